"""Nested records of unknown schema in model output: extraction, variants, inferred schema, violations."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.session import as_column

#: A string with its escapes, or a brace.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)
#: How an object begins: with a quoted name, or its end.
_BEGIN = re.compile(r'\{(?=\s*["}])')


def balanced_object(text: str) -> str | None:
    """The first brace group of a text that begins like an object and is balanced, braces inside strings apart.

    One pass: a group that is never closed is left for the first complete one inside it.
    """
    begin, done = _BEGIN.search(text), None
    if begin is None:
        return None
    begins = {m.start() for m in _BEGIN.finditer(text, begin.start())}
    open_at: list[int] = []
    for token in _TOKEN.finditer(text, begin.start()):
        if token[0] == "{":
            open_at.append(token.start())
        elif token[0] == "}" and open_at:
            at = open_at.pop()
            if at in begins and (done is None or at < done[0]):
                done = (at, token.end())
            if done and not any(i in begins and i < done[0] for i in open_at):
                break  # nothing that is still open began before it
    return text[done[0] : done[1]] if done else None


def extract_object(text: str | Column) -> Column:
    """The first balanced object in a text, null if there is none."""

    def extract(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else balanced_object(t) for t in texts.to_pylist()], pa.string())

    extract.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(extract, "string")(as_column(text).cast("string"))


def parse_record(text: str | Column) -> Column:
    """The first balanced object of a text as a variant, null where it is missing or broken."""
    return F.try_parse_json(extract_object(text))


def field(record: str | Column, path: str, kind: str) -> Column:
    """A value of a variant by path (``$.a.b[0]``) and type; null where it is missing or does not fit."""
    return F.try_variant_get(as_column(record), path, kind)


def inferred_schema(rows: DataFrame, record: str, name: str = "schema") -> DataFrame:
    """One row: the schema that fits the variants of all rows."""
    return rows.agg(F.schema_of_variant_agg(record).alias(name))


def violations(record: str | Column, expected: dict[str, str]) -> Column:
    """Paths of a variant that are missing, or whose value is of another kind than expected.

    Kinds are the first word of a variant's schema: ``BIGINT``, ``STRING``, ``BOOLEAN``, ``OBJECT``, ``ARRAY``, ... All paths of a null record
    are missing.
    """
    record = as_column(record)
    tests = []
    for path, kind in expected.items():
        found = F.schema_of_variant(F.try_variant_get(record, path, "variant"))
        tests.append(F.when(~F.coalesce(found.startswith(kind), F.lit(False)), F.lit(path)))
    return F.array_compact(F.array(*tests))
