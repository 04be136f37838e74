"""Column expressions on model output: JSON extraction, record validation, chat messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curate.session import as_column

# Fixed patterns: a fenced JSON block, else the first brace group without inner closing braces.
JSON_FENCE = r"(?s)```json\n(.*?)```"
BRACE_GROUP = r"(?s)(\{[^}]*\})"
# Fixed format of annotation lines: entity -|- concept -|- description.
ANNOTATION_SEPARATOR = "-|-"


def is_json(text: str | Column) -> Column:
    """True when the whole text is one JSON value; null for null.

    Spark's parsers stop after the first value. Whatever follows it breaks the text either as
    the only element of an array or as the only value of an object.
    """
    text = as_column(text)
    strict = {"allowSingleQuotes": "false"}
    element = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", strict)
    value = F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "map<string,string>", strict)
    return F.when(text.isNotNull(), element.isNotNull() & value.isNotNull())


def extract_json_block(text: str | Column) -> Column:
    """The first fenced JSON block if it parses, else the first brace group if that parses, else null."""
    text = as_column(text)
    found = [F.regexp_extract(text, p, 1) for p in (JSON_FENCE, BRACE_GROUP)]
    return F.coalesce(*[F.when(is_json(block), block) for block in found])


def parse_json_record(rows: DataFrame, column: str, schema: StructType | str) -> DataFrame:
    """Add the fields of a JSON object and ``parsed_into_json``.

    Broken text and JSON that is not an object give nulls and false.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    is_object = F.col(column).rlike(r"^\s*\{") & is_json(column)
    rows = rows.withColumn("parsed_into_json", F.coalesce(is_object, F.lit(False)))
    rows = rows.withColumn("_record", F.when(F.col("parsed_into_json"), F.from_json(column, schema)))
    return rows.withColumns({f: F.col("_record")[f] for f in schema.fieldNames()}).drop("_record")


def parse_success_rate(rows: DataFrame, output: str, flag: str = "parsed_into_json") -> DataFrame:
    """Rows that parsed and rows that did not, and how many of them had no output at all."""
    return rows.groupBy(flag).agg(F.count("*").alias("n"), F.count_if(F.col(output).isNull()).alias("n_null"))


class Rule:
    """A named condition on a record; ``broken`` is true where the record violates it."""

    def __init__(self, name: str, broken: Column):
        self.name, self.broken = name, broken


def required(column: str) -> Rule:
    return Rule(f"{column}:missing", F.col(column).isNull())


def one_of(column: str, allowed: Sequence[str]) -> Rule:
    return Rule(f"{column}:not_allowed", ~F.col(column).isin(list(allowed)))


def min_length(column: str, n: int) -> Rule:
    return Rule(f"{column}:too_short", F.char_length(column) < n)


def max_length(column: str, n: int) -> Rule:
    return Rule(f"{column}:too_long", F.char_length(column) > n)


def max_items(column: str, n: int) -> Rule:
    return Rule(f"{column}:too_many_items", F.size(column) > n)


def each_min_length(column: str, n: int) -> Rule:
    return Rule(f"{column}:item_too_short", F.exists(column, lambda x: F.char_length(x) < n))


def validate_record(rows: DataFrame, rules: Sequence[Rule], name: str = "violations") -> DataFrame:
    """Add the list of broken rules. A null field breaks ``required`` only, so other fields are optional."""
    return rows.withColumn(name, F.array_compact(F.array(*[F.when(r.broken, F.lit(r.name)) for r in rules])))


def parse_delimited_annotations(rows: DataFrame, column: str) -> DataFrame:
    """One row per well-formed annotation line; other lines are dropped."""
    lines = rows.withColumn("_line", F.explode(F.split(F.col(column), "\n")))
    parts = lines.withColumn("_parts", F.split("_line", r"-\|-")).filter(F.size("_parts") == 3)
    fields = {n: F.trim(F.get("_parts", i)) for i, n in enumerate(("entity", "concept", "description"))}
    return parts.withColumns(fields).drop("_line", "_parts", column)


def build_messages(
    prompt: str | Column, response: Column | None = None, system: str | Column | None = None
) -> Column:
    """Chat rows as an array of role and content; a struct or list response becomes JSON text."""
    turns = []
    if system is not None:
        turns.append(("system", F.lit(system) if isinstance(system, str) else system))
    turns.append(("user", as_column(prompt)))
    if response is not None:
        turns.append(("assistant", response))
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns])


def has_nested_value(items: str | Column, field: str, wanted: str) -> Column:
    """True when an element's field contains the text; a missing list or field counts as false."""
    return F.coalesce(F.exists(as_column(items), lambda x: F.contains(x[field], F.lit(wanted))), F.lit(False))


def metadata_state(card: str | Column, values: str | Column) -> Column:
    """State of a metadata list: ``No card data``, ``false`` (no list), ``true``, null (empty list).

    ``card`` is null where there is no card; an empty card has to be made null first.
    """
    card, values = as_column(card), as_column(values)
    return (
        F.when(card.isNull(), "No card data")
        .when(values.isNull(), "false")
        .when(F.size(values) >= 1, "true")
    )
