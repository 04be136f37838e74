"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.session import as_column

# Fixed patterns: four digits anywhere; a leading block between two lines of three dashes.
YEAR = r"(\d{4})"
FRONT_MATTER = r"(?s)^---\n(.*?)\n---\n"
# Fixed set: every Unicode white-space character, and the four ASCII separators.
WHITE_SPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def extract_year(text: str | Column) -> Column:
    """First run of four digits as a string, or null."""
    return F.nullif(F.regexp_extract(as_column(text), YEAR, 1), F.lit(""))


def path_tail(path: str | Column, n: int) -> Column:
    """Last ``n`` segments of a path, joined again with ``/``."""
    parts = F.split(as_column(path), "/")
    start = F.greatest(F.size(parts) - F.lit(n - 1), F.lit(1))
    return F.array_join(F.slice(parts, start, F.lit(n)), "/")


def normalize_instruction(text: str | Column) -> Column:
    """Collapse white space, trim, drop trailing colons."""
    return F.rtrim(F.trim(F.regexp_replace(as_column(text), WHITE_SPACE, " ")), F.lit(":"))


def front_matter(card: str | Column) -> Column:
    """The leading metadata block without its dashes, or null."""
    card = as_column(card)
    return F.when(card.rlike(FRONT_MATTER), F.regexp_extract(card, FRONT_MATTER, 1))


def card_body(card: str | Column) -> Column:
    """The text after the leading metadata block."""
    return F.regexp_replace(as_column(card), FRONT_MATTER, "")


def split_front_matter(rows: DataFrame, card: str) -> DataFrame:
    return rows.withColumns({"front_matter": front_matter(card), "body": card_body(card)})


def prefix_levels(code: str | Column) -> Column:
    """All prefixes of a hierarchical code, coarse to fine, as an array; an empty code has none."""
    code = as_column(code)
    steps = F.when(F.length(code) > 0, F.sequence(F.lit(1), F.length(code)))
    prefixes = F.transform(steps, lambda n: F.substring(code, F.lit(1), n))
    return F.when(F.length(code) == 0, F.array().cast("array<string>")).otherwise(prefixes)


def explode_prefixes(rows: DataFrame, code: str) -> DataFrame:
    """One row per prefix: ``level`` 1 is the first character."""
    return rows.select("*", F.posexplode(prefix_levels(code)).alias("_pos", "prefix")).select(
        *rows.columns, (F.col("_pos") + 1).alias("level"), "prefix"
    )
