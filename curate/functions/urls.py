"""Column expressions on URLs: host, public suffix, host pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.functions.vectors import let
from curate.session import as_column

# A short list of rules known by default (plain, ``*.`` for any label, ``!`` for an exception).
# A complete list of public suffixes has the same form: pass its lines, or a table of them.
RULES = (
    "com org net edu gov mil int info biz name io ai app dev co me tv "
    "co.uk ac.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk police.uk sch.uk "
    "ac.jp co.jp ed.jp go.jp or.jp ne.jp *.kawasaki.jp !city.kawasaki.jp *.ck !www.ck *.bd *.np *.kh"
).split()

# Labels under which countries commonly register names, as in ``gouv.fr`` or ``ac.be``.
SECOND_LEVEL = "ac co com edu gob gouv gov govt go mil net nom or org".split()

# scheme :// [user info @] host [: port] — the host without a trailing dot.
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@\[\]\s]+?)\.?(?::\d*)?(?:[/?#].*)?$"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"
IPV4 = r"^\d{1,3}(?:\.\d{1,3}){3}$"


def url_scheme(url: str | Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(as_column(url), SCHEME, 1), F.lit("")))


def url_host(url: str | Column) -> Column:
    """Lower-case host without user info, port and trailing dot; null for anything malformed."""
    return F.lower(F.nullif(F.regexp_extract(as_column(url), HOST, 1), F.lit("")))


def _candidates(host: Column, depth: int) -> list[Column]:
    """The last ``depth``, ..., 1 labels of a host; null where it has fewer."""
    parts = F.size(F.split(host, r"\."))
    return [F.when(parts >= n, F.substring_index(host, ".", -n)) for n in range(depth, 0, -1)]


def _parent(name: Column) -> Column:
    """A name without its first label; null for a single label."""
    return F.nullif(F.regexp_replace(name, r"^[^.]*\.?", ""), F.lit(""))


def _of_country(name: Column, second_level: Sequence[str]) -> Column:
    """Whether a name is a common second-level label under a two-letter country code."""
    if not second_level:
        return F.lit(False)
    return name.rlike(rf"^(?:{'|'.join(second_level)})\.[a-z]{{2}}$")


def host_suffix(host: str | Column, rules: Sequence[str] = RULES, second_level: Sequence[str] = SECOND_LEVEL) -> Column:
    """Public suffix of a host: ``ac.uk`` rather than ``uk``.

    The longest matching rule wins, an exception beats all; a host that no rule matches has its last
    label as suffix. Null only for a null host and for IP addresses. Rules are looked up in hash sets
    inside the row, so there is no join and no shuffle; for a long list see ``url_tld`` with a table.
    """
    plain = {r for r in rules if r[0] not in "*!"} or {""}
    any_label = {r[2:] for r in rules if r.startswith("*.")} or {""}
    except_ = {r[1:] for r in rules if r.startswith("!")} or {""}
    depth = max(r.count(".") for r in [*rules, "a.b"]) + 1

    def found(host: Column) -> Column:
        # Bound once: the labels, then the names of 1, ..., depth labels; a name's parent is the one before it.
        return let(F.split(host, r"\."), lambda labels: let(F.array(*_candidates(host, depth)[::-1]), lambda names: decide(host, labels, names)))

    def decide(host: Column, labels: Column, names: Column) -> Column:
        name = [F.get(names, F.lit(n)) for n in range(depth)]
        common = F.try_element_at(labels, F.lit(-2)).isin(*second_level) & F.try_element_at(labels, F.lit(-1)).rlike("^[a-z]{2}$") if second_level else F.lit(False)
        excepted = [F.when(name[n].isin(*except_), name[n - 1] if n else F.lit(None)) for n in range(depth - 1, -1, -1)]
        ruled = []
        for n in range(depth - 1, -1, -1):
            listed = name[n].isin(*plain)
            listed = listed | name[n - 1].isin(*any_label) if n else listed
            ruled.append(F.when(listed | (name[n].isNotNull() & common) if n == 1 else listed, name[n]))
        address = F.substring(host, 1, 1).between("0", "9") & host.rlike(IPV4)
        return F.when(~address, F.coalesce(*excepted, *ruled, name[0]))

    return let(as_column(host), found)


def url_tld(
    rows: DataFrame, url: str, name: str = "tld", rules: Sequence[str] | DataFrame = RULES, second_level: Sequence[str] = SECOND_LEVEL
) -> DataFrame:
    """Add the public suffix of a URL's host; null for anything malformed and for IP addresses.

    ``rules`` is a list, or a table with one rule per row in its first column. A table is met by
    equi-joins on the candidate suffixes of each host, which Spark broadcasts while it is small.
    """
    if not isinstance(rules, DataFrame):
        return rows.withColumn(name, host_suffix(url_host(url), rules, second_level))
    rule = F.col(rules.columns[0])
    listed = rules.select(F.regexp_replace(rule, r"^(\*\.|!)", "").alias("_rule"), F.regexp_extract(rule, r"^[*!]", 0).alias("_kind")).distinct()
    listed = listed.groupBy("_rule").agg(*[F.max(F.col("_kind") == k).alias(c) for k, c in (("", "_plain"), ("*", "_any"), ("!", "_not"))])
    depth = 5  # of the longest rule in the public list
    out = rows.withColumn("_host", url_host(url))
    for n, candidate in zip(range(depth, 0, -1), _candidates(F.col("_host"), depth)):
        one = listed.withColumnsRenamed({c: f"{c}{n}" for c in listed.columns})
        out = out.withColumn(f"_c{n}", candidate).join(one, F.col(f"_c{n}") == F.col(f"_rule{n}"), "left")

    def has(kind: str, n: int) -> Column:
        return F.coalesce(F.col(f"_{kind}{n}"), F.lit(False)) if n else F.lit(False)

    span = range(depth, 0, -1)
    excepted = [F.when(has("not", n), _parent(F.col(f"_c{n}"))) for n in span]
    ruled = [F.when(has("plain", n) | has("any", n - 1) | _of_country(F.col(f"_c{n}"), second_level), F.col(f"_c{n}")) for n in span]
    found = F.when(~F.col("_host").rlike(IPV4), F.coalesce(*excepted, *ruled, F.col("_c1")))
    return out.withColumn("_found", found).select(*[c for c in rows.columns if c != name], F.col("_found").alias(name))


def url_parts(rows: DataFrame, url: str, n: int) -> DataFrame:
    """Scheme and the first ``n`` dot-separated host pieces as categorical columns."""
    pieces = F.split(url_host(url), r"\.")
    columns = {"scheme": url_scheme(url)}
    columns |= {f"url{i + 1}": F.get(pieces, i) for i in range(n)}
    return rows.withColumns(columns)
