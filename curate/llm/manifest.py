"""A Merkle manifest of a dataset: a digest per row, a tree of digests per group, and a proof per row.

Rows of a group are leaves in the order of their key. While a group has several nodes, every run of ``FAN`` consecutive
ones becomes its parent, whose digest is that of the run's digests one after the other. The nodes that remain, one
per group, are the leaves of a last tree, whose top is the root of the dataset.

Nodes are labelled with nested intervals: a node covers the ranks ``[lo, hi)`` of its leaves. A node of a level lies in the
bucket ``lo div FAN ** level``, so its parent is found by an equi-join on group and bucket of the level above, and the interval decides
(containment). Within a parent, what is left of its interval without the node's own are the siblings.
Sibling digests are attached from the top down: a level has an eighth of the rows of the one below, and
the lowest nodes keep their leaves as a list of at most ``FAN``, so that what is shuffled stays a few hundred bytes for eight rows
and no row meets all its ancestors one by one. Texts are read once, to be hashed; a group with a third of all
rows is spread by rank like any other, and the tables of nodes are written to the shared folder level by level.

Defined results: a null field counts as ``-``, everything else as its number of UTF-8 bytes, a colon and the value (empty: ``0:``);
null keys come first, null groups form one group, before all others; rows that repeat a key are ordered by
digest and each keeps its leaf; a lone leaf is its group's top, a lone group's top is the root; other columns are left behind, whatever
their names; an empty table has no rows, hence no root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.llm.frames import table
from curate.operators.ordering import row_index

#: Children of a node.
FAN = 8
#: Fields of a row that its digest covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(fields: Sequence[Column]) -> Column:
    """Digest of a row's fields, each with its length, so that no two rows give the same string."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda c: c["hash"]), "")


def siblings(children: Column, lo: Column, hi: Column) -> Column:
    """Digests left and right of ``[lo, hi)`` within a parent: the parent's interval without the node's own."""
    return F.struct(
        joined(F.filter(children, lambda c: c["hi"] <= lo)).alias("before"), joined(F.filter(children, lambda c: c["lo"] >= hi)).alias("after")
    )


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``lo``, the place within ``group`` along ``order`` from 0, and ``n``, the group's number of rows."""
    placed = row_index(rows, ["group", *order], 0, "at")
    sizes = table(placed.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    sizes = sizes.withColumnRenamed("group", "of")
    met = placed.join(sizes, placed["group"].eqNullSafe(sizes["of"]))
    return met.withColumn("lo", F.col("at") - F.col("first")).drop("at", "first", "of")


def trees(leaves: DataFrame) -> DataFrame:
    """``group, n, lo, hi, hash, children, path``: the lowest nodes of each group's tree with the siblings on the way to its top.

    ``leaves`` has ``group, n, lo, hash, row``. ``children`` are a node's leaves with ``lo, hi, hash, row``; ``path`` has a
    struct ``before, after`` per level above. A lone leaf is listed under a node of its own digest.
    """

    def parents(nodes: DataFrame, level: int, *more: str) -> DataFrame:
        child = F.struct("lo", (F.col("hi") if level > 1 else F.col("lo") + 1).alias("hi"), "hash", *more)
        runs = nodes.groupBy("group", "n", F.floor(F.col("lo") / FAN**level).cast("long").alias("bucket")).agg(F.array_sort(F.collect_list(child)).alias("children"))
        top = F.when(F.col("n") > 1, F.sha2(joined(F.col("children")), 256)).otherwise(F.get("children", F.lit(0))["hash"])
        ends = F.array_min(F.transform("children", lambda c: c["lo"])), F.array_max(F.transform("children", lambda c: c["hi"]))
        return table(runs.select("group", "n", "bucket", ends[0].alias("lo"), ends[1].alias("hi"), top.alias("hash"), "children"))

    levels = [parents(leaves, 1, "row")]
    largest = leaves.agg(F.max("n")).first()[0] or 0
    while largest > FAN ** len(levels):
        level = len(levels)
        levels.append(parents(levels[-1].filter(F.col("n") > FAN**level).select("group", "n", "lo", "hi", "hash"), level + 1))

    none = F.array().cast("array<struct<before:string,after:string>>")
    above = levels[-1].select("*", F.col("hash").alias("top"), none.alias("path"))
    for level in range(len(levels) - 1, 0, -1):
        below, up = levels[level - 1], above.select([F.col(c).alias(f"_{c}") for c in above.columns])
        same = below["group"].eqNullSafe(up["_group"]) & (F.floor(below["lo"] / FAN ** (level + 1)) == up["_bucket"])
        met = below.join(up, same & (up["_lo"] <= below["lo"]) & (below["hi"] <= up["_hi"]), "left")
        step = F.concat(F.array(siblings(F.col("_children"), F.col("lo"), F.col("hi"))), F.col("_path"))
        found = F.col("_bucket").isNotNull()
        above = met.select(*below.columns, F.when(found, F.col("_top")).otherwise(F.col("hash")).alias("top"), F.when(found, step).otherwise(none).alias("path"))
    return above.drop("bucket")


def per_leaf(nodes: DataFrame) -> DataFrame:
    """``group, hash, row, top, path`` of every leaf below the nodes of ``trees``."""
    one = nodes.select("group", "n", "children", "top", "path", F.explode("children").alias("c"))
    step = F.array(siblings(F.col("children"), F.col("c.lo"), F.col("c.hi")))
    return one.select("group", "c.hash", "c.row", "top", F.when(F.col("n") > 1, F.concat(step, "path")).otherwise(F.col("path")).alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The top that follows from a leaf and the siblings on its way."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, presented: dict[str, Column] | None = None) -> DataFrame:
    """``key, group, leaf, presented, subroot, root, path`` of every row.

    ``path`` has the siblings from the row's own level to the root. ``presented`` replaces fields by what a holder of the
    row claims them to be; the digest of that claim stands in the column of this name (by default the leaf itself).
    """
    claim = digest([(presented or {}).get(f, F.col(f)) for f in fields])
    hashed = rows.select(F.col(group).alias("group"), F.col(key).alias("key"), digest([F.col(f) for f in fields]).alias("hash"), claim.alias("presented"))
    leaves = ranked(table(hashed), ["key", "hash", "presented"])
    low = trees(table(leaves.select("group", "n", "lo", "hash", F.struct("key", "presented").alias("row"))))
    tops = table(low.filter("lo = 0").select(F.lit(0).alias("group"), F.struct("group").alias("row"), F.col("top").alias("hash")))
    upper = per_leaf(trees(table(ranked(tops, ["row"]).select("group", "n", "lo", "hash", "row"))))
    upper = table(upper.select(F.col("row.group").alias("of"), F.col("top").alias("root"), F.col("path").alias("rest")))
    met = low.join(upper, low["group"].eqNullSafe(upper["of"])).withColumn("path", F.concat("path", "rest"))
    whole = per_leaf(met.withColumn("top", F.struct("top", "root")))
    return whole.select(
        F.col("row.key").alias(key), F.col("group").alias(group), F.col("hash").alias("leaf"), "row.presented",
        F.col("top.top").alias("subroot"), "top.root", "path",
    )


def proof(path: Column) -> Column:
    """Digest of all siblings on the way to the root, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)
