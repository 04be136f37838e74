"""Similarity join on word shingles by a blocked sparse product of documents and n-grams.

Two documents link if their sets of n-word shingles have a Jaccard similarity of at least t. The
incidence matrix of documents by shingles is multiplied with its transpose block by block of columns, with
bounds that follow from the sizes of the sets alone:

* documents with equal sets are one row of the matrix (a class), found by digest;
* a link at similarity t needs ceil(t n) common shingles, so with columns ordered from rare to frequent a pair first
  meets within the first n - ceil(t n) + 1 columns of both rows: only those enter the product (the head of a row);
* in a column, pairs whose sizes differ too much, or whose remaining columns can't add up to the needed overlap,
  are discarded before anything is emitted;
* of the pairs left, those whose heads share too few columns go; the others get their overlap counted over the
  whole rows. Both products are taken for blocks of pairs inside tasks.

Only links matter, not all pairs of a group: first each row meets one other row, the pivot that most of its columns
name; links are verified and joined to components. Only columns that still hold several components are multiplied in
full, across components: columns with the same smallest row lie together, since rows that are alike share most of them, and a
task finds the rows that may still link. A row that may with few others is compared with each; whole rows of those with many
meet as matrices inside tasks, and only links leave a task. So no table holds the pairs of a group, and no component is split: what is not verified lies within one already (``n_verified`` counts
verified links only, so it is a lower bound of a class's links).

The order of columns comes from shingle counts in a hash sample of documents (``SAMPLE`` of them), of which at most
``FREQUENT`` are broadcast; any common order gives the same links, frequent columns last keep columns short.

Defined results: a text of fewer than n words has its whole word sequence as one shingle; null texts and texts
without words have an empty set and link with nothing; rows that repeat an id belong to the component of their own
text; null ids count as the smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.llm.frames import BITS, NO_ID, arrays_of, bit_of, bitmap_of, id_in, id_out, maybe_in, plain, release_memory, table
from curate.llm.words import Hasher, Words, chunks, cuts, lower_ascii, spaces
from curate.operators.ordering import row_index
from curate.session import fresh_path, materialize, scratch

#: Words per shingle and least similarity in percent, unless the caller names others.
WORDS, PERCENT = 5, 80
#: One document in so many is counted for the order of columns; so many frequent shingles are kept at most, each
#: with at least so many sampled documents.
SAMPLE, FREQUENT, OFTEN = 16, 1 << 16, 4
#: Rounds in which every row meets one pivot, before columns are multiplied in full.
ROUNDS = 2
#: Rows multiplied together, in bytes of hashes.
BLOCK_BYTES = 4 << 20
#: Entries of columns multiplied in one task, and pairs formed at a time.
FAMILY, PAIRS = 200_000, 1 << 20
#: Rows and bytes of hashes of a set that one task compares; rows of a set of which all links are passed on, and of a column
#: that is multiplied pair by pair; columns of a matrix.
SET_ROWS, SET_BYTES, SMALL, WIDE = 2048, 16 << 20, 64, 1024
#: Pairs of a row that are verified one by one.
MANY = 16
SEED = 47


class Shingles:
    """Distinct shingle hashes of each text of a run, concatenated; ``edges`` separates texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: Hasher, gap: np.ndarray, low: np.ndarray, words: int):
        w = Words(data, offsets, hasher, gap, low)
        at = np.flatnonzero(w.windows(words))
        key, doc = hasher.windows(w.hash, words)[at], w.text_of_word()[at]
        short = np.flatnonzero((w.count > 0) & (w.count < words))
        if len(short):
            sums = hasher.sums(w.hash)
            key = np.concatenate([key, hasher.spans(sums, w.first[short], w.first[short + 1]) ^ np.uint64(words)])
            doc = np.concatenate([doc, short])
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        self.key, self.doc = key[new], doc[new]
        self.edges = np.searchsorted(self.doc, np.arange(len(w.count) + 1))


def _each(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, int, Shingles]]:
    hasher, gap, low = Hasher(SEED), spaces(), lower_ascii()
    for batch in batches:
        for first, last, data, offsets in chunks(batch["text"]):
            yield batch.slice(first, last - first), first, Shingles(data, offsets, hasher, gap, low, words)
    release_memory()


def frequent_shingles(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent shingles, sorted, and the rank of each from rare to frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, s in _each(batches, words):
            key, n = np.unique(s.key, return_counts=True)
            yield arrays_of(shingle=key.view(np.int64), n=n)

    sample = plain(docs).filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    top = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()  # at most FREQUENT rows
    key = np.array([r.shingle for r in top], np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], (len(key) - np.arange(len(key)))[order]


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """Fewest common shingles of a row of n with any row it links to."""
    return -(-percent * n // 100)


def heads(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_key, n, digest, head`` of every row: size and digest of its set, and its first columns (64-bit hashes)."""
    keys, ranks = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, s in _each(batches, words):
            rank = np.zeros(len(s.key), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, s.key), len(keys) - 1)
                rank = np.where(keys[at] == s.key, ranks[at], 0)
            order = np.lexsort((s.key, rank, s.doc))
            columns, size = s.key[order], np.diff(s.edges)
            head = np.where(size > 0, size - needed(size, percent) + 1, 0)
            yield arrays_of(
                doc_id=batch["doc_id"], text_key=batch["text_key"], n=size.astype(np.int32),
                digest=pa.array([hashlib.md5(s.key[a:b].tobytes()).digest() for a, b in zip(s.edges, s.edges[1:])], pa.binary()),
                head=pa.array([columns[a : a + h].tobytes() for a, h in zip(s.edges.tolist(), head.tolist())], pa.binary()),
            )

    return keyed(docs).mapInArrow(run, "doc_id long, text_key long, n int, digest binary, head binary")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, text_key``: with the id, a hash of the text tells rows apart that repeat an id."""
    return plain(docs).withColumn("text_key", F.xxhash64("text"))


def _short(head: str) -> Column:
    """The hashes of a head cut to 32 bits each."""

    @F.pandas_udf("binary")
    def cut(heads: pd.Series) -> pd.Series:
        return heads.map(lambda x: np.frombuffer(x, np.uint64).astype(np.uint32).tobytes())

    return cut(head)


def columns_of(classes: DataFrame) -> DataFrame:
    """One row ``shingle, rep, n, place`` per entry of the heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = [np.frombuffer(x, np.int64) for x in batch["head"].to_pylist()]
            size = np.array([len(x) for x in head])
            if size.sum():
                yield arrays_of(
                    shingle=np.concatenate(head), rep=np.repeat(batch["rep"].to_numpy(), size), n=np.repeat(batch["n"].to_numpy(), size),
                    place=np.concatenate([np.arange(k, dtype=np.int32) for k in size]),
                )

    return classes.select("rep", "n", "head").mapInArrow(run, "shingle long, rep long, n int, place int")


def may_link(n: Column, place: Column, m: Column, other: Column, percent: int = PERCENT) -> Column:
    """Whether two rows that meet in a column, with these sizes and places of it, can still reach the needed overlap.

    They have met at most ``least(place, other)`` times before, and have what remains after it to go.
    """
    most = F.least(place, other) + 1 + F.least(n - place, m - other) - 1
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def _common(part: pa.RecordBatch, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of both sides of each pair, and how many keys they share."""
    x, y = ([np.frombuffer(v, kind) for v in part[c].to_pylist()] for c in ("x", "y"))
    n, m = (np.array([len(v) for v in side]) for side in (x, y))
    pair = np.arange(part.num_rows)
    key, row = np.concatenate(x + y), np.concatenate([np.repeat(pair, n), np.repeat(pair, m)])
    order = np.lexsort((key, row))
    both = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    return n, m, np.bincount(row[order][1:][both], minlength=len(pair))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of pairs of bounded size, or of one pair."""
    for batch in batches:
        size = pc.add(pc.binary_length(batch["x"]), pc.binary_length(batch["y"])).to_numpy(zero_copy_only=False)
        for first, last in cuts(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), BLOCK_BYTES):
            yield batch.slice(first, last - first)
    release_memory()


def _paired(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with columns of both rows: the first as ``x`` and ``y``, others with the suffixes ``_x`` and ``_y``."""
    first, *more = columns
    left = rows.select(F.col("rep").alias("a"), F.col(first).alias("x"), *[F.col(c).alias(f"{c}_x") for c in more])
    right = rows.select(F.col("rep").alias("b"), F.col(first).alias("y"), *[F.col(c).alias(f"{c}_y") for c in more])
    return pairs.join(left, "a").join(right, "b")


def meet_in_heads(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose heads share enough columns.

    Up to the end of the head that ends first, all common columns are in both heads; beyond it the row has n minus
    its head left. So the overlap is at most the columns common to both heads plus the larger remainder. Hashes are
    cut to 32 bits here, which can only make the bound larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            h, k, common = _common(part, np.uint32)
            n, m = part["n_x"].to_numpy(), part["n_y"].to_numpy()
            most = common + np.maximum(n - h, m - k)
            link = pa.array((100 + percent) * most >= percent * (n.astype(np.int64) + m))
            yield arrays_of(a=part["a"].filter(link), b=part["b"].filter(link))

    return _paired(pairs, classes, "short", "n").select("a", "b", "x", "y", "n_x", "n_y").mapInArrow(run, "a long, b long")


def whole_rows(wanted: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``rep, shingles`` of the classes in ``wanted`` (``rep, doc, digest``), made again from the texts.

    A bitmap of hashed ids, of fixed size, tells the scan which texts may be wanted; only their shingles are
    shuffled, never texts.
    """
    bitmap = np.zeros(BITS // 8, np.uint8)
    for r in bitmap_of(wanted, "doc").collect():  # BITS / 8 bytes at most
        bitmap[(r.k - 1) * len(r.bits) : r.k * len(r.bits)] = np.frombuffer(r.bits, np.uint8)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked = (b.filter(pa.array((bitmap[p >> 3] >> (p & 7)) & 1 == 1)) for b in batches for p in [b["place"].to_numpy()])
        for batch, _, s in _each(picked, words):
            own = [s.key[a:b].tobytes() for a, b in zip(s.edges, s.edges[1:])]
            digests = pa.array([hashlib.md5(k).digest() for k in own], pa.binary())
            yield arrays_of(doc=batch["doc_id"], digest=digests, shingles=pa.array(own, pa.binary()))

    made = plain(docs).withColumn("place", bit_of()).mapInArrow(whole, "doc long, digest binary, shingles binary")
    return table(made.join(wanted, ["doc", "digest"]).select("rep", "shingles"))


def overlaps(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` that link, by the overlap of their whole rows (written)."""
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = whole_rows(table(classes.select("rep", "doc", "digest").join(ids, "rep")), docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            n, m, common = _common(part, np.uint64)
            link = pa.array(100 * common >= percent * (n + m - common))
            yield arrays_of(a=part["a"].filter(link), b=part["b"].filter(link))

    return table(_paired(pairs, sets, "shingles").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """``rep, component`` (smallest id) of every end of an edge, by alternating stars until nothing changes."""
    links = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        # Large star: larger neighbours of a node go to its smallest neighbour (or itself).
        every = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = every.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = table(every.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: smaller neighbours of a node, and the node, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = table(moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    return links.groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("component"))


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id, n_verified`` of every row.

    ``class_id`` is the smallest id with an equal set, ``component_id`` the smallest reachable over links. ``n_verified``
    counts the verified links of the class: at least one if it has any, not all that there are.
    """
    return _kept_groups(docs, words, percent).drop("text_key", "component")


def _kept_groups(docs: DataFrame, words: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    with scratch(spark):  # only the result is kept
        return materialize(_groups(docs, words, percent), fresh_path(spark, "groups"))


def _labelled(shared: DataFrame, known: DataFrame | None) -> DataFrame:
    """The entries of shared columns with the component of their row: itself where it has no link yet."""
    if known is None:
        return shared.withColumn("component", F.col("rep"))
    return shared.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _best_pivots(labelled: DataFrame, percent: int) -> DataFrame:
    """For each row one row ``b`` of another component, a pivot of its columns: the one it meets most often.

    A column's pivot is its row of the smallest component, so the rows of a group mostly have the same one.
    """
    first = Window.partitionBy("shingle").orderBy("component", "rep").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = F.col("pivot")
    met = labelled.withColumn("pivot", F.first(F.struct("component", "rep", "n", "place")).over(first)).filter(F.col("component") != p["component"])
    met = met.filter(may_link(F.col("n"), F.col("place"), p["n"], p["place"], percent))
    counts = met.groupBy(F.col("rep").alias("a"), p["rep"].alias("b")).agg(F.count("*").alias("c"))
    best = counts.groupBy("a").agg(F.max(F.struct(F.col("c"), F.bitwise_not("b").alias("low"), F.col("b"))).getField("b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_rows(mixed: DataFrame, percent: int) -> DataFrame:
    """Rows of different components that may link: ``a, b, c, n, m``, pairs with the columns that their heads share and their
    sizes, and where ``component`` is set, a row ``a`` of size ``n`` of the set ``b`` in ``part``, any two of which may link.

    Columns are dealt by their smallest row, large families by column as well; each task multiplies its columns and finds the
    pairs that the bound does not rule out. Pairs of a row that has few go on as pairs, at most ``MANY`` for each row; of the others
    only the rows go on, each once. A pair is in a set, or a pair in every task that does not rule it out.
    """
    dealt = table(mixed.withColumn("family", F.min("rep").over(Window.partitionBy("shingle"))))
    large = dealt.groupBy("family").agg(F.ceil(F.count("*") / FAMILY).alias("parts")).filter("parts > 1")
    split = F.xxhash64("family", F.pmod(F.xxhash64("shingle"), F.col("parts")))
    together = F.pmod(F.xxhash64("family"), F.lit(-(-dealt.count() // FAMILY) + 1))
    placed = dealt.join(large, "family", "left").withColumn("part", F.when(F.col("parts").isNotNull(), split).otherwise(together))

    def multiply(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("shingle")
        shingle, n, place, component = (group[c].to_numpy() for c in ("shingle", "n", "place", "component"))
        reps, local = np.unique(group["rep"].to_numpy(), return_inverse=True)
        sizes, named = np.zeros((2, len(reps)), np.int64)
        sizes[local], named[local] = n, component
        ends = np.searchsorted(shingle, shingle, "right")
        after = ends - np.arange(len(shingle)) - 1  # rows behind each in its column
        code, count = np.empty(0, np.int64), np.empty(0, np.int64)
        for first, last in cuts(np.concatenate([[0], np.cumsum(after)]), PAIRS):
            width = after[first:last]
            left = np.repeat(np.arange(first, last), width)
            right = left + 1 + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            x, y = sizes[local[left]], sizes[local[right]]
            most = np.minimum(place[left], place[right]) + np.minimum(x - place[left], y - place[right])
            live = (component[left] != component[right]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & ((100 + percent) * most >= percent * (x + y))
            low, high = np.minimum(local[left[live]], local[right[live]]), np.maximum(local[left[live]], local[right[live]])
            new, times = np.unique(low * len(reps) + high, return_counts=True)
            code, at = np.unique(np.concatenate([code, new]), return_inverse=True)
            count = np.bincount(at, np.concatenate([count, times]), len(code)).astype(np.int64)
        a, b = np.divmod(code, max(len(reps), 1))
        # Columns of a head that lie elsewhere can add at most their number: pairs that stay short of the bound go.
        head = sizes - needed(sizes, percent) + 1
        elsewhere = head - np.bincount(local, minlength=len(reps))
        most = count + np.minimum(elsewhere[a], elsewhere[b]) + np.maximum(sizes[a] - head[a], sizes[b] - head[b])
        live = (100 + percent) * most >= percent * (sizes[a] + sizes[b])
        a, b, count = a[live], b[live], count[live]
        pairs = np.bincount(a, minlength=len(reps)) + np.bincount(b, minlength=len(reps))
        many = np.minimum(pairs[a], pairs[b]) > MANY
        x, y = a[many], b[many]
        rows, a, b, count = np.unique(np.concatenate([x, y])), a[~many], b[~many], count[~many]
        inset = reps[_joined(x, y, len(reps))[rows]]

        def column(first: np.ndarray, second: np.ndarray | None, kind: pa.DataType) -> pa.Array:
            return pa.concat_arrays([pa.array(first, kind), pa.nulls(len(rows), kind) if second is None else pa.array(second, kind)])

        return pa.table({
            "part": np.full(len(a) + len(rows), key[0].as_py()), "a": np.concatenate([reps[a], reps[rows]]), "b": np.concatenate([reps[b], inset]),
            "c": column(count, None, pa.int64()), "n": np.concatenate([sizes[a], sizes[rows]]).astype(np.int32),
            "m": column(sizes[b], None, pa.int32()), "component": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(named[rows])]),
        })

    columns = placed.select("part", "shingle", "rep", "n", "place", "component")
    return columns.groupBy("part").applyInArrow(multiply, "part long, a long, b long, c long, n int, m int, component long")


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of ``n`` nodes that each one reaches over the pairs."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        for side in (a, b):
            np.minimum.at(least, side, low)
            np.minimum.at(least, before[side], low)
        least = least[least]
        if np.array_equal(least, before):
            return least


def links_within(sizes: np.ndarray, key: np.ndarray, row: np.ndarray, edges: np.ndarray, component: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of different components in the same set: all of a small set, of a larger one those of a spanning forest.

    Rows ``edges[i]`` to ``edges[i + 1]`` are set i; ``key, row`` are the entries. Columns with few rows are multiplied pair by
    pair, those with many as matrices. Beside the counts, a row of numbers per pair is held for a quarter of ``PAIRS`` at most.
    """
    width = np.diff(edges)
    cell = np.concatenate([[0], np.cumsum(width * width)])
    own = np.repeat(np.arange(len(width)), width)
    counts = np.zeros(cell[-1], np.int32)
    order = np.lexsort((row, key, own[row]))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[row[1:]] != own[row[:-1]])
    starts = np.flatnonzero(new)
    height = np.diff(np.r_[starts, len(key)])
    column = np.repeat(np.arange(len(starts)), height)
    local = row - edges[own[row]]
    few = height[column] <= SMALL
    at = np.flatnonzero(few)
    after = (starts + height)[column[at]] - at - 1
    for first, last in cuts(np.concatenate([[0], np.cumsum(after)]), PAIRS // 4):
        more = after[first:last]
        left = np.repeat(at[first:last], more)
        right = left + 1 + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        of = own[row[left]]
        found, times = np.unique(cell[of] + local[left] * width[of] + local[right], return_counts=True)
        counts[found] += times.astype(np.int32)
    for i in np.unique(own[row[~few]]).tolist():
        mine = np.flatnonzero(~few & (own[row] == i))
        names, place = np.unique(column[mine], return_inverse=True)
        square = counts[cell[i] : cell[i + 1]].reshape(width[i], width[i])
        for first in range(0, len(names), WIDE):
            inside = (place >= first) & (place < first + WIDE)
            part = np.zeros((width[i], min(WIDE, len(names) - first)), np.float32)
            part[local[mine[inside]], place[inside] - first] = 1
            for low, high in _strips(width[i]):
                square[low:high] += np.triu(part[low:high] @ part.T, low + 1).astype(np.int32)

    def links(x: np.ndarray, y: np.ndarray, common: np.ndarray) -> np.ndarray:
        return (common > 0) & (component[x] != component[y]) & (100 * common >= percent * (sizes[x] + sizes[y] - common))

    a, b = [row[:0]], [row[:0]]
    small = np.flatnonzero(width <= SMALL)
    for first, last in cuts(np.concatenate([[0], np.cumsum(width[small] ** 2)]), PAIRS // 4):
        some = np.concatenate([np.arange(cell[i], cell[i + 1]) for i in small[first:last].tolist()])
        some = some[counts[some] > 0]
        of = np.searchsorted(cell, some, "right") - 1
        x, y = np.divmod(some - cell[of], width[of])
        x, y = x + edges[of], y + edges[of]
        link = links(x, y, counts[some].astype(np.int64))
        a.append(x[link])
        b.append(y[link])
    for i in np.flatnonzero(width > SMALL).tolist():
        square, every = counts[cell[i] : cell[i + 1]].reshape(width[i], width[i]), np.arange(edges[i], edges[i + 1])
        near = np.zeros(square.shape, bool)
        for low, high in _strips(width[i]):
            near[low:high] = links(every[low:high, None], every[None, :], square[low:high].astype(np.int64))
        for u, v in _forest(near):
            a.append(np.full(len(v), u + edges[i]))
            b.append(v + edges[i])
    return np.concatenate(a), np.concatenate(b)


def _strips(width: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of a square matrix with at most a quarter of ``PAIRS`` cells, or of one row."""
    step = max(1, PAIRS // 4 // int(width))
    for low in range(0, int(width), step):
        yield low, min(low + step, int(width))


def _forest(near: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Links of a spanning forest of the nodes whose pairs are marked on one side: a node and those first reached from it."""
    near, n = near | near.T, len(near)
    fresh = np.ones(n, bool)
    for root in range(n):
        queue = [root] if fresh[root] else []
        fresh[root] = False
        while queue:
            u = queue.pop()
            v = np.flatnonzero(near[u] & fresh)
            if len(v):
                fresh[v] = False
                queue.extend(v.tolist())
                yield u, v


def crossing_links(mixed: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b``: links that join all components that links between them join.

    Rows with many others that they may link with meet set by set inside tasks, and only links leave a task. Small sets lie together, a large one is cut into
    blocks of rows of which each meets each other.
    """
    found = table(open_rows(mixed, percent))
    counts = found.filter("component IS NULL").groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    beyond = F.greatest(*[F.floor((percent * F.col(x) + 99) / 100) - 1 for x in ("n", "m")])  # row less its head
    enough = (100 + percent) * (F.col("c") + beyond) >= percent * (F.col("n") + F.col("m"))
    single = overlaps(table(counts.filter(enough).select("a", "b")), docs, classes, words, percent)
    rows = found.filter("component IS NOT NULL").select("part", F.col("b").alias("set"), F.col("a").alias("rep"), "n", "component")
    if rows.isEmpty():
        return single
    sets = whole_rows(table(classes.select("rep", "doc", "digest").join(rows.select("rep").distinct(), "rep")), docs, words)
    size = rows.groupBy("part", "set").agg(F.count("*").alias("rows"), F.sum(8 * F.col("n").cast("long")).alias("bytes"))
    blocks = F.when((F.col("rows") <= SET_ROWS) & (F.col("bytes") <= SET_BYTES), 1)
    size = size.withColumn("blocks", blocks.otherwise(F.ceil(F.greatest(2 * F.col("rows") / SET_ROWS, 2 * F.col("bytes") / SET_BYTES))).cast("int"))
    size = table(size)
    cells = -(-(size.agg(F.sum("bytes")).first()[0]) // SET_BYTES) + 1
    put = rows.join(size, ["part", "set"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("part", "set", F.least("own", "other"), F.greatest("own", "other"))
    put = put.withColumn("task", task).withColumn("cell", F.when(F.col("blocks") > 1, F.col("task")).otherwise(F.pmod("task", F.lit(cells))))

    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by([("task", "ascending"), ("rep", "ascending")])
        task, rep, component = (group[c].to_numpy() for c in ("task", "rep", "component"))
        shingles = group["shingles"].combine_chunks()
        edges = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True])
        a, b = [rep[:0]], [rep[:0]]
        for first, last in cuts(np.concatenate([[0], np.cumsum(np.diff(edges).astype(np.int64) ** 2)]), SET_ROWS * SET_ROWS):
            low, high = edges[first], edges[last]
            own = [np.frombuffer(x, np.uint64) for x in shingles[low:high].to_pylist()]
            sizes = np.array([len(x) for x in own])
            x, y = links_within(sizes, np.concatenate(own), np.repeat(np.arange(len(own)), sizes), edges[first : last + 1] - low, component[low:high], percent)
            a.append(rep[low:high][x])
            b.append(rep[low:high][y])
        release_memory()
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    met = put.select("cell", "task", "rep", "component").join(sets, "rep")
    within = met.groupBy("cell").applyInArrow(verify, "a long, b long")
    return single.unionByName(within.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def _groups(docs: DataFrame, words: int, percent: int) -> DataFrame:
    found = table(heads(docs, frequent_shingles(docs, words), words, percent))
    members = found.select("doc_id", "text_key", "n", "digest")
    classes = found.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("head").alias("head"))
    # Numbered in order of id: the first row of a column, its pivot, is mostly the one that others are copies of.
    classes = table(row_index(table(classes), ["doc", "digest"], 0, "rep"))
    column = Window.partitionBy("shingle")
    shared = table(columns_of(classes).withColumn("rows", F.count("*").over(column)).filter("rows > 1").drop("rows"))
    short = table(classes.select("rep", "doc", "n", "digest", _short("head").alias("short")))

    links, known = None, None
    for _ in range(ROUNDS):
        pairs = table(meet_in_heads(_best_pivots(_labelled(shared, known), percent), short, percent))
        new = overlaps(pairs, docs, short, words, percent)
        links = new if links is None else table(links.unionByName(new).distinct())
        known = table(components(links))

    # Columns that still hold several components: multiply across components.
    labelled = _labelled(shared, known)
    several = labelled.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("shingle")
    mixed = table(labelled.join(several, "shingle", "left_semi"))
    # A column that two components share is here, so whichever rows link across components meet in one.
    every = table(links.unionByName(crossing_links(mixed, docs, short, words, percent)).distinct())
    final = components(every)

    degree = every.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_verified"))
    named = classes.select("digest", "rep", "doc").join(final, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = table(named.join(degree, "rep", "left"))
    least = named.groupBy("component").agg(F.min("doc").alias("least"))
    out = members.join(named.join(least, "component"), "digest", "left")

    def name(column: str) -> Column:
        return F.nullif(F.coalesce(column, "doc_id"), F.lit(NO_ID).cast("long"))

    return out.select(
        id_out(), F.col("n").cast("long").alias("n_shingles"), name("doc").alias("class_id"), name("least").alias("component_id"),
        F.coalesce("n_verified", F.lit(0)).alias("n_verified"), "text_key", "component",
    )


def drop_similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, but one document per component: the one with the smallest id."""
    groups = _kept_groups(docs, words, percent).filter("component IS NOT NULL").select(id_in().alias("id"), "text_key", "component")
    first = groups.groupBy("component").agg(F.min(F.struct("id", "text_key")).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    gone = groups.join(first, "component").filter(F.struct("id", "text_key") != F.col("first")).select("id", "text_key").distinct()
    gone = table(gone)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), id_in().alias("id"), F.xxhash64(text).alias("text_key"))
    told = maybe_in(rows, bitmap_of(gone, "id"), "id")
    left = told.filter("_maybe").join(gone, ["id", "text_key"], "left_anti")
    return told.filter("not _maybe").select("row.*").unionByName(left.select("row.*"))
