"""Late interaction for a table of queries: the best documents of each, by the sum of best dot products.

The score of a document is the sum, over the query's vectors, of the largest dot product with one of the document's. Two
bounds of it follow from a summary: the document's vectors of one cell of trained centers are a piece, with their mean and their
largest distance from it. ``q.d`` lies within ``|q| * distance`` of ``q.mean``, so queries need only their products
with the means, which are taken as matrices of many queries and documents. The ``k`` documents of a query with the largest products with their means are multiplied in full; what cannot
reach the least of their scores, or the ``k`` best of its task, by its upper bound is left out, and only the rest is multiplied too, where it lies. Matrices are in single precision, and bounds
leave room for its rounding. The result is exact, whatever the centers.

A vector is exchanged once, to lie beside the others of its document. Queries go to the documents, a bounded number at a time, and each task
passes on only its best ``k`` documents of a query: no table holds pairs.

Documents and queries may have any number of vectors: documents of more than a block are cut into parts whose maxima are combined, a query's vectors are one
row (8 bytes a number), compared a slice at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curate.functions.vectors import doubles
from curate.operators.cells import matrix
from curate.operators.search import BROADCAST_BYTES, MATRIX_CELLS
from curate.session import join_null_safe, materialize

#: Vectors of a document multiplied together.
BLOCK_VECTORS = 4096
#: Pieces of documents that are compared with queries at a time, and products of two vectors taken one by one.
BLOCK_ROWS, PRODUCTS = 512, 1 << 12
#: Cells of a matrix of vectors and centers; the most vectors of a document or a query that are reduced as matrices of one of each.
DISTANCES, FEW = 1 << 21, 32


def _bodies(vectors: DataFrame, kind: str) -> DataFrame:
    """``document, part, bodies`` from ``document, part, v``: the vectors of a part as bytes, those of a batch together."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names, part = batch["document"].dictionary_encode(null_encoding="encode"), batch["part"].to_numpy()
            codes = names.indices.to_numpy()
            order = np.lexsort((part, codes))
            x, codes, part = matrix(batch["v"])[order], codes[order], part[order]
            starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (part[1:] != part[:-1])])
            body = pa.array([x[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(x)])], pa.binary())
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(codes[starts])), pa.array(part[starts]), body], ["document", "part", "body"])

    pieces = vectors.select("document", "part", "v").mapInArrow(cut, f"document {kind}, part long, body binary")
    return pieces.groupBy("document", "part").agg(F.collect_list("body").alias("bodies"))


def whole_documents(vectors: DataFrame, document: str, vector: str, centers: np.ndarray) -> tuple[DataFrame, DataFrame | None]:
    """``document, body, means, away`` of the documents of up to a block of vectors: these, and for each of their pieces the mean and the
    largest distance from it; and ``document, bodies`` of the parts of larger ones, if there are any.

    Equal vectors of a large document count once; its parts follow a hash of the vector.
    """
    kind, dim = vectors.schema[document].dataType.simpleString(), centers.shape[1]
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(document).alias("document"), doubles(vector).alias("v"))
    parts = F.ceil(F.col("n") / BLOCK_VECTORS).alias("parts")
    large = materialize(rows.groupBy("document").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK_VECTORS).select("document", parts))
    wide = None
    if not large.isEmpty():
        cut = join_null_safe(rows, large, ["document"]).distinct().withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))
        wide = materialize(_bodies(cut, kind).select("document", "bodies"))
        rows = join_null_safe(rows, large, ["document"], "left_anti")

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bodies = batch["bodies"]
            x = _numbers(bodies.flatten(), dim)
            each = pc.list_value_length(bodies).to_numpy(zero_copy_only=False)
            length = pc.binary_length(bodies.flatten()).to_numpy(zero_copy_only=False) // (8 * dim)
            size = np.add.reduceat(length, np.cumsum(each) - each)
            of = np.repeat(np.arange(len(size)), size)
            cell = _about_nearest(x, centers)
            order = np.lexsort((cell, of))
            x, of, cell = x[order], of[order], cell[order]
            starts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (cell[1:] != cell[:-1])])
            width = np.diff(np.r_[starts, len(x)])
            means = np.add.reduceat(x, starts, axis=0) / width[:, None]
            away = np.maximum.reduceat(np.sqrt(((x - np.repeat(means, width, axis=0)) ** 2).sum(axis=1)), starts)
            pieces = np.searchsorted(of[starts], np.arange(len(size) + 1))
            vector = np.concatenate([[0], np.cumsum(size)])
            columns = [pa.array([y[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()) for y, edges in ((x, vector), (means, pieces), (away, pieces))]
            yield pa.RecordBatch.from_arrays([batch["document"], *columns], ["document", "body", "means", "away"])

    grouped = _bodies(rows.withColumn("part", F.lit(0).cast("long")), kind).select("document", "bodies")
    return materialize(grouped.mapInArrow(summarize, f"document {kind}, body binary, means binary, away binary")), wide


def whole_queries(queries: DataFrame, query: str, vector: str) -> DataFrame:
    """``query, vectors``: all vectors of a query one after the other."""
    rows = queries.filter(F.col(vector).isNotNull()).select(F.col(query).alias("query"), doubles(vector).alias("v"))
    return rows.groupBy("query").agg(F.flatten(F.collect_list("v")).alias("vectors"))


def _numbers(column: pa.Array, dim: int) -> np.ndarray:
    """The doubles of a column of bytes as rows of ``dim``."""
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, dim)


def _ends(column: pa.Array, dim: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False) // (8 * dim))]).astype(np.int64)


def _slices(edges: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of queries (or documents) of at most ``most`` vectors, or of one."""
    first = 0
    while first < len(edges) - 1:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + most, "right")) - 1)
        yield first, last
        first = last


def _narrow(x: np.ndarray) -> np.ndarray:
    """In single precision, if products fit it; false for NaN."""
    return x.astype(np.float32) if x.size == 0 or np.abs(x).max() < 1e15 else x


def _about_nearest(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest center of each vector, but for rounding in single precision: any cell is right here."""
    c = _narrow(centers)
    half, step = (c * c).sum(axis=1) / 2, max(1, DISTANCES // len(c))
    found = [np.argmax(vectors[i : i + step].astype(c.dtype) @ c.T - half, axis=1) for i in range(0, len(vectors), step)]
    return np.concatenate(found) if found else np.empty(0, np.int64)


class _Groups:
    """Vectors of groups (queries or documents), those of group i in rows ``edges[i]`` to ``edges[i + 1]``, to be multiplied.

    In groups of few vectors, the largest first (``order``), set t has vector t of each group that has so many, so that matrices of sets are
    added up whole. Otherwise they stay as they are.
    """

    def __init__(self, vectors: np.ndarray, edges: np.ndarray, more: np.ndarray):
        size, vectors = np.diff(edges), _narrow(vectors)
        self.count, self.starts = len(size), None
        if size.max(initial=0) > FEW:
            self.order, self.starts, self.sets = np.arange(len(size)), edges[:-1] - edges[0], [(vectors[edges[0] : edges[-1]], more[edges[0] : edges[-1]])]
            return
        self.order = np.argsort(-size, kind="stable")
        rows = [edges[self.order[size[self.order] > t]] + t for t in range(size.max(initial=0))]
        self.sets = [(vectors[r], more[r]) for r in rows]


def _largest(vectors: np.ndarray, norms: np.ndarray, documents: _Groups, sign: int) -> np.ndarray:
    """The largest product of each vector with the pieces of each document, and ``sign`` times how far vectors of a piece can add to it."""
    best = None
    for means, away in documents.sets:
        product = vectors @ means.T
        if sign:
            product += np.outer(norms * sign, away)
        if best is None:
            best = product if documents.starts is None else np.maximum.reduceat(product, documents.starts, axis=1)
        else:
            np.maximum(best[:, : len(means)], product, out=best[:, : len(means)])
    return best


def _bounds(queries: _Groups, documents: _Groups, sign: int) -> np.ndarray:
    """Lower (``sign`` -1) or upper (1) bounds of scores, or those of the means (0), in the order of queries and documents."""
    total = np.zeros((queries.count, documents.count), queries.sets[0][0].dtype)
    width = sum(len(means) for means, _ in documents.sets)
    for vectors, norms in queries.sets:
        if queries.starts is None:
            total[: len(vectors)] += _largest(vectors, norms, documents, sign)
            continue
        # Queries of very many vectors are added up a slice at a time.
        of = np.repeat(np.arange(queries.count), np.diff(np.r_[queries.starts, len(vectors)]))
        step = max(1, 8 * MATRIX_CELLS // width)
        for i in range(0, len(vectors), step):
            best, own = _largest(vectors[i : i + step], norms[i : i + step], documents, sign), of[i : i + step]
            begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total[own[begins]] += np.add.reduceat(best, begins, axis=0)
    return total


class _Asked:
    """Queries as a task holds them; ``least`` is what a score has to reach, ``chosen`` are documents to multiply."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, edges: np.ndarray, least: np.ndarray, chosen: pa.Array, block_rows: int):
        self.ids, self.vectors, self.edges, self.least, self.chosen, self.block_rows = ids, vectors, edges, least, chosen, block_rows
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.length = np.add.reduceat(norms, edges[:-1])
        self.blocks = []
        for a, b in _slices(edges, max(1, MATRIX_CELLS // block_rows)):
            own = _Groups(vectors, edges[a : b + 1], norms.astype(_narrow(norms).dtype))
            self.blocks.append((a + own.order, own))

    def room(self, q: np.ndarray, reach: float) -> np.ndarray:
        """How far rounding can move a bound or a rough score of queries, with vectors no longer than ``reach``."""
        return 8 * (self.vectors.shape[1] + 4) * np.finfo(np.float32).eps * self.length[q] * reach + 1e-36

    def compared(self, batch: pa.RecordBatch, sign: int) -> Iterator[tuple]:
        """``q, d, bounds, queries, reach``: bounds for queries ``q`` and documents ``d`` of a batch, and the length that no vector of these exceeds."""
        dim, ends = self.vectors.shape[1], _ends(batch["away"], 1)
        for low, high in _slices(ends, self.block_rows):
            part = batch.slice(low, high - low)
            means, away = _numbers(part["means"], dim), _numbers(part["away"], 1)[:, 0]
            reach = (np.sqrt((means * means).sum(axis=1)) + away).max()
            documents = _Groups(means, ends[low : high + 1] - ends[low], away.astype(_narrow(away).dtype))
            for q, queries in self.blocks:
                yield q, low + documents.order, _bounds(queries, documents, sign), queries, reach

    def scores(self, q: np.ndarray, d: np.ndarray, vectors: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query and a document of which ``vectors`` has rows ``edges[d]`` to ``edges[d + 1]``, product by product."""
        out = np.empty(len(q))
        asked, held = np.diff(self.edges)[q], np.diff(edges)[d]
        for first, last in _slices(np.concatenate([[0], np.cumsum(asked * held)]), PRODUCTS):
            if asked[first] * held[first] > PRODUCTS:  # one pair
                mine, others = self.vectors[self.edges[q[first]] : self.edges[q[first] + 1]], vectors[edges[d[first]] : edges[d[first] + 1]]
                step = max(1, PRODUCTS // len(others))
                best = [(mine[i : i + step, None] * others).sum(axis=2).max(axis=1) for i in range(0, len(mine), step)]
                out[first] = np.concatenate(best).sum()
                continue
            n, pair = asked[first:last], np.repeat(np.arange(first, last), asked[first:last])
            row = np.repeat(self.edges[q[first:last]] - (np.cumsum(n) - n), n) + np.arange(len(pair))
            width = held[pair]
            begins = np.cumsum(width) - width
            other = np.repeat(edges[d[pair]] - begins, width) + np.arange(width.sum())
            best = np.maximum.reduceat((self.vectors[np.repeat(row, width)] * vectors[other]).sum(axis=1), begins)
            out[first:last] = np.add.reduceat(best, np.cumsum(n) - n)
        return out


class _Top:
    """The ``k`` documents of the largest numbers met so far for each query; of equal ones those of the smallest ids."""

    def __init__(self, n: int, k: int):
        self.value, self.place = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        self.ids: pa.Array | None = None

    def enter(self, ids: pa.Array) -> int:
        """Take documents in, and forget those that no query holds; the place of the first."""
        held = np.unique(self.place[self.place >= 0])
        if len(held):
            self.place = np.where(self.place >= 0, np.searchsorted(held, self.place), -1)
            ids = pa.concat_arrays([self.ids.take(pa.array(held)), ids])
        self.ids = ids
        self.rank = np.empty(len(ids), np.int64)
        self.rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        return len(held)

    def add(self, q: np.ndarray, value: np.ndarray, place: np.ndarray) -> None:
        if not len(q):
            return
        k = self.value.shape[1]
        rows, at = np.unique(q, return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(rows)), k), at])
        value, place = np.concatenate([self.value[rows].ravel(), value]), np.concatenate([self.place[rows].ravel(), place])
        order = np.lexsort((self.rank[place], np.where(np.isnan(value), -np.inf, -value), place < 0, of))
        of = of[order]
        kept = order[np.arange(len(of)) - np.searchsorted(of, of) < k]
        self.value[rows], self.place[rows] = value[kept].reshape(-1, k), place[kept].reshape(-1, k)

    def found(self, queries: pa.Array, name: str) -> Iterator[pa.RecordBatch]:
        q, at = np.nonzero(self.place >= 0)
        if len(q):
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), self.ids.take(pa.array(self.place[q, at])), pa.array(self.value[q, at])], ["query", "document", name])


def _among_best(hit: np.ndarray, value: np.ndarray, k: int, room: np.ndarray) -> np.ndarray:
    """Of very many hits only what is among the ``k`` best of its query in these documents."""
    if value.shape[1] > k and np.count_nonzero(hit) > 8 * k * len(value):
        least = np.partition(value, value.shape[1] - k, axis=1)[:, value.shape[1] - k]
        hit &= ~(value < (least - room)[:, None])
    return hit


def _promising(asked: _Asked, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """``query, document, bound``: the documents of the ``k`` largest products with their means of each query."""
    top = _Top(len(asked.ids), k)
    for batch in batches:
        start = top.enter(batch["document"])
        for q, d, bound, _, _ in asked.compared(batch, 0):
            i, j = np.nonzero(_among_best(bound > top.value[q, -1:], bound, k, np.zeros(len(q))))
            top.add(q[i], bound[i, j].astype(np.float64), start + d[j])
    yield from top.found(asked.ids, "bound")


def _chosen(asked: _Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``query, score`` of the chosen documents."""
    dim, chosen = asked.vectors.shape[1], asked.chosen.flatten()
    of = np.repeat(np.arange(len(asked.ids)), pc.list_value_length(asked.chosen).to_numpy(zero_copy_only=False))
    for batch in batches:
        at = pc.index_in(chosen, value_set=batch["document"])
        here = at.is_valid().to_numpy(zero_copy_only=False)
        q, d = of[here], at.drop_null().to_numpy().astype(np.int64)
        order = np.argsort(d, kind="stable")
        q, d, ends = q[order], d[order], _ends(batch["body"], dim)
        for low, high in _slices(ends, BLOCK_VECTORS):
            i, j = np.searchsorted(d, [low, high])
            if j > i:
                score = asked.scores(q[i:j], d[i:j] - low, _numbers(batch["body"].slice(low, high - low), dim), ends[low : high + 1] - ends[low])
                yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(q[i:j])), pa.array(score)], ["query", "score"])


def _survivors(asked: _Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``query, document`` of the pairs whose upper bound reaches what is wanted."""
    for batch in batches:
        for q, d, upper, _, reach in asked.compared(batch, 1):
            i, j = np.nonzero(~(upper < (asked.least[q] - asked.room(q, reach))[:, None]))
            yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(q[i])), batch["document"].take(pa.array(d[j]))], ["query", "document"])


def _best(asked: _Asked, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """``query, document, score``: the best ``k`` documents of each query among those whose upper bound reaches what is wanted."""
    dim, top = asked.vectors.shape[1], _Top(len(asked.ids), k)
    for batch in batches:
        start, ends, low = top.enter(batch["document"]), _ends(batch["body"], dim), None
        for q, d, upper, queries, reach in asked.compared(batch, 1):
            room = asked.room(q, reach)
            edge = np.maximum(asked.least[q], top.value[q, -1]) - room
            hit = ~(upper < edge.astype(upper.dtype)[:, None])
            if not hit.any():
                continue
            if low != d.min():
                low = d.min()
                high = low + len(d)
                vectors, edges = _numbers(batch["body"].slice(low, high - low), dim), ends[low : high + 1] - ends[low]
            if np.count_nonzero(hit) > hit.size >> 5:  # so many are multiplied as matrices first
                rough, place = np.empty(hit.shape, upper.dtype), np.empty(len(d), np.int64)
                place[d - low] = np.arange(len(d))
                for i, j in _slices(edges, max(1, 8 * MATRIX_CELLS // int((asked.edges[q + 1] - asked.edges[q]).sum()))):
                    some = _Groups(vectors, edges[i : j + 1], np.zeros(len(vectors), np.float32))
                    rough[:, place[i + some.order]] = _bounds(queries, some, 0)
                hit &= ~(rough < edge.astype(rough.dtype)[:, None])
                hit = _among_best(hit, rough, k, 2 * room)
            i, j = np.nonzero(hit)
            top.add(q[i], asked.scores(q[i], d[j] - low, vectors, edges), start + d[j])
    yield from top.found(asked.ids, "score")


def _maxima(asked: _Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``query, document, best``: the largest product of each vector of a query with those of a part of a document."""
    dim = asked.vectors.shape[1]
    for batch in batches:
        for i in range(batch.num_rows):
            part = _numbers(batch["bodies"].slice(i, 1).flatten(), dim)
            step = max(1, 8 * MATRIX_CELLS // len(part))
            for a, b in _slices(asked.edges, step):
                first, last = int(asked.edges[a]), int(asked.edges[b])
                best = np.concatenate([(asked.vectors[j : min(j + step, last)] @ part.T).max(axis=1) for j in range(first, last, step)])
                lists = pa.ListArray.from_arrays(pa.array((asked.edges[a : b + 1] - first).astype(np.int32)), pa.array(best))
                yield pa.RecordBatch.from_arrays([asked.ids.slice(a, b - a), batch["document"].take(pa.array([i] * (b - a))), lists], ["query", "document", "best"])


def _meet(asked: DataFrame, documents: DataFrame, dim: int, pick: Callable, schema: str, broadcast_bytes: int, block_rows: int) -> DataFrame:
    """Rows that ``pick(queries, batches)`` makes of each task's documents.

    ``asked`` has ``query, vectors, least, chosen``. Queries of bounded size go to all tasks at a time; documents stay where they are.
    """
    size = asked.agg(F.coalesce(F.sum(F.size("vectors") + F.size("chosen") + 2), F.lit(0)).alias("cells")).first()["cells"]
    blocks = max(1, -(-size * 8 // max(broadcast_bytes, 1 << 20)))

    def met(own: DataFrame) -> DataFrame:
        table = own.toArrow()
        body = table["vectors"].combine_chunks()
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(body).to_numpy(zero_copy_only=False))]).astype(np.int64) // dim
        vectors = body.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        held = table["query"].combine_chunks(), vectors, edges, table["least"].to_numpy(), table["chosen"].combine_chunks()
        sent = asked.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if len(sent.value[0]):
                yield from pick(_Asked(*sent.value, block_rows), (batch for batch in batches if batch.num_rows))

        return documents.mapInArrow(run, schema)

    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    return functools.reduce(DataFrame.unionByName, [met(asked if blocks == 1 else asked.filter(block == i)) for i in range(blocks)])


def _wanted(queries: DataFrame, documents: DataFrame, k: int, query: str, vector: str, dim: int, broadcast_bytes: int, block_rows: int) -> DataFrame:
    """``query, vectors, least, chosen``: what a score has to reach, by the scores of the ``k`` documents with the largest products with their means."""
    kind = documents.schema["document"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>").alias("chosen")
    asked = materialize(whole_queries(queries, query, vector))
    of = asked.schema["query"].dataType.simpleString()
    plain = asked.select("*", F.lit(0.0).alias("least"), none)
    bounds = _meet(plain, documents.select("document", "means", "away"), dim, lambda a, b: _promising(a, b, k), f"query {of}, document {kind}, bound double", broadcast_bytes, block_rows)
    ranked = bounds.withColumn("_rn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "document"))).filter(F.col("_rn") <= k)
    chosen = ranked.groupBy("query").agg(F.collect_list(F.struct("document")).alias("chosen")).withColumn("chosen", F.col("chosen.document"))
    trial = materialize(join_null_safe(plain.drop("chosen"), chosen, ["query"]))
    reached = _meet(trial, documents.select("document", "body"), dim, _chosen, f"query {of}, score double", broadcast_bytes, block_rows)
    # With fewer than k documents every one is among the best.
    least = reached.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    known = join_null_safe(plain.drop("least"), least, ["query"], "left")
    return materialize(known.select("query", "vectors", F.coalesce("least", F.lit(float("-inf"))).alias("least"), "chosen"))


def candidate_documents(
    queries: DataFrame, vectors: DataFrame, k: int, query: str, document: str, vector: str, centers: np.ndarray,
    broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query, document``: a superset of the ``k`` best documents of each query, from the bounds and the scores of ``k`` documents.

    All pairs with documents of more than a block of vectors are among them.
    """
    documents, wide = whole_documents(vectors, document, vector, centers)
    wanted = _wanted(queries, documents, k, query, vector, centers.shape[1], broadcast_bytes, block_rows)
    schema = f"query {wanted.schema['query'].dataType.simpleString()}, document {documents.schema['document'].dataType.simpleString()}"
    found = _meet(wanted, documents, centers.shape[1], _survivors, schema, broadcast_bytes, block_rows)
    return found if wide is None else found.unionByName(wanted.select("query").crossJoin(wide.select("document").distinct()))


def maxsim_join(
    queries: DataFrame, vectors: DataFrame, k: int, query: str, document: str, vector: str, centers: np.ndarray,
    broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` documents of the largest late-interaction score for every query: query, document, score, rank."""
    dim = centers.shape[1]
    documents, wide = whole_documents(vectors, document, vector, centers)
    wanted = _wanted(queries, documents, k, query, vector, dim, broadcast_bytes, block_rows)
    names = f"query {wanted.schema['query'].dataType.simpleString()}, document {documents.schema['document'].dataType.simpleString()}"
    scores = _meet(wanted, documents, dim, lambda a, b: _best(a, b, k), f"{names}, score double", broadcast_bytes, block_rows)
    if wide is not None:
        partial = _meet(wanted, wide, dim, _maxima, f"{names}, best array<double>", broadcast_bytes, block_rows)
        each = partial.select("query", "document", F.posexplode("best")).groupBy("query", "document", "pos").agg(F.max("col").alias("best"))
        scores = scores.unionByName(each.groupBy("query", "document").agg(F.sum("best").alias("score")))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "document")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
