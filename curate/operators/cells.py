"""Nearest neighbours by trained cells: inverted lists, compressed residuals, exact re-ranking.

Vectors are assigned to the nearest of some trained centers. An inverted list holds, for a run of rows of one cell, their
ids and a few bytes each that stand for the residual (the vector minus its center). A query looks into the lists of its
nearest cells only, ranks what it meets by the compressed residuals, and the best are measured on the vectors themselves.

Centers and codes are learned from a sample of bounded size (``sample`` rows); every row is indexed. Their size is known
(cells times dimensions), so they go to all tasks. Lists are laid out by range of cell and id: a cell
with a third of all rows is spread over files and tasks, and so are the queries that look into it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.functions.vectors import doubles, dot
from curate.operators.search import BROADCAST_BYTES, METRICS, PAIRS, _pair_distances, knn_join
from curate.session import materialize, spread

#: Rows that centers and codes are learned from, and the largest number of cells that is chosen by itself.
SAMPLE_ROWS, MAX_CELLS = 200_000, 1 << 16
#: Codes per part of a residual (one byte).
CODES = 256
#: Rows of a list, queries compared with it together, and lists of a cell that one task compares with them.
LIST_ROWS, QUERY_ROWS, LISTS_PER_TASK = 2048, 256, 32
#: Distances from centers taken at a time.
DISTANCES = 1 << 22
#: Cells whose sums are added up together.
CELLS_PER_SUM = 1024
#: Measured pairs that are gathered before only the best of each query are kept.
GATHERED = 1 << 18


@dataclass(frozen=True)
class Cells:
    """Centers of the cells, and the code books of the residuals' parts (parts x codes x numbers of a part)."""

    centers: np.ndarray
    books: np.ndarray
    metric: str

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        return nearest(vectors, self.centers)

    def parts(self, residuals: np.ndarray) -> np.ndarray:
        """Residuals cut into their parts: rows x parts x numbers, filled up with zeros."""
        parts, _, width = self.books.shape
        filled = np.zeros((len(residuals), parts * width))
        filled[:, : residuals.shape[1]] = residuals
        return filled.reshape(len(residuals), parts, width)

    def encode(self, vectors: np.ndarray, cell: np.ndarray) -> np.ndarray:
        cut = self.parts(vectors - self.centers[cell])
        return np.stack([nearest(cut[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def rough(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the coded rows of a cell, summed over parts from one table per query."""
        cut = self.parts(queries - self.centers[cell])
        total = np.zeros((len(queries), len(codes)))
        for p, book in enumerate(self.books):
            table = ((cut[:, p, None, :] - book[None, :, :]) ** 2).sum(axis=2)
            total += table[:, codes[:, p]]
        return total


def nearest(vectors: np.ndarray, centers: np.ndarray, block: int = 4096) -> np.ndarray:
    """Index of the nearest center of each vector."""
    norm = (centers * centers).sum(axis=1)
    block = max(1, min(block, DISTANCES // max(len(centers), 1)))
    found = [np.argmin(norm - 2.0 * (vectors[i : i + block] @ centers.T), axis=1) for i in range(0, len(vectors), block)]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long number lists as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def prepared(rows: DataFrame, key: str, vector: str, metric: str) -> DataFrame:
    """``id, v`` of the rows with a vector; of unit length for ``cosine``, where vectors without a direction are left out."""
    plain = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), doubles(vector).alias("v"))
    if metric == "l2":
        return plain
    if metric != "cosine":
        raise ValueError(f"metric must be 'l2' or 'cosine', not {metric!r}")
    length = F.sqrt(dot("v", "v"))
    return plain.withColumn("_n", length).filter("_n > 0").select("id", F.transform("v", lambda x: x / F.col("_n")).alias("v"))


def sample_of(vectors: DataFrame, n: int, sample: int, seed: int) -> DataFrame:
    """About ``sample`` of ``n`` rows, by a hash of the id."""
    share = min(1.0, sample / max(n, 1))
    return vectors.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))


def _sums(x: np.ndarray, of: np.ndarray, into: np.ndarray) -> None:
    """Add the rows of ``x``, and their number in the last column, to the rows of ``into`` that ``of`` names."""
    order = np.argsort(of, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0])
    into[of[order][starts], :-1] += np.add.reduceat(x[order], starts, axis=0)
    into[of[order][starts], -1] += np.diff(np.r_[starts, len(of)])


def train_centers(vectors: DataFrame, cells: int, seed: int = 42, rounds: int = 10) -> np.ndarray:
    """Centers of at most ``cells`` cells of the column ``v``, by k-means from distinct rows that a hash picks.

    Tasks assign their rows as matrices and pass on one sum per cell; only the centers reach the driver.
    """
    if cells <= 1:
        return np.array([vectors.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").toPandas()["m"]])
    pool = spread(materialize(vectors.select("v")))
    picked = pool.distinct().orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(cells).toArrow()["v"]
    centers = matrix(picked.combine_chunks())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centers), centers.shape[1] + 1))
        for batch in batches:
            x = matrix(batch["v"])
            if len(x):
                _sums(x, nearest(x, centers), total)
        for a in range(0, len(total), CELLS_PER_SUM):
            yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([total[a : a + CELLS_PER_SUM].tobytes()])], ["first", "sums"])

    def total(group: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"first": [group[0].as_py()], "sums": [sum(np.frombuffer(s) for s in table["sums"].to_pylist()).tobytes()]})

    for _ in range(rounds):
        summed = pool.mapInArrow(add, "first long, sums binary").groupBy("first").applyInArrow(total, "first long, sums binary").collect()
        sums = np.frombuffer(b"".join(r["sums"] for r in sorted(summed, key=lambda r: r["first"]))).reshape(len(centers), -1)
        # A cell without rows keeps its center.
        moved = np.where(sums[:, -1:] > 0, sums[:, :-1] / np.maximum(sums[:, -1:], 1), centers)
        if np.array_equal(moved, centers):
            break
        centers = moved
    return centers


def _book(points: np.ndarray, codes: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centers of one part of the sampled residuals, by a few rounds of k-means."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centers = distinct[rng.choice(len(distinct), min(codes, len(distinct)), replace=False)]
    for _ in range(rounds):
        of = nearest(points, centers)
        count = np.bincount(of, minlength=len(centers))
        sums = np.stack([np.bincount(of, points[:, j], len(centers)) for j in range(points.shape[1])], axis=1)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def train_cells(
    rows: DataFrame, key: str, vector: str, cells: int | None = None, parts: int = 16, metric: str = "l2", sample: int = SAMPLE_ROWS, seed: int = 42
) -> Cells:
    """Learn cells (by default twice the square root of the number of rows) and the codes of residuals from about ``sample`` rows."""
    vectors = prepared(rows, key, vector, metric)
    n = vectors.count()
    if not n:
        raise ValueError("cells need at least one vector")
    pool = materialize(sample_of(vectors, n, sample, seed))
    centers = train_centers(pool, cells or max(1, min(MAX_CELLS, int(2 * math.sqrt(n)))), seed)
    parts = min(parts, centers.shape[1])
    width = -(-centers.shape[1] // parts)
    shape = Cells(centers, np.zeros((parts, 1, width)), metric)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["v"])
            if len(x):
                cut = shape.parts(x - centers[shape.nearest(x)])
                for p in range(parts):
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([cut[:, p].tobytes()])], ["part", "points"])

    def learn(group: tuple, table: pa.Table) -> pa.Table:
        points = np.frombuffer(b"".join(table["points"].to_pylist())).reshape(-1, width)
        return pa.table({"part": pa.array([group[0].as_py()], pa.int32()), "book": [_book(points, CODES, seed).tobytes()]})

    found = pool.mapInArrow(residuals, "part int, points binary").groupBy("part").applyInArrow(learn, "part int, book binary").collect()
    books = [np.frombuffer(r["book"]).reshape(-1, width) for r in sorted(found, key=lambda r: r["part"])]
    most = max(len(b) for b in books)
    return Cells(centers, np.stack([np.vstack([b, np.repeat(b[:1], most - len(b), axis=0)]) for b in books]), metric)


def _runs(values: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of equal values, no longer than ``most``."""
    if not len(values):
        return []
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return [(i, min(i + most, b)) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(values)]) for i in range(a, b, most)]


def index_cells(rows: DataFrame, key: str, vector: str, model: Cells, path: str | None = None) -> DataFrame:
    """Inverted lists ``cell, list, ids, codes`` of all rows, written in the order of cells."""
    kind = rows.schema[key].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["v"])
            if len(x):
                cell = model.nearest(x)
                codes = model.encode(x, cell)
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch["id"], flat.cast(pa.binary())], ["cell", "id", "code"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, codes = batch["cell"].to_numpy(), batch["code"].to_pylist()
            for a, b in _runs(cell, LIST_ROWS):
                ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch["id"].slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 1]), ids, pa.array([b"".join(codes[a:b])])], ["cell", "ids", "codes"])

    # Written down before the range shuffle, whose sample would otherwise assign all rows once more.
    coded = materialize(prepared(rows, key, vector, model.metric).mapInArrow(assign, f"cell int, id {kind}, code binary"))
    laid = coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").mapInArrow(lists, f"cell int, ids array<{kind}>, codes binary")
    return materialize(laid.withColumn("list", F.monotonically_increasing_id()), path)


def list_sizes(lists: DataFrame) -> DataFrame:
    """``cell, n, parts``: rows of each cell, and tasks that its lists are dealt to."""
    sizes = lists.groupBy("cell").agg(F.sum(F.size("ids")).alias("n"), F.ceil(F.count("*") / LISTS_PER_TASK).cast("int").alias("parts"))
    return materialize(sizes)


def probe_cells(queries: DataFrame, key: str, vector: str, model: Cells, sizes: DataFrame, probes: int, least: int) -> DataFrame:
    """``cell, id, v``: the ``probes`` nearest cells of each query, and more until they hold ``least`` rows."""
    kind = queries.schema[key].dataType.simpleString()
    held = np.zeros(len(model.centers), np.int64)
    for row in sizes.select("cell", "n").toLocalIterator():  # one row per cell at most
        held[row["cell"]] = row["n"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = (model.centers**2).sum(axis=1)
        for batch in batches:
            x = matrix(batch["v"])
            for a in range(0, len(x), QUERY_ROWS):
                part = x[a : a + QUERY_ROWS]
                order = np.argsort(norm - 2.0 * (part @ model.centers.T), axis=1, kind="stable")
                full = held[order]
                before = np.cumsum(full, axis=1) - full
                some = full > 0
                wanted = some & ((np.cumsum(some, axis=1) <= probes) | (before < least))
                q, at = np.nonzero(wanted)
                rows = pa.array(a + q)
                yield pa.RecordBatch.from_arrays([pa.array(order[q, at].astype(np.int32)), batch["id"].take(rows), batch["v"].take(rows)], ["cell", "id", "v"])

    return prepared(queries, key, vector, model.metric).mapInArrow(look, f"cell int, id {kind}, v array<double>")


def knn_join_cells(
    queries: DataFrame, rows: DataFrame, lists: DataFrame, model: Cells, k: int, key: str, vector: str,
    probes: int = 8, rerank: int = 10, exclude_self: bool = False, sizes: DataFrame | None = None,
) -> DataFrame:
    """About the ``k`` nearest rows for every query row: query_id, row_id, distance, rank.

    ``lists`` is ``index_cells`` of ``rows``. ``rerank`` times ``k`` rows per query are measured exactly. A query looks into at
    least as many cells as hold ``k`` rows, so it gets ``k`` of them if the table has as many.
    """
    kind = rows.schema[key].dataType.simpleString()
    sizes = list_sizes(lists) if sizes is None else sizes
    probed = probe_cells(queries, key, vector, model, sizes, probes, k + 1 if exclude_self else k)
    kept = rerank * k

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, x = batch["cell"].to_numpy(), matrix(batch["v"])
            for a, b in _runs(cell, QUERY_ROWS):
                ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch["id"].slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 1]), ids, pa.array([x[a:b].tobytes()])], ["cell", "query_ids", "vectors"])

    asked = materialize(probed).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").mapInArrow(blocks, f"cell int, query_ids array<{kind}>, vectors binary")
    asked = asked.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = lists.join(sizes, "cell").withColumn("part", F.pmod("list", "parts").cast("int"))
    met = asked.select("cell", "part", "query_ids", "vectors").join(dealt.select("cell", "part", "ids", "codes"), ["cell", "part"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, ids = batch["query_ids"][i].values, batch["ids"][i].values
                q = np.frombuffer(batch["vectors"][i].as_py()).reshape(len(q_ids), -1)
                codes = np.frombuffer(batch["codes"][i].as_py(), np.uint8).reshape(len(ids), -1)
                rough = model.rough(q, batch["cell"][i].as_py(), codes)
                n = min(kept + exclude_self, len(ids))
                best = np.argpartition(rough, n - 1, axis=1)[:, :n]
                at = np.repeat(np.arange(len(q_ids)), n)
                columns = [q_ids.take(pa.array(at)), ids.take(pa.array(best.ravel())), pa.array(rough[at, best.ravel()])]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "row_id", "rough"])

    rough = met.mapInArrow(rank, f"query_id {kind}, row_id {kind}, rough double")
    if exclude_self:
        rough = rough.filter("query_id <> row_id")
    near = Window.partitionBy("query_id").orderBy("rough", "row_id")
    chosen = rough.withColumn("_rn", F.row_number().over(near)).filter(F.col("_rn") <= kept).select("query_id", "row_id")
    left = queries.select(F.col(key).alias("query_id"), doubles(vector).alias("_q"))
    right = rows.select(F.col(key).alias("row_id"), doubles(vector).alias("_r"))
    measured = chosen.join(right, "row_id").join(left, "query_id").select("query_id", "row_id", METRICS[model.metric]("_q", "_r").alias("distance"))
    best = Window.partitionBy("query_id").orderBy("distance", "row_id")
    return measured.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def probed_pairs(queries: DataFrame, key: str, vector: str, model: Cells, sizes: DataFrame, k: int, probes: int = 8) -> Column:
    """Scalar: how many pairs of a query and a coded row ``knn_join_cells`` compares."""
    looked = probe_cells(queries, key, vector, model, sizes, probes, k).select("cell").join(sizes, "cell")
    return looked.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()


class Unruled:
    """The best ``k`` rows of the cells met so far for each query, which compares itself only with cells that may hold one of them.

    A row is no farther from its own center than from the center nearest to a query. A query that is farther from the first than
    from the second by more than ``limit`` allows has no row of that cell within ``limit``. Limits are distances that ``k`` rows
    are known to lie within (infinite if unknown) and shrink to the ``k``-th best. Matrices are in single precision;
    whatever lies within their rounding of the limit is measured directly.
    """

    def __init__(self, centers: np.ndarray, ids: np.ndarray, queries: np.ndarray, cell: np.ndarray, limit: np.ndarray, k: int, exclude_self: bool):
        self.centers, self.ids, self.queries, self.cell, self.k, self.exclude_self = centers, ids, queries, cell, k, exclude_self
        self.limit = limit * (1 + 1e-9)  # sums in another order
        self.norm = (centers * centers).sum(axis=1)
        self.own = self.norm[cell] - 2.0 * (queries * centers[cell]).sum(axis=1)
        self.length = np.sqrt((queries * queries).sum(axis=1))
        self.longest = self.length.max(initial=0.0) + np.sqrt(self.norm.max())
        self.found = [np.empty(0, np.int64)], [ids[:0]], [np.empty(0)]
        self.gathered = self.compared = 0

    def meet(self, cell: np.ndarray, ids: np.ndarray, block: np.ndarray) -> None:
        """Rows in the order of their cells."""
        runs = _runs(cell, LIST_ROWS)
        step = max(1, DISTANCES // max(len(self.ids), 1))
        for a in range(0, len(runs), step):
            part = runs[a : a + step]
            heads = cell[[b for b, _ in part]]
            farther = self.norm[heads] - 2.0 * (self.queries @ self.centers[heads].T) - self.own[:, None]
            for i, (b, e) in enumerate(part):
                self._meet(farther[:, i], heads[i], ids[b:e], block[b:e])

    def _meet(self, farther: np.ndarray, head: int, ids: np.ndarray, block: np.ndarray) -> None:
        square = (block * block).sum(axis=1)
        scale = (self.longest + np.sqrt(square.max())) ** 2
        apart = np.sqrt(((self.centers - self.centers[head]) ** 2).sum(axis=1))
        with np.errstate(invalid="ignore"):
            some = np.flatnonzero(~(farther > 2.0 * apart[self.cell] * self.limit + 16.0 * (block.shape[1] + 4) * np.finfo(float).eps * scale))
        self.compared += len(some) * len(ids)
        kind = np.float32 if scale < 1e30 else np.float64  # squares fit single precision; false for NaN
        error = 4.0 * (block.shape[1] + 4) * np.finfo(kind).eps * scale + 1e-36
        side, square = block.astype(kind).T, square.astype(kind)
        for a in range(0, len(some), QUERY_ROWS):
            q = some[a : a + QUERY_ROWS]
            with np.errstate(over="ignore", invalid="ignore"):
                rough = (-2.0 * self.queries[q]).astype(kind) @ side
                rough += square
                hit = ~(rough > (self.limit[q] ** 2 - self.length[q] ** 2 + error).astype(kind)[:, None])
            at, r = np.divmod(np.flatnonzero(hit), len(ids))
            for b in range(0, len(at), PAIRS):
                self._measure(q[at[b : b + PAIRS]], r[b : b + PAIRS], ids, block)

    def _measure(self, q: np.ndarray, r: np.ndarray, ids: np.ndarray, block: np.ndarray) -> None:
        exact = _pair_distances(self.queries[q], block[r], "l2")
        kept = ~(exact > self.limit[q])
        if self.exclude_self:
            kept &= self.ids[q] != ids[r]
        for all_of, more in zip(self.found, (q[kept], ids[r[kept]], exact[kept])):
            all_of.append(more)
        self.gathered += np.count_nonzero(kept)
        if self.gathered > GATHERED:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, row ids and distances of the best rows met; no others are kept."""
        q, near, exact = (np.concatenate(x) for x in self.found)
        order = np.lexsort((near, exact, q))
        q, near, exact = q[order], near[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = (place == self.k - 1) & ~np.isnan(exact)
        self.limit[q[last]] = np.fmin(self.limit[q[last]], exact[last])
        kept = place < self.k
        q, near, exact = q[kept], near[kept], exact[kept]
        self.found, self.gathered = ([q], [near], [exact]), 0
        return q, near, exact


def knn_join_exact(
    queries: DataFrame, rows: DataFrame, near: DataFrame, model: Cells, k: int, key: str, vector: str,
    exclude_self: bool = False, sizes: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The ``k`` nearest rows for every query row, as ``search.knn_join`` finds them: query_id, row_id, distance, rank.

    ``near`` is what ``knn_join_cells`` found for at least ``k``: its distances are the limits beyond which nothing is looked for.
    Rows are laid out by cell and streamed past the queries; a query meets only cells that the centers cannot rule out, and each task
    passes on its best ``k`` per query. With ``sizes`` (``list_sizes``), a cell with many rows is spread over tasks. Queries beyond
    ``broadcast_bytes`` are compared with all rows, as is everything for a metric other than ``l2``.
    """
    kind = rows.schema[key].dataType.simpleString()
    asked = prepared(queries, key, vector, "l2")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim")).first()
    if model.metric != "l2" or size["n"] * (size["dim"] + 3) * 8 > broadcast_bytes:
        return knn_join(queries, rows, k, key, vector, model.metric, exclude_self)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["v"])
            if len(x):
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * x.shape[1]), len(x), [None, pa.py_buffer(x.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(model.nearest(x).astype(np.int32)), batch["id"], flat.cast(pa.binary())], ["cell", "id", "v"])

    def assigned(vectors: DataFrame) -> DataFrame:
        return vectors.mapInArrow(assign, f"cell int, id {kind}, v binary")

    def unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1) if len(column) else np.empty((0, 0))

    limits = near.filter(F.col("rank") <= k).groupBy("query_id").agg(F.max("distance").alias("limit"), F.count("*").alias("n"))
    limits = limits.filter(F.col("n") == k).select(F.col("query_id").alias("id"), "limit")
    table = assigned(asked).join(limits, "id", "left").select("id", "cell", "v", F.coalesce("limit", F.lit(math.inf)).alias("limit")).toArrow()
    sent = rows.sparkSession.sparkContext.broadcast((table["id"].to_numpy(), unpacked(table["v"]), table["cell"].to_numpy(), table["limit"].to_numpy()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, cell, limit = sent.value
        if not len(ids):
            return
        met = Unruled(model.centers, ids, vectors, cell, limit, k, exclude_self)
        for batch in batches:
            if len(batch):
                met.meet(batch["cell"].to_numpy(), batch["id"].to_numpy(zero_copy_only=False), unpacked(batch["v"]))
        q, row, distance = met.best()
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(row), pa.array(distance)], ["query_id", "row_id", "distance"])

    laid = assigned(prepared(rows, key, vector, "l2"))
    if sizes is not None:
        laid = laid.join(sizes.select("cell", "parts"), "cell", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
    laid = laid.repartition("cell", *(["part"] if sizes is not None else [])).sortWithinPartitions("cell").select("cell", "id", "v")
    candidates = laid.mapInArrow(search, f"query_id {kind}, row_id {kind}, distance double")
    best = Window.partitionBy("query_id").orderBy("distance", "row_id")
    return candidates.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def save_cells(model: Cells, spark, path: str) -> None:
    """Write centers and code books as a small table, so that lists can be searched by a later job."""
    parts, _, width = model.books.shape
    body = [("center", i, c.tolist()) for i, c in enumerate(model.centers)] + [(f"book {parts} {width} {model.metric}", i, c.tolist()) for i, c in enumerate(model.books.reshape(-1, width))]
    spark.createDataFrame(body, "kind string, at long, numbers array<double>").write.parquet(path)


def load_cells(spark, path: str) -> Cells:
    rows = spark.read.parquet(path).orderBy("kind", "at").collect()
    centers = np.array([r["numbers"] for r in rows if r["kind"] == "center"])
    books = [r for r in rows if r["kind"] != "center"]
    _, parts, width, metric = books[0]["kind"].split(" ")
    return Cells(centers, np.array([r["numbers"] for r in books]).reshape(int(parts), -1, int(width)), metric)
