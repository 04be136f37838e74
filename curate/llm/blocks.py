"""Texts in compressed blocks, and questions about their keys across blocks.

Operators that read whole texts several times and join small answers to them keep the texts in blocks of a few
megabytes, one row each, written once to the shared folder: a join then moves compressed blocks instead of texts.
Questions of the form "which of my keys occur elsewhere" are dealt by bucket of the key: a block sends each bucket
one row with its sorted 32-bit keys, a bucket's rows meet in one task, and each block gets one row back. The number
of buckets follows the input, so that what meets in a task stays bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm.frames import arrays_of, plain, release_memory, table
from curate.llm.words import buffers, cuts

#: Text per block, and text whose keys meet in one bucket, in bytes. Larger values make fewer and longer rows, at the
#: cost of memory in a task (some 60 times a block, 10 times a bucket); raise both with the executors' memory.
BLOCK_BYTES, BUCKET_BYTES = 1 << 20, 24 << 20
#: Compression of the texts.
LEVEL = 6

_SCHEMA = "block long, ids binary, offsets binary, digests binary, n_bytes long, body binary"


class Block:
    """Ids, bytes and offsets of the documents of one block."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        body = pa.decompress(row["body"], row["n_bytes"], codec="zstd") if row["n_bytes"] else b""
        self.data = np.frombuffer(body, np.uint8)
        #: Place of each document by (id, position).
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[np.argsort(self.ids, kind="stable")] = np.arange(len(self.ids))


def pack(docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` as a written table of blocks; ``digests`` has the MD5 of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, codec = TaskContext.get().partitionId() << 32, pa.Codec("zstd", compression_level=LEVEL)
        for batch in batches:
            ids, (data, offsets) = batch["doc_id"].to_numpy(), buffers(batch["text"])
            for first, last in cuts(offsets, BLOCK_BYTES):
                raw, inside = data[offsets[first] : offsets[last]].tobytes(), offsets[first : last + 1] - offsets[first]
                ends = inside.tolist()
                digests = b"".join(hashlib.md5(raw[a:b]).digest() for a, b in zip(ends, ends[1:]))
                yield arrays_of(
                    block=[block], ids=[ids[first:last].tobytes()], offsets=[inside.tobytes()], digests=[digests],
                    n_bytes=[len(raw)], body=[codec.compress(raw, asbytes=True) if raw else b""],
                )
                block += 1

    return table(plain(docs).mapInArrow(run, _SCHEMA))


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}
            yield Block(row), row
    release_memory()


def bucket_count(blocks: DataFrame) -> int:
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(1, -(-total // BUCKET_BYTES))


def later_copies(blocks: DataFrame, least: int) -> DataFrame:
    """``block, copies``: positions of documents of at least ``least`` bytes whose text occurs before, by (id, block, position)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch["ids"][i].as_py(), np.int64)
                sizes = np.diff(np.frombuffer(batch["offsets"][i].as_py(), np.int64))
                digests = batch["digests"][i].as_py()
                at = np.flatnonzero(sizes >= least)
                yield arrays_of(
                    digest=pa.array([digests[16 * j : 16 * j + 16] for j in at.tolist()], pa.binary()),
                    doc_id=ids[at], block=np.full(len(at), batch["block"][i].as_py()), position=at.astype(np.int32),
                )

    rows = blocks.select("block", "ids", "offsets", "digests").mapInArrow(run, "digest binary, doc_id long, block long, position int")
    place = F.struct("doc_id", "block", "position")
    first = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = rows.join(first, "digest").filter(place != F.col("first"))
    return table(later.groupBy("block").agg(F.collect_list("position").alias("copies")))


def bucketed(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32-bit key of 64-bit hashes, as one number: bucket above, key below."""
    return (((keys >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as compressed differences, byte by byte."""
    if not len(keys):
        return b""
    gaps = np.diff(keys.astype(np.uint32), prepend=np.uint32(0))
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T)
    return len(keys).to_bytes(4, "little") + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def unpack_keys(packed: bytes) -> np.ndarray:
    if not packed:
        return np.empty(0, np.uint32)
    n = int.from_bytes(packed[:4], "little")
    planes = np.frombuffer(pa.decompress(packed[4:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def by_bucket(sorted_keys: np.ndarray, buckets: int) -> list[bytes]:
    """The 32-bit keys of each bucket."""
    edges = np.searchsorted(sorted_keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
    low = sorted_keys.astype(np.uint32)
    return [pack_keys(low[a:b]) for a, b in zip(edges.tolist(), edges[1:].tolist())]


def at_most_twice(sorted_keys: np.ndarray) -> np.ndarray:
    """Two of each key at most: enough to tell that it repeats."""
    keep = np.ones(len(sorted_keys), bool)
    keep[2:] = sorted_keys[2:] != sorted_keys[:-2]
    return sorted_keys[keep]


def is_in(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values


def meet(questions: DataFrame, answer: Callable[[list[np.ndarray], list[np.ndarray]], tuple[list[np.ndarray], list[np.ndarray]]]) -> DataFrame:
    """``block, answers``: what ``answer`` makes of the rows ``bucket, block, keys, marked`` that meet in a bucket.

    ``answer`` gets the keys and the marked keys of each row, and returns for each row the keys to send back and
    a flag for each. Answers are structs ``bucket, keys, flags``.
    """

    def run(rows: pa.Table) -> pa.Table:
        keys = [unpack_keys(x) for x in rows["keys"].to_pylist()]
        marked = [unpack_keys(x) for x in rows["marked"].to_pylist()]
        found, flags = answer(keys, marked)
        some = [i for i, x in enumerate(found) if len(x)]
        out = rows.select(["bucket", "block"]).take(pa.array(some, pa.int64()))
        out = out.append_column("keys", pa.array([pack_keys(found[i]) for i in some], pa.binary()))
        return out.append_column("flags", pa.array([np.packbits(flags[i]).tobytes() for i in some], pa.binary()))

    answers = questions.groupBy("bucket").applyInArrow(run, "bucket int, block long, keys binary, flags binary")
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "keys", "flags")).alias("answers"))


def question_rows(block: int, keys: list[bytes], marked: list[bytes] | None = None) -> pa.RecordBatch:
    at = [i for i, k in enumerate(keys) if k]
    return arrays_of(
        bucket=pa.array(at, pa.int32()), block=pa.array([block] * len(at), pa.int64()),
        keys=pa.array([keys[i] for i in at], pa.binary()), marked=pa.array([marked[i] if marked else b"" for i in at], pa.binary()),
    )


QUESTION = "bucket int, block long, keys binary, marked binary"


def answered(answers: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """All keys sent back to a block, sorted, as ``bucketed`` numbers, and their flags."""
    keys, flags = [np.empty(0, np.uint64)], [np.empty(0, bool)]
    for x in sorted(answers or [], key=lambda x: x["bucket"]):
        low = unpack_keys(x["keys"]).astype(np.uint64)
        keys.append((np.uint64(x["bucket"]) << np.uint64(32)) | low)
        flags.append(np.unpackbits(np.frombuffer(x["flags"], np.uint8), count=len(low)).astype(bool))
    return np.concatenate(keys), np.concatenate(flags)


def ranges(starts: np.ndarray) -> bytes:
    """Sorted numbers as pairs (first, how many)."""
    if not len(starts):
        return b""
    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1]))
    return np.column_stack([starts[new], np.diff(np.append(new, len(starts)))]).astype(np.int32).tobytes()


def covered(n: int, width: int, starts: list[int] | None, packed: list[bytes] | None) -> np.ndarray:
    """Which of ``n`` places lie in a run of ``width`` from one of the starts, given singly and as ranges."""
    change = np.zeros(n + 1, np.int64)
    at = np.array(starts or [], np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + width, n), -1)
    for x in packed or []:
        first, count = np.frombuffer(x, np.int32).reshape(-1, 2).T.astype(np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, np.minimum(first + count - 1 + width, n), -1)
    return np.cumsum(change[:-1]) > 0


#: Rows that ask which of equal windows comes first; ``known`` has ranges already known to repeat.
ASK = "a long, b long, doc_id long, block long, doc int, start int, known binary"


def repeats(asks: DataFrame, per_document: bool) -> DataFrame:
    """``block, starts, known``: windows whose digest (a, b) occurs earlier, and the ranges known before.

    Earlier is by (id, block, document, start), or in an earlier document only.
    """
    from pyspark.sql import Window

    same = Window.partitionBy("a", "b")
    doc = F.struct("doc_id", "block", "doc")
    place = doc if per_document else F.struct("doc_id", "block", "doc", "start")
    late = asks.withColumn("first", F.min(place).over(same)).filter(F.col("known").isNotNull() | (place != F.col("first")))
    return late.groupBy("block").agg(
        F.collect_list(F.when(F.col("known").isNull(), F.col("start"))).alias("starts"), F.collect_list("known").alias("known")
    )


def ask_rows(a: np.ndarray, b: np.ndarray, doc_id: np.ndarray, block: np.ndarray, doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    return arrays_of(
        a=a.view(np.int64), b=b.view(np.int64), doc_id=doc_id, block=block, doc=doc.astype(np.int32), start=start.astype(np.int32),
        known=pa.nulls(len(a), pa.binary()),
    )


def known_row(block: int, packed: bytes, salt: int) -> pa.RecordBatch:
    """A row that only carries known ranges; its digest is its own, so that no window meets it."""
    return arrays_of(
        a=pa.array([salt], pa.int64()), b=pa.array([None], pa.int64()), doc_id=pa.array([0], pa.int64()), block=pa.array([block], pa.int64()),
        doc=pa.array([0], pa.int32()), start=pa.array([0], pa.int32()), known=pa.array([packed], pa.binary()),
    )
