"""Language-model scores from a probabilistic suffix tree.

The tree's nodes are contexts of up to ``DEPTH`` tokens. A context is a candidate if it occurs at least ``LEAST`` times
in the training tokens, whatever their number; it is kept if the distribution of the next token differs enough from
that of its longest proper suffix (a divergence test). Distributions are smoothed towards the suffix, down to add-half
counts of single tokens, and a token is scored by the longest kept context before it.

Counts come from the whole training part, and neither grams nor contexts are ever in one place. Each block of texts
sends its distinct grams with counts, by bucket of their hash, and gets the corpus counts back. Grams are
counted length by length: a gram is sent if both its parts, one token shorter, occur ``LEAST`` times. One block of those
that have a gram, its owner, sends it as an entry to the bucket of its context, where the test is made; blocks ask
there for their contexts and get back how many entries a kept context has and how often they occur. From
this each block computes the probabilities of its own tokens.

Tokens and grams are told apart by hashes of 64 bits.

Defined results: null and empty texts are one end token; null ids train and are not held out; repeated rows train
as often as they occur; without training tokens every token has count 0; an empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.llm import blocks as B
from curate.llm.frames import NO_ID, arrays_of, id_out, table
from curate.llm.words import Hasher, Words, lower_ascii, spaces
from curate.session import fresh_path, materialize, scratch

#: Longest context; least count of a gram.
DEPTH, LEAST = 3, 2
#: A context is kept if its gain in log-likelihood (nats) exceeds this much per next token it lists, plus a constant.
GAIN_PER_ENTRY, GAIN = 1.0, 5.0
#: Text of the blocks that one task reads, in bytes.
TASK_BYTES = 8 << 20
#: Hash of the end token.
END = np.uint64(0x656E64)
SEED = 43


def one_in_five(ids: np.ndarray) -> np.ndarray:
    """Documents that train: all but those with crc32 of the id modulo 5 equal to 1."""
    return np.array([i == NO_ID or zlib.crc32(str(i).encode()) % 5 != 1 for i in ids.tolist()], bool)


class Tokens:
    """Lower-cased words of one block, each document closed by an end token."""

    def __init__(self, block: B.Block, hasher: Hasher, gap: np.ndarray, low: np.ndarray):
        words = Words(block.data, block.offsets, hasher, gap, low)
        self.count = words.count + 1
        self.hash = np.insert(words.hash, words.first[1:], END)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.first = np.zeros(len(self.hash), bool)
        self.first[np.cumsum(self.count) - self.count] = True


def _hashed() -> tuple[Hasher, np.ndarray, np.ndarray]:
    return Hasher(SEED), spaces(), lower_ascii()


def _edges(keys: np.ndarray, buckets: int) -> list[int]:
    """Edges of the buckets in sorted keys: a bucket is a range of keys, so that their differences stay small."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1)).tolist()


def _pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers of 64 bits byte by byte, compressed; rising ones as differences."""
    gaps = np.diff(values.view(np.uint64), prepend=np.uint64(0)) if rising else np.ascontiguousarray(values).view(np.uint64)
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def _unpack(packed: bytes, kind=np.uint64, rising: bool = False) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    values = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if rising else values.view(kind)


#: Questions: grams with their counts in a block, or contexts asked for, or (``other`` is set) entries of contexts.
_ASK = "kind int, bucket int, block long, keys binary, counts binary, times binary, other binary"
#: Answers: for grams twice the corpus count, and one more for the owner (0 for grams of several tokens that are too rare to
#: matter); for contexts entries and sum of their counts.
_ANSWER = "kind int, bucket int, block long, counts binary, listed binary, distinct long, tokens long"


def _rows(kind: int, block: int, buckets: int, keys: np.ndarray, counts: np.ndarray | None = None, times: np.ndarray | None = None, other: np.ndarray | None = None) -> pa.RecordBatch:
    """Questions about sorted keys, one row per bucket that has any."""
    edges = _edges(keys, buckets)
    some = [(edges[i], edges[i + 1]) for i in range(buckets) if edges[i] < edges[i + 1]]

    def cut(values: np.ndarray | None, rising: bool = False) -> pa.Array:
        return pa.array([None if values is None else _pack(values[a:b], rising) for a, b in some], pa.binary())

    return arrays_of(
        kind=pa.array([kind] * len(some), pa.int32()), bucket=pa.array([i for i in range(buckets) if edges[i] < edges[i + 1]], pa.int32()),
        block=pa.array([block] * len(some), pa.int64()), keys=cut(keys, True), counts=cut(counts), times=cut(times), other=cut(other),
    )


def _answers(kind: int, bucket: int, blocks: list, counts: list, listed: list | None = None, distinct: int | None = None, tokens: int | None = None) -> pa.Table:
    n = len(blocks)
    return pa.table({
        "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "block": pa.array(blocks, pa.int64()),
        "counts": pa.array(counts, pa.binary()), "listed": pa.array(listed or [None] * n, pa.binary()),
        "distinct": pa.array([distinct if b is None else None for b in blocks], pa.int64()),
        "tokens": pa.array([tokens if b is None else None for b in blocks], pa.int64()),
    })


def _count(rows: pa.Table, kind: int, bucket: int) -> pa.Table:
    """Corpus counts of the grams that meet in a bucket; for single tokens also a row that sums up the bucket."""
    keys = [_unpack(x, rising=True) for x in rows["keys"].to_pylist()]
    counts = np.concatenate([_unpack(x, np.int64) for x in rows["counts"].to_pylist()])
    ends = np.cumsum([len(k) for k in keys])
    every, owner, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(which, weights=counts, minlength=len(every)).astype(np.int64)
    value = 2 * total[which]
    value[owner] += 1
    if kind:
        value[total[which] < LEAST] = 0
    blocks, out = rows["block"].to_pylist(), [_pack(x) for x in np.split(value, ends[:-1])]
    if kind:
        return _answers(kind, bucket, blocks, out)
    return _answers(kind, bucket, [*blocks, None], [*out, None], None, int((total > 0).sum()), int(total.sum()))


def _judge(rows: pa.Table, kind: int, bucket: int) -> pa.Table:
    """Number of entries and sum of their counts of the contexts asked for, 0 where a context is not kept."""
    entries = rows.filter(pc.is_valid(rows["other"]))
    asked = rows.filter(pc.is_null(rows["other"]))
    none = [np.empty(0, np.uint64)]
    key = np.concatenate(none + [_unpack(x, rising=True) for x in entries["keys"].to_pylist()])
    count, times = (np.concatenate([np.empty(0, np.int64)] + [_unpack(x, np.int64) for x in entries[c].to_pylist()]) for c in ("counts", "times"))
    other = np.concatenate([np.empty(0)] + [_unpack(x, np.float64) for x in entries["other"].to_pylist()])
    order = np.lexsort((other, count, key))  # sums do not depend on the order of rows
    key, count, times, other = key[order], count[order], times[order], other[order]
    found, first, context = np.unique(key, return_index=True, return_inverse=True)
    kept, _, _ = judged(context, count, other, times[first])
    size = np.where(kept, np.bincount(context, minlength=len(found)), 0)
    listed = np.where(kept, np.bincount(context, weights=count, minlength=len(found)), 0).astype(np.int64)
    sizes, sums = [], []
    for x in asked["keys"].to_pylist():
        own = _unpack(x, rising=True)
        at = np.minimum(np.searchsorted(found, own), max(len(found) - 1, 0))
        hit = found[at] == own if len(found) else np.zeros(len(own), bool)
        sizes.append(_pack(np.where(hit, size[at], 0) if len(found) else np.zeros(len(own), np.int64)))
        sums.append(_pack(np.where(hit, listed[at], 0) if len(found) else np.zeros(len(own), np.int64)))
    return _answers(kind, bucket, asked["block"].to_pylist(), sizes, sums)


def _meet(rows: pa.Table) -> pa.Table:
    kind, bucket = rows["kind"][0].as_py(), rows["bucket"][0].as_py()
    return (_judge if kind % 2 else _count)(rows, kind, bucket)


class Grams:
    """The grams that end at each token of a block, with what the answers so far say of them.

    Answers of kind 2 n are counts of grams of n + 1 tokens, those of kind 2 n - 1 are about contexts of n tokens.
    """

    def __init__(self, tokens: Tokens, train: np.ndarray, answers: list[dict], buckets: int, scale: float = 0.0):
        self.tokens, self.train, self.buckets, self.scale = tokens, train, buckets, scale
        self.answers: dict[int, list[dict]] = {}
        for x in sorted(answers, key=lambda x: (x["kind"], x["bucket"])):
            self.answers.setdefault(x["kind"], []).append(x)
        self.at, self.key, self.found, self.which, self.count, self.total, self.owned = ([] for _ in range(7))
        self.prob = None

    def ask(self) -> None:
        """The grams one token longer whose parts both occur ``LEAST`` times."""
        hashes = self.tokens.hash
        if not self.key:
            at, key = np.arange(len(hashes)), hashes
        else:
            often = self.count[-1] >= LEAST
            at = np.flatnonzero(often[:-1] & often[1:] & ~self.tokens.first[1:]) + 1
            key = np.zeros(len(hashes), np.uint64)
            key[at] = _mixed(self.key[-1][at - 1] * np.uint64(0x9E3779B97F4A7C15) + hashes[at])
        found, which = np.unique(key[at], return_inverse=True)
        self.at.append(at)
        self.key.append(key)
        self.found.append(found)
        self.which.append(which)

    def counted(self) -> None:
        """Corpus counts of the grams last asked for."""
        n, found, at = len(self.count), self.found[-1], self.at[-1]
        value = np.empty(0, np.int64)
        if len(found):
            value = np.concatenate([_unpack(x["counts"], np.int64) for x in self.answers[2 * n]])
        count = np.zeros(len(self.tokens.hash), np.int64)
        count[at] = (value >> 1)[self.which[-1]]
        self.count.append(count)
        self.total.append(value >> 1)
        self.owned.append((value & 1 == 1) & (value >> 1 >= LEAST))
        if n == 0:
            self.prob = (count + 0.5) / self.scale

    def followed(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens after a gram of n tokens in their document, and the number of that gram."""
        kind = np.full(len(self.tokens.hash), -1, np.int64)
        kind[self.at[n - 1]] = self.which[n - 1]
        at = np.flatnonzero((kind[:-1] >= 0) & ~self.tokens.first[1:]) + 1
        return at, kind[at - 1]

    def contexts(self, n: int) -> np.ndarray:
        """Numbers of the distinct grams of n tokens that matter here as contexts and may have entries.

        An entry follows its context in this block, or all its ``LEAST`` or more occurrences are elsewhere, and with them as many
        of the context.
        """
        at, context = self.followed(n)
        follows, listed = np.zeros((2, len(self.found[n - 1])), bool)
        follows[context] = True
        listed[context[self.count[n][at] >= LEAST]] = True
        own = np.bincount(self.which[n - 1][self.train[self.at[n - 1]]], minlength=len(follows))
        total = self.total[n - 1]
        return np.flatnonzero(follows & (total >= LEAST) & (listed | (total - own >= LEAST)))

    def entries(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Context (rising), count, count of the context and probability after the shorter context of owned grams of n + 1 tokens."""
        at = np.empty(len(self.found[n]), np.int64)
        at[self.which[n]] = self.at[n]  # any one place of each
        at = at[self.owned[n]]
        at = at[np.argsort(self.key[n - 1][at - 1], kind="stable")]
        return self.key[n - 1][at - 1], self.count[n][at], self.count[n - 1][at - 1], self.prob[at]

    def smooth(self, n: int) -> None:
        """Probabilities after contexts of n tokens, from those after contexts one token shorter."""
        asked = self.contexts(n)
        size, listed = np.zeros((2, len(self.found[n - 1])), np.int64)
        if len(asked):
            for into, name in ((size, "counts"), (listed, "listed")):
                into[asked] = np.concatenate([_unpack(x[name], np.int64) for x in self.answers[2 * n - 1]])
        at, context = self.followed(n)
        at, context = at[size[context] > 0], context[size[context] > 0]
        size, listed, times, count = size[context], listed[context], self.total[n - 1][context], self.count[n][at]
        share = (times - listed + size) / (times + size)
        self.prob[at] = np.where(count >= LEAST, count / (times + size), 0.0) + share * self.prob[at]


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def judged(context: np.ndarray, count: np.ndarray, other: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which contexts are kept, the share each leaves to its suffix, and the smoothed probabilities of the entries.

    ``context`` is the number of each entry's context, ``other`` its probability after the suffix of the context.
    """
    size = len(times)
    listed = np.bincount(context, weights=count, minlength=size)
    entries = np.bincount(context, minlength=size)
    share = (times - listed + entries) / (times + entries)
    own = count / (times + entries)[context] + share[context] * other
    left = np.maximum(1.0 - np.bincount(context, weights=other, minlength=size), 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.bincount(context, weights=own * np.log(own / other), minlength=size) + np.where(share > 0, share * left * np.log(share), 0.0)
    return (entries > 0) & (times * gain > GAIN + GAIN_PER_ENTRY * entries), share, own


class Level:
    """Grams of one length in one place: sorted keys, counts, and what they are as entries and as contexts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.suffix = self.prob = self.share = None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where absent."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


def build(levels: list[Level], total: int, distinct: int) -> None:
    """Smoothed probabilities of the entries, and the kept contexts with the share they leave to their suffix.

    The same tree as ``fit_and_score`` spreads over blocks and buckets, for grams that are all in one place.
    """
    levels[0].prob = (levels[0].counts + 0.5) / (total + 0.5 * (distinct + 1))
    for n, level in enumerate(levels[1:], 1):
        below = levels[n - 1]  # its grams are the contexts of this level's entries
        context, last = (level.keys >> np.uint64(32)).astype(np.int64), (level.keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if n == 1:
            level.suffix = last
        else:
            level.suffix = below.find((below.suffix[context].astype(np.uint64) << np.uint64(32)) | last.astype(np.uint64))
        other = below.prob[level.suffix]
        kept, share, own = judged(context, level.counts, other, below.counts.astype(np.float64))
        below.share = np.where(kept, share, 1.0)
        level.prob = np.where(kept[context], own, other)
    levels[-1].share = np.ones(len(levels[-1].keys))


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the table they were made for is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def _by_block(spark: SparkSession) -> Iterator[Callable[[DataFrame, int], DataFrame]]:
    """Writes tables bucketed by ``block``, so that joins on it move neither texts nor answers; they go at the end of the scope."""
    names = []
    with scratch(spark) as folder:

        def keep(rows: DataFrame, pieces: int) -> DataFrame:
            names.append(f"curate_{uuid.uuid4().hex}")
            rows.write.bucketBy(pieces, "block").saveAsTable(names[-1], path=f"{folder}/{names[-1]}")
            return spark.table(names[-1])

        try:
            yield keep
        finally:
            for name in names:
                spark.sql(f"DROP TABLE IF EXISTS {name}")


def fit_and_score(docs: DataFrame, learns: Callable[[np.ndarray], np.ndarray] = one_in_five) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``learns`` tells from an array of ids which documents train. Scores are log10 probabilities of the whole text
    with its end; the base score is that of single tokens.
    """
    spark = docs.sparkSession
    with _by_block(spark) as keep:  # only the result stays
        return materialize(_scored(docs, learns, keep), fresh_path(spark, "scores"))


def _scored(docs: DataFrame, learns: Callable[[np.ndarray], np.ndarray], keep: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    spark = docs.sparkSession
    with _tidy(spark), scratch(spark):
        packed = B.pack(docs).select("block", "ids", "offsets", "n_bytes", "body")
        buckets = B.bucket_count(packed)
        total = packed.agg(F.sum("n_bytes")).first()[0] or 0
        pieces = max(-(-total // TASK_BYTES), spark.sparkContext.defaultParallelism)
        texts = keep(packed.repartition(pieces, "block"), pieces)

    def by_block(rows: DataFrame) -> DataFrame:
        """One row per block with its answers."""
        own = F.collect_list(F.struct("kind", "bucket", "counts", "listed"))
        return keep(rows.repartition(pieces, "block").groupBy("block").agg(own.alias("answers")), pieces)

    def ask_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _hashed()
        for block, _ in B.each(batches):
            tokens = Tokens(block, *tools)
            grams = Grams(tokens, learns(block.ids)[tokens.doc], [], buckets)
            grams.ask()
            yield _gram_rows(grams, block)

    with _tidy(spark), scratch(spark):
        counted = table(texts.mapInArrow(ask_tokens, _ASK).groupBy("kind", "bucket").applyInArrow(_meet, _ANSWER))
        summed = counted.filter("block IS NULL").agg(F.sum("distinct"), F.sum("tokens")).first()
        answers = [by_block(counted.filter("block IS NOT NULL"))]
    distinct, total = summed[0] or 0, summed[1] or 0
    scale = total + 0.5 * (distinct + 1)

    def told() -> DataFrame:
        """The blocks with all answers so far, a column for each pass."""
        rows = texts
        for k, one in enumerate(answers):
            rows = rows.join(one.withColumnRenamed("answers", f"answers_{k}"), "block", "left")
        return rows

    def told_of(row: dict) -> list[dict]:
        return [x for name, some in row.items() if name.startswith("answers_") for x in some or ()]

    def ask_more(n: int) -> Callable:
        """Counts of grams of n + 1 tokens, and judgements of contexts of n - 1 tokens, from the answers before."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tools = _hashed()
            for block, row in B.each(batches):
                tokens = Tokens(block, *tools)
                grams = Grams(tokens, learns(block.ids)[tokens.doc], told_of(row), buckets, scale)
                for k in range(n):
                    grams.ask()
                    grams.counted()
                    if 1 <= k < n - 1:
                        grams.smooth(k)
                if n > 1:
                    yield _rows(2 * n - 3, block.block, buckets, grams.found[n - 2][grams.contexts(n - 1)])
                    key, count, times, other = grams.entries(n - 1)
                    yield _rows(2 * n - 3, block.block, buckets, key, count, times, other)
                if n <= DEPTH:
                    grams.ask()
                    yield _gram_rows(grams, block)

        return run

    for n in range(1, DEPTH + 2):
        asked = told().mapInArrow(ask_more(n), _ASK)
        with _tidy(spark):
            answers.append(by_block(asked.groupBy("kind", "bucket").applyInArrow(_meet, _ANSWER)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _hashed()
        for block, row in B.each(batches):
            tokens = Tokens(block, *tools)
            learned = learns(block.ids)
            grams, n = Grams(tokens, learned[tokens.doc], told_of(row), buckets, scale), len(tokens.count)
            for k in range(DEPTH + 1):
                grams.ask()
                grams.counted()
                if k:
                    grams.smooth(k)
                else:
                    base = np.bincount(tokens.doc, weights=np.log10(grams.prob), minlength=n)
            yield arrays_of(
                doc_id=block.ids, held_out=~learned, n_tokens=tokens.count,
                n_known=np.bincount(tokens.doc[grams.count[0] > 0], minlength=n), train_tokens=np.full(n, total),
                base_score=base, score=np.bincount(tokens.doc, weights=np.log10(grams.prob), minlength=n),
            )

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return told().mapInArrow(score, out).withColumn("doc_id", id_out())


def _gram_rows(grams: Grams, block: B.Block) -> pa.RecordBatch:
    """The grams last asked for, with their counts in the training documents of the block."""
    counts = np.bincount(grams.which[-1][grams.train[grams.at[-1]]], minlength=len(grams.found[-1]))
    return _rows(2 * (len(grams.found) - 1), block.block, buckets=grams.buckets, keys=grams.found[-1], counts=counts)
