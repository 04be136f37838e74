"""Suffix-array deduplication over bytes.

A byte goes if a string of ``WIDTH`` bytes around it also starts in an earlier document. Suffixes are range
partitioned by their leading bytes with sampled splitters, each bucket sorts its suffixes by multikey quicksort
(eight bytes at a time, only ties go on) and marks all but the earliest document of equal prefixes, and leading
bytes that lie on the boundary of a bucket are compared across buckets.

Only suffixes that can repeat are sorted. Of every ``WIDTH - GRAM + 1`` consecutive grams the one with the smallest
hash is the anchor of the string that starts with them, so equal strings have equal anchors at equal distance. The
hashes of anchors, one in 14 bytes, are exchanged first (see ``blocks``); suffixes whose anchor occurs in no other
document stay where they are. The others travel as runs, one row per anchor with the bytes of all strings it
owns, keyed by the eight bytes that lead at the anchor. Runs are deduplicated inside a block of texts before,
and a hot anchor spreads over several ranges by a second key. Later copies of whole texts are settled by digest.

Defined results: null texts are empty; texts shorter than ``WIDTH`` bytes lose nothing; rows that repeat an id are
ordered by place, and a repeated row is a later document; null ids come first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm import blocks as B
from curate.llm.frames import arrays_of, id_out, release_memory, table
from curate.llm.words import Hasher

#: Length of a string that counts as a repeat, and of the grams that anchor it, in bytes.
WIDTH, GRAM = 50, 24
#: Suffixes sorted together, besides those of one leading key.
SORTED = 1 << 19
SEEDS = (31, 37, 41)

_RUN = "lead long, spread long, run binary, doc_id long, block long, doc int, start int, known binary"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


class Anchors:
    """Anchors of the strings of ``WIDTH`` bytes of one block: places, hashes, documents, and the strings each owns."""

    def __init__(self, block: B.Block, copies: list[int] | None, hasher: Hasher):
        n, sizes = len(block.data), np.diff(block.offsets)
        empty = np.empty(0, np.int64)
        self.at = self.low = self.high = self.doc = empty
        self.hash = np.empty(0, np.uint64)
        if n < WIDTH:
            return
        grams = hasher.windows(hasher.byte[block.data], GRAM)
        bits = np.uint64(max(21, n.bit_length()))
        mask = (np.uint64(1) << bits) - np.uint64(1)
        least = sliding_min((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), WIDTH - GRAM + 1)
        inside = np.repeat(block.offsets[1:], sizes) - np.arange(n) >= WIDTH
        probed = np.ones(len(sizes), bool)
        probed[copies or []] = False
        start = np.flatnonzero((inside & np.repeat(probed, sizes))[: len(least)])
        if not len(start):
            return
        owner = (least[start] & mask).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        self.at, self.low, self.high = owner[new], start[new], start[np.append(new[1:], len(start)) - 1]
        self.hash, self.doc = grams[self.at], np.searchsorted(block.offsets, self.at, "right") - 1


def _answer(keys: list[np.ndarray], marked: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    every = np.sort(np.concatenate(keys))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    found = [own[B.is_in(own, again)] for own in map(np.unique, keys)]
    return found, [np.ones(len(x), bool) for x in found]


def equal_prefixes(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes, by index into ``at``, that share their first ``width`` bytes with another, and the group of each.

    Multikey quicksort with eight bytes as one symbol: each pass orders the ties of the last one by the next
    symbol, and suffixes without a tie drop out.
    """
    view = np.lib.stride_tricks.sliding_window_view(data, 8)
    index, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for offset in [*range(0, width - 8, 8), width - 8]:
        if not len(index):
            break
        symbol = view[at[index] + offset].copy().view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((symbol, group)) if offset else np.argsort(symbol, kind="stable")
        index, group, symbol = index[order], group[order], symbol[order]
        new = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])])
        tied = ~(new & np.append(new[1:], True))
        group = np.cumsum(new)
        index, group = index[tied], group[tied]
    return index, group


_SORTED = "bucket int, block long, known binary, " + ", ".join(f"{c} binary" for c in ("a", "b", "doc_id", "blocks", "doc", "start"))
_ASKED = (("a", np.uint64), ("b", np.uint64), ("doc_id", np.int64), ("blocks", np.int64), ("doc", np.int64), ("start", np.int64))


def _known(block: int, packed: bytes) -> pa.RecordBatch:
    """Strings found to go; the negative bucket only spreads such rows."""
    nothing = {c: pa.nulls(1, pa.binary()) for c, _ in _ASKED}
    return arrays_of(bucket=pa.array([-1 - block % 1009], pa.int32()), block=pa.array([block], pa.int64()), known=pa.array([packed], pa.binary()), **nothing)


def _per_block(block: np.ndarray, place: np.ndarray) -> list[tuple[int, bytes]]:
    """Places to go as packed ranges of each block."""
    order = np.lexsort((place, block))
    block, place = block[order], place[order]
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else np.empty(0, np.int64)
    return [(int(block[a]), B.ranges(np.unique(place[a:b]))) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _across(rows: pa.Table) -> pa.Table:
    """Strings on boundaries of buckets that meet by digest: all but those of the earliest document go."""
    known = rows.filter(rows["known"].is_valid())
    asked = rows.filter(rows["known"].is_null())
    found = list(zip(known["block"].to_pylist(), known["known"].to_pylist()))
    if asked.num_rows:
        a, b, doc_id, block, doc, start = (np.concatenate([np.frombuffer(x, t) for x in asked[c].to_pylist()]) for c, t in _ASKED)
        order = np.lexsort((doc, block, doc_id, b, a))
        a, b, doc_id, block, doc, start = (x[order] for x in (a, b, doc_id, block, doc, start))
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        best = np.repeat(head, np.diff(np.append(head, len(a))))
        gone = (doc_id != doc_id[best]) | (block != block[best]) | (doc != doc[best])
        found += _per_block(block[gone], start[gone])
    return pa.table({"block": pa.array([x for x, _ in found], pa.int64()), "known": pa.array([x for _, x in found], pa.binary())})


def _sort_bucket(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The removed strings of one bucket, and questions about those on its boundaries."""
    rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if rows is None or not rows.num_rows:
        return
    lead = rows["lead"].to_numpy()
    order = np.argsort(lead, kind="stable")
    lead = lead[order]
    ends = np.flatnonzero(np.append(lead[1:] != lead[:-1], True)) + 1
    sizes = np.array([len(x) for x in rows["run"].to_pylist()])[order] - WIDTH + 1
    total = np.cumsum(sizes)
    hashers, first = (Hasher(SEEDS[1]), Hasher(SEEDS[2])), 0
    while first < len(lead):
        upto = ends[ends > first]
        fits = upto[total[upto - 1] - (total[first - 1] if first else 0) <= SORTED]
        last = int(fits[-1] if len(fits) else upto[0])
        part = rows.take(pa.array(order[first:last]))
        yield from _sort_part(part, (lead[first:last] == lead[0]) | (lead[first:last] == lead[-1]), hashers, buckets)
        first = last
    release_memory()


def _sort_part(rows: pa.Table, boundary: np.ndarray, hashers: tuple[Hasher, Hasher], buckets: int) -> Iterator[pa.RecordBatch]:
    runs = rows["run"].to_pylist()
    data = np.frombuffer(b"".join(runs), np.uint8)
    length = np.array([len(x) for x in runs])
    count = length - WIDTH + 1
    row = np.repeat(np.arange(len(runs)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(length) - length)[row] + step
    doc_id, block, doc, start = (rows[c].to_numpy().astype(np.int64) for c in ("doc_id", "block", "doc", "start"))
    removed = np.zeros(len(at), bool)
    index, group = equal_prefixes(data, at, WIDTH)
    if len(index):
        r = row[index]
        order = np.lexsort((doc[r], block[r], doc_id[r], group))
        index, group, r = index[order], group[order], r[order]
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        best = r[np.repeat(head, np.diff(np.append(head, len(r))))]
        removed[index[(doc_id[r] != doc_id[best]) | (block[r] != block[best]) | (doc[r] != doc[best])]] = True
    place = start[row] + step
    for which, packed in _per_block(block[row[removed]], place[removed]):
        yield _known(which, packed)
    asked = np.flatnonzero(boundary[row] & ~removed)
    if len(asked):
        a, b = (h.spans(h.sums(h.byte[data]), at[asked], at[asked] + WIDTH) for h in hashers)
        bucket = (a % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        r = row[asked]
        columns = (a, b, doc_id[r], block[r], doc[r], place[asked])
        some = [k for k in range(buckets) if edges[k] < edges[k + 1]]
        packed = {
            c: pa.array([x[order[edges[k] : edges[k + 1]]].astype(t).tobytes() for k in some], pa.binary()) for (c, t), x in zip(_ASKED, columns)
        }
        yield arrays_of(bucket=pa.array(some, pa.int32()), block=pa.nulls(len(some), pa.int64()), known=pa.nulls(len(some), pa.binary()), **packed)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row; ``kept`` holds the bytes left."""
    texts = B.pack(docs)
    buckets = B.bucket_count(texts)
    copies = B.later_copies(texts, WIDTH)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SEEDS[0])
        for block, row in B.each(batches):
            anchors = Anchors(block, row["copies"], hasher)
            key = B.bucketed(anchors.hash, buckets)
            order = np.lexsort((anchors.doc, key))
            key, doc = key[order], anchors.doc[order]
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            yield B.question_rows(block.block, B.by_bucket(B.at_most_twice(key[once]), buckets))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SEEDS[0])
        for block, row in B.each(batches):
            anchors = Anchors(block, row["copies"], hasher)
            some = np.flatnonzero(B.is_in(B.bucketed(anchors.hash, buckets), B.answered(row["answers"])[0]))
            if not len(some):
                continue
            at, low, high, doc = (x[some] for x in (anchors.at, anchors.low, anchors.high, anchors.doc))
            content = hasher.spans(hasher.sums(hasher.byte[block.data]), low, high + WIDTH)
            order = np.lexsort((low, block.rank[doc], at - low, high - low, content))
            same = np.zeros(len(order), bool)
            for x in (content, high - low, at - low):
                same[1:] |= x[order][1:] != x[order][:-1]
            head = np.maximum.accumulate(np.where(np.concatenate([[True], same[1:]]), np.arange(len(order)), 0))
            later = doc[order] != doc[order[head]]
            sent, gone = np.sort(order[~later]), order[later]
            raw = block.data.tobytes()
            view = np.lib.stride_tricks.sliding_window_view(block.data, 8)
            lead = view[at[sent]].copy().view(">u8").ravel().astype(np.uint64).view(np.int64)
            spread = ((block.block * 0x9E3779B1 & 0x7FFFFFFF) + low[sent] * 0x85EBCA6B) & 0x7FFFFFFF
            yield arrays_of(
                lead=lead, spread=spread, run=pa.array([raw[a:b] for a, b in zip(low[sent].tolist(), (high[sent] + WIDTH).tolist())], pa.binary()),
                doc_id=block.ids[doc[sent]], block=np.full(len(sent), block.block), doc=doc[sent].astype(np.int32),
                start=low[sent].astype(np.int32), known=pa.nulls(len(sent), pa.binary()),
            )
            if len(gone):
                starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(low[gone], high[gone])]))
                own = B.known_row(block.block, B.ranges(starts), 0)
                yield arrays_of(
                    lead=pa.array([None], pa.int64()), spread=pa.array([0], pa.int64()), run=pa.array([b""], pa.binary()),
                    doc_id=own["doc_id"], block=own["block"], doc=own["doc"], start=own["start"], known=own["known"],
                )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, row in B.each(batches):
            sizes = np.diff(block.offsets)
            gone = B.covered(len(block.data), WIDTH, None, row["known"])
            whole = np.zeros(len(sizes), bool)
            whole[row["copies"] or []] = True
            gone |= np.repeat(whole, sizes)
            first = np.zeros(len(gone), bool)
            first[block.offsets[:-1][sizes > 0]] = True
            opens = gone.copy()
            opens[1:] &= ~gone[:-1] | first[1:]
            removed, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[block.offsets]) for x in (gone, opens))
            left = block.data[~gone].tobytes()
            ends = np.cumsum(sizes - removed).tolist()
            kept = [left[a:b] for a, b in zip([0, *ends], ends)]
            yield arrays_of(doc_id=block.ids, n_bytes=sizes, n_removed=removed, n_spans=spans, kept=pa.array(kept, pa.binary()))

    def joined(*more: DataFrame) -> DataFrame:
        out = texts.select("block", "ids", "offsets", "n_bytes", "body")
        for rows in more:
            out = out.join(rows, "block", "left")
        return out

    answers = B.meet(joined(copies).mapInArrow(probe, B.QUESTION), _answer)
    found = table(joined(copies).join(answers, "block").mapInArrow(runs, _RUN))
    by_lead = found.filter("known IS NULL").drop("known").repartitionByRange("lead", "spread")
    sorted_ = by_lead.mapInArrow(lambda batches: _sort_bucket(batches, buckets), _SORTED)
    late = sorted_.groupBy("bucket").applyInArrow(_across, "block long, known binary")
    every = late.unionByName(found.filter("known IS NOT NULL").select("block", "known"))
    gone = every.groupBy("block").agg(F.collect_list("known").alias("known"))
    rows = joined(copies, gone).mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return rows.withColumn("doc_id", id_out())
