"""Substring deduplication over words with fixed-block anchors.

Every document is cut into blocks of ``window // 2`` words that do not overlap; their hashes are the index. The
rolling windows of that length of all documents probe it. Any repeated passage of ``window`` words holds a whole
block of its earlier document, so it is hit. Hits are extended over neighbouring rolling windows that repeat, to
maximal runs, and each passage of ``window`` words inside a run is settled by a 128-bit digest: all but the
earliest go.

Probes travel as sorted 32-bit keys per block of texts and hash bucket (see ``blocks``), about four bytes a word, and
the answers are the repeating ones only. Passages inside runs are deduplicated within a block of texts before they
are shuffled, so a passage that a third of all documents share costs one row per block, not per document. Later
copies of whole texts are settled by digest and not probed.

Defined results: null and texts of separators have no words; a text shorter than the window loses words only if it
repeats none (it keeps all); rows that repeat an id are ordered by place, and a repeated row is a later document;
null ids come first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm import blocks as B
from curate.llm.frames import arrays_of, id_out
from curate.llm.words import Hasher, Words, spaces

WINDOW = 20
SEEDS = (23, 29)


def _words(block: B.Block, hasher: Hasher, gap: np.ndarray) -> Words:
    return Words(block.data, block.offsets, hasher, gap)


def _open(words: Words, copies: list[int] | None, window: int) -> np.ndarray:
    """Which words belong to documents that are probed."""
    probed = words.count >= window
    probed[copies or []] = False
    return np.repeat(probed, words.count)


def _answer(keys: list[np.ndarray], marked: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The keys of each row that repeat, flagged where the index has them."""
    every = np.sort(np.concatenate(keys))
    again = every[1:][every[1:] == every[:-1]]
    again = again[np.concatenate([[True], again[1:] != again[:-1]])] if len(again) else again
    index = np.unique(np.concatenate(marked))
    found = [own[B.is_in(own, again)] for own in map(np.unique, keys)]
    return found, [B.is_in(x, index) for x in found]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row; ``kept`` joins the words left by one space."""
    anchor = window // 2
    table = B.pack(docs)
    buckets = B.bucket_count(table)
    copies = B.later_copies(table, window)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, gap = Hasher(SEEDS[0]), spaces()
        for block, row in B.each(batches):
            words = _words(block, hasher, gap)
            at = np.flatnonzero(words.windows(anchor) & _open(words, row["copies"], window))
            key = B.bucketed(hasher.windows(words.hash, anchor)[at], buckets)
            aligned = (at - np.repeat(words.first[:-1], words.count)[at]) % anchor == 0
            yield B.question_rows(
                block.block, B.by_bucket(B.at_most_twice(np.sort(key)), buckets), B.by_bucket(np.unique(key[aligned]), buckets)
            )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, other, gap = Hasher(SEEDS[0]), Hasher(SEEDS[1]), spaces()
        for block, row in B.each(batches):
            words = _words(block, hasher, gap)
            repeated, hit = B.answered(row["answers"])
            inside = words.windows(anchor) & _open(words, row["copies"], window)
            at = np.flatnonzero(inside)
            key = B.bucketed(hasher.windows(words.hash, anchor)[at], buckets)
            again, hits = np.zeros((2, len(inside) + 1), np.int64)
            again[1:][at] = B.is_in(key, repeated)
            hits[1:][at] = B.is_in(key, repeated[hit])
            again, hits = np.cumsum(again), np.cumsum(hits)
            start = np.flatnonzero(words.windows(window))
            span = window - anchor + 1
            start = start[(again[start + span] - again[start] == span) & (hits[start + span] > hits[start])]
            if not len(start):
                continue
            a, b = hasher.windows(words.hash, window)[start], other.windows(words.hash, window)[start]
            doc = words.text_of_word()[start]
            order = np.lexsort((start, block.rank[doc], b, a))
            first = np.ones(len(order), bool)
            first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            ask = np.sort(order[first])  # neighbours differ little, so the rows compress
            yield B.ask_rows(a[ask], b[ask], block.ids[doc[ask]], np.full(len(ask), block.block), doc[ask], start[ask])
            if not first.all():
                yield B.known_row(block.block, B.ranges(np.sort(start[order[~first]])), block.block)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = spaces()
        for block, row in B.each(batches):
            words = Words(block.data, block.offsets, None, gap)
            gone = B.covered(len(words.start), window, row["starts"], row["known"])
            whole = np.zeros(len(words.count), bool)
            whole[row["copies"] or []] = True
            gone |= np.repeat(whole & (words.count >= window), words.count)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            raw, kept = block.data.tobytes(), []
            for d, (a, b) in enumerate(zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist())):
                text = raw[a:b].split()
                if removed[d]:
                    text = compress(text, (~gone[words.first[d] : words.first[d + 1]]).tolist())
                kept.append(b" ".join(text))
            yield arrays_of(doc_id=block.ids, n_words=words.count, n_removed=removed, kept=pa.array(kept, pa.binary()))

    def joined(*more: DataFrame) -> DataFrame:
        out = table.select("block", "ids", "offsets", "n_bytes", "body")
        for rows in more:
            out = out.join(rows, "block", "left")
        return out

    answers = B.meet(joined(copies).mapInArrow(probe, B.QUESTION), _answer)
    asks = joined(copies).join(answers, "block").mapInArrow(extend, B.ASK)
    late = B.repeats(asks, per_document=False)
    rows = joined(copies, late).mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept binary")
    return rows.select(id_out(), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
