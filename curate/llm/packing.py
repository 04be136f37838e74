"""Packing documents into token windows by order-preserving dynamic programming.

Documents are tokenized and laid end to end in the order of their rows. Windows are cut at the ends of
documents or sentences (anywhere only inside a sentence longer than a window) so that padding plus truncation
penalties is least. Since padding is linear in a window's length, the best predecessor of a cut is a sliding
minimum, kept in a monotone queue; lengths that are powers of two, which need no padding, are extra
transitions. The work is linear in the number of cuts.

Each run of about a megabyte of text is packed by itself inside one task: nothing is shuffled, memory is bounded
by the run (or by one longer document), and a lost task is repeated from its input split. Windows do not span
runs, which costs at most one partly filled window in about 400.

Defined results: null and empty texts give the closing id alone; null ids, repeated rows and ties keep their
place as separate documents; other columns are left behind; an empty table gives no windows.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from curate.llm.frames import arrays_of, id_out, plain, release_memory
from curate.llm.words import Hasher, buffers, cuts

WINDOW = 1024
#: Text packed together, in bytes.
RUN_BYTES = 1 << 20
#: Costs, in padded tokens: a cut between sentences, one inside a sentence, and each window.
SENTENCE_COST, HARD_COST, WINDOW_COST = 4, 64, 16
#: Id that closes a document.
CLOSE = 0
#: Tokenized words kept at a time.
CACHE = 100_000

# Fixed value: the pre-tokenizing pattern of byte-level vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def gap_after_blank(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Blanks followed by white space or the end of their text, where the pattern's white-space rule spans words."""
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    at = np.flatnonzero(data == 32)
    one, two, three = padded[at + 1], padded[at + 2], padded[at + 3]
    gap = (one <= 32) | ((one == 0xC2) & ((two == 0x85) | (two == 0xA0))) | ((one == 0xE1) & (two == 0x9A) & (three == 0x80))
    gap |= (one == 0xE2) & (((two == 0x80) & ((three <= 0x8A) | np.isin(three, (0xA8, 0xA9, 0xAF)))) | ((two == 0x81) & (three == 0x9F)))
    gap |= (one == 0xE3) & (two == 0x80) & (three == 0x80)
    return at[gap | np.isin(at + 1, offsets)]


class Encoder:
    """Token ids of texts by a byte-level BPE file of the ``tokenizers`` library.

    Words that follow a single blank are tokenized apart from their neighbours, hence once, and new ones all in
    one string, with the same merges in ``tiktoken``, which is faster. Texts with wider gaps or special tokens go
    through whole.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        letters, vocabulary = byte_letters(), model["model"]["vocab"]
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.special = re.compile(b"|".join(re.escape(t.encode()) for t in special)) if special else re.compile(b"(?!)")
        self.size = np.zeros(1 + max([*ranks.values(), *special.values()]), np.int64)
        self.ends = np.zeros(len(self.size), bool)  # of sentences
        for token, i in ranks.items():
            self.size[i], self.ends[i] = len(token), token[-1:] in (b".", b"!", b"?", b"\n")
        self.hasher = Hasher(11)
        self.known: dict[int, bytes] = {}

    @functools.cached_property
    def model(self):
        """The library's tokenizer, which only texts with special tokens need: it holds the vocabulary once more."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Words with a leading blank, no gap and no special token inside."""
        ids = np.array(self.fast.encode_ordinary(b"".join(words).decode()), np.uint32)
        cut = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(w) for w in words])) + 1
        raw, cut = ids.tobytes(), [0, *(4 * cut).tolist()]
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def _whole(self, text: bytes) -> bytes:
        plain_text = text.decode()
        ids = self.model.encode(plain_text, add_special_tokens=False).ids if self.special.search(text) else self.fast.encode_ordinary(plain_text)
        return np.array(ids, np.uint32).tobytes()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, each closed by ``CLOSE``, and the number per text."""
        if len(self.known) > CACHE:
            self.known = {}
        n = len(offsets) - 1
        whole = np.zeros(n, bool)
        whole[np.searchsorted(offsets, gap_after_blank(data, offsets), "right") - 1] = True
        if self.special.search(data.tobytes()):
            whole |= [bool(self.special.search(data[a:b].tobytes())) for a, b in zip(offsets[:-1], offsets[1:])]
        blank = data == 32
        for d in np.flatnonzero(whole):
            blank[offsets[d] : offsets[d + 1]] = False
        blank[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        start = np.flatnonzero(blank)
        end = np.append(start[1:], len(data))
        key = self.hasher.spans(self.hasher.sums(self.hasher.byte[data]), start, end)
        found, first, which = np.unique(key, return_index=True, return_inverse=True)
        found, known = found.tolist(), self.known
        new = [i for i, k in enumerate(found) if k not in known]
        if new:
            at = first[new]
            doc = np.searchsorted(offsets, start[at], "right") - 1
            alone = whole[doc] | (data[start[at]] != 32)
            raw, spans = data.tobytes(), list(zip(start[at].tolist(), end[at].tolist()))
            for one in (True, False):
                picked = [i for i, a in enumerate(alone.tolist()) if a == one]
                texts = [raw[spans[i][0] : spans[i][1]] for i in picked]
                known.update(zip([found[new[i]] for i in picked], map(self._whole, texts) if one else self._words(texts) if texts else ()))
        entries = [known[k] for k in found]
        flat, length = np.frombuffer(b"".join(entries), np.uint32), np.array([len(x) // 4 for x in entries], np.int64)
        begin = np.cumsum(length) - length
        length, begin = length[which], begin[which]
        done = np.cumsum(length)
        ids = flat[np.repeat(begin - done + length, length) + np.arange(done[-1] if len(done) else 0)]
        upto = np.concatenate([[0], done])[np.searchsorted(start, offsets)]
        return np.insert(ids, upto[1:], CLOSE), np.diff(upto) + 1


def cut_points(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and the penalty of each; gaps longer than a window get hard cuts."""
    places = np.union1d(np.union1d(doc_ends, sentence_ends), [0, total])
    cost = np.where(np.isin(places, doc_ends), 0, SENTENCE_COST)
    cost[0] = 0
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > window)
    if len(wide):
        hard = np.concatenate([np.arange(places[i] + window, places[i + 1], window) for i in wide])
        order = np.argsort(both := np.concatenate([places, hard]), kind="stable")
        places, cost = both[order], np.concatenate([cost, np.full(len(hard), HARD_COST)])[order]
    return places, cost


def best_cuts(places: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Ends of the windows, a subset of ``places``, with least padding plus penalties."""
    n = len(places)
    extra_to, extra_from = [], []
    power = 1
    while power < window:
        at = np.searchsorted(places, places - power)
        hit = np.flatnonzero((at < n) & (places[np.minimum(at, n - 1)] == places - power))
        extra_to.append(hit)
        extra_from.append(at[hit])
        power *= 2
    to, back = np.concatenate(extra_to), np.concatenate(extra_from)
    order = np.argsort(to, kind="stable")
    to, back = [*to[order].tolist(), n], back[order].tolist()
    where, price = places.tolist(), (cost + WINDOW_COST).tolist()
    best, source = [0] * n, [0] * n
    queue, low = deque([0]), [where[0]] * n  # indices by rising low = best + place
    x, next_to = 0, to[0]
    for j in range(1, n):
        at = where[j]
        while where[queue[0]] < at - window:
            queue.popleft()
        i = queue[0]
        value = low[i] + window - at
        while next_to == j:
            if best[back[x]] < value:
                value, i = best[back[x]], back[x]
            x += 1
            next_to = to[x]
        value += price[j]
        best[j], source[j] = value, i
        value += at
        low[j] = value
        while queue and low[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    ends, j = [], n - 1
    while j > 0:
        ends.append(where[j])
        j = source[j]
    return np.array(ends[::-1], np.int64)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in windows: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the path of a tokenizer file. With ``with_ids`` each piece also carries its token ids.
    ``sequence_id`` is unique and rises in the order of packing within an input split.
    """
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    fields += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = Encoder(tokenizer), TaskContext.get().partitionId() << 40
        release_memory()
        for batch in batches:
            names, (data, offsets) = batch["doc_id"], buffers(batch["text"])
            for first, last in cuts(offsets, RUN_BYTES):
                ids, counts = encoder.encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                doc_ends = np.cumsum(counts)
                doc_starts = doc_ends - counts
                final = encoder.ends[ids]
                final[:-1] &= ~final[1:]
                sentences = np.flatnonzero(final) + 1
                ends = best_cuts(*cut_points(len(ids), doc_ends, sentences, window), window)
                starts = np.concatenate([[0], ends[:-1]])
                to = np.union1d(ends, doc_ends)
                lo = np.concatenate([[0], to[:-1]])
                doc, piece = np.searchsorted(doc_ends, lo, "right"), np.searchsorted(ends, lo, "right")
                raw = memoryview(ids.astype("<u4").tobytes())
                columns = {
                    "doc_id": names.slice(first, last - first).take(pa.array(doc)),
                    "start": lo - doc_starts[doc],
                    "length": to - lo,
                    "ids_crc32": np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), to.tolist())], np.int64),
                    "doc_tokens": counts[doc],
                    "sequence_id": sequence + piece,
                    "offset": lo - starts[piece],
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(lo, to[-1:]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                sequence += len(ends)
                yield arrays_of(**columns)

    rows = plain(docs).mapInArrow(run, fields)
    return rows.withColumn("doc_id", id_out())
