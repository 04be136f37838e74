"""Piece encoding and decoding with the source bytes of every piece.

A text is normalised first: from left to right the longest prefix that the model's compiled character map knows is
replaced, every other character stays; blanks become marks, and one mark goes before the text. The map is a
double-array trie, walked for all characters of a batch at once, byte by byte. Every normalised byte keeps the place
of the source bytes it stands for, so that a piece, being a run of normalised bytes, has a span in the source.

No piece of such a model has a mark after another character, so merges never reach over the start of a marked
word: words are cut there, and each distinct word of a batch is encoded once, by the library that the model file is made for, without
its own normalisation. A model in which this does not hold has its texts encoded whole. Each row is handled by itself: nothing
is shuffled, and long texts are cut at the same places, so that memory follows a batch of ``CHUNK`` bytes
and the pieces of the longest text (some 40 bytes a piece) plus its longest run without blanks.

Defined results: null and empty texts have no pieces and decode to the empty text; repeated rows, ties and null
ids keep their rows; other columns are left behind. A replaced run of characters is the source of all bytes that
replace it; the mark before a text has an empty span. Models need byte pieces, so that every text can be encoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm.frames import arrays_of, id_out, plain, release_memory
from curate.llm.words import buffers, cuts

#: Text encoded together, in bytes.
CHUNK = 2 << 20
#: Distinct words kept between batches, and the longest of them.
CACHE, KEPT_WORD = 200_000, 64
#: The mark that stands for a blank.
MARK = "▁".encode()


class CharMap:
    """A compiled map of byte strings: the trie's size, its units, then the replacements, each closed by a zero byte."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4)
        self.texts = np.frombuffer(compiled, np.uint8, offset=4 + size)
        self.ends = np.flatnonzero(self.texts == 0)

    @staticmethod
    def _step(units: np.ndarray) -> np.ndarray:
        """Distance to the children of a unit: 22 bits, times 256 where bit 9 says so."""
        return (units >> 10) << ((units & 0x200) >> 6)

    def longest(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest known string at each place (0: none), and where its replacement starts."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        alive, node = np.arange(len(at)), np.full(len(at), self._step(self.units[:1])[0], np.uint32)
        depth = 0
        while len(alive):
            inside = at[alive] + depth < ends[alive]
            alive, node = alive[inside], node[inside]
            byte = data[at[alive] + depth].astype(np.uint32)
            node = node ^ byte
            unit = self.units[node]
            same = (unit & np.uint32(0x800000FF)) == byte
            alive, node, unit = alive[same], node[same], unit[same]
            node = node ^ self._step(unit)
            depth += 1
            final = (unit & 0x100) != 0
            length[alive[final]] = depth
            value[alive[final]] = self.units[node[final]] & 0x7FFFFFFF
        return length, value

    def replace(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes after replacement, and for each the place of its source."""
        first = np.flatnonzero((data & 0xC0) != 0x80)
        ends = offsets[np.searchsorted(offsets, first, "right")]
        length, value = self.longest(data, first, ends)
        hit = np.flatnonzero(length)
        at, length, value = first[hit], length[hit], value[hit]
        keep, reached = np.ones(len(at), bool), 0
        if len(at) and (at[1:] < (at + length)[:-1]).any():  # a match that reaches into the next one hides it
            for i, (a, n) in enumerate(zip(at.tolist(), length.tolist())):
                keep[i] = a >= reached
                reached = a + n if keep[i] else reached
        at, length, value = at[keep], length[keep], value[keep]
        size = self.ends[np.searchsorted(self.ends, value)] - value
        count = np.ones(len(data), np.int64)
        cover = np.zeros(len(data) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        count[np.cumsum(cover[:-1]) > 0] = 0
        count[at] = size
        source = np.repeat(np.arange(len(data)), count)
        out = data[source]
        begin = (np.cumsum(count) - count)[at]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin, size) + inner] = self.texts[np.repeat(value, size) + inner]
        # What a match covers maps to its first byte; a match replaced by nothing leaves no byte.
        return out, source


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        with open(path, "rb") as file:
            model = ModelProto.FromString(file.read())
        kinds, spec, trained = ModelProto.SentencePiece, model.normalizer_spec, model.trainer_spec
        pieces, kind = [p.piece.encode() for p in model.pieces], np.array([p.type for p in model.pieces])
        if (kind == kinds.BYTE).sum() != 256 or trained.treat_whitespace_as_suffix:
            raise ValueError("a model with byte pieces and marks before words is needed")
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.mark = spec.add_dummy_prefix, spec.remove_extra_whitespaces, MARK if spec.escape_whitespaces else b" "
        plain_kind = np.isin(kind, (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED))
        self.apart = trained.model_type == trained.BPE and self.mark == MARK and not (kind == kinds.USER_DEFINED).any()
        self.apart &= not any(MARK in p.lstrip(MARK) for p, own in zip(pieces, plain_kind) if own and MARK in p)
        self.size = np.array([1 if k == kinds.BYTE else len(p) for p, k in zip(pieces, kind)], np.int64)
        self.starts_marked = np.array([p.startswith(MARK) and bool(own) for p, own in zip(pieces, plain_kind)])
        self.hidden = kind == kinds.CONTROL
        self.is_high_byte = np.array([k == kinds.BYTE and int(p[3:5], 16) > 127 for p, k in zip(pieces, kind)])
        shown = {kinds.BYTE: lambda p: bytes([int(p[3:5], 16)]), kinds.CONTROL: lambda p: b"", kinds.UNKNOWN: lambda p: trained.unk_surface.encode()}
        self.surface = pa.array([shown.get(k, lambda p: p.replace(MARK, b" "))(p) for p, k in zip(pieces, kind.tolist())], pa.binary())
        self.whole = SentencePieceProcessor(model_proto=model.SerializeToString())
        spec.Clear()
        spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
        self.core = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.known: dict[bytes, bytes] = {}

    def normalise(self, data: np.ndarray, offsets: np.ndarray, prefix: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes, offsets of the texts in them, and the source place of each byte (one more: the end)."""
        out, source = self.map.replace(data, offsets) if self.map else (data, np.arange(len(data)))
        if self.squeeze:
            text = np.searchsorted(offsets, source, "right")
            blank = out == 32
            new = np.r_[True, text[1:] != text[:-1]] if len(out) else np.empty(0, bool)
            drop = blank & (new | np.r_[False, blank[:-1]][: len(out)])
            # Blanks at the end: after the last other byte of a text.
            last = np.full(len(offsets) + 1, -1)
            solid = np.flatnonzero(~blank)
            last[text[solid]] = solid  # rising, so the last one stays
            drop |= blank & (np.arange(len(out)) > last[text])
            out, source = out[~drop], source[~drop]
        begins = np.searchsorted(source, offsets)
        mark = np.frombuffer(self.mark, np.uint8)
        blank = np.flatnonzero(out == 32)
        lead = np.zeros(len(out), np.int64)
        if self.prefix and prefix:
            lead[begins[:-1][begins[:-1] < begins[1:]]] = len(mark)
        count = lead + 1
        count[blank] += len(mark) - 1
        start = np.cumsum(count) - count
        total = int(count.sum())
        result = np.empty(total, np.uint8)
        result[start + lead] = out
        for i, byte in enumerate(mark):
            result[(start + lead)[blank] + i] = byte
            result[start[lead > 0] + i] = byte
        return result, np.append(start, total)[begins], np.append(np.repeat(source, count), len(data))

    def _ids(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            known.update((w, np.array(ids, np.int32).tobytes()) for w, ids in zip(new, self.core.encode([w.decode() for w in new], num_threads=1)))
        found = [known[w] for w in words]
        for w in new:
            if len(w) > KEPT_WORD:
                del known[w]
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray, prefix: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of some texts, their number per text, and the source span of each within its text."""
        text, bounds, source = self.normalise(data, offsets, prefix)
        begin = np.zeros(len(text), bool)
        begin[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        if self.apart:
            marked = np.zeros(len(text) + 3, bool)
            marked[3:-2] = (text[:-2] == MARK[0]) & (text[1:-1] == MARK[1]) & (text[2:] == MARK[2]) if len(text) > 2 else False
            begin |= marked[3:] & ~marked[:-3]
        start = np.append(np.flatnonzero(begin), len(text)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start) - 1, [None, pa.py_buffer(start), pa.py_buffer(text)]).dictionary_encode()
        entries = self._ids(words.dictionary.to_pylist())
        flat, length = np.frombuffer(b"".join(entries), np.int32), np.array([len(x) // 4 for x in entries], np.int64)
        which = words.indices.to_numpy()
        first = (np.cumsum(length) - length)[which]
        length = length[which]
        done = np.cumsum(length)
        ids = flat[np.repeat(first - done + length, length) + np.arange(done[-1] if len(done) else 0)]
        end = np.cumsum(self.size[ids])
        counts = np.diff(np.searchsorted(end, bounds, "right"))
        shift = np.repeat(offsets[:-1], counts)
        return ids, counts, source[end - self.size[ids]] - shift, source[end] - shift

    def encode_long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``encode`` for one text, in parts that begin with a blank after another character."""
        edges = [0]
        if self.apart and not self.map and not self.squeeze:
            blank = data == 32
            at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
            marks = (data[at - 1] == MARK[2]) & (data[np.maximum(at - 2, 0)] == MARK[1]) & (data[np.maximum(at - 3, 0)] == MARK[0])
            at = at[~marks]
            while len(data) - edges[-1] > CHUNK:
                i = np.searchsorted(at, edges[-1] + CHUNK, "right") - 1
                if i < 0 or at[i] <= edges[-1]:
                    i += 1  # a run without blanks longer than a part
                if i >= len(at):
                    break
                edges.append(int(at[i]))
        parts = []
        for a, b in zip(edges, [*edges[1:], len(data)]):
            ids, _, start, end = self.encode(data[a:b], np.array([0, b - a]), prefix=a == 0)
            parts.append((ids, (start + a).astype(np.int32), (end + a).astype(np.int32)))
        ids, start, end = (np.concatenate(x) for x in zip(*parts))
        return ids, np.array([len(ids)]), start, end

    def _whole_characters(self, raw: np.ndarray, ids: np.ndarray) -> bool:
        """Byte pieces form characters, with no control piece between them."""
        if (self.hidden[ids]).any():
            return False
        try:
            raw.tobytes().decode()
        except UnicodeDecodeError:
            return False
        return True

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of runs of ids."""
        body = self.surface.take(pa.array(ids))
        raw, inside = buffers(body)
        ends = np.concatenate([[0], np.cumsum(counts)])
        offsets = inside[ends]
        filled = counts > 0
        cut = np.zeros(len(counts), np.int64)
        if self.prefix or self.squeeze:
            cut[filled] = self.starts_marked[ids[ends[:-1][filled]]]
        keep = np.ones(len(raw), bool)
        keep[offsets[:-1][cut > 0]] = False
        moved = np.concatenate([[0], np.cumsum(np.diff(offsets) - cut)]).astype(np.int32)
        texts = pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(moved), pa.py_buffer(raw[keep])])
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(self.is_high_byte[ids]), "right") - 1)
        broken = {d for d in odd.tolist() if not self._whole_characters(raw[offsets[d] : offsets[d + 1]], ids[ends[d] : ends[d + 1]])}
        if broken:  # as the library reads them
            known = texts.cast(pa.binary()).to_pylist()
            for d in broken:
                known[d] = self.whole.decode(ids[ends[d] : ends[d + 1]].tolist()).encode()
            texts = pa.array(known, pa.binary()).cast(pa.string())
        return texts


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, model: str, decoded: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids, starts, ends`` of every text by the model file: ids and their byte spans in the text.

    With ``decoded`` the text that the ids give again is added.
    """
    fields = "doc_id long, n_tokens long, ids array<int>, starts array<int>, ends array<int>" + (", decoded string" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        codec = Codec(model)
        for batch in batches:
            names, (data, offsets) = batch["doc_id"], buffers(batch["text"])
            for first, last in cuts(offsets, CHUNK):
                part, inside = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                ids, counts, starts, ends = codec.encode_long(part) if len(part) > CHUNK else codec.encode(part, inside)
                columns = {
                    "doc_id": names.slice(first, last - first), "n_tokens": counts.astype(np.int64),
                    "ids": _lists(ids, counts), "starts": _lists(starts, counts), "ends": _lists(ends, counts),
                }
                yield arrays_of(**columns, **({"decoded": codec.decode(ids, counts)} if decoded else {}))

    return plain(docs).mapInArrow(run, fields).withColumn("doc_id", id_out())


def decode(rows: DataFrame, model: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key, decoded``: the text of each row's ids (null or empty: the empty text)."""
    fields = f"{key} {rows.schema[key].dataType.simpleString()}, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            lists = batch[1]
            counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch[0], codec.decode(flat, counts)], [key, "decoded"])

    filled = F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>"))
    return rows.select(key, filled.alias("_ids")).mapInArrow(run, fields)
