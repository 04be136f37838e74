"""Piece encoding against the library, its character map on a small compiled one, and spans."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
from curate.llm import pieces
from curate.llm.words import buffers
from odd_rows import ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(PATH)


def random_texts(seed, n):
    rnd = random.Random(seed)
    parts = ["a", "b", "e", " ", "  ", "\n", "\t", "é", "漢", "🎈", "▁", "<s>", "</s>", "<unk>", "<0x0A>", "the", "ing", " ▁", "\0", "　", "́", "1", "."]
    return ["", " ", "▁", " a ", "▁ ▁a▁"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def check(codec, texts):
    ids, counts, starts, ends = codec.encode(*buffers(pa.array(texts)))
    decoded, at = codec.decode(ids, counts).to_pylist(), 0
    for text, n, back in zip(texts, counts.tolist(), decoded):
        want = LIBRARY.encode(text)
        assert ids[at : at + n].tolist() == want and back == LIBRARY.decode(want)
        spans = list(zip(starts[at : at + n].tolist(), ends[at : at + n].tolist()))
        assert all(a <= b for a, b in spans) and [b for _, b in spans][:-1] == [a for a, _ in spans][1:]  # they tile the text
        assert not spans or (spans[0][0], spans[-1][1]) == (0, len(text.encode()))
        raw = text.encode()
        for i, (a, b) in zip(want, spans):
            shown = LIBRARY.id_to_piece(i)
            piece = bytes([int(shown[3:5], 16)]) if LIBRARY.is_byte(i) else shown.encode()
            surface = raw[a:b].replace(b" ", pieces.MARK)
            assert piece == surface or (a == 0 and piece == pieces.MARK + surface)
        at += n


def test_as_the_library(codec):
    check(codec, random_texts(1, 3000))


def test_one_cache_for_many_batches(codec, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 50)
    for seed in range(2, 6):
        check(codec, random_texts(seed, 200))


def test_long_texts_are_cut_between_words(codec, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 64)
    for text in [*random_texts(7, 50), "  ".join(["word"] * 100), "x" * 300, "a " + "y" * 200 + " b  " * 60, " " * 200]:
        ids, counts, starts, ends = codec.encode_long(np.frombuffer(text.encode(), np.uint8))
        whole = codec.encode(*buffers(pa.array([text])))
        assert ids.tolist() == LIBRARY.encode(text) and counts.tolist() == [len(ids)]
        assert starts.tolist() == whole[2].tolist() and ends.tolist() == whole[3].tolist()


def test_ids_that_no_text_gives_are_decoded_as_the_library_does(codec):
    rnd = random.Random(3)
    runs = [[rnd.choice([0, 1, 2, 3, *range(3, 259), *range(259, 400)]) for _ in range(rnd.randint(0, 12))] for _ in range(500)]
    counts = np.array([len(r) for r in runs])
    got = codec.decode(np.array([i for r in runs for i in r], np.int32), counts).to_pylist()
    assert got == [LIBRARY.decode(r) for r in runs]


def compiled(table):
    """A character map in the compiled form, for a few strings: a double-array trie filled node by node."""
    texts, places = b"", {}
    for key, value in table.items():
        places[key.encode()] = len(texts)
        texts += value.encode() + b"\0"
    units, used, bases = {0: 0}, {0}, set()

    def place(node, prefix):
        children = sorted({k[len(prefix)] for k in places if k.startswith(prefix) and len(k) > len(prefix)})
        labels = ([0] if prefix in places else []) + children
        base = next(b for b in range(1, 1 << 20) if b not in bases and all((b ^ c) not in used and (b ^ c) for c in labels) and (node ^ b) < (1 << 21))
        bases.add(base)
        used.update(base ^ c for c in labels)
        units[node] = units.get(node, 0) | ((node ^ base) << 10) | (0x100 if prefix in places else 0)
        if prefix in places:
            units[base] = 0x80000000 | places[prefix]
        for c in children:
            units[base ^ c] = c
        for c in children:
            place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    size = max(units) + 256
    array = np.zeros(size, "<u4")
    array[list(units)] = list(units.values())
    # A label that no child has must not be taken for one: unused units carry an impossible label.
    array[[i for i in range(size) if i not in units]] = 0x80000000
    return (4 * size).to_bytes(4, "little") + array.tobytes() + texts


def test_character_map():
    table = {"ﬁ": "fi", "é": "e", "é": "é", "ab": "X", "abc": "Y Z", "ca": "", " ": " "}
    found = pieces.CharMap(compiled(table))
    rnd = random.Random(9)
    letters = ["a", "b", "c", "é", "e", "́", "ﬁ", " ", "漢", " "]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    data, offsets = buffers(pa.array(texts))
    out, source = found.replace(data, offsets)
    want, places = b"", []
    for text, at in zip(texts, offsets):
        while text:
            key = max((k for k in table if text.startswith(k)), key=len, default=None)
            new, n = (table[key], len(key)) if key else (text[0], 1)
            width = len(text[:n].encode())
            want += new.encode()
            places += [at] * len(new.encode()) if key else list(range(at, at + width))
            text, at = text[n:], at + width
    assert out.tobytes() == want and source.tolist() == places


def test_map_and_squeezed_blanks_in_a_model(codec, monkeypatch):
    monkeypatch.setattr(codec, "map", pieces.CharMap(compiled({" ": " ", "ﬁ": "fi"})))
    monkeypatch.setattr(codec, "squeeze", True)
    text = "  a  ﬁn  b "
    norm, bounds, source = codec.normalise(*buffers(pa.array([text, " ", "c"])))
    assert norm.tobytes().decode() == "▁a▁fin▁b▁c" and bounds.tolist() == [0, 14, 14, 18]
    raw = text.encode()
    ids, counts, starts, ends = codec.encode(*buffers(pa.array([text])))
    assert ids.tolist() == LIBRARY.encode("a fin b") and raw[starts[0] : ends[0]].strip() == b"a" and "ﬁn".encode() in raw[starts[1] : ends[-2]]


def test_table(spark, documents):
    rows = pieces.encode(documents(ODD), PATH, decoded=True).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in rows) == sorted((str(i), LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t, *_ in ODD)
    assert all(len(r.ids) == len(r.starts) == len(r.ends) == r.n_tokens for r in rows)
    again = pieces.decode(pieces.encode(documents(ODD), PATH), PATH).collect()
    assert sorted(str(r) for r in again) == sorted(str(r) for r in pieces.encode(documents(ODD), PATH, True).select("doc_id", "decoded").collect())
    assert pieces.encode(documents([]), PATH).collect() == []
    lists = spark.createDataFrame([(1, [306, 29871]), (2, None), (3, [])], "doc_id long, ids array<long>")
    assert {r.doc_id: r.decoded for r in pieces.decode(lists, PATH).collect()} == {1: LIBRARY.decode([306, 29871]), 2: "", 3: ""}


def test_query(spark, tables):
    import hashlib

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()}
    ids = dict(zip(texts, LIBRARY.encode(list(texts.values()))))
    rows = __spark_entry__.queries()["op12_sentencepiece"](spark, tables).orderBy(F.col("doc_id")).collect()
    assert [tuple(r) for r in rows] == [(i, len(ids[i]), sha(",".join(map(str, ids[i]))), sha(LIBRARY.decode(ids[i]))) for i in sorted(texts)]
