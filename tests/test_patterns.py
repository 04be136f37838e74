"""The automaton and the prefix trie against plain search, and their Spark functions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from curate.operators import patterns


def occurrences(text, literal):
    return [i for i in range(len(text) - len(literal) + 1) if text.startswith(literal, i)]


@pytest.mark.parametrize("seed", range(6))
def test_automaton(seed, monkeypatch):
    monkeypatch.setattr(patterns, "LANE", 8)
    rnd = random.Random(seed)
    letters = "abcé" if seed % 2 else "ab"
    literals = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))).encode() for _ in range(30)})
    texts = ["".join(rnd.choice(letters + "xé ") for _ in range(rnd.randint(0, 120))) for _ in range(40)] + ["", None]
    data, offsets = patterns._buffers(pa.array(texts))
    text, which, end = patterns.Automaton(literals).hits(data, offsets)
    got = sorted((t, literals[w], e - offsets[t]) for t, w, e in zip(text.tolist(), which.tolist(), end.tolist()))
    want = sorted((t, x, i + len(x)) for t, s in enumerate(texts) for x in literals for i in occurrences((s or "").encode(), x))
    assert got == want


def test_prefixes():
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("ab/é") for _ in range(rnd.randint(1, 7))).encode() for _ in range(60)})
    texts = ["".join(rnd.choice("ab/éx") for _ in range(rnd.randint(0, 12))) for _ in range(300)] + [None]
    best = patterns.Prefixes(words).longest(*patterns._buffers(pa.array(texts)))
    for text, i in zip(texts, best.tolist()):
        fits = [w for w in words if (text or "").encode().startswith(w)]
        assert (words[i] if i >= 0 else None) == max(fits, key=len, default=None)


def table(spark, literals):
    return spark.createDataFrame([(x,) for x in literals], "l string")


def test_hits_of_several_groups(spark, monkeypatch):
    texts = [(1, "one twö three two"), (2, ""), (3, None), (4, "twotwo"), (5, "ne th")]
    rows = spark.createDataFrame(texts, "id long, text string")
    literals = ["two", "twö", "ne", "ne t", "three", "", None, "absent", "two"]
    want = sorted((i, x, p + 1) for i, t in texts for x in {x for x in literals if x} for p in occurrences(t or "", x))
    for limit in (1 << 17, 8):
        monkeypatch.setattr(patterns, "GROUP_BYTES", limit)
        assert sorted(map(tuple, patterns.literal_hits(rows, "id", "text", table(spark, literals), "l").collect())) == want
        kept = patterns.filter_any_literal(rows, ["text"], table(spark, literals), "l")
        assert sorted(r.id for r in kept.collect()) == [1, 4, 5] and kept.columns == rows.columns
    none = table(spark, [""])
    assert patterns.literal_hits(rows, "id", "text", none, "l").collect() == []
    assert patterns.filter_any_literal(rows, ["text"], none, "l").collect() == []


def test_several_columns(spark):
    rows = spark.createDataFrame([(1, "ab", None), (2, None, "xaby"), (3, "a", "b"), (4, None, None)], "id long, a string, b string")
    assert sorted(r.id for r in patterns.filter_any_literal(rows, ["a", "b"], table(spark, ["ab"]), "l").collect()) == [1, 2]


def test_longest_prefix(spark, monkeypatch):
    entries = ["http://a.org", "http://a.org/x", "http://a.org/x/y", "https://b", ""]
    rows = spark.createDataFrame([("http://a.org/x/z",), ("http://a.org",), ("https://b.com/",), ("ftp://a",), (None,)], "url string")
    want = {"http://a.org/x/z": "http://a.org/x", "http://a.org": "http://a.org", "https://b.com/": "https://b", "ftp://a": None, None: None}
    for limit in (1 << 21, 16):
        monkeypatch.setattr(patterns, "PREFIX_BYTES", limit)
        assert {r.url: r.prefix for r in patterns.longest_prefix(rows, "url", table(spark, entries), "l").collect()} == want


def test_work_does_not_follow_the_number_of_literals():
    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 123, 1 << 20).astype(np.uint8)
    offsets = np.arange(0, len(data) + 1, 1 << 12)
    few, many = (patterns.Automaton(sorted({bytes(rnd.integers(97, 123, 9).astype(np.uint8)) for _ in range(n)})) for n in (10, 5000))
    import time

    def seconds(automaton):
        start = time.perf_counter()
        automaton.hits(data, offsets)
        return time.perf_counter() - start

    assert min(seconds(many) for _ in range(3)) < 8 * min(seconds(few) for _ in range(3))
