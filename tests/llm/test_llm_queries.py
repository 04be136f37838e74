"""The operators' queries against their SQL, or against their contract's brute force, on whole tables."""

import math
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import oracle

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@pytest.fixture(scope="module")
def texts(spark, tables):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()}


def test_all_are_registered():
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in QUERIES) == 1
    assert "pipeline" in QUERIES


@pytest.mark.parametrize("name", [n for n in sorted(SQL) if n.startswith("op")])
def test_sql(spark, tables, name):
    assert oracle.compare(spark, oracle.connect(tables), QUERIES[name], SQL[name], tables) == ""


def test_toxicity(spark, tables):
    rows = QUERIES["op1_toxicity"](spark, tables).join(spark.read.parquet(f"{tables}/labels.parquet"), "doc_id", "left").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    known = [r for r in rows if r.toxic is not None]
    assert sum(r.predicted == r.toxic for r in known) / len(known) > 0.9
    held = [r for r in known if r.held_out]
    toxic, clean = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    better = sum((a > b) + (a == b) / 2 for a in toxic for b in clean)
    assert better / (len(toxic) * len(clean)) > 0.7


def test_language_model(spark, tables, texts):
    rows = QUERIES["op6_suffix_tree"](spark, tables).collect()
    tokens = {i: [*t.encode().translate(LOW).split(), 0] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ws = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_quality_statistics(spark, tables, texts):
    def plain(text):
        words = text.encode().split()
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
        return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)

    rows = QUERIES["op8_quality_outliers"](spark, tables).collect()
    for r in rows:
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert 0.5 < sum(r.kept for r in rows) / len(rows) < 0.95


def test_packing(spark, tables, texts):
    rows = QUERIES["op10_packing"](spark, tables).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*e.ids, 0] for i, e in zip(texts, model.encode_batch(list(texts.values()), add_special_tokens=False))}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for i, found in pieces.items():
        at = 0
        for start, length in sorted(found):
            assert start == at and length > 0
            at += length
        assert at == len(ids[i])
    assert pieces.keys() == ids.keys()
    padding = 0
    for found in windows.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.03 * sum(map(len, ids.values()))
