"""The conversation trie and the dataset manifest against brute force on small tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from curate.llm import manifest, queries, trie
from odd_rows import ODD

TURNS = StructType([
    StructField(n, LongType() if n in ("conv_id", "turn", "node", "depth") else StringType())
    for n in ("conv_id", "turn", "role", "text", "node", "depth", "path", "chars", "digest", "shard", "body")
])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_trie(conversations, rebuild):
    """All nodes by definition, from ``{conv_id: [(role, text), ...]}``."""
    turns = {}
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild and c is not None else 0
        turns[c] = conversations.get(c - c % 100, [])[:h] + own[h:] if h else own
    order = lambda c: (c is not None, c)
    members = defaultdict(list)
    for c, seq in turns.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    least = {n: min(m, key=order) for n, m in members.items()}
    children = defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    ends = {n: sorted((c for c in m if len(turns[c]) == len(n)), key=order) for n, m in members.items()}
    name = lambda c: "null" if c is None else str(c)
    return sorted(
        str((least[n], len(n), least[n[:-1]] if n else None, len(m), children[n], leaves[n], saved[n], sha(",".join(map(name, ends[n])))))
        for n, m in members.items()
    )


def chats(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, 2, "p", "c", "d", "s", "b") for c, t, r, x in rows], TURNS).repartition(3)


def grouped(rows):
    """Turns in order; rows of one turn number are told apart by digest."""
    out = defaultdict(list)
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        out[c].append((t is not None, t, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest(), (r, x)))
    return {c: [x[-1] for x in sorted(v)] for c, v in out.items()}


def random_chats(seed, n=120):
    rnd, rows = random.Random(seed), []
    for c in rnd.sample([*range(0, 400), None, -3], n):
        long = rnd.random() < 0.1
        rows += [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bé", ""])) for t in range(rnd.randint(1, 40 if long else 7))]
    rows += [(c, t, "system", "same") for c in range(1000, 1060) for t in range(3)]  # many equal ones
    rows += [(2000, None, None, None), (2000, 1, "user", None), (2000, 1, "user", None), (2001, 5, "", "ab"), (2002, 5, "a", "b")]
    return rows


@pytest.mark.parametrize("seed, shard_turns", [(0, 1), (1, 7), (2, 60), (3, 1 << 19), (4, 20)])
def test_trie(spark, seed, shard_turns):
    rows = random_chats(seed)
    got = trie.build(trie.paths(chats(spark, rows)), shard_turns).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_trie(grouped(rows), False)
    rebuilt = trie.build(queries.rebuilt(trie.paths(chats(spark, [r for r in rows if r[0] != -3]))), shard_turns).collect()
    assert sorted(str(tuple(r)) for r in rebuilt) == plain_trie(grouped([r for r in rows if r[0] != -3]), True)


def test_shards_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(trie, "TASK_BYTES", 2000)
    monkeypatch.setattr(trie, "PIECE", 5)
    rows = random_chats(9)
    got = trie.build(trie.paths(chats(spark, rows)), 11).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_trie(grouped(rows), False)


def test_trie_of_one_turn_and_of_none(spark):
    assert trie.build(trie.paths(chats(spark, []))).collect() == []
    one = trie.build(trie.paths(chats(spark, [(None, None, None, None)]))).collect()
    assert sorted(str(tuple(r)) for r in one) == plain_trie({None: [("", "")]}, False)
    no_turn = spark.createDataFrame([(5, b"", b""), (3, b"", b"")], "conv_id long, path binary, chars binary")
    assert [tuple(r) for r in trie.build(no_turn).collect()] == [(3, 0, None, 2, 0, 1, 0, sha("3,5"))]


def test_a_long_conversation(spark):
    rows = [(c, t, "user", f"{t}") for c in (1, 2) for t in range(3000)] + [(2, 3000, "user", "x"), (3, 0, "user", "0")]
    got = trie.build(trie.paths(chats(spark, rows)), 50).collect()
    assert len(got) == 3002
    top = next(r for r in got if r.depth == 0)
    assert (top.n_convs, top.n_children, top.n_leaves, top.saved_tokens) == (3, 1, 1, 2 + sum(len(str(t)) for t in range(1, 3000)))
    assert {r.depth: r.n_convs for r in got} == {0: 3, 1: 3, **{d: 2 for d in range(2, 3001)}, 3001: 1}


def test_walk_sorts_and_starts_nodes():
    rnd = np.random.default_rng(4)
    rows = [tuple(rnd.integers(0, 3, rnd.integers(0, 20)).tolist()) for _ in range(300)]
    flat = np.array([x for r in rows for x in r], np.uint64)
    walk = trie.Walk(flat, flat, np.array([len(r) for r in rows]), np.arange(300))
    assert [rows[i] for i in walk.order] == sorted(rows)
    nodes = 0
    for d, at, begins, node, parents in walk:
        found = [rows[walk.order[i]][:d] for i in at]
        assert len(set(found)) == len(begins) == len(parents) and len(set(node.tolist())) == len(begins)
        nodes += len(begins)
    assert nodes == len({r[:d] for r in rows for d in range(1, len(r) + 1)})


def plain_manifest(rows, lower):
    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], len(r[1] or ""), text)))

    groups = defaultdict(list)
    for i, r in enumerate(rows):
        low = None if r[1] is None else r[1].encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).decode()
        h = leaf(r, r[1])
        groups[r[2]].append((r[0] is not None, r[0] or 0, h, leaf(r, low if lower(r[0]) else r[1]), i))

    def climb(level, claims):
        """Top, and per node the proof and the top that follows from its claim."""
        proofs, places = ["" for _ in level], list(range(len(level)))
        while len(level) > 1:
            for i, p in enumerate(places):
                run = range(p // 8 * 8, min(p // 8 * 8 + 8, len(level)))
                proofs[i] += "".join(level[j] for j in run if j != p)
                claims[i] = sha("".join(claims[i] if j == p else level[j] for j in run))
            level = [sha("".join(level[j : j + 8])) for j in range(0, len(level), 8)]
            places = [p // 8 for p in places]
        return level[0], proofs, claims

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:4])
        tops[g] = climb([x[2] for x in groups[g]], [x[3] for x in groups[g]])
    out = []
    for i, g in enumerate(names):
        for j, x in enumerate(groups[g]):
            claims = [tops[n][0] for n in names]
            claims[i] = tops[g][2][j]
            root, proofs, ends = climb([tops[n][0] for n in names], claims)
            out.append(str((rows[x[4]][0], x[2], tops[g][0], root, sha(tops[g][1][j] + proofs[i]), ends[i], ends[i] == root)))
    return sorted(out)


def run_manifest(docs, lower):
    lowered = F.when(lower, F.translate("text", queries._UPPER, queries._LOWER)).otherwise(F.col("text"))
    m = manifest.manifest(docs, presented={"text": lowered})
    end = manifest.folded(F.col("presented"), F.col("path"))
    found = m.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")).alias("p"), end.alias("e"), (end == F.col("root")).alias("v"))
    return sorted(str(tuple(r)) for r in found.collect())


def test_manifest(spark, documents):
    rnd = random.Random(3)
    sizes = {"en": 530, "de": 64, "fr": 65, "es": 8, "it": 9, "pt": 1, "é": 3, None: 2, "zz": 1, "a": 1}
    rows = [(i * 7 % 1009, "".join(rnd.choice("aB ÉöX") for _ in range(rnd.randint(0, 9))), g) for i, g in enumerate(x for g, n in sizes.items() for x in [g] * n)]
    rows = [(i, None if i % 11 == 0 else t, g, None if i % 5 == 0 else f"s{i % 3}") for i, t, g in rows]
    got = run_manifest(documents(rows), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    assert got == plain_manifest(rows, lambda i: zlib.crc32(str(i).encode()) % 3 == 0)


def test_manifest_of_odd_rows(spark, documents):
    rows = [(r[0], r[1], *(r[2:] or ("en", "src0"))) for r in ODD]
    assert run_manifest(documents(rows), F.lit(True)) == plain_manifest(rows, lambda i: True)
    assert run_manifest(documents([]), F.lit(True)) == []
    one = [(None, "A", None, None)]
    assert run_manifest(documents(one), F.lit(False)) == plain_manifest(one, lambda i: False)


def test_a_changed_row_breaks_only_its_own_proof(spark, documents):
    rows = [(i, f"text {i}", "en", "s") for i in range(20)]
    m = manifest.manifest(documents(rows), presented={"source": F.when(F.col("doc_id") == 7, F.lit("t")).otherwise(F.col("source"))})
    bad = m.filter(manifest.folded(F.col("presented"), F.col("path")) != F.col("root")).collect()
    assert [r.doc_id for r in bad] == [7]
