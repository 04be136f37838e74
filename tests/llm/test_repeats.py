"""Similarity join, substring and suffix deduplication, exact duplicates against brute force on small tables."""

import hashlib
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from curate.llm import blocks, exact, jaccard, substring, suffix
from curate.llm.frames import table
from odd_rows import LOW, ODD


def shingle_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = tuple((t or "").encode().translate(LOW).split())
        sets[i] = frozenset([w[j : j + k] for j in range(len(w) - k + 1)] if len(w) >= k else ([w] if w else []))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    common = defaultdict(int)
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                common[a, b] += 1
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def noisy(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = rnd.choice("abcdefg")
    return " ".join(words)


def near_copies():
    rnd, rows = random.Random(5), []
    for _ in range(30):
        base = [rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(1, 200))]
        rows += [noisy(rnd, base, rnd.randint(0, 6)) for _ in range(rnd.randint(1, 12))]
    line = [rnd.choice("abcdefghijkl") for _ in range(40)]  # a hot passage, with tails of many lengths
    rows += [" ".join(line + [rnd.choice("uvwxyz") for _ in range(rnd.randint(0, 12))]) for _ in range(120)]
    rows += ["a", "A b", "a b", "a b c", "", None, "  ", "a b c d", "A B C D"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80)])
def test_similarity_join(documents, words, percent):
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(documents(rows), words, percent).collect()}
    assert got == shingle_groups(rows, words, percent)


def test_similarity_join_does_not_depend_on_column_order(documents, monkeypatch):
    rows = near_copies()
    monkeypatch.setattr(jaccard, "OFTEN", 10**6)  # no frequent shingles: columns in order of hash
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(documents(rows), 4, 85).collect()}
    assert got == shingle_groups(rows, 4, 85)


def test_one_of_each_group_stays(documents):
    rows = near_copies()
    kept = sorted(r.doc_id for r in jaccard.drop_similar(documents(rows)).collect())
    assert kept == sorted({c for _, c in shingle_groups(rows, 5, 80).values()})


def test_ids_that_repeat_with_other_texts(documents):
    rnd = random.Random(8)
    base = [rnd.choice("abcdefghijklmnop") + rnd.choice("qrstuv") for _ in range(80)]
    near, other = " ".join([*base[:-1], "x"]), " ".join(reversed(base))
    rows = [(3, near), (5, " ".join(base)), (5, other), (None, other + " y"), (None, "w " * 30 + "z"), (9, None), (9, "")]
    got = [(r.doc_id is None, r.doc_id or 0, r.text) for r in jaccard.drop_similar(documents(rows)).select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(False, 3, near), (True, 0, other + " y"), (True, 0, "w " * 30 + "z"), (False, 9, None), (False, 9, "")], key=str)
    groups = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(documents(rows)).collect()}
    assert {(3, 76, 3), (5, 76, 3), (5, 76, None), (9, 0, 9)} <= groups


def test_families_of_columns_are_split(documents, monkeypatch):
    rows = near_copies()
    monkeypatch.setattr(jaccard, "FAMILY", 50)
    monkeypatch.setattr(jaccard, "PAIRS", 64)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(documents(rows), 4, 85).collect()}
    assert got == shingle_groups(rows, 4, 85)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.rep: r.component for r in jaccard.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def small_blocks(monkeypatch):
    """Many blocks and buckets, so that small tables cross them."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 8000)
    monkeypatch.setattr(suffix, "SORTED", 2000)


def repeated_words(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            key = tuple(words[s : s + width])
            if key in seen:
                gone[s : s + width] = [True] * width
            seen.add(key)
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


@pytest.mark.parametrize("width", [20, 6, 7])
def test_substring(documents, monkeypatch, width):
    small_blocks(monkeypatch)
    rnd = random.Random(width)
    phrases = [" ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(5, 60))) for _ in range(12)]
    rows = [
        (i, " ".join(rnd.choice(phrases) + " " + " ".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(0, 4))))
        for i in range(250)
    ]
    rows += [(400 + i, rows[i][1]) for i in range(40)] + [(1000, None), (1001, ""), (1002, " \n ")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(documents(rows, 5), width).collect()}
    assert got == repeated_words(rows, width)


def repeated_bytes(rows, width=50):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        text = (t or "").encode()
        gone, own = bytearray(len(text)), set()
        for s in range(len(text) - width + 1):
            key = text[s : s + width]
            if key in seen:
                gone[s : s + width] = b"\1" * width
            else:
                own.add(key)
        seen |= own
        spans = sum(1 for j in range(len(text)) if gone[j] and not (j and gone[j - 1]))
        out[i] = (len(text), sum(gone), spans, bytes(c for c, g in zip(text, gone) if not g))
    return out


def test_suffix(documents, monkeypatch):
    small_blocks(monkeypatch)
    rnd = random.Random(3)
    phrases = ["".join(rnd.choice("abcé ") for _ in range(rnd.randint(30, 160))) for _ in range(14)] + ["ab" * 60, "x" * 130]
    rows = [
        (i, "".join(rnd.choice(phrases) + "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(0, 4))))
        for i in range(250)
    ]
    rows += [(400 + i, rows[i][1]) for i in range(40)] + [(1000, None), (1001, ""), (1002, " \n ")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(documents(rows, 5)).collect()}
    assert got == repeated_bytes(rows)


def test_a_passage_in_every_text_is_spread(documents, monkeypatch):
    """One leading key in far more rows than a bucket sorts together, over many range partitions."""
    small_blocks(monkeypatch)
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(140))
    rows = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(60, 90))) + passage + str(i) * 20) for i in range(400)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(documents(rows, 8)).collect()}
    assert got == repeated_bytes(rows)


def test_exact(documents):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("ab") * rnd.randint(0, 3) + "tail" * 30) for i in range(200)] + [(300, "same length x"), (301, "same length y")]
    by = defaultdict(list)
    for i, t in rows:
        by[t].append(i)
    groups = exact.exact_groups(documents(rows)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in groups} == {(i, max(by[t]), len(by[t]), i == max(by[t])) for i, t in rows}
    assert sorted(r.doc_id for r in exact.drop_exact(documents(rows)).collect()) == sorted(max(v) for v in by.values())


def test_exact_reads_only_surviving_texts(documents):
    rows = [(1, "aa"), (2, "ab"), (3, "abc"), (4, "aa")]
    got = {r.doc_id: r.digest for r in exact.exact_groups(documents(rows)).collect()}
    digest = hashlib.sha256(b"aa").hexdigest()
    assert got == {1: digest, 2: None, 3: None, 4: digest}


def test_odd_rows(documents):
    docs = documents(ODD)
    groups = exact.exact_groups(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size) for r in groups) == sorted(
        [(False, 1, 2, 2), (False, 2, 2, 2), (False, 3, 3, 1), (False, 4, 7, 3), (False, 5, 5, 1), (True, 0, 6, 2), (False, 6, 6, 2), (False, 7, 7, 3), (False, 8, 8, 1)]
    )
    assert len(exact.drop_exact(docs).collect()) == 6 and exact.drop_exact(docs).columns == docs.columns
    similar = jaccard.similar_groups(docs).collect()
    assert len(similar) == len(ODD)
    assert {r.doc_id: r.component_id for r in similar} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, None: None, 6: None, 7: 4, 8: 8}
    words = substring.remove_repeats(docs).collect()
    assert len(words) == len(ODD) and {r.doc_id: r.n_removed for r in words if r.n_removed} == {5: 29_999}
    left = suffix.remove_repeats(docs).collect()
    assert len(left) == len(ODD) and not any(r.n_removed for r in left)


@pytest.mark.parametrize("apply", [exact.exact_groups, exact.drop_exact, jaccard.similar_groups, jaccard.drop_similar, substring.remove_repeats, suffix.remove_repeats])
def test_empty_table(documents, apply):
    assert apply(documents(ODD).limit(0)).collect() == []


def test_links_within_a_large_set_take_little_memory():
    rnd = np.random.default_rng(1)
    n, base = jaccard.SET_ROWS, rnd.integers(0, 2**63, 60, dtype=np.uint64)
    own = [base[rnd.random(60) < 0.97] for _ in range(n)]
    sizes = np.array([len(x) for x in own])
    tracemalloc.start()
    x, y = jaccard.links_within(sizes, np.concatenate(own), np.repeat(np.arange(n), sizes), np.array([0, n]), np.arange(n), 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(x) == n - 1 and len(np.unique(np.r_[x, y])) == n  # nearly all pairs link: a tree
    assert peak < 60e6  # the counts of all pairs take 17 MB; numbers of each pair do not lie beside them


def test_links_within_sets_match_brute_force(monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 5)
    monkeypatch.setattr(jaccard, "WIDE", 16)
    monkeypatch.setattr(jaccard, "PAIRS", 50)
    rng = np.random.default_rng(6)
    own, edges = [], [0]
    for rows, spread in ((3, 4), (1, 1), (40, 9), (5, 2), (25, 6)):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        for _ in range(rows):
            row = base.copy()
            row[rng.choice(60, rng.integers(0, spread), replace=False)] = rng.integers(0, 2**63, 1)[0]
            own.append(np.unique(row))
        edges.append(len(own))
    component = rng.integers(0, len(own), len(own))
    sizes = np.array([len(x) for x in own])
    x, y = jaccard.links_within(sizes, np.concatenate(own), np.repeat(np.arange(len(own)), sizes), np.array(edges), component, 85)
    links = set()
    for a, b in zip(edges, edges[1:]):
        for i in range(a, b):
            for j in range(i + 1, b):
                common = len(np.intersect1d(own[i], own[j]))
                if component[i] != component[j] and 100 * common >= 85 * (sizes[i] + sizes[j] - common):
                    links.add((i, j))
    found = {(min(i, j), max(i, j)) for i, j in zip(x.tolist(), y.tolist())}
    assert found <= links and len(found) < len(links)
    n = len(own)
    assert np.array_equal(jaccard._joined(*np.array(sorted(found)).T, n), jaccard._joined(*np.array(sorted(links)).T, n))


def test_no_table_of_links_holds_the_pairs_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SET_ROWS", 40)
    monkeypatch.setattr(jaccard, "MANY", 3)
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # about half of the pairs link
        own = list(words)
        for at in rng.choice(60, 1 if i % 3 else 3, replace=False):
            own[at] = f"x{i}-{at}"
        rows.append((i, " ".join(own)))
    want = {r: c for r, c in zip(range(150), brute_components(rows, 4, 85))}
    sent, plain = [], jaccard.open_rows

    def counted(*args):
        rows = table(plain(*args))
        sent.append((rows.filter("component IS NULL").count(), rows.filter("component IS NOT NULL").count()))
        return rows

    monkeypatch.setattr(jaccard, "open_rows", counted)
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == want
    assert len(sent) == 1 and sent[0][0] <= 3 * 150 and 0 < sent[0][1] <= 150


def brute_components(rows, words, percent):
    sets = [{tuple(t.split()[i : i + words]) for i in range(len(t.split()) - words + 1)} for _, t in rows]
    least = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if least[j] < least[i] and 100 * len(a & b) >= percent * len(a | b):
                    least[i], changed = least[j], True
    return least
