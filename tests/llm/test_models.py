"""Toxicity segments, mixing, the suffix tree, robust outliers, chat folding and packing on small tables."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from curate.llm import blocks, chat, mixing, outliers, packing, suffix_tree, toxicity
from curate.llm.frames import table
from curate.llm.words import Hasher, Words, buffers, spaces
from odd_rows import ODD
from test_repeats import shingle_groups


def best_segments(score):
    """By definition: the best segment, then those left and right of it."""

    def within(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += score[j]
                if total > 0 and (best is None or total > best[2] + 1e-12 or (abs(total - best[2]) < 1e-12 and j + 1 - i < best[1] - best[0])):
                    best = (i, j + 1, total)
        return within(a, best[0]) + [best] + within(best[1], b) if best else []

    return within(0, len(score))


def test_segments():
    rnd = random.Random(0)
    for _ in range(300):
        score = [rnd.choice([-3.1, -1.07, -0.31, 0.53, 1.017, 2.23]) for _ in range(rnd.randint(0, 14))]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(np.array(score))]
        assert got == [(a, b, round(s, 6)) for a, b, s in best_segments(score)]


def toxic_table(spark, documents):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    rows = []
    for i in range(400):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 200))]
        if i % 4 == 0:
            text[5:8] = ["scoundrel", "villain", "scoundrel"]
        rows.append((i, " ".join(text)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(400)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, score string")
    return documents([*rows, *[(1000 + (r[0] or 0), *r[1:]) for r in ODD]]), labels, rows


def test_toxicity(spark, documents):
    docs, labels, rows = toxic_table(spark, documents)
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    got = {r.doc_id: r for r in toxicity.score_texts(docs, model).collect()}
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i in range(400))
    for i in range(0, 400, 4):
        text = rows[i][1].encode()
        passage = got[i].passages[0]
        assert b"villain" in text[passage.start : passage.end] and passage.expected <= toxicity.MAX_EXPECTED
    assert all(0 <= got[1000 + (r[0] or 0)].score < 0.5 for r in ODD)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 300 + len(ODD)


def test_late_passage_of_a_long_text_is_found(spark, documents):
    docs, labels, rows = toxic_table(spark, documents)
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    plain = " ".join(rows[i][1] for i in range(1, 100) if i % 4)
    passage = "villain scoundrel villain scoundrel"
    text = " ".join([plain, "villain", plain, "scoundrel", plain] * 4 + [passage])
    row = toxicity.score_texts(documents([(1, text)]), model).first()
    start = len(text) - len(passage)
    assert any(p.start <= start and p.end == len(text) for p in row.passages)


def test_calibration_does_not_follow_the_order_of_the_sample(spark, documents):
    _, _, rows = toxic_table(spark, documents)
    first = [i for i in range(4000) if int(hashlib.md5(f"toxic{i}".encode()).hexdigest()[:4], 16) % toxicity.CALIBRATE == 0][:400]
    labels = spark.createDataFrame([(i, int(n % 4 == 0)) for n, i in enumerate(first)], "doc_id long, toxic int")
    docs = documents([(i, text) for i, (_, text) in zip(first, rows)])
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, toxicity.fit(docs, labels)).collect()}
    assert all((got[i] >= 0.5) == (n % 4 == 0) for n, i in enumerate(first))


def test_tail_of_dependent_scores():
    rng = np.random.default_rng(3)
    tokens = rng.integers(50, 2000, 4000).astype(float)
    # Extreme values with a lower rate than independent tokens would have (0.9), as where neighbours depend on each other.
    best = np.maximum((np.log(0.05 * tokens) + rng.gumbel(size=4000)) / 0.5, 0.0)
    rate, log_k = toxicity.tail(best, tokens, 0.9)
    assert abs(rate - 0.5) < 0.06
    expected = np.exp(log_k + np.log(tokens) - rate * best)
    assert 0.004 < (expected <= 0.01).mean() < 0.02  # as many false passages as promised
    assert toxicity.tail(best[:50], tokens[:50], 0.9)[0] == 0.9


def test_toxicity_without_labels(spark, documents):
    docs, labels, _ = toxic_table(spark, documents)
    model = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_texts(docs, model).collect()} == {0.0}
    assert toxicity.score_texts(docs.limit(0), model).collect() == []


def shares(sizes, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 3 * sizes[s] <= level * weight[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        left, free = left - sum(3 * sizes[s] for s in over), free - over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mixing(documents, seed):
    rnd = random.Random(seed)
    rows = [(i, "w " * rnd.choice([0, 1, 5, 40, 300]), "en", rnd.choice(["src1", "src0", "é", "z", None, "tiny"][: 3 + seed])) for i in range(300)]
    rows += [(500, "w " * 4000, "en", "src0"), (500, "w " * 4000, "en", "src0"), (501, None, "en", "only empty"), (None, "w w", "en", "src0")]
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want, taken = shares(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)


def test_taking(documents):
    docs = documents([(i, "w " * 10, "en", f"src{i % 3}") for i in range(300)])
    assert mixing.take(docs).columns == docs.columns
    per = {r.source: r["count"] for r in mixing.take(docs).groupBy("source").count().collect()}
    assert per == {"src0": 50, "src1": 100, "src2": 150}


def test_suffix_tree_sums_to_one():
    rnd = random.Random(4)
    # Token hashes 1..30 in documents; grams counted here, the tree built by the library.
    texts = [[rnd.randint(1, 6) if rnd.random() < 0.6 else rnd.randint(1, 30) for _ in range(rnd.randint(1, 30))] for _ in range(300)]
    for t in texts[::2]:
        t += [1, 2, 3, 4, 5, 6]
    count = {}
    for t in texts:
        for n in range(1, 5):
            for i in range(len(t) - n + 1):
                count[tuple(t[i : i + n])] = count.get(tuple(t[i : i + n]), 0) + 1
    often = {g: c for g, c in count.items() if c >= 3}
    levels, ids = [], {}
    for n in range(1, 5):
        grams = [g for g in often if len(g) == n]
        keys = [g[0] if n == 1 else (ids[g[:-1]] << 32) | ids[g[-1:]] for g in grams]
        level = suffix_tree.Level(np.array(keys, np.uint64), np.array([often[g] for g in grams], np.int64))
        ids |= {g: int(np.searchsorted(level.keys, k)) for g, k in zip(grams, keys)}
        levels.append(level)
    total, distinct = sum(map(len, texts)), len({w for t in texts for w in t})
    suffix_tree.build(levels, total, distinct)
    scale = total + 0.5 * (distinct + 1)

    def prob(context, word):
        p = (count.get((word,), 0) + 0.5) / scale
        for n in range(1, 4):
            s = context[-n:]
            if len(s) < n or s not in ids:
                break
            g = s + (word,)
            p = levels[n].prob[ids[g]] if g in ids else levels[n - 1].share[ids[s]] * p
        return p

    kept = [sum(level.share < 1) for level in levels]
    assert kept[0] and kept[1]
    for context in [(), (1,), (2,), (1, 2), (1, 2, 3), (9, 1), (30, 30, 30), (2, 3, 4)]:
        assert math.isclose(sum(prob(context, w) for w in range(1, 32)), 1.0, rel_tol=1e-9)  # 31 stands for all unknown


def test_suffix_tree_scores(documents, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 5000)
    rnd = random.Random(6)
    phrase = "the quick brown fox jumps over the lazy dog"
    rows = [(i, " ".join(rnd.choice([phrase, "Alpha", "beta", "gamma"]) for _ in range(rnd.randint(1, 30)))) for i in range(300)]
    got = suffix_tree.fit_and_score(documents([*rows, *[(1000 + (r[0] or 0), *r[1:]) for r in ODD]])).collect()
    assert len(got) == 300 + len(ODD)
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)  # logarithms: nearer to 0 is likelier
    assert all(r.score <= 0 for r in got)
    assert suffix_tree.fit_and_score(documents(ODD).limit(0)).collect() == []


def test_suffix_tree_moves_no_texts(spark, documents, monkeypatch):
    plans, write, before = [], suffix_tree.materialize, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(suffix_tree, "materialize", lambda rows, path: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(rows, path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tables = {t.name for t in spark.catalog.listTables()}
    try:
        assert suffix_tree.fit_and_score(documents([(i, "one two three four") for i in range(20)])).count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Blocks meet their answers where both lie.
    assert plans[0].count("SortMergeJoin") == suffix_tree.DEPTH + 2 and "Exchange" not in plans[0]
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_suffix_tree_sends_nothing_for_rare_grams():
    keys = np.array([5, 2**40, 2**63], np.uint64)
    row = {"bucket": 0, "keys": suffix_tree._pack(keys, True)}
    rows = pa.Table.from_pylist([row | {"block": i, "counts": suffix_tree._pack(np.array([i, 1, 0]))} for i in range(2)])
    values = [suffix_tree._unpack(x, np.int64).tolist() for x in suffix_tree._count(rows, 2, 0)["counts"].to_pylist()]
    assert values == [[0, 5, 0], [0, 4, 0]]  # only the second occurs twice


def tree_scores(texts, held):
    """log10 probability of every text by definition, from all grams that occur twice in those that train."""
    count, known = {}, [[*t.lower().split(), None] for t in texts]
    for ws in (w for w, h in zip(known, held) if not h):
        for n in range(1, suffix_tree.DEPTH + 2):
            for i in range(len(ws) - n + 1):
                count[tuple(ws[i : i + n])] = count.get(tuple(ws[i : i + n]), 0) + 1
    total, distinct = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)
    follow = {}
    for g, c in count.items():
        if len(g) > 1 and c >= 2:
            follow.setdefault(g[:-1], {})[g[-1]] = c
    shares = {(): None}

    def prob(context, word):
        if not context:
            return (count.get((word,), 0) + 0.5) / (total + 0.5 * (distinct + 1))
        other = prob(context[1:], word)
        share = leaves(context)
        if share is None:
            return other
        listed = follow[context]
        return listed.get(word, 0) / (count[context] + len(listed)) + share * other

    def leaves(context):
        if context not in shares:
            listed, shares[context] = follow.get(context), None
            if listed:
                whole = count[context] + len(listed)
                share, left, gain = (whole - sum(listed.values())) / whole, 1.0, 0.0
                for w, c in listed.items():
                    other = prob(context[1:], w)
                    own = c / whole + share * other
                    left, gain = left - other, gain + own * math.log(own / other)
                gain += share * max(left, 1e-12) * math.log(share) if share else 0.0
                if count[context] * gain > suffix_tree.GAIN + suffix_tree.GAIN_PER_ENTRY * len(listed):
                    shares[context] = share
        return shares[context]

    depth = suffix_tree.DEPTH
    return [sum(math.log10(prob(tuple(ws[max(0, i - depth) : i]), w)) for i, w in enumerate(ws)) for ws in known]


@pytest.mark.parametrize("more", [0, 1_200_000])
def test_rare_contexts_count_at_any_size(documents, monkeypatch, more):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 5000 if not more else 500_000)
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice(["red green blue", "Red green", "sun", "moon stone", f"w{rnd.randint(0, 99)}"]) for _ in range(rnd.randint(0, 40))) for _ in range(150)]
    texts += ["once only twice seen phrase"] * 6 + ["", "w1 " * more]  # the last trains
    rows = list(enumerate(texts))
    learns = lambda ids: ids % 5 != 1
    got = {r.doc_id: r for r in suffix_tree.fit_and_score(documents(rows), learns).collect()}
    want = tree_scores(texts, [i % 5 == 1 for i in range(len(texts))])
    for i, score in enumerate(want):
        assert got[i].held_out == (i % 5 == 1) and math.isclose(got[i].score, score, rel_tol=1e-9)
    # One of the six is held out: its phrase is known however small a part of the tokens it is.
    assert got[151].held_out and got[151].score > 0.6 * got[151].base_score


def smallest_determinant(x, starts=60, steps=15):
    """Mean and corrected covariance of the half with the smallest determinant, from many random starts."""
    rng, half, best = np.random.default_rng(0), len(x) // 2 + 1, None
    for _ in range(starts):
        rows = rng.choice(len(x), x.shape[1] + 1, replace=False)
        for _ in range(steps):
            mean, cov = x[rows].mean(0), np.cov(x[rows].T, bias=True) + 1e-6 * np.eye(x.shape[1])
            rows = np.argsort(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean))[:half]
        mean, cov = x[rows].mean(0), np.cov(x[rows].T, bias=True)
        if best is None or np.linalg.det(cov) < best[0]:
            best = np.linalg.det(cov), mean, cov
    return best[1], best[2] * outliers.CONSISTENCY


def test_estimate_against_many_starts(spark):
    rng = np.random.default_rng(2)
    mix = np.array([[2.0, 0.5, 0, 0, 0], [0, 1.0, 0.2, 0, 0.3], [0, 0, 0.5, 0.1, 0], [0, 0, 0, 0.4, 0.2], [0, 0, 0, 0, 0.6]])
    x = np.concatenate([rng.normal(size=(900, 5)) @ mix, 8 + rng.normal(size=(60, 5))])
    mean, cov = smallest_determinant(x)
    rows = spark.createDataFrame([("en", "s", *map(float, r)) for r in x], "lang string, source string, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = outliers.estimate(rows, grouped=False).first()
    far = lambda m, inverse: np.einsum("ij,jk,ik->i", x - m, inverse, x - m)
    mine, true = far(np.array(got["mean"]), np.array(got["inverse"]).reshape(5, 5)), far(mean, np.linalg.inv(cov))
    assert ((mine > outliers.CUTOFF) == (true > outliers.CUTOFF)).mean() > 0.99 and (mine[900:] > outliers.CUTOFF).all()
    assert abs(np.median(mine / true) - 1) < 0.1
    assert abs(np.median(mine[:900]) - 4.35) < 0.5  # the median of chi-square with 5 degrees of freedom


def test_outliers(documents):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9)))
    rows = [(i, " ".join(word() for _ in range(rnd.randint(100, 400))), rnd.choice(["en", "fr"]), rnd.choice(["s0", "s0", "s1"])) for i in range(400)]
    rows += [(1000 + i, " ".join(word() + "$$$" for _ in range(200)), "en", "s0") for i in range(20)]
    rows += [(2000 + i, " ".join("x" for _ in range(200)), "en", "s0") for i in range(5)]
    got = {r.doc_id: r for r in outliers.judge(documents([*rows, *[(3000 + (r[0] or 0), *r[1:]) for r in ODD]])).collect()}
    assert sum(got[i].kept for i in range(400)) >= 398
    assert not any(got[1000 + i].kept for i in range(20)) and not any(got[1000 + i].base_failed for i in range(20))
    assert all(got[2000 + i].base_failed for i in range(5))
    assert not any(got[3000 + (r[0] or 0)].kept for r in ODD)
    assert outliers.judge(documents(rows).limit(0)).collect() == []


def test_ties_do_not_break_the_covariance(documents):
    same = "a few plain words that say nothing at all " * 1
    text = " ".join(f"{same} {i}" for i in range(12))
    got = outliers.judge(documents([(i, text, "en", "s") for i in range(60)])).collect()
    assert len({(r.distance, r.kept) for r in got}) == 1


def folded(events):
    """Event by event, in order of sequence."""
    convs = {}
    for conv, seq, kind, message, role, text in sorted(events, key=lambda e: (e[0], e[1])):
        state = convs.setdefault(conv, {})
        key = message if message is not None else ("row", seq)
        if key not in state:
            state[key] = [seq, role, "", True]
        m = state[key]
        m[1] = role if role is not None else m[1]
        if kind == "delete":
            m[3] = False
        elif kind == "regenerate":
            m[2], m[3] = "", True
        elif kind == "delta":
            m[2] += (text or "") if m[3] else ""
        else:
            m[2], m[3] = text or "", True
    return {c: [(r or "", t) for _, r, t, live in sorted(s.values(), key=lambda m: m[0]) if live] for c, s in convs.items()}


def test_chat_events(spark):
    rnd, events = random.Random(3), []
    for conv in range(30):
        seq = 0
        for message in range(rnd.randint(1, 6)):
            role = rnd.choice(["user", "assistant"])
            for kind in rnd.choice([["message"], ["delta"] * 4, ["message", "edit"], ["delta", "delta", "regenerate", "delta"], ["message", "delete"]]):
                text = rnd.choice(["a", "</s>", "<|im_end|>", "[/INST] b", "\\", "<\\|im_start|>", "é\n", ""])
                events.append((conv, seq, kind, message, role, None if kind in ("regenerate", "delete") else text))
                seq += 1
        events.append((conv, seq, "message", None, "system", "end"))
    frame = spark.createDataFrame(events, "conv_id long, seq long, kind string, message_id long, role string, text string").repartition(4)
    turns = chat.render(chat.fold_events(frame))
    got = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.position)):
        assert not any(m in r.formatted[len(chat.START) : -len(chat.END)] for m in chat.CONTROL)
        got.setdefault(r.conv_id, []).append(chat.read_turn(r.formatted))
    assert got == folded(events)


def test_chat_events_without_message_id(spark):
    kinds = ["message", "edit", "delta", "regenerate", "delete", None, "delta"]
    events = [(1, seq, kind, None, "user", f"t{seq}") for seq, kind in enumerate(kinds)]
    frame = spark.createDataFrame(events, "conv_id long, seq long, kind string, message_id long, role string, text string")
    got = sorted((r.position, r.role, r.text) for r in chat.fold_events(frame).collect())
    assert [(role, text) for _, role, text in got] == folded(events)[1]
    assert [text for _, _, text in got] == ["t0", "t1", "t2", "", "t5", "t6"]


def test_a_table_of_turns_is_folded_from_its_events(spark):
    rnd = random.Random(6)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["", "x", "é" * 300, "word </s> " * 40, "[INST] a " * 4000])) for c in range(40) for t in range(3)]
    log = chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    kinds = {r.kind: r.n for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["message"] == len(rows) and kinds["regenerate"] > 10 and kinds["edit"] > 10 and kinds["delta"] > 500
    assert log.groupBy("message_id", "part").count().filter("count > 1").count() > 100  # delivered twice
    folded_rows = chat.fold_events(log)
    assert "Aggregate" in folded_rows._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(((r.conv_id, r.position, r.role, r.text) for r in folded_rows.collect()), key=str)
    assert got == sorted(rows, key=str)


def test_chat_odd_rows(spark):
    rows = [(None, None, None, None), (-8, 0, "a\nb\\<s>", None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 0, "assistant", "<\\\\s> 漢 " * 5000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.render(chat.fold_events(chat.from_turns(frame)))).collect()}
    assert got[1].n_turns == 2 and got[None].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert got[-8].turns_sha256 == hashlib.sha256(b"a\nb\\<s>\n\n").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(rows[-1][3].encode()).hexdigest() and got[2].loss_chars == len(rows[-1][3])
    assert chat.digests(chat.render(chat.fold_events(chat.from_turns(frame.limit(0))))).collect() == []


def test_encoder_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    rnd = random.Random(1)
    odd = ["", " ", "  a", " a", "a ", "a  b", "a \n b", "a\n\n b", "\n a\n", "x  y", " 　z", "don't 's it's", "<|endoftext|> a <|endoftext|>", "a\t b"]
    odd += ["é ß  ", " <|endoftext|>b c", "a\x1c b \x1cd", "a b\n", "tab\t\tb", "“quoted” “text”", "漢字 かな", "a  b  c"]
    odd += ["".join(rnd.choice("ab é\n\t.,'1$  ") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    ids, counts = encoder.encode(*buffers(pa.array(odd)))
    ends = np.cumsum(counts)
    for text, a, b in zip(odd, ends - counts, ends):
        assert ids[a:b].tolist() == [*model.encode(text, add_special_tokens=False).ids, 0]


def test_cuts_are_best():
    rnd, window = random.Random(1), 32
    for _ in range(150):
        total = rnd.randint(1, 120)
        docs = sorted(set(rnd.sample(range(1, total + 1), min(total, rnd.randint(1, 6)))) | {total})
        sentences = sorted(rnd.sample(range(1, total + 1), min(total, rnd.randint(0, 12))))
        places, cost = packing.cut_points(total, np.array(docs), np.array(sentences, int), window)
        pad = lambda n: 0 if n & (n - 1) == 0 else window - n
        best = [0] + [10**9] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                if places[j] - places[i] <= window:
                    best[j] = min(best[j], best[i] + pad(int(places[j] - places[i])) + cost[j] + packing.WINDOW_COST)
        value, at = 0, 0
        for end in packing.best_cuts(places, cost, window).tolist():
            value += pad(end - at) + cost[places.tolist().index(end)] + packing.WINDOW_COST
            at = end
        assert at == total and value == best[-1]


def test_packing_odd_rows(documents):
    rows = packing.pack(documents(ODD), public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert all(len(r.ids) == r.length for r in rows)
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 4)
    assert packing.pack(documents(ODD).limit(0), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_words():
    texts = ["Hello  wörld\tfoo\n bar ", "", " x ", "Hello wörld foo bar", " "]
    data, offsets = buffers(pa.array(texts))
    words = Words(data, offsets, Hasher(1), spaces())
    assert [data[a:b].tobytes().decode() for a, b in zip(words.start, words.end)] == ["Hello", "wörld", "foo", "bar", "x", "Hello", "wörld", "foo", "bar", " "]
    assert words.count.tolist() == [4, 0, 1, 4, 1] and (words.hash[:4] == words.hash[5:9]).all()


def test_pipeline(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "packing"]
    toxic = spark.read.parquet(f"{tables}/labels.parquet").filter("toxic = 1")
    kept = corpus_pipeline.drop_toxic(spark, docs, tables)
    assert kept.columns == docs.columns and docs.count() > kept.count() > 0.8 * docs.count()
    assert kept.join(toxic, "doc_id").count() < 0.6 * toxic.count()
    result = corpus_pipeline.run(spark, tables)
    assert result.filter(F.size("ids") != F.col("length")).count() == 0 and result.count() > 0


def test_each_stage_of_the_pipeline(spark):
    """Every stage on what the one before it kept, against what it should keep."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)

    def kept(name, given):
        out = table(stage[name](spark, given, folder))
        assert out.columns == docs.columns or name == "packing"
        return out, sorted(r.doc_id for r in out.collect())

    text = lambda rows: {r.doc_id: r.text or "" for r in rows.collect()}
    clean, ids = kept("toxicity", docs)
    scores = toxicity.score_texts(docs, toxicity.fit(docs, labels, ~toxicity.held_out())).collect()
    assert ids == sorted(r.doc_id for r in scores if r.score < 0.5)

    single, ids = kept("exact_dedup", clean)
    last = {}
    for i, t in sorted(text(clean).items()):
        last[t] = i
    assert ids == sorted(last.values())

    apart, ids = kept("ngram_jaccard", single)
    assert ids == sorted({c for _, c in shingle_groups(list(text(single).items()), 5, 80).values()})

    mixed, ids = kept("mixing", apart)
    plan = mixing.mix(apart).collect()
    assert ids == sorted(r.doc_id for r in plan for _ in range(r.passes + (0 < r.extra and 2 * r.extra >= r.size)))

    packed = stage["packing"](spark, mixed, folder).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {i: [*model.encode(t, add_special_tokens=False).ids, 0] for i, t in text(mixed).items()}
    assert sum(r.length for r in packed) == sum(len(whole[i]) for i in ids)
    assert all(r.ids == whole[r.doc_id][r.start : r.start + r.length] for r in packed)
