"""Toxicity by maximum-scoring segments.

Each token scores its log-odds between toxic and clean documents (counted once per document) with an
informative Dirichlet prior in proportion to the token's frequency; tokens
without significant evidence score a small negative drift. A linear-time scan finds every maximal-scoring
segment of a text. Scores of segments in clean text follow an extreme-value law, P(S > x) = 1 - exp(-K n e^(-lambda x)):
lambda solves sum p(s) e^(lambda s) = 1 over clean tokens and K is fitted on clean documents. A document's
normalized segment scores, lambda S - ln(K n), are aggregated and calibrated to a probability.

Learning takes a bounded sample of labelled rows (``MAX_LABELLED`` per class, chosen by md5 of the id): their ids
are broadcast, so texts are not shuffled. Tokens are hashed to ``DIMS`` buckets, which bounds the model to a few
megabytes whatever the vocabulary. Scoring is a map over the table.

Defined results: null texts count as empty and get the score of a text without segments; labels with null id or
null value are ignored and of repeated labels the largest counts; a null id is never held out nor learned from;
repeated rows get equal scores; without labels of both classes every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.llm.frames import arrays_of, id_out, plain, release_memory
from curate.llm.words import Hasher, Words, chunks, lower_ascii

#: Labelled documents per class that the model is fitted on at most.
MAX_LABELLED = 12_000
#: Hash buckets of the vocabulary.
DIMS = 1 << 18
#: Weight of the prior as a share of all counts; least |z| of a token that counts; score of other tokens.
PRIOR, MIN_Z, DRIFT = 0.1, 2.6, -0.3
#: Expected number of equally good segments in clean text below which a segment counts as significant.
MAX_EXPECTED = 0.01
#: The part of the labelled documents kept out of the counts to fit K and the calibration: one in.
CALIBRATE = 4
#: Share of the clean texts of that part whose best segments give lambda and K, and the fewest that do.
TAIL, LEAST_BEYOND = 0.1, 30
#: Occurrences of one token that count in a run of so many tokens of a text.
MAX_REPEATS, NEAR = 3, 100
SEED = 5


def token_gaps() -> np.ndarray:
    """Separators of tokens: ASCII other than letters and digits."""
    gap = np.zeros(256, bool)
    gap[:128] = [not chr(b).isalnum() for b in range(128)]
    return gap


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(labels: DataFrame, allowed: Column, bound: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, toxic, place`` of at most ``bound`` documents per class; ``place`` is their rank by hash."""
    known = labels.filter(allowed).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.withColumn("place", F.md5(F.concat(F.lit("toxic"), F.col("doc_id").cast("string"))))
    one = [known.filter(F.col("toxic") == c).orderBy("place", "doc_id").limit(bound) for c in (0, 1)]
    return one[0].unionByName(one[1])


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, one past the last, score), by Ruzzo and Tompa's scan.

    Only runs of positive tokens are visited; sums over the negative stretches come from prefix sums.
    """
    positive = score > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], positive, [False]]).astype(np.int8)))
    if not len(edges):
        return []
    total = np.concatenate([[0.0], np.cumsum(score, dtype=np.float64)])
    begin, end = edges[::2].tolist(), edges[1::2].tolist()
    low, high = total[edges[::2]].tolist(), total[edges[1::2]].tolist()
    kept: list[tuple[int, int, float, float]] = []
    for a, b, left, right in zip(begin, end, low, high):
        while True:
            j = len(kept) - 1
            held = []
            while j >= 0 and kept[j][2] >= left:
                held.append(j)
                j -= 1
            if j < 0 or kept[j][3] >= right:
                kept.append((a, b, left, right))
                break
            a, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, right - left) for a, b, left, right in kept]


@dataclass
class ToxicityModel:
    """Token scores by hash bucket, extreme-value parameters, calibration."""

    score: np.ndarray = field(default_factory=lambda: np.zeros(DIMS, np.float32))
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    weights: tuple[float, ...] = ()

    def normal(self, found: list[tuple[int, int, float]], tokens: int) -> np.ndarray:
        return np.array([self.rate * s for _, _, s in found]) - self.log_k - math.log(max(tokens, 1))

    def features(self, found: list[tuple[int, int, float]], tokens: int) -> tuple[float, float]:
        """The best normalized segment score, and the sum of all that are above chance."""
        if not found:
            return -3.0, 0.0
        values = self.normal(found, tokens)
        return float(np.clip(values.max(), -3.0, 30.0)), float(min(np.maximum(values, 0.0).sum(), 60.0))

    def probability(self, features: tuple[float, float]) -> float:
        if not self.weights:
            return 0.0
        x = self.weights[0] + self.weights[1] * features[0] + self.weights[2] * features[1]
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, x))))


def scored(score: np.ndarray, bucket: np.ndarray, words: Words) -> np.ndarray:
    """The score of each token; a positive token with ``MAX_REPEATS`` equal ones among the ``NEAR`` before scores the drift.

    Repeats are damped only where they stand close together, so a passage scores the same wherever in a text it stands.
    """
    out = score[bucket]
    at = np.flatnonzero(out > 0)
    if len(at):
        kind = words.text_of_word()[at] * DIMS + bucket[at]
        order = np.argsort(kind, kind="stable")
        kind, place = kind[order], at[order]
        again = np.zeros(len(at), bool)
        again[MAX_REPEATS:] = (kind[MAX_REPEATS:] == kind[:-MAX_REPEATS]) & (place[MAX_REPEATS:] - place[:-MAX_REPEATS] < NEAR)
        out[place[again]] = DRIFT
    return out


def _tokens(texts: pa.Array, hasher: Hasher) -> Iterator[tuple[int, np.ndarray, Words]]:
    """(index of the first text, hash bucket of each token, words) of runs of texts."""
    gap, low = token_gaps(), lower_ascii()
    for first, _, data, offsets in chunks(texts):
        words = Words(data, offsets, hasher, gap, low)
        yield first, (words.hash & np.uint64(DIMS - 1)).astype(np.int64), words
    release_memory()


def _count(labelled: DataFrame) -> DataFrame:
    """``bucket, toxic, clean``: labelled documents that have a token of the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = Hasher(SEED), np.zeros((2, DIMS), np.int64)
        for batch in batches:
            toxic = batch["toxic"].to_numpy(zero_copy_only=False)
            for first, bucket, words in _tokens(batch["text"], hasher):
                once = np.unique(words.text_of_word() * DIMS + bucket)
                kind = toxic[first : first + len(words.count)][once // DIMS]
                for c in (0, 1):
                    counts[c] += np.bincount(once[kind == c] % DIMS, minlength=DIMS)
        at = np.flatnonzero(counts.sum(0))
        if len(at):
            yield arrays_of(bucket=at, toxic=counts[1][at], clean=counts[0][at])

    rows = labelled.mapInArrow(run, "bucket long, toxic long, clean long")
    return rows.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def token_scores(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Log-odds with an informative Dirichlet prior where significant, the drift elsewhere."""
    both = toxic + clean
    prior = PRIOR * both
    a, b = toxic + prior, clean + prior
    rest_a, rest_b = a.sum() - a, b.sum() - b
    with np.errstate(divide="ignore", invalid="ignore"):
        delta = np.log(a / rest_a) - np.log(b / rest_b)
        z = delta / np.sqrt(1 / a + 1 / b)
    return np.where((both > 0) & (np.abs(z) >= MIN_Z) & np.isfinite(delta), delta + DRIFT, DRIFT).astype(np.float32)


def extreme_rate(score: np.ndarray, weight: np.ndarray) -> float:
    """The positive lambda with sum p(s) e^(lambda s) = 1 under clean token frequencies."""
    p = weight / max(weight.sum(), 1)
    if not (p[score > 0].sum() > 0 and (p * score).sum() < 0):
        return 1.0
    low, high = 0.0, 1.0
    moment = lambda x: float((p * np.exp(np.minimum(x * score.astype(np.float64), 700.0))).sum()) - 1.0
    while moment(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 0 else (low, middle)
    return high


def tail(best: np.ndarray, tokens: np.ndarray, rate: float) -> tuple[float, float]:
    """lambda and log K of the best segments of clean texts, from those beyond a high level.

    Beyond it, the excess of an extreme value is exponential with rate lambda, and K follows from how many texts reach the level.
    Neighbouring tokens depend on each other, so lambda may come out lower than ``rate``, that of independent ones, but not higher. With too
    few texts beyond the level, ``rate`` stays.
    """
    level = float(np.quantile(best, 1 - TAIL))
    beyond = best[best > level]
    if len(beyond) < LEAST_BEYOND:
        reached, expected = len(best), float((tokens * np.exp(-rate * best)).sum())
    else:
        rate = min(rate, 1.0 / max(float((beyond - level).mean()), 1e-9))
        reached, expected = len(beyond), float((tokens * np.exp(-rate * level)).sum())
    return rate, math.log(max(reached / max(expected, 1e-9), 1e-9))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton steps for a logistic regression with an intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, bound: int = MAX_LABELLED) -> ToxicityModel:
    """A model from the labelled documents that ``allowed`` (a condition on ``doc_id``) admits."""
    sample = labelled_sample(labels, F.lit(True) if allowed is None else allowed, bound)
    # Other digits than those that order the sample: with many labels its first ones are all alike.
    calibrate = F.conv(F.substring("place", -4, 4), 16, 10).cast("int") % CALIBRATE == 0
    # At most 2 * bound rows: small by construction.
    labelled = plain(docs).join(F.broadcast(sample.select("doc_id", "toxic", calibrate.alias("calibrate"))), "doc_id")
    counts = _count(labelled.filter("not calibrate").select("text", "toxic")).collect()  # at most DIMS rows
    toxic, clean = np.zeros(DIMS), np.zeros(DIMS)
    for r in counts:
        toxic[r.bucket], clean[r.bucket] = r.toxic, r.clean
    if not toxic.sum() or not clean.sum():
        return ToxicityModel(np.full(DIMS, DRIFT, np.float32))
    model = ToxicityModel(token_scores(toxic, clean))
    model.rate = extreme_rate(model.score, clean)
    rows = _best(labelled.filter("calibrate").select("doc_id", "text", "toxic"), model).collect()  # at most 2 * bound rows
    clean_rows = [r for r in rows if not r.toxic and r.n_tokens]
    if clean_rows:
        best, tokens = np.array([max([0.0, *r.scores]) for r in clean_rows]), np.array([float(r.n_tokens) for r in clean_rows])
        model.rate, model.log_k = tail(best, tokens, model.rate)
    if rows and len({r.toxic for r in rows}) == 2:
        x = np.array([model.features([(0, 0, s) for s in r.scores], r.n_tokens) for r in rows])
        model.weights = logistic(x, np.array([float(r.toxic) for r in rows]))
    else:
        model.weights = (0.0, 1.0, 0.0)
    return model


def _best(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SEED)
        for batch in batches:
            n_tokens, scores = [], []
            for _, bucket, words in _tokens(batch["text"], hasher):
                score = scored(model.score, bucket, words)
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                    n_tokens.append(b - a)
                    scores.append([s for _, _, s in segments(score[a:b])])
            yield arrays_of(toxic=batch["toxic"], n_tokens=pa.array(n_tokens, pa.int64()), scores=pa.array(scores, pa.list_(pa.float64())))

    return rows.mapInArrow(run, "toxic int, n_tokens long, scores array<double>")


def score_texts(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, passages`` of every row.

    ``passages`` holds the significant segments: start and end in bytes of the UTF-8 text, raw score, and the
    number of segments as good expected in clean text of that length.
    """
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SEED)
        for batch in batches:
            probability, passages = [], []
            for _, bucket, words in _tokens(batch["text"], hasher):
                score, first = scored(model.score, bucket, words), words.first
                busy = np.diff(np.concatenate([[0], np.cumsum(score > 0)])[first])
                base = words.offsets.tolist()
                for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    found = segments(score[a:b]) if busy[d] else []
                    probability.append(model.probability(model.features(found, b - a)))
                    expected = np.exp(-model.normal(found, b - a)) if found else []
                    passages.append([
                        {"start": int(words.start[a + i] - base[d]), "end": int(words.end[a + j - 1] - base[d]), "score": s, "expected": float(e)}
                        for (i, j, s), e in zip(found, expected) if e <= MAX_EXPECTED
                    ])
            yield arrays_of(doc_id=batch["doc_id"], score=pa.array(probability, pa.float64()), passages=pa.array(passages, pa.list_(passage)))

    schema = "doc_id long, score double, passages array<struct<start: long, end: long, score: double, expected: double>>"
    return plain(docs).mapInArrow(run, schema).withColumn("doc_id", id_out())



def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SEED)
        for batch in batches:
            clean = []
            for _, bucket, words in _tokens(pc.fill_null(batch["text"], ""), hasher):
                score = scored(model.score, bucket, words)
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                    clean.append(model.probability(model.features(segments(score[a:b]), b - a)) < threshold)
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
