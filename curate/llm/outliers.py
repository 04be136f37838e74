"""Quality rules by robust multivariate outliers.

Every text gets plain statistics and two fixed rules. The texts that pass are compared with their own kind: per
language and source, a minimum-covariance-determinant estimate of location and scatter is fitted to transformed
statistics, and a text goes if its Mahalanobis distance is beyond a chi-square quantile.

The estimate takes all rows. A concentration step is one aggregation: rows are binned by distance per group and
each bin keeps its count, sums and cross products; the nearest half is then a prefix of bins, whose sums give the
next mean and covariance. So a group with a third of all rows is combined on the map side to a few hundred bins.
Groups are fitted inside tasks from those bins; none is collected. Small groups are drawn towards the estimate of
all rows.

Defined results: a null text has no words and fails the word rule; null language or source is a group of its own;
repeated rows count as often as they occur and get equal verdicts; statistics without spread are given a floor, so
that ties do not make a covariance singular; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.llm.frames import arrays_of, id_out, plain, table
from curate.llm.words import Hasher, Words, chunks, spaces

#: Fewest words, and largest share of words in repeated 3-word windows (percent).
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
GROUP = ["lang", "source"]
FEATURES = ["x0", "x1", "x2", "x3", "x4"]
#: Least standard deviation of each transformed statistic.
FLOOR = (0.5, 0.25, 0.05, 0.05, 0.13)
#: Squared distance beyond which a text goes: the 1 - 1e-6 quantile of chi-square with 5 degrees of freedom.
CUTOFF = 35.89
#: Share of the rows that the determinant is minimized over, and concentration steps.
HALF, STEPS = 0.5, 4
#: What the covariance of the nearest half of a normal distribution in 5 dimensions is multiplied with: half over the share of
#: chi-square with 7 degrees of freedom below the median of that with 5.
CONSISTENCY = 1.915
#: Weight of the estimate over all rows, in rows.
PRIOR_ROWS = 50
#: Bins per doubling of the squared distance.
FINE = 8
SEED = 17


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the statistics of every row's whole text.

    ``n_words``; ``word_chars``, code points in words; ``n_symbols``; ``n_dup_lines``, lines with a word that equal
    an earlier line; ``n_repeat_words``, words inside 3-word windows that occur twice or more in the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, gap = Hasher(SEED), spaces()
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        for batch in batches:
            parts = []
            for _, _, data, offsets in chunks(batch["text"]):
                words = Words(data, offsets, hasher, gap)
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                symbols = np.concatenate([[0], np.cumsum(symbol[data])])
                chars = np.concatenate([[0], np.cumsum(lead[words.end] - lead[words.start])])
                parts.append((
                    words.count, np.diff(chars[words.first]), np.diff(symbols[offsets]),
                    _dup_lines(data, offsets, words, hasher), _repeat_words(words, hasher),
                ))
            n = [np.concatenate(x).astype(np.int64) for x in zip(*parts)] if parts else [np.empty(0, np.int64)] * 5
            yield arrays_of(
                doc_id=batch["doc_id"], lang=batch["lang"], source=batch["source"],
                n_words=n[0], word_chars=n[1], n_symbols=n[2], n_dup_lines=n[3], n_repeat_words=n[4],
            )

    rows = plain(docs, *[F.col(c).cast("string").alias(c) for c in GROUP])
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return rows.mapInArrow(run, f"doc_id long, lang string, source string, {counts}")


def _dup_lines(data: np.ndarray, offsets: np.ndarray, words: Words, hasher: Hasher) -> np.ndarray:
    n = len(offsets) - 1
    start = np.union1d(offsets[:-1][offsets[:-1] < offsets[1:]], (at := np.flatnonzero(data == 10) + 1)[at < len(data)])
    if not len(start):
        return np.zeros(n, np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(data)), offsets[doc + 1])
    end = end - (data[end - 1] == 10)
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    doc, start, end = doc[has_word], start[has_word], end[has_word]
    key = hasher.spans(hasher.sums(hasher.byte[data]), start, end)
    order = np.lexsort((key, doc))
    again = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])
    return np.bincount(doc[order][1:][again], minlength=n)


def _repeat_words(words: Words, hasher: Hasher) -> np.ndarray:
    n, total = len(words.count), len(words.start)
    at = np.flatnonzero(words.windows(3))
    if not len(at):
        return np.zeros(n, np.int64)
    key, doc = hasher.windows(words.hash, 3)[at], words.text_of_word()
    order = np.lexsort((key, doc[at]))
    same = (key[order][1:] == key[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
    repeated = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
    covered = np.zeros(total, bool)
    for i in range(3):
        covered[repeated + i] = True
    return np.bincount(doc[covered], minlength=n)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def transformed() -> list[Column]:
    """The statistics on scales on which clean texts are about normal."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        c.alias(name)
        for name, c in zip(
            FEATURES,
            [
                F.log(words), F.col("word_chars") / words, F.sqrt(F.col("n_symbols") / words),
                F.sqrt(F.col("n_dup_lines") / words), F.sqrt(F.col("n_repeat_words") / words),
            ],
        )
    ]


def _moments() -> list[Column]:
    sums = [F.sum(x).alias(f"s_{x}") for x in FEATURES]
    return [F.count("*").alias("n"), *sums] + [F.sum(F.col(x) * F.col(y)).alias(f"s_{x}_{y}") for i, x in enumerate(FEATURES) for y in FEATURES[i:]]


def _distance(model_mean: str = "mean", model_inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance, from arrays with the mean and the inverse covariance (row by row)."""
    d = [F.col(x) - F.col(model_mean)[i] for i, x in enumerate(FEATURES)]
    p = len(FEATURES)
    terms = [(1 if i == j else 2) * d[i] * d[j] * F.col(model_inverse)[i * p + j] for i in range(p) for j in range(i, p)]
    return sum(terms[1:], terms[0])


def _joined(rows: DataFrame, model: DataFrame, grouped: bool) -> DataFrame:
    if not grouped:  # one model: its numbers enter as literals
        one = model.first()
        parts = {c: F.array(*[F.lit(v) for v in one[c]]) if one else F.lit(None).cast("array<double>") for c in ("mean", "inverse")}
        return rows.withColumns(parts)
    right = model.withColumnsRenamed({c: f"_{c}" for c in GROUP})
    on = rows["lang"].eqNullSafe(right["_lang"]) & rows["source"].eqNullSafe(right["_source"])
    return rows.join(right, on).drop("_lang", "_source")


def _fit_groups(frames: Iterator[pd.DataFrame], prior: dict | None, share: float, scale: float) -> Iterator[pd.DataFrame]:
    """Means and inverse covariances from the moments per group and distance bin."""
    p = len(FEATURES)
    for bins in frames:
        out = []
        for _, g in bins.groupby("group_key", sort=False):
            g = g.sort_values("bin")
            upto = int(np.searchsorted(np.cumsum(g["n"].to_numpy()), share * g["n"].sum())) + 1
            near = g.iloc[:upto]
            n = float(near["n"].sum())
            mean = np.array([near[f"s_{x}"].sum() for x in FEATURES]) / n
            cov = np.empty((p, p))
            for i, x in enumerate(FEATURES):
                for j, y in enumerate(FEATURES[i:], i):
                    cov[i, j] = cov[j, i] = near[f"s_{x}_{y}"].sum() / n - mean[i] * mean[j]
            cov = cov * scale
            if prior:
                weight = n / (n + PRIOR_ROWS)
                mean = weight * mean + (1 - weight) * np.array(prior["mean"])
                cov = weight * cov + (1 - weight) * np.linalg.inv(np.array(prior["inverse"]).reshape(p, p))
            low = np.maximum(np.array(FLOOR) ** 2 - np.diag(cov), 0.0)
            inverse = np.linalg.inv(cov + np.diag(low) + 1e-9 * np.eye(p))
            out.append({"lang": g["lang"].iloc[0], "source": g["source"].iloc[0], "mean": mean.tolist(), "inverse": inverse.ravel().tolist()})
        if out:
            yield pd.DataFrame(out)


_MODEL = "lang string, source string, mean array<double>, inverse array<double>"


def _fitted(binned: DataFrame, prior: dict | None, share: float, scale: float) -> DataFrame:
    """One model per group. A group's bins, a few hundred rows at most, meet in one task."""
    keyed = binned.withColumn("group_key", F.xxhash64(F.to_json(F.struct(*GROUP))))

    def fit(key, g):
        return next(_fit_groups(iter([g]), prior, share, scale))

    return table(keyed.groupBy("group_key").applyInPandas(fit, _MODEL))


def estimate(rows: DataFrame, prior: dict | None = None, grouped: bool = True) -> DataFrame:
    """``lang, source, mean, inverse`` of each group's minimum-covariance-determinant estimate.

    ``rows`` has the group and the transformed statistics. Starts from medians and quartile ranges. If not
    ``grouped``, all rows are of one group.
    """
    middle = rows.groupBy(*GROUP).agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q_{x}") for x in FEATURES])
    p = len(FEATURES)
    spread = [F.greatest((F.col(f"q_{x}")[2] - F.col(f"q_{x}")[0]) / 1.349, F.lit(FLOOR[i])) for i, x in enumerate(FEATURES)]
    diagonal = [1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(p) for j in range(p)]
    model = table(middle.select(*GROUP, F.array(*[F.col(f"q_{x}")[1] for x in FEATURES]).alias("mean"), F.array(*diagonal).alias("inverse")))
    for _ in range(STEPS):
        bin_of = F.floor(FINE * F.log2(F.greatest(_distance(), F.lit(1e-3)))).cast("int")
        binned = _joined(rows, model, grouped).withColumn("bin", bin_of).groupBy(*GROUP, "bin").agg(*_moments())
        model = _fitted(binned, prior, HALF, CONSISTENCY)
    return model


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, statistics, ``base_failed``, ``distance`` (squared, null where the base rules fail) and ``kept``."""
    stats = table(statistics(docs).withColumn("base_failed", base_failed()))
    rows = stats.filter("not base_failed").select(*GROUP, *transformed())
    over_all = rows.withColumns({c: F.lit("") for c in GROUP})
    everything = estimate(over_all, grouped=False).first()
    models = estimate(rows, everything.asDict() if everything else None)
    left = stats.select("*", *transformed())
    right = models.withColumnsRenamed({c: f"_{c}" for c in GROUP})
    on = left["lang"].eqNullSafe(right["_lang"]) & left["source"].eqNullSafe(right["_source"])
    distance = F.when(~F.col("base_failed"), _distance())
    found = left.join(right, on, "left").withColumn("distance", distance)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance"]
    return found.select(id_out(), *GROUP, *columns, kept.alias("kept"))
