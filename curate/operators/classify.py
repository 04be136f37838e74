"""Small quality classifiers: train, evaluate, choose a threshold, score, report, sweep."""

from __future__ import annotations

import itertools
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, FeatureHasher, HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.operators.ordering import running_totals
from curate.operators.stats import describe, value_counts
from curate.session import materialize


def quality_stages(
    label: str, categories: Sequence[str], weight: str | None, n_features: int, reg: float, max_iter: int
) -> tuple[list, Pipeline]:
    """Hashing of words and categories (needs no fit), then the fitted rest up to a logistic regression."""
    hashing = [HashingTF(inputCol="_words", outputCol="_tf", numFeatures=n_features)]
    inputs = ["_tfidf"]
    if categories:
        hashing.append(FeatureHasher(inputCols=list(categories), outputCol="_categories", numFeatures=1 << 12))
        inputs.append("_categories")
    model = LogisticRegression(
        featuresCol="_features", labelCol=label, regParam=reg, maxIter=max_iter,
        probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw",
    )
    if weight:
        model = model.setWeightCol(weight)
    idf = IDF(inputCol="_tf", outputCol="_tfidf")
    return hashing, Pipeline(stages=[idf, VectorAssembler(inputCols=inputs, outputCol="_features"), model])


def _words_of(text: str) -> Column:
    # Native splitting is several times faster than the tokenizer stages of the ML library.
    return F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+").alias("_words")


def balanced_weights(rows: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weight each class by the inverse of its share.

    The counts, one per class, enter as one scalar, so the rows are not shuffled on the label.
    """
    counts = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.struct(F.sum("_n").alias("n"), F.map_from_entries(F.collect_list(F.struct(label, "_n"))).alias("of"))).scalar()
    size = F.try_element_at(totals.getField("of"), F.col(label))
    return rows.filter(F.col(label).isNotNull()).withColumn(name, totals.getField("n") / (F.size(totals.getField("of")) * size))


def train_quality_filter(
    train: DataFrame,
    text: str,
    label: str,
    categories: Sequence[str] = (),
    balanced: bool = False,
    n_features: int = 1 << 14,
    reg: float = 0.01,
    max_iter: int = 20,
) -> PipelineModel:
    """Fit a small text classifier on labelled rows (label 0 or 1)."""
    rows = train.select(_words_of(text), F.col(label).cast("double").alias(label), *categories)
    if balanced:
        rows = balanced_weights(rows, label)
    weight = "weight" if balanced else None
    hashing, rest = quality_stages(label, categories, weight, n_features, reg, max_iter)
    # The hashed rows are read once per pass of the fit; words and text are not needed again.
    hashed = PipelineModel(hashing).transform(rows).drop("_words", *categories).persist()
    try:
        fitted = rest.fit(hashed)
    finally:
        hashed.unpersist()
    return PipelineModel([*hashing, *fitted.stages])


def score_corpus(
    model: PipelineModel,
    rows: DataFrame,
    key: str,
    text: str,
    categories: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Key, predicted label, its confidence and the probability of class 1; only needed columns are read.

    Columns of ``keep`` pass through, so that scores need not be joined back to their rows.
    """
    needed = dict.fromkeys([key, *keep, *categories])
    scored = model.transform(rows.select(*needed, _words_of(text)))
    probability = vector_to_array("_probability")
    return scored.select(
        *dict.fromkeys([key, *keep]),
        F.col("_prediction").cast("int").alias("label"),
        F.array_max(probability).alias("confidence"),
        F.get(probability, 1).alias("score"),
    )


def binary_metrics(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """Confusion counts and the usual rates in one pass; a zero denominator gives 0."""

    def cell(truth: int, guess: int):
        return F.count(F.when((F.col(label) == truth) & (F.col(predicted) == guess), 1))

    def rate(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    cells = scored.agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )
    return (
        cells.withColumn("accuracy", rate(tp + tn, tp + tn + fp + fn))
        .withColumn("precision", rate(tp, tp + fp))
        .withColumn("recall", rate(tp, tp + fn))
        .withColumn("specificity", rate(tn, tn + fp))
        .withColumn("f1", rate(2 * tp, 2 * tp + fp + fn))
        .withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)
    )


def weighted_f1(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy and the F1 of each class weighted by its rows, for any number of classes."""
    cells = scored.groupBy(label, predicted).agg(F.count("*").alias("n"))
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col(label).alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("guessed"),
                         F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("guessed"),
                         F.lit(0).cast("long").alias("hit")),
            )
        )
    )
    classes = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("actual", "guessed", "hit")])
    f1 = F.try_divide(2 * F.col("hit"), F.col("actual") + F.col("guessed"))
    return classes.agg(
        F.try_divide(F.sum("hit"), F.sum("actual")).alias("accuracy"),
        F.try_divide(F.sum(F.col("actual") * F.coalesce(f1, F.lit(0.0))), F.sum("actual")).alias("weighted_f1"),
    )


def _by_score(scored: DataFrame, label: str, score: str) -> DataFrame:
    # One row per distinct score, with running counts from the highest score downwards.
    counts = scored.groupBy(F.col(score).alias("threshold")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )
    return running_totals(counts, [F.desc("threshold")], ["n", "pos"])


def pr_curve(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Precision and recall of ``score >= threshold`` at every distinct score."""
    return _by_score(scored, label, score).select(
        "threshold",
        (F.col("run_pos") / F.col("run_n")).alias("precision"),
        F.coalesce(F.try_divide("run_pos", "all_pos"), F.lit(1.0)).alias("recall"),
        "n",
    )


def roc_auc_ap(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision."""
    rows = _by_score(scored, label, score)
    neg = F.col("n") - F.col("pos")
    neg_above = F.col("run_n") - F.col("run_pos") - neg
    # Each positive beats the negatives with a lower score and half of those with the same one.
    below = (F.col("all_n") - F.col("all_pos")) - neg_above - neg
    wins = F.sum(F.col("pos") * (below + neg * 0.5))
    pairs = F.max(F.col("all_pos").cast("double") * (F.col("all_n") - F.col("all_pos")))
    steps = F.sum(F.col("pos") * F.col("run_pos") / F.col("run_n"))
    return rows.agg(
        F.try_divide(wins, pairs).alias("roc_auc"),
        F.try_divide(steps, F.max("all_pos")).alias("average_precision"),
    )


def choose_threshold(
    scored: DataFrame, label: str, score: str, min_precision: float = 0.9, min_threshold: float = 0.5
) -> DataFrame:
    """The lowest threshold above the floor with enough precision.

    Without one, the most precise threshold above the floor (the lowest of equals);
    without any score above the floor, the floor itself with precision and recall 0.
    """
    point = F.struct("threshold", "precision", "recall")
    above = F.col("threshold") >= min_threshold
    enough = above & (F.col("precision") >= min_precision)
    rank = F.struct(F.col("precision"), -F.col("threshold"))
    floor = F.struct(
        F.lit(float(min_threshold)).alias("threshold"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    best = pr_curve(scored, label, score).agg(
        F.coalesce(
            F.min_by(F.when(enough, point), F.when(enough, F.col("threshold"))),
            F.max_by(F.when(above, point), F.when(above, rank)),
            floor,
        ).alias("best"),
        F.min("threshold").alias("min_prob"),
        F.max("threshold").alias("max_prob"),
        (F.sum(F.col("threshold") * F.col("n")) / F.sum("n")).alias("mean_prob"),
    )
    p, r = F.col("best.precision"), F.col("best.recall")
    return best.select(
        F.col("best.threshold").alias("threshold"),
        p.alias("precision"),
        r.alias("recall"),
        F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"),
        "min_prob", "max_prob", "mean_prob",
    )


# Points of the grid below, around and above the optimum, and the width around it.
GRID_POINTS = (40, 20, 40)
GRID_MARGIN = 0.1


def dense_grid(floor: float, optimum: float, highest: float, margin: float = GRID_MARGIN) -> list[float]:
    """Thresholds from floor to highest score, denser around the optimum."""
    corners = (floor, optimum - margin, optimum + margin, highest)
    spans = [np.linspace(a, b, n) for a, b, n in zip(corners, corners[1:], GRID_POINTS)]
    return sorted({float(x) for x in np.clip(np.concatenate(spans), floor, highest)})


def threshold_grid(scored: DataFrame, label: str, score: str, grid: Sequence[float]) -> DataFrame:
    """Precision, recall and F1 of ``score >= t`` at each ``t`` of a short list.

    Each row is counted once, under the number of thresholds it reaches; sums over that
    handful of counts then give every threshold, without pairing rows with thresholds.
    """
    points = sorted(set(float(t) for t in grid))
    spark = scored.sparkSession
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in points]), lambda t: t <= F.col(score)))
    counts = scored.groupBy(reached.alias("place")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )
    slots = spark.createDataFrame(
        [(0, None)] + [(i + 1, t) for i, t in enumerate(points)], "place int, threshold double"
    )
    filled = slots.join(counts, "place", "left").na.fill(0, ["n", "pos"])
    upwards = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    sums = filled.select(
        "threshold",
        F.sum("n").over(upwards).alias("guessed"),
        F.sum("pos").over(upwards).alias("hit"),
        F.sum("pos").over(Window.partitionBy()).alias("actual"),
    ).filter(F.col("threshold").isNotNull())

    def rate(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return sums.select(
        "threshold",
        rate(F.col("hit"), F.col("guessed")).alias("precision"),
        rate(F.col("hit"), F.col("actual")).alias("recall"),
        rate(2 * F.col("hit"), F.col("guessed") + F.col("actual")).alias("f1"),
    )


def filter_by_prediction(
    scored: DataFrame, wanted: object, label: str = "label", confidence: str | None = None, at_least: float = 0.95
) -> DataFrame:
    """Keep one predicted class, optionally only confident predictions."""
    kept = scored.filter(F.col(label) == F.lit(wanted))
    return kept if confidence is None else kept.filter(F.col(confidence) >= at_least)


def label_proportions(scored: DataFrame, label: str = "label") -> DataFrame:
    return value_counts(scored, label, normalize=True)


def confidence_report(scored: DataFrame, confidence: str, below: Sequence[float] = (0.9, 0.8)) -> DataFrame:
    """Summary of the confidence column and the rows under each limit.

    The scores are written first, so that a model behind them runs once.
    """
    under = [F.count(F.when(F.col(confidence) < v, 1)).alias(f"under_{round(v * 100)}") for v in below]
    return describe(materialize(scored.select(confidence)), [confidence], extra=under)


def param_sweep(
    train: DataFrame,
    validation: DataFrame,
    text: str,
    label: str,
    grid: dict[str, Sequence],
    first: dict | None = None,
    parallelism: int = 2,
) -> DataFrame:
    """One trial per grid point: ``number``, ``value`` (average precision), ``params_*``, ``seconds``.

    ``first`` is tried before the grid. Every fit is a distributed job; the driver only holds
    one row of results per trial.
    """
    # Every trial reads both parts again: written once, they are not derived again each time.
    train, validation = (materialize(part.select(text, label)) for part in (train, validation))
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    if first is not None:
        points = [first] + [p for p in points if p != first]

    def trial(item: tuple[int, dict]):
        number, params = item
        started = time.monotonic()
        model = train_quality_filter(train, text, label, **params)
        scored = model.transform(validation.select(_words_of(text), F.col(label).cast("double").alias(label)))
        scored = scored.select(label, F.get(vector_to_array("_probability"), 1).alias("score"))
        value = roc_auc_ap(scored, label, "score").first()["average_precision"]
        numbers = [float(params[p]) if p in params else None for p in grid]
        return (number, value, *numbers, time.monotonic() - started)

    with ThreadPoolExecutor(parallelism) as pool:
        trials = list(pool.map(trial, enumerate(points)))
    columns = ", ".join(f"params_{p} double" for p in grid)
    return train.sparkSession.createDataFrame(trials, f"number int, value double, {columns}, seconds double")
