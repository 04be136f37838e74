"""The whole curation job: split, train, pick a threshold, score, filter, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.operators import classify, joins, sampling
from curate.session import materialize
from curate.sources import writers


def curate_corpus(
    corpus: DataFrame,
    annotations: DataFrame,
    key: str,
    text: str,
    group: str,
    flag: str,
    out: str,
    min_precision: float = 0.9,
    min_threshold: float = 0.5,
) -> DataFrame:
    """Publish the corpus without the rows that a small classifier flags; returns the published rows.

    The classifier learns from the annotated rows, stratified by group and flag, and its
    threshold is chosen on the held-out part. The corpus itself is scored, filtered and written
    in one pass without a shuffle.
    """
    # Labels are few next to the corpus; written once, they are not joined again in each pass.
    labelled = materialize(joins.join_metadata(corpus.select(key, text, group), annotations.select(key, flag), key))
    parts = materialize(sampling.stratified_split(labelled, [group, flag], 0.2, 42, key))
    model = classify.train_quality_filter(parts.filter("split = 'train'"), text, flag, balanced=True)

    held_out = parts.filter("split = 'test'")
    tested = classify.score_corpus(model, held_out, key, text, keep=[flag])
    chosen = classify.choose_threshold(tested, flag, "score", min_precision, min_threshold).first()

    scored = classify.score_corpus(model, corpus, key, text, keep=corpus.columns)
    clean = scored.filter(F.col("score") < chosen["threshold"])
    kept = clean.select(*corpus.columns, "score", F.lit("train").alias("split"))
    version = writers.publish_dataset(kept, out)
    published = writers.read_published(corpus.sparkSession, out, version)
    return published.select(key, group, F.round("score", 6).alias("score"))
