"""Counts of a run, and precision and recall where rows carry labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs_within(groups: DataFrame, group: str, member: str) -> DataFrame:
    """(a, b) of all members that share a group."""
    left, right = groups.select(group, F.col(member).alias("a")), groups.select(group, F.col(member).alias("b"))
    return left.join(right, group).filter(F.col("a") < F.col("b")).select("a", "b").distinct()


def true_pairs(rows: DataFrame) -> DataFrame:
    return pairs_within(rows.filter("true_person_id IS NOT NULL"), "true_person_id", "id")


def ratio(part: Column, whole: Column, if_none: float) -> Column:
    return F.when(whole == 0, F.lit(if_none)).otherwise(part / whole)


def agreement(predicted: DataFrame, truth: DataFrame) -> tuple[int, int, int]:
    """How many pairs are predicted, true, and both."""
    found = predicted.select("a", "b").distinct().withColumn("p", F.lit(1)).join(truth.withColumn("t", F.lit(1)), ["a", "b"], "full")
    row = found.agg(F.count("p"), F.count("t"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull())).first()
    return tuple(row)


def precision_recall(predicted: DataFrame, truth: DataFrame) -> tuple[float, float]:
    """Precision is 1 without predictions, recall 1 without true pairs."""
    p, t, both = agreement(predicted, truth)
    return (both / p if p else 1.0), (both / t if t else 1.0)


def threshold_sweep(edges: DataFrame, auto: DataFrame, truth: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Queue length, and precision and recall of taking it whole, at each threshold, in one job.

    ``edges`` are scored pairs that are still open, ``auto`` pairs merged already.
    """
    spark = edges.sparkSession
    steps = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    known = truth.withColumn("t", F.lit(1))
    queued = edges.select("a", "b", "score").join(known, ["a", "b"], "left").crossJoin(F.broadcast(steps)).filter("score >= threshold")
    queue = queued.groupBy("threshold").agg(F.count("*").alias("queue"), F.count("t").alias("queue_true"))
    base = auto.join(known, ["a", "b"], "left").agg(F.count("*").alias("auto"), F.count("t").alias("auto_true")).crossJoin(truth.agg(F.count("*").alias("truth")))
    whole = steps.join(queue, "threshold", "left").crossJoin(F.broadcast(base))
    queue_n, queue_true = F.coalesce("queue", F.lit(0)), F.coalesce("queue_true", F.lit(0))
    return whole.select(
        "threshold",
        queue_n.cast("long").alias("queue"),
        ratio(F.col("auto_true"), F.col("auto"), 1.0).alias("auto_precision"),
        ratio(F.col("auto_true"), F.col("truth"), 1.0).alias("auto_recall"),
        ratio(F.col("auto_true") + queue_true, F.col("auto") + queue_n, 1.0).alias("blind_precision"),
        ratio(F.col("auto_true") + queue_true, F.col("truth"), 1.0).alias("blind_recall"),
    )
