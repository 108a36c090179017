"""Leads that keep arriving: stateless steps on the stream, linkage batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.config import Config
from kinfold.operators import blocking, records, scoring
from kinfold.schema import as_constraints


def normalized_stream(rows: DataFrame, config: Config | None = None) -> DataFrame:
    """Normalized and triaged records of a stream of rows."""
    return records.triaged(records.normalized(rows, config or Config()))


def first_by_mailbox(stream: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """The first record of each personal mailbox within the watermark; others are dropped."""
    person = stream.filter(records.has_mailbox()).withColumn("mailbox", F.col("email.canonical"))
    return person.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["mailbox"])


def new_edges(batch: DataFrame, known: DataFrame, config: Config | None = None, constraints: DataFrame | None = None) -> DataFrame:
    """Scored and routed edges that the records of ``batch`` bring, among themselves and to ``known``.

    Both hold triaged records. Only keys of the batch are joined with the stored ones, so the
    cost follows the batch; keys with more records than the cap are skipped as in a whole run.
    """
    config = config or Config()
    batch, known = (d.filter(F.col("held_reason").isNull()).drop("held_reason") for d in (batch, known))
    every = known.join(batch.select("id"), "id", "left_anti").unionByName(batch)
    fresh = blocking.keyed(batch)
    keys = blocking.keyed(every).join(fresh.select("key").distinct(), "key", "left_semi")
    pairs = blocking.blocked_pairs(keys, blocking.block_sizes(keys), config.max_block_size)
    a, b = (batch.select(F.col("id").alias(c), F.lit(True).alias(f"new_{c}")) for c in "ab")
    touched = pairs.join(a, "a", "left").join(b, "b", "left").filter("new_a OR new_b").select("a", "b")
    sides = scoring.sides(every)
    found = scoring.routed(touched, sides, as_constraints(constraints, batch), config)
    return scoring.explained(found, sides, config).select("a", "b", "kind", "score", "reasons", "route")


def link_stream(stream: DataFrame, store: str, edges: str, checkpoint: str, config: Config | None = None):
    """A query that links each batch of ``stream`` (triaged records) against the table at ``store``.

    Records are appended to ``store`` and edges to ``edges`` (both Parquet) by batch, in folders
    named after it, so that a batch that runs again replaces what it wrote.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            schema = held.schema
            known = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(store) if _there(spark, store) else spark.createDataFrame([], schema)
            new_edges(held, known, config).write.mode("overwrite").parquet(f"{edges}/batch={number}")
            held.write.mode("overwrite").parquet(f"{store}/batch={number}")
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def _there(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
