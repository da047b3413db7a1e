"""Rollup of a stream of source rows to compact owners.

The relation is a static table; each micro-batch is joined with it and added up,
and the running totals are merged per owner in the sink table. A batch is
written under its own number, so that a batch that is tried again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def owner_sums(rows: DataFrame, relation: DataFrame, sums: list[str], column: str = "h3") -> DataFrame:
    """Partial sums by owner: ``compact_h3, compact_resolution, source_row_n`` and the sums as doubles; rows without an owner are left out."""
    own = rows.select(F.lower(f"`{column}`").alias("source_h3"), *(F.col(f"`{f}`").cast("double").alias(f) for f in sums))
    joined = own.join(relation.select("source_h3", "compact_h3", "compact_resolution"), "source_h3")
    return joined.groupBy("compact_h3", "compact_resolution").agg(F.count("*").alias("source_row_n"), *(F.sum(f"`{f}`").alias(f) for f in sums))


def start(stream: DataFrame, relation: DataFrame, sums: list[str], path: str, checkpoint: str, column: str = "h3", **trigger) -> StreamingQuery:
    """Starts adding up a stream into ``path``, partitioned by batch."""

    def write(batch: DataFrame, number: int) -> None:
        owner_sums(batch, relation, sums, column).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, path: str, sums: list[str]) -> DataFrame:
    """The sums over all batches so far, by owner."""
    parts = spark.read.parquet(path)
    return parts.groupBy("compact_h3", "compact_resolution").agg(F.sum("source_row_n").alias("source_row_n"), *(F.sum(f"`{f}`").alias(f) for f in sums)).orderBy("compact_h3")


def windowed(stream: DataFrame, relation: DataFrame, sums: list[str], time: str, width: str, late: str, column: str = "h3") -> DataFrame:
    """Sums by owner and time window of a stream (or table), with rows up to ``late`` behind still counted."""
    own = stream.withWatermark(time, late).withColumn("source_h3", F.lower(f"`{column}`"))
    joined = own.join(relation.select("source_h3", "compact_h3", "compact_resolution"), "source_h3")
    grouped = joined.groupBy(F.window(time, width), "compact_h3", "compact_resolution")
    return grouped.agg(F.count("*").alias("source_row_n"), *(F.sum(F.col(f"`{f}`").cast("double")).alias(f) for f in sums)).select(F.col("window.start").alias("window_start"), "compact_h3", "compact_resolution", "source_row_n", *sums)
