"""Incremental tallies with Structured Streaming.

Tallies are sums, so they can be kept up to date exactly. Reference errors can't: a late
panel member changes a clip's threshold, so touched clips are computed anew, batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.consensus import Settings, find_ref_edits
from ..plans.families import Family
from ..plans.switch import tallies


def read_predictions(spark: SparkSession, folder: str, schema: str, kind: str = "json") -> DataFrame:
    """A folder's files as a stream; the model is the file's stem."""
    rows = spark.readStream.schema(schema).format(kind).load(folder)
    return rows.withColumn("model", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1))


def stream_tallies(clips: DataFrame, families: Sequence[Family], **options) -> DataFrame:
    """:func:`tallies` of a stream (update or complete mode)."""
    return tallies(clips, families, **options)


def windowed_counts(events: DataFrame, *keys: str, time: str = "ts", width: str = "1 hour", late: str = "2 hours", value: str | None = None) -> DataFrame:
    """Counts (and sums) by tumbling window; rows later than the watermark are dropped by it in append mode."""
    by = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    out = by.agg(F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else []))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", *(["total"] if value else []))


def stream_edits(clips: DataFrame, table: str, panel: Sequence[str], settings: Settings | None = None, sink: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Appends each batch's (clip_key, model, ref_tokens, hyp_tokens) rows to a table and hands ``sink`` the edits of the clips it touched."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        batch.write.mode("append").saveAsTable(table)
        touched = batch.select("clip_key").distinct()
        rows = spark.read.table(table).join(touched, "clip_key", "left_semi").dropDuplicates(["clip_key", "model"])
        if sink:
            sink(find_ref_edits(rows, panel, settings=settings), number)
        batch.unpersist()

    writer = clips.writeStream.foreachBatch(run).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
