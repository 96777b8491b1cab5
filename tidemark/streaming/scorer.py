"""Incremental scoring with Structured Streaming.

New loss files are read as a stream, joined to static per-sample and
per-group tables (stream–static joins), normalised, and appended to a
Parquet sink. ``trigger(availableNow=True)`` processes everything present
and stops, so the same job serves scheduled incremental runs; the
checkpoint location makes reruns exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import normalize as NZ
from tidemark.sources.parts import shared_path

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def stream_table(spark: SparkSession, folder: str, file_glob: str, schema: T.StructType,
                 max_files_per_trigger: int = 100) -> DataFrame:
    """Stream the Parquet files of ``folder`` matching ``file_glob``."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(folder))


def run_available_now(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Append everything currently available to ``sink`` and stop."""
    q = (stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def normalised_loss_stream(events: DataFrame, first_loss: DataFrame, stats: DataFrame) -> DataFrame:
    """Stateless per-row transform: loss delta against the sample's original, then z-normalised per group."""
    m = F.pmod(F.col("user_id"), F.lit(3))
    rows = events.join(first_loss, "user_id").select(
        F.col("user_id").alias("sample_id"), F.col("event_id").alias("k"), F.col("event_type").alias("ds_name"),
        F.when(m == 0, F.lit("no_leak")).when(m == 1, F.lit("leak")).otherwise(F.lit("other")).alias("model_name"),
        (F.col("value") - F.col("input_loss")).alias("loss_delta"))
    return NZ.lookup_stats(rows, stats).select("sample_id", "k", NZ.norm_std().alias("norm_loss"))


def incremental_normalised_losses(spark: SparkSession, folder: str, first_loss: DataFrame,
                                  stats: DataFrame) -> DataFrame:
    """Stream ``events`` from ``folder`` through :func:`normalised_loss_stream` into a shared sink."""
    sink, ckpt = shared_path(spark, "scores"), shared_path(spark, "scores-checkpoint")
    stream = stream_table(spark, folder, "events.parquet", EVENTS_SCHEMA)
    run_available_now(normalised_loss_stream(stream, first_loss, stats), sink, ckpt)
    return spark.read.parquet(sink)
