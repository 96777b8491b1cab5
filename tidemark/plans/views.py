"""Views that give the driver tables the shapes the operators consume.

Each view is a lazy select/join over the given tables, so every query's work
grows with them. The same definitions appear as CTEs in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table


def corpus(spark: SparkSession, sf_dir: str, label: str = "toxic") -> DataFrame:
    """Labelled documents ``(doc_id, text, lang, source, n_chars, label)``; 1 = member."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).cast("int").alias("label"))
    return docs.join(labels, "doc_id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour predictions ``(vec_id, ds_name, model_name, sample_id, label, score array<double>)``.

    Six consecutive vectors form a sample; the first two embedding components
    act as the two attack logits and ``label >= 5`` as membership.
    """
    e = table(spark, sf_dir, "embeddings")
    sample = F.floor(F.col("vec_id") / 6).cast("long")
    return e.select(
        "vec_id",
        F.concat(F.lit("d"), F.pmod(sample, F.lit(3)).cast("string")).alias("ds_name"),
        F.when(F.pmod(sample, F.lit(4)) == 3, F.lit("Giga-7b"))
        .otherwise(F.concat(F.lit("m"), F.pmod(sample, F.lit(2)).cast("string")))
        .alias("model_name"),
        sample.alias("sample_id"),
        (F.col("label") >= 5).cast("int").alias("label"),
        F.array(F.col("embedding")[0], F.col("embedding")[1]).cast("array<double>").alias("score"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense feature rows ``(vec_id, features array<double>, label)`` with a binary label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") >= 5).cast("int").alias("label"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample table ``(sample_id, conv_id, input, answer, ds_name)``: a user turn and the assistant reply after it."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    j = u.join(a, ["conv_id", "turn"])
    return j.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"),
        "conv_id",
        "input",
        "answer",
        F.concat(F.lit("ds"), F.pmod(F.col("conv_id"), F.lit(3)).cast("string")).alias("ds_name"),
    )


def event_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss stand-in from ``events``: a user is a sample, an event a neighbour, the user's first event the original.

    ``(sample_id, k, ds_name, model_name, label, neighbor_loss, input_loss, loss_delta)``.
    """
    e = table(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("input_loss"))
    m = F.pmod(F.col("user_id"), F.lit(3))
    return e.join(first, "user_id").select(
        F.col("user_id").alias("sample_id"),
        F.col("event_id").alias("k"),
        F.col("event_type").alias("ds_name"),
        F.when(m == 0, F.lit("no_leak")).when(m == 1, F.lit("leak")).otherwise(F.lit("other")).alias("model_name"),
        (F.pmod(F.col("user_id"), F.lit(2)) == 0).cast("int").alias("label"),
        F.col("value").alias("neighbor_loss"),
        "input_loss",
        (F.col("value") - F.col("input_loss")).alias("loss_delta"),
    )


def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media files with their vectors, ``(path, vector array<double>)``: one file per row of ``embeddings``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("media/"), F.col("vec_id").cast("string")).alias("path"),
                    F.col("embedding").cast("array<double>").alias("vector"))


def media_lists(samples: DataFrame, nbrs: DataFrame) -> DataFrame:
    """``(sample_id, media_path, media_neighbors)``: lists of one path per neighbour, of one path too few, or null."""
    path = lambda n: F.concat(F.lit("media/"), F.pmod(n, F.lit(520)).cast("string"))
    count = nbrs.groupBy("sample_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    kind = F.pmod(F.col("conv_id"), F.lit(3))
    many = F.when(kind == 0, F.col("n")).when(kind == 1, F.col("n") - 1)
    paths = F.transform(F.sequence(F.lit(0), many - 1), lambda i: path(F.col("sample_id") * 7 + i))
    return samples.join(count, "sample_id").select(
        "sample_id", path(F.col("sample_id") * 13).alias("media_path"), F.when(many >= 1, paths).alias("media_neighbors"))
