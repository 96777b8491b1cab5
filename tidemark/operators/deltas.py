"""Delta dataset (D01–D08): neighbour minus original, keyed by ``(sample_id, k)``.

Embeddings and losses are glued with equi-joins on the key (the reference
relied on row positions); unmatched rows are reported with anti-joins. The
original sample's values come from a per-sample table joined back, never
from a "first row" of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import vec_sub
from tidemark.operators.running import running_totals

KEY = ["sample_id", "k"]


def align(embeds: DataFrame, losses: DataFrame, modality: DataFrame | None = None) -> DataFrame:
    """Inner join of neighbour embeddings and losses on ``(sample_id, k)``; optional modality left-joined."""
    out = embeds.join(losses, KEY)
    if modality is not None:
        out = out.join(modality, KEY, "left")
    return out


def unmatched(embeds: DataFrame, losses: DataFrame) -> DataFrame:
    """D01 report: keys present on one side only, with the side that has them."""
    e = embeds.select(*KEY).join(losses.select(*KEY), KEY, "left_anti").withColumn("only_in", F.lit("embeds"))
    lo = losses.select(*KEY).join(embeds.select(*KEY), KEY, "left_anti").withColumn("only_in", F.lit("losses"))
    return e.unionByName(lo)


def group_key(*cols: str) -> F.Column:
    """Sample identity ``md5`` of the joined columns (no per-neighbour path)."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


def carry_forward(rows: DataFrame, per_sample: DataFrame, cols: Sequence[str], key: Sequence[str] = ("sample_id",)):
    """Copy per-sample values (the original's loss and embedding) onto every neighbour row."""
    return rows.join(per_sample.select(*key, *cols), list(key), "left")


def loss_delta(neighbor: str = "neighbor_loss", original: str = "input_loss", sign: str = "neighbor_minus_input"):
    """D04 (loss): ``neighbour − input`` by default; ``input_minus_neighbor`` gives the older sign."""
    if sign == "neighbor_minus_input":
        return F.col(neighbor) - F.col(original)
    return F.col(original) - F.col(neighbor)


def embedding_delta(neighbor: str = "neighbor_embeds", original: str = "input_embeds",
                    sign: str = "neighbor_minus_input"):
    """D04 / D05 (vectors): element-wise difference with the same sign convention."""
    if sign == "neighbor_minus_input":
        return vec_sub(neighbor, original)
    return vec_sub(original, neighbor)


def modality_deltas(embeds: DataFrame, kind: str, sign: str = "neighbor_minus_input", id_col: str = "sample_id") -> DataFrame:
    """``(id, k, {kind}_delta)`` from media vectors whose original stands at ``k = -1``.

    The original's vector comes from its own row, joined back. Null where either side has no vector.
    """
    own = embeds.filter(F.col("k") == -1).select(id_col, F.col("embeds").alias("input_embeds"))
    rows = embeds.filter(F.col("k") >= 0).withColumnRenamed("embeds", "neighbor_embeds").join(own, id_col, "left")
    return rows.select(id_col, "k", embedding_delta(sign=sign).alias(f"{kind}_delta"))


def attach_stats(df: DataFrame, stats: DataFrame, by: Sequence[str] = ("ds_name", "model_name")) -> DataFrame:
    """Per-group statistics, defaults mean 0 / std 1 / min 0 / diff 1 when the group has none."""
    out = df.join(stats, list(by), "left")
    for c, d in (("mean", 0.0), ("std", 1.0), ("min_loss", 0.0), ("loss_diff", 1.0)):
        if c in stats.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(d)))
    return out


def build_deltas(samples: DataFrame, embeds: DataFrame, losses: DataFrame, sign: str = "neighbor_minus_input",
                 stats: DataFrame | None = None, modality: DataFrame | None = None) -> DataFrame:
    """``(sample_id, k, ds_name, model_name, label, loss_delta, embedding_delta)`` for every model and label.

    ``modality`` (:func:`modality_deltas`) adds its delta columns, null where a neighbour has none.

    ``embeds``: ``(sample_id, k, embeds)`` with ``k = -1`` for the original;
    ``losses``: ``(sample_id, k, model_name, label, neighbor_loss, input_loss)``.
    """
    nb = embeds.filter(F.col("k") >= 0).withColumnRenamed("embeds", "neighbor_embeds")
    orig = embeds.filter(F.col("k") == -1).select("sample_id", F.col("embeds").alias("input_embeds"))
    # the vectors become one before the rows of the models are joined, so they travel once
    vectors = carry_forward(nb, orig, ["input_embeds"])
    # a sample whose text has no tokens has no embedding rows: its original vector is all zeros
    vectors = vectors.withColumn("input_embeds", F.coalesce(
        F.col("input_embeds"), F.array_repeat(F.lit(0.0), F.size("neighbor_embeds"))))
    vectors = vectors.select(*KEY, embedding_delta(sign=sign).alias("embedding_delta"))
    named = losses.withColumn("loss_delta", loss_delta(sign=sign)).join(samples.select("sample_id", "ds_name"), "sample_id")
    out = align(vectors, named).select("sample_id", "k", "ds_name", "model_name", "label", "loss_delta", "embedding_delta")
    if modality is not None:
        out = out.join(modality, KEY, "left")
    if stats is not None:
        out = attach_stats(out, stats)
    return out


def legacy_groups(df: DataFrame, keys: Sequence[str] = ("input", "label")) -> DataFrame:
    """Dense group index over ``(input, label)`` in sorted order (running count over distinct keys)."""
    distinct = df.select(*keys).distinct().withColumn("_one", F.lit(1).cast("long"))
    idx = running_totals(distinct, [], [F.col(k).asc() for k in keys], ["_one"])
    return df.join(idx.select(*keys, (F.col("cum__one") - 1).alias("group_idx")), list(keys))
