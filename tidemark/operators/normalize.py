"""Per-group loss statistics and normalisation.

Statistics are map-side combined aggregates per ``(ds_name, model_name)``;
the statistics table has one row per group and is joined back (Spark picks a
broadcast when it is small). The field named ``std`` holds the population
variance by default, as the reference stores it; ``true_std=True`` gives the
standard deviation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = ["ds_name", "model_name"]
FALLBACK_MODEL = "no_leak"


def loss_mean_var(df: DataFrame, loss: str = "loss_delta", by: Sequence[str] = GROUP, true_std: bool = False):
    """``(by…, mean, std)``; ``std`` is the population variance unless ``true_std``."""
    spread = F.stddev_pop(loss) if true_std else F.var_pop(loss)
    return df.groupBy(*by).agg(F.avg(loss).alias("mean"), spread.alias("std"))


def loss_min_range(df: DataFrame, loss: str = "loss_delta", by: Sequence[str] = GROUP) -> DataFrame:
    """``(by…, min_loss, loss_diff = max − min)``."""
    return df.groupBy(*by).agg(F.min(loss).alias("min_loss"), (F.max(loss) - F.min(loss)).alias("loss_diff"))


def lookup_stats(df: DataFrame, stats: DataFrame, fallback_model: str = FALLBACK_MODEL,
                 on_missing: str = "error") -> DataFrame:
    """Statistics for ``(ds_name, model_name)``, else for ``(ds_name, fallback_model)``.

    Rows still without statistics raise at execution (``on_missing='error'``)
    or keep nulls (``'keep'``).
    """
    vals = [c for c in stats.columns if c not in GROUP]
    exact = stats.select(*GROUP, *[F.col(c).alias(f"_x_{c}") for c in vals])
    fb = stats.filter(F.col("model_name") == fallback_model).select(
        "ds_name", *[F.col(c).alias(f"_f_{c}") for c in vals])
    out = df.join(exact, GROUP, "left").join(fb, "ds_name", "left")
    for c in vals:
        out = out.withColumn(c, F.coalesce(F.col(f"_x_{c}"), F.col(f"_f_{c}"))).drop(f"_x_{c}", f"_f_{c}")
    if on_missing == "error":
        missing = F.col(vals[0]).isNull()
        out = out.withColumn(vals[0], F.when(missing, F.raise_error(F.concat(
            F.lit("no statistics for "), F.col("ds_name"), F.lit("/"), F.col("model_name")))).otherwise(F.col(vals[0])))
    return out


def norm_std(loss: str = "loss_delta", mean: str = "mean", std: str = "std") -> F.Column:
    """``(loss − mean) / std``; a zero divisor leaves the centred value."""
    return F.when(F.col(std) == 0, F.col(loss) - F.col(mean)).otherwise((F.col(loss) - F.col(mean)) / F.col(std))


def norm_linear(loss: str = "loss_delta", min_loss: str = "min_loss", diff: str = "loss_diff") -> F.Column:
    """``(loss − min_loss) / loss_diff``; a zero range leaves the shifted value."""
    return F.when(F.col(diff) == 0, F.col(loss) - F.col(min_loss)).otherwise(
        (F.col(loss) - F.col(min_loss)) / F.col(diff))


def assemble(df: DataFrame, model_name: str, sigmas_type: str = "none", stats: DataFrame | None = None,
             modality_cols: Sequence[str] = ("image_delta", "video_delta", "audio_delta"),
             modality_dim: int | None = None) -> DataFrame:
    """Attack features ``[loss'] ++ embedding_delta (++ modality delta)``.

    ``sigmas_type``: ``none`` | ``std`` | ``linear``. The modality vector
    (first present of image, video, audio) is added unless the model name
    holds "baseline". A row without any gets ``modality_dim`` zeros if that is
    given, so that all rows have one length, else no modality entries.
    """
    out = df
    if sigmas_type == "std":
        out = lookup_stats(out, stats).withColumn("loss_feature", norm_std())
    elif sigmas_type == "linear":
        out = lookup_stats(out, stats).withColumn("loss_feature", norm_linear())
    else:
        out = out.withColumn("loss_feature", F.col("loss_delta"))
    parts = [F.array(F.col("loss_feature")), F.col("embedding_delta")]
    present = [c for c in modality_cols if c in out.columns]
    if present and "baseline" not in model_name.lower():
        parts.append(F.coalesce(*[F.col(c) for c in present], F.array_repeat(F.lit(0.0), modality_dim or 0)))
    return out.withColumn("features", F.concat(*parts))
