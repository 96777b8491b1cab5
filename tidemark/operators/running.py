"""Running totals over a global order without a single-partition window.

``Window.orderBy(x)`` with no ``partitionBy`` moves every row into one task.
Here the rows are range-partitioned into slices once, each row is written to
the reliable checkpoint folder together with its slice number, and both
branches read that one table: local running sums in a window partitioned by
``(slice, group)``, and a per-slice totals table (at most ``slices + groups``
rows), whose own running sums give the offset of every slice. The slice is stored with
the row, so the branches agree whatever columns they read, however often a
task is repeated, and at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def _slices(df: DataFrame, n_slices: int | None) -> int:
    return n_slices or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_totals(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[Column],
    sum_cols: Sequence[str],
    prefix: str = "cum_",
    n_slices: int | None = None,
) -> DataFrame:
    """Add inclusive running sums ``{prefix}{c}`` of ``sum_cols`` per group along ``order_cols``.

    ``(group_cols, order_cols)`` must identify rows uniquely (aggregate first).
    """
    groups = list(group_cols)
    sliced = cut_lineage(
        df.repartitionByRange(_slices(df, n_slices), *[F.col(g) for g in groups], *order_cols)
        .withColumn("_slice", F.spark_partition_id())
    )
    along = Window.partitionBy("_slice", *groups).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(c).over(along).alias(f"_loc_{c}") for c in sum_cols])
    totals = sliced.groupBy("_slice", *groups).agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    # offsets: running sums over the totals, one row a slice and group
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_slice").alias("_at"), *[F.col(g).alias(f"_of_{g}") for g in groups],
        *[F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sum_cols],
    )
    same = F.col("_slice") == F.col("_at")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    joined = local.join(offsets if groups else F.broadcast(offsets), same)
    return joined.select(
        *df.columns, *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"{prefix}{c}") for c in sum_cols]
    )
