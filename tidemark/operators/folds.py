"""Deterministic splits: stratified folds (H10), permuted labels (H11), train/test split.

Random choices are replaced by a hash order ``md5(seed|id)`` so runs repeat
and an SQL engine can replay them. Positions inside a class come from the
distributed running totals, so a class holding most rows is still spread
over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import running_totals

DEFAULT_SEED = 42


def hash_order(seed: int, *cols: str) -> Column:
    """Deterministic pseudo-random sort key ``md5('seed|c1|c2…')``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def n_folds(df: DataFrame, label: str = "label", n_splits: int = 5) -> int:
    """``min(n_splits, smallest class)``; a class with fewer than two rows is an error."""
    counts = df.groupBy(label).count().collect()  # one row per class
    if len(counts) < 2:
        raise ValueError("folds need rows of two classes")
    m = min(r["count"] for r in counts)
    if m < 2:
        raise ValueError("folds need two rows of every class or more")
    return min(n_splits, m)


def stratified_folds(
    df: DataFrame, id_col: str, label: str = "label", n_splits: int = 5, seed: int = DEFAULT_SEED,
    k: int | None = None,
) -> DataFrame:
    """Add ``fold`` in ``0…k-1``; each class is dealt round-robin in hash order."""
    k = k or n_folds(df, label, n_splits)
    keyed = df.withColumn("_h", hash_order(seed, id_col)).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_totals(keyed, [label], [F.col("_h").asc(), F.col(id_col).asc()], ["_one"])
    return ranked.withColumn("fold", F.pmod(F.col("cum__one") - 1, F.lit(k)).cast("int")).drop(
        "_h", "_one", "cum__one"
    )


def permute_labels(df: DataFrame, id_col: str, label: str = "label", seed: int = DEFAULT_SEED,
                   out: str = "label") -> DataFrame:
    """Shuffle all labels (class counts kept) as a no-signal control.

    The label sequence in id order is dealt to the ids in hash order; both
    orders are global positions from running totals, joined on position.
    """
    base = df.withColumn("_one", F.lit(1).cast("long"))
    by_id = running_totals(base.select(id_col, label, "_one"), [], [F.col(id_col).asc()], ["_one"]).select(
        F.col("cum__one").alias("_pos"), F.col(label).alias("_new_label")
    )
    by_hash = running_totals(
        base.withColumn("_h", hash_order(seed, id_col)), [], [F.col("_h").asc(), F.col(id_col).asc()], ["_one"]
    ).withColumnRenamed("cum__one", "_pos")
    joined = by_hash.join(by_id, "_pos")
    cols = [c for c in df.columns if c != label] + ([label] if out != label else [])
    return joined.select(*cols, F.col("_new_label").alias(out))


def train_test_split(df: DataFrame, id_col: str, test_fraction: float = 0.1, seed: int = DEFAULT_SEED) -> DataFrame:
    """``is_test`` flag from a hash bucket in 0…999 (a row-local decision, no shuffle)."""
    bucket = F.pmod(F.conv(F.substring(hash_order(seed, id_col), 1, 8), 16, 10).cast("long"), F.lit(1000))
    return df.withColumn("is_test", bucket < int(round(test_fraction * 1000)))
