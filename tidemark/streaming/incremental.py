"""Normalised losses kept up to date file by file (S14b, incremental form).

New loss files feed two append-only streams. The first writes the rows. The
second keeps keyed stream state: for each (user, type, salt) the number, mean
and squared deviations of the losses and the earliest event, and appends the
new totals of every key that changed. The salt spreads a user who holds a
large part of the rows. The keys are dealt to a fixed number of buckets, each
one state (its keys' totals as an Arrow table), so a lot costs one pandas
call for each bucket it touches, not one for each key. :func:`scores` merges the latest totals: the earliest
event of a user's keys is the original loss, and shifting a key's mean by it
gives the group moments of the deltas, so late files may also move a user's
first event. No pass over the rows is needed before or besides the stream.

State lives in Spark's state store below the checkpoint folder; for many
users choose the RocksDB provider (``spark.sql.streaming.stateStore.providerClass``).
Both streams are exactly-once (file sink and checkpoint), and both must have
ended before :func:`scores` is read. A file counts once, by its name; equal
rows in two files are two rows. Losses that are null or NaN add nothing to
the moments and get a null score. Times that are null come first.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import normalize as NZ
from tidemark.streaming.scorer import EVENTS_SCHEMA, run_available_now, stream_table

SALTS = 16  # parts of a user's rows of one type; changes the spread, not the result
TOTALS = "n long, k long, mean double, m2 double, at long, id long, first double"
OUTPUT = f"user_id long, event_type string, salt int, {TOTALS}"
KEY = ["user_id", "no_user", "event_type", "no_type", "salt"]  # nulls stand as 0 or an empty type with a flag
BUCKETS = 2048  # keys are dealt to so many states; changes the time, not the result
STATE_SCHEMA = pa.schema([
    ("user_id", pa.int64()), ("no_user", pa.bool_()), ("event_type", pa.string()), ("no_type", pa.bool_()), ("salt", pa.int32()), ("n", pa.int64()),
    ("k", pa.int64()), ("mean", pa.float64()), ("m2", pa.float64()), ("at", pa.int64()), ("id", pa.int64()), ("first", pa.float64())])
ROW_SCHEMA = T.StructType([EVENTS_SCHEMA[c] for c in ("event_id", "user_id", "event_type", "value")])
EARLIEST = -(2**62)


def model_of(user: Column) -> Column:
    """The model whose losses a user stands for in the stand-in data."""
    m = F.pmod(user, F.lit(3))
    return F.when(m == 0, F.lit("no_leak")).when(m == 1, F.lit("leak")).otherwise(F.lit("other"))


def _partial(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals of the keys of some rows."""
    groups = rows.groupby(KEY, dropna=False, sort=False)["value"]
    rows = rows.assign(n=1, k=rows["value"].notna().astype("int64"), mean=rows["value"].fillna(0.0), first=rows["value"],
                       m2=((rows["value"] - groups.transform("mean")) ** 2).fillna(0.0), id=rows["event_id"])
    return _merge(rows.assign(mean=groups.transform("mean").fillna(0.0)), own_means=True)


def _merge(parts: pd.DataFrame, own_means: bool = False) -> pd.DataFrame:
    """One row a key: counts, pooled mean and squared deviations, and the earliest event (the first of equal ones)."""
    groups = parts.groupby(KEY, dropna=False, sort=False)
    k = groups["k"].transform("sum")
    mean = parts["mean"]
    if not own_means:
        mean = ((parts["k"] * parts["mean"]).groupby([parts[c] for c in KEY], dropna=False, sort=False).transform("sum") / k.where(k > 0)).fillna(0.0)
        parts = parts.assign(m2=parts["m2"] + parts["k"] * (parts["mean"] - mean) ** 2)
    sums = parts.assign(mean=mean).groupby(KEY, dropna=False, sort=False).agg(
        n=("n", "sum"), k=("k", "sum"), mean=("mean", "first"), m2=("m2", "sum")).reset_index()
    heads = parts.sort_values(["at", "id"], kind="stable").drop_duplicates(KEY)
    return sums.merge(heads[[*KEY, "at", "id", "first"]], on=KEY)


def _add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold the new rows of one bucket of keys into their totals, all keys at once; the changed totals come out."""
    new = [_partial(rows) for rows in batches if len(rows)]
    if not new:
        return
    parts = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
    totals = _merge(pd.concat([*parts, *new], ignore_index=True))
    buffer = pa.BufferOutputStream()
    table = pa.Table.from_pandas(totals, STATE_SCHEMA, preserve_index=False)
    with pa.ipc.new_stream(buffer, STATE_SCHEMA) as out:
        out.write_table(table)
    state.update((buffer.getvalue().to_pybytes(),))
    changed = totals.merge(pd.concat([p[KEY] for p in new]).drop_duplicates(), on=KEY) if parts else totals
    changed = changed.astype({"user_id": object, "first": object})
    changed.loc[changed["no_user"], "user_id"] = None
    changed.loc[changed["no_type"], "event_type"] = None
    changed = changed.where(changed.notna(), None)
    yield changed[[c.split()[0] for c in OUTPUT.split(", ")]]


def ingest(spark: SparkSession, folder: str, root: str, file_glob: str = "*.parquet", salts: int = SALTS,
           max_files_per_trigger: int = 100, buckets: int = BUCKETS) -> None:
    """Take in every file of ``folder`` that ``root`` has not seen yet, and stop. May be called again at any time."""
    events = stream_table(spark, folder, file_glob, EVENTS_SCHEMA, max_files_per_trigger)
    run_available_now(events.select(*ROW_SCHEMA.names), os.path.join(root, "rows"), os.path.join(root, "checkpoint", "rows"))
    salt = F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int")
    keyed = events.select(
        F.coalesce("user_id", F.lit(0)).alias("user_id"), F.col("user_id").isNull().alias("no_user"),
        F.coalesce("event_type", F.lit("")).alias("event_type"), F.col("event_type").isNull().alias("no_type"), salt.alias("salt"),
        F.pmod(F.xxhash64("user_id", "event_type", salt), F.lit(buckets)).cast("int").alias("bucket"), "value",
        F.coalesce(F.unix_micros("ts"), F.lit(EARLIEST)).alias("at"), F.coalesce("event_id", F.lit(EARLIEST)).alias("event_id"))
    totals = keyed.groupBy("bucket").applyInPandasWithState(_add, OUTPUT, "totals binary", "append", GroupStateTimeout.NoTimeout)
    run_available_now(totals, os.path.join(root, "totals"), os.path.join(root, "checkpoint", "totals"))


def latest_totals(spark: SparkSession, root: str) -> DataFrame:
    """The newest totals of every key: a key's row count only grows."""
    parts = spark.read.schema(OUTPUT).parquet(os.path.join(root, "totals"))
    names = [c.split()[0] for c in TOTALS.split(", ")]
    return parts.groupBy("user_id", "event_type", "salt").agg(F.max(F.struct(*names)).alias("t")).select(
        "user_id", "event_type", "salt", "t.*")


def first_losses(totals: DataFrame) -> DataFrame:
    """``(user_id, input_loss)``: the loss of each user's earliest event (ties by event id)."""
    return totals.groupBy("user_id").agg(F.min(F.struct("at", "id", "first")).alias("f")).select(
        "user_id", F.col("f.first").alias("input_loss"))


def group_moments(totals: DataFrame, firsts: DataFrame) -> DataFrame:
    """Mean and population variance of the loss deltas per ``(ds_name, model_name)``, without the rows."""
    key = totals.filter(F.col("k") > 0).join(firsts.filter(F.col("input_loss").isNotNull()), "user_id").select(
        F.col("event_type").alias("ds_name"), model_of(F.col("user_id")).alias("model_name"), F.col("k").cast("double").alias("k"),
        "m2", (F.col("mean") - F.col("input_loss")).alias("d")).filter(F.col("model_name") != "other")
    centre = key.groupBy(*NZ.GROUP).agg((F.sum(F.col("k") * F.col("d")) / F.sum("k")).alias("mean"))
    return key.join(centre, NZ.GROUP).groupBy(*NZ.GROUP, "mean").agg(
        (F.sum(F.col("m2") + F.col("k") * (F.col("d") - F.col("mean")) ** 2) / F.sum("k")).alias("std"))


def scores(spark: SparkSession, root: str) -> DataFrame:
    """``(sample_id, k, norm_loss)`` of all rows taken in so far, normalised by the state so far."""
    totals = latest_totals(spark, root)
    firsts = first_losses(totals)
    rows = spark.read.schema(ROW_SCHEMA).parquet(os.path.join(root, "rows")).join(firsts, "user_id").select(
        F.col("user_id").alias("sample_id"), F.col("event_id").alias("k"), F.col("event_type").alias("ds_name"),
        model_of(F.col("user_id")).alias("model_name"), (F.col("value") - F.col("input_loss")).alias("loss_delta"))
    return NZ.lookup_stats(rows, group_moments(totals, firsts)).select("sample_id", "k", NZ.norm_std().alias("norm_loss"))
