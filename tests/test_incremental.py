"""Losses taken in lot by lot: any order of the files and any restart gives the result of one batch."""

import itertools
import math
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import normalize as NZ
from tidemark.sources.parts import shared_path
from tidemark.streaming import incremental as INC
from tidemark.streaming.scorer import EVENTS_SCHEMA


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i, f"2024-01-{1 + (i * 7) % 27:02d} 00:00:{i % 60:02d}", 5 if i % 3 == 0 else i % 7, "xyz"[i % 3 if i % 5 else 0],
             math.sin(i) * 10 + 1e6) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
    return df.select("event_id", F.to_timestamp("ts").alias("ts"), "user_id", "event_type", "value", F.lit("").alias("props")).cache()


def _batch(events):
    first = events.groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("input_loss"))
    rows = events.join(first, "user_id").select(
        F.col("user_id").alias("sample_id"), F.col("event_id").alias("k"), F.col("event_type").alias("ds_name"),
        INC.model_of(F.col("user_id")).alias("model_name"), (F.col("value") - F.col("input_loss")).alias("loss_delta"))
    stats = NZ.loss_mean_var(rows.filter(F.col("model_name") != "other"))
    return _result(NZ.lookup_stats(rows, stats).select("sample_id", "k", NZ.norm_std().alias("norm_loss")))


def _result(df):
    return {(r["sample_id"], r["k"]): r["norm_loss"] for r in df.collect()}


def _lot(events, folder, i):
    """Lot ``i`` of three as one file of the folder."""
    part = events.filter(F.pmod(F.col("event_id"), F.lit(3)) == i).coalesce(1)
    part.write.mode("append").parquet(folder)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_three_lots_in_any_order_equal_one_batch(spark, events, order):
    folder, root = shared_path(spark, "lots"), shared_path(spark, "state")
    seen = []
    for i in order:  # each call of ingest starts anew from the checkpoint
        _lot(events, folder, i)
        INC.ingest(spark, folder, root)
        seen.append(i)
        if i == order[1]:  # and a call without new files changes nothing
            INC.ingest(spark, folder, root)
    so_far = events.filter(F.pmod(F.col("event_id"), F.lit(3)).isin(seen))
    got, want = _result(INC.scores(spark, root)), _batch(so_far)
    assert got.keys() == want.keys() and len(got) == 120
    for key, v in want.items():
        assert got[key] == pytest.approx(v, abs=1e-6)


def test_nulls_and_one_user(spark, events):
    odd = spark.createDataFrame([(1, None, 3, None, None, ""), (2, None, 3, "x", 4.0, ""), (3, None, 6, "x", 1.0, ""), (4, None, 6, "x", 3.0, "")],
                                EVENTS_SCHEMA)
    folder, root = shared_path(spark, "lots"), shared_path(spark, "state")
    odd.coalesce(1).write.parquet(folder)
    INC.ingest(spark, folder, root, salts=1)
    totals = INC.latest_totals(spark, root)
    firsts = {r["user_id"]: r["input_loss"] for r in INC.first_losses(totals).collect()}
    assert firsts == {3: None, 6: 1.0}  # user 3's earliest loss is null
    stats = INC.group_moments(totals, INC.first_losses(totals)).collect()
    assert [(r["ds_name"], r["model_name"], r["mean"], r["std"]) for r in stats] == [("x", "no_leak", 1.0, 1.0)]
    assert os.path.isdir(os.path.join(root.replace("file:", ""), "checkpoint", "totals"))


def test_a_lot_costs_a_call_a_bucket_not_a_key(spark, events, tmp_path):
    """Many users in few states: the totals equal those of a state for each key, also over two lots."""
    folder, root = shared_path(spark, "lots"), shared_path(spark, "state")
    for i in (0, 1):
        _lot(events, folder, i)
        INC.ingest(spark, folder, root, salts=3, buckets=2)
    states = spark.read.format("statestore").load(os.path.join(root, "checkpoint", "totals"))
    assert states.count() == 2
    got = {r["user_id"]: r for r in INC.latest_totals(spark, root).groupBy("user_id").agg(
        F.sum("n").alias("n"), F.sum(F.col("k") * F.col("mean")).alias("s")).collect()}
    want = events.filter(F.pmod(F.col("event_id"), F.lit(3)) < 2).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")).collect()
    assert len(got) == len(want)
    for r in want:
        assert got[r["user_id"]]["n"] == r["n"] and got[r["user_id"]]["s"] == pytest.approx(r["s"])
