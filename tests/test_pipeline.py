"""Neighbour properties, folds, permutation, deltas and normalisation."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds as FO
from tidemark.operators import neighbors as N
from tidemark.operators import normalize as NZ

TEXTS = [
    (1, "the cat sat on the mat and then it ran away quickly , very quickly"),
    (2, "a, b c! d"),
    (3, "!!! ??"),
    (4, ""),
    (5, "single"),
]


@pytest.fixture(scope="module")
def prep(spark):
    df = spark.createDataFrame(TEXTS, "sample_id long, input string")
    return N.prepare(df).cache()


def test_mask_count_and_content(prep):
    got = {r["sample_id"]: (r["n_tok"], r["n_content"], r["m"]) for r in prep.collect()}
    assert got[2] == (4, 2, 1)  # "a," and "c!" carry punctuation
    assert got[3] == (2, 0, 0)
    assert got[4] == (0, 0, 0)
    assert got[1][2] == min(max(int(got[1][0] * 0.1), max(0, min(5, got[1][1] - 1))), 40)


def test_deletion_is_subsequence(prep):
    toks = {r["sample_id"]: r["tokens"] for r in prep.collect()}
    ms = {r["sample_id"]: (r["m"], r["n_content"]) for r in prep.collect()}
    for r in N.deletion_neighbors(prep).collect():
        out = r["neighbor"].split()
        src = list(toks[r["sample_id"]])
        it = iter(src)
        assert all(t in it for t in out)
        m, nc = ms[r["sample_id"]]
        assert len(src) - len(out) == min(m, nc)


def test_duplication_and_swap(prep):
    toks = {r["sample_id"]: r["tokens"] for r in prep.collect()}
    ms = {r["sample_id"]: r["m"] for r in prep.collect()}
    for r in N.duplication_neighbors(prep).collect():
        assert len(r["neighbor"].split()) == len(toks[r["sample_id"]]) + ms[r["sample_id"]]
    for r in N.swap_neighbors(prep).collect():
        assert sorted(r["neighbor"].split()) == sorted(toks[r["sample_id"]])


def test_neighbors_order_and_count(spark):
    df = spark.createDataFrame(TEXTS[:1], "sample_id long, input string")
    rows = N.neighbors(df).orderBy("k").collect()
    assert [r["k"] for r in rows] == list(range(24))
    assert [r["kind"] for r in rows] == ["substitution"] * 6 + ["deletion"] * 6 + ["duplication"] * 6 + ["swap"] * 6


def test_folds_stratified_and_permutation(spark):
    df = spark.range(203).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    f = FO.stratified_folds(df, "doc_id", "label", 5)
    counts = f.groupBy("label", "fold").count().collect()
    for lab in (0, 1):
        c = [r["count"] for r in counts if r["label"] == lab]
        assert len(c) == 5 and max(c) - min(c) <= 1
    assert f.select("doc_id").distinct().count() == 203
    p = FO.permute_labels(df, "doc_id", out="perm")
    assert p.groupBy("perm").count().orderBy("perm").collect() == df.groupBy(F.col("label").alias("perm")).count() \
        .orderBy("perm").collect()


def test_lookup_stats_fallback(spark):
    rows = spark.createDataFrame([("d", "m1", 1.0), ("d", "other", 3.0), ("e", "other", 1.0)],
                                 "ds_name string, model_name string, loss_delta double")
    stats = spark.createDataFrame([("d", "m1", 0.5, 2.0), ("d", "no_leak", 1.0, 4.0)],
                                  "ds_name string, model_name string, mean double, std double")
    got = NZ.lookup_stats(rows.filter("ds_name = 'd'"), stats).orderBy("model_name").collect()
    assert [(r["mean"], r["std"]) for r in got] == [(0.5, 2.0), (1.0, 4.0)]
    with pytest.raises(Exception):
        NZ.lookup_stats(rows, stats).collect()
