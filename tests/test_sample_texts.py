"""Losses, vectors and neighbours of a sample are worked out within its row (findings 23-29, 36 of round 3)."""

import pytest

from tidemark.operators import embed as EM
from tidemark.operators import loss as LO
from tidemark.operators import neighbors as N
from tidemark.operators.deltas import build_deltas

# repeated ids, null and empty sides, a text without tokens, repeated neighbours
SAMPLES = [(1, "One two two. Three", "four Five four five", "a"), (2, None, "six", "a"), (3, "seven eight", None, "b"), (4, "", " ", "b"),
           (5, "one two", "three", "a"), (5, "two one", "", "b"), (None, "nine ten", "one", "a")]
NEIGHBORS = [(1, 0, "two. One two Three"), (1, 1, "One two"), (1, 2, "One two"), (2, 0, ""), (2, 1, "six six"), (3, 0, "eight seven"),
             (3, 1, ""), (4, 0, ""), (5, 0, "one one"), (5, 0, "two"), (5, 1, "ΣΑΣ Σ"), (None, 0, "one"), (9, 0, "one")]


@pytest.fixture(scope="module")
def tables(spark):
    samples = spark.createDataFrame(SAMPLES, "sample_id long, input string, answer string, ds_name string")
    return samples, spark.createDataFrame(NEIGHBORS, "sample_id long, k int, neighbor string")


def _models(spark):
    docs = spark.createDataFrame([("one two three four five one two",), ("six seven one one",)], "text string")
    other = spark.createDataFrame([("two. three five four nine ten",)], "text string")
    return {"a": (LO.train_bigram_lm(docs), 1), "b": (LO.train_bigram_lm(other), 0)}


@pytest.mark.parametrize("user_answer", [False, True])
@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_losses_equal_those_of_whole_texts(spark, tables, user_answer, broadcast_rows):
    models = _models(spark)
    whole = LO.score_losses(LO.loss_pairs(*tables, user_answer), ["sample_id", "k"], "text", {n: m for n, (m, _) in models.items()})
    loss = {(r["sample_id"], r["k"]): r for r in whole.collect()}
    want = sorted((i, k, n, y, round(r[n], 9), round(loss[i, -1][n], 9) if (i, -1) in loss else None)
                  for (i, k), r in loss.items() if k >= 0 for n, (_, y) in models.items())
    got = LO.loss_stages(*tables, models, user_answer, broadcast_rows=broadcast_rows)
    assert sorted((i, k, n, y, round(a, 9), None if b is None else round(b, 9)) for i, k, n, y, a, b in got.collect()) == want


def test_a_pair_of_a_sample_is_one_row(tables):
    pairs = LO.sample_pairs(*tables)
    assert pairs.groupBy("sample_id", "prev", "tok").count().filter("count > 1").count() == 0
    held = {(r["prev"], r["tok"]): sorted(r["ks"]) for r in pairs.filter("sample_id = 1").collect()}
    assert held["five", "four"] == [LO.ALL] and held["one", "two"] == [-1, 0, 1, 2]


@pytest.mark.parametrize("user_answer", [False, True])
def test_vectors_equal_those_of_whole_texts(tables, user_answer):
    samples, nbrs = tables
    nbrs = nbrs.filter("sample_id <> 4")  # a text of cancelling tokens has no norm to divide by
    whole = EM.hashed_vectors(EM._texts(samples, nbrs, user_answer, "sample_id"), ["sample_id", "k"], "text")
    assert sorted(map(tuple, EM.embed_vectors(samples, nbrs, user_answer).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_long_vectors_keep_buckets_whose_tokens_cancel(spark):
    signs = {}
    for i in range(2000):
        h, sign = EM._code(f"t{i}")
        signs.setdefault(h % EM.DIM, {}).setdefault(sign, f"t{i}")
    both = next(x for x in signs.values() if len(x) == 2)
    samples = spark.createDataFrame([(1, f"{both[1]} {both[-1]} one", "two")], "sample_id long, input string, answer string")
    nbrs = spark.createDataFrame([(1, 0, "one")], "sample_id long, k int, neighbor string")
    whole = EM.hashed_embedding(EM._texts(samples, nbrs, False, "sample_id"), ["sample_id", "k"], "text")
    rows = lambda df: sorted((i, k, d, round(v, 12)) for i, k, d, v in df.collect())
    assert rows(EM.embed_stage(samples, nbrs)) == rows(whole) and any(v == 0 for *_, v in rows(whole))


def test_no_token_is_shuffled_for_vectors(tables):
    plan = EM.embed_stage(*tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "explode" not in plan


def test_samples_are_dealt_to_all_cores(spark, tables):
    samples, _ = tables
    prep = N.prepare(samples.coalesce(1))
    assert prep.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert prep.count() == len(SAMPLES)


def test_deltas_join_one_vector_per_neighbor(spark, tables):
    samples, nbrs = tables
    samples, nbrs = samples.filter("sample_id in (1, 2)"), nbrs.filter("sample_id in (1, 2)")
    deltas = build_deltas(samples, EM.embed_vectors(samples, nbrs), LO.loss_stages(samples, nbrs, _models(spark)))
    vectors = {(r["sample_id"], r["k"]): r["embeds"] for r in EM.embed_vectors(samples, nbrs).collect()}
    for r in deltas.collect():
        own = vectors.get((r["sample_id"], -1), [0.0] * EM.DIM)
        assert r["embedding_delta"] == [a - b for a, b in zip(vectors[r["sample_id"], r["k"]], own)]
    assert {(r["sample_id"], r["k"]) for r in deltas.collect()} == {(1, 0), (1, 1), (2, 0), (2, 1)}
