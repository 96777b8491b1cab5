"""Costly steps run once: rows are counted as a function sees them, or in the tables that are stored."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import attack as AT
from tidemark.operators import bow_attack as B
from tidemark.operators import masked_fill as MF
from tidemark.operators import media_attack as MA
from tidemark.operators import naive_bayes as NB
from tidemark.operators import named_models as NM
from tidemark.operators import neighbors as N
from tidemark.operators import text_features as TF
from tidemark.plans import q_attack as QA
from tidemark.session import stored

WORDS = [f"w{i}" for i in range(9)]


def _docs(spark, n=40):
    return spark.createDataFrame([(i, " ".join(WORDS[(i * 5 + j * j) % 9] for j in range(3 + i % 5)), i % 2) for i in range(n)],
                                 "doc_id long, text string, label int")


def _counted(spark, kind):
    """A function that returns its argument and counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def same(x):
        calls.add(1)
        return x

    return calls, F.udf(same, kind)


def test_joint_attack_makes_media_vectors_once(spark):
    calls, same = _counted(spark, "array<double>")
    media = spark.range(40).select(F.col("id").alias("img_id"), same(F.array(
        F.col("id").cast("double"), F.sqrt("id"), F.lit(1.0))).alias("features"))
    got = MA.joint_attack(_docs(spark), media, max_features=4, model_type="gaussian", pca_dim=None, n_splits=3)
    assert sorted(r.fold for r in got.collect()) == [0, 1, 2] and calls.value == 40


def test_network_training_reads_its_rows_once(spark, monkeypatch):
    monkeypatch.setattr(AT, "SPREAD_ROWS", 10)
    calls, same = _counted(spark, "array<double>")
    df = spark.range(40).select((F.col("id") % 2).cast("int").alias("label"), same(F.array(F.sin("id"), F.cos("id"))).alias("features"))
    AT.train(df, 2, hidden=(3,), max_iter=3)
    assert calls.value == 40


def test_statistics_of_a_named_model_are_stored(spark):
    rows = spark.createDataFrame([(i // 2, i % 2, "d", "m", i % 2, float(i % 7), [float(i), 1.0]) for i in range(20)],
                                 "sample_id long, k int, ds_name string, model_name string, label int, loss_delta double, embedding_delta array<double>")
    model = NM.train_named("BaseLineLossNormLinear", rows, hidden=(3,), max_iter=2)
    assert model.stats.inputFiles() and [tuple(r) for r in model.stats.collect()] == [("d", "m", 0.0, 6.0)]


def test_terms_of_a_text_are_counted_once(spark):
    calls, same = _counted(spark, "string")
    docs = _docs(spark).repartition(2).withColumn("text", same("text"))
    long, voc = TF.fit_transform(docs, F.col("label") >= 0, 4)
    assert voc.count() == 4 and long.count() > 40 and calls.value == 40


@pytest.mark.parametrize("model_type", ["gaussian", "multi"])
def test_sparse_fit_reads_the_entries_once(spark, model_type):
    calls, same = _counted(spark, "double")
    entries = spark.createDataFrame([(i, i % 2, WORDS[i % 4], float(1 + i % 3)) for i in range(12)], "doc_id long, label int, term string, value double")
    ids = entries.select("doc_id", "label")
    params, const = NB.sparse_fit(entries.withColumn("value", same("value")), ids, model_type)
    assert params.count() == 4 and const.count() == 1 and calls.value == 12


def test_trials_that_differ_in_the_model_share_their_vectors(spark, monkeypatch):
    docs = _docs(spark, 60)
    folded, tf = B._folded(docs, "original", "doc_id", "label", 3, 42), TF.term_counts(docs)
    trials = [{"max_features": 5, "vectorizer": v, "model_type": m} for v in ("tf", "count") for m in ("multi", "gaussian")]
    sizes = []

    def counted(df):
        out = stored(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(B, "stored", counted)
    got = {(r.trial, r.doc_id): r.proba for r in B.nb_scores(folded, tf, trials, "doc_id", "label").collect()}
    assert len(got) == 240 and sizes[1] == 2 * sizes[0]  # entries, then one vector for each of two forms
    for t, trial in enumerate(trials):
        for r in B.nb_scores(folded, tf, [trial], "doc_id", "label").collect():
            assert got[t, r.doc_id] == pytest.approx(r.proba, abs=1e-12)


def test_rows_without_rounds_left_are_not_written_again(spark, monkeypatch):
    sizes = []

    def counted(df):
        out = stored(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(MF, "stored", counted)
    prep = N.prepare(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c"), (3, "solo")], "sample_id long, input string"))
    m = [r["m"] for r in prep.collect()]
    assert MF.substitution_rounds(prep, load=lambda: lambda texts: ["x"] * len(texts)).count() == 18
    assert sizes == [18] + [6 * sum(x >= r for x in m) for r in range(1, max(m) + 1)]


def test_split_vectors_are_dealt_to_all_cores(spark, monkeypatch):
    monkeypatch.setattr(QA, "SPREAD_ROWS", 10)
    monkeypatch.setattr(QA.V, "corpus", lambda *_: _docs(spark))
    rows = QA._split_vectors(spark, None)
    assert rows.count() == 40 and rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows.unpersist()
