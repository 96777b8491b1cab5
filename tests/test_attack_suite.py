"""Six detectors by name: inputs, tasks, dispatch by data set."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import attack_suite as S


@pytest.fixture(scope="module")
def data(spark):
    docs = spark.createDataFrame(
        # three members and six others: three folds
        [(i, f"{'early' if i % 2 else 'later'} word{i % 5} {2010 if i % 2 else 2024} other text", i % 2) for i in range(12) if i % 2 == 0 or i < 6],
        "doc_id long, text string, label int").cache()
    vectors = docs.select(F.col("doc_id").alias("id"), F.array(F.col("label").cast("double"), F.sin("doc_id"), F.cos("doc_id")).alias("features"), "label")
    return S.Corpus(docs, vectors, vectors, vectors.select(F.col("id").alias("doc_id"), "features"))


def test_six_names_each_with_its_control(spark, data):
    rows = S.run_attacks(data, settings=S.Settings(media_model="gaussian", greedy_splits=1, pca_dim=None, dataset_name="wikimia")).collect()
    got = {(r["attack"], r["task"]): {} for r in rows}
    for r in rows:
        got[r["attack"], r["task"]][r["metric"]] = r["mean"]
    assert set(got) == {(a, t) for a in S.DETECTORS for t in S.TASKS} and len(S.DETECTORS) == 6
    assert all(v is not None for m in got.values() for v in m.values())
    assert got["date_detection", "original"]["auroc"] == 1.0 > got["date_detection", "permuted"]["auroc"]
    for a in ("bag_of_words", "bag_of_visual_words", "bag_of_audio_words"):
        assert got[a, "original"]["auroc"] > 0.8  # each fold holds one member


def test_data_set_chooses_the_variant(spark, data):
    only_docs = S.Corpus(docs=data.docs)
    wiki = S.run_attacks(only_docs, ["greedy_selection"], S.Settings("temporal_wiki", greedy_splits=1)).collect()
    assert {r["metric"] for r in wiki} == {"auroc"} and {r["task"] for r in wiki} == set(S.TASKS)
    arxiv = S.run_attacks(only_docs, ["greedy_selection"], S.Settings("arxiv1m_1m")).collect()
    assert {r["metric"] for r in arxiv} == {f"{w}_{c}" for w in ("reference_words", "best_words") for c in ("tpr", "fpr")}
    cited = S.run_attacks(only_docs, ["date_detection"], S.Settings("arxiv_1m")).collect()
    assert {r["mean"] for r in cited if r["metric"] == "auroc"} == {0.5}  # no citations in these texts


def test_unknown_names_and_missing_inputs(spark, data):
    with pytest.raises(ValueError, match="no detector"):
        S.run_attacks(data, ["horoscope"])
    with pytest.raises(ValueError, match="needs images"):
        S.run_attacks(S.Corpus(docs=data.docs), ["bag_of_visual_words"])
    with pytest.raises(ValueError, match="one detector"):
        S.run_attacks(data, [])
