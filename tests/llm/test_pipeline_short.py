import corpus_pipeline
from pyspark.sql import functions as F


def test_short_texts_are_not_judged_by_their_share(spark, monkeypatch):
    def told(docs, train):
        pred = F.when(F.col("text").rlike("[a-z]"), "en").otherwise("und")
        return docs.withColumns({"lang_pred": pred, "score": F.col("share"), "log_prob": F.lit(0.0)})

    monkeypatch.setattr(corpus_pipeline, "identify", told)
    rows = [(1, "la casa", 0.3), (2, "la casa " * 10, 0.3), (3, "la casa " * 10, 0.5), (4, "12 34", 0.3), (5, "x" * 79, 0.3), (6, "house", 0.9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, share double")
    assert {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()} == {1, 3, 5, 6}
