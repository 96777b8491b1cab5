"""ROC / AUROC / TPR@FPR against brute-force statements of the same rules."""

import numpy as np
import pytest

from tidemark.operators import metrics as M


def roc_brute(scores, labels, drop=True):
    order = sorted(set(scores), reverse=True)
    tps, fps = [], []
    for t in order:
        tps.append(sum(1 for s, y in zip(scores, labels) if s >= t and y == 1))
        fps.append(sum(1 for s, y in zip(scores, labels) if s >= t and y == 0))
    idx = list(range(len(order)))
    if drop and len(order) > 2:
        keep = [0]
        for i in range(1, len(order) - 1):
            if (fps[i + 1] - 2 * fps[i] + fps[i - 1]) != 0 or (tps[i + 1] - 2 * tps[i] + tps[i - 1]) != 0:
                keep.append(i)
        keep.append(len(order) - 1)
        idx = keep
    P, N = sum(labels), len(labels) - sum(labels)
    fpr = [0.0] + [fps[i] / N for i in idx]
    tpr = [0.0] + [tps[i] / P for i in idx]
    return fpr, tpr


def auc_brute(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


CASES = {
    "ties": ([0.9, 0.8, 0.8, 0.7, 0.7, 0.7, 0.1], [1, 1, 0, 1, 0, 0, 0]),
    "all_equal": ([0.5] * 6, [1, 0, 1, 0, 0, 1]),
    "perfect": ([0.9, 0.8, 0.3, 0.2], [1, 1, 0, 0]),
    "inverted": ([0.9, 0.8, 0.3, 0.2], [0, 0, 1, 1]),
    "collinear": ([0.9, 0.8, 0.7, 0.6, 0.5, 0.4], [1, 1, 1, 0, 0, 0]),
    "mixed": ([0.95, 0.9, 0.85, 0.8, 0.7, 0.65, 0.6, 0.55, 0.5, 0.3], [1, 0, 1, 1, 0, 1, 0, 0, 1, 0]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_roc_auc_tpr(spark, name):
    scores, labels = CASES[name]
    df = spark.createDataFrame(list(zip(scores, labels)), "score double, label int")
    pts = M.roc_points(df).orderBy("fps", "tps").collect()
    fpr, tpr = roc_brute(scores, labels)
    got = sorted((round(r["fpr"], 9), round(r["tpr"], 9)) for r in pts)
    assert got == sorted((round(a, 9), round(b, 9)) for a, b in zip(fpr, tpr))
    rep = M.roc_report(df, fpr_budgets_pct=[1.0, 25.0, 50.0]).first()
    assert rep["auroc"] == pytest.approx(auc_brute(scores, labels))
    for b, col in ((1.0, "tpr_at_1fpr"), (25.0, "tpr_at_25fpr"), (50.0, "tpr_at_50fpr")):
        assert rep[col] == pytest.approx(float(np.interp(b / 100, fpr, tpr)))
    first95 = next(f for f, t in zip(fpr, tpr) if t >= 0.95)
    last05 = [t for f, t in zip(fpr, tpr) if f <= 0.05][-1]
    assert rep["fpr95"] == pytest.approx(first95)
    assert rep["tpr05"] == pytest.approx(last05)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_running_totals_match_window_with_spare_columns(spark, tmp_path, parts):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidemark.operators.running import running_totals

    path = str(tmp_path / "rows")
    spark.range(400_000).select(
        F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("o"), (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("v"),
        F.lit(1).cast("long").alias("one"), F.repeat(F.lit("spare text "), 3).alias("text")).repartition(parts).write.parquet(path)
    df = spark.read.parquet(path)
    ranks = running_totals(df, [], [F.col("o").desc()], ["one"], n_slices=parts).select("cum_one")
    r = ranks.agg(F.countDistinct("cum_one").alias("d"), F.max("cum_one").alias("m"), F.count("*").alias("n")).first()
    assert (r["d"], r["m"], r["n"]) == (400_000, 400_000, 400_000)
    grouped = running_totals(df, ["g"], [F.col("o").asc()], ["v"], n_slices=parts)
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("g", "o", F.sum("v").over(w).alias("ref"))
    assert grouped.join(ref, ["g", "o"]).filter(F.col("cum_v") != F.col("ref")).count() == 0 and grouped.count() == 400_000


def test_auroc_of_many_distinct_scores(spark):
    from pyspark.sql import functions as F

    df = spark.range(400_000).select("id", F.rand(3).alias("score"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("label"),
                                     F.lit("spare").alias("text"))
    got = M.auroc(df).first()["auroc"]
    pdf = df.select("score", "label").toPandas().sort_values("score")
    ranks = np.arange(1, len(pdf) + 1)
    n1 = int(pdf.label.sum())
    want = (ranks[pdf.label.to_numpy() == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(pdf) - n1))
    assert got == pytest.approx(want, abs=1e-12)


def test_naive_bayes_in_one_plan_equals_fold_by_fold(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import bow_attack as B
    from tidemark.operators import naive_bayes as NB
    from tidemark.operators import text_features as TF

    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame(
        [(i, " ".join(words[(i * 7 + j * j) % 12] for j in range(3 + i % 5)), int(i % 3 == 0)) for i in range(60)], "doc_id long, text string, label int")
    folded = B._folded(docs, "original", "doc_id", "label", 3, 42)
    trials = [{"max_features": 5, "vectorizer": "count", "model_type": "multi"}, {"max_features": 8, "vectorizer": "tf", "model_type": "gaussian"}]
    got = {(r.trial, r.doc_id): r.proba for r in B._scores(docs, folded, trials, "doc_id", "text", "label").collect()}
    assert len(got) == 120
    rows = folded.join(docs.select("doc_id", "text"), "doc_id")
    for t, p in enumerate(trials):
        for f in range(3):
            long, voc = TF.fit_transform(rows, F.col("fold") != f, p["max_features"], p["vectorizer"])
            tr, te = F.col("fold") != f, F.col("fold") == f
            if p["model_type"] == "multi":
                lab = long.join(rows.select("doc_id", "label", "fold"), "doc_id")
                params, priors = NB.multinomial_fit(lab.filter(tr), rows.filter(tr).select("doc_id", "label"), voc.count())
                ref = NB.multinomial_predict(params, priors, lab.filter(te).drop("label"), rows.filter(te).select("doc_id"))
            else:
                dense = TF.dense(long, rows.select("doc_id", "label", "fold"), voc.count())
                params, priors = NB.gaussian_fit(dense.filter(tr))
                ref = NB.gaussian_predict(params, priors, dense.filter(te).drop("label"))
            for r in ref.collect():
                assert got[t, r.doc_id] == pytest.approx(r.proba, abs=1e-9)


def test_softmax_and_sample_scores(spark):
    rows = [(1, 0, [0.0, 0.0]), (1, 0, [2.0, 1.0]), (2, 1, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "sample_id long, label int, score array<double>")
    p = {r["p1"] for r in M.neighbor_probs(df).collect()}
    exp = {0.5, np.exp(1) / (np.exp(2) + np.exp(1)), np.exp(3) / (np.exp(1) + np.exp(3))}
    assert sorted(p) == pytest.approx(sorted(exp))
    s = {r["sample_id"]: r["sample_score"] for r in M.sample_scores(df, ["sample_id"]).collect()}
    assert s[1] == pytest.approx((0.5 + np.exp(1) / (np.exp(2) + np.exp(1))) / 2)


def test_classification_report_rows(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "label int, pred int")
    rep = {(r["row"], r["metric"]): r["value"] for r in M.classification_report(df).collect()}
    assert rep[("member", "precision")] == pytest.approx(0.5)
    assert rep[("member", "recall")] == pytest.approx(0.5)
    assert rep[("non-member", "recall")] == pytest.approx(2 / 3)
    assert rep[("accuracy", "f1-score")] == pytest.approx(0.6)
