"""Cross-validated attacks on dense media features.

Per stratified fold: optional whitened PCA fitted on the training rows only
(``fit_on_all=True`` reproduces the reference, which fits before splitting),
a classifier fitted on the training rows, the held-out rows scored; the
folds' scores are evaluated together by one grouped ROC report. The permuted
-label control runs the same plan on shuffled labels.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators.classifiers import MEDIA_STACK, at_once, fit_predict
from tidemark.operators.folds import permute_labels, stratified_folds
from tidemark.operators.media import whitener
from tidemark.session import cut_lineage


def _project(train: DataFrame, test: DataFrame, k: int | None, features: str):
    """Whitened components fitted on the training rows only."""
    if not k:
        return train, test
    project = whitener(train, k, features)
    return tuple(project(df, "_reduced").drop(features).withColumnRenamed("_reduced", features) for df in (train, test))


def cv_dense(df: DataFrame, model_type: str, fpr_budget_pct: float, id_col: str, features: str = "features",
             label: str = "label", pca_dim: int | None = None, n_splits: int = 5, seed: int = 42) -> DataFrame:
    """``(fold, auroc, tpr)`` per fold for dense ``array<double>`` features."""
    spark = df.sparkSession
    folded = stratified_folds(df.select(id_col, features, label), id_col, label, n_splits, seed).cache()
    k = int(folded.agg(F.max("fold")).first()[0]) + 1
    dim = len(folded.select(features).first()[0])
    scored = None
    for f in range(k):
        tr, te = folded.filter(F.col("fold") != f), folded.filter(F.col("fold") == f)
        tr, te = _project(tr, te, min(pca_dim, dim) if pca_dim else None, features)
        p = fit_predict(model_type, tr, te, features, label, MEDIA_STACK, id_col=id_col).select(id_col, label, "proba") \
            .withColumn("fold", F.lit(f))
        scored = p if scored is None else scored.unionByName(p)
    col = f"tpr_at_{M._pct_name(fpr_budget_pct)}fpr"
    rep = M.roc_report(scored, "proba", label, by=["fold"], fpr_budgets_pct=[fpr_budget_pct])
    rows = [Row(fold=int(r["fold"]), auroc=float(r["auroc"]), tpr=float(r[col]))
            for r in rep.select("fold", "auroc", col).collect()]  # k rows
    folded.unpersist()
    return spark.createDataFrame(sorted(rows), "fold int, auroc double, tpr double")


def media_attack(df: DataFrame, attack: str, model_type: str = "stack", fpr_budget_pct: float = 1.0,
                 id_col: str = "id", features: str = "features", label: str = "label",
                 pca_dim: int | None = 250, seed: int = 42) -> DataFrame:
    """CV on true and permuted labels; ``(attack, task, metric, mean, std)``."""
    true_cv = cv_dense(df, model_type, fpr_budget_pct, id_col, features, label, pca_dim, seed=seed)
    perm = permute_labels(df.select(id_col, features, label), id_col, label, seed)
    perm_cv = cv_dense(perm, model_type, fpr_budget_pct, id_col, features, label, pca_dim, seed=seed)
    out = None
    for task, cv in (("original", true_cv), ("permuted", perm_cv)):
        s = M.fold_summary(cv, ["auroc", "tpr"]).select(F.inline(F.array(
            F.struct(F.lit(task).alias("task"), F.lit("auroc").alias("metric"), F.col("auroc_mean").alias("mean"),
                     F.col("auroc_std").alias("std")),
            F.struct(F.lit(task).alias("task"), F.lit(f"tpr_at_{M._pct_name(fpr_budget_pct)}fpr").alias("metric"),
                     F.col("tpr_mean").alias("mean"), F.col("tpr_std").alias("std")))))
        out = s if out is None else out.unionByName(s)
    return out.withColumn("attack", F.lit(attack))


def joint_attack(docs: DataFrame, media: DataFrame, fpr_budget_pct: float = 1.0, max_features: int = 30,
                 model_type: str = "random", id_col: str = "doc_id", pca_dim: int | None = 20,
                 n_splits: int = 5, seed: int = 42) -> DataFrame:
    """Per fold a tf-idf text vector (vocabulary fitted on the training rows) joined with the media
    vector, scaled and PCA-projected on the training rows, then classified; one row per fold
    ``(fold, auroc, tpr)``. A fold whose test rows hold one class only scores AUROC .5 and TPR = budget."""
    from tidemark.operators import text_features as TF

    spark = docs.sparkSession
    folded = stratified_folds(docs.select(id_col, "text", "label"), id_col, "label", n_splits, seed).cache()
    k = int(folded.agg(F.max("fold")).first()[0]) + 1
    tf = TF.term_counts(folded, id_col, "text").cache()
    # every fold reads the media vectors, every step of a fold its joint vectors: both are made once
    # (checkpoints keep the partitions, by which a forest draws its rows)
    media = cut_lineage(media.select(F.col(media.columns[0]).alias(id_col), F.col("features").alias("mvec")))
    width = len(media.select("mvec").first()[0])

    def one(f: int) -> Row:
        long, voc = TF.fit_transform(folded, F.col("fold") != f, max_features, "tf", id_col, "text", tf)
        size = voc.count()  # bounded by max_features
        text_vec = TF.dense(long, folded.select(id_col, "label", "fold"), size, id_col, "tvec")
        joint = cut_lineage(text_vec.join(media, id_col).select(id_col, "label", "fold", F.concat("tvec", "mvec").alias("features")))
        tr, te = joint.filter(F.col("fold") != f), joint.filter(F.col("fold") == f)
        classes = {r["label"] for r in te.select("label").distinct().collect()}  # at most two rows
        if len(classes) < 2:
            return Row(fold=f, auroc=0.5, tpr=fpr_budget_pct / 100.0)
        dim = size + width
        tr, te = _project(tr, te, min(pca_dim, dim) if pca_dim else None, "features")
        p = fit_predict(model_type, tr, te, "features", "label", MEDIA_STACK, id_col=id_col)
        rep = M.roc_report(p, "proba", "label", fpr_budgets_pct=[fpr_budget_pct]).first()
        return Row(fold=f, auroc=float(rep["auroc"]), tpr=float(rep[f"tpr_at_{M._pct_name(fpr_budget_pct)}fpr"]))

    rows = at_once(one, range(k))  # a fold is many short jobs and independent of the others
    folded.unpersist()
    tf.unpersist()
    return spark.createDataFrame(rows, "fold int, auroc double, tpr double")
