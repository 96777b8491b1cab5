"""Scores and ranking metrics.

ROC points follow the usual convention: one point per distinct score in
descending order, collinear interior points dropped, then the origin
prepended with threshold +inf. AUROC is computed exactly from per-score class
counts (ties count one half), which equals the trapezoid over the ROC points.
All ordered work goes through :func:`running_totals`; no window without a
partition ever sees data-sized input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import argmax2, softmax
from tidemark.operators.running import running_totals


def _join_totals(df: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return df.join(totals, list(by))
    # one-row aggregate: trivially bounded
    return df.crossJoin(F.broadcast(totals))


# --------------------------------------------------------------------------- R01–R03
def neighbor_probs(df: DataFrame, logits: str = "score") -> DataFrame:
    """R01 + R02: softmax probabilities and the argmax class of two logits."""
    p = softmax(logits)
    return df.withColumn("_p", p).withColumn("p0", F.col("_p")[0]).withColumn("p1", F.col("_p")[1]).withColumn(
        "pred", argmax2("_p")
    ).drop("_p")


def sample_scores(
    df: DataFrame, keys: Sequence[str], logits: str = "score", label: str = "label"
) -> DataFrame:
    """Per ``(keys, label)`` the mean P(class 1) over the sample's neighbours.

    ``|max p - 1 + argmax p|`` is P(class 1) for two classes, so the mean of
    ``p1`` is the reference sample score. Also returns neighbour counts and
    how many neighbour predictions equal the label (for R09).
    """
    probs = neighbor_probs(df, logits)
    return probs.groupBy(*keys, label).agg(
        F.avg("p1").alias("sample_score"),
        F.count(F.lit(1)).alias("n_neighbors"),
        F.sum(F.when(F.col("pred") == F.col(label), 1).otherwise(0)).cast("long").alias("n_correct"),
    )


# --------------------------------------------------------------------------- R04–R08
def score_counts(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Positive / negative counts per distinct score (map-side combined)."""
    is_pos = F.col(label) == 1
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(is_pos, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(is_pos, 0).otherwise(1)).cast("long").alias("neg"),
    )


def _desc_run(df: DataFrame, score: str, label: str, by: Sequence[str]):
    """Per-score counts with running totals in descending score order, plus group totals.

    The counts (one row per distinct score and group) are persisted so the
    size check, the running totals and the group totals read the source once.
    """
    from pyspark import StorageLevel

    counts = score_counts(df, score, label, by).withColumn("one", F.lit(1).cast("long")).persist(
        StorageLevel.MEMORY_AND_DISK)
    run = running_totals(counts, by, [F.col("score").desc()], ["pos", "neg", "one"])
    totals = counts.groupBy(*by).agg(
        F.sum("pos").alias("_P"), F.sum("neg").alias("_N"), F.count(F.lit(1)).alias("_n_pts")
    )
    return _join_totals(run, totals, by), totals


def _curve(run: DataFrame, totals: DataFrame, by: Sequence[str], drop_intermediate: bool) -> DataFrame:
    by = list(by)
    pts = run
    if drop_intermediate:
        nxt = run.select(
            *by,
            (F.col("cum_one") - 1).alias("cum_one"),
            F.col("pos").alias("_next_pos"),
            F.col("neg").alias("_next_neg"),
        )
        pts = pts.join(nxt, [*by, "cum_one"], "left")
        keep = (
            (F.col("cum_one") == 1)
            | (F.col("cum_one") == F.col("_n_pts"))
            | (F.col("_n_pts") <= 2)
            | (F.col("_next_pos") != F.col("pos"))
            | (F.col("_next_neg") != F.col("neg"))
        )
        pts = pts.filter(keep)
    curve = pts.select(
        *by,
        F.col("score").alias("threshold"),
        F.col("cum_neg").alias("fps"),
        F.col("cum_pos").alias("tps"),
        (F.col("cum_neg") / F.col("_N")).alias("fpr"),
        (F.col("cum_pos") / F.col("_P")).alias("tpr"),
    )
    origin = totals.select(
        *by,
        F.lit(float("inf")).alias("threshold"),
        F.lit(0).cast("long").alias("fps"),
        F.lit(0).cast("long").alias("tps"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return curve.unionByName(origin)


def roc_points(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    by: Sequence[str] = (),
    drop_intermediate: bool = True,
) -> DataFrame:
    """ROC curve points ``(by…, threshold, fps, tps, fpr, tpr)``."""
    run, totals = _desc_run(df, score, label, by)
    return _curve(run, totals, by, drop_intermediate)


def _auc_from_run(run: DataFrame, by: Sequence[str]) -> DataFrame:
    # negatives strictly below score_i = N - cum_neg_i (descending order); ties count one half
    below = F.col("_N").cast("double") - F.col("cum_neg").cast("double")
    num = F.col("pos").cast("double") * (below + 0.5 * F.col("neg").cast("double"))
    agg = run.groupBy(*by).agg(F.sum(num).alias("_num"), F.first("_P").alias("n_pos"), F.first("_N").alias("n_neg"))
    return agg.select(
        *by,
        (F.col("_num") / (F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))).alias("auroc"),
        "n_pos",
        "n_neg",
    )


def auroc(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve per group, ties counted one half."""
    run, _ = _desc_run(df, score, label, by)
    return _auc_from_run(run, by)


def tpr_at_fpr(points: DataFrame, fpr_budget_pct: float, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """TPR linearly interpolated at FPR = budget/100 (last point at a repeated FPR)."""
    x = float(fpr_budget_pct) / 100.0
    le = F.col("fpr") <= F.lit(x)
    agg = points.groupBy(*by).agg(
        F.max(F.when(le, F.col("fpr"))).alias("_fl"),
        F.max(F.when(le, F.col("tpr"))).alias("_tl"),
        F.min(F.when(~le, F.col("fpr"))).alias("_fr"),
        F.min(F.when(~le, F.col("tpr"))).alias("_tr"),
    )
    val = F.when(F.col("_fr").isNull(), F.col("_tl")).otherwise(
        F.col("_tl") + (F.col("_tr") - F.col("_tl")) * (F.lit(x) - F.col("_fl")) / (F.col("_fr") - F.col("_fl"))
    )
    return agg.select(*by, val.alias(name or f"tpr_at_{_pct_name(fpr_budget_pct)}fpr"))


def _pct_name(p: float) -> str:
    return str(int(p)) if float(p).is_integer() else str(p).replace(".", "_")


def fpr95_tpr05(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """R06 + R07: FPR at the first point with TPR ≥ .95, TPR at the last point with FPR ≤ .05."""
    return points.groupBy(*by).agg(
        F.min(F.when(F.col("tpr") >= 0.95, F.col("fpr"))).alias("fpr95"),
        F.max(F.when(F.col("fpr") <= 0.05, F.col("tpr"))).alias("tpr05"),
    )


# --------------------------------------------------------------------------- R09–R13
def accuracy(df: DataFrame, pred: Column | str, label: str = "label", by: Sequence[str] = (), name: str = "acc"):
    """Share of rows whose prediction equals the label."""
    p = F.col(pred) if isinstance(pred, str) else pred
    return df.groupBy(*by).agg(F.avg(F.when(p == F.col(label), 1.0).otherwise(0.0)).alias(name))


def classification_report(
    df: DataFrame,
    label: str = "label",
    pred: str = "pred",
    target_names: Sequence[str] = ("non-member", "member"),
    by: Sequence[str] = (),
) -> DataFrame:
    """Precision / recall / f1 / support per class plus accuracy, macro and weighted rows.

    Long form ``(by…, row, metric, value)``; undefined ratios are 0 as in the
    common report convention.
    """
    by = list(by)
    y, p = F.col(label), F.col(pred)
    c = df.groupBy(*by).agg(
        F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).cast("double").alias("tp1"),
        F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).cast("double").alias("fp1"),
        F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).cast("double").alias("fn1"),
        F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).cast("double").alias("tp0"),
    )

    def safe(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    def f1(pr: Column, rc: Column) -> Column:
        return F.when(pr + rc == 0, F.lit(0.0)).otherwise(2 * pr * rc / (pr + rc))

    prec1, rec1 = safe(F.col("tp1"), F.col("tp1") + F.col("fp1")), safe(F.col("tp1"), F.col("tp1") + F.col("fn1"))
    # class 0: its true positives are tp0, its false positives are fn1, its false negatives are fp1
    prec0, rec0 = safe(F.col("tp0"), F.col("tp0") + F.col("fn1")), safe(F.col("tp0"), F.col("tp0") + F.col("fp1"))
    s1 = F.col("tp1") + F.col("fn1")
    s0 = F.col("tp0") + F.col("fp1")
    tot = s0 + s1
    m = c.select(
        *by,
        prec0.alias("p0"), rec0.alias("r0"), f1(prec0, rec0).alias("f0"), s0.alias("s0"),
        prec1.alias("p1"), rec1.alias("r1"), f1(prec1, rec1).alias("f1"), s1.alias("s1"),
        tot.alias("tot"), safe(F.col("tp0") + F.col("tp1"), tot).alias("acc"),
    )
    n0, n1 = target_names
    rows = []
    for cls, pc, rc, fc, sc in ((n0, "p0", "r0", "f0", "s0"), (n1, "p1", "r1", "f1", "s1")):
        rows += [(cls, "precision", F.col(pc)), (cls, "recall", F.col(rc)), (cls, "f1-score", F.col(fc)),
                 (cls, "support", F.col(sc))]
    rows += [("accuracy", "f1-score", F.col("acc")), ("accuracy", "support", F.col("tot"))]
    for metric, a, b in (("precision", "p0", "p1"), ("recall", "r0", "r1"), ("f1-score", "f0", "f1")):
        rows.append(("macro avg", metric, (F.col(a) + F.col(b)) / 2))
        rows.append(("weighted avg", metric, safe(F.col(a) * F.col("s0") + F.col(b) * F.col("s1"), F.col("tot"))))
    rows += [("macro avg", "support", F.col("tot")), ("weighted avg", "support", F.col("tot"))]
    stacked = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(mt).alias("metric"), v.cast("double").alias("value"))
                        for r, mt, v in rows])
    return m.select(*by, F.inline(stacked))


def roc_report(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    by: Sequence[str] = (),
    fpr_budgets_pct: Sequence[float] = (),
) -> DataFrame:
    """AUROC, FPR@95%TPR, TPR@5%FPR and interpolated TPR at each budget, one row per group.

    One running-totals pass feeds both the area and the curve; all curve
    summaries are a single aggregate.
    """
    by = list(by)
    run, totals = _desc_run(df, score, label, by)
    curve = _curve(run, totals, by, True)
    aggs = [
        F.min(F.when(F.col("tpr") >= 0.95, F.col("fpr"))).alias("fpr95"),
        F.max(F.when(F.col("fpr") <= 0.05, F.col("tpr"))).alias("tpr05"),
    ]
    finals = []
    for b in fpr_budgets_pct:
        x = float(b) / 100.0
        n = _pct_name(b)
        le = F.col("fpr") <= F.lit(x)
        aggs += [
            F.max(F.when(le, F.col("fpr"))).alias(f"_fl{n}"),
            F.max(F.when(le, F.col("tpr"))).alias(f"_tl{n}"),
            F.min(F.when(~le, F.col("fpr"))).alias(f"_fr{n}"),
            F.min(F.when(~le, F.col("tpr"))).alias(f"_tr{n}"),
        ]
        fl, tl, fr, tr = (F.col(f"_{p}{n}") for p in ("fl", "tl", "fr", "tr"))
        finals.append(
            F.when(fr.isNull(), tl).otherwise(tl + (tr - tl) * (F.lit(x) - fl) / (fr - fl)).alias(f"tpr_at_{n}fpr")
        )
    summary = curve.groupBy(*by).agg(*aggs).select(*by, "fpr95", "tpr05", *finals)
    auc = _auc_from_run(run, by)
    return auc.join(summary, by) if by else auc.crossJoin(summary)


def metrics_table(
    scores: DataFrame, score: str = "sample_score", label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """Auroc / fpr95 / tpr05 (numeric and ``x.x%`` text), accuracy of score > .5, per-neighbour accuracy."""
    by = list(by)
    rep = roc_report(scores, score, label, by)
    acc = scores.groupBy(*by).agg(
        F.avg(F.when((F.col(score) > 0.5).cast("int") == F.col(label), 1.0).otherwise(0.0)).alias("acc"),
        (F.sum("n_correct") / F.sum("n_neighbors")).alias("per_neighbors_acc"),
    )
    out = rep.join(acc, by) if by else rep.crossJoin(acc)
    for m in ("auroc", "fpr95", "tpr05"):
        out = out.withColumn(f"{m}_pct", F.format_string("%.1f%%", F.col(m) * 100))
    return out


def metrics_by_dataset(
    scores: DataFrame, score: str = "sample_score", label: str = "label", exclude_model_substring: str = "Giga"
) -> DataFrame:
    """R11 per ``ds_name`` pooling its models, leaving out model names holding a substring."""
    kept = scores.filter(~F.col("model_name").contains(exclude_model_substring))
    return metrics_table(kept, score, label, by=["ds_name"])


def fold_summary(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of per-fold metrics."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return df.groupBy(*by).agg(*aggs)
