"""Queries for scores and metrics (R01–R12) over neighbour predictions built from ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.plans import views as V
from tidemark.plans.catalog import query
from tidemark.plans.sqlkit import PROBS, SAMPLES, SCORED, auroc_ctes, fpr95_tpr05_cte, roc_ctes, tpr_at_cte

KEYS = ["ds_name", "model_name", "sample_id"]
_BASE = f"{SCORED}, {PROBS}"


def _samples(spark, sf_dir):
    return M.sample_scores(V.scored(spark, sf_dir), KEYS, "score", "label")


@query("r01_softmax", f"WITH {_BASE} SELECT vec_id, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM probs")
def r01(spark, sf_dir):
    return M.neighbor_probs(V.scored(spark, sf_dir)).select("vec_id", "p0", "p1")


@query("r02_neighbor_pred", f"WITH {_BASE} SELECT vec_id, CAST(pred AS BIGINT) AS pred FROM preds")
def r02(spark, sf_dir):
    return M.neighbor_probs(V.scored(spark, sf_dir)).select("vec_id", "pred")


@query(
    "r03_sample_score",
    f"WITH {_BASE}, {SAMPLES} SELECT ds_name, model_name, CAST(sample_id AS BIGINT) AS sample_id, "
    "CAST(label AS BIGINT) AS label, round(sample_score, 6) AS sample_score, CAST(n_neighbors AS BIGINT) AS n_neighbors, "
    "CAST(n_correct AS BIGINT) AS n_correct FROM samples",
)
def r03(spark, sf_dir):
    return _samples(spark, sf_dir)


@query(
    "r04_roc_curve",
    f"WITH {_BASE}, {SAMPLES}, {roc_ctes('pts', 'samples', 'sample_score', 'label')} "
    "SELECT round(threshold, 6) AS threshold, fps, tps, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM pts",
)
def r04(spark, sf_dir):
    return M.roc_points(_samples(spark, sf_dir), "sample_score", "label")


@query(
    "r05_auroc",
    f"WITH {_BASE}, {SAMPLES}, {auroc_ctes('auc', 'samples', 'sample_score', 'label', ['ds_name'])} "
    "SELECT ds_name, round(auroc, 6) AS auroc, n_pos, n_neg FROM auc",
)
def r05(spark, sf_dir):
    return M.auroc(_samples(spark, sf_dir), "sample_score", "label", by=["ds_name"])


@query(
    "r06_fpr_at_95tpr",
    f"WITH {_BASE}, {SAMPLES}, {roc_ctes('pts', 'samples', 'sample_score', 'label')}, {fpr95_tpr05_cte('m', 'pts')} "
    "SELECT round(fpr95, 6) AS fpr95 FROM m",
)
def r06(spark, sf_dir):
    return M.fpr95_tpr05(M.roc_points(_samples(spark, sf_dir), "sample_score", "label")).select("fpr95")


@query(
    "r07_tpr_at_5fpr",
    f"WITH {_BASE}, {SAMPLES}, {roc_ctes('pts', 'samples', 'sample_score', 'label', ['ds_name'])}, "
    f"{fpr95_tpr05_cte('m', 'pts', ['ds_name'])} SELECT ds_name, round(tpr05, 6) AS tpr05 FROM m",
)
def r07(spark, sf_dir):
    pts = M.roc_points(_samples(spark, sf_dir), "sample_score", "label", by=["ds_name"])
    return M.fpr95_tpr05(pts, ["ds_name"]).select("ds_name", "tpr05")


@query(
    "r08_tpr_at_budget",
    f"WITH {_BASE}, {SAMPLES}, {roc_ctes('pts', 'samples', 'sample_score', 'label')}, "
    f"{tpr_at_cte('t1', 'pts', 1.0, 'tpr_at_1fpr')}, {tpr_at_cte('t5', 'pts', 5.0, 'tpr_at_5fpr')}, "
    f"{tpr_at_cte('t10', 'pts', 10.0, 'tpr_at_10fpr')} "
    "SELECT round(tpr_at_1fpr, 6) AS tpr_at_1fpr, round(tpr_at_5fpr, 6) AS tpr_at_5fpr, "
    "round(tpr_at_10fpr, 6) AS tpr_at_10fpr FROM t1, t5, t10",
)
def r08(spark, sf_dir):
    pts = M.roc_points(_samples(spark, sf_dir), "sample_score", "label")
    out = M.tpr_at_fpr(pts, 1.0)
    for b in (5.0, 10.0):
        out = out.crossJoin(M.tpr_at_fpr(pts, b))
    return out


@query(
    "r09_accuracy",
    f"WITH {_BASE}, {SAMPLES} SELECT ds_name, round(avg(CASE WHEN CAST(sample_score > 0.5 AS INTEGER) = label "
    "THEN 1.0 ELSE 0.0 END), 6) AS acc, round(sum(n_correct) / sum(n_neighbors), 6) AS per_neighbors_acc "
    "FROM samples GROUP BY ds_name",
)
def r09(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return s.groupBy("ds_name").agg(
        F.avg(F.when((F.col("sample_score") > 0.5).cast("int") == F.col("label"), 1.0).otherwise(0.0)).alias("acc"),
        (F.sum("n_correct") / F.sum("n_neighbors")).alias("per_neighbors_acc"),
    )


_REPORT_SQL = """
c AS (SELECT CAST(sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp1,
             CAST(sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp1,
             CAST(sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn1,
             CAST(sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tp0 FROM preds),
pr AS (SELECT CASE WHEN tp0 + fn1 = 0 THEN 0.0 ELSE tp0 / (tp0 + fn1) END AS p0,
              CASE WHEN tp0 + fp1 = 0 THEN 0.0 ELSE tp0 / (tp0 + fp1) END AS r0,
              CASE WHEN tp1 + fp1 = 0 THEN 0.0 ELSE tp1 / (tp1 + fp1) END AS p1,
              CASE WHEN tp1 + fn1 = 0 THEN 0.0 ELSE tp1 / (tp1 + fn1) END AS r1,
              tp0 + fp1 AS s0, tp1 + fn1 AS s1, tp0 + tp1 + fp1 + fn1 AS tot, tp0 + tp1 AS hit FROM c),
m AS (SELECT *, CASE WHEN p0 + r0 = 0 THEN 0.0 ELSE 2 * p0 * r0 / (p0 + r0) END AS f0,
             CASE WHEN p1 + r1 = 0 THEN 0.0 ELSE 2 * p1 * r1 / (p1 + r1) END AS f1,
             CASE WHEN tot = 0 THEN 0.0 ELSE hit / tot END AS acc FROM pr),
rows AS (
  SELECT 'non-member' AS "row", 'precision' AS metric, p0 AS value FROM m UNION ALL
  SELECT 'non-member', 'recall', r0 FROM m UNION ALL SELECT 'non-member', 'f1-score', f0 FROM m UNION ALL
  SELECT 'non-member', 'support', s0 FROM m UNION ALL SELECT 'member', 'precision', p1 FROM m UNION ALL
  SELECT 'member', 'recall', r1 FROM m UNION ALL SELECT 'member', 'f1-score', f1 FROM m UNION ALL
  SELECT 'member', 'support', s1 FROM m UNION ALL SELECT 'accuracy', 'f1-score', acc FROM m UNION ALL
  SELECT 'accuracy', 'support', tot FROM m UNION ALL
  SELECT 'macro avg', 'precision', (p0 + p1) / 2 FROM m UNION ALL
  SELECT 'weighted avg', 'precision', CASE WHEN tot = 0 THEN 0.0 ELSE (p0 * s0 + p1 * s1) / tot END FROM m UNION ALL
  SELECT 'macro avg', 'recall', (r0 + r1) / 2 FROM m UNION ALL
  SELECT 'weighted avg', 'recall', CASE WHEN tot = 0 THEN 0.0 ELSE (r0 * s0 + r1 * s1) / tot END FROM m UNION ALL
  SELECT 'macro avg', 'f1-score', (f0 + f1) / 2 FROM m UNION ALL
  SELECT 'weighted avg', 'f1-score', CASE WHEN tot = 0 THEN 0.0 ELSE (f0 * s0 + f1 * s1) / tot END FROM m UNION ALL
  SELECT 'macro avg', 'support', tot FROM m UNION ALL SELECT 'weighted avg', 'support', tot FROM m)
SELECT "row", metric, round(value, 6) AS value FROM rows
"""


@query("r10_classification_report", f"WITH {_BASE}, {_REPORT_SQL}")
def r10(spark, sf_dir):
    return M.classification_report(M.neighbor_probs(V.scored(spark, sf_dir)), "label", "pred")


def _metrics_sql(by: list[str], where: str = "") -> str:
    g = ", ".join(by)
    gsel = g + ", " if by else ""
    join = f" USING ({g})" if by else ""
    src = f"(SELECT * FROM samples{where})"
    grp = f" GROUP BY {g}" if by else ""
    acc = (
        f"acc AS (SELECT {gsel}avg(CASE WHEN CAST(sample_score > 0.5 AS INTEGER) = label THEN 1.0 ELSE 0.0 END) AS acc, "
        f"sum(n_correct) / sum(n_neighbors) AS per_neighbors_acc FROM {src}{grp})"
    )
    ctes = (
        f"{_BASE}, {SAMPLES}, {auroc_ctes('auc', src, 'sample_score', 'label', by)}, "
        f"{roc_ctes('pts', src, 'sample_score', 'label', by)}, {fpr95_tpr05_cte('ft', 'pts', by)}, {acc}"
    )
    fr = f"auc JOIN ft{join} JOIN acc{join}" if by else "auc, ft, acc"
    cols = ", ".join(
        [f"round({m}, 6) AS {m}" for m in ("auroc", "fpr95", "tpr05", "acc", "per_neighbors_acc")]
        + [f"printf('%.1f%%', {m} * 100) AS {m}_pct" for m in ("auroc", "fpr95", "tpr05")]
    )
    return f"WITH {ctes} SELECT {gsel}{cols}, n_pos, n_neg FROM {fr}"


@query("r11_metrics_table", _metrics_sql([]))
def r11(spark, sf_dir):
    return M.metrics_table(_samples(spark, sf_dir))


@query("r12_metrics_by_dataset", _metrics_sql(["ds_name"], " WHERE model_name NOT LIKE '%Giga%'"))
def r12(spark, sf_dir):
    return M.metrics_by_dataset(_samples(spark, sf_dir))
