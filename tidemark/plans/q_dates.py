"""Queries for the date detectors (H01–H05) and the ROC point table of H44."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import dates as D
from tidemark.operators import metrics as M
from tidemark.plans import views as V
from tidemark.plans.catalog import cite_text, query
from tidemark.plans.sqlkit import CITE_TEXT, CORPUS, auroc_ctes, roc_ctes, tpr_at_cte
from tidemark.sources.tables import table

# The driver's 4-digit runs are arbitrary digits, so the driver queries use a
# cutoff inside their range; real cutoffs are tested on hand-made rows.
DRIVER_CUTOFF = 5000

_MAX_YEAR_SQL = "list_max(list_transform(regexp_extract_all(text, '[0-9]{4}', 0), lambda s: CAST(s AS INTEGER)))"


@query(
    "h01_max_year",
    f"SELECT doc_id, CAST(coalesce({_MAX_YEAR_SQL}, -1) AS BIGINT) AS max_year FROM documents",
)
def h01(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.coalesce(D.max_year("text"), F.lit(-1)).alias("max_year"))


def _preds_sql(year_expr: str, cutoff: int, src: str = "corpus") -> str:
    return (
        f"preds AS (SELECT doc_id, label, y AS max_year, CASE WHEN y < {cutoff} THEN 1 ELSE 0 END AS pred, "
        f"CASE WHEN y IS NULL THEN 0.5 WHEN y < {cutoff} THEN 1.0 ELSE 0.0 END AS proba "
        f"FROM (SELECT doc_id, label, {year_expr} AS y FROM {src}))"
    )


def _report_sql(prefix_ctes: str) -> str:
    return (
        f"WITH {prefix_ctes}, {auroc_ctes('auc', 'preds', 'proba', 'label')}, "
        f"{roc_ctes('pts', 'preds', 'proba', 'label')}, {tpr_at_cte('tpr', 'pts', 1.0, 'tpr_at_1fpr')} "
        "SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(CASE WHEN max_year IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
        "AS no_year_count, round(any_value(auc.auroc), 6) AS auroc, round(any_value(tpr.tpr_at_1fpr), 6) AS tpr_at_1fpr "
        "FROM preds, auc, tpr"
    )


@query("h02_date_detection", _report_sql(f"{CORPUS}, {_preds_sql(_MAX_YEAR_SQL, DRIVER_CUTOFF)}"))
def h02(spark, sf_dir):
    preds = D.date_detection(V.corpus(spark, sf_dir), cutoff=DRIVER_CUTOFF)
    return D.detection_report(preds, fpr_budget_pct=1.0)


@query(
    "h44_roc_points",
    f"WITH {CORPUS}, {_preds_sql(_MAX_YEAR_SQL, DRIVER_CUTOFF)}, {roc_ctes('pts', 'preds', 'proba', 'label')} "
    "SELECT threshold, fps, tps, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM pts",
)
def h44(spark, sf_dir):
    preds = D.date_detection(V.corpus(spark, sf_dir), cutoff=DRIVER_CUTOFF)
    return M.roc_points(preds, "proba", "label")


_CITE_YEAR_SQL = (
    "coalesce(list_max(list_transform("
    "list_filter(flatten(list_transform(regexp_extract_all(text, '\\\\cite[p|t]?\\{([^}]*)', 1), "
    "lambda b: string_split(b, ','))), lambda k: ltrim(k, ' ' || chr(9) || chr(10) || chr(13)) <> ''), "
    "lambda k: CASE WHEN len(regexp_extract_all(k, '[0-9]+', 0)) = 1 AND ("
    "(length(regexp_extract_all(k, '[0-9]+', 0)[1]) = 2 AND ("
    "CAST(regexp_extract_all(k, '[0-9]+', 0)[1] AS INTEGER) BETWEEN 0 AND 23 OR "
    "CAST(regexp_extract_all(k, '[0-9]+', 0)[1] AS INTEGER) BETWEEN 70 AND 99)) OR "
    "(length(regexp_extract_all(k, '[0-9]+', 0)[1]) = 4 AND "
    "CAST(regexp_extract_all(k, '[0-9]+', 0)[1] AS INTEGER) BETWEEN 1970 AND 2023)) "
    "THEN (CASE WHEN CAST(regexp_extract_all(k, '[0-9]+', 0)[1] AS INTEGER) <= 23 "
    "THEN 2000 + CAST(regexp_extract_all(k, '[0-9]+', 0)[1] AS INTEGER) "
    "WHEN CAST(regexp_extract_all(k, '[0-9]+', 0)[1] AS INTEGER) <= 99 "
    "THEN 1900 + CAST(regexp_extract_all(k, '[0-9]+', 0)[1] AS INTEGER) "
    "ELSE CAST(regexp_extract_all(k, '[0-9]+', 0)[1] AS INTEGER) END) ELSE 9999 END)), 9999)"
)


@query("h03_cite_years", f"WITH {CORPUS}, {CITE_TEXT} SELECT doc_id, CAST({_CITE_YEAR_SQL} AS BIGINT) AS cite_year FROM cited")
def h03(spark, sf_dir):
    docs = cite_text(V.corpus(spark, sf_dir))
    return docs.select("doc_id", D.cite_year("text").alias("cite_year"))


@query(
    "h04_cite_year_sweep",
    f"WITH {CORPUS}, {CITE_TEXT}, yrs AS (SELECT label, {_CITE_YEAR_SQL} AS y FROM cited), "
    "sweep AS (SELECT t, 100.0 * avg(CASE WHEN y < t THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 1) AS tpr, "
    "100.0 * avg(CASE WHEN y < t THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 0) AS fpr "
    "FROM range(1990, 2023) r(t), yrs GROUP BY t) "
    "SELECT CAST(t AS BIGINT) AS t, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, "
    "coalesce(t = (SELECT max(t) FROM sweep WHERE fpr <= 1.0), false) AS selected FROM sweep",
)
def h04(spark, sf_dir):
    docs = cite_text(V.corpus(spark, sf_dir)).select("label", D.cite_year("text").alias("cite_year"))
    return D.cite_year_sweep(docs, fpr_budget_pct=1.0)


_CITE_SPAN_SQL = (
    "list_max(list_transform(flatten(list_transform(regexp_extract_all(text, 'cite\\{.+\\}', 0), "
    "lambda s: regexp_extract_all(s, '[0-9]{4}', 0))), lambda s: CAST(s AS INTEGER)))"
)


@query(
    "h05_cite_date_detection",
    _report_sql(f"{CORPUS}, {CITE_TEXT}, {_preds_sql(_CITE_SPAN_SQL, D.ARXIV_CUTOFF, 'cited')}"),
)
def h05(spark, sf_dir):
    docs = cite_text(V.corpus(spark, sf_dir))
    preds = D.cite_date_detection(docs, cutoff=D.ARXIV_CUTOFF)
    return D.detection_report(preds, fpr_budget_pct=1.0)
