"""SQL text builders for the DuckDB oracle (ROC, AUROC, interpolated TPR).

The oracle is an independent, single-node statement of each query's meaning;
it favours plain window functions over scalability.
"""

from __future__ import annotations

from collections.abc import Sequence

# The view definitions shared by every oracle statement.
CORPUS = (
    "corpus AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(l.toxic AS INTEGER) AS label "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)
CORPUS_QUALITY = (
    "corpus AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(l.quality AS INTEGER) AS label "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)
SCORED = (
    "scored AS (SELECT vec_id, 'd' || CAST((vec_id // 6) % 3 AS VARCHAR) AS ds_name, "
    "CASE WHEN (vec_id // 6) % 4 = 3 THEN 'Giga-7b' ELSE 'm' || CAST((vec_id // 6) % 2 AS VARCHAR) END AS model_name, "
    "vec_id // 6 AS sample_id, CAST(label >= 5 AS INTEGER) AS label, "
    "[CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)] AS score FROM embeddings)"
)
PROBS = (
    "probs AS (SELECT *, exp(score[1] - greatest(score[1], score[2])) / (exp(score[1] - greatest(score[1], score[2])) "
    "+ exp(score[2] - greatest(score[1], score[2]))) AS p0, exp(score[2] - greatest(score[1], score[2])) / "
    "(exp(score[1] - greatest(score[1], score[2])) + exp(score[2] - greatest(score[1], score[2]))) AS p1 FROM scored), "
    "preds AS (SELECT *, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS pred FROM probs)"
)
SAMPLES = (
    "samples AS (SELECT ds_name, model_name, sample_id, label, avg(p1) AS sample_score, count(*) AS n_neighbors, "
    "sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS n_correct FROM preds GROUP BY ds_name, model_name, sample_id, label)"
)
CITE_TEXT = (
    "cited AS (SELECT doc_id, label, text || ' \\citep{' || lang || CAST(n_chars % 100 AS VARCHAR) || ', ' || lang "
    "|| CAST(1960 + doc_id % 70 AS VARCHAR) || '}' AS text FROM corpus)"
)


def _g(by: Sequence[str]) -> tuple[str, str, str]:
    g = ", ".join(by)
    return g, (g + ", " if by else ""), (f"PARTITION BY {g}" if by else "")


def roc_ctes(name: str, src: str, score: str, label: str, by: Sequence[str] = ()) -> str:
    g, gsel, part = _g(by)
    cnt = (
        f"{name}_cnt AS (SELECT {gsel}CAST({score} AS DOUBLE) AS score, "
        f"SUM(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS pos, SUM(CASE WHEN {label} = 1 THEN 0 ELSE 1 END) AS neg "
        f"FROM {src} GROUP BY {gsel}CAST({score} AS DOUBLE))"
    )
    w = f"OVER ({part} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    wo = f"OVER ({part} ORDER BY score DESC)"
    run = (
        f"{name}_run AS (SELECT *, SUM(pos) {w} AS tps, SUM(neg) {w} AS fps, ROW_NUMBER() {wo} AS i, "
        f"COUNT(*) OVER ({part}) AS n_pts, SUM(pos) OVER ({part}) AS tot_pos, SUM(neg) OVER ({part}) AS tot_neg, "
        f"LEAD(pos) {wo} AS npos, LEAD(neg) {wo} AS nneg FROM {name}_cnt)"
    )
    pts = (
        f"{name} AS (SELECT {gsel}score AS threshold, CAST(fps AS BIGINT) AS fps, CAST(tps AS BIGINT) AS tps, "
        f"CAST(fps AS DOUBLE) / CAST(tot_neg AS DOUBLE) AS fpr, CAST(tps AS DOUBLE) / CAST(tot_pos AS DOUBLE) AS tpr "
        f"FROM {name}_run WHERE i = 1 OR i = n_pts OR n_pts <= 2 OR npos <> pos OR nneg <> neg "
        f"UNION ALL SELECT DISTINCT {gsel}CAST('inf' AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0.0, 0.0 "
        f"FROM {name}_run)"
    )
    return ", ".join([cnt, run, pts])


def auroc_ctes(name: str, src: str, score: str, label: str, by: Sequence[str] = ()) -> str:
    g, gsel, part = _g(by)
    cnt = (
        f"{name}_cnt AS (SELECT {gsel}CAST({score} AS DOUBLE) AS score, "
        f"SUM(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS pos, SUM(CASE WHEN {label} = 1 THEN 0 ELSE 1 END) AS neg "
        f"FROM {src} GROUP BY {gsel}CAST({score} AS DOUBLE))"
    )
    w = f"OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    grp = f" GROUP BY {g}" if by else ""
    auc = (
        f"{name} AS (SELECT {gsel}SUM(CAST(pos AS DOUBLE) * (CAST(cum_neg AS DOUBLE) - 0.5 * CAST(neg AS DOUBLE))) "
        f"/ (CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE)) AS auroc, CAST(SUM(pos) AS BIGINT) AS n_pos, "
        f"CAST(SUM(neg) AS BIGINT) AS n_neg FROM (SELECT *, SUM(neg) {w} AS cum_neg FROM {name}_cnt){grp})"
    )
    return ", ".join([cnt, auc])


def tpr_at_cte(name: str, pts: str, budget_pct: float, col: str, by: Sequence[str] = ()) -> str:
    g, gsel, _ = _g(by)
    x = f"CAST({float(budget_pct) / 100.0!r} AS DOUBLE)"
    grp = f" GROUP BY {g}" if by else ""
    return (
        f"{name} AS (SELECT {gsel}CASE WHEN fr IS NULL THEN tl ELSE tl + (tr - tl) * ({x} - fl) / (fr - fl) END AS {col} "
        f"FROM (SELECT {gsel}max(fpr) FILTER (WHERE fpr <= {x}) AS fl, max(tpr) FILTER (WHERE fpr <= {x}) AS tl, "
        f"min(fpr) FILTER (WHERE fpr > {x}) AS fr, min(tpr) FILTER (WHERE fpr > {x}) AS tr FROM {pts}{grp}))"
    )


def fpr95_tpr05_cte(name: str, pts: str, by: Sequence[str] = ()) -> str:
    g, gsel, _ = _g(by)
    grp = f" GROUP BY {g}" if by else ""
    return (
        f"{name} AS (SELECT {gsel}min(fpr) FILTER (WHERE tpr >= 0.95) AS fpr95, "
        f"max(tpr) FILTER (WHERE fpr <= 0.05) AS tpr05 FROM {pts}{grp})"
    )


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"
