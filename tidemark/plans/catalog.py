"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (through :mod:`tidemark.plans.views`) and
runs over whole tables and whole texts. Matching DuckDB SQL lives in
:mod:`tidemark.plans.oracle` under the same key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.tidy import tidy

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``sql`` is its DuckDB oracle (omitted for non-SQL operators)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        REGISTRY[name].__doc__ = fn.__doc__
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def all_queries() -> dict[str, QueryFn]:
    # importing the modules registers their queries
    from tidemark.plans import q_dates, q_metrics, q_sources  # noqa: F401
    from tidemark.plans import q_attack, q_greedy, q_text  # noqa: F401
    from tidemark.plans import q_pipeline  # noqa: F401
    from tidemark.plans import q_media, q_model  # noqa: F401

    return dict(sorted(REGISTRY.items()))


def _plus_zero(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)`` so a rounded -0.0 prints as 0.0, as Spark's does."""
    out, i, n = [], 0, len(sql)
    while i < n:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                break
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        out.append(sql[i:j])
        depth, k, quote = 0, j + 5, False
        while k < n:
            ch = sql[k]
            if ch == "'":
                quote = not quote
            elif not quote and ch == "(":
                depth += 1
            elif not quote and ch == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append("(round(" + _plus_zero(sql[j + 6:k]) + ") + CAST(0 AS DOUBLE))")
        i = k + 1
    return "".join(out)


def all_oracle_sql() -> dict[str, str]:
    all_queries()
    return {k: _plus_zero(v) for k, v in sorted(ORACLE.items())}


def cite_text(df: DataFrame) -> DataFrame:
    """Documents with a citation command appended, built from their own columns."""
    return df.withColumn(
        "text",
        F.concat(
            F.col("text"),
            F.lit(" \\citep{"),
            F.col("lang"),
            F.pmod(F.col("n_chars"), F.lit(100)).cast("string"),
            F.lit(", "),
            F.col("lang"),
            (F.lit(1960) + F.pmod(F.col("doc_id"), F.lit(70))).cast("string"),
            F.lit("}"),
        ),
    )
