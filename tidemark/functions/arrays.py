"""Native array expressions (higher-order functions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(logits: Column | str) -> Column:
    """Numerically stable softmax of an ``array<double>``."""
    x = _c(logits).cast("array<double>")
    mx = F.array_max(x)
    ex = F.transform(x, lambda v: F.exp(v - mx))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / total)


def argmax2(probs: Column | str) -> Column:
    """Index of the larger of two entries; a tie gives 0 (first maximum)."""
    p = _c(probs)
    return F.when(p[1] > p[0], F.lit(1)).otherwise(F.lit(0))


def vec_sub(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def vec_dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v * v))


def linf_norm(a: Column | str) -> Column:
    return F.array_max(F.transform(_c(a), lambda v: F.abs(v)))


def round_array(a: Column | str, digits: int = 6) -> Column:
    return F.transform(_c(a), lambda v: F.round(v, digits))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column expression that a lambda refers to is otherwise computed again for every element.
    """
    return F.transform(F.array(value), body)[0]
