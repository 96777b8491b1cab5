"""Output normalisation shared by the registered queries.

Doubles are rounded to 6 decimals and small integers widened to bigint so the
Spark result and the DuckDB oracle compare value for value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        dt = f.dataType
        if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.DoubleType, T.FloatType)):
            c = F.transform(c, lambda v: F.round(v.cast("double"), digits))
        elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("array<bigint>")
        cols.append(c.alias(f.name))
    return df.select(*cols)
