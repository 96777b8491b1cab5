"""The texts of a sample in one row: what its neighbours share is tokenised and counted once.

Every text of a sample (L01, E02) is a perturbed side and a side that stays the same, joined by a space, so its tokens
are those of the two sides one after the other. A row holds all neighbours of a sample and its original texts; a few
dozen texts at most, as neighbours are a fixed number a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import tokens

ROWS = 64  # samples that a task holds as Python objects at once
SIDES = ("input", "answer")


def _toks(text: Column) -> Column:
    return tokens(F.lower(F.coalesce(text, F.lit(""))))


def by_sample(samples: DataFrame, nbrs: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """``(id, sides array<struct<input, answer>>, heads array<struct<k, t>>)`` of lower-cased tokens, one row per id.

    An id that comes in several samples has several sides; ``heads`` is null where no neighbour has the id.
    """
    sides = samples.select(id_col, *SIDES).groupBy(id_col).agg(F.collect_list(F.struct(*SIDES)).alias("sides"))
    heads = nbrs.groupBy(id_col).agg(F.collect_list(F.struct("k", "neighbor")).alias("heads"))
    return sides.join(heads, id_col, "left").select(
        id_col,
        F.transform("sides", lambda s: F.struct(_toks(s["input"]).alias("input"), _toks(s["answer"]).alias("answer"))).alias("sides"),
        F.transform("heads", lambda h: F.struct(h["k"].cast("long").alias("k"), _toks(h["neighbor"]).alias("t"))).alias("heads"))


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list, list]]:
    """Ids, sides and heads of a few samples at a time."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            lot = b.slice(at, ROWS)
            yield lot.column(0), lot.column(1).to_pylist(), lot.column(2).to_pylist()


def texts_of(sides: list[dict], heads: list[dict] | None, user_answer: bool) -> Iterator[tuple[dict, list[tuple[int, list[str]]]]]:
    """Per side ``(fixed tokens, [(k, perturbed tokens)…])``; the original has ``k = -1``."""
    fixed, free = SIDES if user_answer else SIDES[::-1]
    own = [(h["k"], h["t"]) for h in heads or ()]
    for s in sides:
        yield s[fixed], [(-1, s[free]), *own]
