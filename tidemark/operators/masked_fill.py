"""Substitution neighbours filled one mask at a time (N08 in rounds).

Every neighbour of every sample is one row that holds its present tokens. A
round masks one content token of each row that has rounds left, fills it, and
splits the result again, so a later round sees what earlier ones put in and
may mask it anew. All rows with rounds left take a round together: there are as
many rounds as the largest mask count (at most 40), each one Spark job whose
result goes to the checkpoint folder; a row that is done is not read again.

The filler is the corpus context model, or any loaded model: a function that
returns a filler from texts with one mask to replacement strings. It is loaded
once for each task and fed Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import ASCII_PUNCT_CLASS, tokens
from tidemark.operators import neighbors as N
from tidemark.session import cut_lineage, stored

MASK = "<extra_id_0>"  # fixed value: the mask token of the reference's filler
Filler = Callable[[pd.Series], "list[str]"]


def _place(seed: int, id_col: str) -> Column:
    """The content position that comes first in the hash order of this round; null without content tokens."""
    content = F.filter(F.transform("toks", lambda t, i: F.when(~t.rlike(ASCII_PUNCT_CLASS), i)), lambda i: i.isNotNull())
    order = F.transform(content, lambda i: F.struct(N._hash(seed, id_col, "substitution", F.col("j"), F.col("r"), i).alias("h"), i.alias("i")))
    return F.array_min(order)["i"]


def _model_fill(masked: DataFrame, model: tuple) -> DataFrame:
    """``masked`` with ``fill`` from the context tables; only distinct contexts are looked up."""
    fills = N.context_fills(masked.select("left", "right").distinct(), model)
    return masked.join(fills, F.col("left").eqNullSafe(F.col("_l")) & F.col("right").eqNullSafe(F.col("_r"))).drop("_l", "_r")


def _loaded_fill(masked: DataFrame, load: Callable[[], Filler], mask: str) -> DataFrame:
    """``masked`` with ``fill`` from a loaded filler, which sees the whole masked text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        filler = load()
        for texts in batches:
            yield pd.Series(list(filler(texts)), dtype="object")

    text = F.array_join(F.transform("toks", lambda t, i: F.when(i == F.col("pos"), F.lit(mask)).otherwise(t)), " ")
    return masked.withColumn("fill", run(text))


def substitution_rounds(prep: DataFrame, n_each: int = N.N_NEIGHBORS // 4, seed: int = N.SEED, id_col: str = "sample_id",
                        model: tuple | None = None, load: Callable[[], Filler] | None = None, mask: str = MASK) -> DataFrame:
    """``(id, kind, j, neighbor)``, each of the ``m`` masks of a neighbour filled before the next is chosen.

    ``prep``: :func:`tidemark.operators.neighbors.prepare`. With ``load`` the loaded filler takes the place of the context
    model; a null fill counts as empty, an empty one removes the token, and one of several words is split like any text.
    Samples with masks but without a content token have no neighbours; should fills leave a row without content
    tokens, it stays as it is. Samples without masks keep their tokens.
    """
    masks = F.greatest(F.col("m"), F.lit(0))
    rows = prep.filter((F.col("n_content") > 0) | (F.col("m") <= 0)).select(
        id_col, F.explode(F.sequence(F.lit(0), F.lit(n_each - 1))).alias("j"), F.col("tokens").alias("toks"), masks.alias("m"))
    if load is None:
        model = tuple(cut_lineage(t) for t in (model or N.context_model(prep)))  # read again in every round
    rounds = prep.agg(F.max("m")).first()[0] or 0
    keep = [id_col, "j", "toks"]

    def placed(rows: DataFrame, r: int) -> DataFrame:
        """The rows with the place that round ``r`` masks, null in those that are done; found once, as it hashes every token."""
        here = rows.withColumn("r", F.lit(r)).withColumn("pos", F.when(F.col("m") >= r, _place(seed, id_col))).drop("r")
        return stored(here.withColumn("left", F.when(F.col("pos") > 0, F.get("toks", F.col("pos") - 1))).withColumn(
            "right", F.get("toks", F.col("pos") + 1)))

    here, done = placed(rows, 1), []
    for r in range(1, rounds + 1):
        done.append(here.filter(F.col("pos").isNull()).select(*keep))  # no later round changes these
        turn = here.filter(F.col("pos").isNotNull())
        filled = _model_fill(turn, model) if load is None else _loaded_fill(turn, load, mask)
        put = F.flatten(F.transform("toks", lambda t, i: F.when(i == F.col("pos"), tokens(F.coalesce("fill", F.lit("")))).otherwise(F.array(t))))
        here = placed(filled.withColumn("toks", put).select(*keep, "m"), r + 1)
    rows = here.select(*keep)
    for part in done:
        rows = rows.unionByName(part)
    return rows.select(id_col, F.lit("substitution").alias("kind"), "j", F.array_join("toks", " ").alias("neighbor"))
