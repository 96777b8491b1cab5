"""Language-model loss of sample and neighbour pairs.

The scorer is pluggable (any callable on a pandas Series of texts, run as an
Arrow-batched UDF). The default scorer is a bigram language model trained in
Spark: unigram and bigram counts are ``groupBy`` aggregates of a corpus,
probabilities use add-α smoothing, and the loss of a text is the mean
negative log-probability of its lower-cased tokens. The counts are joined to
the distinct (previous, current) pairs of all texts, for any number of models
at once; one more join brings the costs back to the texts. The texts of a
sample differ in few tokens, so the loss stage joins each distinct pair of a
sample once, with the list of its texts that hold it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.arrays import let
from tidemark.functions.text import tokens
from tidemark.operators.sample_texts import by_sample, lots, texts_of
from tidemark.session import cut_lineage, stored

ALPHA = 1.0
#: Distinct token pairs up to which their cost table is broadcast (about 100 bytes a row).
BROADCAST_PAIRS = 500_000
# Chat role markers of the rendered conversation and token caps.
ROLE_MARKERS = {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"}
FIRST_TOKENS = 2048
LAST_TOKENS = 4096
ALL = -2  # stands for every text of a sample


def _toks(text: Column) -> Column:
    return tokens(F.lower(text))


def train_bigram_lm(corpus: DataFrame, text: str = "text") -> dict[str, DataFrame]:
    """Unigram / bigram counts and the corpus totals (token count, vocabulary size)."""
    t = corpus.select(_toks(F.col(text)).alias("t"))
    uni = t.select(F.explode("t").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("c"))
    pairs = t.select(F.explode(F.arrays_zip(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))),
                                            F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))))).alias("p"))
    bi = pairs.select(F.col("p")["0"].alias("prev"), F.col("p")["1"].alias("tok")).groupBy("prev", "tok").agg(
        F.count(F.lit(1)).alias("c"))
    totals = uni.agg(F.sum("c").alias("n_tokens"), F.count(F.lit(1)).alias("vocab"))
    return {"uni": uni, "bi": bi, "totals": totals}


def _pairs(df: DataFrame, ids: Sequence[str], text: str) -> DataFrame:
    """``(ids…, prev, tok)`` for every token, ``prev`` null for the first."""
    pairs = let(_toks(F.col(text)), lambda t: F.transform(t, lambda x, i: F.struct(
        F.when(i > 0, F.get(t, i - 1)).alias("prev"), x.alias("tok"))))
    return df.select(*ids, F.inline(pairs))


def _costs(pairs: DataFrame, models: Mapping[str, dict[str, DataFrame]], alpha: float) -> DataFrame:
    """``(prev, tok, model columns…)``: negative log-probability of each distinct pair under every model."""
    out = pairs.select("prev", "tok").distinct()
    a = F.lit(alpha)
    for name, lm in models.items():
        uni, bi = lm["uni"], lm["bi"]
        v = F.col("vocab").cast("double")
        p = F.when(F.col("prev").isNull(), (F.coalesce("c_tok", F.lit(0)) + a) / (F.col("n_tokens") + a * v)).otherwise(
            (F.coalesce("c_bi", F.lit(0)) + a) / (F.coalesce("c_prev", F.lit(0)) + a * v))
        kept = out.columns
        out = (out.join(bi.withColumnRenamed("c", "c_bi"), ["prev", "tok"], "left")
               .join(uni.select(F.col("tok").alias("prev"), F.col("c").alias("c_prev")), "prev", "left")
               .join(uni.select("tok", F.col("c").alias("c_tok")), "tok", "left")
               .crossJoin(F.broadcast(lm["totals"]))  # one-row totals
               .select(*kept, (-F.log(p)).alias(name)))
    return out


def score_losses(df: DataFrame, id_cols: Sequence[str], text: str, models: Mapping[str, dict[str, DataFrame]],
                 alpha: float = ALPHA, broadcast_rows: int = BROADCAST_PAIRS) -> DataFrame:
    """L02 for several models at once: ``(ids…, one loss column per model name)``.

    The table of distinct pairs is written once and counted; up to ``broadcast_rows`` rows it is broadcast, beyond that it
    is joined by shuffle, where adaptive execution splits the head pairs.
    """
    ids = list(id_cols)
    rows = _pairs(df, ids, text)
    joined, columns, _ = _with_costs(rows, models, alpha, broadcast_rows)
    return joined.groupBy(*ids).agg(*[F.avg(c).alias(n) for n, c in columns.items()])


def _with_costs(rows: DataFrame, models: Mapping[str, dict[str, DataFrame]], alpha: float,
                broadcast_rows: int) -> tuple[DataFrame, dict[str, str], bool]:
    """``rows`` (with ``prev, tok``) joined with a cost column per model, the columns, and whether the table was broadcast."""
    columns = {name: f"_loss_{i}" for i, name in enumerate(models)}
    costs = cut_lineage(_costs(rows, {columns[n]: lm for n, lm in models.items()}, alpha))
    small = costs.count() <= broadcast_rows
    if small:
        costs = F.broadcast(costs)
    costs = costs.withColumnsRenamed({"prev": "_prev", "tok": "_tok"})
    return rows.join(costs, (F.col("tok") == F.col("_tok")) & F.col("prev").eqNullSafe(F.col("_prev"))), columns, small


def score_loss(df: DataFrame, id_cols: Sequence[str], text: str, lm: dict[str, DataFrame],
               alpha: float = ALPHA) -> DataFrame:
    """L02 default: ``(ids…, loss)`` mean negative log-probability under the bigram model."""
    return score_losses(df, id_cols, text, {"loss": lm}, alpha)


def plugin_loss(df: DataFrame, text: str, score_fn: Callable[[pd.Series], Sequence[float]], out: str = "loss"):
    """L02 plug-in: ``score_fn`` (texts → losses) runs per Arrow batch, one model per worker."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([float(x) for x in score_fn(s)])

    return df.withColumn(out, run(F.col(text)))


def loss_pairs(samples: DataFrame, nbrs: DataFrame, user_answer: bool = False, id_col: str = "sample_id"):
    """The scored text of each neighbour (the perturbed side replaced) and of the original (``k = -1``)."""
    s = samples.select(id_col, "input", "answer")
    nb = nbrs.select(id_col, "k", "neighbor").join(s, id_col)
    if user_answer:
        nb_text = F.concat_ws(" ", F.col("input"), F.col("neighbor"))
    else:
        nb_text = F.concat_ws(" ", F.col("neighbor"), F.col("answer"))
    orig = s.select(id_col, F.lit(-1).alias("k"), F.concat_ws(" ", "input", "answer").alias("text"))
    return nb.select(id_col, "k", nb_text.alias("text")).unionByName(orig)


def _held_pairs(sides: list[dict], heads: list[dict] | None, user_answer: bool) -> dict[tuple[str | None, str], list[int]]:
    """The distinct ``(prev, tok)`` of a sample's texts, each with the ``k`` of every occurrence.

    Pairs inside the side that all texts share are listed once, at ``ALL``, where each ``k`` has one text a side. The
    first token of that side is listed for every text, so every text that has a token is listed somewhere.
    """
    at: dict[tuple[str | None, str], list[int]] = {}
    ks = [h["k"] for h in heads or ()]
    once = len(set(ks)) == len(ks)
    for fixed, texts in texts_of(sides, heads, user_answer):
        for k, free in texts:
            toks = [*fixed[-1:], *free] if user_answer else [*free, *fixed[:1]]
            first = (fixed or free)[:1] if user_answer else toks[:1]
            for pair in [*[(None, t) for t in first], *zip(toks, toks[1:])]:
                at.setdefault(pair, []).append(k)
        for pair in zip(fixed, fixed[1:]):
            at.setdefault(pair, []).extend([ALL] if once else [k for k, _ in texts])
    return at


def sample_pairs(samples: DataFrame, nbrs: DataFrame, user_answer: bool = False, id_col: str = "sample_id") -> DataFrame:
    """``(id, prev, tok, ks)``: each distinct token pair of a sample's texts (:func:`loss_pairs`) and the texts that hold it."""
    rows = by_sample(samples, nbrs, id_col)
    kind = samples.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), T.StructField("prev", T.StringType()), T.StructField("tok", T.StringType()),
                        T.StructField("ks", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sides, heads in lots(batches):
            place, prev, tok, ks = [], [], [], []
            for i, (s, h) in enumerate(zip(sides, heads)):
                held = _held_pairs(s, h, user_answer)
                place += [i] * len(held)
                prev += [p for p, _ in held]
                tok += [t for _, t in held]
                ks += held.values()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(place, pa.int64())), pa.array(prev, pa.string()), pa.array(tok, pa.string()),
                                              pa.array(ks, pa.list_(pa.int64()))], names=out.fieldNames())

    return rows.mapInArrow(run, out)


def loss_stages(samples: DataFrame, nbrs: DataFrame, models: Mapping[str, tuple[dict[str, DataFrame], int]],
                user_answer: bool = False, id_col: str = "sample_id", broadcast_rows: int = BROADCAST_PAIRS) -> DataFrame:
    """``(sample_id, k, model_name, label, neighbor_loss, input_loss)`` for every ``model_name: (model, label)``.

    All texts are scored for all models in one pass over the distinct token pairs of each sample; a text's loss is the
    mean over its own pairs and those that all texts of the sample share.
    """
    pairs = stored(sample_pairs(samples, nbrs, user_answer, id_col))
    joined, columns, small = _with_costs(pairs, {name: lm for name, (lm, _) in models.items()}, ALPHA, broadcast_rows)
    joined = joined.select(id_col, "ks", *columns.values())
    if not small:  # the lists travel back to their samples before they are laid out
        joined = joined.repartition(id_col)
    each = joined.select(id_col, F.explode("ks").alias("k"), *columns.values())
    sums = each.groupBy(id_col, "k").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in columns.values()])
    sample = Window.partitionBy(id_col)  # a row for each text
    shared = lambda c: F.coalesce(F.max(F.when(F.col("k") == ALL, F.col(c))).over(sample), F.lit(0))
    means = sums.select(id_col, "k", *[((F.col(c) + shared(c)) / (F.col("_n") + shared("_n"))).alias(c) for c in columns.values()])
    own = lambda c: F.max(F.when(F.col("k") == -1, F.col(c))).over(sample)
    scored = means.select(id_col, F.col("k").cast(nbrs.schema["k"].dataType).alias("k"), F.array(*[
        F.struct(F.lit(name).alias("model_name"), F.lit(int(label)).alias("label"), F.col(columns[name]).alias("neighbor_loss"),
                 own(columns[name]).alias("input_loss")) for name, (_, label) in models.items()]).alias("m"))
    return cut_lineage(scored.filter(F.col("k") >= 0)).select(id_col, "k", F.inline("m"))


def loss_stage(samples: DataFrame, nbrs: DataFrame, lm: dict[str, DataFrame], model_name: str, label: int,
               user_answer: bool = False, id_col: str = "sample_id") -> DataFrame:
    """L06 for one model and label."""
    return loss_stages(samples, nbrs, {model_name: (lm, label)}, user_answer, id_col)


def render_chat(system: Column | None, user: Column, assistant: Column) -> Column:
    """Role-marked conversation text; media placeholders become spaces."""
    parts = []
    if system is not None:
        parts += [F.lit(ROLE_MARKERS["system"]), system]
    parts += [F.lit(ROLE_MARKERS["user"]), user, F.lit(ROLE_MARKERS["assistant"]), assistant]
    text = F.concat_ws(" ", *parts)
    return F.regexp_replace(text, r"<(audio|video|image)>", " ")


def mask_prefix(toks: Column, marker: str = ROLE_MARKERS["assistant"]) -> Column:
    """Tokens after the last marker token (all tokens when no marker)."""
    def rest(t: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(t, lambda x, i: F.when(x == marker, i + 1).otherwise(F.lit(0)))), F.lit(0))
        return let(last, lambda n: F.when(n == 0, t).otherwise(F.slice(t, n + 1, F.greatest(F.size(t) - n, F.lit(0)))))

    return let(toks, rest)


def truncate_tokens(toks: Column, n: int, keep: str = "first") -> Column:
    """Keep the first ``n`` or the last ``n`` tokens."""
    if keep == "first":
        return F.slice(toks, 1, n)
    return F.when(F.size(toks) <= n, toks).otherwise(F.slice(toks, -n, n))


# --------------------------------------------------------------------------- L07
MEDIA_TYPES = ("image", "image_url", "video")


def media_refs(messages: DataFrame, id_cols: Sequence[str] = ("conv_id", "turn"),
               elements: str = "content") -> DataFrame:
    """Image / video references of chat messages in order, long form ``(ids…, pos, kind, ref)``.

    ``content`` is ``array<struct<type, text, image, video>>``; an element whose type is none of text, image,
    image_url, video is an error.
    """
    ids = list(id_cols)
    el = messages.select(*ids, F.posexplode(elements).alias("pos", "e"))
    t = F.col("e.type")
    bad = ~t.isin("text", *MEDIA_TYPES)
    # one predicate, so the type check sees every element before non-media ones are dropped
    media = el.filter(F.when(bad, F.raise_error(F.concat(F.lit("unsupported content type "), t)))
                      .otherwise(t.isin(*MEDIA_TYPES)))
    kind = F.when(t == "video", F.lit("video")).otherwise(F.lit("image"))
    return media.select(*ids, "pos", kind.alias("kind"),
                        F.when(t == "video", F.col("e.video")).otherwise(F.col("e.image")).alias("ref"))
