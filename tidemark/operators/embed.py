"""Text embeddings.

The embedder is pluggable: any Python callable mapping a pandas Series of
texts to equal-length vectors runs as an Arrow-batched iterator UDF (loaded
once per worker). The built-in default stays in the JVM: a signed hashed
bag of lower-cased tokens, summed with a map-side combined ``groupBy`` and
L2-normalised. Vectors are one aggregation per text with a sum for each bucket.
The embedding stage sums within the row of a sample, so no token is shuffled.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.arrays import let
from tidemark.functions.text import tokens
from tidemark.operators.sample_texts import by_sample, lots, texts_of

DIM = 64


def _bucket(tok: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def _sign(tok: Column) -> Column:
    bit = F.pmod(F.conv(F.substring(F.md5(tok), 9, 1), 16, 10).cast("int"), F.lit(2))
    return F.when(bit == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def hashed_embedding(df: DataFrame, id_cols: Sequence[str], text: str, dim: int = DIM) -> DataFrame:
    """E03 default: long form ``(ids…, dim, value)`` of the L2-normalised signed hashed bag of tokens."""
    ids = list(id_cols)
    toks = df.select(*ids, F.explode(tokens(F.lower(F.col(text)))).alias("tok"))
    summed = toks.groupBy(*ids, _bucket(F.col("tok"), dim).alias("dim")).agg(F.sum(_sign(F.col("tok"))).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*ids)))  # at most dim rows per text
    return summed.select(*ids, "dim", (F.col("raw") / norm).alias("value"))


def hashed_vectors(df: DataFrame, id_cols: Sequence[str], text: str, dim: int = DIM, out: str = "embeds") -> DataFrame:
    """E03 default as a dense ``array<double>`` per id; texts without tokens have no row."""
    ids = list(id_cols)
    toks = df.select(*ids, F.explode(tokens(F.lower(F.col(text)))).alias("tok"))
    coded = toks.select(*ids, _bucket(F.col("tok"), dim).alias("_b"), _sign(F.col("tok")).alias("_s"))
    sums = coded.groupBy(*ids).agg(*[F.sum(F.when(F.col("_b") == d, F.col("_s")).otherwise(0.0)).alias(f"_{d}") for d in range(dim)])
    raw = sums.select(*ids, F.array(*[f"_{d}" for d in range(dim)]).alias("_raw"))
    norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x * x))
    return raw.select(*ids, let(norm, lambda n: F.transform("_raw", lambda x: F.when(n > 0, x / n).otherwise(0.0))).alias(out))


def to_vectors(long: DataFrame, id_cols: Sequence[str], dim: int = DIM, out: str = "embeds") -> DataFrame:
    """Dense ``array<double>`` per id from long entries (missing buckets are 0)."""
    ids = list(id_cols)
    agg = long.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("_m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0)))
    return agg.select(*ids, vec.alias(out))


def plugin_embedding(df: DataFrame, text: str, embed_fn: Callable[[pd.Series], list], out: str = "embeds") -> DataFrame:
    """E03 plug-in: ``embed_fn`` (texts → vectors) runs per Arrow batch; one model load per worker."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([list(map(float, v)) for v in embed_fn(s)])

    return df.withColumn(out, run(F.col(text)))


def explode_neighbors(nbrs: DataFrame, id_col: str = "sample_id", media: DataFrame | None = None,
                      ignore_media: bool = False) -> DataFrame:
    """The neighbours that are embedded, ``(id, neighbor, k)`` and with ``media`` the ``path`` of each.

    ``media`` has a row per sample, ``(id, media_path, media_neighbors array<string>)``. A list that is not ignored and
    has one path per neighbour is zipped with the neighbours in the order of ``k``, repeats kept; any other sample (list
    null, of another length, or no row) keeps its distinct neighbours, each at its first ``k``, with the base path.
    """
    if media is None:
        return nbrs.groupBy(id_col, "neighbor").agg(F.min("k").alias("k"))
    # a sample has a fixed number of neighbours, so its list is short
    lists = nbrs.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("k", "neighbor"))).alias("_ns"))
    both = lists.join(media.select(id_col, "media_path", "media_neighbors"), id_col, "left")
    zipped = F.zip_with("_ns", "media_neighbors", lambda n, p: F.struct(n["neighbor"].alias("neighbor"), n["k"].alias("k"), p.alias("path")))
    names = F.transform("_ns", lambda n: n["neighbor"])
    first = F.filter("_ns", lambda n, i: F.array_position(names, n["neighbor"]) == i + 1)
    base = F.transform(first, lambda n: F.struct(n["neighbor"].alias("neighbor"), n["k"].alias("k"), F.col("media_path").alias("path")))
    aligned = F.lit(not ignore_media) & F.coalesce(F.size("media_neighbors") == F.size("_ns"), F.lit(False))
    return both.select(id_col, F.inline(F.when(aligned, zipped).otherwise(base)))


def compose_text(input_col: Column, answer_col: Column, neighbor_col: Column | None, user_answer: bool) -> Column:
    """The text that is embedded; a neighbour replaces the perturbed side."""
    if neighbor_col is None:
        return F.concat_ws(" ", input_col, answer_col)
    if user_answer:
        return F.concat_ws(" ", input_col, neighbor_col)
    return F.concat_ws(" ", neighbor_col, answer_col)


def _texts(samples: DataFrame, nbrs: DataFrame, user_answer: bool, id_col: str, specs: DataFrame | None = None) -> DataFrame:
    distinct = explode_neighbors(nbrs, id_col) if specs is None else specs.select(id_col, "neighbor", "k")
    s = samples.select(id_col, "input", "answer")
    nb = distinct.join(s, id_col).select(
        id_col, "k", compose_text(F.col("input"), F.col("answer"), F.col("neighbor"), user_answer).alias("text"))
    orig = s.select(id_col, F.lit(-1).alias("k"), compose_text(F.col("input"), F.col("answer"), None, user_answer)
                    .alias("text"))
    return nb.unionByName(orig)


@functools.lru_cache(maxsize=1 << 18)
def _code(tok: str) -> tuple[int, int]:
    """The number whose remainder is a token's bucket, and its sign: :func:`_bucket` and :func:`_sign` of one token."""
    h = hashlib.md5(tok.encode()).hexdigest()
    return int(h[:8], 16), -1 if int(h[8], 16) % 2 else 1


def _bag(toks: Sequence[str], dim: int) -> Counter:
    """Signed token count of every bucket that holds a token; a sum may be 0."""
    out: Counter = Counter()
    for t in toks:
        h, sign = _code(t)
        out[h % dim] += sign
    return out


def _sample_bags(sides: list[dict], heads: list[dict] | None, user_answer: bool, dim: int) -> dict[int, Counter]:
    """By ``k``: the bag of a sample's text; several texts of one ``k`` are added."""
    out: dict[int, Counter] = {}
    for fixed, texts in texts_of(sides, heads, user_answer):
        shared = _bag(fixed, dim)
        for k, free in texts:
            bag = out.setdefault(k, Counter())
            for part in (shared, _bag(free, dim)):
                for d, x in part.items():
                    bag[d] += x
    return {k: bag for k, bag in out.items() if bag}


def _bags(samples: DataFrame, nbrs: DataFrame, user_answer: bool, dim: int, id_col: str, specs: DataFrame | None = None,
          dense: bool = False) -> DataFrame:
    """``(id, k, dims, raw)``: the buckets in order (``dense``: all) and their sums, for every text of a sample that has a token."""
    embedded = explode_neighbors(nbrs, id_col) if specs is None else specs.select(id_col, "neighbor", "k")
    rows = by_sample(samples, embedded, id_col)
    out = T.StructType([T.StructField(id_col, samples.schema[id_col].dataType), T.StructField("k", embedded.schema["k"].dataType),
                        T.StructField("dims", T.ArrayType(T.IntegerType())), T.StructField("raw", T.ArrayType(T.DoubleType()))])
    k_type = pa.int32() if embedded.schema["k"].dataType == T.IntegerType() else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sides, heads in lots(batches):
            place, ks, dims, raw = [], [], [], []
            for i, (s, h) in enumerate(zip(sides, heads)):
                for k, bag in _sample_bags(s, h, user_answer, dim).items():
                    at = range(dim) if dense else sorted(bag)
                    place.append(i)
                    ks.append(k)
                    dims.append(at)
                    raw.append([float(bag[d]) for d in at])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(place, pa.int64())), pa.array(ks, k_type), pa.array(dims, pa.list_(pa.int32())),
                                              pa.array(raw, pa.list_(pa.float64()))], names=out.fieldNames())

    return rows.mapInArrow(run, out).withColumn("_norm", F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x)))


def embed_stage(samples: DataFrame, nbrs: DataFrame, user_answer: bool = False, dim: int = DIM,
                id_col: str = "sample_id") -> DataFrame:
    """Long embeddings ``(sample_id, k, dim, value)``; ``k = -1`` is the original sample."""
    bags = _bags(samples, nbrs, user_answer, dim, id_col)
    return bags.select(id_col, "k", "_norm", F.inline(F.arrays_zip("dims", "raw"))).select(
        id_col, "k", F.col("dims").alias("dim"), (F.col("raw") / F.col("_norm")).alias("value"))


def embed_vectors(samples: DataFrame, nbrs: DataFrame, user_answer: bool = False, dim: int = DIM,
                  id_col: str = "sample_id", specs: DataFrame | None = None) -> DataFrame:
    """E05 as dense vectors ``(sample_id, k, embeds)``; texts without tokens have no row, as in the long form.

    ``specs`` are the neighbours to embed where they are aligned with media (:func:`explode_neighbors`).
    """
    bags = _bags(samples, nbrs, user_answer, dim, id_col, specs, dense=True)
    return bags.select(id_col, "k", F.transform("raw", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(0.0)).alias("embeds"))


def media_vectors(specs: DataFrame, media: DataFrame, vectors: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """E04 / E05 for media: ``(id, k, embeds)`` of every neighbour's path and, at ``k = -1``, of the sample's own.

    ``vectors`` is ``(path, vector)`` with one row per distinct path, so a path that many neighbours share is
    embedded once. A path that is null or has no vector gives a null ``embeds``.
    """
    asked = specs.select(id_col, "k", "path").unionByName(media.select(id_col, F.lit(-1).alias("k"), F.col("media_path").alias("path")))
    return asked.join(vectors.select("path", F.col("vector").alias("embeds")), "path", "left").select(id_col, "k", "embeds")
