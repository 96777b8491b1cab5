"""Bag-of-words features (H06–H09) in long form ``(id, idx, value)``.

Terms are counted per document with a map-side combined ``groupBy``; the
vocabulary is the top ``max_features`` terms by total count in the training
rows (count desc, term asc), indexed alphabetically as a dense vector would
be. A bounded vocabulary is broadcast; an unbounded one is joined normally.
"""

from __future__ import annotations

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import terms
from tidemark.operators.running import running_totals
from tidemark.session import stored


def term_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, term, tf)`` for every term of every document."""
    return (
        docs.select(id_col, F.explode(terms(text)).alias("term"))
        .groupBy(id_col, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def vocab(tf: DataFrame, max_features: int | None = None) -> DataFrame:
    """``(term, count, df, idx)`` over the given (training) term counts."""
    totals = tf.groupBy("term").agg(F.sum("tf").alias("count"), F.count(F.lit(1)).alias("df"))
    if max_features is not None:
        top = totals.orderBy(F.col("count").desc(), F.col("term").asc()).limit(max_features)
        # at most max_features rows: an unpartitioned window is bounded
        return top.withColumn("idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))
    ranked = running_totals(totals.withColumn("_one", F.lit(1).cast("long")), [], [F.col("term").asc()], ["_one"])
    return ranked.select("term", "count", "df", (F.col("cum__one") - 1).cast("int").alias("idx"))


def _vocab_side(voc: DataFrame, bounded: bool) -> DataFrame:
    return F.broadcast(voc) if bounded else voc


def count_vectors(tf: DataFrame, voc: DataFrame, id_col: str = "doc_id", bounded: bool = True) -> DataFrame:
    """Non-zero entries ``(id, idx, value)`` of the count vectors."""
    return tf.join(_vocab_side(voc.select("term", "idx"), bounded), "term").select(
        id_col, "idx", F.col("tf").cast("double").alias("value")
    )


def idf_table(train_tf: DataFrame | None, voc: DataFrame, n_train_docs: DataFrame | int, bounded: bool = True) -> DataFrame:
    """Smoothed idf ``ln((1+n)/(1+df)) + 1`` from the training rows.

    Without ``train_tf`` the document counts are those of ``voc``, which was then fitted on the training rows.
    """
    if train_tf is None:
        df_ = voc.select("idx", "df")
    else:
        df_ = train_tf.join(_vocab_side(voc.select("term", "idx"), bounded), "term").groupBy("idx").agg(F.count(F.lit(1)).alias("df"))
    if isinstance(n_train_docs, int):
        n = F.lit(float(n_train_docs))
        return df_.select("idx", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    return df_.crossJoin(F.broadcast(n_train_docs.select(F.col("n").alias("_n")))).select(
        "idx", (F.log((1.0 + F.col("_n")) / (1.0 + F.col("df"))) + 1.0).alias("idf")
    )


def tfidf_vectors(counts: DataFrame, idf: DataFrame, id_col: str = "doc_id", bounded: bool = True) -> DataFrame:
    """L2-normalised tf·idf entries ``(id, idx, value)``."""
    raw = counts.join(_vocab_side(idf, bounded), "idx").select(
        id_col, "idx", (F.col("value") * F.col("idf")).alias("raw")
    )
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "idx", (F.col("raw") / norm).alias("value"))


def term_vectors(tf: DataFrame, train_ids: DataFrame, vectorizer: str = "tf", id_col: str = "doc_id") -> DataFrame:
    """H08/H09 over all terms of the training rows: ``(id, term, value)``, keyed by term, without an index.

    The vocabulary is a joined table of one row a term, never a list in a row or on the driver.
    """
    voc = tf.join(train_ids.select(id_col), id_col, "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = tf.join(voc, "term")
    if vectorizer == "count":
        return known.select(id_col, "term", F.col("tf").cast("double").alias("value"))
    if vectorizer != "tf":
        raise ValueError(f"unknown vectorizer {vectorizer!r}")
    n = train_ids.agg(F.count(F.lit(1)).alias("_n"))
    raw = known.crossJoin(F.broadcast(n)).select(
        id_col, "term", (F.col("tf") * (F.log((1.0 + F.col("_n")) / (1.0 + F.col("df"))) + 1.0)).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))  # a document's distinct terms
    return raw.select(id_col, "term", (F.col("raw") / norm).alias("value"))


def sparse(long: DataFrame, ids: DataFrame, size: int, id_col: str = "doc_id", out: str = "features") -> DataFrame:
    """ML vectors of ``size`` with the non-zero entries of each id alone (empty for ids without entries)."""
    agg = long.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("_e"))
    at = F.coalesce(F.col("_e.idx"), F.array().cast("array<int>"))
    values = F.coalesce(F.col("_e.value"), F.array().cast("array<double>"))
    vector = F.udf(lambda i, v: SparseVector(size, i, v), VectorUDT())
    return ids.join(agg, id_col, "left").withColumn(out, vector(at, values)).drop("_e")


def dense(long: DataFrame, ids: DataFrame, size: int, id_col: str = "doc_id", out: str = "features") -> DataFrame:
    """Dense ``array<double>`` of ``size`` per id (zeros for ids without entries); size is the bounded vocab."""
    agg = long.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("_m"))
    base = ids.join(agg, id_col, "left")
    if size <= 0:
        return base.select("*", F.array().cast("array<double>").alias(out)).drop("_m")
    vec = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(F.col("_m"), i), F.lit(0.0)))
    return base.select("*", F.when(F.col("_m").isNull(), F.array_repeat(F.lit(0.0), size)).otherwise(vec).alias(out)).drop("_m")


def fit_transform(
    docs: DataFrame,
    train_filter,
    max_features: int | None,
    vectorizer: str = "tf",
    id_col: str = "doc_id",
    text: str = "text",
    tf: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Vectorise all rows with a vocabulary (and idf) fitted on the training rows only.

    ``tf`` may carry precomputed term counts of ``docs`` (reused across folds); else they are counted and stored once,
    as the vocabulary and the entries read them. The vocabulary is stored too. Returns ``(long_entries, vocab)``.
    """
    tf = tf if tf is not None else stored(term_counts(docs, id_col, text))
    train_ids = docs.filter(train_filter).select(id_col)
    train_tf = tf.join(train_ids, id_col, "left_semi")
    voc = stored(vocab(train_tf, max_features))
    bounded = max_features is not None
    counts = count_vectors(tf, voc, id_col, bounded)
    if vectorizer == "count":
        return counts, voc
    if vectorizer != "tf":
        raise ValueError(f"unknown vectorizer {vectorizer!r}")
    n = train_ids.agg(F.count(F.lit(1)).alias("n"))
    idf = idf_table(None, voc, n, bounded)
    return tfidf_vectors(counts, idf, id_col, bounded), voc
