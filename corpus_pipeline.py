"""Corpus preparation: the stages in order, each a function ``(spark, docs, sf_dir) -> DataFrame``.

Every stage works on all rows that the one before it kept. All but the last return the columns of ``documents``.
Null, empty and repeated rows, extra columns and empty tables pass as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe_table import encode
from tidemark.llm.decontam import without_copies
from tidemark.llm.langid import UNKNOWN, identify
from tidemark.llm.pfp_dedup import remove_repeats
from tidemark.llm.queries import read
from tidemark.llm.simhash import near_duplicates, row_name
from tidemark.llm.util import stored

#: Least share of the posterior that the predicted language of a text must have, and the characters from which it is asked for.
LEAST_SCORE, LEAST_CHARS = 0.5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: texts without a letter, null texts and longer texts of no clear language go.

    A text of under ``LEAST_CHARS`` characters is too short to judge by its share; it goes only without a letter.
    Learnt from the rows whose crc32(doc_id) is not 2 modulo 4, as the operator's query is. ``lang`` stays as given.
    """
    train = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) != 2
    own = {c: f"_kept_{c}" for c in docs.columns if c in ("lang_pred", "score", "log_prob")}
    told = identify(docs.withColumnsRenamed(own), train)
    clear = (F.col("score") >= LEAST_SCORE) | (F.char_length("text") < LEAST_CHARS)
    told = told.where((F.col("lang_pred") != UNKNOWN) & clear).drop("lang_pred", "score", "log_prob")
    return told.withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates (3-word shingles, at most 2 bits): the document with the smallest id of each group stays."""
    keep = near_duplicates(docs, 3, 2).where("stays").select(F.col("row").alias("_row")).distinct()
    left = docs.withColumn("_row", row_name("doc_id", "text")).join(keep, "_row", "left_semi")
    copy = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
    return left.withColumn("_copy", copy).where("_copy = 1").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes in 100-byte strings that start earlier go; ``n_chars`` follows the new text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = remove_repeats(docs, 100, texts=True, carry=others)
    new = {"doc_id": F.col("id"), "text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    return kept.select([(new[c] if c in new else F.col("more")[c]).alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a copy of a benchmark item go."""
    return without_copies(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids of every text that is left, with the digests of ids and decoded text."""
    done = encode(docs.select("doc_id", "text"), arrays=True)
    return done.select(F.col("id").alias("doc_id"), "n_tokens", F.col("ids").cast("array<int>").alias("ids"), "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", known_language),
    ("simhash", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: SQL can't express the stages; tests/llm compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read back for the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
