"""Labelled corpora and sample tables.

Readers take an explicit schema or select explicit columns (no inference);
argument checks run on the driver before any job starts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.running import running_totals

# The suffix the reference appends to rendered instructions and the month-split rule.
ANSWER_SUFFIX = "ОТВЕТ: "
MEMBER_MONTH, NONMEMBER_MONTH = "2302", "2303"
YEAR_LO, YEAR_HI = 22, 50
MODALITY_COLUMNS = ("image", "video", "audio", "audio_1", "audio_2")


def read_labelled(
    spark: SparkSession,
    source: DataFrame | str,
    feature_col: str | None,
    label_col: str | None,
    text_col: str | None = None,
    modality_type: str | None = None,
    joint: bool = False,
    fmt: str = "csv",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Labelled rows ``(keep…, feature string, label int[, text, modality_type])``.

    Missing arguments raise as in the reference's custom loader; a joint
    text+media attack needs a text column and a modality type of image|audio.
    """
    if source is None or (isinstance(source, str) and not source):
        raise ValueError("no source given: name a path or pass a DataFrame")
    if not label_col:
        raise ValueError("label_col is empty")
    if not feature_col:
        raise ValueError("feature_col is empty")
    if joint:
        if not text_col:
            raise ValueError("joint=True needs text_col")
        if modality_type not in ("image", "audio"):
            raise ValueError("joint=True needs modality_type image or audio")
    df = source if isinstance(source, DataFrame) else spark.read.format(fmt).option("header", True).load(source)
    cols = [*keep, F.col(feature_col).cast("string").alias("feature"), F.col(label_col).cast("int").alias("label")]
    if joint:
        cols += [F.col(text_col).cast("string").alias("text"), F.lit(modality_type).alias("modality_type")]
    return df.select(*cols)


def read_text_dirs(spark: SparkSession, member_glob: str, nonmember_glob: str) -> DataFrame:
    """One document per file; the label comes from which folder matched."""
    def side(glob: str, label: int) -> DataFrame:
        return spark.read.text(glob, wholetext=True).select(
            F.input_file_name().alias("path"), F.col("value").alias("text"), F.lit(label).alias("label"))

    return side(member_glob, 1).unionByName(side(nonmember_glob, 0))


def read_line_corpora(spark: SparkSession, member_txt: str, nonmember_txt: str) -> DataFrame:
    """One document per line (``\\n`` only); a trailing newline adds no empty document."""
    def side(path: str, label: int) -> DataFrame:
        return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("text"),
                                                                     F.lit(label).alias("label"))

    return side(member_txt, 1).unionByName(side(nonmember_txt, 0))


def stack_pairs(df: DataFrame, member_col: str = "member", nonmember_col: str = "nonmember",
                keep: Sequence[str] = ()) -> DataFrame:
    """A member column and a non-member column become labelled rows."""
    return df.select(*keep, F.inline(F.array(
        F.struct(F.col(member_col).alias("text"), F.lit(1).alias("label")),
        F.struct(F.col(nonmember_col).alias("text"), F.lit(0).alias("label")),
    )))


def concat_splits(splits: Mapping[str, DataFrame] | Sequence[DataFrame]) -> DataFrame:
    """All named splits in one DataFrame (columns missing in a split become null)."""
    items = list(splits.items()) if isinstance(splits, Mapping) else [(None, s) for s in splits]
    out = None
    for name, s in items:
        part = s if name is None else s.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def filter_split(df: DataFrame, column: str, value) -> DataFrame:
    """Keep one length bucket / subset."""
    return df.filter(F.col(column) == value)


def length_bucket(n_chars: Column) -> Column:
    return F.when(n_chars < 500, "short").when(n_chars <= 3000, "medium").otherwise("long")


def members(df: DataFrame, label: str = "label") -> DataFrame:
    """Member rows."""
    return df.filter(F.col(label) == 1)


def nonmembers(df: DataFrame, label: str = "label") -> DataFrame:
    """Non-member rows."""
    return df.filter(F.col(label) == 0)


def month_split(df: DataFrame, yymm: str = "yymm", member_month: str = MEMBER_MONTH,
                nonmember_month: str = NONMEMBER_MONTH, year_lo: int = YEAR_LO, year_hi: int = YEAR_HI,
                on_error: str = "raise") -> DataFrame:
    """Rows of the member month → 1, of the non-member month → 0, other months dropped.

    Years ``<= year_lo`` or ``> year_hi`` are dropped first; any other
    surviving year than the two months' year is an error (``raise``) or is
    dropped into nothing (``drop``).
    """
    yy = F.substring(F.col(yymm), 1, 2).cast("int")
    kept = df.filter((yy > year_lo) & (yy <= year_hi))
    expected = int(member_month[:2])
    if on_error == "raise":
        kept = kept.filter(F.when(yy != expected, F.raise_error(
            F.concat(F.lit("unexpected year in "), F.col(yymm)))).otherwise(F.lit(True)))
    return kept.filter(F.col(yymm).isin(member_month, nonmember_month)).withColumn(
        "label", (F.col(yymm) == member_month).cast("int"))


def image_manifest(spark: SparkSession, path: str, label: int, caption: str | None = None) -> DataFrame:
    """Decodable three-channel images, numbered in path order: ``(image_id, image_paths, caption, label)``."""
    imgs = spark.read.format("image").option("dropInvalid", True).load(path)
    ok = imgs.filter(F.col("image.nChannels") == 3).select(F.col("image.origin").alias("image_paths"))
    ranked = running_totals(ok.withColumn("_one", F.lit(1).cast("long")), [], [F.col("image_paths").asc()], ["_one"])
    return ranked.select((F.col("cum__one") - 1).alias("image_id"), "image_paths",
                         F.lit(caption).cast("string").alias("caption"), F.lit(label).alias("label"))


def canonical_samples(df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """``(sample_id, input, answer, modality, ds_name)``; the modality path is the first present column."""
    mods = [F.col(c) for c in MODALITY_COLUMNS if c in df.columns]
    modality = F.coalesce(*mods) if mods else F.lit(None).cast("string")
    sid = F.col(id_col) if id_col in df.columns else F.xxhash64("input", "answer", modality, "ds_name")
    return df.select(sid.alias("sample_id"), "input", "answer", modality.alias("modality"), "ds_name")


def render_instruction(template: str, fields: Mapping[str, Column | str], suffix: str = ANSWER_SUFFIX) -> Column:
    """``template`` with each ``{name}`` replaced by its column, then the answer suffix."""
    out = F.lit(template)
    for name, col in fields.items():
        c = F.col(col) if isinstance(col, str) else col
        out = F.replace(out, F.lit("{" + name + "}"), c)
    return F.concat(out, F.lit(suffix))


def format_score(score: Column) -> Column:
    """``"[a b]"`` text form of a two-logit score."""
    return F.concat(F.lit("["), F.array_join(F.transform(score, lambda x: x.cast("string")), " "), F.lit("]"))


def parse_score(text: Column) -> Column:
    """Parse ``"[a b]"`` back into ``array<double>``."""
    inner = F.trim(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""))
    return F.transform(F.split(inner, r"\s+"), lambda x: x.cast("double"))
