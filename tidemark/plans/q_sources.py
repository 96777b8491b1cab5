"""Queries for sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import normalize as NZ
from tidemark.plans import views as V
from tidemark.plans.catalog import query
from tidemark.plans.sqlkit import CORPUS, SCORED
from tidemark.sources import labelled as L
from tidemark.sources import parts as P
from tidemark.session import cut_lineage
from tidemark.sources.tables import table
from tidemark.streaming import incremental as INC
from tidemark.streaming import scorer as ST


@query("s01_read_labelled", f"WITH {CORPUS} SELECT doc_id, text AS feature, CAST(label AS BIGINT) AS label FROM corpus")
def s01(spark, sf_dir):
    return L.read_labelled(spark, V.corpus(spark, sf_dir), "text", "label", keep=["doc_id"])


_PAIRS_SQL = ("pairs AS (SELECT a.doc_id AS pair_id, a.text AS member, b.text AS nonmember FROM documents a "
              "JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0)")


@query("s04_stack_pairs", f"WITH {_PAIRS_SQL} SELECT pair_id, member AS text, CAST(1 AS BIGINT) AS label FROM pairs "
       "UNION ALL SELECT pair_id, nonmember, CAST(0 AS BIGINT) FROM pairs")
def s04(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = d.filter(F.pmod("doc_id", F.lit(2)) == 0).select(F.col("doc_id").alias("pair_id"), F.col("text").alias("member"))
    b = d.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("nonmember"))
    return L.stack_pairs(a.join(b, "pair_id"), keep=["pair_id"])


@query("s05_concat_splits", "SELECT doc_id, lang AS split FROM documents")
def s05(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    langs = ["de", "en", "es", "fr"]
    parts = {lang: d.filter(F.col("lang") == lang).select("doc_id") for lang in langs}
    other = d.filter(~F.col("lang").isin(langs)).select("doc_id", F.col("lang").alias("split"))
    return L.concat_splits(parts).unionByName(other)


@query("s06_filter_split", "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 500 AND n_chars <= 3000")
def s06(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("bucket", L.length_bucket(F.col("n_chars")))
    return L.filter_split(d, "bucket", "medium").select("doc_id", "n_chars")


@query("s07_members", f"WITH {CORPUS} SELECT doc_id, 'member' AS side FROM corpus WHERE label = 1 UNION ALL "
       "SELECT doc_id, 'nonmember' FROM corpus WHERE label = 0")
def s07(spark, sf_dir):
    c = V.corpus(spark, sf_dir)
    return L.members(c).select("doc_id", F.lit("member").alias("side")).unionByName(
        L.nonmembers(c).select("doc_id", F.lit("nonmember").alias("side")))


@query(
    "s08_month_split",
    "SELECT o_orderkey, CAST(strftime(o_orderdate, '%y%m') = '9702' AS BIGINT) AS label FROM orders "
    "WHERE strftime(o_orderdate, '%y%m') IN ('9702', '9703')",
)
def s08(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyMM").alias("yymm"))
    return L.month_split(o, "yymm", "9702", "9703", year_lo=96, year_hi=97).select("o_orderkey", "label")


@query("s10_canonical_samples",
       "SELECT u.conv_id * 1000 + u.turn AS sample_id, u.text AS input, a.text AS answer, '' AS modality, "
       "'ds' || CAST(u.conv_id % 3 AS VARCHAR) AS ds_name FROM conversations u JOIN conversations a "
       "ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'")
def s10(spark, sf_dir):
    return L.canonical_samples(V.samples(spark, sf_dir)).fillna("", ["modality"])


@query("s11_render_instruction",
       "SELECT u.conv_id * 1000 + u.turn AS sample_id, replace(replace('Question: {input}' || chr(10) || "
       "'Dataset: {ds_name}' || chr(10), '{input}', u.text), '{ds_name}', 'ds' || CAST(u.conv_id % 3 AS VARCHAR)) "
       "|| 'ОТВЕТ: ' AS instruction FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id "
       "AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'")
def s11(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    tpl = "Question: {input}\nDataset: {ds_name}\n"
    return s.select("sample_id", L.render_instruction(tpl, {"input": "input", "ds_name": "ds_name"}).alias("instruction"))


@query("s16_parse_score", f"WITH {SCORED} SELECT vec_id, round(score[1], 6) AS s0, round(score[2], 6) AS s1 FROM scored")
def s16(spark, sf_dir):
    s = V.scored(spark, sf_dir).withColumn("txt", L.format_score(F.col("score")))
    p = L.parse_score(F.col("txt"))
    return s.select("vec_id", p[0].alias("s0"), p[1].alias("s1"))


def _event_groups_sql(extra: str) -> str:
    from tidemark.plans.q_pipeline import EVENTS_SQL

    return f"WITH {EVENTS_SQL} SELECT model_name, CAST(label AS BIGINT) AS label, count(*) AS n{extra} FROM el GROUP BY ALL"


@query("s12_write_read_parts", _event_groups_sql(", round(sum(loss_delta), 4) AS s"))
def s12(spark, sf_dir):
    """Event losses written as bounded part files per model and label, read back, counted per folder."""
    ev = V.event_losses(spark, sf_dir)
    path = P.write_parts(ev, P.shared_path(spark, "parts"), part_size=1000)
    back = P.read_parts(spark, path)
    return back.groupBy("model_name", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("loss_delta"), 4).alias("s"))


@query("s13_delta_dataset", _event_groups_sql(""))
def s13(spark, sf_dir):
    """Typed delta dataset round trip (write S13, read S14a from two folders)."""
    ev = V.event_losses(spark, sf_dir).withColumn("k", F.col("k").cast("int")).withColumn(
        "embedding_delta", F.array(F.col("neighbor_loss"), F.col("input_loss")))
    a = P.write_delta_dataset(ev.filter(F.col("label") == 1), P.shared_path(spark, "delta"))
    b = P.write_delta_dataset(ev.filter(F.col("label") == 0), P.shared_path(spark, "delta"))
    back = P.read_delta_dataset(spark, f"{a},{b}")
    return back.groupBy("model_name", "label").agg(F.count(F.lit(1)).alias("n"))


def _z04_like(spark, sf_dir):
    ev = V.event_losses(spark, sf_dir)
    kept = ev.filter(F.col("model_name") != "other")
    stats = NZ.loss_mean_var(kept).join(NZ.loss_min_range(kept), NZ.GROUP)
    e = table(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("input_loss"))
    return first, stats


def _s14b_sql():
    from tidemark.plans.q_pipeline import EVENTS_SQL, _LOOKUP_SQL, _STATS_SQL

    return (f"WITH {EVENTS_SQL}, {_STATS_SQL}, {_LOOKUP_SQL} SELECT sample_id, k, round(CASE WHEN std = 0 "
            "THEN loss_delta - mean ELSE (loss_delta - mean) / std END, 6) AS norm_loss FROM lk")


@query("s14b_streaming_scores", _s14b_sql())
def s14b(spark, sf_dir):
    """Events streamed (availableNow) through a stream–static normalisation into a Parquet sink."""
    # the static sides are computed once, not again in every micro-batch
    first, stats = (cut_lineage(df) for df in _z04_like(spark, sf_dir))
    return ST.incremental_normalised_losses(spark, sf_dir, first, stats)


@query("s14c_incremental_scores", _s14b_sql())
def s14c(spark, sf_dir):
    """The same scores from keyed stream state (first loss and moments), with no pass over the events before the stream."""
    root = P.shared_path(spark, "incremental")
    INC.ingest(spark, sf_dir, root, "events.parquet")
    return INC.scores(spark, root)
