import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import queries
from tidemark.llm.decontam import contaminated
from tidemark.llm.langid import identify
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = queries.read(spark, SF, "documents")
    columns = docs.columns
    rows = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        path = str(tmp_path / str(i))
        stage(spark, docs, SF).write.parquet(path)
        after_df = spark.read.parquet(path)
        after = {r.doc_id: r for r in after_df.collect()}
        assert after_df.count() == len(after) and set(after) <= set(before)
        if i < 4:
            assert after_df.columns == columns
        if name == "language_id":
            train = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
            told = {r.doc_id: r for r in identify(docs, train).collect()}
            assert set(after) == {k for k, r in told.items() if r.lang_pred != "und" and r.score >= 0.5} and len(after) > 0.95 * len(before)
        elif name == "simhash":
            groups = brute.classes({k: brute.simhash(r.text) for k, r in before.items()}, 2)
            assert set(after) == set(groups.values()) and all(after[k] == before[k] for k in after)
        elif name == "suffix_array_dedup":
            want = brute.repeats({k: r.text for k, r in before.items()})
            assert set(after) == set(before)
            for k, r in after.items():
                assert r.text == want[k][1].decode(errors="ignore") and r.n_chars == len(r.text) and r.lang == before[k].lang
        elif name == "decontamination":
            found = {r.id for r in contaminated(docs, queries.read(spark, SF, "benchmark")).collect()}
            items = [b.text for b in queries.read(spark, SF, "benchmark").collect()]
            assert set(after) == set(before) - found and not any(b in r.text for r in after.values() for b in items)
        else:
            tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert set(after) == set(before) and all(after[k].ids == tk.encode(before[k].text, add_special_tokens=False).ids for k in before)
        docs, rows[name] = after_df, after
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == rows["bpe"]
    assert zlib.crc32(b"0") >= 0


def test_stages_on_odd_rows(spark):
    text = "The cat sat on the mat and looked at the dog that slept by the door of the house all day long."
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (None, None, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0),
            (5, "123 456", "en", "s", 7), (6, text + " " + text, None, None, 5), (None, text.upper(), "en", "s", 9), (7, "é" * 30_000, "fr", "s", 30_000)]
    docs = spark.createDataFrame([(*r, "x", 2.0, 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, copy int")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, docs, SF)
        n = out.count()
        if name == "language_id":
            assert n == 6 and out.columns == docs.columns and {r.lang_pred for r in out.collect()} == {"x"}
        elif name == "simhash":
            got = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
            assert (False, 1) in got and (False, 2) not in got and n == len(set(got)) and out.columns == docs.columns
        elif name == "suffix_array_dedup":
            assert n == len(rows) and out.columns == docs.columns
        elif name == "decontamination":
            assert n == len(rows) and out.columns == docs.columns
        else:
            assert n == len(rows)
