import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import pfp_dedup, queries
from tidemark.llm.pfp_dedup import parse, remove_repeats

SF = "/root/testdata/sf0.001"


def _compare(got, texts, n=100):
    want = brute.repeats(texts, n)
    assert len(got) == len(texts)
    for r in got:
        size, kept, spans = want[r[0]]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, size - len(kept), spans, brute.sha(kept)), r[0]


def test_query_equals_brute_force(spark):
    texts = {d.doc_id: d.text for d in queries.read(spark, SF, "documents").collect()}
    _compare(queries.QUERIES["op7_prefix_free_dedup"](spark, SF).collect(), texts)


def _corpus():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(80), prose(14)[:99]
    texts = {i: prose(rnd.randrange(5, 120)) for i in range(40)}
    for i in range(40, 70):
        texts[i] = prose(20) + passage + prose(20)
    for i in range(70, 90):
        texts[i] = prose(rnd.randrange(30)) + line + "|" + prose(10)
    for i in range(90, 110):
        t = list(texts[i - 90])
        for _ in range(2):
            t[rnd.randrange(len(t))] = "#"
        texts[i] = "".join(t)
    texts |= {110: None, 111: "", 112: "a" * 99, 113: "a" * 100, 114: "a" * 5000, 115: "ab" * 3000, 116: texts[3], 117: passage[:100], 118: passage[:99], 119: passage * 3, 120: ("xyz" * 40 + "q") * 9, 121: "a" * 101}
    return texts


def test_synthetic_corpus(spark):
    texts = _corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, kept string, copy int").repartition(7)
    _compare(remove_repeats(df).collect(), texts)
    other = remove_repeats(df, length=64, texts=True).collect()
    _compare(other, texts, 64)
    want = brute.repeats(texts, 64)
    assert all(bytes(r.kept) == want[r.id][1] and r.kept_text == want[r.id][1].decode(errors="ignore") for r in other)


def test_common_triggers_dealt_singly_give_the_same(spark, monkeypatch):
    texts = _corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(pfp_dedup, "RUN_ROWS", 3)
    _compare(remove_repeats(df).collect(), texts)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    t = "the quick brown fox " * 3 + " jumps over the lazy dog and runs away from all of us " * 2 + "end of it"
    rows = [(2, t), (2, t), (None, t), (1, "short"), (1, "short"), (2, "other text of the same id " * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(df).collect()
    assert len(got) == 6
    full = [r for r in got if r.n_bytes == len(t)]
    assert sorted(r.n_removed == r.n_bytes for r in full) == [False, True, True] and next(r for r in full if r.id is None).n_removed < len(t)
    assert [r.n_removed for r in got if r.n_bytes == 5] == [0, 0]
    carried = remove_repeats(df.withColumn("kept", F.monotonically_increasing_id()), texts=True, carry=("kept",)).collect()
    assert len({r.more.kept for r in carried}) == 6 and sorted(r.kept_text for r in carried if r.n_bytes == 5) == ["short"] * 2
    assert remove_repeats(df.limit(0), texts=True).count() == 0


def test_large_and_small_parses_agree(monkeypatch):
    data = np.frombuffer(bytes(random.Random(1).choice(b"ab") for _ in range(3000)) + b"c" * 500, np.uint8)
    offsets = np.array([0, 0, 1000, 1099, 3500])
    row, lo, count, trigger = parse(data, offsets, 100)
    assert count.sum() == 901 + 0 + 2302 and set(row.tolist()) == {1, 3}
    assert ((trigger >= lo + count - 1) & (trigger <= lo + 68)).all()


def test_texts_beyond_the_packed_size_tie_to_the_left():
    data = np.zeros((1 << 24) + 300, np.uint8)
    data[:500] = np.random.default_rng(0).integers(0, 250, 500)
    row, lo, count, trigger = parse(data, np.array([0, len(data)]), 100)
    assert count.sum() == len(data) - 99 and ((trigger >= lo) & (trigger - lo <= 68)).all()
    r2, l2, c2, t2 = parse(data[:5000], np.array([0, 5000]), 100)
    assert (l2[:20] == lo[:20]).all() and (trigger[:20] >= lo[:20]).all()


def test_windows_that_share_a_polynomial(spark):
    from .test_tokens import twins

    texts = dict(enumerate([*twins(1024), *twins(2048)]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for length in (512, 1024):
        _compare(remove_repeats(df, length).collect(), texts, length)
