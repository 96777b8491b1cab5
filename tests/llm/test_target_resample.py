import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.target_resample import PositionCrc, _threshold, resample

from .test_tokens import NASTY, SF


def _features(text):
    low = (text or "").encode().lower().decode()  # bytes.lower changes A-Z only
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    return len(w), [zlib.crc32(x.encode()) % 10_000 for x in runs]


def _brute(docs, target, percent=5, least=20):
    found = [_features(t) for _, t in docs]
    s = collections.Counter(b for _, f in found for b in f)
    t = collections.Counter(b for x in target for b in _features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for (key, _), (n, f) in zip(docs, found):
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = rank + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def _same(got, want):
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_crc_of_spans_of_any_length():
    rnd = np.random.default_rng(1)
    data = rnd.integers(0, 256, 9_000).astype(np.uint8)
    for reach in (8, 128):
        crc = PositionCrc(reach)
        starts = np.concatenate((rnd.integers(0, 4_000, 400), np.arange(300)))
        stops = starts + np.concatenate((rnd.integers(1, 700, 400), np.full(300, 8)))
        stops[:3] = 9_000
        cut = starts + rnd.integers(1, 10**6, len(starts)) % (stops - starts)
        cut = np.maximum(cut, starts + 1)
        state = crc.spans(data, starts, cut, stops)
        rest = cut < stops
        state[rest] ^= crc.spans(data, cut[rest], stops[rest], stops[rest])
        got = state ^ crc.constant(stops - starts)
        assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts.tolist(), stops.tolist())]


def test_equals_plain_features(spark):
    rnd = random.Random(4)
    pool = ["the", "Cat", "sat", "où", "ÉTÉ", "x1", "日本語", "don't", "a_b", "—", "w" * 300, "É" * 90, "\x7f", " "]
    texts = NASTY + [rnd.choice([" ", "\n", ", "]).join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["k" * 20_000 + " z " * 30]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (None, None), (7, texts[40]), (7, texts[40])]
    target = [texts[30], "The cat sat. x1", None, ""]
    df = spark.createDataFrame([(k, t, 5) for k, t in docs], "doc_id long, text string, score int").repartition(6)
    tf = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 60):
        _same(resample(df, tf, percent=percent).collect(), _brute(docs, target, percent))
    assert resample(df.limit(0), tf).count() == 0
    _same(resample(df, tf.limit(0)).collect(), _brute(docs, []))


def test_draw_with_many_ties(spark):
    docs = [(None if i % 3 == 0 else i % 5, "one two " * 12) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    tf = spark.createDataFrame([("one two",)], "text string")
    _same(resample(df, tf, percent=50).collect(), _brute(docs, ["one two"], 50))


def test_threshold(spark):
    df = spark.range(100_000).select((F.col("id") * 977 % 1_000_003 - 500_000).alias("score"))
    scores = sorted((r.score for r in df.collect()), reverse=True)
    assert [_threshold(df, n) for n in (0, 1, 17, 5_000, 100_000)] == [None, scores[0], scores[16], scores[4_999], scores[-1]]


def test_query(spark):
    docs = [(d.doc_id, d.text) for d in queries.read(spark, SF, "documents").collect()]
    target = [r.text for r in queries.read(spark, SF, "benchmark").collect()]
    _same(queries.QUERIES["op11_target_resampling"](spark, SF).collect(), _brute(docs, target))
