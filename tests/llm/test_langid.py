import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import langid, queries
from tidemark.llm.langid import Lattice, default_vocabulary, identify, pieces

SF = "/root/testdata/sf0.001"


def _brute(word, prob, index):
    part = b" " + word
    alpha = [1.0] + [0.0] * len(part)
    for j in range(1, len(part) + 1):
        for i in range(max(0, j - 128), j):
            k = index.get(part[i:j])
            if k is not None:
                alpha[j] += alpha[i] * prob[k]
    return alpha[-1]


def test_forward_sums_all_segmentations():
    path = default_vocabulary()
    table, index = pieces(path), {p: i for i, p in enumerate(pieces(path))}
    rng = np.random.default_rng(0)
    p = np.vstack([rng.random((len(table), 2)) / 1000, np.zeros((1, 2))])
    texts = [b"the", b"station", "é".encode(), b"x", b"internationally", b"zqj\xff"]
    lattice = Lattice(path)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    seen = set()
    for rows, m, _ in lattice.parts(data, np.concatenate(([0], ends[:-1])), ends):
        got = lattice.forward(m, lattice.ids(m), p)[-1]
        for r, g in zip(rows.tolist(), got):
            seen.add(r)
            for k in range(2):
                assert math.isclose(g[k], _brute(texts[r], p[:, k], index), rel_tol=1e-12)
    assert seen == set(range(len(texts)))


def test_expected_counts_cover_every_byte():
    path = default_vocabulary()
    table = pieces(path)
    p = np.vstack([np.full((len(table), 1), 1 / len(table)), np.zeros((1, 1))])
    lattice, out = Lattice(path), np.zeros(len(table))
    long = b"a" * 100
    data = np.frombuffer(b"hello" + long, np.uint8)
    total = 0
    for rows, m, lengths in lattice.parts(data, np.array([0, 5]), np.array([5, 105])):
        lattice.expected(m, lengths, np.array([3.0, 1.0])[rows], p, out)
        total += (np.array([3.0, 1.0])[rows] * m.shape[1]).sum()
    assert math.isclose(sum(n * len(t) for n, t in zip(out, table)), total, rel_tol=1e-9) and total == 3 * 6 + 101


def _log_brute(word, logs, index):
    part = b" " + word
    alpha = [0.0]
    for j in range(1, len(part) + 1):
        terms = [alpha[i] + logs[index[part[i:j]]] for i in range(max(0, j - 128), j) if part[i:j] in index]
        top = max(terms)
        alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return alpha


def test_rare_scripts_and_long_words_do_not_underflow():
    """Floors of 1e-12 over a whole word, and unspaced sentences, against a lattice in logarithms; no word is cut."""
    path = default_vocabulary()
    table, index = pieces(path), {p: i for i, p in enumerate(pieces(path))}
    rng = np.random.default_rng(1)
    p = np.vstack([np.full((len(table), 2), 1e-12), np.zeros((1, 2))])
    common = np.array([len(t) <= 3 and t.isascii() for t in table])
    p[:-1][common, 0] = rng.random(int(common.sum())) / 5_000
    words = ["ⵜⴰⵎⴰⵣⵉⵖⵜⴰ", "a", "漢字かな交じり文" * 220, "ⵜⴰⵎⴰⵣⵉⵖⵜⴰⵜⴰⵎⴰ", "--------" * 30, "x" * 700, "longerthanthirtytwobytesbutonlyjust"]
    raw = [w.encode() for w in words]
    lattice, data = Lattice(path), np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    seen = 0
    for rows, m, lengths in lattice.parts(data, np.concatenate(([0], ends[:-1])), ends):
        got = lattice.log_sums(m, lengths, p)
        for r, g in zip(rows.tolist(), got):
            seen += 1
            for k in range(2):
                assert math.isclose(g[k], _log_brute(raw[r], np.log(p[:-1, k]), index)[-1], rel_tol=1e-9)
        out = np.zeros(len(table))
        lattice.expected(m, lengths, np.ones(len(rows)), p[:, 1:], out)
        size = np.full(len(m), m.shape[1]) if lengths is None else lengths
        assert np.isfinite(out).all() and math.isclose(sum(n * len(t) for n, t in zip(out, table)), size.sum(), rel_tol=1e-6)
    assert seen == len(words)


def test_score_is_a_share_for_every_text(spark):
    path = default_vocabulary()
    p = np.vstack([np.full((len(pieces(path)), 2), 1e-14), np.zeros((1, 2))])
    texts = ["ⵜⴰⵎⴰⵣⵉⵖⵜⴰ " * 50, "漢字かな交じり文" * 300, "plain", "ⵜ" * 3000, "", None, "123"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(df, ["aa", "bb"], p, path).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["aa"] * 4 + ["und"] * 3
    assert all(0 <= r.score <= 1 and math.isfinite(r.log_prob) for r in got.values()) and got[0].score == 0.5


def test_query_is_accurate_on_held_out_rows(spark):
    docs = {d.doc_id: d for d in queries.read(spark, SF, "documents").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op4_language_id"](spark, SF).collect()}
    assert set(got) == set(docs) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].lang_pred == docs[i].lang for i in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got.values())


def test_edge_cases(spark):
    rows = [(i, t, la) for i, (t, la) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 5)]
    rows += [(20, None, "en"), (21, "", "fr"), (22, "123 -- 456", "en"), (23, "the", None), (23, "the", None), (None, "le chat", None), (24, "the cat " * 20_000, None), (25, "x" * 5000, None), (26, "日本", None)]
    df = spark.createDataFrame([(*r, "kept", 1.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, log_prob double")
    got = identify(df, F.col("doc_id") < 20).collect()
    at = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [at[i].lang_pred for i in (20, 21, 22)] == ["und"] * 3 and at[20].score == 0
    assert at[23].lang_pred == "en" and at[None].lang_pred == "fr" and at[24].lang_pred == "en" and at[25].lang_pred in ("en", "fr") and at[26].lang_pred in ("en", "fr")
    assert all(math.isfinite(r.log_prob) for r in got)
    assert identify(df.limit(0), F.lit(True)).count() == 0
    assert {r.lang_pred for r in identify(df, F.lit(False)).collect()} == {"und"}


def test_letters():
    assert langid.has_letter("é") and not langid.has_letter("12 ½ _ 🙂")
    assert pa.array(["x"]).type == pa.string()
