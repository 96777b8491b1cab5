import collections
import math
import zlib

from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.ppm import ALPHABET, DISCOUNT, score_documents

SF = "/root/testdata/sf0.001"


class Trie:
    """Symbol by symbol PPM with escapes and exclusion, as a book would have it."""

    def __init__(self, texts, order):
        self.order, self.nodes = order, collections.defaultdict(collections.Counter)
        for t in texts:
            for ctx, s in self.symbols(t):
                for k in range(order + 1):
                    self.nodes[ctx[order - k :]][s] += 1

    def symbols(self, text):
        seq = [0] * self.order + [b + 1 for b in (text or "").encode().lower()] + [0]
        return [(tuple(seq[i - self.order : i]), seq[i]) for i in range(self.order, len(seq))]

    def p(self, ctx, s):
        gone, out = set(), 1.0
        for k in range(self.order, -1, -1):
            node = self.nodes.get(ctx[self.order - k :])
            if not node:
                continue
            left = {x: n for x, n in node.items() if x not in gone}
            if not left:
                continue
            total, d = sum(left.values()), 0 if len(node) == ALPHABET else DISCOUNT
            if s in left:
                return out * (left[s] - d) / total
            out *= d * len(left) / total
            gone |= set(left)
        return out / (ALPHABET - len(gone))

    def score(self, text):
        return sum(math.log10(self.p(c, s)) for c, s in self.symbols(text))


def _base(texts, learn):
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = collections.Counter(w for t in learn for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(len(words(t)), sum(w in c for w in words(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for t in texts]


def _check(got, rows, order):
    learn = [t for _, t, x in rows if x]
    trie, base = Trie(learn, order), _base([t for _, t, _ in rows], learn)
    for (i, t, _), b in zip(rows, base):
        for r in got[i]:
            assert (r.n_tokens, r.n_known, r.train_tokens) == b[:3]
            assert math.isclose(r.base_score, b[3], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, trie.score(t), rel_tol=1e-9)


def _by_id(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.id].append(r)
    return out


def test_edges_heads_and_tails_equal_a_plain_trie(spark):
    texts = [None, "", "the cat", "The CAT sat\non the mat", "the cat", "é\U0001f600 naïve", "zzz zzz", " \t ", "the dog sat " * 30, "a"]
    rows = [(i, t, i % 3 != 2) for i, t in enumerate(texts)] + [(None, "the cat sat", True)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, learn boolean, key string, n int")
    for order, head in ((3, 1 << 20), (5, 20), (2, 0)):
        _check(_by_id(score_documents(df, F.col("learn"), order, head_rows=head).collect()), rows, order)


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x y", True), (1, "x y", True), (1, "other", True)], "doc_id long, text string, learn boolean")
    got = score_documents(df, F.col("learn"), 3, head_rows=2).collect()
    assert len(got) == 3 and sorted(r.n_tokens for r in got) == [2, 3, 3] and len({r.score for r in got if r.n_tokens == 3}) == 1
    assert score_documents(df.limit(0), F.col("learn")).count() == 0
    none = score_documents(df, F.lit(False), 3).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in none) and math.isclose(min(r.score for r in none), -6 * math.log10(257), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    trie = Trie(["the cat sat", "the hat", "a cat"], 3)
    for ctx in [(0, 0, 0), tuple(b + 1 for b in b"the"), (5, 5, 5), tuple(b + 1 for b in b" ca")]:
        assert math.isclose(sum(trie.p(ctx, s) for s in range(ALPHABET)), 1, rel_tol=1e-9)


def test_query_equals_brute_force(spark):
    docs = [(d.doc_id, d.text, zlib.crc32(str(d.doc_id).encode()) % 7 != 2) for d in queries.read(spark, SF, "documents").collect()]
    got = _by_id(queries.QUERIES["op5_ppm_scoring"](spark, SF).withColumnRenamed("doc_id", "id").collect())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) for i, rs in got.items() for r in rs)
    base = _base([t for _, t, _ in docs], [t for _, t, x in docs if x])
    assert len(got) == len(docs)
    for (i, _, _), b in zip(docs, base):
        assert (got[i][0].n_tokens, got[i][0].n_known, got[i][0].train_tokens) == b[:3] and math.isclose(got[i][0].base_score, b[3], rel_tol=1e-9)
    trie = Trie([t for _, t, x in docs if x], 5)
    for i, t, x in docs[:12]:
        assert math.isclose(got[i][0].score, trie.score(t), rel_tol=1e-9)


def test_words_that_share_a_polynomial(spark):
    from .test_tokens import twins

    a, b = twins(1024)
    df = spark.createDataFrame([(0, a, True), (1, b, False)], "doc_id long, text string, learn boolean")
    got = {r.id: r for r in score_documents(df, F.col("learn"), 2).collect()}
    assert (got[0].n_known, got[1].n_known) == (2, 1)
    assert math.isclose(got[1].base_score, math.log10(1 / 5) + math.log10(2 / 5), rel_tol=1e-12)
