import random

import numpy as np

from tests.llm import brute
from tidemark.llm import queries
from tidemark.llm.components import components
from tidemark.llm.simhash import near_duplicates, near_links, near_pairs

SF = "/root/testdata/sf0.001"


def test_query_equals_brute_force(spark):
    got = queries.QUERIES["op6_simhash_near_dedup"](spark, SF).collect()
    want = {d.doc_id: brute.simhash(d.text) for d in queries.read(spark, SF, "documents").collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == brute.classes(want, 2)


def test_edge_cases(spark):
    rows = [(5, None), (3, ""), (4, " \n"), (9, "One"), (8, "one"), (7, "one two"), (7, "one two"), (None, "one"), (1, "x " * 30_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    at = {r.id: r.component_id for r in got}
    assert sorted(r.id for r in got if r.stays) == [1, 3, 7, 7, 8]
    assert at[5] == at[3] == at[4] == 3 and at[9] == at[8] == 8 and at[None] == 8 and at[7] == 7 and at[1] == 1
    assert near_duplicates(df.limit(0)).count() == 0


def test_bit_sliced_pairs():
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(40)]
    vals = np.array([b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(5))) for b in base for _ in range(4)], np.uint64)
    for radius in (0, 1, 2):
        a, b = near_pairs(vals, vals, radius)
        want = {(i, j) for i in range(len(vals)) for j in range(len(vals)) if (int(vals[i]) ^ int(vals[j])).bit_count() <= radius}
        assert set(zip(a.tolist(), b.tolist())) == want


def test_large_buckets_are_split_without_loss(spark):
    rnd = random.Random(2)
    near = {rnd.getrandbits(64) for _ in range(5)}
    vals = sorted({b ^ (1 << i) ^ (1 << j) for b in near for i in range(0, 64, 5) for j in range(0, 64, 7)} | {rnd.getrandbits(64) for _ in range(50)} | {0, 1})
    signed = [v - (1 << 64) if v >> 63 else v for v in vals]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.root for r in components(near_links(df, 2, block=16)).collect()}
    want = brute.classes(dict(enumerate(vals)), 2)
    groups = lambda of: {frozenset(g) for g in _groups(of) if len(g) > 1}
    assert groups({v: got.get(v, v) for v in signed}) == groups({signed[i]: c for i, c in want.items()})


def _groups(of):
    out = {}
    for k, v in of.items():
        out.setdefault(v, set()).add(k)
    return out.values()


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 200), (1, 2), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame([(a, b, "x") for a, b in links], "a long, b long, root string")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 140)}, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
