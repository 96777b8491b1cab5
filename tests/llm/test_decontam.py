import random

import numpy as np

from tidemark.llm import queries
from tidemark.llm.decontam import GAP, MATCH, MISMATCH, align, contaminated, without_copies

SF = "/root/testdata/sf0.01"


def _sw(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH), h[i - 1][j] + GAP, h[i][j - 1] + GAP)
    return max(map(max, h))


def test_alignment_equals_the_textbook():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(0, 12))] for _ in range(2))
        assert align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == _sw(a, b)


def test_query_finds_every_verbatim_copy_and_scores_as_brute_force(spark):
    docs = {d.doc_id: d.text for d in queries.read(spark, SF, "documents").collect()}
    items = {b.item_id: b.text for b in queries.read(spark, SF, "benchmark").collect()}
    got = {(r.doc_id, r.item_id): r for r in queries.QUERIES["op1_benchmark_decontamination"](spark, SF).collect()}
    verbatim = {(d, i) for d, t in docs.items() for i, b in items.items() if b in t}
    assert verbatim and verbatim <= set(got) and all(got[k].score == 1 for k in verbatim)
    assert all(docs[d].encode()[got[d, i].start : got[d, i].end].decode().strip(".\n ") == items[i].strip(".\n ") for d, i in verbatim)
    assert len(got) <= len(verbatim) * 1.2 + 3


def _prose(rnd, n):
    return [rnd.choice(["the", "of", "and", "to"]) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8))) for _ in range(n)]


def test_edited_copies_and_edge_cases(spark):
    rnd = random.Random(2)
    items = [_prose(rnd, 40) for _ in range(12)]
    clean = [(i, " ".join(_prose(rnd, 200))) for i in range(60)]
    planted = []
    for k, item in enumerate(items):
        swapped = [w if rnd.random() > 0.15 else "changed" for w in item]
        dropped = [w for w in item if rnd.random() > 0.1]
        half = item[:24]
        for j, w in enumerate((item, swapped, dropped, [x.upper() + "," for x in item], half)):
            planted.append((1000 + 10 * k + j, " ".join(_prose(rnd, 50) + w + _prose(rnd, 50)), k))
    rows = clean + [(i, t) for i, t, _ in planted] + [(2000, None), (2001, ""), (2002, "the of"), (None, " ".join(items[0])), (2003, " ".join(items[1])), (2003, " ".join(items[1]))]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w), "x") for k, w in enumerate(items)] + [(50, None, "x"), (51, "", "x"), (52, "the of and", "x"), (53, " ".join(items[5]), "x")], "item_id long, text string, start string")
    for block in (8 << 20, 500):
        got = {(r.id, r.item): r for r in contaminated(docs, bench, block_bytes=block).collect()}
        assert {(i, k) for i, _, k in planted} <= set(got) and (None, 0) in got and (2003, 1) in got
        assert {i for i, _ in got} <= {i for i, _, _ in planted} | {None, 2003} and {k for _, k in got} <= set(range(12)) | {53}
        kept = without_copies(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in clean} | {2000, 2001, 2002}
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
    assert without_copies(docs, bench.limit(0)).count() == len(rows)
