import random

import numpy as np
import pytest

from tests.llm.test_decontam import _prose
from tidemark.llm.decontam import MATCH, align, contaminated


def _edited(rnd, item, share):
    out = []
    for w in item:
        x = rnd.random()
        if x >= share:
            out.append(w)
        elif x < share * 0.6:
            out.append("changed")
        elif x < share * 0.8:
            out += [w, "added"]
    return out


@pytest.mark.parametrize("threshold", [0.4, 0.3])
def test_seeds_reach_all_that_the_threshold_accepts(spark, threshold):
    rnd = random.Random(7)
    items, texts = [_prose(rnd, rnd.randrange(15, 21)) for _ in range(150)], []
    for k, item in enumerate(items):
        for copy in (*[_edited(rnd, item, s) for s in (0.2, 0.3, 0.35, 0.4)], [w if i % 3 != 2 else "changed" for i, w in enumerate(item)], [x for w in item for x in (w, "added")]):
            texts.append((k, _prose(rnd, 30) + copy + _prose(rnd, 30)))
    names = {}
    code = lambda words: np.array([names.setdefault(w, len(names) + 1) for w in words], np.uint64)
    want = {}
    for d, (k, text) in enumerate(texts):
        score = align(code(items[k]), code(text))[0]
        if score >= threshold * MATCH * len(items[k]) - 1e-9:
            want[d, k] = score / (MATCH * len(items[k]))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, (_, t) in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.id, r.item): r.score for r in contaminated(docs, bench, threshold=threshold).collect()}
    assert len(want) > 600 and {x: got.get(x) for x in want} == want
