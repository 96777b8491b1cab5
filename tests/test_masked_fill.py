"""Masks filled round by round: stub fillers, counts, and equality with plain Python."""

import hashlib

from tidemark.operators import masked_fill as MF
from tidemark.operators import neighbors as N

TEXTS = [(1, "one two three four"), (2, "a b c"), (3, "solo"), (4, "! ? ..."), (5, ""), (6, None)]


def _prep(spark):
    return N.prepare(spark.createDataFrame(TEXTS, "sample_id long, input string"))


def _plain(text, sid, j, m, fill):
    """One neighbour, mask after mask."""
    toks = text.split()
    for r in range(1, m + 1):
        content = [i for i, t in enumerate(toks) if not any(c in '!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~' for c in t)]
        if not content:
            break
        pos = min(content, key=lambda i: hashlib.md5(f"42|{sid}|substitution|{j}|{r}|{i}".encode()).hexdigest())
        toks[pos:pos + 1] = fill(" ".join(toks[:pos] + [MF.MASK] + toks[pos + 1:])).split()
    return " ".join(toks)


def _check(spark, load):
    prep = _prep(spark)
    want_m = {r["sample_id"]: (r["m"], r["n_content"]) for r in prep.collect()}
    got = {(r["sample_id"], r["j"]): r["neighbor"] for r in MF.substitution_rounds(prep, load=load).collect()}
    one = load()
    want = {}
    for sid, text in TEXTS:
        m, content = want_m[sid]
        if text is not None and (content > 0 or m <= 0):
            want.update({(sid, j): _plain(text, sid, j, m, lambda t: one([t])[0] or "") for j in range(6)})
    assert {k: v for k, v in got.items() if k[0] != 6} == want
    return got, want_m


def test_each_round_sees_the_fills_before_it(spark):
    def load():
        return lambda texts: [f"{len(t.split())}x{t.split().index('<extra_id_0>')}" for t in texts]

    got, m = _check(spark, load)
    assert "x" in got[2, 0] and m[1][0] == 3


def test_fills_of_several_words_and_none_are_split_again(spark):
    def load():
        return lambda texts: ["two words" if len(t) % 2 == 0 else None for t in texts]

    _check(spark, load)


def test_default_model_uses_earlier_fills(spark):
    """`b` follows `a` and `c` follows `b`: filled one by one from the present neighbours."""
    rows = [(i, "a b c a") for i in range(5)]
    prep = N.prepare(spark.createDataFrame(rows, "sample_id long, input string"))
    out = MF.substitution_rounds(prep).collect()
    assert len(out) == 30 and all(r["neighbor"] == "a b c a" for r in out)  # every fill restores the pattern


def test_empty_table(spark):
    prep = N.prepare(spark.createDataFrame([], "sample_id long, input string"))
    assert MF.substitution_rounds(prep).count() == 0
