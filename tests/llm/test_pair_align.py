import base64
import collections
import hashlib
import random

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import queries
from tidemark.llm.pair_align import align

from .test_piece_map import PARTS
from .test_tokens import NASTY, SF

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
    A_BYTES = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}


def _brute(texts):
    """Rows of ``(n_a, n_b, n_groups, n_links, n_best, count_sum, groups)``, all overlaps tried one by one."""
    made = []
    for text in texts:
        a = A.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = B.encode(text) if text else []
        spans = []
        for ids, of in ((a, [A_BYTES[i] for i in a]), (b, [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, B.id_to_piece(i)) for i in b)])):
            if b"".join(of) != (" " + (text or "")).encode():
                spans.append(None)
                continue
            at, out = 0, []
            for i, x in zip(ids, of):
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        if None in spans or not text:
            made.append(([], [], [], []))
            continue
        x, y = spans
        links, i = [], 0
        for t in x:
            while y[i][2] <= t[1]:
                i += 1
            k = i
            while k < len(y) and y[k][1] < t[2]:
                links.append((t[0], y[k][0]))
                k += 1
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, s, e in x if low <= s < c) + "|" + ",".join(str(i) for i, s, e in y if low <= s < c))
            low = c
        made.append((x, y, groups, links))
    count = collections.Counter(p for *_, links in made for p in set(links))
    best = collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(len(x), len(y), len(g), len(li), sum(count[p] == best[p[0]] for p in li), sum(count[p] for p in li), ";".join(g)) for x, y, g, li in made]


def _same(got, keys, want):
    want = sorted(((k is not None, k or 0), *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for k, w in zip(keys, want))
    assert sorted(((r.id is not None, r.id or 0), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want


def _texts():
    rnd = random.Random(8)
    return NASTY + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 25))) for _ in range(300)] + ["same again, and again"] * 3


def test_equals_all_overlaps(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(5)
    got = align(df, groups=True).collect()
    want = _brute(texts)
    _same(got, range(len(texts)), want)
    assert {r.id: r.groups for r in got} == {i: w[6] for i, w in enumerate(want)}


def test_several_rounds(spark):
    """Few pairs in a block and in a round: the documents are read once for each round, with equal results."""
    texts = _texts()[-120:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    _same(align(df, round_pairs=400, block_pairs=60).collect(), range(len(texts)), _brute(texts))


def test_null_repeated_and_empty(spark):
    rows = [(None, None), (None, "one two"), (1, "one two"), (1, "one two"), (2, ""), (3, "▁ sign"), (4, "w" * 5000)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    _same(align(df).collect(), [k for k, _ in rows], _brute([t for _, t in rows]))
    assert align(df.limit(0)).count() == 0
    assert [r.n_links for r in align(df.where("doc_id = 2")).collect()] == [0]


def test_query(spark):
    docs = [(d.doc_id, d.text) for d in queries.read(spark, SF, "documents").collect()]
    got = queries.QUERIES["op12_tokenizer_alignment"](spark, SF).withColumnRenamed("doc_id", "id").collect()
    _same(got, [k for k, _ in docs], _brute([t for _, t in docs]))
