import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import queries
from tidemark.llm.piece_map import _fields, _varint, decode, encode

from .test_tokens import NASTY, SF

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "B1", " ", "  ", "\n", "\t", "'s", ".", "é", "\r", "!?", "\x1c", "\x85", "\xa0", "日本", "▁", "<s>", "<0x41>", "ﬁ", "①", "ｶﾞ", "é", "​", "🙂", "½", "ñ(", "　", "…", "\xad", "한"]


def _texts(n):
    rnd = random.Random(5)
    return NASTY + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 25))) for _ in range(n)]


def _model(folder, rule, extra):
    """The vocabulary with the compiled character map of one of the library's own rules, in a temporary file."""
    spec = b"".join(v for k, v in _fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if k == 3) + extra
    path = str(folder / "model")
    with open(PATH, "rb") as f, open(path, "wb") as g:
        g.write(f.read() + b"\x1a" + _varint(len(spec)) + spec)
    return path


# the third case has no added prefix, the fourth keeps repeated spaces
@pytest.mark.parametrize("rule,extra", [(None, b""), ("nmt_nfkc", b""), ("nfkc_cf", b"\x18\x00"), ("nmt_nfkc_cf", b"\x20\x00")])
def test_ids_spans_and_text_equal_the_library(spark, tmp_path, rule, extra):
    path = _model(tmp_path, rule, extra) if rule else PATH
    lib, texts = sentencepiece.SentencePieceProcessor(model_file=path), _texts(400)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = encode(df, model=path, bos=False, eos=False, arrays=True).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.id] or ""
        want = lib.encode(text, return_type="proto").pieces
        assert r.ids == [p.id for p in want], text
        assert list(zip(r.begins, r.ends)) == [(p.begin, p.end) for p in want], text
        assert r.decoded == lib.decode(r.ids) and r.covered_bytes == sum(p.end - p.begin for p in want)


def test_edge_cases(spark):
    rows = [(None, None), (1, None), (1, "twice"), (1, "twice"), (2, ""), (3, "word " * 30_000), (4, "x" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = encode(df, arrays=True).collect()
    assert sorted((r.id or 0, r.n_tokens) for r in got) == sorted((i or 0, len(lib.encode(t or "")) + 2) for i, t in rows)
    assert sorted(x.decoded for x in got) == sorted(t or "" for _, t in rows)
    assert all(r.ids[0] == 1 and r.ids[-1] == 2 for r in got)
    assert encode(df.limit(0)).count() == 0


def test_decoding_any_ids(spark):
    lib, rnd = sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(2)
    lists = [[], None, [1, 2], [0], [1, 230, 153, 29871], [29871, 29871, 230, 2, 155]] + [[rnd.choice([0, 1, 2, rnd.randint(3, 258), rnd.randint(259, 31_999)]) for _ in range(rnd.randint(1, 9))] for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(lists)), "id long, ids array<int>")
    for r in decode(df).collect():
        assert r.text == lib.decode(lists[r.id] or []), lists[r.id]


def test_query_equals_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = {d.doc_id: d.text or "" for d in queries.read(spark, SF, "documents").collect()}
    got = queries.QUERIES["op13_sentencepiece_spans"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = [lib.bos_id(), *lib.encode(docs[r.doc_id]), lib.eos_id()]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest() and r.covered_bytes == len(docs[r.doc_id].encode())
