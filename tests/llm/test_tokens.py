import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import queries
from tidemark.llm.bpe_table import encode
from tidemark.llm.token_store import Encoder, PerfectHash, TokenStore, _codes

SF = "/root/testdata/sf0.001"
NASTY = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n\nb", "\n\n a", "a\tb", "a\t b", "it's don't I'LL", "x<|endoftext|>y <|startoftext|>", "\x1ca\x1fb c",
    "a b   c", " x 　y", "é é ́ İ Σς ﬁ", "日本語 テキスト", "🙂🙂 ok", "1234 5.6%", "a\r\nb\x0bc\x0cd\x85e", "word " * 3000, "x" * 3000, "Hello\nWorld foo",
]


def test_word_tokenizer_equals_the_library(spark):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(NASTY)] + [(None, "again", "x"), (3, "again", "x")], "doc_id long, text string, ids string")
    for head in (1 << 18, 3):
        got = encode(df, head_words=head, arrays=True).collect()
        assert len(got) == len(NASTY) + 2
        for r in got:
            if r.id is not None and r.decoded != "again</w>":
                ids = tk.encode(NASTY[r.id] or "", add_special_tokens=False).ids
                told = tk.decode(ids, skip_special_tokens=False)
                assert (r.ids, r.decoded, r.n_tokens) == (ids, told, len(ids)), NASTY[r.id]
                assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert encode(df.limit(0)).count() == 0


def twins(n):
    """Two different words of ``n`` bytes (a power of two) that any polynomial modulo 2^64 with an odd base maps to one value."""
    return ["".join("ab"[i.bit_count() % 2 ^ k] for i in range(n)) for k in (0, 1)]


def test_words_that_share_a_polynomial(spark):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [w for n in (256, 512, 1024, 2048) for w in twins(n)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, " ".join(texts)])], "doc_id long, text string")
    for r in encode(df, arrays=True).collect():
        assert r.ids == tk.encode([*texts, " ".join(texts)][r.id], add_special_tokens=False).ids


def test_word_query_equals_the_library(spark):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {d.doc_id: d.text for d in queries.read(spark, SF, "documents").collect()}
    got = queries.QUERIES["op8_bpe_word_table"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = tk.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        )


def test_byte_encoder_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tk, mine = Tokenizer.from_file(path), Encoder(path, 0)
    rnd = random.Random(3)
    mixes = ["".join(rnd.choice(["a", "B1", " ", "  ", "\n", "\t", "'s", ".", "é", " ", "\r", "!?"]) for _ in range(40)) for _ in range(300)]
    for t in [t for t in NASTY if t is not None] + mixes:
        want = [*tk.encode(t, add_special_tokens=False).ids, 0]
        assert np.frombuffer(mine(t), mine.type).tolist() == want, repr(t)


def test_perfect_hash():
    keys = np.array([0, -1, 2**62, -(2**62), *range(5, 20_000, 7)], np.int64)
    codes = _codes(keys)
    mph = PerfectHash.build(codes)
    assert sorted(mph.slots(codes).tolist()) == list(range(len(keys)))
    assert PerfectHash.build(codes[:0]).slots(codes[:3]).tolist() == [-1] * 3


def _check(rows, got, path):
    tk = Tokenizer.from_file(path)
    start, want = 0, []
    for i, t in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_store_edge_cases(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(None, "null id"), (None, "null id too"), (-5, "minus"), (7, ""), (7, "twice"), (7, "twice"), (9, None), (10**15, "far")]
    rows += [(100 + i, f"text {i} " * (i % 9)) for i in range(300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    store = TokenStore.write(df, shard_bytes=700)
    assert store.manifest.count() > 5
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    _check(ordered, [tuple(r) for r in store.lookup(df).collect()], path)
    some = store.lookup(spark.createDataFrame([(7,), (8,), (10**15,), (-6,), (None,)], "doc_id long"), arrays=True).collect()
    assert sorted((r.id is None, r.id or 0) for r in some) == [(False, 7)] * 3 + [(False, 10**15)] + [(True, 0)] * 2
    assert Tokenizer.from_file(path).decode(next(r.ids for r in some if r.id == 10**15)[:-1]) == "far"
    empty = TokenStore.write(df.limit(0))
    assert empty.lookup(df).count() == 0


def test_store_query(spark):
    docs = sorted((d.doc_id, d.text) for d in queries.read(spark, SF, "documents").collect())
    _check(docs, [tuple(r)[:4] for r in queries.QUERIES["op2_token_store"](spark, SF).collect()], public_tokenizers.path("byte_bpe_50k.json"))
