"""BPE encoding through a distinct-word table, and decoding through a table of pieces."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import Finder, Hashes, distinct_words, most_frequent, ragged, scan, steps, stored, text_bytes

#: Most frequent distinct words whose encodings are sent to every task.
HEAD_WORDS = 1 << 17


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str):
    """The tokenizer, without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def word_table(docs: DataFrame, text: Column) -> DataFrame:
    """``(word, n)``: the distinct words (cut at ASCII white space) of all rows with their counts."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            data, offsets = text_bytes(batch.column(0))
            for i, j in steps(offsets):
                part = data[offsets[i] : offsets[j]]
                keys, starts, ends, inverse, _ = distinct_words(part, offsets[i : j + 1] - offsets[i])
                if len(keys):
                    n = np.bincount(inverse, minlength=len(keys))
                    flat = ragged(part, starts, ends - starts)
                    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
                    found = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(at), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays([found, pa.array(n)], ["word", "n"])

        return work

    return scan(docs, [text.alias("t")], "word binary, n long", make).groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(table: DataFrame, path: str) -> DataFrame:
    """``(word, ids binary)``: each distinct word encoded once, ids as little-endian unsigned 32-bit integers."""

    def make():
        tokenizer = load(path)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = tokenizer.encode_batch_fast([w.decode() for w in batch.column(0).to_pylist()], add_special_tokens=False)
            ids = [np.array(x.ids, "<u4").tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["word", "ids"])

        return work

    return scan(table, ["word"], "word binary, ids binary", make)


def _offsets(lengths) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.asarray(lengths, np.int64))))


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, head_words: int = HEAD_WORDS,
    arrays: bool = False,
) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` per row, with ``arrays`` also ``ids array<long>`` and ``decoded``.

    Words are cut at ASCII white space, which no token of a word tokenizer crosses, and counted over all rows. The
    commonest ``head_words`` (a fixed bound) are encoded once each in Spark and sent to every task; the others are
    encoded once per step of a few megabytes. Ids are joined back by the words' positions. Decoding joins each id with its
    piece; this tokenizer has no decoder step, so pieces are joined by one space as the library does. Null text counts as
    empty: no tokens. Repeated rows give repeated rows; an empty table gives none.
    """
    path = tokenizer or default_tokenizer()
    text = F.col(text_col)
    counted = stored(word_table(docs, text))
    least = most_frequent(counted, "n", head_words)
    head = encode_words(counted.where(F.col("n") >= least), path).toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((head["word"].combine_chunks(), head["ids"].combine_chunks()))
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", ids array<long>, decoded string" if arrays else ""

    def make():
        known_words, known = sent.value
        flat, at = text_bytes(known_words)
        find = Finder(Hashes(flat).of(at[:-1], at[1:]))
        ids_flat, ids_at = text_bytes(known)
        ids_flat, ids_at = np.frombuffer(ids_flat.tobytes(), "<u4"), ids_at // 4
        lib = load(path)
        names = [(lib.id_to_token(i) or "").encode() for i in range(lib.get_vocab_size(with_added_tokens=True))]
        piece_at = _offsets([len(x) + 1 for x in names])
        piece_flat = np.frombuffer(b"".join(x + b" " for x in names), np.uint8)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            data, offsets = text_bytes(batch.column(1))
            for i, j in steps(offsets, 1 << 20):
                part = data[offsets[i] : offsets[j]]
                keys, starts, ends, inverse, first = distinct_words(part, offsets[i : j + 1] - offsets[i])
                where = find(keys)
                rare = np.flatnonzero(where < 0)
                raw = part.tobytes()
                got = lib.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts[rare].tolist(), ends[rare].tolist())], add_special_tokens=False) if len(rare) else []
                new = [x.ids for x in got]
                table = np.concatenate((ids_flat, np.array([x for ids in new for x in ids], np.uint32)))
                new_at = len(ids_flat) + _offsets([len(x) for x in new])
                begin, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
                old = where >= 0
                begin[old], size[old] = ids_at[where[old]], np.diff(ids_at)[where[old]]
                begin[rare], size[rare] = new_at[:-1], np.diff(new_at)
                ids = ragged(table, begin[inverse], size[inverse])
                doc_at = _offsets(size[inverse])[first]
                lengths = np.diff(piece_at)[ids]
                told = ragged(piece_flat, piece_at[:-1][ids], lengths)
                told_at = _offsets(lengths)[doc_at]
                id_bytes, told_bytes = ids.astype("<u4").tobytes(), told.tobytes()
                spans = list(zip(doc_at[:-1].tolist(), doc_at[1:].tolist(), told_at[:-1].tolist(), told_at[1:].tolist()))
                columns = [
                    batch.column(0).slice(i, j - i),
                    pa.array(np.diff(doc_at)),
                    pa.array([hashlib.sha256(id_bytes[4 * a : 4 * b]).hexdigest() for a, b, _, _ in spans]),
                    pa.array([hashlib.sha256(told_bytes[a : max(a, b - 1)]).hexdigest() for _, _, a, b in spans]),
                ]
                if arrays:
                    columns += [
                        pa.array([ids[a:b].astype(np.int64) for a, b, _, _ in spans], pa.list_(pa.int64())),
                        pa.array([told_bytes[a : max(a, b - 1)].decode() for _, _, a, b in spans]),
                    ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if arrays else [])])

        return work

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}"
    return scan(docs, [F.col(id_col).alias("id"), text.alias("t")], schema, make)
