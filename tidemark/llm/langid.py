"""Language identification by unigram pieces, summed over all segmentations of a text."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm.util import LOWER, Finder, Hashes, distinct_words, ragged, scan, steps, stored, text_bytes

UNKNOWN = "und"
#: Bytes of a word (with the space before it) up to which words of one length share a matrix; longer ones go by logarithms.
PART = 32
#: Bytes of long words in one group, and start places of it whose pieces are looked up at once.
GROUP_BYTES, GROUP_PLACES = 1 << 18, 1 << 10
#: Least probability of a word for which plain products are exact enough; rarer words go by logarithms.
LEAST = 1e-250
#: Smoothing count of every piece.
FLOOR = 0.1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def pieces(path: str) -> tuple[bytes, ...]:
    """The byte pieces of a rank file; all 256 single bytes are among them, so every text can be segmented."""
    with open(path, "rb") as f:
        found = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    return tuple(sorted(found | {bytes([b]) for b in range(256)}))


class Lattice:
    """Piece ids of all substrings of words, and the sums over all segmentations."""

    def __init__(self, path: str):
        vocabulary = pieces(path)
        self.size = len(vocabulary)
        self.lengths = sorted({len(p) for p in vocabulary})
        flat = np.frombuffer(b"".join(vocabulary), np.uint8)
        sizes = np.array([len(p) for p in vocabulary], np.int64)
        ends = np.cumsum(sizes)
        self.find = Finder(Hashes(flat).of(ends - sizes, ends))
        # the longest piece that may begin with the same four bytes (by a hash of them, so never too small)
        self.reach = np.zeros(1 << 20, np.uint8)
        long = sizes >= 4
        np.maximum.at(self.reach, self._prefix(flat)[(ends - sizes)[long]], np.minimum(sizes[long], 255).astype(np.uint8))

    @staticmethod
    def _prefix(flat: np.ndarray) -> np.ndarray:
        """A 20-bit code of the four bytes from every place (from the last three: of what is left)."""
        wide = np.concatenate((flat, np.zeros(3, np.uint8))).astype(np.uint32)
        code = wide[:-3] | (wide[1:-2] << np.uint32(8)) | (wide[2:-1] << np.uint32(16)) | (wide[3:] << np.uint32(24))
        return ((code * np.uint32(0x9E3779B1)) >> np.uint32(12)).astype(np.int64)

    def parts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """``(word indexes, byte matrix, lengths)``: words with a space before them, none cut.

        Words of up to ``PART`` bytes come with others of their length (``lengths`` is None), longer ones in groups of
        like lengths, filled up at the end.
        """
        size = ends - starts + 1
        short = size <= PART
        for n in np.unique(size[short]).tolist():
            pick = np.flatnonzero(size == n)
            for i in range(0, len(pick), 1 << 13):
                rows = pick[i : i + (1 << 13)]
                m = np.full((len(rows), n), 32, np.uint8)
                if n > 1:
                    m[:, 1:] = data[starts[rows][:, None] + np.arange(n - 1)]
                yield rows, m, None
        long = np.flatnonzero(~short)
        long = long[np.argsort(-size[long], kind="stable")]
        i = 0
        while i < len(long):
            widest = int(size[long[i]])
            rows = long[i : i + max(1, GROUP_BYTES // widest)]
            rows = rows[size[rows] * 2 >= widest]
            m = np.zeros((len(rows), widest), np.uint8)
            for k, w in enumerate(rows.tolist()):
                m[k, 0], m[k, 1 : size[w]] = 32, data[starts[w] : ends[w]]
            yield rows, m, size[rows]
            i += len(rows)

    def ids(self, m: np.ndarray, lengths: np.ndarray | None = None, low: int = 0, high: int | None = None) -> dict[tuple[int, int], np.ndarray]:
        """Piece id (or -1) of ``m[:, i : i + length]`` for every ``(i, length)`` that any row has, for ``low <= i < high``."""
        rows, n = m.shape
        high = n if high is None else min(n, high)
        stop = min(n, high + self.lengths[-1])
        part = np.ascontiguousarray(m[:, low:stop])
        flat, width = part.reshape(-1), stop - low
        hashes, reach = Hashes(flat), self.reach[self._prefix(flat)].reshape(rows, width)
        ends = np.full(rows, width) if lengths is None else np.minimum(lengths - low, width)
        out = {}
        for length in self.lengths:
            places = min(high - low, width - length + 1)
            if places <= 0:
                break
            open_ = np.arange(places) + length <= ends[:, None]
            if length >= 4:
                open_ &= reach[:, :places] >= length
            row, i = np.nonzero(open_)
            if not len(row):
                continue
            at = row * width + i
            got = np.full((rows, places), -1, np.int64)
            got[row, i] = self.find(hashes.of(at, at + length))
            for i in np.flatnonzero((got >= 0).any(axis=0)).tolist():
                out[low + i, length] = got[:, i]
        return out

    def forward(self, m: np.ndarray, ids: dict, p: np.ndarray) -> np.ndarray:
        """``alpha[j]``: the summed probability of all segmentations of the first ``j`` bytes, per row and language."""
        rows, n = m.shape
        alpha = np.zeros((n + 1, rows, p.shape[1]))
        alpha[0] = 1.0
        for (i, length), piece in sorted(ids.items()):
            alpha[i + length] += alpha[i] * p[piece]
        return alpha

    def log_forward(self, m: np.ndarray, lengths: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """The logarithm of :meth:`forward`, for rows of any lengths and probabilities."""
        rows, n = m.shape
        alpha = np.full((n + 1, rows, log_p.shape[1]), -np.inf)
        alpha[0] = 0.0
        for low in range(0, n, GROUP_PLACES):
            for (i, length), piece in sorted(self.ids(m, lengths, low, low + GROUP_PLACES).items()):
                np.logaddexp(alpha[i + length], alpha[i] + log_p[piece], out=alpha[i + length])
        return alpha

    def log_sums(self, m: np.ndarray, lengths: np.ndarray | None, p: np.ndarray) -> np.ndarray:
        """The log probability of every row in every language, summed over all its segmentations."""
        if lengths is None:
            whole = self.forward(m, self.ids(m), p)[-1]
            few = np.flatnonzero(whole.min(axis=1) < LEAST)
            with np.errstate(divide="ignore"):
                out = np.log(whole)
            if len(few):
                out[few] = self.log_sums(m[few], np.full(len(few), m.shape[1]), p)
            return out
        with np.errstate(divide="ignore"):
            alpha = self.log_forward(m, lengths, np.log(p))
        return alpha[lengths, np.arange(len(m))]

    def expected(self, m: np.ndarray, lengths: np.ndarray | None, weights: np.ndarray, p: np.ndarray, out: np.ndarray) -> None:
        """Add to ``out`` the expected number of uses of each piece in the weighted rows (``p`` of one language)."""
        if lengths is not None:
            return self._log_expected(m, lengths, weights, p, out)
        ids = self.ids(m)
        rows, n = m.shape
        alpha = self.forward(m, ids, p)[:, :, 0]
        few = np.flatnonzero(alpha[n] < LEAST)
        if len(few):
            self._log_expected(m[few], np.full(len(few), n), weights[few], p, out)
        beta = np.zeros((n + 1, rows))
        beta[n] = 1.0
        for (i, length), piece in sorted(ids.items(), reverse=True):
            beta[i] += beta[i + length] * p[piece, 0]
        scale = np.where(alpha[n] < LEAST, 0.0, weights / np.maximum(alpha[n], LEAST))
        for (i, length), piece in ids.items():
            used = alpha[i] * p[piece, 0] * beta[i + length] * scale
            has = piece >= 0
            out += np.bincount(piece[has], used[has], len(out))

    def _log_expected(self, m: np.ndarray, lengths: np.ndarray, weights: np.ndarray, p: np.ndarray, out: np.ndarray) -> None:
        rows, n = m.shape
        with np.errstate(divide="ignore"):
            log_p = np.log(p)
        alpha = self.log_forward(m, lengths, log_p)[:, :, 0]
        whole = alpha[lengths, np.arange(rows)]
        beta = np.full((n + 1, rows), -np.inf)
        beta[lengths, np.arange(rows)] = 0.0
        for low in reversed(range(0, n, GROUP_PLACES)):
            for (i, length), piece in sorted(self.ids(m, lengths, low, low + GROUP_PLACES).items(), reverse=True):
                behind = log_p[piece, 0] + beta[i + length]
                np.logaddexp(beta[i], behind, out=beta[i])
                has = piece >= 0
                np.add.at(out, piece[has], weights[has] * np.exp(alpha[i, has] + behind[has] - whole[has]))


def language_words(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    """``(lang, word, n)``: how often each lower-cased (A-Z) word stands in the rows of each non-null language."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for value in pc.unique(batch.column(0)):
                table = pa.Table.from_batches([batch]).filter(pc.equal(batch.column(0), value))
                data, offsets = text_bytes(table["t"])
                data = LOWER[data]
                found: list[tuple] = []
                for i, j in steps(offsets):
                    part = data[offsets[i] : offsets[j]]
                    keys, starts, ends, inverse, _ = distinct_words(part, offsets[i : j + 1] - offsets[i])
                    found.append((keys, np.bincount(inverse, minlength=len(keys)), ends - starts, ragged(part, starts, ends - starts)))
                keys, n, lengths, flat = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
                unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
                if len(unique):
                    begin = np.cumsum(lengths) - lengths
                    at = np.concatenate(([0], np.cumsum(lengths[first]))).astype(np.int32)
                    chosen = pa.Array.from_buffers(
                        pa.binary(), len(unique), [None, pa.py_buffer(at), pa.py_buffer(ragged(flat, begin[first], lengths[first]))]
                    )
                    names = pa.array([value.as_py()]).take(pa.array(np.zeros(len(unique), np.int64)))
                    total = np.bincount(inverse, n, len(unique)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([names, chosen, pa.array(total)], ["lang", "word", "n"])

        return work

    rows = scan(docs.where(lang.isNotNull() & text.isNotNull()), [lang.alias("lang"), text.alias("t")], "lang string, word binary, n long", make)
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(table: DataFrame, path: str, rounds: int = 2) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities ``(pieces + 1, languages)`` by expectation maximisation over ``language_words``.

    Every round sums the expected piece counts of all words in Spark; at most languages x vocabulary rows reach
    the driver, a size that the fixed vocabulary bounds. The start is uniform over the pieces.
    """
    spark = table.sparkSession
    langs = sorted(r.lang for r in table.select("lang").distinct().collect())
    size = len(pieces(path))
    p = np.zeros((size + 1, len(langs)))
    p[:-1] = 1.0 / size
    for _ in range(rounds if langs else 0):
        sent = spark.sparkContext.broadcast((langs, p))

        def task(batches, sent=sent):
            lattice, (names, prob) = Lattice(path), sent.value
            sums = np.zeros((len(names), size))
            for batch in batches:
                for k, name in enumerate(names):
                    part = pa.Table.from_batches([batch]).filter(pc.equal(batch.column(0), name))
                    data, offsets = text_bytes(part["word"])
                    n = part["n"].to_numpy().astype(float)
                    for i, j in steps(offsets, 1 << 20):
                        at = offsets[i : j + 1] - offsets[i]
                        for rows, m, lengths in lattice.parts(data[offsets[i] : offsets[j]], at[:-1], at[1:]):
                            lattice.expected(m, lengths, n[i:j][rows], prob[:, k : k + 1], sums[k])
            k, piece = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(piece), pa.array(sums[k, piece])], ["lang", "piece", "n"])

        found = table.select("lang", "word", "n").mapInArrow(task, "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        p = np.zeros((size + 1, len(langs)))
        p[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
        p[:-1] += FLOOR
        p /= p.sum(axis=0)
    return langs, p


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, path: str, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``(lang_pred, score, log_prob)``: the language with the greatest summed log probability.

    The new columns replace any of their names.

    ``score`` is its share of the posterior under equal priors. Null text, text without a letter, and any text when
    nothing was learned, give ``und`` with score 0. Ties go to the first language by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast((langs, p))
    new = ["lang_pred", "score", "log_prob"]
    kept = [c for c in docs.columns if c not in new]
    place = docs.columns.index(text_col)

    def make():
        lattice, (names, prob) = Lattice(path), sent.value

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = batch.column(place)
            raw, offsets = text_bytes(texts)
            data = LOWER[raw]
            total = np.zeros((batch.num_rows, max(1, len(names))))
            for i, j in steps(offsets) if names else ():
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                keys, starts, ends, inverse, first = distinct_words(part, at)
                logs = np.zeros((len(keys) + 1, len(names)))
                for rows, m, lengths in lattice.parts(part, starts, ends):
                    logs[rows] = lattice.log_sums(m, lengths, prob)
                row = np.repeat(np.arange(j - i), np.diff(first))
                for k in range(len(names)):
                    total[i:j, k] = np.bincount(row, logs[inverse, k], j - i)
            letters = np.zeros(batch.num_rows, bool)
            for i, j in steps(offsets):
                part = data[offsets[i] : offsets[j]]
                count = np.concatenate(([0], np.cumsum((part >= 97) & (part <= 122), dtype=np.int32)))
                letters[i:j] = np.diff(count[offsets[i : j + 1] - offsets[i]]) > 0
            for k in np.flatnonzero(~letters & (np.diff(offsets) > 0)).tolist():
                letters[k] = has_letter(texts[k].as_py() or "")
            known = letters & bool(names)
            best = total.argmax(axis=1)
            share = np.where(known, 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
            told = np.where(known, np.array([*names, ""], object)[best], UNKNOWN)
            added = [pa.array(told, pa.string()), pa.array(share), pa.array(np.where(known, total.max(axis=1), 0.0))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *added], [*kept, *new])

        return work

    schema = StructType([*[docs.schema[c] for c in kept], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("log_prob", DoubleType())])
    return scan(docs, docs.columns, schema, make)


def identify(docs: DataFrame, train: Column, lang_col: str = "lang", text_col: str = "text", vocabulary: str | None = None, rounds: int = 2) -> DataFrame:
    """Learn from the rows where ``train`` holds and the language is known, then predict every row.

    Only text and language are learned from; a prediction reads the text alone. An empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()
    table = stored(language_words(docs.where(train), F.col(text_col), F.col(lang_col)))
    langs, p = learn(table, path, rounds)
    return predict(docs, langs, p, path, text_col)
