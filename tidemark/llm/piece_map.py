"""SentencePiece encoding that keeps the source bytes of every piece, and decoding.

Normalisation walks the model's compiled character map (a double-array trie over UTF-8 bytes) from all characters of
a batch at once, takes the longest match at each, and records for every normalised byte where its source starts.
Pieces are found in the normalised text; their ends are carried back through that record to spans of source bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import ChunkTable, joined, joins, row_sums
from tidemark.llm.util import ragged, scan, steps, text_bytes

#: Bytes of source text in one step.
PIECE_STEP = 2 << 20
#: The sign that stands for a space inside pieces (fixed value).
MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: numbers, or bytes for strings and messages."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, raw[at : at + size]
            at += size


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


class CharMap:
    """Longest-prefix replacement through a compiled character map: a trie's size, its units, then the replacements."""

    def __init__(self, raw: bytes):
        size = int.from_bytes(raw[:4], "little")
        self.units = np.frombuffer(raw, "<u4", size // 4, 4).astype(np.int64)
        self.pool = np.frombuffer(raw, np.uint8, -1, 4 + size)
        self.ends = np.flatnonzero(self.pool == 0)

    @staticmethod
    def _child(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest key at each place (0: none; never beyond ``stop``) and its replacement's place in the pool."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        who = np.arange(len(at))
        node = np.full(len(at), int(self._child(self.units[:1])[0]), np.int64)
        depth = 0
        while len(who):
            here = at[who] + depth
            open_ = here < stop[who]
            who, node, here = who[open_], node[open_], here[open_]
            byte = data[here].astype(np.int64)
            node ^= byte
            inside = node < len(self.units)
            unit = np.where(inside, self.units[np.minimum(node, len(self.units) - 1)], 0)
            fits = inside & ((unit & 0x800000FF) == byte)
            who, node, unit = who[fits], (node ^ self._child(unit))[fits], unit[fits]
            depth += 1
            leaf = (unit >> 8) & 1 == 1
            length[who[leaf]] = depth
            value[who[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return length, value

    def sizes(self, value: np.ndarray) -> np.ndarray:
        return self.ends[np.searchsorted(self.ends, value)] - value


class Normalizer:
    """The normalisation that a model file names, for whole batches and with source alignment."""

    def __init__(self, spec: bytes):
        found = dict(_fields(spec))
        chars = found.get(2, b"")
        self.map = CharMap(chars) if chars else None
        self.prefix, self.squeeze = bool(found.get(3, 1)), bool(found.get(4, 1))
        if not found.get(5, 1):
            raise ValueError("models that leave spaces as they are are not supported")

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes, their row offsets, and the source place of every normalised byte and row end.

        The sign for a space, given or made, is one byte 0x20 here. Row ``r`` owns the aligned places
        ``new[r] + r`` to ``new[r + 1] + r``, the last of which is the source place where its text ends.
        """
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(starts, append=len(data))
        row = np.searchsorted(offsets, starts, side="right") - 1
        flat, begin, size = data, starts, width
        if self.map is not None and len(starts):
            length, value = self.map.longest(data, starts, offsets[row + 1])
            alive = np.ones(len(starts), bool)
            for k in np.flatnonzero(length > width).tolist():
                if alive[k]:  # a match over several characters takes those it covers
                    alive[k + 1 : np.searchsorted(starts, starts[k] + length[k])] = False
            flat = np.concatenate((data, self.map.pool))
            hit = length > 0
            begin, size = starts.copy(), width.copy()
            begin[hit], size[hit] = len(data) + value[hit], self.map.sizes(value[hit])
            starts, begin, size, row = starts[alive], begin[alive], size[alive], row[alive]
        out = ragged(flat, begin, size)
        align, owner = np.repeat(starts, size), np.repeat(row, size)
        # the sign inside a text is the same as a space that was made into it
        sign = np.flatnonzero((out[:-2] == 0xE2) & (out[1:-1] == 0x96) & (out[2:] == 0x81)) if len(out) > 2 else np.zeros(0, np.int64)
        given = np.zeros(len(out), bool)
        if len(sign):
            out = out.copy()
            out[sign], given[sign] = 0x20, True
            keep = np.ones(len(out), bool)
            keep[sign + 1] = keep[sign + 2] = False
            out, align, owner, given = out[keep], align[keep], owner[keep], given[keep]
        last = offsets[1:].copy()
        lead = offsets[:-1].copy()
        has = np.diff(offsets) > 0
        if self.squeeze and len(out):
            space = (out == 0x20) & ~given
            first = np.append(True, owner[1:] != owner[:-1])
            again = space & (first | np.append(False, space[:-1]))
            # the source place after the leading spaces is where the added prefix stands
            out, align, owner, given = out[~again], align[~again], owner[~again], given[~again]
            rows, at = np.unique(owner, return_index=True)
            has = np.zeros(len(has), bool)
            has[rows], lead[rows] = True, align[at]
            while True:
                end = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(out) else np.zeros(0, np.int64)
                end = end[out[end] == 0x20]
                if not len(end):
                    break
                last[owner[end]] = align[end]
                keep = np.ones(len(out), bool)
                keep[end] = False
                out, align, owner = out[keep], align[keep], owner[keep]
            left = np.zeros(len(has), bool)
            left[owner] = True
            has &= left
        count = np.bincount(owner, minlength=len(has)) if len(has) else np.zeros(0, np.int64)
        new = np.concatenate(([0], np.cumsum(count)))
        if self.prefix:
            out = np.insert(out, new[:-1][has], 0x20)
            align = np.insert(align, new[:-1][has], lead[has])
            new += np.concatenate(([0], np.cumsum(has)))
        return out, new, np.insert(align, new[1:], last)


class Pieces:
    """A SentencePiece model with byte fallback: its normaliser, its pieces as bytes, and ids of normalised chunks."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            raw = f.read()
        self.lib = SentencePieceProcessor(model_proto=raw)
        parts = list(_fields(raw))
        trainer = dict(_fields(b"".join(v for k, v in parts if k == 2)))
        if not trainer.get(35) or trainer.get(24):
            raise ValueError("a model with byte fallback and spaces before words is needed")
        self.normalizer = Normalizer(b"".join(v for k, v in parts if k == 3))
        # fixed values: field numbers of the character map, the prefix, extra spaces and escaping; all off
        plain = b"\x0a\x08identity\x12\x00\x18\x00\x20\x00\x28\x00"
        self.inner = SentencePieceProcessor(model_proto=raw + b"\x1a" + _varint(len(plain)) + plain)
        n = self.lib.vocab_size()
        names = [self.lib.id_to_piece(i) for i in range(n)]
        self.control = np.array([self.lib.is_control(i) for i in range(n)])
        self.byte = np.array([self.lib.is_byte(i) for i in range(n)])
        unknown = np.array([self.lib.is_unknown(i) for i in range(n)])
        self.marked = np.array([x.startswith(MARK) for x in names]) & ~unknown
        surface = trainer.get(44, " ⁇ ".encode())
        self.bytes = [
            b"" if self.control[i] else surface if unknown[i] else bytes([int(x[3:5], 16)]) if self.byte[i] else x.replace(MARK, " ").encode()
            for i, x in enumerate(names)
        ]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.lengths)))
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.cut = not joins([self.bytes[i] for i in np.flatnonzero(~self.control & ~unknown & ~self.byte)])
        self.bos, self.eos = self.lib.bos_id(), self.lib.eos_id()

    def encode(self, text: str) -> np.ndarray:
        return self.inner.encode(text.replace(" ", MARK), return_type="numpy").astype(np.int64)

    def ids(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the normalised chunks and the number of each chunk's."""
        if not self.cut:
            out = [self.encode(x.decode()) for x in chunks]
            return np.concatenate([*out, np.zeros(0, np.int64)]), np.array([len(x) for x in out], np.int64)
        return joined(chunks, self.encode, b" ", self.lengths)

    def spans(self, ids: np.ndarray, first: np.ndarray, new: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source begin and end of every piece, for rows of pieces that start at ``first``.

        A character that fell back to bytes belongs to the last of its byte pieces; the others stand before it, empty.
        """
        ends = np.cumsum(self.lengths[ids])
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        begin, end = align[ends - self.lengths[ids] + row], align[ends + row]
        part = self.byte[ids]
        inner = part & np.append(part[1:] & (self.flat[self.at[ids[1:]]] & 0xC0 == 0x80), False) if len(ids) else part
        end[inner] = begin[inner]
        return begin, end

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """UTF-8 of the text of every row of ids; bytes that are no character become U+FFFD one by one."""
        told = ragged(self.flat, self.at[ids], self.lengths[ids]).tobytes()
        ends = np.concatenate(([0], np.cumsum(self.lengths[ids])))
        held = np.concatenate(([0], np.cumsum(self.control[ids])))
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            a0, b0 = a, b
            while a < b and self.control[ids[a]]:
                a += 1
            while a < b and self.control[ids[b - 1]]:
                b -= 1
            text = told[ends[a] : ends[b]]
            if a < b and not held[b] - held[a] and not (self.normalizer.squeeze and text[:2] == b"  "):
                if self.marked[ids[a]] and (self.normalizer.prefix or self.normalizer.squeeze):
                    text = text[1:]
                try:
                    text.decode()
                except UnicodeDecodeError:
                    text = self.lib.decode(ids[a0:b0].tolist()).encode()
            elif a < b:
                text = self.lib.decode(ids[a0:b0].tolist()).encode()
            out.append(text)
        return out


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(2)
def piece_table(path: str) -> ChunkTable:
    """A worker's table of encoded chunks, which outlives a task."""
    return ChunkTable(lambda chunks: {"ids": pieces(path).ids(chunks)}, {"ids": np.int32})


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, bos: bool = True, eos: bool = True,
    arrays: bool = False,
) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256, covered_bytes)`` per row.

    ``ids_sha256`` is of the ids as little-endian unsigned 32-bit integers, with the begin and end ids asked for;
    ``decoded_sha256`` of the text decoded from them; ``covered_bytes`` is the number of source bytes in the pieces'
    spans. With ``arrays`` also ``ids``, ``begins`` and ``ends`` (source byte spans; begin and end ids have empty ones)
    and ``decoded``. Null text counts as empty: only the begin and end ids. Repeated rows give repeated rows and an
    empty table none; other columns are not read.
    """
    path = model or default_model()
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        vocabulary, table = pieces(path), piece_table(path)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            data, offsets = text_bytes(batch.column(1))
            for i, j in steps(offsets, PIECE_STEP):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                yield step(batch.column(0).slice(i, j - i), part, at)

        def step(keys: pa.Array, part: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            text, new, align = vocabulary.normalizer(part, at)
            found = [(table.of["ids"].take(chunk), row_sums(table.of["ids"].lengths(chunk), first)) for _, _, chunk, first in table.scan(text, new, vocabulary.cut)]
            ids = np.concatenate([x for x, _ in found] + [np.zeros(0, np.int32)])
            count = np.concatenate([n for _, n in found] + [np.zeros(0, np.int64)])
            first = np.concatenate(([0], np.cumsum(count)))
            begin, end = vocabulary.spans(ids, first, new, align)
            total = np.concatenate(([0], np.cumsum(end - begin)))
            covered = total[first[1:]] - total[first[:-1]]
            for edge, wanted, value in ((slice(None, -1), bos, vocabulary.bos), (slice(1, None), eos, vocabulary.eos)):
                if wanted:
                    place, source = first[edge], at[edge]
                    ids, begin, end = np.insert(ids, place, value), np.insert(begin, place, source), np.insert(end, place, source)
                    first = first + np.arange(len(first))
            told = vocabulary.decode(ids, first)
            raw = ids.astype("<u4").tobytes()
            spans = list(zip(first[:-1].tolist(), first[1:].tolist()))
            columns = [
                keys,
                pa.array(np.diff(first)),
                pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in told], pa.string()),
                pa.array(covered),
            ]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"]
            if arrays:
                begin, end = (x - np.repeat(at[:-1], np.diff(first)) for x in (begin, end))
                columns += [pa.array([x[a:b].astype(np.int64) for a, b in spans], pa.list_(pa.int64())) for x in (ids, begin, end)]
                columns.append(pa.array([x.decode() for x in told], pa.string()))
                names += ["ids", "begins", "ends", "decoded"]
            return pa.RecordBatch.from_arrays(columns, names)

        return work

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long"
    if arrays:
        schema += ", ids array<long>, begins array<long>, ends array<long>, decoded string"
    return scan(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("t")], schema, make)


def decode(rows: DataFrame, id_col: str = "id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``(id, text)``: the text of every array of ids, as the library decodes it; null or empty ids give an empty text."""
    path = model or default_model()
    kind = rows.schema[id_col].dataType.simpleString()

    def make():
        vocabulary = pieces(path)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lists = batch.column(1).to_pylist()
            for i in range(0, len(lists), 1024):
                part = [x or [] for x in lists[i : i + 1024]]
                first = np.concatenate(([0], np.cumsum([len(x) for x in part]))).astype(np.int64)
                told = vocabulary.decode(np.array([x for ids in part for x in ids], np.int64), first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), pa.array([x.decode() for x in told], pa.string())], ["id", "text"])

        return work

    return scan(rows, [F.col(id_col).alias("id"), F.col(ids_col).cast("array<long>").alias("ids")], f"id {kind}, text string", make)
