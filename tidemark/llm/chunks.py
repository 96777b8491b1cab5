"""Texts as chunks that tokenizers encode independently, each distinct chunk encoded once while a worker remembers it.

A chunk starts at a space or newline that follows a character that is not white space, and where letters and
punctuation meet. A tokenizer whose rules or vocabulary may join what stands on both sides of such a place gets whole
texts instead (each says so by ``cut``), so the ids of a text are the ids of its chunks. Distinct chunks are found by comparing bytes (Arrow's dictionary encoding), never by a hash alone.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from tidemark.llm.util import ragged, steps

#: Bytes of text in one step, and entries and key bytes that a worker's table may hold before it starts anew.
CHUNK_STEP, TABLE_ROWS, TABLE_BYTES = 4 << 20, 800_000, 32 << 20
#: Bytes of distinct chunks that are given to a tokenizer as one text.
JOIN_BYTES = 1 << 13

_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x0A]] = True
#: ASCII letters, and ASCII punctuation but the apostrophe (which may start a contraction).
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = True


def joins(pieces: list[bytes]) -> bool:
    """Whether a piece stands on both sides of a place where :func:`chunk_starts` cuts."""
    for x in pieces:
        data = np.frombuffer(x, np.uint8)
        if len(data) > 1 and len(chunk_starts(data, np.array([0, len(data)]))[0]) > 1:
            return True
    return False


def _ends_in_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character whose last byte is ``data[at]`` is white space or a control character, in any dialect's view."""
    last = data[at]
    one = np.where(at > 0, data[np.maximum(at - 1, 0)], 0)
    two = np.where(at > 1, data[np.maximum(at - 2, 0)], 0)
    wide = (one == 0xC2) & ((last == 0x85) | (last == 0xA0))
    wide |= (two == 0xE1) & (((one == 0x9A) & (last == 0x80)) | ((one == 0xA0) & (last == 0x8E)))
    wide |= (two == 0xE2) & (one == 0x80) & ((last <= 0x8B) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    wide |= (two == 0xE2) & (one == 0x81) & (last == 0x9F)
    wide |= (two == 0xE3) & (one == 0x80) & (last == 0x80)
    return (last <= 0x20) | (wide & (last >= 0x80))


def chunk_starts(data: np.ndarray, offsets: np.ndarray, cut: bool = True, keep: list[bytes] = []) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the chunks of all rows, in order, and the index of each row's first chunk (``rows + 1``).

    The strings ``keep`` are never cut inside.
    """
    begins = np.zeros(len(data), bool)
    if cut and len(data):
        at = np.flatnonzero(_CUT[data])
        at = at[at > 0]
        begins[at[~_ends_in_space(data, at - 1)]] = True
        # letters with accents below U+0100: two bytes, but for the signs of multiplication and division
        accent = np.zeros(len(data), bool)
        accent[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter, mark = _LETTER[data], _MARK[data]
        begins[1:] |= mark[1:] & (letter | accent)[:-1]
        begins[1:] |= mark[:-1] & (letter[1:] | np.append(accent[2:], False) if len(data) > 1 else False)
        for x in keep:
            raw = data.tobytes()
            at = raw.find(x)
            while at >= 0:
                begins[at + 1 : at + len(x)] = False
                at = raw.find(x, at + 1)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, offsets)


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct chunks and the index of every chunk among them; chunks follow one another without gaps."""
    if not len(starts):
        return [], np.zeros(0, np.int64)
    at = np.append(starts, len(data)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
    found = found.dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64)


class Ragged:
    """Growing rows of numbers, one after the other."""

    def __init__(self, kind):
        self.flat, self.at = np.zeros(0, kind), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(lengths)))
        self.flat = np.concatenate((self.flat, flat.astype(self.flat.dtype)))

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        return self.at[rows + 1] - self.at[rows]

    def take(self, rows: np.ndarray) -> np.ndarray:
        return ragged(self.flat, self.at[rows], self.lengths(rows))


class ChunkTable:
    """What ``make(chunks)`` gives for each distinct chunk, remembered in a worker process within fixed bounds.

    ``make`` returns named ``(flat, lengths)`` rows for a list of chunks. The table starts anew at a step once it
    holds ``TABLE_ROWS`` chunks or ``TABLE_BYTES`` of them; what a step needs is always whole.
    """

    def __init__(self, make: Callable[[list[bytes]], dict[str, tuple[np.ndarray, np.ndarray]]], kinds: dict):
        self.make, self.kinds = make, kinds
        self._new()

    def _new(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.of = {name: Ragged(kind) for name, kind in self.kinds.items()}

    def rows(self, chunks: list[bytes]) -> np.ndarray:
        if len(self.known) > TABLE_ROWS or self.held > TABLE_BYTES:
            self._new()
        got = np.array([self.known.get(x, -1) for x in chunks], np.int64)
        new = np.flatnonzero(got < 0)
        if len(new):
            add = [chunks[i] for i in new.tolist()]
            got[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(add, got[new].tolist()))
            self.held += sum(map(len, add))
            for name, (flat, lengths) in self.make(add).items():
                self.of[name].add(flat, lengths)
        return got

    def scan(self, data: np.ndarray, offsets: np.ndarray, cut: bool = True, keep: list[bytes] = []) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(i, j, table row of every chunk, first chunk of each row)`` for steps of the rows ``i`` to ``j``."""
        for i, j in steps(offsets, CHUNK_STEP):
            rows, code, first = self.step(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], cut, keep)
            yield i, j, rows[code], first

    def step(self, data: np.ndarray, offsets: np.ndarray, cut: bool = True, keep: list[bytes] = []) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Table rows of the distinct chunks, the index of every chunk among them, and the first chunk of each row."""
        starts, first = chunk_starts(data, offsets, cut, keep)
        chunks, code = distinct(data, starts)
        return self.rows(chunks), code, first


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each row's chunks."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def joined(chunks: list[bytes], encode: Callable[[str], np.ndarray], lead: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks and the number for each, many chunks encoded as one text.

    Only chunks that start with one ``lead`` or newline and end in a character that is not white space stand side by
    side; the others are encoded alone. ``lengths``: bytes of each id, by which the ids are dealt to the chunks.
    """
    if not chunks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(lead)
    size = np.array([len(x) for x in chunks], np.int64)
    ends = np.cumsum(size)
    flat = np.frombuffer(b"".join(chunks) + lead + b" ", np.uint8)
    starts = ends - size
    led = flat[starts] == lead[0]
    for k in range(1, n):
        led &= flat[starts + k] == lead[k]
    line = flat[starts] == 0x0A
    after = starts + np.where(line, 1, n)
    safe = (led | line) & (after < ends)
    after[~safe] = 0
    safe &= (flat[after] > 0x20) & (flat[after] != lead[0]) & ~_ends_in_space(flat, ends - 1)
    beside, alone = np.flatnonzero(safe), np.flatnonzero(~safe)
    parts, count = [], np.zeros(len(chunks), np.int64)
    stops = np.cumsum(size[beside])
    i = 0
    while i < len(beside):
        j = max(i + 1, int(np.searchsorted(stops, stops[i] + JOIN_BYTES)))
        group = beside[i:j]
        ids = encode(b"".join([chunks[k] for k in group.tolist()]).decode())
        dealt = np.searchsorted(np.cumsum(lengths[ids]), np.cumsum(size[group]), side="right")
        count[group] = np.diff(dealt, prepend=0)
        parts.append(ids)
        i = j
    for k in alone.tolist():
        parts.append(encode(chunks[k].decode()))
        count[k] = len(parts[-1])
    order = np.concatenate((beside, alone))
    at = np.empty(len(chunks), np.int64)
    at[order] = np.cumsum(count[order]) - count[order]
    return ragged(np.concatenate(parts), at, count), count


class ByteLevel:
    """Ids of chunks by a byte-level tokenizer of the tokenizers library; ``cut`` says whether its texts may be cut.

    Special strings of the tokenizer inside texts get their special ids unless ``plain`` is set.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.lib.encode_special_tokens = plain
        spec = json.loads(self.lib.to_str())
        pre = spec.get("pre_tokenizer") or {}
        added = spec["added_tokens"]
        simple = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"]) for t in added)
        level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.cut = bool(spec.get("normalizer") is None and level and simple)
        self.keep = [] if plain else [t["content"].encode() for t in added]
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        # fixed values: the byte alphabet of byte-level tokenizers
        fixed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        code = {chr(b): b for b in fixed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in fixed)}
        special = {t["id"]: t["content"].encode() for t in added}
        names = [self.lib.id_to_token(i) or "" for i in range(self.size)]
        self.bytes = [special[i] if i in special else bytes(code.get(c, 0) for c in x) for i, x in enumerate(names)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def ids(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of each chunk's."""
        if not self.cut:
            out = [self.encode(x.decode()) for x in chunks]
            return np.concatenate([*out, np.zeros(0, np.int64)]), np.array([len(x) for x in out], np.int64)
        return joined(chunks, self.encode, b" ", self.lengths)
