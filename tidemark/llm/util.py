"""Helpers shared by the operators: stored intermediates and numpy views of Arrow text columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidemark.session import ensure_checkpoint_dir

#: Bytes of text that one numpy step works on (a longer document is one step of its own).
STEP_BYTES = 2 << 20


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage in a way that survives lost executors, and lets several readers share one scan.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(df: DataFrame, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the ``len + 1`` row offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per row, the index of its first word (``rows + 1``)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, STEP_BYTES + 4096), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 4 * STEP_BYTES:  # the powers for a very long text are not kept
            _powers[kind] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def byte_codes(seed: int) -> np.ndarray:
    """A fixed odd-looking 64-bit code for each byte value."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


#: Bytes from which a range gets a hash of its bytes: differences of a polynomial modulo 2^64 can cancel out in long ones.
LONG_RANGE = 256


class Hashes:
    """Hashes of any byte range of ``data``: polynomials modulo 2^64 by prefix sums, in constant time per range, and
    XXH64 for ranges of ``LONG_RANGE`` bytes or more."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        n = len(data)
        self.data, self.seed = data, seed
        self.sums = np.zeros(n + 1, np.uint64)
        np.take(byte_codes(seed), data, out=self.sums[1:])
        self.sums[1:] *= _power("up", _MULTIPLIER, n)
        np.cumsum(self.sums, out=self.sums)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * _power("down", _INVERSE, len(self.sums))[starts]
        out = mixed(raw + (ends - starts).astype(np.uint64))
        for k in np.flatnonzero(ends - starts >= LONG_RANGE).tolist():
            out[k] = xxhash.xxh64_intdigest(self.data[starts[k] : ends[k]].tobytes(), self.seed)
        return out


def scan(df: DataFrame, columns: list, schema, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """``mapInArrow`` over ``columns``: ``make()`` runs once per task and gives the function for its batches."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            yield from work(batch)

    return df.select(*columns).mapInArrow(task, schema)


class Finder:
    """Positions of 64-bit keys in a fixed key set: sorted keys with a bucket table over their scrambled top bits."""

    def __init__(self, keys: np.ndarray):
        code = mixed(np.ascontiguousarray(keys).view(np.uint64))
        self.order = np.argsort(code, kind="stable")
        self.codes = np.append(code[self.order], np.uint64(0))
        self.bits = max(1, int(len(keys)).bit_length())
        tops = (self.codes[:-1] >> np.uint64(64 - self.bits)).astype(np.int64)
        self.starts = np.searchsorted(tops, np.arange((1 << self.bits) + 1)).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key in the set given at the start, -1 where absent."""
        code = mixed(np.ascontiguousarray(keys).view(np.uint64))
        top = (code >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[top].astype(np.int64), self.starts[top + 1]
        out = np.full(len(code), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        at = at[open_]
        while len(open_):
            hit = self.codes[at] == code[open_]
            out[open_[hit]] = self.order[at[hit]]
            left = ~hit
            open_, at = open_[left], at[left] + 1
            more = at < end[open_]
            open_, at = open_[more], at[more]
        return out


def most_frequent(table: DataFrame, count: str, limit: int) -> int:
    """The smallest power of two such that at most ``limit`` rows of ``table`` have a ``count`` of it or more."""
    from pyspark.sql import functions as F

    level = F.floor(F.log2(F.greatest(F.col(count), F.lit(1)).cast("double"))).cast("int")
    found = {r.level: r.n for r in table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, least = 0, 63
    for k in sorted(found, reverse=True):
        total += found[k]
        if total > limit:
            break
        least = k
    return 1 << min(least, 62)


def distinct_words(data: np.ndarray, offsets: np.ndarray, seed: int = 0):
    """``(hashes, first start, first end, index of each word, rows' first words)`` of the distinct words of a step."""
    starts, ends, first = words(data, offsets)
    keys = Hashes(data, seed).of(starts, ends)
    unique, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return unique, starts[at], ends[at], inverse, first


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start : start + length]`` one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]
