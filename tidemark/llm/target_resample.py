"""Importance resampling towards a target text distribution over hashed word n-grams.

A feature's bucket is the crc32 of its bytes. The crc is linear over XOR but for a constant of the length, so a table
gives what every byte value adds at every distance from the end; features that end at the same word share those
contributions, and one ``bitwise_xor.reduceat`` over word spans yields all of them. Spans beyond the table fold block
by block: a block's XOR is carried over the blocks behind it by the operator that appends a block of zero bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import LOWER, scan, steps, stored, text_bytes
from tidemark.operators.running import running_totals

#: Distances from the end that the byte table holds; also the bytes of a block of longer spans.
REACH = 128
#: Bytes of text in one step.
FEATURE_STEP = 2 << 20
_POLYNOMIAL = 0xEDB88320  # fixed value: the reflected polynomial of crc32


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), table >> np.uint32(1)).astype(np.uint32)
    return table


def _position_table(reach: int) -> np.ndarray:
    """``[distance * 256 + byte]``: what the byte adds to the crc's state with so many bytes behind it."""
    one = _byte_table()
    out = np.empty((reach, 256), np.uint32)
    out[0] = one
    for d in range(1, reach):
        out[d] = (out[d - 1] >> np.uint32(8)) ^ one[out[d - 1] & np.uint32(255)]
    return out.reshape(-1)


class PositionCrc:
    """crc32 of many byte spans at once, by contributions of bytes at their distance from the end."""

    def __init__(self, reach: int = REACH):
        self.reach, self.table = reach, _position_table(reach)
        one = _byte_table()
        # the operator "append reach zero bytes", by the four bytes of a state
        self.carry = np.empty((4, 256), np.uint32)
        for k in range(4):
            state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
            for _ in range(reach):
                state = (state >> np.uint32(8)) ^ one[state & np.uint32(255)]
            self.carry[k] = state
        self.zeros = np.array([zlib.crc32(bytes(n)) for n in range(4 * reach)], np.uint32)

    def constant(self, length: np.ndarray) -> np.ndarray:
        """crc32 of so many zero bytes: what a span's length alone adds."""
        out = self.zeros[np.minimum(length, len(self.zeros) - 1)]
        for n in np.unique(length[length >= len(self.zeros)]).tolist():
            crc, left = 0, n
            while left:
                crc = zlib.crc32(bytes(min(left, 1 << 20)), crc)
                left -= min(left, 1 << 20)
            out[length == n] = crc
        return out

    def appended(self, state: np.ndarray) -> np.ndarray:
        low = [self.carry[k][(state >> np.uint32(8 * k)) & np.uint32(255)] for k in range(4)]
        return low[0] ^ low[1] ^ low[2] ^ low[3]

    def near(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """XOR of the contributions of the bytes of spans (not empty) that have ``behind`` bytes after them, all in reach."""
        size = ends - starts
        first = np.cumsum(size) - size
        at = np.repeat(starts - first, size) + np.arange(int(size.sum()))
        distance = np.repeat(behind + ends, size) - 1 - at
        return np.bitwise_xor.reduceat(self.table[distance * 256 + data[at]], first)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Contributions of the bytes from ``starts`` to ``ends`` (not empty) of texts that end at ``stops``."""
        out = np.zeros(len(starts), np.uint32)
        blocks = -(-(stops - starts) // self.reach)
        short, long = np.flatnonzero(blocks <= 1), np.flatnonzero(blocks > 1)
        if len(short):
            out[short] = self.near(data, starts[short], ends[short], (stops - ends)[short])
        # long spans, the longest first: all that reach into a block fold it together, from the far end
        long = long[np.argsort(-blocks[long], kind="stable")]
        many = -blocks[long]
        for block in range(int(-many[0]) - 1 if len(long) else -1, -1, -1):
            now = long[: np.searchsorted(many, -block)]
            out[now] = self.appended(out[now])
            edge = stops[now] - block * self.reach
            low, high = np.maximum(starts[now], edge - self.reach), np.minimum(ends[now], edge)
            some = low < high
            if some.any():
                out[now[some]] ^= self.near(data, low[some], high[some], (edge - high)[some])
        return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of ASCII letters, digits and bytes beyond ASCII, one space after each, with their starts
    and the index of each row's first word."""
    text = LOWER[data]
    inside = (text >= 0x80) | ((text >= 0x30) & (text <= 0x39)) | ((text >= 0x61) & (text <= 0x7A))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    row = offsets[:-1][offsets[:-1] < len(data)]
    begins[row] = inside[row]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint8), starts, first
    # a byte's new place: the bytes of words before it, and a space for each word before its own
    at = np.cumsum(inside) + np.cumsum(begins) - 2
    out = np.full(int(inside.sum()) + len(starts), 0x20, np.uint8)
    out[at[inside]] = text[inside]
    return out, at[starts], first


def feature_buckets(crc: PositionCrc, data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Buckets of all features of every row: for one, two and three words ``(bucket, index of the last word)``, each
    last word once; then the index of each row's first word (``rows + 1``)."""
    text, starts, first = _words(data, offsets)
    n = len(starts)
    ends = np.append(starts[1:], len(text)) - 1
    inner = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    state, out = np.zeros(n, np.uint32), []
    for k in range(3):
        last = np.flatnonzero(inner >= k)
        if not len(last):
            break
        # the word k places before the last one with the space behind it joins what the nearer words gave
        word, stop = last - k, ends[last]
        state[last] ^= crc.spans(text, starts[word], stop if k == 0 else ends[word] + 1, stop)
        code = state[last] ^ crc.constant(stop - starts[word])
        out.append((code.astype(np.int64) % buckets, last))
    return out, first


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = 10_000) -> DataFrame:
    """``(bucket, n)``: features of all rows in each bucket that has any (at most ``buckets`` rows)."""

    def make():
        crc = PositionCrc()

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            data, offsets = text_bytes(batch.column(0))
            total = np.zeros(buckets, np.int64)
            for i, j in steps(offsets, FEATURE_STEP):
                found, _ = feature_buckets(crc, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)
                for code, _ in found:
                    total += np.bincount(code, minlength=buckets)
            own = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

        return work

    return scan(rows, [F.col(text_col).alias("t")], "bucket long, n long", make).groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = 10_000) -> DataFrame:
    """``(bucket, gain)`` of every bucket: 1000 times the log of the target's smoothed share over the corpus', floored."""
    have = bucket_counts(docs, text_col, buckets).withColumnRenamed("n", "s")
    want = bucket_counts(target, text_col, buckets).withColumnRenamed("n", "t")
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(have, "bucket", "left").join(want, "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    up = (F.col("t").cast("double") + 1) * (F.col("all_s") + buckets)
    down = (F.col("s").cast("double") + 1) * (F.col("all_t") + buckets)
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).alias("gain"))


def weigh(docs: DataFrame, gains: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000) -> DataFrame:
    """``(id, n_words, n_features, weight)`` per row; ``gains`` has one row a bucket and goes to every task."""
    got = gains.select("bucket", "gain").toArrow()
    table = np.zeros(buckets, np.int64)
    table[got["bucket"].to_numpy()] = got["gain"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        crc, gain = PositionCrc(), sent.value

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            data, offsets = text_bytes(batch.column(1))
            for i, j in steps(offsets, FEATURE_STEP):
                found, first = feature_buckets(crc, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)
                n = int(first[-1])
                by_word, each = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for code, last in found:
                    by_word[last] += gain[code]
                    each[last] += 1
                sums = [np.concatenate(([0], np.cumsum(x))) for x in (each, by_word)]
                columns = [pa.array(np.diff(first).astype(np.int64)), *(pa.array(x[first[1:]] - x[first[:-1]]) for x in sums)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], ["id", "n_words", "n_features", "weight"])

        return work

    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("t")]
    return scan(docs, columns, f"id {kind}, n_words long, n_features long, weight long", make)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, least_words: int = 20,
    percent: int = 5, seed: int = 42,
) -> DataFrame:
    """``(id, n_features, weight, score, rank)`` per row; ``rank`` is null for rows that are not drawn.

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII; features are all runs of one to
    three of them. The weight is the sum of the features' gains; the score adds Gumbel noise fixed by ``seed`` and id
    (``sha256('<seed>:<id>')``, a null id as an empty string). Of the rows with ``least_words`` words, ``percent`` in a
    hundred (floored) with the highest scores are drawn, ties to the smaller id (null first). Null and empty texts
    have no features and weight 0. Repeated rows are rows of their own, with equal scores and ranks one after the other.
    Empty tables give none; an empty target leaves a uniform one. Other columns are not read.
    """
    weighed = weigh(docs, bucket_gains(docs, target, text_col, buckets), id_col, text_col, buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    # the row number is written with the row, so that equal rows stay apart in every pass
    scored = stored(weighed.withColumn("score", F.col("weight") + noise).withColumn("_row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= least_words
    n = scored.where(able).count() * percent // 100
    least = _threshold(scored.where(able), n)
    near = able & (F.col("score") >= F.lit(least)) if least is not None else F.lit(False)
    order = [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("_row")]
    top = running_totals(scored.where(near).withColumn("_one", F.lit(1).cast("long")), [], order, ["_one"], prefix="_upto")
    columns = ["id", "n_features", "weight", "score"]
    ranked = top.select(*columns, F.when(F.col("_upto_one") <= n, F.col("_upto_one")).alias("rank"))
    return ranked.unionByName(scored.where(~near).select(*columns, F.lit(None).cast("long").alias("rank")))


def _threshold(rows: DataFrame, n: int) -> int | None:
    """The ``n``-th highest score: counts of scores in 4,096 steps, then again within the step that holds it."""
    if n <= 0:
        return None
    got = rows.agg(F.min("score").alias("a"), F.max("score").alias("b")).first()
    low, high, above = int(got.a), int(got.b), 0
    while high > low:
        step = max(1, -(-(high - low + 1) // 4096))
        bin_ = F.floor((F.col("score") - F.lit(low)) / F.lit(step)).cast("long")
        found = rows.where(F.col("score").between(low, high)).groupBy(bin_.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(found, key=lambda r: -r.k):
            if above + r.n >= n:
                low, high = low + r.k * step, min(high, low + (r.k + 1) * step - 1)
                break
            above += r.n
        if step == 1:
            break
    return low
