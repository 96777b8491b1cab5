"""SimHash near-duplicate groups by bit-sliced comparison inside exact candidate buckets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.util import partitions, scan, stored

BITS = 64
#: Rows of a bucket that one comparison block holds; larger buckets are split into pairs of blocks.
BLOCK = 2048


def fingerprint(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the ``shingle``-word shingles of a text, repeats included."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    left = np.concatenate(([0], ends[: -shingle])).tolist()
    right = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(left, right)), np.uint64, len(left))


def _majority(hashes: np.ndarray) -> int:
    """The 64 majority bits of many hashes, counted in slices so that a very long text needs no large matrix."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, fp long)`` of every row: majority bits over the shingle hashes; no words give zero.

    ``row`` is a 64-bit name of id and text, which tells rows with one id apart.

    Null and blank texts count as texts without words. Repeated rows give repeated rows. Texts are lower-cased
    in A-Z only and split at ASCII white space; fewer words than ``shingle`` form one shingle.
    """

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out = np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(1)):
                got = fingerprint(text.as_buffer().to_pybytes(), shingle) if text.is_valid else ()
                if len(got):
                    out[i] = _majority(got)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out)], ["id", "row", "fp"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    columns = [F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"), row_name(id_col, text_col).alias("row")]
    return scan(docs, columns, f"id {kind}, row long, fp long", make)


def row_name(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def _spread(values: np.ndarray) -> list[np.ndarray]:
    """Bit planes: plane ``b`` holds bit ``b`` of all values, 64 values to a machine word."""
    width = -(-len(values) // 64) * 64
    bits = np.zeros((BITS, width), np.uint8)
    bits[:, : len(values)] = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return list(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``left`` x ``right`` that differ in at most ``radius`` (below 4) bits.

    ``right`` stands as bit planes. For each block of left values the differences are added plane by plane
    into three carry-save counter words (ones, twos, fours and more); a block stops as soon as every lane is out.
    """
    planes = _spread(np.ascontiguousarray(right))
    lanes = len(planes[0])
    full = np.full(lanes, ~np.uint64(0))
    if len(right) % 64:
        full[-1] = np.uint64((1 << (len(right) % 64)) - 1)
    found_l, found_r = [], []
    each = max(1, (1 << 16) // lanes)
    for start in range(0, len(left), each):
        part = left[start : start + each]
        mask = np.zeros((len(part), 1), np.uint64)
        ones = np.zeros((len(part), lanes), np.uint64)
        twos, fours, out = ones.copy(), ones.copy(), ones
        for b in range(BITS):
            mask[:, 0] = np.uint64(0) - ((part >> np.uint64(b)) & np.uint64(1))
            diff = planes[b][None, :] ^ mask
            carry = ones & diff
            ones = ones ^ diff
            fours |= twos & carry
            twos ^= carry
            if b % 8 == 7:
                out = fours | (twos & ones if radius == 2 else twos if radius == 1 else (ones | twos) if radius == 0 else np.uint64(0))
                if np.all(full & ~out == 0):
                    break
        alive = full & ~out
        rows, cols = np.nonzero(alive)
        for r, c in zip(rows.tolist(), cols.tolist()):
            word = int(alive[r, c])
            while word:
                low = word & -word
                found_l.append(start + r)
                found_r.append(c * 64 + low.bit_length() - 1)
                word ^= low
    return np.array(found_l, np.int64), np.array(found_r, np.int64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root index of each of ``n`` nodes under links ``a - b``."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)], np.int64)


def near_links(prints: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the distinct values ``fp`` within ``radius`` (at most 2) bits.

    Two values at most two bits apart agree on two of four 16-bit quarters, so the six pairs of quarters are
    exact bucket keys. A bucket is compared bit-sliced; of a bucket's links only a spanning forest is kept (same
    components, at most one row per value). A bucket with more than ``block`` values is split into pairs of
    blocks, each a group of its own, so no group holds more than two blocks.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    quarter = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [F.struct(F.lit(k).alias("k"), (quarter(i) * 65536 + quarter(j)).alias("key")) for k, (i, j) in enumerate(combinations(range(4), 2))]
    rows = prints.select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.k", "x.key")
    heavy = (
        rows.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
        .select("k", "key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    )
    dealt = (
        rows.join(heavy, ["k", "key"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("k", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "fp")
    )
    order = ["k", "key", "i", "j"]
    spread = dealt.repartition(partitions(prints), *order).sortWithinPartitions(*order)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            col = {c: table[c].to_numpy() for c in (*order, "mine", "fp")}
            n = table.num_rows
            same = np.ones(max(0, n - 1), bool)
            for c in order:
                same &= col[c][1:] == col[c][:-1]
            cuts = np.concatenate(([0], np.flatnonzero(~same) + 1, [n]))
            fp = col["fp"].view(np.uint64)
            from_, to = [], []
            for s, e in zip(cuts[:-1][np.diff(cuts) > 1].tolist(), cuts[1:][np.diff(cuts) > 1].tolist()):
                mine = col["mine"][s:e]
                first, second = mine == col["i"][s], mine == col["j"][s]
                vals = fp[s:e]
                li, ri = np.flatnonzero(first), np.flatnonzero(second)
                a, b = near_pairs(vals[li], vals[ri], radius)
                a, b = li[a], ri[b]
                off = a != b
                roots = _forest(e - s, a[off], b[off])
                moved = np.flatnonzero(roots != np.arange(e - s))
                from_.append(vals[moved])
                to.append(vals[roots[moved]])
            join = lambda x: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(join(from_)), pa.array(join(to))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in order]
            first = [held[0].column(c)[0].as_py() for c in order]
            if last == first:
                continue
            # all but the last, perhaps unfinished, run can be compared now
            open_ = np.ones(batch.num_rows, bool)
            for c, v in zip(order, last):
                open_ &= batch.column(c).to_numpy() == v
            cut = int(np.argmax(open_))
            yield flush(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield flush(pa.Table.from_batches(held))

    return spread.mapInArrow(task, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, fp long, component_id, stays)``: texts linked by fingerprints of at most ``radius`` bits apart.

    ``component_id`` is the smallest id reachable, the row's own included; ``stays`` holds for the one text of each component
    that represents it (smallest id, then smallest ``row``; equal rows share it). Equal fingerprints are one node,
    so copies are never expanded into pairs. Null ids sort last: a component id is null only if all its ids are. An
    empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, shingle, id_col, text_col))
    least = lambda c: F.min(c).alias("least")
    nodes = prints.groupBy("fp").agg(least(F.struct(F.col("id").isNull().alias("none"), "id", "row")))
    nodes = stored(nodes)
    roots = components(near_links(nodes, radius)).select(F.col("node").alias("fp"), "root")
    classes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = classes.groupBy("root").agg(least("least"))
    of = classes.select("fp", "root").join(first, "root").select("fp", F.col("least.id").alias("component_id"), F.col("least.row").alias("_first"))
    return prints.join(of, "fp").select("id", "row", "fp", "component_id", (F.col("row") == F.col("_first")).alias("stays"))
