"""Alignment of two tokenizers' ids by byte range, with corpus counts of the linked id pairs.

Both tokenizers cut the same bytes, so the union of their token ends cuts a text into segments, each inside one token
of either: a segment is a link, and an end of both closes a group. The distinct pairs of the corpus get a minimal
perfect hash; documents are counted into dense vectors by hash slot, which are summed as a tree; a second pass aligns
the documents again and looks the counts up, each slot's key being compared with the pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import ByteLevel, ChunkTable, row_sums
from tidemark.llm.piece_map import default_model, pieces
from tidemark.llm.token_store import PerfectHash, default_tokenizer
from tidemark.llm.util import mixed, partitions, ragged, steps, stored, text_bytes

#: Pairs in a block of the index, and in a round: a round's index (about 8 bytes a pair, and 9 of results) goes to every task.
BLOCK_PAIRS, ROUND_PAIRS = 1 << 15, 1 << 22
#: Bytes of text in one step.
ALIGN_STEP = 3 << 20


class Aligner:
    """Links, groups and pairs of chunks of text; A is a byte-level tokenizer, B a SentencePiece model."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteLevel(byte_path, plain=True), pieces(piece_path)
        self.cut = self.a.cut and self.b.cut
        a_bytes = np.frombuffer(b"".join(self.a.bytes), np.uint8)
        self.a_flat, self.a_at = a_bytes, np.concatenate(([0], np.cumsum(self.a.lengths)))
        names = [str(i).encode() + b"," for i in range(max(self.a.size, len(self.b.bytes)))]
        self.name_size = np.array([len(x) for x in names], np.int64)
        self.name_at, self.name_flat = np.concatenate(([0], np.cumsum(self.name_size))), np.frombuffer(b"".join(names), np.uint8)
        kinds = {"n": np.int32, "pairs": np.int64, "groups": object, "ok": np.int8}
        self.table = ChunkTable(self.align, kinds)

    def align(self, chunks: list[bytes]) -> dict:
        """Per chunk: numbers of A ids, B ids and groups; pairs (A id * 2^32 + B id), one per link; the groups as text; whether both cover it."""
        a, n_a = self.a.ids(chunks)
        b, n_b = self.b.ids(chunks)
        size = np.array([len(x) for x in chunks], np.int64)
        raw = np.frombuffer(b"".join(chunks), np.uint8)
        ends = np.cumsum(size)

        def same(ids: np.ndarray, n: np.ndarray, flat: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            first = np.concatenate(([0], np.cumsum(n)))
            whole = row_sums(lengths[ids], first) == size
            if whole.all():
                wrong = np.concatenate(([0], np.cumsum(ragged(flat, at[ids], lengths[ids]) != raw)))
                return wrong[ends] == wrong[ends - size]
            told = ragged(flat, at[ids], lengths[ids]).tobytes()
            cut = np.concatenate(([0], np.cumsum(row_sums(lengths[ids], first))))
            return np.array([told[cut[i] : cut[i + 1]] == x for i, x in enumerate(chunks)], bool)

        ok = same(a, n_a, self.a_flat, self.a_at, self.a.lengths) & same(b, n_b, self.b.flat, self.b.at, self.b.lengths)
        if not ok.all():
            # what a tokenizer does not give back has no alignment; its text is left out as a whole
            a, b, raw_size = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)], np.where(ok, size, 0)
            n_a, n_b, ends = np.where(ok, n_a, 0), np.where(ok, n_b, 0), np.cumsum(raw_size)
        a_end, b_end = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        total = int(ends[-1]) if len(ends) else 0
        of_a, of_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        of_a[a_end], of_b[b_end] = True, True
        link, close = np.flatnonzero(of_a | of_b), np.flatnonzero(of_a & of_b)
        pair = (a[np.searchsorted(a_end, link)] << 32) | b[np.searchsorted(b_end, link)]
        n_links = np.diff(np.searchsorted(link, ends, side="right"), prepend=0)
        n_groups = np.diff(np.searchsorted(close, ends, side="right"), prepend=0)
        # the ids of a group's A tokens, then its B tokens, as text with a separator after each
        a_group, b_group = np.searchsorted(close, a_end), np.searchsorted(close, b_end)
        a_upto, b_upto = np.searchsorted(a_end, close, side="right"), np.searchsorted(b_end, close, side="right")
        place = np.concatenate((
            np.arange(len(a)) + np.concatenate(([0], b_upto))[a_group],
            np.arange(len(b)) + a_upto[b_group] if len(b) else np.zeros(0, np.int64),
        ))
        ids = np.empty(len(place), np.int64)
        ids[place] = np.concatenate((a, b))
        text = ragged(self.name_flat, self.name_at[ids], self.name_size[ids])
        stop = np.cumsum(self.name_size[ids])
        last = np.concatenate((np.isin(np.arange(len(a)), a_upto - 1), np.isin(np.arange(len(b)), b_upto - 1)))
        mark = np.where(np.arange(len(place)) < len(a), ord("|"), ord(";"))
        text[stop[place[last]] - 1] = mark[last]
        told, first = text.tobytes(), np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(n_a + n_b)))]
        cuts = first.tolist()
        groups = np.empty(len(chunks), object)
        groups[:] = [told[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
        three = np.stack((n_a, n_b, n_groups), axis=1).reshape(-1)
        one = np.ones(len(chunks), np.int64)
        return {"n": (three, 3 * one), "pairs": (pair, n_links), "groups": (groups, one), "ok": (ok.astype(np.int8), one)}

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A space and the text of each row whose normalised form is just that; other rows and empty ones become empty."""
        new, at, _ = self.b.normalizer(data, offsets)
        size = np.diff(offsets)
        fits = (np.diff(at) == size + 1) & (size > 0)
        wrong = np.zeros(len(size), bool)
        row = np.flatnonzero(fits)
        if len(row):
            mine = ragged(new, at[row] + 1, size[row]) != ragged(data, offsets[row], size[row])
            total = np.concatenate(([0], np.cumsum(mine)))
            ends = np.cumsum(size[row])
            wrong[row] = (total[ends] != total[ends - size[row]]) | (new[at[row]] != 0x20)
        fits &= ~wrong
        return ragged(new, at[:-1][fits], np.diff(at)[fits]), np.concatenate(([0], np.cumsum(np.where(fits, size + 1, 0))))

    def scan(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """``(i, j, table rows of the distinct chunks, index of every chunk among them, first chunk of each row)``."""
        data, offsets = text_bytes(column)
        for i, j in steps(offsets, ALIGN_STEP):
            flat, at = self.texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            rows, code, first = self.table.step(flat, at, self.cut)
            bad = self.table.of["ok"].flat[rows] == 0
            if bad.any():  # a text with one such chunk has no tokens
                left = row_sums(bad[code], first) == 0
                keep = np.repeat(left, np.diff(first))
                code = code[keep]
                first = np.concatenate(([0], np.cumsum(np.where(left, np.diff(first), 0))))
            yield i, j, rows, code, first


@lru_cache(1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One aligner for a worker process, whose table outlives a task."""
    return Aligner(byte_path, piece_path)


def _code(pair: np.ndarray) -> np.ndarray:
    return mixed(np.ascontiguousarray(pair).view(np.uint64))


def _sorted_once(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Index:
    """Slots of the pairs of some blocks: a minimal perfect hash for each block, and the key of every slot."""

    def __init__(self, blocks: int, held: dict[int, tuple[list[bytes], bytes]]):
        self.blocks, self.hash, self.start, self.keys = blocks, {}, {}, {}
        total = 0
        for block in sorted(held):
            levels, keys = held[block]
            self.hash[block] = PerfectHash([np.frombuffer(x, np.uint64) for x in levels])
            self.keys[block] = np.frombuffer(keys, np.int64)
            self.start[block] = total
            total += len(self.keys[block])
        self.size = total

    def __call__(self, pair: np.ndarray) -> np.ndarray:
        """The slot of every pair, -1 where these blocks do not hold it."""
        out = np.full(len(pair), -1, np.int64)
        block = (_code(pair) % np.uint64(self.blocks)).astype(np.int64) if len(pair) else out
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order], prepend=-1)) if len(order) else np.zeros(0, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(order))):
            where = order[a:b]
            k = int(block[where[0]])
            if k in self.hash:
                slot = self.hash[k].slots(_code(pair[where]))
                right = (slot >= 0) & (self.keys[k][slot] == pair[where])
                out[where[right]] = self.start[k] + slot[right]
        return out


def _distinct_pairs(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``(pair)``: every id pair that a text links, once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(byte_path, piece_path)
        # a bounded memory of what this task gave already: the last pair of every hash value
        sent = np.full(1 << 20, -1, np.int64)
        for batch in batches:
            for _, _, rows, code, _ in work.scan(batch.column(0)):
                used = np.zeros(len(rows), bool)
                used[code] = True
                pair = work.table.of["pairs"].take(rows[used])
                at = (_code(pair) >> np.uint64(44)).astype(np.int64)
                new = sent[at] != pair
                sent[at[new]] = pair[new]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(pair[new]))], ["pair"])

    return docs.select("_t").mapInArrow(task, "pair long").distinct()


def _blocks(pairs: DataFrame, blocks: int) -> DataFrame:
    """``(block, n, levels array<binary>, keys binary)``: the perfect hash of each block of pairs and its keys by slot."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = batch.column(0).to_numpy()
            block = (_code(pair) % np.uint64(blocks)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column(0)], ["block", "pair"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's pairs follow one another; only one block is held."""
        now, held = -1, []

        def close() -> pa.RecordBatch:
            keys = np.concatenate(held)
            found = PerfectHash.build(_code(keys))
            order = np.empty_like(keys)
            order[found.slots(_code(keys))] = keys
            levels = [x.tobytes() for x in found.levels]
            return pa.RecordBatch.from_arrays(
                [pa.array([now]), pa.array([len(keys)]), pa.array([levels], pa.list_(pa.binary())), pa.array([order.tobytes()])], ["block", "n", "levels", "keys"]
            )

        for batch in batches:
            block, pair = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)])) if len(block) else [0]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if block[i] != now:
                    if held:
                        yield close()
                    now, held = int(block[i]), []
                held.append(pair[i:j])
        if held:
            yield close()

    rows = pairs.mapInArrow(dealt, "block long, pair long").repartition(min(blocks, partitions(pairs)), "block").sortWithinPartitions("block")
    return stored(rows.mapInArrow(build, "block long, n long, levels array<binary>, keys binary"))


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    """The vectors of each key summed, one held at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def close() -> pa.RecordBatch:
            columns = [pa.array([k], pa.int64()) for k in now]
            return pa.RecordBatch.from_arrays([*columns, pa.array([total.tobytes()])], [*by, "counts"])

        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(c)[i].as_py() for c in range(len(by)))
                add = np.frombuffer(batch.column(len(by))[i].as_buffer(), np.int64)
                if key != now:
                    if now is not None:
                        yield close()
                    now, total = key, np.zeros(len(add), np.int64)
                total += add
        if now is not None:
            yield close()

    dealt = rows.select(*by, "counts").repartition(partitions(rows), *by).sortWithinPartitions(*by)
    return dealt.mapInArrow(task, ", ".join(f"{c} long" for c in by) + ", counts binary")


def _counts(docs: DataFrame, index, paths: tuple[str, str], fan: int) -> DataFrame:
    """``(block, counts binary)``: by slot, how many documents link the pair; tasks' dense vectors summed in two levels."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, found = aligner(*paths), Index(*index.value)
        counts = np.zeros(found.size, np.int64)
        for batch in batches:
            for i, j, rows, code, first in work.scan(batch.column(0)):
                if not len(code):
                    continue
                pairs = work.table.of["pairs"]
                slot, n = found(pairs.take(rows)), pairs.lengths(rows)
                begin = np.cumsum(n) - n
                doc = np.repeat(np.arange(j - i), np.diff(first))
                both = _sorted_once(doc * len(rows) + code)
                doc, code = both // len(rows), both % len(rows)
                many = n[code]
                held = ragged(slot, begin[code], many)
                one = _sorted_once((np.repeat(doc, many) * (found.size + 1) + held)[held >= 0])
                np.add.at(counts, one % (found.size + 1), 1)
        part = TaskContext.get().partitionId() % fan
        for block, start in found.start.items():
            own = counts[start : start + len(found.keys[block])]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part], pa.int64()), pa.array([own.tobytes()])], ["block", "part", "counts"])

    rows = docs.select("_t").mapInArrow(task, "block long, part long, counts binary")
    return _summed(_summed(rows, ["block", "part"]), ["block"])


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_tokenizer: str | None = None, piece_model: str | None = None,
    groups: bool = False, round_pairs: int = ROUND_PAIRS, block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per row; with ``groups`` their text, too.

    A encodes a space and the text, B the text (it adds the space); special strings inside texts are plain text. A text
    that is null, empty, or that a tokenizer does not give back byte for byte has no tokens: zeros and an empty digest.
    A pair's count is the number of rows of ``docs`` that link it anywhere; ``count_sum`` adds it up over a row's links and
    ``n_best`` counts the links whose pair has the highest count of its A id, ties included. Repeated rows count as
    documents of their own; an empty table gives none; other columns are not read.

    The number of distinct pairs is bounded by the two vocabularies, not by the corpus. A round sends the index of at most
    ``round_pairs`` of them (and one block) to the tasks; where there are more, the documents are read again for each round.
    """
    spark = docs.sparkSession
    paths = (byte_tokenizer or default_tokenizer(), piece_model or default_model())
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"))
    pairs = stored(_distinct_pairs(rows, *paths))
    total = pairs.count()
    blocks = max(1, -(-total // block_pairs))
    index = _blocks(pairs, blocks)
    sizes = index.select("block", "n").orderBy("block").collect()
    rounds: list[list[int]] = []
    held = round_pairs
    for r in sizes:
        if held + r.n > round_pairs:
            rounds.append([])
            held = 0
        rounds[-1].append(r.block)
        held += r.n

    def sent(of: list[int], more: DataFrame | None = None) -> tuple:
        """A round's blocks, broadcast (at most ``round_pairs`` pairs), and their rows with those of ``more``."""
        picked = index.where(F.col("block").between(of[0], of[-1])).select("block", "levels", "keys")
        if more is not None:
            picked = picked.join(more, "block")
        got = picked.toArrow().to_pylist()
        plain = (blocks, {r["block"]: (r["levels"], r["keys"]) for r in got})
        return spark.sparkContext.broadcast(plain), got

    fan = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
    counted = [stored(_counts(rows, sent(of)[0], paths, fan)) for of in rounds]
    best = _best(spark, index, counted)
    done = rows
    for n, of in enumerate(rounds or [[]]):
        last = n + 1 >= len(rounds)
        if of:
            found, got = sent(of, counted[n])
            results = spark.sparkContext.broadcast({r["block"]: r["counts"] for r in got})
        else:
            found, results = spark.sparkContext.broadcast((1, {})), spark.sparkContext.broadcast({})
        columns = ["id", "_t"] + (["_best", "_sum"] if n else [])
        schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + (", groups string" if groups else "")
        if not last:
            schema = f"id {kind}, _t string, _best long, _sum long"
        done = done.select(*columns).mapInArrow(_looked_up(found, results, best, paths, last, groups), schema)
        if not last:
            done = stored(done)
    return done


def _best(spark, index: DataFrame, counted: list[DataFrame]):
    """The highest count of every A id, broadcast: as many numbers as A has ids."""
    if not counted:
        return spark.sparkContext.broadcast(np.zeros(1, np.int64))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, n = np.frombuffer(keys, np.int64) >> 32, np.frombuffer(counts, np.int64)
                most = np.zeros(int(a.max()) + 1, np.int64)
                np.maximum.at(most, a, n)
                own = np.flatnonzero(most)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(most[own])], ["a", "n"])

    every = counted[0]
    for more in counted[1:]:
        every = every.unionByName(more)
    rows = index.select("block", "keys").join(every, "block").select("keys", "counts").mapInArrow(task, "a long, n long")
    most = rows.groupBy("a").agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(int(max(most["a"].to_numpy(), default=0)) + 1, np.int64)
    out[most["a"].to_numpy()] = most["n"].to_numpy()
    return spark.sparkContext.broadcast(out)


def _looked_up(found, results, best, paths: tuple[str, str], last: bool, groups: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, index, most = aligner(*paths), Index(*found.value), best.value
        counts = np.zeros(index.size + 1, np.int64)
        for block, start in index.start.items():
            counts[start : start + len(index.keys[block])] = np.frombuffer(results.value[block], np.int64)
        for batch in batches:
            for i, j, rows, code, first in work.scan(batch.column(1)):
                of = work.table.of
                pair, n = of["pairs"].take(rows), of["pairs"].lengths(rows)
                slot = index(pair)
                here = counts[slot]
                top = (slot >= 0) & (here == most[np.minimum(pair >> 32, len(most) - 1)])
                at = np.concatenate(([0], np.cumsum(n)))
                sums = [row_sums(row_sums(x, at)[code], first) for x in (top, here)]
                if batch.num_columns > 2:
                    sums = [x + batch.column(2 + k).slice(i, j - i).to_numpy() for k, x in enumerate(sums)]
                keys = batch.column(0).slice(i, j - i)
                if not last:
                    yield pa.RecordBatch.from_arrays([keys, batch.column(1).slice(i, j - i), *map(pa.array, sums)], ["id", "_t", "_best", "_sum"])
                    continue
                three = of["n"].flat.reshape(-1, 3)[rows].astype(np.int64)
                counted = [row_sums(three[:, k][code], first) for k in range(3)] + [row_sums(n[code], first)]
                told = of["groups"].flat[rows][code].tolist()
                cuts = first.tolist()
                texts = [b"".join(told[a:b])[:-1] for a, b in zip(cuts[:-1], cuts[1:])]
                digest = pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in texts], pa.string())
                columns = [keys, *map(pa.array, counted), *map(pa.array, sums), digest]
                names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
                if groups:
                    columns.append(pa.array([x.decode() for x in texts], pa.string()))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(columns, names)

    return task
