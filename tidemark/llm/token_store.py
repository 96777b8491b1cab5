"""Token ids in binary shards with a minimal perfect hash index for keyed access.

A shard is two files. ``.ids``: the raw ids of its rows one after the other, little-endian, two bytes each if the
vocabulary allows it, else four. ``.idx``: a JSON line with the sizes, then the bit arrays of the hash levels, a 32-bit
fingerprint and the first row and number of rows of every key, and the row offsets. Shards follow one another
in ascending key order, so the concatenated payloads are the corpus in that order.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chunks import ByteLevel, ChunkTable, row_sums
from tidemark.llm.util import mixed, partitions, scan, shared_folder, stored, text_bytes

#: Payload bytes after which a shard is closed.
SHARD_BYTES = 32 << 20
_SALT = np.uint64(0xA24BAED4963EE407)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Whole-text ids with the tokenizers library, each distinct chunk encoded once while the worker remembers it."""

    def __init__(self, path: str, end_id: int):
        self.lib = ByteLevel(path)
        self.type = np.dtype("<u2" if self.lib.size <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.type).tobytes()
        self.table = ChunkTable(lambda chunks: {"ids": self.lib.ids(chunks)}, {"ids": self.type})

    def rows(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of every text (null: empty) and the end id, as payload bytes."""
        data, offsets = text_bytes(column)
        for _, _, chunk, first in self.table.scan(data, offsets, self.lib.cut, self.lib.keep):
            ids = self.table.of["ids"]
            flat = ids.take(chunk).tobytes()
            at = np.concatenate(([0], np.cumsum(row_sums(ids.lengths(chunk), first)))) * self.type.itemsize
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                yield flat[a:b] + self.end

    def __call__(self, text: str) -> bytes:
        return next(self.rows(pa.array([text], pa.string())))


@lru_cache(1)
def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for a worker process, whose caches outlive a task."""
    return Encoder(path, end_id)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bit arrays, a key's slot is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = np.bitwise_count(np.concatenate(levels)) if levels else np.zeros(0, np.uint8)
        self.ranks = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in levels]))).astype(np.int64)

    @staticmethod
    def _place(codes: np.ndarray, level: int, words: int) -> np.ndarray:
        salt = np.uint64((int(_SALT) * (level + 1)) % (1 << 64))
        return (mixed(codes + salt) % np.uint64(words * 64)).astype(np.int64)

    @classmethod
    def build(cls, codes: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(codes):
            words = max(1, -(-len(codes) // 32))
            at = cls._place(codes, len(levels), words)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            codes = codes[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def slots(self, codes: np.ndarray) -> np.ndarray:
        """Slot of every key; for keys that were not in the set an arbitrary slot or -1."""
        out = np.full(len(codes), -1, np.int64)
        left = np.arange(len(codes))
        for k, bits in enumerate(self.levels):
            at = self._place(codes[left], k, len(bits))
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            w = word[hit]
            below = bits[w] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[self.first[k] + w] + np.bitwise_count(below)
            left = left[~hit]
        return out


def _codes(keys: np.ndarray) -> np.ndarray:
    return mixed(np.ascontiguousarray(keys, np.int64).view(np.uint64))


def _prints(codes: np.ndarray) -> np.ndarray:
    return (mixed(codes ^ _SALT) >> np.uint64(32)).astype(np.uint32)


def write_shard(where: fs.FileSystem, path: str, keys: list, payload: list[bytes], kind: np.dtype) -> int:
    """Write one shard of ``keys`` (ascending, nulls first, repeats allowed); returns the number of ids."""
    sizes = np.array([len(x) // kind.itemsize for x in payload], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    nulls = sum(k is None for k in keys)
    known, first, rows = np.unique(np.array(keys[nulls:], np.int64), return_index=True, return_counts=True)
    codes = _codes(known)
    mph = PerfectHash.build(codes)
    slot = mph.slots(codes)
    order = np.empty(len(known), np.int64)
    order[slot] = np.arange(len(known))
    head = {"ids": kind.str, "keys": len(known), "rows": len(keys), "null_rows": nulls, "levels": [len(x) for x in mph.levels]}
    parts = [json.dumps(head).encode() + b"\n", *(x.tobytes() for x in mph.levels), _prints(codes)[order].tobytes()]
    parts += [(first[order] + nulls).astype("<u4").tobytes(), rows[order].astype("<u4").tobytes(), offsets.astype("<u8").tobytes()]
    token = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
    for name, data in ((f"{path}.ids", payload), (f"{path}.idx", parts)):
        with where.open_output_stream(f"{name}.{token}.tmp", compression=None) as out:
            for x in data:
                out.write(x)
        where.move(f"{name}.{token}.tmp", name)
    return int(offsets[-1])


class Shard:
    """Keyed access to one shard: the index is read once, payload bytes only for the rows asked for."""

    def __init__(self, where: fs.FileSystem, path: str):
        with where.open_input_file(f"{path}.idx") as f:
            raw = f.read()
        cut = raw.index(b"\n") + 1
        head = json.loads(raw[:cut])
        self.kind, self.nulls, n = np.dtype(head["ids"]), head["null_rows"], head["keys"]

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal cut
            got = np.frombuffer(raw, kind, count, cut)
            cut += got.nbytes
            return got

        self.mph = PerfectHash([take("<u8", w) for w in head["levels"]])
        self.prints, self.first, self.rows = take("<u4", n), take("<u4", n), take("<u4", n)
        self.offsets = take("<u8", head["rows"] + 1).astype(np.int64)
        self.payload = where.open_input_file(f"{path}.ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of every key; 0 rows where the fingerprint says that it is absent."""
        codes = _codes(keys)
        slot = self.mph.slots(codes)
        has = slot >= 0
        has[has] = self.prints[slot[has]] == _prints(codes[has])
        first, rows = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[has], rows[has] = self.first[slot[has]], self.rows[slot[has]]
        return first, rows

    def ids(self, row: int) -> np.ndarray:
        a, b = int(self.offsets[row]), int(self.offsets[row + 1])
        self.payload.seek(a * self.kind.itemsize)
        return np.frombuffer(self.payload.read((b - a) * self.kind.itemsize), self.kind)

    def close(self) -> None:
        self.payload.close()


class TokenStore:
    """Written shards and their manifest ``(part, seq, path, low, high, nulls, n_rows, n_ids)``."""

    def __init__(self, manifest: DataFrame, folder: str):
        self.manifest, self.folder = manifest, folder

    @classmethod
    def write(
        cls, docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
        folder: str | None = None, shard_bytes: int = SHARD_BYTES,
    ) -> TokenStore:
        """Encode every whole text (null: empty), append ``end_id`` and write shards in ascending key order.

        Rows are range-partitioned and sorted by key (an integer; nulls first; ties by text). A task holds one open
        shard. Files are written beside their final name and moved, so a task that runs again leaves whole files.
        """
        path, folder = tokenizer or default_tokenizer(), folder or shared_folder(docs, "tokens")

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where, root = fs.FileSystem.from_uri(folder)
            where.create_dir(root, recursive=True)
            encode, part = encoder(path, end_id), TaskContext.get().partitionId()
            keys, payload, held, seq, out = [], [], 0, 0, []

            def close() -> None:
                name = f"part-{part:06d}-{seq:06d}"
                n = write_shard(where, f"{root}/{name}", keys, payload, encode.type)
                known = [k for k in (keys[sum(x is None for x in keys) :] or [None])]
                out.append((part, seq, name, known[0], known[-1], keys[0] is None, len(keys), n))

            for batch in batches:
                for key, ids in zip(batch.column(0).to_pylist(), encode.rows(batch.column(1))):
                    keys.append(key)
                    payload.append(ids)
                    held += len(ids) + 40
                    if held >= shard_bytes:
                        close()
                        keys, payload, held, seq = [], [], 0, seq + 1
            if keys:
                close()
            names = ["part", "seq", "path", "low", "high", "nulls", "n_rows", "n_ids"]
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema=pa.schema(
                [("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("nulls", pa.bool_()), ("n_rows", pa.int64()), ("n_ids", pa.int64())]
            ))

        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
        rows = rows.repartitionByRange(partitions(docs), "id").sortWithinPartitions("id", "t")
        schema = "part int, seq int, path string, low long, high long, nulls boolean, n_rows long, n_ids long"
        return cls(stored(rows.mapInArrow(task, schema)), folder)

    def lookup(self, keys: DataFrame, key_col: str = "doc_id", arrays: bool = False) -> DataFrame:
        """``(id, start, n_tokens, ids_crc32)`` of every stored row of the given keys, with ``arrays`` also ``ids``.

        Each task gets the shards' key ranges (32 bytes for a shard of many megabytes), finds the shards that may
        hold a key, and the keys of a shard meet in sorted runs. Repeated keys count once; absent keys give no row.
        """
        spark: SparkSession = keys.sparkSession
        listed = self.manifest.orderBy("part", "seq").select("path", "low", "high", "nulls", "n_ids").toArrow()
        low, high = listed["low"].to_numpy(), listed["high"].to_numpy()
        names, nulls = listed["path"].to_pylist(), listed["nulls"].to_numpy()
        starts = np.concatenate(([0], np.cumsum(listed["n_ids"].to_numpy()))).astype(np.int64)
        whole = np.flatnonzero(listed["low"].is_valid().to_numpy(zero_copy_only=False))
        low, high = low[whole].astype(np.int64), high[whole].astype(np.int64)
        sent = spark.sparkContext.broadcast((low, high, whole, np.flatnonzero(nulls), names, starts))
        folder = self.folder

        def make_shards():
            low, high, whole, null_shards, _, _ = sent.value

            def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                column = batch.column(0)
                valid = column.is_valid().to_numpy(zero_copy_only=False)
                values = column.fill_null(0).to_numpy()
                a = np.searchsorted(high, values, side="left")
                b = np.searchsorted(low, values, side="right")
                n = np.where(valid, np.maximum(b - a, 0), len(null_shards))
                row = np.repeat(np.arange(len(values)), n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                shard = np.empty(len(row), np.int64)
                ok = valid[row]
                shard[ok] = whole[(a[row] + step)[ok]]
                shard[~ok] = null_shards[step[~ok]]
                yield pa.RecordBatch.from_arrays([column.take(pa.array(row)), pa.array(shard)], ["id", "shard"])

            return work

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, _, _, _, names, starts = sent.value
            where, root = fs.FileSystem.from_uri(folder)
            now, shard = -1, None
            for batch in batches:
                at = batch.column(1).to_numpy()
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1, [len(at)])) if len(at) else [0]
                for s, e in zip(cuts[:-1], cuts[1:]):
                    if at[s] != now:
                        if shard:
                            shard.close()
                        now, shard = int(at[s]), Shard(where, f"{root}/{names[int(at[s])]}")
                    ids = batch.column(0).slice(s, e - s)
                    first, rows = shard.find(ids.fill_null(0).to_numpy())
                    for k in np.flatnonzero(~ids.is_valid().to_numpy(zero_copy_only=False)).tolist():
                        first[k], rows[k] = 0, shard.nulls
                    take = np.repeat(np.arange(len(rows)), rows)
                    row = np.repeat(first, rows) + np.arange(len(take)) - np.repeat(np.cumsum(rows) - rows, rows)
                    for i in range(0, len(row), 512):
                        got = [shard.ids(r) for r in row[i : i + 512].tolist()]
                        columns = [
                            ids.take(pa.array(take[i : i + 512])),
                            pa.array(starts[now] + shard.offsets[row[i : i + 512]]),
                            pa.array([len(x) for x in got], pa.int64()),
                            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in got], pa.int64()),
                        ]
                        if arrays:
                            columns.append(pa.array([x.astype(np.int64) for x in got], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32", *(["ids"] if arrays else [])])
            if shard:
                shard.close()

        wanted = keys.select(F.col(key_col).cast("long").alias("id")).distinct()
        dealt = scan(wanted, ["id"], "id long, shard long", make_shards)
        dealt = dealt.repartition(partitions(keys), "shard").sortWithinPartitions("shard", "id")
        return dealt.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if arrays else ""))
