"""Repeated byte strings across a corpus, by prefix-free parsing at rolling-hash triggers.

Every ``length``-byte string has one trigger: the place in it where a rolling hash of ``GRAM`` bytes is smallest.
The strings of a text that share a trigger start in one run of positions; the bytes that they cover are a phrase, and the
phrases of a text, in order, are its parse. Equal strings have equal triggers at equal distances, so:

1. the parse of every text is dealt by trigger, and phrases whose trigger stands nowhere else leave;
2. the others form the dictionary, grouped by trigger: their suffixes, cut to ``length`` bytes and as far as they are starts of
   the phrase's strings, are sorted by fingerprint and then by corpus order (smallest document, position), which puts
   every repeat behind its first occurrence;
3. the starts that are repeats go back to the texts as ranges, and the bytes that they cover are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tidemark.llm.util import Hashes, mixed, partitions, scan, steps, stored, text_bytes

GRAM = 32
#: Phrases of one trigger that are compared in one task's memory; the strings of commoner triggers are compared by Spark's joins.
RUN_ROWS = 1 << 16
STEP = 1 << 19


def text_key(raw: bytes) -> int:
    """64-bit name of a text, as a signed number; equals Spark's ``xxhash64`` of the string."""
    return int(np.uint64(xxhash.xxh64_intdigest(raw, 42)).view(np.int64))


def parse(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of all rows: ``(row, first start, number of starts, place of the trigger)``; places count in ``data``."""
    none = np.zeros(0, np.int64)
    span = length - GRAM + 1
    if len(data) < length:
        return none, none, none, none
    hashes = Hashes(data, seed=3)
    at = np.arange(len(data) - GRAM + 1)
    key = (hashes.of(at, at + GRAM) >> np.uint64(24)) << np.uint64(24)
    if len(data) >= 1 << 24:
        # places do not fit beside the hash: number the hashes, so that ties still go to the leftmost place
        order = np.argsort(key, kind="stable")
        key = np.empty(len(order), np.uint64)
        key[order] = np.arange(len(order), dtype=np.uint64)
        least, width = key, 1
        place = order
    else:
        key |= at.astype(np.uint64)
        least, width, place = key, 1, None
    while width * 2 <= span:
        least, width = np.minimum(least[: len(least) - width], least[width:]), width * 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    trigger = place[least.astype(np.int64)] if place is not None else (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    lengths = np.diff(offsets)
    many = np.maximum(lengths - length + 1, 0)
    row = np.repeat(np.arange(len(lengths)), many)
    start = np.arange(int(many.sum())) + np.repeat(offsets[:-1] - (np.cumsum(many) - many), many)
    trigger = trigger[start]
    new = np.ones(len(start), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    return row[first], start[first], count, trigger[first]


def _pack(lo: np.ndarray, count: np.ndarray, to_trigger: np.ndarray) -> np.ndarray:
    return (lo << 24) | (count << 12) | to_trigger


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, int]]:
    """``(row, text, key)`` of the distinct texts of a batch, each at its first row (smallest id, null first; then ``ord``)."""
    ids, order = batch.column("id").to_pylist(), batch.column("ord").to_pylist()
    best: dict[int, int] = {}
    raws = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("t")]
    rank = [(x is not None, x if x is not None else 0, o) for x, o in zip(ids, order)]
    for i, raw in enumerate(raws):
        k = text_key(raw)
        j = best.get(k)
        if j is None or rank[i] < rank[j]:
            best[k] = i
    for k, i in best.items():
        yield i, raws[i], k


def _parsed(docs: DataFrame, length: int, schema: str, keep: np.ndarray | None, row_of, once: bool) -> DataFrame:
    """``row_of(ids, keys, data, offsets, parse, codes)`` of the texts in steps, for the phrases that ``keep`` (if given) asks for.

    With ``once`` a task takes each distinct text one time, else each batch does, at its smallest id.
    """

    def make():
        told: set[int] = set()

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, keys, raws = [], [], []

            def emit() -> pa.RecordBatch:
                data = np.frombuffer(b"".join(raws), np.uint8)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in raws]))).astype(np.int64)
                row, lo, count, trigger = parse(data, offsets, length)
                code = Hashes(data, seed=9).of(trigger, trigger + GRAM).view(np.int64)
                if keep is not None:
                    row, lo, count, trigger, code = (x[keep(code)] for x in (row, lo, count, trigger, code))
                return row_of(batch.column("id").take(pa.array(ids, pa.int64())), np.array(keys, np.int64), data, offsets, (row, lo, count, trigger), code)

            size = 0
            for i, raw, key in _texts(batch):
                if len(raw) < length or (once and key in told):
                    continue
                if once:
                    told.add(key)
                ids.append(i)
                keys.append(key)
                raws.append(raw)
                size += len(raw)
                if size >= STEP:
                    yield emit()
                    ids, keys, raws, size = [], [], [], 0
            if raws:
                yield emit()

        return work

    return scan(docs, ["id", "t", "ord"], schema, make)


def phrases(docs: DataFrame, length: int, without: np.ndarray | None = None) -> DataFrame:
    """The parse of every text: ``(trigger, text, at)``, the phrase's start and sizes packed into ``at``.

    Phrases of the triggers ``without`` are left out. A text that stands in several tasks' rows gives its phrases in each of them.
    """

    def row_of(ids, keys, data, offsets, parsed, code):
        row, lo, count, trigger = parsed
        at = _pack(lo - offsets[row], count, trigger - lo)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(keys[row]), pa.array(at)], ["trigger", "text", "at"])

    keep = None
    if without is not None and len(without):
        sent = docs.sparkSession.sparkContext.broadcast(without)
        keep = lambda code: ~np.isin(code, sent.value)
    return _parsed(docs, length, "trigger long, text long, at long", keep, row_of, once=True)


def _strings(docs: DataFrame, length: int, common: np.ndarray, once: bool) -> DataFrame:
    """``(code, id, text, at)`` of every string whose trigger is one of ``common``: its fingerprint and its start as a range of one."""
    kind = docs.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def row_of(ids, keys, data, offsets, parsed, code):
        row, lo, count, _ = parsed
        many = np.repeat(row, count)
        start = np.arange(int(count.sum())) + np.repeat(lo - (np.cumsum(count) - count), count)
        codes = Hashes(data, seed=11).of(start, start + length).view(np.int64)
        at = _pack(start - offsets[many], np.ones(len(start), np.int64), 0)
        return pa.RecordBatch.from_arrays([pa.array(codes), ids.take(pa.array(many)), pa.array(keys[many]), pa.array(at)], ["code", "id", "text", "at"])

    return _parsed(docs, length, f"code long, id {kind}, text long, at long", lambda code: np.isin(code, sent.value), row_of, once)


def common_repeats(docs: DataFrame, common: np.ndarray, length: int) -> DataFrame:
    """``(text, at)`` as of :func:`repeated_starts` for the strings of very common triggers.

    The first occurrence of a string is a minimum that tasks form in part before the shuffle; all others are kept by a join
    that Spark may split, so no string's occurrences meet in one task's memory.
    """
    known = F.col("id").isNotNull().alias("known")
    least = _strings(docs, length, common, False).groupBy("code").agg(F.min(F.struct(known, "id", "text", "at")).alias("least"), F.min(F.struct("text", "at")).alias("a"), F.max(F.struct("text", "at")).alias("b"))
    least = stored(least.where("a < b").select("code", F.col("least.text").alias("first_text"), F.col("least.at").alias("first_at")))
    found = _strings(docs, length, common, True).select("code", "text", "at").join(least, "code")
    return found.where("text != first_text or at != first_at").select("text", "at")


def _with_texts(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts ``(text, at, trigger)`` of a text followed by the text itself, ``(id, ord, more, zip)``, its first row first.

    Texts travel compressed, and at most once per input batch.
    """
    kinds = {c: docs.schema[c].dataType for c in ("id", "more")}

    def make():
        pack = zstandard.ZstdCompressor(level=3).compress

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                found = list(_texts(part))
                at = pa.array([j for j, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for _, _, k in found], pa.int64()), *[part.column(c).take(at) for c in ("id", "ord", "more")], pa.array([pack(raw) for _, raw, _ in found], pa.binary())],
                    ["text", "id", "ord", "more", "zip"],
                )

        return work

    schema = StructType([
        StructField("text", LongType()), StructField("id", kinds["id"]), StructField("ord", LongType()), StructField("more", kinds["more"]), StructField("zip", BinaryType())
    ])
    texts = scan(docs, ["id", "t", "ord", "more"], schema, make)
    both = facts.select(
        "text", F.lit(0).cast("byte").alias("part"), "at", "trigger", F.lit(None).cast(kinds["id"]).alias("id"),
        F.lit(None).cast("long").alias("ord"), F.lit(None).cast(kinds["more"]).alias("more"), F.lit(None).cast("binary").alias("zip")
    ).unionByName(
        texts.select("text", F.lit(1).cast("byte").alias("part"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("trigger"), "id", "ord", "more", "zip")
    )
    return both.repartition(partitions(docs), "text").sortWithinPartitions("text", "part", "id", "ord", "at")


def _each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, object, bytes, list[np.ndarray], list[np.ndarray]]]:
    """``(key, id, more, text, at, trigger)`` per text of :func:`_with_texts`, whole runs over batch borders."""
    unpack = zstandard.ZstdDecompressor().decompress
    now, at, trigger, told = None, [], [], False
    for batch in batches:
        n = batch.num_rows
        text, part = batch.column("text").to_numpy(), batch.column("part").to_numpy()
        places, triggers = batch.column("at").to_numpy(), batch.column("trigger").to_numpy()
        ids, more, zips = batch.column("id"), batch.column("more"), batch.column("zip")
        cuts = np.concatenate(([0], np.flatnonzero((text[1:] != text[:-1]) | (part[1:] != part[:-1])) + 1, [n])) if n else [0]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if text[s] != now:
                now, at, trigger, told = int(text[s]), [], [], False
            if part[s] == 0:
                at.append(places[s:e])
                trigger.append(triggers[s:e])
            elif not told:
                told = True
                yield now, ids[int(s)].as_py(), more[int(s)].as_py(), unpack(zips[int(s)].as_py()), at, trigger


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, np.int64)


def dictionary(docs: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """The shared phrases ``(trigger, id, text, at, bytes)``, each once."""
    kind = docs.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for key, id_, _, raw, at, trigger in _each_text(batches):
            if not at:
                continue
            at, first = np.unique(_joined(at), return_index=True)
            lo, count, trigger = at >> 24, (at >> 12) & 4095, _joined(trigger)[first]
            for a, t, x, n in zip(at.tolist(), trigger.tolist(), lo.tolist(), count.tolist()):
                held.append((t, id_, key, a, raw[x : x + n + length - 1]))
            if len(held) > 20_000:
                yield _dictionary_rows(held, id_type)
                held = []
        if held:
            yield _dictionary_rows(held, id_type)

    id_type = to_arrow_type(docs.schema["id"].dataType)
    return _with_texts(docs, shared).mapInArrow(task, f"trigger long, id {kind}, text long, at long, bytes binary")


def _dictionary_rows(held: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    trigger, id_, text, at, raw = zip(*held)
    return pa.RecordBatch.from_arrays(
        [pa.array(trigger, pa.int64()), pa.array(id_, id_type), pa.array(text, pa.int64()), pa.array(at, pa.int64()), pa.array(raw, pa.binary())],
        ["trigger", "id", "text", "at", "bytes"],
    )


def _repeats(table: pa.Table, length: int) -> pa.RecordBatch:
    """Starts that are repeats among the phrases of whole triggers, as ranges ``(text, at)`` of starts.

    The table is in the order of trigger and corpus. The suffixes of the phrases are sorted by trigger, distance
    and fingerprint, equal ones in corpus order; all but the first of each are repeats.
    """
    trigger, at = table["trigger"].to_numpy(), table["at"].to_numpy()
    lo, count, to_trigger = at >> 24, (at >> 12) & 4095, at & 4095
    data, offsets = text_bytes(table["bytes"])
    phrase = np.repeat(np.arange(len(at)), count)
    step = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[:-1][phrase] + step
    code = Hashes(data, seed=11).of(begin, begin + length)
    run = np.concatenate(([0], np.cumsum(trigger[1:] != trigger[:-1])))
    code = mixed(code + mixed(run[phrase].astype(np.uint64) * np.uint64(128) + to_trigger[phrase].astype(np.uint64) - step.astype(np.uint64)))
    order = np.argsort(code, kind="stable")
    again = np.zeros(len(code), bool)
    ranked = code[order]
    again[order[1:]] = ranked[1:] == ranked[:-1]
    hit = np.flatnonzero(again)
    fresh = np.ones(len(hit), bool)
    fresh[1:] = (np.diff(hit) != 1) | (phrase[hit[1:]] != phrase[hit[:-1]])
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(hit)))
    of = phrase[hit[first]]
    return pa.RecordBatch.from_arrays(
        [pa.array(table["text"].to_numpy()[of]), pa.array(_pack(lo[of] + step[hit[first]], size, 0))], ["text", "at"]
    )


def repeated_starts(found: DataFrame, length: int) -> DataFrame:
    """``(text, at)``: the ranges of starts of strings that also start earlier in the corpus."""
    dealt = found.repartition(partitions(found), "trigger").sortWithinPartitions("trigger", "id", "text", "at")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            last = batch.column(0)[batch.num_rows - 1].as_py()
            if rows < 8192 or held[0].column(0)[0].as_py() == last:
                continue
            cut = int(np.argmax(batch.column(0).to_numpy() == last))
            done, held = [*held[:-1], batch.slice(0, cut)], [batch.slice(cut)]
            rows = held[0].num_rows
            yield from _slices(pa.Table.from_batches(done), length)
        if held:
            yield from _slices(pa.Table.from_batches(held), length)

    return dealt.mapInArrow(task, "text long, at long")


def _slices(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Whole triggers of about 16,384 phrases at a time."""
    trigger = table["trigger"].to_numpy()
    ends = np.append(np.flatnonzero(trigger[1:] != trigger[:-1]) + 1, len(trigger))
    s = 0
    while s < len(trigger):
        e = int(ends[max(0, int(np.searchsorted(ends, s + 16384, side="right")) - 1)])
        if e <= s:
            e = int(ends[int(np.searchsorted(ends, s, side="right"))])
        yield _repeats(table.slice(s, e - s), length)
        s = e


def remove_repeats(
    docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, more)`` of every row.

    With ``texts`` also ``kept`` (binary) and ``kept_text``, the same without characters that lost some of their bytes.
    ``more`` is a struct of the row's ``carry`` columns (null without any).

    A byte goes if a ``length``-byte string (64 to 4,000) that covers it also starts earlier: in a text with a smaller id, or
    earlier in the same text. Strings are judged on the input and never cross texts. Null text counts as empty, a
    null id as smallest. Rows with one id are ordered by their text's 64-bit key, equal rows are copies of one another. Of equal
    texts only the first is parsed; in the others every string starts earlier, so all of a copy goes if it has ``length``
    bytes. An empty table gives no rows.
    """
    if not 2 * GRAM <= length < 4000:
        raise ValueError("length must be from 64 to 3999")
    more = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    order = F.xxhash64(*[F.col(c) for c in carry]) if carry else F.lit(0).cast("long")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"), order.alias("ord"), more.alias("more"))
    id_type, more_type = base.schema["id"].dataType, base.schema["more"].dataType

    def name():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            raws = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("t")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array([text_key(x) for x in raws], pa.int64()), pa.array([len(x) for x in raws], pa.int64()),
                    pa.array([x if len(x) < length else None for x in raws], pa.binary()), batch.column("ord"), batch.column("more"),
                ],
                ["id", "text", "n_bytes", "short", "ord", "more"],
            )

        return work

    schema = StructType([
        StructField("id", id_type), StructField("text", LongType()), StructField("n_bytes", LongType()), StructField("short", BinaryType()),
        StructField("ord", LongType()), StructField("more", more_type),
    ])
    rows = stored(scan(base, ["id", "t", "ord", "more"], schema, name))
    # a trigger is shared if it stands in two texts or at two places of one
    place = F.xxhash64("text", "at")
    often = phrases(base, length).groupBy("trigger").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("a"), F.max(place).alias("b"))
    often = stored(often.where("a < b").select("trigger", "n"))
    # at most one of them for each RUN_ROWS phrases
    common = often.where(F.col("n") > RUN_ROWS).select("trigger").toArrow()["trigger"].to_numpy()
    shared = phrases(base, length, common).join(often.where(F.col("n") <= RUN_ROWS).select("trigger"), "trigger").select("text", "at", "trigger")
    starts = repeated_starts(dictionary(base, shared, length), length)
    if len(common):
        starts = starts.unionByName(common_repeats(base, common, length))
    arrow = [to_arrow_type(id_type), to_arrow_type(more_type)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def rows_of() -> pa.RecordBatch:
            columns = list(zip(*held))
            types = [arrow[0], arrow[1], pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            names = ["id", "more", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names[: len(columns)])

        for _, id_, extra, raw, at, _ in _each_text(batches):
            kept, spans = raw, 0
            if at:
                at = _joined(at)
                lo, count = at >> 24, (at >> 12) & 4095
                edge = np.bincount(lo, minlength=len(raw) + 1) - np.bincount(lo + count + length - 1, minlength=len(raw) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            told = [kept, kept.decode(errors="ignore")] if texts else []
            held.append((id_, extra, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), *told))
            size += len(kept) if texts else 200
            if size > 2 << 20:
                yield rows_of()
                held, size = [], 0
        if held:
            yield rows_of()

    facts = starts.select("text", "at", F.lit(0).cast("long").alias("trigger"))
    fields = [StructField("id", id_type), StructField("more", more_type), *[StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")], StructField("kept_sha256", StringType())]
    fields += [StructField("kept", BinaryType()), StructField("kept_text", StringType())] if texts else []
    firsts = _with_texts(base, facts).mapInArrow(task, StructType(fields))
    # the copies: every row of a text but its first one; their texts are gone, or too short to change
    least = rows.groupBy("text").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("least"))
    number = F.row_number().over(Window.partitionBy("text", "id").orderBy("ord"))
    ranked = rows.withColumn("copy", number).join(least, "text")
    again = ranked.where(~F.col("id").eqNullSafe(F.col("least.id")) | (F.col("copy") > 1))
    gone = F.col("n_bytes") >= length
    left = F.when(gone, F.lit(b"")).otherwise(F.col("short"))
    copies = again.select(
        "id", "more", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"), F.sha2(left, 256).alias("kept_sha256"),
        *([left.alias("kept"), F.decode(left, "UTF-8").alias("kept_text")] if texts else []),
    )
    return firsts.unionByName(copies)
