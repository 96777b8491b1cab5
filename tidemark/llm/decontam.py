"""Benchmark decontamination: seeds of word pairs, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.util import Finder, Hashes, mixed, scan, steps, text_bytes, words

#: Fewest words of an item that is aligned; shorter ones are matched as they are, unless chance brings their words together
#: in more than ``SHORT_CHANCE`` of the documents.
LEAST_WORDS, SHORT_CHANCE = 8, 0.05
#: A place of an item whose pairs chance brings into a document more often than this, by the corpus frequencies of its words, is
#: left out of the seeds, as long as an accepted copy keeps ``LEAST_SEEDS`` others.
CHANCE, LEAST_SEEDS = 1e-2, 2
#: Alignment scores and the share of an item's full score that counts as a copy.
MATCH, MISMATCH, GAP, THRESHOLD = 2, -1, -1, 0.4
#: Words of a verbatim run whose score is enough for any item, however long.
RUN = 40
#: Bytes of benchmark text that are sent to the tasks at a time; a larger benchmark is gone through in blocks.
BLOCK_BYTES = 8 << 20
#: Seed hits that are sorted at a time (those of one document stay together).
HITS = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _b in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _FOLD[_b] = 32

#: Other white space folded the same way, so that all of it parts words.
_FOLD[[9, 10, 11, 12, 13]] = 32
_ANY, _FULL, _HALF = np.zeros((3, 256), bool)
_ANY[0x80:0xC0] = True
_FULL[[*range(0x81, 0x90), *range(0x9A, 0xA1), *range(0xBB, 0xC0)]] = True
_HALF[[0x80, *range(0x9B, 0xA6)]] = True
_WIDE = [(0xE3, 0x80, _ANY), (0xEF, 0xBC, _FULL), (0xEF, 0xBD, _HALF)]


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the accented letters of Latin-1, ASCII, CJK and full-width punctuation to spaces; places stay the same."""
    out = _FOLD[data]
    if len(data) > 1:
        high = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[high] += 32
    if len(data) > 2:
        for lead, second, third in _WIDE:
            at = np.flatnonzero((data[:-2] == lead) & (data[1:-1] == second))
            at = at[third[data[at + 2]]]
            for k in range(3):
                out[at + k] = 32
    return out


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`words` of folded text, with every character of a script without spaces as a word of its own."""
    starts, ends, first = words(data, offsets)
    at = np.flatnonzero(data[:-1] >= 0xE0)
    lead, second = data[at], data[at + 1]
    # Thai and Lao; Myanmar and Khmer; kana and Han
    own = (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB)
    own |= (lead == 0xE1) & ((second >= 0x80) & (second <= 0x82) | (second >= 0x9E) & (second <= 0x9F))
    own |= (lead == 0xE3) & (second >= 0x81) | (lead >= 0xE4) & (lead <= 0xE9) | (lead == 0xEF) & (second >= 0xA4) & (second <= 0xAB)
    own |= (lead == 0xF0) & (second >= 0xA0) & (second <= 0xB3)
    if not own.any():
        return starts, ends, first
    at = at[own]
    past = at + np.where(lead[own] == 0xF0, 4, 3)
    starts = np.union1d(starts, np.concatenate((at, past[np.append(data, 0x20)[past] != 0x20])))
    ends = np.union1d(ends, np.concatenate((past, at[np.append(data, 0x20)[at - 1] != 0x20])))
    return starts, ends, np.searchsorted(starts, offsets)


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n if len(out) else 0):
        out = mixed(out + hashes[k : len(hashes) - n + 1 + k])
    return out


def pairs_of(hashes: np.ndarray, step: int) -> np.ndarray:
    """Hash of every word hash and the one ``step`` places on."""
    return mixed(mixed(hashes[:-step]) + hashes[step:]) if len(hashes) > step else np.zeros(0, np.uint64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences and where it ends in the passage.

    Row by row: the gap inside a row is a running maximum, as the gap cost is linear.
    """
    slope = -GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(passage == w, MATCH, MISMATCH), row[1:] + GAP)
        row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + slope) - slope, 0)
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def align_many(items: list[np.ndarray], passages: list[np.ndarray], cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """:func:`align` of many pairs, those of about one size in one array."""
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    wide, long = np.array([len(x) for x in passages]), np.array([len(x) for x in items])
    order = np.lexsort((wide, long))
    s = 0
    while s < len(order):
        e = s + 1
        width = int(wide[order[s]])
        while e < len(order) and long[order[e]] <= 2 * long[order[s]] and max(width, int(wide[order[e]])) * (e + 1 - s) <= cells:
            width = max(width, int(wide[order[e]]))
            e += 1
        part = order[s:e]
        words_, there = np.zeros((len(part), int(long[part].max())), np.uint64), np.zeros((len(part), width), np.uint64)
        for k, x in enumerate(part):
            words_[k, : long[x]], there[k, : wide[x]] = items[x], passages[x]
        inside = np.arange(width) < wide[part][:, None]
        slope = (-GAP * np.arange(width + 1)).astype(np.int32)
        row = np.zeros((len(part), width + 1), np.int32)
        top, at = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for i in range(words_.shape[1]):
            same = (there == words_[:, i : i + 1]) & inside & (i < long[part])[:, None]
            new = np.zeros_like(row)
            new[:, 1:] = np.maximum(row[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), row[:, 1:] + np.int32(GAP))
            row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + slope, axis=1) - slope, 0)
            k = row.argmax(axis=1)
            value = row[np.arange(len(part)), k]
            more = value > top
            top[more], at[more] = value[more], k[more]
        best[part], end[part] = top, at
        s = e
    return best, end


def _frequencies(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Occurrences of every vocabulary word in all texts, all words, all rows."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        find = Finder(sent.value)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            data, offsets = text_bytes(batch.column(0))
            counts, total = np.zeros(len(sent.value) + 2, np.int64), 0
            for i, j in steps(offsets):
                part = fold(data[offsets[i] : offsets[j]])
                starts, ends, _ = cut(part, offsets[i : j + 1] - offsets[i])
                at = find(Hashes(part).of(starts, ends))
                counts[:-2] += np.bincount(at[at >= 0], minlength=len(sent.value))
                total += len(starts)
            counts[-2:] = total, batch.num_rows
            has = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(counts[has])], ["word", "n"])

        return work

    found = scan(docs, [F.col(text_col).alias("t")], "word long, n long", make).groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(vocabulary) + 2, np.int64)
    counts[found["word"].to_numpy()] = found["n"].to_numpy()
    return counts[:-2], int(counts[-2]), int(counts[-1])


def least_score(lengths: np.ndarray, threshold: float) -> np.ndarray:
    """The alignment score from which a passage is a copy of an item of so many words."""
    return np.clip(np.ceil(threshold * MATCH * lengths - 1e-9), 1, RUN * MATCH).astype(np.int64)


def _matcher(docs: DataFrame, items: list[tuple], text_col: str, threshold: float):
    """A function for tasks: it makes one that lists ``(row, item, score, n_seeds, start, end)`` of a text column.

    Between two matched words of an alignment that follow each other there are no, one or more errors. As an error costs 1
    and a match brings 2, an alignment of score S has at least S / 2 - 1 links with one error at most, each from
    another place of the item. Such a link is a pair of words that are neighbours, or next but one, in item and
    text. So no copy is lost if a window needs that many pairs, less the places that are left out as common, and as far apart in diagonals
    as the item's full score less S allows gaps.
    """
    data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
    data = fold(data)
    starts, ends, first = cut(data, offsets)
    hashes = Hashes(data).of(starts, ends)
    sequences = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
    vocabulary, inverse = np.unique(hashes, return_inverse=True)
    counts, total, rows = _frequencies(docs, text_col, vocabulary)
    log_p = np.log((counts[inverse] + 0.5) / (total + 1.0)) if len(hashes) else np.zeros(0)
    length = total / max(1, rows)
    lengths = np.array([len(x) for x in sequences], np.int64)
    wanted = least_score(lengths, threshold)
    need = np.ones(len(sequences), np.int64)
    keys, item_of, place, short = [], [], [], {}
    for k, sequence in enumerate(sequences):
        n = len(sequence)
        if n < LEAST_WORDS:
            if n and length * np.exp(log_p[first[k] : first[k + 1]].sum()) <= SHORT_CHANCE:
                short.setdefault(n, []).append(k)
            continue
        own = np.exp(log_p[first[k] : first[k + 1]])
        often = length * own[:-1] * (own[1:] + np.append(own[2:], 0.0)) * 2
        links = max(1, -(-int(wanted[k]) // 2) - 1)
        common = np.argsort(-often, kind="stable")[: max(0, links - LEAST_SEEDS)]
        common = common[often[common] > CHANCE]
        need[k] = links - len(common)
        used = np.ones(n - 1, bool)
        used[common] = False
        for step in (1, 2):
            chosen = np.flatnonzero(used[: n - step])
            keys.append(pairs_of(sequence, step)[chosen])
            item_of.append(np.full(len(chosen), k))
            place.append(chosen)
    keys, item_of, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, item_of, place))
    order = np.argsort(keys.astype(np.uint64), kind="stable")
    unique, begin = np.unique(keys.astype(np.uint64)[order], return_index=True)
    sent = docs.sparkSession.sparkContext.broadcast(
        (unique, np.append(begin, len(keys)), item_of[order], place[order], sequences, lengths, wanted, need, short, [i for i, _ in items])
    )

    def make():
        unique, begin, item_of, place, sequences, lengths, wanted, need, short, names = sent.value
        find = Finder(unique)
        whole = []
        for n, those in short.items():
            codes = np.array([runs_of(sequences[k], n)[0] for k in those], np.uint64)
            order = np.argsort(codes, kind="stable")
            distinct, at = np.unique(codes[order], return_index=True)
            whole.append((n, Finder(distinct), np.split(np.array(those)[order], at[1:])))
        drift = MATCH * lengths - wanted

        def windows(hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
            """``(row, item, number of hits, first diagonal, last diagonal)`` of the places that may hold a copy, some rows at a time."""
            hit, at = [], []
            for step in (1, 2):
                found = find(pairs_of(hashes, step))
                where = np.flatnonzero(found >= 0)
                inside = where + step < first[np.searchsorted(first, where, side="right")]
                hit.append(where[inside])
                at.append(found[where[inside]])
            hit, at = np.concatenate(hit), np.concatenate(at)
            order = np.argsort(hit, kind="stable")
            hit, at = hit[order], at[order]
            row = np.searchsorted(first, hit, side="right") - 1
            many = begin[at + 1] - begin[at]
            ends = np.flatnonzero(np.diff(row, append=-1)) + 1
            sums = np.cumsum(many)
            s = 0
            while s < len(hit):
                e = int(ends[np.searchsorted(ends, s, side="right")])
                room = int(np.searchsorted(sums, (sums[s - 1] if s else 0) + HITS, side="right"))
                e = max(e, int(ends[np.searchsorted(ends, room, side="right") - 1]) if room >= ends[0] else 0)
                n = many[s:e]
                entry = np.repeat(begin[at[s:e]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                item, rows, diagonal = item_of[entry], np.repeat(row[s:e], n), np.repeat(hit[s:e], n) - place[entry]
                order = np.lexsort((diagonal, item, rows))
                rows, item, diagonal = rows[order], item[order], diagonal[order]
                last = np.arange(len(item)) + need[item] - 1
                good = np.flatnonzero(last < len(item))
                last = last[good]
                fits = (rows[last] == rows[good]) & (item[last] == item[good]) & (diagonal[last] - diagonal[good] <= drift[item[good]])
                good, last = good[fits], last[fits]
                if len(good):
                    new = np.ones(len(good), bool)
                    new[1:] = (rows[good[1:]] != rows[good[:-1]]) | (item[good[1:]] != item[good[:-1]])
                    new[1:] |= diagonal[good[1:]] - diagonal[last[:-1]] > drift[item[good[1:]]]
                    cut = np.flatnonzero(new)
                    a, b = good[cut], last[np.append(cut[1:], len(good)) - 1]
                    yield rows[a], item[a], b - a + 1, diagonal[a], diagonal[b]
                s = e

        def work(texts: pa.Array) -> Iterator[tuple]:
            data, offsets = text_bytes(texts)
            for i, j in steps(offsets):
                base = offsets[i]
                part = fold(data[base : offsets[j]])
                starts, ends, first = cut(part, offsets[i : j + 1] - base)
                hashes = Hashes(part).of(starts, ends)
                for n, look, those in whole:
                    found = look(runs_of(hashes, n))
                    hit = np.flatnonzero(found >= 0)
                    row = np.searchsorted(first, hit, side="right") - 1
                    for h, r in zip(hit.tolist(), row.tolist()):
                        if h + n <= first[r + 1]:
                            doc_at = int(offsets[i + r] - base)
                            for k in those[found[h]].tolist():
                                yield i + r, names[k], 1.0, 1, int(starts[h]) - doc_at, int(ends[h + n - 1]) - doc_at
                for row, item, n, low, high in windows(hashes, first):
                    lo = np.maximum(first[row], low - drift[item])
                    hi = np.minimum(first[row + 1], high + lengths[item] + drift[item])
                    best, end = align_many([sequences[k] for k in item], [hashes[a:b] for a, b in zip(lo, hi)])
                    for x in np.flatnonzero(best >= wanted[item]).tolist():
                        k, r, passage = int(item[x]), int(row[x]), hashes[lo[x] : lo[x] + end[x]]
                        begun = int(end[x]) - align(sequences[k][::-1], passage[::-1])[1]
                        a, b = int(starts[lo[x] + begun]), int(ends[lo[x] + end[x] - 1])
                        doc_at = int(offsets[i + r] - base)
                        yield i + r, names[k], float(best[x] / (MATCH * lengths[k])), int(n[x]), a - doc_at, b - doc_at

        return work

    return make


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(id, item, score, n_seeds, start, end)``: each document and item of which it holds an exact or edited copy.

    Words are folded (case, punctuation). An item's seeds are the pairs of its words that are neighbours or
    next but one, without the commonest by the words' frequencies in all documents. Where a text has as many of them near one diagonal as
    any copy must have (see :func:`_matcher`), its words are aligned with the item's, so the seeds lose no copy. ``score`` is the best
    alignment score over the item's full score, the best window counts; ``start`` and ``end`` are its bytes in the text.

    The items are the stated query set: they go to the tasks in blocks of at most ``block_bytes`` (a longer item is a block of its
    own), and each block meets all documents in one scan; nothing of the documents is collected but counts of the
    block's words. Of items of over 100 words an alignment that scores as 40 words in a row is a copy, too; its
    ``score`` is then under the threshold. Items of under eight words match where all their words stand in a row, unless the words' frequencies
    alone would bring that into more than 5 % of the documents (then, like items without a word, they match nothing). Every
    character of a script without spaces (Han, kana, Thai, Lao, Khmer, Myanmar) is a word. Null texts are empty; rows with a null id are
    reported under null; repeated rows count once; empty tables give no rows.
    """
    kind, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    schema = f"id {kind}, item {item_type.simpleString()}, score double, n_seeds long, start long, end long"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        match = _matcher(docs, items, text_col, threshold)

        def make(match=match):
            hits = match()

            def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                out = list(hits(batch.column(1)))
                if out:
                    rows, names, *rest = (list(x) for x in zip(*out))
                    types = [pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                    columns = [batch.column(0).take(pa.array(rows)), pa.array(names, to_arrow_type(item_type)), *[pa.array(x, t) for x, t in zip(rest, types)]]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "item", "score", "n_seeds", "start", "end"])

            return work

        found = found.unionByName(scan(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("t")], schema, make))
    best = F.max(F.struct("score", "n_seeds", (-F.col("start")).alias("s"), "end")).alias("best")
    return found.groupBy("id", "item").agg(best).select("id", "item", "best.score", "best.n_seeds", (-F.col("best.s")).alias("start"), "best.end")


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    usable = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("t")).where("t is not null")
    size = usable.agg(F.sum(F.octet_length("t")).alias("n")).first().n or 0
    blocks = -(-size // block_bytes)
    for b in range(blocks):
        items = [(r.item, r.t) for r in usable.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).collect()]
        if items:
            yield items


def without_copies(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that hold no copy of a benchmark item, by the rules of :func:`contaminated`.

    Each block of items filters the rows as they pass, so no text is shuffled.
    """
    place = docs.columns.index(text_col)
    left = docs
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        match = _matcher(docs, items, text_col, threshold)

        def make(match=match):
            hits = match()

            def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in hits(batch.column(place))]] = False
                yield batch.filter(pa.array(keep))

            return work

        left = scan(left, left.columns, docs.schema, make)
    return left
