"""Document scoring: prediction by partial matching over byte contexts, beside a smoothed word unigram."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.util import LOWER, Finder, Hashes, most_frequent, scan, steps, stored, text_bytes, words

#: Symbols: byte + 1; 0 is the end of a text and, in contexts, what stands before it.
ALPHABET, WIDTH = 257, 9
#: What each symbol of a context gives to the escape (method D).
DISCOUNT = 0.5
WORD, GRAM, ROW = 0, 1, -1
END_KEY = -1
#: Most frequent words and byte strings that are sent to every task; the others are joined.
HEAD_ROWS = 1 << 19


def symbol_grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Per byte and text end, the packed string of the symbol and the ``order`` symbols before it (newest lowest)."""
    lengths = np.diff(offsets)
    rows = len(lengths)
    padded = np.zeros(len(data) + (order + 1) * rows, np.uint64)
    padded[np.arange(len(data)) + order + (order + 1) * np.repeat(np.arange(rows), lengths)] = data.astype(np.uint64) + np.uint64(1)
    out = padded.copy()
    for k in range(1, order + 1):
        out[k:] |= padded[:-k] << np.uint64(WIDTH * k)
    return out[np.arange(len(data) + rows) + order * (np.repeat(np.arange(rows), lengths + 1) + 1)]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(inverse, np.concatenate(counts), len(unique)).astype(np.int64)


def gather_counts(docs: DataFrame, text: Column, train: Column, order: int) -> DataFrame:
    """``(kind, key, n, n_train)``: occurrences of every word (by hash) and byte string in all and in training rows."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            data, offsets = text_bytes(batch.column(0))
            data = LOWER[data]
            learns = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
            found: dict[tuple[int, bool], tuple[list, list]] = {}
            for i, j in steps(offsets):
                for train in (False, True):
                    pick = np.flatnonzero(learns[i:j] == train) + i
                    if not len(pick):
                        continue
                    part = ragged_rows(data, offsets, pick)
                    starts, ends, _ = words(*part)
                    for kind, keys in ((WORD, Hashes(part[0]).of(starts, ends)), (GRAM, symbol_grams(*part, order))):
                        unique, n = np.unique(keys, return_counts=True)
                        held = found.setdefault((kind, train), ([], []))
                        held[0].append(unique)
                        held[1].append(n)
                    found[WORD, train][0].append(np.array([END_KEY], np.int64).view(np.uint64))
                    found[WORD, train][1].append(np.array([len(pick)]))
            for (kind, train), (keys, counts) in found.items():
                unique, n = _summed(keys, counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), kind, np.int8)), pa.array(unique.view(np.int64)), pa.array(n), pa.array(n if train else np.zeros_like(n))],
                    ["kind", "key", "n", "n_train"],
                )

        return work

    rows = scan(docs, [text.alias("t"), train.alias("learn")], "kind byte, key long, n long, n_train long", make)
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


def ragged_rows(data: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the picked rows."""
    lengths = offsets[pick + 1] - offsets[pick]
    at = np.concatenate(([0], np.cumsum(lengths)))
    if len(pick) and pick[-1] - pick[0] + 1 == len(pick):
        return data[offsets[pick[0]] : offsets[pick[-1] + 1]], at
    return data[np.repeat(offsets[pick] - at[:-1], lengths) + np.arange(at[-1])], at


def ppm_costs(grams: DataFrame, order: int) -> DataFrame:
    """``(key, q)``: the probability of every string's last symbol after the symbols before it.

    ``grams(key, n)`` holds the strings of ``order + 1`` symbols that are needed, with their training counts (0: not
    seen). Level by level, the nodes of the context trie get their counts; escape estimation is method D (each
    symbol seen in a context gives half a count to the escape) with symbol exclusion: on escape, what the longer
    context has seen is left out of the shorter one's counts. The levels are joined on the string without its oldest
    symbol; a context has at most 257 symbols, so no window group is larger.
    """
    below: DataFrame | None = None
    for k in range(order + 1):
        mask = (1 << (WIDTH * (k + 1))) - 1
        level = grams.groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.sum("n").alias("n"))
        node = Window.partitionBy("ctx")
        if below is not None:
            suffix = F.col("key").bitwiseAND(F.lit((1 << (WIDTH * k)) - 1)).alias("low")
            level = level.select("*", suffix).join(below, "low")
        level = level.withColumn("ctx", F.shiftright("key", WIDTH)).select(
            "*", F.sum("n").over(node).alias("total"), F.sum((F.col("n") > 0).cast("long")).over(node).alias("kinds"),
            *([] if below is None else [F.sum(F.when(F.col("n") > 0, F.col("low_n")).otherwise(0)).over(node).alias("out")]),
        )
        n, total, kinds = (F.col(c).cast("double") for c in ("n", "total", "kinds"))
        full = kinds >= ALPHABET
        escape = F.when(full, 0.0).otherwise(DISCOUNT * kinds)
        seen = F.when(full, n).otherwise(n - DISCOUNT) / total
        if below is None:
            q = F.when(total == 0, F.lit(1.0 / ALPHABET)).when(n > 0, seen).otherwise(escape / total / (ALPHABET - kinds))
        else:
            low_n, low_total, low_kinds, out, low_q = (F.col(c).cast("double") for c in ("low_n", "low_total", "low_kinds", "out", "low_q"))
            low_escape = F.when(low_kinds >= ALPHABET, 0.0).otherwise(DISCOUNT * low_kinds)
            rest = F.when(low_kinds >= ALPHABET, 0.0).otherwise(DISCOUNT * (low_kinds - kinds))
            again = (
                F.when(low_n > 0, low_total / (low_total - out))
                .when(rest > 0, rest / low_escape * low_total / (low_total - out))
                .otherwise(low_total / low_escape)
            )
            q = F.when(total == 0, low_q).when(n > 0, seen).otherwise(escape / total * low_q * again)
        if k < order:
            below = level.select(
                F.col("key").alias("low"), F.col("n").alias("low_n"), F.col("total").alias("low_total"), F.col("kinds").alias("low_kinds"), q.alias("low_q")
            )
    return level.select("key", q.alias("q"))


def score_documents(
    docs: DataFrame, train: Column, order: int = 5, id_col: str = "doc_id", text_col: str = "text", head_rows: int = HEAD_ROWS
) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` of every row; both models learn from ``train`` rows.

    Texts are lower-cased in A-Z. ``score`` is the log10 probability of the bytes and the end under the PPM model
    of the given order (1 to 6); ``base_score`` that of the words and the end under add-one unigrams. All strings of all rows
    are counted. The commonest ``head_rows`` of each kind go to every task (a fixed size); the others of a text leave
    as ``(row, key, count)`` rows and meet the model in a join, so the model may grow with the corpus.

    Null text counts as empty (one token, the end). Null in ``train`` means no. Rows are told apart by id and text; an equal row
    again gives an equal result again. An empty table gives no rows; without training rows every symbol has
    probability 1/257 and the base 1.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    counts = stored(gather_counts(docs, text, train, order))
    size = counts.where(f"kind = {WORD}").agg(F.sum("n_train").alias("n"), F.count(F.when(F.col("n_train") > 0, 1)).alias("v")).first()
    n, v = size.n or 0, size.v or 0
    costs = ppm_costs(counts.where(f"kind = {GRAM}").select("key", F.col("n_train").alias("n")), order)
    word_terms = counts.where(f"kind = {WORD}").select(
        "kind", "key", "n", F.log10((F.col("n_train") + 1.0) / (n + v + 1.0)).alias("value"), (F.col("n_train") > 0).cast("long").alias("known")
    )
    gram_terms = counts.where(f"kind = {GRAM}").join(costs, "key").select("kind", "key", "n", F.log10("q").alias("value"), F.lit(0).cast("long").alias("known"))
    model = stored(word_terms.unionByName(gram_terms))
    least = {kind: most_frequent(model.where(f"kind = {kind}"), "n", head_rows) for kind in (WORD, GRAM)}
    in_head = F.col("n") >= F.when(F.col("kind") == WORD, F.lit(least[WORD])).otherwise(F.lit(least[GRAM]))
    head = model.where(in_head).select("kind", "key", "value", "known").toArrow()
    held = {c: head[c].to_numpy() for c in ("kind", "key", "value", "known")}
    sent = spark.sparkContext.broadcast({k: tuple(held[c][held["kind"] == k] for c in ("key", "value", "known")) for k in (WORD, GRAM)})
    kind_of_id = docs.schema[id_col].dataType.simpleString()

    def make():
        tables = {k: (Finder(key), np.append(value, 0.0), np.append(known, 0)) for k, (key, value, known) in sent.value.items()}

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            data, offsets = text_bytes(batch.column(1))
            data = LOWER[data]
            ids = batch.column(0)
            for i, j in steps(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                rows = np.array([xxhash.xxh64_intdigest(part[a:b].data) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64)
                starts, ends, first = words(part, at)
                of_word = np.repeat(np.arange(j - i), np.diff(first))
                # each row's words and then its end
                keys = np.insert(Hashes(part).of(starts, ends), first[1:], np.array([END_KEY], np.int64).view(np.uint64)[0])
                word_rows = np.insert(of_word, first[1:], np.arange(j - i))
                tail_row, tail_kind, tail_key, tail_n, sums = [], [], [], [], {}
                gram_rows = np.repeat(np.arange(j - i), np.diff(at) + 1)
                for kind, key, row in ((WORD, keys, word_rows), (GRAM, symbol_grams(part, at, order), gram_rows)):
                    find, value, known = tables[kind]
                    where = find(key)
                    begin = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=j - i))[:-1]))
                    sums[kind] = np.add.reduceat(value[where], begin), np.add.reduceat(known[where], begin) if kind == WORD else None
                    miss = np.flatnonzero(where < 0)
                    if len(miss):
                        pairs = np.rec.fromarrays([row[miss], key[miss]])
                        unique, n = np.unique(pairs, return_counts=True)
                        tail_row.append(unique["f0"])
                        tail_key.append(unique["f1"])
                        tail_n.append(n)
                        tail_kind.append(np.full(len(n), kind, np.int8))
                m = j - i
                yield _rows(ids, np.arange(i, j), rows, np.full(m, ROW, np.int8), rows, np.ones(m, np.int64), np.diff(first) + 1, sums[WORD][1], sums[WORD][0], sums[GRAM][0])
                if tail_row:
                    row, zero = np.concatenate(tail_row), np.zeros(sum(map(len, tail_n)))
                    yield _rows(ids, row + i, rows[row], np.concatenate(tail_kind), np.concatenate(tail_key), np.concatenate(tail_n), zero.astype(np.int64), zero.astype(np.int64), zero, zero)

        return work

    schema = f"id {kind_of_id}, row long, kind byte, key long, n long, n_tokens long, n_known long, base double, score double"
    parts = scan(docs, [F.col(id_col).alias("id"), text.alias("t")], schema, make)
    rest = model.where(~in_head).select("kind", "key", "value", "known")
    joined = parts.join(rest, ["kind", "key"], "left")
    term = lambda kind, c: F.when(F.col("kind") == kind, F.col("n") * F.col(c)).otherwise(0)
    total = joined.groupBy("id", "row").agg(
        F.count(F.when(F.col("kind") == ROW, 1)).alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + term(WORD, "known")).alias("n_known"),
        F.sum(F.col("base") + term(WORD, "value")).alias("base"),
        F.sum(F.col("score") + term(GRAM, "value")).alias("score"),
    )
    each = total.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        "id",
        (F.col("n_tokens") / F.col("copies")).cast("long").alias("n_tokens"),
        (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
    )


def _rows(ids, index, rows, kind, key, n, tokens, known, base, score) -> pa.RecordBatch:
    long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(index)), long(rows), pa.array(kind), long(key), long(n), long(tokens), long(known), pa.array(base), pa.array(score)],
        ["id", "row", "kind", "key", "n", "n_tokens", "n_known", "base", "score"],
    )
