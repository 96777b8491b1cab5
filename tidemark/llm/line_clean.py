"""Line-first cleaning of web text, in built-in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[ \\t-\\r]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
NAVIGATION = "|>»›·•/"
#: Fixed phrases of page furniture and licence notices, matched in the lower-cased line.
BOILERPLATE = (
    "all rights reserved|copyright|©|licensed under|released under the|cookie|privacy policy|terms of (use|service)"
    "|subscribe|sign up|log in|enable javascript|lorem ipsum|click here|skip to content|back to top"
)


def _word_count(text: Column) -> Column:
    """Words of a string: the starts of runs of other characters than ASCII white space."""
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != F.lit("")))


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def repeated_words(words: Column, n: int = 8) -> Column:
    """How many words of the array lie in an ``n``-word window that the array holds twice or more.

    Windows are told apart by 64-bit hashes. Only rows whose windows are not all different pay for the sort: it
    brings equal windows together, their starts are put in order, and each start covers the words up to the
    next start, ``n`` at most.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.transform(
            F.array(pairs),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        F.arrays_zip(s.alias("p"), F.concat(F.slice(s, 2, F.size(s)), F.array(F.lit(None))).alias("q"), F.concat(F.array(F.lit(None)), s).alias("o")),
                        lambda x: x["p"].isNotNull() & (x["p"]["h"].eqNullSafe(x["q"]["h"]) | x["p"]["h"].eqNullSafe(x["o"]["h"])),
                    ),
                    lambda x: x["p"]["i"],
                )
            ),
        )[0]

    def total(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-n).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(n), i - a["last"])).alias("n"), i.alias("last")),
        )["n"]

    def windows_of(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[h[i + k] for k in range(n)]))
        return F.when(F.size(h) >= n, each).otherwise(F.array().cast("array<bigint>"))

    return F.transform(
        F.transform(F.array(hashes), windows_of),
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(total(covered(w))),
    )[0]


def line_verdicts(lines: Column) -> Column:
    """Per line ``(line, words, failed)``: ``failed`` names the first rule that the line breaks, else null.

    Rules: ``repeat`` (equal to an earlier line with a word), ``boilerplate`` (a fixed phrase), ``symbols``
    (two or more symbol characters, over one for five words), ``navigation`` (two or more separators standing
    alone, over one for five words), ``shouting`` (runs of ! or ? after 30 % of the words), ``punctuation``
    (no letter or digit, or under ten words without closing punctuation). Lines without a word never fail.
    """

    def judge(line: Column) -> Column:
        words = _word_count(line)
        low = F.lower(line)
        separators = _word_count(line) - F.size(F.filter(F.split(line, SPACE), lambda w: (w != F.lit("")) & ~w.isin(*NAVIGATION)))
        rule = (
            F.when(words == 0, F.lit(None).cast("string"))
            .when(low.rlike(BOILERPLATE) & (words <= 40), "boilerplate")
            .when((_count(line, SYMBOLS) >= 2) & (5 * _count(line, SYMBOLS) > words), "symbols")
            .when((separators >= 2) & (5 * separators > words), "navigation")
            .when(line.contains("!!") & (10 * F.size(F.split(line, "[!?]{2,}")) > 3 * words + 10), "shouting")
            .when(~line.rlike("[\\p{L}\\p{N}]"), "punctuation")
            .when((words < 10) & ~line.rlike("[.!?…:;\"”»。！？)\\]][ \\t-\\r]*$"), "punctuation")
        )
        return F.struct(line.alias("line"), words.cast("long").alias("words"), rule.alias("failed"))

    return F.transform(lines, judge)


def first_lines(judged: Column) -> Column:
    """The judged lines without those that equal an earlier one; lines without a word all stay.

    Lines sorted with their places put equal ones side by side, so the work grows with their number, not its square.
    """

    def firsts(a: Column) -> Column:
        ranked = F.sort_array(F.transform(a, lambda x, i: F.struct(x["line"].alias("line"), i.alias("i"), x["words"].alias("words"))))
        new = F.transform(F.array(ranked), lambda s: F.filter(s, lambda x, k: (x["words"] == 0) | ~F.get(s, k - 1)["line"].eqNullSafe(x["line"])))[0]
        return F.sort_array(F.transform(new, lambda x: x["i"]))

    return F.transform(F.array(judged), lambda a: F.transform(firsts(a), lambda i: F.get(a, i)))[0]


def clean_lines(
    docs: DataFrame, text_col: str = "text", min_words: int = 20, max_repeat_percent: int = 30, min_kept_percent: int = 50, prefix: str = ""
) -> DataFrame:
    """Add the cleaned text, the base counts and the verdict to every row of ``docs``.

    New columns (after ``prefix``): ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long),
    ``base_failed``, ``clean_text`` (the lines that pass, in order), ``n_kept_words``, ``kept``: false if
    ``base_failed`` or if under ``min_kept_percent`` of the words are left. Null text counts as empty (0 words,
    ``base_failed``). All other columns stay; everything is computed within the row, without any shuffle.
    """
    p = prefix
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        "*", F.filter(F.split(text, SPACE), lambda w: w != F.lit("")).alias("_words"), F.split(text, "\n").alias("_lines")
    )
    worded = F.filter("_lines", lambda x: F.translate(x, SPACES, "") != F.lit(""))
    counted = base.select(
        *docs.columns,
        "_lines",
        F.size("_words").cast("long").alias(f"{p}n_words"),
        F.char_length(F.translate(text, SPACES, "")).cast("long").alias(f"{p}word_chars"),
        _count(text, SYMBOLS).cast("long").alias(f"{p}n_symbols"),
        F.transform(F.array(worded), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias(f"{p}n_dup_lines"),
        repeated_words(F.col("_words")).alias(f"{p}n_repeat_words"),
        line_verdicts(F.col("_lines")).alias("_judged"),
    )
    passed = F.filter("_judged", lambda x: x["failed"].isNull())
    # an equal line has an equal verdict, so repeats are found among the lines that pass
    once = F.when(F.col(f"{p}n_dup_lines") > 0, first_lines(passed)).otherwise(passed)
    failed = (F.col(f"{p}n_words") < min_words) | (100 * F.col(f"{p}n_repeat_words") > max_repeat_percent * F.col(f"{p}n_words"))
    done = counted.withColumn(f"{p}base_failed", failed).withColumn("_kept", once)
    kept_words = F.aggregate("_kept", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return (
        done.withColumn(f"{p}clean_text", F.array_join(F.transform("_kept", lambda x: x["line"]), "\n"))
        .withColumn(f"{p}n_kept_words", kept_words)
        .withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (100 * F.col(f"{p}n_kept_words") >= min_kept_percent * F.col(f"{p}n_words")))
        .drop("_lines", "_judged", "_kept")
    )
