"""Chat transcripts from event logs, rendered with reversible escapes, in built-in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed control strings of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Reversibly hide control strings: ``\\`` is doubled, then ``<|`` becomes ``<\\|``; no ``<|`` is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As :func:`escape`; a newline becomes ``<\\n>``, which no escaped text can hold."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, turn, role, text)`` of an event log ``(conv_id, seq, kind, turn, role, text)``.

    Events are applied per conversation in the order of ``seq`` (ties: kind, role, text, nulls first):

    * ``message`` and ``edit`` set the text of their turn, ``regenerate`` sets it anew and takes back all later
      turns that were written before it, ``delta`` appends to the text.
    * A turn's role is that of its last event that has one. Null text is empty. A turn that was taken back and
      not written again is absent. Rows without conversation or turn number form groups of their own (null ids);
      an unknown kind acts as ``message``.

    The log is partitioned by conversation once; the running step is a sorted window that holds no group in
    memory, and only the events of one turn are ever gathered.
    """
    e = events.select(
        "conv_id", "seq", F.coalesce(F.col("kind"), F.lit("message")).alias("kind"), "turn", "role", F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    before = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("turn", F.col("turn").cast("long"))
    e = e.withColumn("undone", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(before))
    live = e.where(F.col("undone").isNull() | (F.col("seq") > F.col("undone")))
    step = F.struct("seq", "kind", "role", "text")
    turns = live.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    sets = F.filter(F.transform("steps", lambda s, i: F.when(s["kind"] != "delta", i)), lambda i: i.isNotNull())
    last = F.coalesce(F.array_max(sets), F.lit(0))
    tail = F.slice("steps", last + 1, F.size("steps"))
    roles = F.filter(F.transform("steps", lambda s: s["role"]), lambda r: r.isNotNull())
    return turns.select(
        "conv_id", "turn",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(tail, lambda s: s["text"]), "").alias("text"),
    )


def render(messages: DataFrame, train_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted`` and ``spans``, the loss mask.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n`` with role and text escaped. ``spans`` are the code-point
    ranges ``(start, end)`` of the escaped texts of ``train_role`` in ``formatted``, in order. Turns are in the order
    of ``turn``; ties by role and text. A conversation is one output string, so its turns meet in one row.
    """
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    parts = turns.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("head"),
                escape(t["text"]).alias("body"),
                (t["role"] == train_role).alias("train"),
            ),
        ).alias("parts"),
    )
    tail = CLOSE + "\n"
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.char_length(p["head"]) + F.char_length(p["body"]) + F.lit(len(tail))).alias("at"),
            F.when(
                p["train"],
                F.concat(
                    a["spans"],
                    F.array(
                        F.struct(
                            (a["at"] + F.char_length(p["head"])).alias("start"),
                            (a["at"] + F.char_length(p["head"]) + F.char_length(p["body"])).alias("end"),
                        )
                    ),
                ),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )["spans"]
    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "").alias("formatted"),
        spans.alias("spans"),
    )


def parse(formatted: Column) -> Column:
    """The ``(role, text)`` turns of a rendered conversation, unescaped."""
    tail = CLOSE + "\n"
    chunks = F.split(formatted, "\\Q" + tail + "\\E")
    bodies = F.slice(chunks, 1, F.size(chunks) - 1)
    return F.transform(
        bodies,
        lambda c: F.struct(
            unescape_role(F.substr(F.substring_index(c, "\n", 1), F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(c, F.char_length(F.substring_index(c, "\n", 1)) + 2)).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, span after span with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )
