"""Chat formatting with Spark expressions only.

A conversation's turns are put in order, adjacent turns of one role are merged into one block, and the
blocks are concatenated::

    <|start|>ROLE<|text|>TEXT<|turn|>TEXT<|end|>\\n

``<|turn|>`` stands between merged turns, so that every turn can be read back. Control strings inside roles
and texts are escaped reversibly: each backslash is doubled, then a backslash goes behind the first
character of ``<|``, ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``. No escaped text holds ``<|``.

The loss mask covers the texts of assistant blocks, without the ``<|turn|>`` between them.

Defined cases: null role or text is empty; a null conv_id is a conversation of its own; a null turn comes
first; rows that tie on turn are ordered by role, then text; a repeated row is a turn of its own; an empty
table gives no rows; further columns are ignored.

Two levels keep a hot conversation out of a single sort: rows are first collected by
``(conv_id, turn div 64)`` and each such segment becomes one string with its first and last role; only
segments meet per conversation. The formatted conversation itself is one value, by the nature of the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, TURN, END = "<|start|>", "<|text|>", "<|turn|>", "<|end|>\n"
SEGMENT_TURNS = 64
#: What a text may not contain unescaped; the first group stays in front of the backslash.
CONTROL = r"(<)(?=\||/?s>)|(\[)(?=/?INST\])"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _opening(role: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(TEXT))


def _glued(parts: Column, first: str, last: str, body: str) -> Column:
    """Join parts: the same role on both sides of a seam goes on, another closes the block and opens one."""
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(parts, lambda x: x[last]))
    pairs = F.arrays_zip(parts.alias("part"), F.slice(before, 1, F.size(parts)).alias("before"))
    seam = lambda x: (
        F.when(x["before"].isNull(), F.lit(""))
        .when(x["before"] == x["part"][first], F.lit(TURN))
        .otherwise(F.concat(F.lit(END), _opening(x["part"][first])))
    )
    return F.array_join(F.transform(pairs, lambda x: F.concat(seam(x), x["part"][body])), "")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted: one row per conversation."""
    rows = conversations.select(
        "conv_id",
        F.floor(F.col("turn") / SEGMENT_TURNS).alias("segment"),
        "turn",
        escape(F.coalesce(F.col("role"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
    )
    segments = (
        rows.groupBy("conv_id", "segment")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select(
            "conv_id",
            F.struct(
                "segment",
                F.element_at("turns", 1)["role"].alias("first"),
                F.element_at("turns", -1)["role"].alias("last"),
                _glued(F.col("turns"), "role", "role", "text").alias("body"),
            ).alias("part"),
        )
    )
    return (
        segments.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("part")).alias("parts"))
        .select(
            "conv_id",
            F.concat(
                _opening(F.element_at("parts", 1)["first"]),
                _glued(F.col("parts"), "first", "last", "body"),
                F.lit(END),
            ).alias("formatted"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> back from a formatted conversation."""
    quoted = lambda s: r"\Q" + s + r"\E"
    blocks = F.filter(F.split(formatted, quoted(END)), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substr(block, F.lit(len(START) + 1)), TEXT, 1)
        texts = F.split(F.element_at(F.split(block, quoted(TEXT), 2), 2), quoted(TURN), -1)
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    turns = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"])
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.array_join(learnt, "").alias("learnt"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
