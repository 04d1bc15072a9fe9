"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn; adjacent turns of one role are merged
into one block; blocks are concatenated as

    <|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT...]<|im_end|>\\n

A control string starts with "<|". Inside roles and texts every "<", any number of backslashes, "|" gets one
more backslash, so no text holds "<|" any more and the original comes back exactly; a line feed inside a role is
<|nl|>. The output is a list of
segments, each with a loss flag: texts of assistants have it, everything else hasn't. `formatted` is their
concatenation.

A conversation is one row of the output, so its turns meet in one task: that is the unit asked for. Nothing
larger than one conversation is gathered.

Defined results: null roles and texts are empty; a null turn comes first; equal turn numbers are ordered by
role, then text; repeated rows are turns of their own; a null conv_id is a conversation of its own; the empty
table gives the empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template.
START, SEP, END, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), F.replace(escape(empty(role_col)), F.lit("\n"), F.lit(LINE)).alias("role"), escape(empty(text_col)).alias("text")).alias("said"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    # where a role begins; the block k is turns[starts[k]] .. turns[starts[k + 1] - 1]
    starts = sorted_turns.withColumn("starts", F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 OR get(turns, i - 1).role <> get(turns, i).role)"))
    blocks = starts.withColumn(
        "blocks",
        F.expr(
            "transform(starts, (s, k) -> struct(get(turns, s).role AS role,"
            " transform(slice(turns, s + 1, coalesce(get(starts, k + 1), size(turns)) - s), t -> t.text) AS texts))"
        ),
    )
    piece = (
        "flatten(transform(blocks, b -> concat("
        f"array(struct(concat('{START}', b.role, '\\n') AS text, false AS loss)),"
        f" flatten(transform(b.texts, (t, i) -> IF(i = 0, array(struct(t AS text, b.role = '{loss_role}' AS loss)),"
        f" array(struct('{SEP}' AS text, false AS loss), struct(t AS text, b.role = '{loss_role}' AS loss))))),"
        f" array(struct('{END}\\n' AS text, false AS loss)))))"
    )
    return blocks.select("conv_id", F.expr(piece).alias("segments")).withColumn("formatted", F.expr("array_join(segments.text, '')"))


def read_turns(formatted: Column) -> Column:
    """The turns in the formatted text, array<struct<role, text>>, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, k: k > 0)

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.split(F.regexp_extract(block, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1), r"<\|im_sep\|>")
        return F.transform(body, lambda t: F.struct(unescape(F.replace(role, F.lit(LINE), F.lit("\n"))).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from format_conversations' output, as counts and digests."""
    back = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
