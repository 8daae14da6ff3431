"""Chat formatting with Spark expressions only.

A conversation's rows are sorted by turn, then role, then text, and collected as structs that are joined; a null text or role
is empty. Adjacent turns of one role become one block, in which a mark keeps the turns apart, so that the output still
holds each of them. All marks start with ``<|``. Inside roles and texts a backslash is put after the first character of
whatever could be taken for a mark of this or another common template; where backslashes stand there already, one more
joins them, so taking one away again restores the text exactly.

Marks stand between turns by what is before them, so a conversation is written turn by turn: a window tells each turn
whether its role is that of the turn before and how many characters come before it, and time grows with the turns.

Each row with a null ``conv_id`` is a conversation of its own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: What may not stand in a text unescaped, without its first character. Fixed values.
_TAILS = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
LOSS_ROLE = "assistant"
#: Spans that are cut out of a text one by one; more are cut out of the list of its characters.
MANY = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAILS, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAILS, "$1$2")


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start and end in code points of ``formatted``, one for each assistant text)."""
    role, text = (escape(F.coalesce(c, F.lit(""))).alias(c) for c in ("role", "text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    sorting = [F.coalesce(c, F.lit("")).alias(f"{c}_as_is") for c in ("role", "text")]
    written = rows.select("conv_id", alone, "turn", *sorting, role, text)
    order = Window.partitionBy("conv_id", "alone").orderBy("turn", "role_as_is", "text_as_is")
    same = F.lag("role").over(order) == F.col("role")
    ends = F.when(F.lag("role").over(order).isNotNull(), F.lit(END + "\n")).otherwise(F.lit(""))
    before = F.when(same, F.lit(NEXT)).otherwise(F.concat(ends, F.lit(TURN), F.col("role"), F.lit(TEXT)))
    pieces = written.select("conv_id", "alone", "role", "text", before.alias("before"), F.row_number().over(order).alias("place"), *(F.col(c) for c in ("turn", "role_as_is", "text_as_is")))
    upto = F.sum(F.length("before") + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    turns = pieces.select("conv_id", "alone", F.struct("place", F.concat("before", "text").alias("piece"), F.col("role"), upto.alias("end"), F.length("text").alias("n")).alias("turn"))
    return (
        turns.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
        .select(
            "conv_id", F.concat(F.array_join("turns.piece", ""), F.lit(END + "\n")).alias("formatted"),
            F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: F.struct((t["end"] - t["n"]).alias("start"), t["end"].alias("end"))).alias("loss_spans"),
        )
    )


def read_back(formatted: Column) -> Column:
    """The turns held in a formatted conversation: array of (role, text)."""
    blocks = F.slice(F.split(formatted, r"<\|turn\|>"), F.lit(2), F.size(F.split(formatted, r"<\|turn\|>")) - 1)

    def turns(b: Column) -> Column:
        role = unescape(F.substring_index(b, TEXT, 1))
        body = F.regexp_extract(b, r"(?s)^.*?<\|text\|>(.*)<\|end\|>\n$", 1)
        return let(role, lambda r: F.transform(F.split(body, r"<\|next\|>"), lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    place = lambda s: ((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    few = F.transform(spans, lambda s: unescape(F.substring(formatted, *place(s))))
    # a substring is counted off from the start of the text, a slice isn't
    many = let(F.split(formatted, ""), lambda chars: F.transform(spans, lambda s: unescape(F.array_join(F.slice(chars, *place(s)), ""))))
    return F.array_join(F.when(F.size(spans) <= MANY, few).otherwise(many), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What the output holds, by reading it back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
        .select(
            "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
