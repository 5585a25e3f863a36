r"""Chat formatting with Spark expressions only.

Each conversation becomes one string. The turns are sorted, adjacent turns of one
role share a block, and every piece of text stays apart from its neighbours by a
control string, so the turns can be read back exactly:

    <s>role<role/>[INST] text<turn/>text [/INST]</s>     (user)
    <s>role<role/>text<turn/>text</s>                    (all other roles)

A control string inside a text or a role gets one backslash after its first
character (``</s>`` turns into ``<\/s>``); one that already has k backslashes there
gets k + 1. Reading back takes one away, so escaping loses nothing.

The loss mask covers the assistant's texts (as escaped), without control strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings after their first character, as a regular expression.
_REST = r"(/?s>|role/>|turn/>|/?INST\])"
_PLAIN = r"(<|\[)(\\*)" + _REST
_ESCAPED = r"(<|\[)\\(\\*)" + _REST
BEGIN, ROLE_END, TURN_END, END = "<s>", "<role/>", "<turn/>", "</s>"
USER_OPEN, USER_CLOSE = "[INST] ", " [/INST]"
#: Splits the body of a block from its header, and its texts from each other.
SQL_PLAIN, SQL_ESCAPED = _PLAIN, _ESCAPED


def escape(text: Column) -> Column:
    """Text in which no control string is left."""
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_chats(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: conv, formatted, n_turns, loss_spans (array of struct<start, length>, code points from 0).

    Null texts and roles count as empty; null turns come first; equal turns are ordered by role, then text, and
    repeated rows stay repeated. A null conversation id is one conversation. Other columns are ignored, an empty
    table gives no row. Prefix sums of lengths come from a running window, so the work per conversation is linear
    in its turns (plus the sort); one conversation has to fit in one row, as its result is one string.
    """
    base = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        escape(F.coalesce(F.col(text), F.lit(""))).alias("body"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    opens = (F.lag("role").over(order).isNull() | (F.lag("role").over(order) != F.col("role"))).alias("opens")
    closes = (F.lead("role").over(order).isNull() | (F.lead("role").over(order) != F.col("role"))).alias("closes")
    marked = base.select("*", opens, closes, F.row_number().over(order).alias("at"))
    user = F.col("role") == "user"
    head = F.when(
        F.col("opens"),
        F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(ROLE_END), F.when(user, F.lit(USER_OPEN)).otherwise(F.lit(""))),
    ).otherwise(F.lit(TURN_END))
    tail = F.when(F.col("closes"), F.concat(F.when(user, F.lit(USER_CLOSE)).otherwise(F.lit("")), F.lit(END))).otherwise(F.lit(""))
    pieces = marked.select("conv", "role", "at", "body", head.alias("head"), tail.alias("tail"))
    size = F.char_length("head") + F.char_length("body") + F.char_length("tail")
    before = Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        "conv",
        F.struct(
            "at",
            F.concat("head", "body", "tail").alias("piece"),
            (F.col("role") == loss_role).alias("loss"),
            (F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)) + F.char_length("head")).alias("start"),
            F.char_length("body").cast("long").alias("length"),
        ).alias("t"),
    )
    turns = pieces.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return turns.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("turns", lambda t: t.piece), "").alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        F.transform(
            F.filter("turns", lambda t: t.loss), lambda t: F.struct(t.start.alias("start"), t.length.alias("length"))
        ).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Array of struct<role, texts> (both escaped) per block of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"\Q" + END + r"\E"), lambda b: b != "")
    parted = F.transform(blocks, lambda b: F.split(F.substr(b, F.lit(len(BEGIN) + 1)), r"\Q" + ROLE_END + r"\E", 2))

    def block(p: Column) -> Column:
        user = p[0] == "user"
        inner = F.substr(p[1], F.lit(len(USER_OPEN) + 1), F.char_length(p[1]) - len(USER_OPEN) - len(USER_CLOSE))
        texts = F.split(F.when(user, inner).otherwise(p[1]), r"\Q" + TURN_END + r"\E")
        return F.struct(p[0].alias("role"), texts.alias("texts"))

    return F.transform(parted, block)


def digest(chats: DataFrame, conv: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """What a reader of the formatted strings finds in them: turns, texts under the loss mask, lengths."""
    blocks = chats.select(F.col(conv), "formatted", read_back(F.col("formatted")).alias("blocks"))
    told = F.flatten(
        F.transform("blocks", lambda b: F.transform(b.texts, lambda t: F.concat(unescape(b.role), F.lit("\n"), unescape(t), F.lit("\n"))))
    )
    loss = F.flatten(F.transform(F.filter("blocks", lambda b: b.role == loss_role), lambda b: F.transform(b.texts, unescape)))
    read = blocks.select(
        F.col(conv), F.char_length("formatted").cast("long").alias("formatted_chars"), told.alias("told"), F.array_join(loss, "").alias("loss")
    )
    return read.select(
        conv,
        F.size("told").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join("told", ""), "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
