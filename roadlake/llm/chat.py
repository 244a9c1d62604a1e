"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it as context,
then the reply, whose text alone is trainable (``loss_start`` to ``loss_end``, in
characters). What follows the last reply, or a conversation without any, becomes a
last example without a trainable part, so that no turn is lost.

A turn reads ``<s>[ROLE] role [/ROLE] text</s>``. Control strings inside roles and
texts get a backslash after their first character, and one more where they have
some, which ``unescape`` takes away again; so no text can pose as a mark.

The method writes each context again for each reply: a conversation of n turns gives
n examples of up to n turns. One conversation is put together in one row.

Nulls and ties: a null text or role is empty. Turns go by (turn, role, text), null
turns first; repeated rows are turns of their own. Rows with a null id are one
conversation. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLY = "assistant"
OPEN, MIDDLE, CLOSE = "<s>[ROLE] ", " [/ROLE] ", "</s>"
_MARK = r"(/?(?:s>|INST\]|ROLE\]))"
_FREE, _ESCAPED = r"([<\[])(\\*)" + _MARK, r"([<\[])\\(\\*)" + _MARK


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _FREE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_examples(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Examples: the id, ``example`` (the target's place), ``formatted``, the loss span."""

    def plain(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    role, text = plain(role_col), plain(text_col)
    row = turns.select(
        F.col(f"`{id_col}`").alias("id"),
        F.struct(
            F.col(f"`{turn_col}`").alias("turn"),
            role.alias("role"),
            text.alias("text"),
            F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE)).alias("head"),
            escape(text).alias("body"),
        ).alias("t"),
    )
    whole = row.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))
    whole = whole.select("id", "turns", parts.alias("parts"))
    target = whole.select("id", "turns", "parts", F.posexplode("turns").alias("place", "t"))
    is_reply = F.col("t.role") == REPLY
    target = target.where(is_reply | (F.col("place") == F.size("turns") - 1))
    start = F.char_length("context") + F.char_length("t.head")
    return (
        target.select(
            F.col("id"),
            F.col("place").alias("example"),
            F.concat_ws("", F.slice("parts", F.lit(1), F.col("place"))).alias("context"),
            F.element_at("parts", F.col("place") + 1).alias("last"),
            F.col("t"),
            is_reply.alias("trainable"),
        )
        .select(
            F.col("id").alias(id_col),
            "example",
            F.concat("context", "last").alias("formatted"),
            F.when(F.col("trainable"), start).otherwise(0).alias("loss_start"),
            F.when(F.col("trainable"), start + F.char_length("t.body"))
            .otherwise(0)
            .alias("loss_end"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, MIDDLE, 1)
        cut = F.char_length(role) + len(MIDDLE) + 1
        return F.struct(
            unescape(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(piece, cut)).alias("text"),
        )

    return F.transform(pieces, turn)


def read_back(examples: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation: its turns and the texts under the loss mask, read from examples."""
    loss = F.substr(
        F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")
    )
    whole = examples.groupBy(F.col(f"`{id_col}`").alias("id")).agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    return whole.select(
        F.col("id").alias(id_col),
        read_turns(F.col("formatted")).alias("turns"),
        F.transform("losses", lambda x: unescape(x["loss"])).alias("losses"),
        "formatted_chars",
    )
