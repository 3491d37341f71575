r"""Operator 4: chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, then that reply, and only the
reply's characters trainable. Turns after the last assistant turn would be lost that way, so a conversation that does
not end with an assistant turn has one more example without a trainable part. A rendered turn is

    ### role: text
    </turn>

with a backslash before every backslash, ``#`` and ``<`` of the text; in the role ``#`` and ``<`` have one too, a
backslash is written ``\b`` and a colon ``\c``. So neither mark can occur inside a turn, the first colon of a turn
ends its role, and both can be read back.

A conversation's turns are gathered in one row, as its last example must hold all of them anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "\n</turn>\n"
TARGET = "assistant"
#: What roles are written with.
ROLE = (("\\", r"\b"), (":", r"\c"), ("#", r"\#"), ("<", r"\<"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"[\\#<]", r"\\$0")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _heading(role: Column) -> Column:
    for plain, code in ROLE:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE))


def _role(heading: Column) -> Column:
    for plain, code in reversed(ROLE):
        heading = F.replace(heading, F.lit(code), F.lit(plain))
    return heading


def chat_examples(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (1, 2, ...), formatted, loss_start (code points from 0) and loss_length.

    ``turns`` has conv_id, turn, role, text. A null role or text is empty; turns with one number (null first) are
    ordered by role and text, and repeated rows are turns of their own; rows with a null conv_id are one conversation.
    loss_length is 0 in an example that trains nothing, or whose reply is empty.
    """
    none = F.lit("")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), none).alias("role"), F.coalesce(F.col("text").cast("string"), none).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = whole.select(
        "conv_id", "turns", F.transform("turns", lambda t: F.concat(_heading(t["role"]), escaped(t["text"]), F.lit(CLOSE))).alias("parts"), F.size("turns").alias("n")
    )
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (F.get("turns", i - 1)["role"] == TARGET) | (i == F.col("n")))
    each = whole.select("conv_id", "turns", "parts", F.posexplode(ends).alias("example", "end"))
    last, context = F.get("turns", F.col("end") - 1), F.array_join(F.slice("parts", 1, F.col("end") - 1), "")
    own = F.when(last["role"] == TARGET, F.length(escaped(last["text"]))).otherwise(0)
    return each.select(
        "conv_id",
        (F.col("example") + 1).alias("example"),
        F.concat(context, F.get("parts", F.col("end") - 1)).alias("formatted"),
        (F.length(context) + F.length(_heading(last["role"]))).cast("long").alias("loss_start"),
        own.cast("long").alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: its turns, in order, and the text under the loss masks, in order."""
    middle = lambda p: F.instr(p, MIDDLE)
    role = lambda p: _role(F.substring(p, F.lit(len(OPEN) + 1), middle(p) - 1 - len(OPEN)))
    text = lambda p: unescaped(F.substring(p, middle(p) + len(MIDDLE), F.length(p)))
    pieces = F.split("all", f"\\Q{CLOSE}\\E")
    masked = F.struct("example", F.expr("substring(formatted, cast(loss_start AS int) + 1, cast(loss_length AS int))").alias("text"))
    whole = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("all"), F.sort_array(F.collect_list(masked)).alias("masked"), F.sum(F.length("formatted")).cast("long").alias("formatted_chars")
    )
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))
    return whole.select("conv_id", turns.alias("turns"), F.transform("masked", lambda m: unescaped(m["text"])).alias("trained"), "formatted_chars")
