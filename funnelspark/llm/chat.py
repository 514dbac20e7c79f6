"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
own text is trainable. Turns are written as ``### role: text </turn>`` and a line end. Where a text
holds ``###`` or ``</turn>``, one backslash is put before it and before any backslashes that already
stand there, so taking one away restores the text, and an unescaped mark is always the template's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"


def escape(text: Column) -> Column:
    """One more backslash before each control string."""
    return F.regexp_replace(text, r"(\\*)(###|</turn>)", r"\\$1$2")


def unescape(text: Column) -> Column:
    """One backslash less before each control string."""
    return F.regexp_replace(text, r"\\(\\*)(###|</turn>)", "$1$2")


def escape_role(role: Column) -> Column:
    """A backslash before each character that could end the header."""
    return F.regexp_replace(role, r"([\\:<#])", r"\\$1")


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"(?s)\\(.)", "$1")


def format_examples(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", trained: str = "assistant",
) -> DataFrame:
    """Examples (conv_id, example, text, loss_start, loss_length), by code points from 1.

    One example per turn of the role ``trained``, numbered by its position in the conversation. A
    conversation that does not end with such a turn has one more row with all its turns and an
    empty loss span, so no turn is lost. Null texts and roles are empty; a null conv_id is a
    conversation of its own; equal turn numbers go by role and text, and repeated rows stay
    repeated. Other columns are not read. An example holds its whole context, so a conversation is
    the unit of work: its turns meet in one task.
    """
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        ).alias("_t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    written = ordered.select(
        "conv_id",
        F.transform(
            "_turns",
            lambda t: F.struct(
                t["role"].alias("role"),
                F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(SEP)).alias("head"),
                F.concat(escape(t["text"])).alias("body"),
            ),
        ).alias("_parts"),
    )
    last = F.size("_parts")
    cut = written.withColumn(
        "example",
        F.explode(
            F.filter(
                F.sequence(F.lit(1), last),
                lambda i: (F.element_at("_parts", i)["role"] == trained) | (i == last),
            )
        ),
    )
    used = F.slice("_parts", 1, F.col("example"))
    final = F.element_at("_parts", F.col("example"))
    whole = F.array_join(
        F.transform(used, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""
    )
    trains = final["role"] == trained
    body = F.length(final["body"])
    return cut.select("conv_id", "example", whole.alias("text"), trains.alias("_trains"),
                      body.alias("_body")).select(
        "conv_id",
        "example",
        "text",
        F.when(
            F.col("_trains"), F.length("text") - len(CLOSE) - F.col("_body") + 1
        ).otherwise(1).alias("loss_start"),
        F.when(F.col("_trains"), F.col("_body")).otherwise(0).alias("loss_length"),
    )


def parse_turns(text: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    pieces = F.split(text, " </turn>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    head = r"(?s)^### ((?:[^\\:]|\\.)*): (.*)$"
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.regexp_extract(p, head, 1)).alias("role"),
            unescape(F.regexp_extract(p, head, 2)).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples say: turns, text under the loss mask, sizes.

    The longest example holds all turns; the loss texts are taken from all examples in order.
    """
    loss = F.substring(F.col("text"), F.col("loss_start"), F.col("loss_length"))
    per = examples.select(
        "conv_id", "example", "text", unescape(loss).alias("_loss"), F.length("text").alias("_n")
    ).groupBy("conv_id").agg(
        F.max(F.struct("example", "text")).alias("_last"),
        F.sort_array(F.collect_list(F.struct("example", "_loss"))).alias("_losses"),
        F.sum("_n").alias("formatted_chars"),
    )
    back = per.select(
        "conv_id",
        parse_turns(F.col("_last.text")).alias("turns"),
        F.array_join(F.transform("_losses", lambda x: x["_loss"]), "").alias("loss_text"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )
    said = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
