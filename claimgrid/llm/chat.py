"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log has one row per event of a message: `delta` appends its text, `edit` replaces the message by its text, `regenerate` empties it.
Events are folded by message: what comes before the last edit or regeneration is void, the rest is joined in the order of the
log. Messages are rendered one by one, so a conversation with very many of them is spread until its rendered turns are joined.

A turn is written as <|turn|>ROLE<|text|>TEXT<|end|> and a line feed. In roles and texts every `<`, followed by any number of
backslashes and `|`, gets one more backslash before the `|`, so no text contains a control string, and taking one away again
restores it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"

EVENTS = "conv_id, message, seq, kind, role, text"


def escape(text):
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text):
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) from events(conv_id, message, seq, kind, role, text).

    Events are taken in the order of seq, ties by kind and text. The role is that of the first event that has one. Null texts and
    roles count as empty, null kinds as delta. A message that was emptied and got no further text stays with an empty text.
    """
    reset = F.col("kind").isin("edit", "regenerate")
    w = W.partitionBy("conv_id", "message")
    order = F.struct(F.col("seq"), F.col("kind"), F.col("text"))
    e = events.select("conv_id", "message", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("last", F.max(F.when(reset, order)).over(w)).withColumn("live", F.col("last").isNull() | (order >= F.col("last")))
    part = F.when(F.col("live"), F.struct("seq", "kind", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text")))
    return e.groupBy("conv_id", "message").agg(F.coalesce(F.min_by("role", F.when(F.col("role").isNotNull(), order)), F.lit("")).alias("role"), F.array_join(F.array_sort(F.collect_list(part))["text"], "").alias("text"))


def render(messages: DataFrame, trained=("assistant",)) -> DataFrame:
    """(conv_id, formatted, pieces) from messages(conv_id, message, role, text), in the order of message.

    pieces: the formatted text cut where the loss mask changes, array of (text, loss); loss holds for the texts of the roles in
    `trained`, not for the marks around them.
    """
    row = F.struct("message", F.concat(F.lit(TURN), escape("role"), F.lit(TEXT)).alias("head"), escape("text").alias("body"), F.col("role").isin(*trained).alias("loss"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    cut = F.flatten(F.transform("turns", lambda t: F.array(F.struct(t["head"].alias("text"), F.lit(False).alias("loss")), F.struct(t["body"].alias("text"), t["loss"].alias("loss")), F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))))
    return turns.select("conv_id", cut.alias("pieces")).select("conv_id", F.array_join(F.col("pieces")["text"], "").alias("formatted"), "pieces")


def format_chats(events: DataFrame, trained=("assistant",)) -> DataFrame:
    """Fold a log and render its conversations; other columns are not read, an empty log gives no conversation."""
    return render(fold(events), trained)


def read_turns(formatted):
    """The turns of a formatted text as an array of (role, text)."""
    body = F.transform(F.slice(F.split(formatted, r"<\|turn\|>"), 2, 2_147_483_646), lambda t: F.split(t, r"<\|text\|>|<\|end\|>\n"))
    return F.transform(body, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def log_of(rows: DataFrame, parts: int = 8, least: int = 200) -> DataFrame:
    """The log that a table of turns (conv_id, turn, role, text) stands for: each turn is streamed as up to `parts` deltas of at
    least `least` code points. Turns are ordered by turn (null first), ties by role and text; equal rows are messages of their own."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("message", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")))
    size = F.greatest(F.lit(least), F.ceil(F.length("text") / parts)).cast("int")
    rows = rows.withColumn("size", size).withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / size).cast("int") - 1))))
    return rows.select("conv_id", "message", (F.col("message") * (parts + 1) + F.col("i")).cast("long").alias("seq"), F.lit("delta").alias("kind"), "role", F.expr("substring(text, i * size + 1, size)").alias("text"))
