"""Chat formatting by event-sourced reconstruction, in native expressions only.

A log holds events of conversations: ``conv_id``, ``seq`` and ``part`` (the order),
``event``, ``message_id``, ``role``, ``text``.  Events:

* ``start``       a message begins (its role; its text so far, usually none)
* ``delta``       text that is appended to the message
* ``edit``        the message's text becomes the event's
* ``regenerate``  as ``edit``, and messages that follow it in the conversation and
  had begun before the regeneration are dropped, as they answered what is gone
* ``delete``      the message goes, unless a later ``edit`` or ``regenerate`` restores it

``fold`` sorts each message's events and folds them into its final text; ``render``
puts the messages of a conversation in order into one string and says which
characters a loss applies to; ``parse`` reads that string back.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``.  In texts and roles ``<``,
any number of ``\\``, ``|`` gets one ``\\`` more, so no control string survives and
taking one away restores the text; roles also escape ``%`` and line feeds.

Skew: events are grouped by message first, so a conversation's events spread over
the tasks; only finished messages meet by conversation, whose one string is the
result.  Nothing is quadratic in a conversation's length.

Defined results: a null text or role is empty; rows with a null ``conv_id`` make one
conversation, as SQL groups them; messages with equal order follow by role and text;
equal rows each make their message; an empty log gives no conversation; a conversation
is one row of the result and so has to fit in one, however many events it took; other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Code points of one delta when turns are replayed as a log.
DELTA_CHARS = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def log_of_turns(turns: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The log that would have streamed these turns: a start and its deltas for each row."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"),
        F.monotonically_increasing_id().alias("message_id"),  # only tells rows apart
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    pieces = F.expr(f"transform(sequence(0, CAST(ceil(char_length(text) / {delta_chars}) AS INT)), i -> struct(i AS part, CASE WHEN i = 0 THEN '' ELSE substring(text, (i - 1) * {delta_chars} + 1, {delta_chars}) END AS text))")
    return rows.select("conv_id", "seq", "message_id", "role", F.inline(pieces).alias("part", "text")).select(
        "conv_id", "seq", "part", F.when(F.col("part") == 0, "start").otherwise("delta").alias("event"), "message_id", "role", "text"
    )


def fold(log: DataFrame) -> DataFrame:
    """One row a message that remains: ``conv_id``, ``seq``, ``part`` of its first event, ``message_id``, ``role``, ``text``."""
    event = F.struct("seq", "part", "event", F.coalesce("text", F.lit("")).alias("text"), F.col("role"))
    grouped = log.groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(event)).alias("events"))
    marked = grouped.select(
        "conv_id", "message_id", "events",
        # place of the last event that sets the text anew
        F.expr("coalesce(array_max(transform(events, (e, i) -> CASE WHEN e.event <> 'delta' AND e.event <> 'delete' THEN i END)), 0)").alias("reset"),
    )
    messages = marked.select(
        "conv_id", "message_id",
        F.col("events")[0]["seq"].alias("seq"), F.col("events")[0]["part"].alias("part"),
        F.coalesce(F.expr("get(filter(transform(events, e -> e.role), r -> r IS NOT NULL), 0)"), F.lit("")).alias("role"),
        F.expr("array_join(transform(slice(events, reset + 1, size(events)), e -> e.text), '')").alias("text"),
        F.expr("exists(slice(events, reset + 1, size(events)), e -> e.event = 'delete')").alias("deleted"),
        F.expr("array_max(transform(events, e -> CASE WHEN e.event = 'regenerate' THEN struct(e.seq AS seq, e.part AS part) END))").alias("again"),
    )
    before = Window.partitionBy("conv_id").orderBy("seq", "part", "role", "text", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        messages.withColumn("superseded", F.max("again").over(before))
        .where(~F.col("deleted") & (F.col("superseded").isNull() | (F.col("superseded") <= F.struct("seq", "part"))))
        .select("conv_id", "seq", "part", "message_id", "role", "text")
    )


def render(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss``: spans of ``formatted`` (code points from 0) that assistants wrote.

    A span tells its turn and where that turn begins, so that reading it takes no
    scan of the whole string.
    """
    order = Window.partitionBy("conv_id").orderBy("seq", "part", "role", "text", "message_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    pieces = messages.select("*", head.alias("head"), escape(F.col("text")).alias("body")).select(
        "*", F.concat("head", "body", F.lit(END + "\n")).alias("piece")
    )
    placed = pieces.select(
        "conv_id", "role", "head", "body", "piece",
        F.row_number().over(order).alias("turn"),
        F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0).cast("long")).alias("begins"),
    )
    span = F.when(
        F.col("role") == "assistant",
        F.struct("turn", "begins", (F.col("begins") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")),
    )
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "piece", span.alias("span")))).alias("m"))
    return grouped.select(
        "conv_id",
        F.expr("array_join(transform(m, x -> x.piece), '')").alias("formatted"),
        F.expr("filter(transform(m, x -> x.span), s -> s IS NOT NULL)").alias("loss"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` (role, text) and ``loss_texts``, read back from ``formatted`` and ``loss``."""
    cut = formatted.select("*", F.expr(r"slice(split(formatted, '<\\|im_start\\|>'), 2, 2147483647)").alias("segments"))
    role = F.expr(r"transform(segments, s -> substring_index(s, '\n', 1))").alias("roles")
    both = cut.select("*", role)
    texts = F.zip_with("segments", "roles", lambda s, r: F.struct(unescape_role(r).alias("role"), unescape(F.substring_index(F.substring(s, F.length(r) + 2, F.length(s)), END, 1)).alias("text")))
    under = F.transform(
        "loss",
        lambda x: unescape(F.substring(F.get("segments", x["turn"] - 1), (x["start"] - x["begins"] - len(START) + 1).cast("int"), x["length"].cast("int"))),
    )
    return both.select("conv_id", "formatted", texts.alias("turns"), under.alias("loss_texts"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Turns to their log, the log to messages, the messages to one formatted row a conversation."""
    return render(fold(log_of_turns(turns)))
