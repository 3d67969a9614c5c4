"""Chat formatting by quotation linking, in DataFrame functions alone.

Messages quote earlier ones with lines that begin with >, once for each level.  The lines of a message are
parsed into runs of one level.  A quoted passage is a run, or a single line of it; it is normalised (lower
case, single spaces), hashed, and joined to the first message of the conversation whose own words hold the
same passage.  A message replies to the latest message that its outermost linked quotes come from; one without
linked quotes replies to the turn before it.  The texts returned are without quotes and the lines that
introduce them, and messages are numbered in reply order: after what they reply to, with the other replies to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import saved

# Quote marks at the start of a line, and a line that introduces a quote.
QUOTE = r"^(?:[ \t]*>)+[ \t]?"
INTRODUCES = r"(?i)(wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"


def _normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """`messages` with _lines: array<struct<level, said>> (said: the line without its marks)."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n"), "\n")

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, QUOTE, 0)
        return F.struct(
            (F.length(marks) - F.length(F.translate(marks, ">", ""))).alias("level"),
            F.regexp_replace(x, QUOTE, "").alias("said"),
        )

    return messages.withColumn("_lines", F.transform(lines, line))


def _passages(df: DataFrame) -> DataFrame:
    """A row for each passage of a message: its level and normalised text.  Runs of one level, and their lines."""
    starts = F.expr("filter(sequence(0, size(_lines) - 1), i -> i = 0 OR _lines[i].level <> _lines[i - 1].level)")
    df = df.withColumn("_starts", starts)
    runs = F.expr(
        "transform(_starts, (s, k) -> named_struct('level', _lines[s].level, 'said', "
        "array_join(transform(slice(_lines, s + 1, coalesce(get(_starts, k + 1), size(_lines)) - s), x -> x.said), ' ')))"
    )
    both = F.explode(F.array_distinct(F.concat(runs, F.col("_lines"))))
    df = df.withColumn("_passage", both).select("conv", "at", F.col("_passage.level").alias("level"), _normalised(F.col("_passage.said")).alias("passage"))
    return df.where("passage <> ''").distinct()


def without_quotes(lines: Column) -> Column:
    """The lines that are a message's own: not quoted, and not the one that introduces a quote."""

    def own(x: Column, k: Column) -> Column:
        following = F.get(lines, k + 1)["level"]
        return (x["level"] == 0) & ~(x["said"].rlike(INTRODUCES) & (F.coalesce(following, F.lit(0)) > 0))

    return F.trim(F.array_join(F.transform(F.filter(lines, own), lambda x: x["said"]), "\n"))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations in reply order, without quotes: one row for every message.

    Columns: the conversation, turn and role, text (own words, trimmed), quote_depth (levels of quotes), n_quoted
    (quoted lines), n_linked (quoted passages found in earlier messages), reply_to (a turn, or null where there
    is nothing to reply to), position (from 0 within the conversation, by reply_to, nulls first, then turn, nulls last,
    role and text, nulls first: every message comes after the one it replies to).  Null texts count as empty.  A null
    conversation or turn links with nothing, and a null conversation has no positions.  Messages that repeat a turn get
    the same links, those of all of them together.
    """
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("at"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = parsed(rows)
    known = rows.where("conv IS NOT NULL AND at IS NOT NULL")
    passages = _passages(known.select("conv", "at", "_lines")).withColumn("key", F.md5("passage"))
    quoted = passages.where("level > 0").select("conv", "at", "level", "key")
    originals = passages.where("level = 0").groupBy("conv", "key").agg(F.min("at").alias("source"))
    linked = quoted.join(originals, ["conv", "key"]).where("source < at")
    # Outermost level first, then the latest source: the greatest (-level, source).
    replies = linked.groupBy("conv", "at").agg(F.max(F.struct((-F.col("level")).alias("outer"), "source"))["source"].alias("found"), F.count("*").alias("n_linked"))
    turns = known.select("conv", (F.col("at") + 1).alias("at"), F.col("at").alias("previous")).distinct()
    own = rows.select(
        "conv", "at", "role", without_quotes(F.col("_lines")).alias("text"),
        F.coalesce(F.array_max(F.transform("_lines", lambda x: x["level"])), F.lit(0)).alias("quote_depth"),
        F.size(F.filter("_lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
    )
    replied = own.join(replies, ["conv", "at"], "left").join(turns, ["conv", "at"], "left")
    replied = replied.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"), "reply_to": F.coalesce("found", "previous")}).drop("found", "previous")
    return _numbered(replied).select(
        F.col("conv").alias(conv_col), F.col("at").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col),
        "quote_depth", "n_quoted", "n_linked", "reply_to", "position",
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` with their position in the conversation.

    All rows are sorted at once, so that a long conversation lies in many partitions.  In each of those its rows
    are counted, and what lies in earlier ones is added; only a partition's first conversation can have begun before.
    """
    order = [F.asc_nulls_first("reply_to"), F.asc_nulls_last("at"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    ordered = saved(rows.orderBy("conv", *order).withColumn("_n", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("_part", F.shiftright("_n", 33))
    counts = ordered.where("conv IS NOT NULL").groupBy("conv", "_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begun = counts.select("conv", "_part", before.alias("_before")).where("_before > 0")  # a row for each partition at most
    own = F.row_number().over(Window.partitionBy("conv", "_part").orderBy("_n")) - 1
    numbered = ordered.withColumn("_own", F.when(F.col("conv").isNotNull(), own)).join(F.broadcast(begun), ["conv", "_part"], "left")
    return numbered.withColumn("position", (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("long"))


def conversations(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", size: int = 256) -> DataFrame:
    """What `link_quotes` gives as conversations: the conversation, part, and messages in reply order.

    A part has `size` messages (the last one fewer), so that no conversation is too long for a row; messages of a null
    conversation have no part.
    """
    message = F.struct("position", F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), "reply_to")
    part = F.floor(F.col("position") / size).cast("long").alias("part")
    return linked.where("position IS NOT NULL").groupBy(conv_col, part).agg(F.sort_array(F.collect_list(message)).alias("messages"))
