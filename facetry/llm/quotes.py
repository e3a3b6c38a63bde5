r"""Quotation linking: reply-ordered conversations without quotes, in SQL functions only.

A line's quote level is the number of ``>`` before its text.  Neighbouring lines of one level, up to a blank line,
are a passage; white space runs and case do not matter, so re-wrapped quotes are equal.  Passages are hashed
(128 bits).  The original of a quoted passage is the first message of the scope that says it itself (level 0): one
row for each passage after a grouping that adds up inside tasks first, so a passage that a third of all messages
share meets no task with more than its partial results.  Quotes then join their originals many-to-one.

A message replies to the latest original of its shallowest linked quotes; an original must come before the quote.
Paths from the first message of a thread are made by doubling, stored in the shared folder each round; messages
that link to nothing take no part.  Reply order is the order of paths: each message follows the one it answers,
messages without a link follow each other by turn.  Positions are global ranks less the first of the conversation,
so that a conversation of any length is never gathered.

Own texts lose quoted lines and a line of the form ``On ... wrote:`` before a quote.

Defined cases: null text is an empty message, text null; null roles pass through; messages of a null conversation
form one conversation; null turns come first; equal rows are separate messages in neighbouring places.  Other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import is_empty, stage
from .permutation import numbered

# Quote marks before a line, the line that announces a quote, and a mark between passages.
MARKS = r"^(?:[ \t]*>)+[ \t]?"
ANNOUNCED = r"(?i)^\s*on\b.*\bwrote:\s*$"
BREAK = "\x01"


@dataclass(frozen=True)
class QuoteParams:
    scope: tuple[str, ...] = ("conv_id",)  # originals are looked for among messages equal in these; () for all
    least_chars: int = 1  # of a passage that may link


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, passages) with own text and passages (level, k1, k2, chars) of each message."""
    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                           F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("whole"))
    rows = rows.withColumn("raw", F.split(F.translate(F.coalesce("whole", F.lit("")), BREAK + "\r", " "), "\n"))
    rows = rows.withColumn("marks", F.transform("raw", lambda x: F.regexp_extract(x, MARKS, 0)))
    rows = rows.withColumn("levels", F.transform("marks", lambda m: F.char_length(F.regexp_replace(m, "[^>]", ""))))
    rows = rows.withColumn("lines", F.transform("raw", lambda x, i: F.substring(x, F.char_length(F.get("marks", i)) + 1, F.char_length(x))))
    levels, lines = F.col("levels"), F.col("lines")
    dropped = lambda i: (F.get(levels, i) > 0) | (F.get(lines, i).rlike(ANNOUNCED) & (F.coalesce(F.get(levels, i + 1), F.lit(0)) > 0))
    at = F.sequence(F.lit(0), F.size("lines") - 1)
    rows = rows.withColumn("own", F.filter(at, lambda i: ~dropped(i)))
    rows = rows.withColumn("text", F.when(F.col("whole").isNotNull(), F.regexp_replace(F.trim(
        F.array_join(F.transform("own", lambda i: F.get(lines, i)), "\n")), r"^\s+|\s+$", "")))
    blank = lambda i: F.trim(F.regexp_replace(F.get(lines, i), r"\s", "")) == ""
    rows = rows.withColumn("used", F.filter(at, lambda i: ~blank(i) & ((F.get(levels, i) > 0) | ~dropped(i))))
    used = F.col("used")
    opens = lambda k: (k == 0) | (F.get(used, k - 1) != F.get(used, k) - 1) | (F.get(levels, F.get(used, k - 1)) != F.get(levels, F.get(used, k)))
    rows = rows.withColumn("heads", F.filter(used, lambda i, k: opens(k)))
    joined = F.array_join(F.transform(used, lambda i, k: F.concat(F.when(opens(k), F.lit(BREAK)).otherwise(F.lit(" ")), F.get(lines, i))), "")
    rows = rows.withColumn("bodies", F.transform(F.slice(F.split(joined, BREAK), 2, F.size("heads")), _plain))
    passages = F.transform("bodies", lambda b, k: F.struct(
        F.get(levels, F.get("heads", k)).alias("level"), F.xxhash64(b, F.lit(17)).alias("k1"), F.xxhash64(F.lit(29), b).alias("k2"),
        F.char_length(b).alias("chars")))
    return rows.select("conv_id", "turn", "role", "text", passages.alias("passages"))


def _paths(messages: DataFrame, parents: DataFrame) -> DataFrame:
    """(mid, path) of the messages that reply to another: turns and ids from the thread's first message on."""
    own = lambda t: F.array(F.struct(F.col(f"{t}turn").alias("turn"), F.col(f"{t}mid").alias("mid")))
    firsts = messages.join(parents.select(F.col("parent").alias("mid")).distinct(), "mid").join(parents.select("mid"), "mid", "left_anti")
    state = stage(messages.join(parents, "mid").select("mid", F.col("parent").alias("above"), own("").alias("path"))
                  .unionByName(firsts.select("mid", F.lit(None).cast("bigint").alias("above"), own("").alias("path"))))
    while not is_empty(state.filter("above is not null")):
        upper = state.select(F.col("mid").alias("above"), F.col("above").alias("next"), F.col("path").alias("before"))
        state = stage(state.join(upper, "above", "left").select(
            "mid", F.col("next").alias("above"), F.concat(F.coalesce("before", F.array().cast(state.schema["path"].dataType)), "path").alias("path")))
    return state.select("mid", "path")


def conversations(messages: DataFrame, p: QuoteParams = QuoteParams()) -> DataFrame:
    """(conv_id, turn, role, pos, depth, parent_turn, n_quoted, n_linked, text): one row for each message."""
    held = stage(parsed(messages).withColumn("mid", F.monotonically_increasing_id()))
    scope = [F.xxhash64(*p.scope) if p.scope else F.lit(0).cast("bigint")]
    said = held.select("mid", "turn", scope[0].alias("within"), F.inline("passages"))
    quotes = said.filter((F.col("level") > 0) & (F.col("chars") >= p.least_chars))
    originals = (said.filter("level = 0").groupBy("within", "k1", "k2")
                 .agg(F.min(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "mid")).alias("first")))
    found = quotes.join(originals, ["within", "k1", "k2"]).withColumn("here", F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "mid"))
    links = stage(found.filter("first < here").select("mid", "level", "first"))
    latest = links.groupBy("mid").agg(F.max(F.struct((-F.col("level")).alias("level"), "first")).alias("best"), F.count("*").alias("n_linked"))
    parents = stage(latest.select("mid", F.col("best.first.mid").alias("parent"), "n_linked"))
    paths = held.select("mid", "turn")
    rows = held.join(parents, "mid", "left")
    own = F.array(F.struct("turn", "mid"))
    if is_empty(parents):
        rows = rows.withColumn("path", own).withColumn("parent_turn", F.lit(None).cast("bigint"))
    else:
        above = held.select(F.col("mid").alias("parent"), F.col("turn").alias("parent_turn"), F.col("conv_id").alias("parent_conv"))
        rows = rows.join(_paths(paths, parents.select("mid", "parent")), "mid", "left").join(above, "parent", "left")
        rows = rows.withColumn("path", F.coalesce("path", own))
    quoted = F.size(F.filter("passages", lambda x: x["level"] > 0))
    rows = rows.select("conv_id", "turn", "role", "text", "path", "parent_turn", (F.size("path") - 1).alias("depth"),
                       quoted.cast("bigint").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"))
    rows = numbered(rows, ["conv_id", "path"], "rank")
    first = rows.groupBy(F.col("conv_id").alias("conv")).agg(F.min("rank").alias("begin"))
    return (rows.join(first, F.expr("conv_id <=> conv"))
            .select("conv_id", "turn", "role", (F.col("rank") - F.col("begin")).alias("pos"), "depth", "parent_turn", "n_quoted", "n_linked", "text"))
