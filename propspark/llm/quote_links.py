"""Chat formatting by quotation linking, in DataFrame functions alone.

Lines that start with > marks are quotes of that depth. Every quoted line is normalised,
hashed and joined to the first message of its conversation that wrote the line itself. A
message replies to the latest such message among its shallowest quotes. Following these
replies gives threads; within a conversation, threads stand by their first turn and
messages by turn, so that a reply always follows what it replies to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import empty, store

#: Rounds of pointer doubling at most; each doubles the depth that is covered.
ROUNDS = 40
MARKS = r"^((?:[ \t]*>)+)"
ATTRIBUTION = r"wrote:[ \t]*$"


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", "")).cast("int")


def passage(line: Column) -> Column:
    """A line without marks, in lower case and with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[ \t\r]+", " "))


def parsed(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Messages with their lines as (level, said, next_level); next_level is that of the line behind."""
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.struct(level_of(x).alias("level"), x.alias("line")))
    out = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), lines.alias("lines"))
    seen = F.transform("lines", lambda x, i: F.struct(x["level"].alias("level"), x["line"].alias("line"), ((x["level"] == 0) & x["line"].rlike(ATTRIBUTION) & (F.coalesce(F.get("lines", i + 1)["level"], F.lit(0)) > 0)).alias("names_quote")))
    return out.withColumn("lines", seen)


def own_text(lines: Column) -> Column:
    """The unquoted lines, without those that only name who is quoted, and without blank ones at either end."""
    own = F.filter(lines, lambda x: (x["level"] == 0) & ~x["names_quote"])
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^(?:[ \t\r]*\n)+|(?:\n[ \t\r]*)+$", "")


def reply_links(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) for messages with a quote that an earlier message wrote."""
    one = lines.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("lines").alias("x"))
    one = one.select("conv_id", "turn", F.col("x.level").alias("level"), passage(F.col("x.line")).alias("passage")).where(F.col("passage").rlike(r"[\p{L}\p{N}]"))
    one = one.select("conv_id", "turn", "level", F.md5("passage").alias("key"))
    quoted = one.where("level > 0").groupBy("conv_id", "turn", "key").agg(F.min("level").alias("level"))
    first = one.where("level = 0").groupBy("conv_id", "key").agg(F.min("turn").alias("said"))
    found = quoted.join(first, ["conv_id", "key"]).where("said < turn")
    best = F.max(F.struct((-F.col("level")).alias("near"), "said"))
    return found.groupBy("conv_id", "turn").agg(best["said"].alias("reply_to"), F.count("*").alias("n_linked"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked, thread, depth): the first message that replies lead to, and their number."""
    up = store(links.withColumn("thread", F.col("reply_to")).withColumn("depth", F.lit(1)), "quote-up")
    for _ in range(ROUNDS):
        beyond = up.selectExpr("conv_id", "turn AS thread", "thread AS next", "depth AS more")
        if empty(up.join(beyond, ["conv_id", "thread"], "left_semi")):
            break
        joined = up.join(beyond, ["conv_id", "thread"], "left")
        up = store(joined.select("conv_id", "turn", "reply_to", "n_linked", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "quote-up")
    return up


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every message without quotes, in reply order: conv_id, thread, depth, turn, reply_to, n_quoted, n_linked, role, text.

    thread is the turn that the thread starts with, depth the number of replies from there,
    n_quoted the quoted lines and n_linked the distinct ones that link. Messages that quote
    nothing, or nothing known, start a thread. Null texts count as empty; null conversations
    or turns link to nothing and keep a null thread. Rows that repeat a turn link alike and
    stay; a line that several messages wrote belongs to the first. An empty table gives no
    rows; other columns are not read.
    """
    lines = store(parsed(messages, conv_col, turn_col, role_col, text_col), "quote-lines")  # read by three branches
    up = threads(reply_links(lines))
    n_quoted = F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long")
    own = lines.select("conv_id", "turn", "role", own_text(F.col("lines")).alias("text"), n_quoted.alias("n_quoted"))
    out = own.join(up, ["conv_id", "turn"], "left")
    out = out.select("conv_id", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), "turn", "reply_to", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "role", "text")
    return out.orderBy("conv_id", "thread", "turn", "role", "text")
