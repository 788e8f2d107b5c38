r"""Quotation linking: conversations in reply order without what they quote; DataFrame functions only.

A line's quote level is the number of marks before it; runs of lines of one level, however
deep, are passages.  Quoted passages, their paragraphs and their lines are normalised and
hashed, and joined with the first message of the conversation that says the same
outside quotes.  A message replies to the latest such message, of those quoted at
its lowest linked level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, need

#: One quoted line; a repeated group would recurse once a line.
_QUOTED = r"(?m)^[ \t]*>[^\n]*(?:\n|\z)"
_MARKS = r"^((?:[ \t]*>)*)"
_ALL_MARKS = r"^(?:[ \t]*>)+[ \t]?"


def normal(text: Column) -> Column:
    """Lower case and single spaces: what counts when passages are compared."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def passages(text: Column) -> Column:
    """(level, text without marks) of its runs of lines of one level, in order, those outside quotes (level 0) too; linear in the lines."""
    lines = F.split(text, "\n", -1)
    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))

    def runs(x: Column) -> Column:
        n = F.size(x["lines"])
        new = F.zip_with(x["levels"], F.concat(F.array(F.lit(-1)), F.slice(x["levels"], F.lit(1), n - 1)), lambda now, before: now != before)
        starts = F.filter(F.transform(new, lambda is_new, i: F.when(is_new, i)), lambda i: i.isNotNull())
        return F.struct(x["lines"].alias("lines"), x["levels"].alias("levels"), starts.alias("starts"), n.alias("n"))

    def cut_up(x: Column) -> Column:
        ends = F.concat(F.slice(x["starts"], F.lit(2), F.size(x["starts"])), F.array(x["n"]))
        body = lambda a, b: F.array_join(F.transform(F.slice(x["lines"], a + 1, b - a), lambda line: F.regexp_replace(line, _ALL_MARKS, "")), "\n")
        return F.zip_with(x["starts"], ends, lambda a, b: F.struct(F.get(x["levels"], a).alias("level"), body(a, b).alias("part")))

    leveled = _let(lines, lambda x: F.struct(x.alias("lines"), F.transform(x, level).alias("levels")))
    return _let(_let(leveled, runs), cut_up)


def unquoted(text: Column) -> Column:
    """The text's parts outside quotes."""
    outside = F.transform(F.filter(passages(text), lambda p: p["level"] == 0), lambda p: p["part"])
    return F.when(text.rlike(_QUOTED), outside).otherwise(F.array(text))


def keys(parts: Column) -> Column:
    """128-bit hashes of normalised passages, of their paragraphs and of their lines."""
    pieces = F.transform(parts, lambda p: F.concat(F.array(p), F.split(p, r"\n[ \t]*\n"), F.split(p, r"\n")))
    said = F.filter(F.transform(F.flatten(pieces), normal), lambda x: x != "")
    return F.transform(F.array_distinct(said), lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit("2"), x).alias("g")))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per row of ``messages``: conv_id, turn, role, text (without quotes), reply_to, thread, depth, n_quoted, n_linked.

    ``reply_to`` is the turn replied to, null for none; ``thread`` and ``depth`` are the first turn of
    the chain of replies and the steps from it, so that ``(conv_id, thread, depth, turn)`` is
    the order of replies.  n_quoted counts a message's distinct quoted passages, paragraphs and lines,
    n_linked those that an earlier turn of the conversation says.  Messages that share a conversation and
    a turn are linked as one and returned each; a null or empty text quotes and says nothing;
    a null conversation or turn takes part in no link and starts a thread of its own.
    Other columns are left out.
    """
    need(messages, conv_col, turn_col, role_col, text_col)
    m = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = m.filter("conv_id is not null and turn is not null")

    said = known.select("conv_id", "turn", F.explode(keys(unquoted(F.col("text")))).alias("k")).select("conv_id", "turn", "k.h", "k.g")
    first = cut(said.groupBy("conv_id", "h", "g").agg(F.min("turn").alias("said_at")), "first-said")

    parts = known.filter(F.col("text").rlike(_QUOTED)).select("conv_id", "turn", F.inline(passages(F.col("text")))).filter("level > 0")
    quoted = parts.select("conv_id", "turn", "level", F.explode(keys(F.array("part"))).alias("k"))
    quoted = cut(quoted.select("conv_id", "turn", "level", "k.h", "k.g").groupBy("conv_id", "turn", "h", "g").agg(F.min("level").alias("level")), "quoted")

    met = quoted.join(first.hint("merge"), ["conv_id", "h", "g"], "left")
    earlier = F.col("said_at") < F.col("turn")
    best = F.max(F.when(earlier, F.struct((-F.col("level")).alias("l"), F.col("said_at").alias("t"))))
    replies = cut(met.groupBy("conv_id", "turn").agg(best["t"].alias("reply_to"), F.count("*").alias("n_quoted"), F.count_if(earlier).alias("n_linked")), "replies")

    up = _chains(replies.filter("reply_to is not null").select("conv_id", "turn", "reply_to"))
    facts = cut(replies.join(up.hint("merge"), ["conv_id", "turn"], "left"), "reply-facts")
    out = m.join(facts.hint("merge"), ["conv_id", "turn"], "left")
    clean = F.trim(F.regexp_replace(F.col("text"), _QUOTED, ""))
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "turn", "role", clean.alias("text"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", zero).alias("depth"), F.coalesce("n_quoted", zero).alias("n_quoted"), F.coalesce("n_linked", zero).alias("n_linked"))


def _chains(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) of every replying turn, by doubling: as many rounds as the depth has binary digits."""
    chain = cut(links.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "chains")
    while True:
        above = chain.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("higher"), F.col("depth").alias("more"))
        chain = cut(chain.join(above.hint("merge"), ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("higher", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")), "chains")
        if chain.filter("moved").isEmpty():
            return chain.drop("moved")
        chain = chain.drop("moved")
