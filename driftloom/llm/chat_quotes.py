"""Quotation linking: find the messages that quoted passages come from and rebuild conversations in reply order. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import let, stage, text_of


def _marks(line: Column) -> Column:
    """The > marks that a line begins with and the blanks before and between them. A class alone is matched, which takes no stack however many there are."""
    return F.rtrim(F.regexp_extract(line, r"^[\x20\t>]*+", 0), F.lit(" \t"))


def quote_level(line: Column) -> Column:
    """How many > marks, blanks between them or not, a line begins with."""
    return F.char_length(F.regexp_replace(_marks(line), "[^>]", ""))


def _strip(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))


def normalised(passage: Column) -> Column:
    """Lower case, white space as single blanks, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(passage, r"[\x20\x09-\x0D]+", " ")))


def passages(text: Column) -> Column:
    """The array of (level, passage): maximal runs of lines of one quote level, marks stripped, blank lines ending a run."""
    rest = lambda x: F.substring(x, F.char_length(_marks(x)) + 1, F.char_length(x))
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(quote_level(x).alias("level"), rest(x).alias("line")))

    def grouped(own: Column) -> Column:
        blank = lambda x: _strip(x["line"]) == ""
        # The places where a passage starts: a line with words after a blank line, another level or nothing.
        starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: ~blank(own[i]) & ((i == 0) | blank(F.get(own, i - 1)) | (F.get(own, i - 1)["level"] != own[i]["level"])))

        def cut(at: Column) -> Column:
            def one(i: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(at, k + 1), F.size(own))
                part = F.slice(own, i + 1, stop - i)
                return F.struct(own[i]["level"].cast("int").alias("level"), F.array_join(F.transform(part, lambda x: x["line"]), "\n").alias("passage"))

            return F.transform(at, one)

        return let(starts, cut)

    return let(lines, grouped)


def _messages(chats: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One row per message with its own text, without quotes, and the hashes of its own and of its quoted passages."""
    own = chats.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), text_of(text_col).alias("body"))
    own = own.withColumn("p", passages(F.col("body")))
    of_level = lambda test: F.filter("p", lambda x: test(x["level"]))
    hashes = lambda found: F.array_distinct(F.transform(found, lambda x: F.struct(F.xxhash64(normalised(x["passage"])).alias("h1"), F.xxhash64(F.lit(1), normalised(x["passage"])).alias("h2"))))
    return own.select(
        "conv_id", "turn", "role",
        F.xxhash64("body").alias("mark"),
        F.array_join(F.transform(of_level(lambda n: n == 0), lambda x: _strip(x["passage"])), "\n\n").alias("content"),
        F.size(of_level(lambda n: n > 0)).cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("p", lambda x: x["level"])), F.lit(0)).cast("int").alias("quote_depth"),
        hashes(of_level(lambda n: n == 0)).alias("own"),
        F.transform(of_level(lambda n: n > 0), lambda x: F.struct(x["level"].alias("level"), F.xxhash64(normalised(x["passage"])).alias("h1"), F.xxhash64(F.lit(1), normalised(x["passage"])).alias("h2"))).alias("quoted"),
    )


def link_quotes(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every message with the message it replies to and its place in the reply order.

    Returns per row: conv_id, turn, role, content (the text without quotes), n_quotes, quote_depth, n_linked (quoted passages found in an earlier
    message of the conversation), parent_turn, reply_by ("quote", "order" or "start"), thread_turn and reply_depth.

    A quoted passage is linked to the latest earlier turn of the same conversation that has it as its own, unquoted passage. The parent
    is the source of the least nested linked quote, the latest among equals; without one it is the turn before, and a
    conversation's first turn has none. thread_turn and reply_depth lead to that start; ordering by (conv_id, thread_turn,
    reply_depth, parent_turn, turn) gives each conversation in reply order, level by level.

    Passages meet by conversation and hash in the order of turns, without pairs, so a passage that many turns of a conversation have
    and quote costs its rows alone. A null text is an empty message. Rows that share conversation and turn are one node: all are returned, with
    one parent. Null conversations or turns have no links and no parent. Other columns are dropped. An empty table gives none.
    """
    messages = stage(_messages(chats, conv_col, turn_col, role_col, text_col), "messages")
    own = messages.select("conv_id", "turn", F.explode("own").alias("h")).select("conv_id", F.col("turn").alias("source"), "h.h1", "h.h2").distinct()
    quoted = messages.select("conv_id", "turn", F.posexplode("quoted").alias("at", "q")).select("conv_id", "turn", "at", "q.level", "q.h1", "q.h2").distinct()
    hits = _latest_sources(quoted, own).groupBy("conv_id", "turn", "at", "level").agg(F.max("source").alias("source"))
    links = hits.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", (-F.col("source")).alias("back"))).alias("best"))
    links = stage(links.select("conv_id", "turn", "n_linked", (-F.col("best.back")).alias("quoted_turn")), "quote-links")

    nodes = messages.select("conv_id", "turn").where("conv_id is not null and turn is not null").distinct()
    nodes = stage(nodes, "message-nodes")
    before = _turn_before(nodes)
    up = nodes.join(before, ["conv_id", "turn"], "left").join(links, ["conv_id", "turn"], "left")
    up = stage(up.select("conv_id", "turn", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("quoted_turn", "before").alias("parent_turn"), F.when(F.col("quoted_turn").isNotNull(), "quote").when(F.col("before").isNotNull(), "order").otherwise("start").alias("reply_by")), "parents")
    placed = up.join(_depths(up), ["conv_id", "turn"])
    out = messages.join(placed, ["conv_id", "turn"], "left")
    return out.select(
        F.col("conv_id").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "content", "n_quotes", "quote_depth",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_turn", F.coalesce("reply_by", F.lit("start")).alias("reply_by"), F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("reply_depth", F.lit(0)).alias("reply_depth"),
    )


#: Turns of a conversation that one window holds; neighbours across two windows meet through the windows' ends.
TURNS = 4096


def _latest_sources(quoted: DataFrame, own: DataFrame) -> DataFrame:
    """(conv_id, turn, at, level, source) of the quotes that an earlier turn has as its own, over bounded spans of turns as in _turn_before."""
    from pyspark.sql import Window

    key = ["conv_id", "h1", "h2"]
    quoted = quoted.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    own = own.where("source IS NOT NULL").join(quoted.select(*key).distinct(), key, "left_semi")
    both = quoted.unionByName(own.withColumn("turn", F.col("source")), allowMissingColumns=True).withColumn("span", F.floor(F.col("turn") / TURNS))
    ends = both.groupBy(*key, "span").agg(F.max("source").alias("last"))
    earlier = F.max("last").over(Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*key, "span", earlier.alias("earlier"))
    inside = F.max("source").over(Window.partitionBy(*key, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    found = both.withColumn("inside", inside).where("at IS NOT NULL").join(ends, [*key, "span"])
    return found.select("conv_id", "turn", "at", "level", F.coalesce("inside", "earlier").alias("source")).where("source IS NOT NULL")


def _turn_before(nodes: DataFrame) -> DataFrame:
    """(conv_id, turn, before): the turn before each, over windows of bounded spans of turns, so that no conversation is one group."""
    from pyspark.sql import Window

    span = nodes.withColumn("span", F.floor(F.col("turn") / TURNS))
    inside = Window.partitionBy("conv_id", "span").orderBy("turn")
    ends = span.groupBy("conv_id", "span").agg(F.max("turn").alias("last"))
    ends = ends.withColumn("earlier", F.lag("last").over(Window.partitionBy("conv_id").orderBy("span"))).select("conv_id", "span", "earlier")
    found = span.withColumn("before", F.lag("turn").over(inside)).join(ends, ["conv_id", "span"])
    return found.select("conv_id", "turn", F.coalesce("before", "earlier").alias("before"))


def _depths(up: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, reply_depth) by doubling: each round the messages that have not reached their start jump over the pointer of the message they point to.

    Rounds grow with the logarithm of the longest chain, and each joins only what is still on its way.
    """
    starts = up.where("parent_turn IS NULL").select("conv_id", "turn", F.col("turn").alias("to"), F.lit(0).cast("long").alias("steps"))
    done, active = [stage(starts, "thread-starts")], stage(up.where("parent_turn IS NOT NULL").select("conv_id", "turn", F.col("parent_turn").alias("to"), F.lit(1).cast("long").alias("steps")), "jumps")
    while not active.isEmpty():
        ahead = reduce(DataFrame.unionByName, [*done, active]).select("conv_id", F.col("turn").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        moved = active.join(ahead, ["conv_id", "to"]).select("conv_id", "turn", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("on"))
        moved = stage(moved, "jumps")
        done.append(moved.where("NOT on").drop("on"))
        active = moved.where("on").drop("on")
    return reduce(DataFrame.unionByName, done).select("conv_id", "turn", F.col("to").alias("thread_turn"), F.col("steps").alias("reply_depth"))


def chat_lines(linked: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Each linked message rendered as a chat turn, with the columns that order a conversation's replies."""
    turn = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("content"), F.lit("\n"))
    return linked.select(F.col(conv_col), "thread_turn", "reply_depth", "parent_turn", "turn", turn.alias("chat"))
