"""Mixing sources to target weights by temperature, realised as budgeted block permutations. Built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import BROADCAST_BYTES, WORD, maybe_broadcast, scratch, small, stage, text_of

#: Target entropy of the weights, as a share of the entropy of equal weights.
ENTROPY_SHARE = 0.95
#: No source may be repeated more often than this.
MAX_REPEATS = 4.0
#: Halvings of the exponent's interval.
STEPS = 20
#: Documents in a block of a permutation, about.
BLOCK_DOCS = 2_000
SEED = "mix"
ADDED = ("mix_tokens", "mix_weight", "mix_block", "mix_epoch")


def word_tokens(text_col: str = "text") -> Column:
    """Words of the text plus one for its end, the default measure of tokens."""
    return (F.regexp_count(text_of(text_col), F.lit(WORD)) + 1).cast("long")


def source_shares(docs: DataFrame, source_col: str, tokens: Column) -> DataFrame:
    """(source, docs, tokens), staged; one row per source, summed before and after the shuffle."""
    return stage(docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("docs"), F.sum(tokens).alias("tokens")), "source-tokens")


def _measure(shares: DataFrame, total: int, exponent: float) -> tuple[float, float, float]:
    """For weights proportional to share ** exponent: the sum of the powers, the weights' entropy, and the largest weight per token."""
    share = F.col("tokens") / F.lit(total)
    power = F.pow(share, F.lit(exponent))
    s, t, most = shares.agg(F.sum(power), F.sum(power * F.log(share)), F.max(power / F.col("tokens"))).first()
    return s, math.log(s) - exponent * t / s, most / s


def bisect_exponent(shares: DataFrame, total: int, budget: float, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, steps: int = STEPS) -> float:
    """The exponent in [0, 1], by so many halvings.

    Entropy and the largest repetition (budget * weight / tokens) both fall as the exponent rises to 1, where the weights
    are the shares. The largest exponent that reaches the target entropy is taken; if its weights repeat a source more than
    max_repeats times, the least exponent that does not (1 where even the shares do). Each halving is one small aggregate on the executors; three
    numbers reach the driver.
    """

    def halve(low_side) -> tuple[float, float]:
        low, high = 0.0, 1.0
        for _ in range(steps):
            middle = (low + high) / 2
            low, high = (middle, high) if low_side(_measure(shares, total, middle)) else (low, middle)
        return low, high

    n = shares.count()
    if n < 2:
        return 1.0
    target = entropy_share * math.log(n)
    found = 1.0 if _measure(shares, total, 1.0)[1] >= target else halve(lambda m: m[1] >= target)[0]
    if budget * _measure(shares, total, found)[2] > max_repeats:
        found = halve(lambda m: budget * m[2] > max_repeats)[1]
    return found


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens: Column | None = None, budget_share: float = 1.0, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, block_docs: int = BLOCK_DOCS, seed: str = SEED, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs, drawn so that sources hold their weights of a budget of budget_share times all tokens; mix_tokens, mix_weight, mix_block and mix_epoch are added.

    A source of t tokens and weight w is repeated r = budget * w / t times: every document floor(r) times, epochs 1.., and
    once more the first documents of a permutation while the rest of the budget lasts. The permutation orders by a hash of seed and
    id and runs within blocks: a source is dealt by hash into blocks of about block_docs documents, and each block meets its
    own part of the rest. So a source with a third of all rows is many windows of bounded size, over three narrow columns; they leave a
    cut-off per block. While those fit in broadcast_bytes they are broadcast and the texts are not shuffled; beyond that the texts meet their draws, which are
    the same, once by the hash. A document
    belongs to the partial epoch if the tokens before it in its block and half its own lie below the block's part.

    A null source is a source of its own; a null text is one token. Rows that share an id are drawn alike. Columns of docs
    pass through, except earlier ones of the four added names. An empty table gives an empty result.
    """
    docs = docs.drop(*ADDED)
    tokens = word_tokens(text_col) if tokens is None else tokens
    with scratch(docs.sparkSession):
        narrow = docs.select(F.col(source_col).alias("source"), _order(F.col(id_col), seed).alias("order"), tokens.alias("tokens"))
        narrow = stage(narrow, "mix-rows")
        shares = source_shares(narrow, "source", F.col("tokens"))
        total = shares.agg(F.sum("tokens")).first()[0] or 0
        if not total:
            return docs.limit(0).withColumns({"mix_tokens": F.lit(0).cast("long"), "mix_weight": F.lit(0.0), "mix_block": F.lit(0).cast("long"), "mix_epoch": F.lit(0)})
        budget = budget_share * total
        exponent = bisect_exponent(shares, total, budget, entropy_share, max_repeats)
        powers = _measure(shares, total, exponent)[0]
        weight = F.pow(F.col("tokens") / F.lit(total), F.lit(exponent)) / F.lit(powers)
        plan = shares.select("source", weight.alias("weight"), F.ceil(F.col("docs") / block_docs).alias("blocks"), (F.lit(budget) * weight / F.col("tokens")).alias("repeats"))
        plan = stage(plan, "mix-plan", lasting=True)

        placed = narrow.join(maybe_broadcast(plan, 64, broadcast_bytes).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        placed = placed.withColumn("block", _block(F.col("order"), F.col("blocks")))
        own = Window.partitionBy("source", "block")
        part = (F.col("repeats") - F.floor("repeats")) * F.sum("tokens").over(own)
        before = F.coalesce(F.sum("tokens").over(own.orderBy("order", "tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = placed.withColumn("in", before + F.col("tokens") / 2 < part).groupBy("source", "block").agg(F.max(F.when(F.col("in"), F.col("order"))).alias("last"), F.first("weight").alias("weight"), F.first("repeats").alias("repeats"), F.first("blocks").alias("blocks"))
        cut = stage(cut, "mix-cuts", lasting=True)
        few = small(plan, 64, broadcast_bytes) and small(cut, 128, broadcast_bytes)
        if not few:  # draws are made on narrow rows, which then meet the texts by their place in the permutation, a key that no source makes hot
            of = cut.select(F.col("source").alias("s2"), F.col("block").alias("b2"), "last")
            made = placed.join(of, F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
            drawn = stage(made.select("source", "order", "block", "weight", _times(F.col("repeats"), F.col("order"), F.col("last")).alias("times")).distinct(), "mix-drawn", lasting=True)

    names = {c.lower() for c in docs.columns}
    free = lambda name: name if name not in names else free(name + "_")
    s, b, o, n = (free(f"mix_{x}_") for x in ("s", "b", "o", "n"))
    sized = docs.withColumn("mix_tokens", tokens).withColumn(o, _order(F.col(id_col), seed))
    if few:
        sources = F.broadcast(plan.select(F.col("source").alias(s), F.col("blocks").alias(n)))
        rows = sized.join(sources, F.col(source_col).eqNullSafe(F.col(s)))
        rows = rows.withColumn("mix_block", _block(F.col(o), F.col(n))).drop(s, n)
        cuts = F.broadcast(cut.select(F.col("source").alias(s), F.col("block").alias(b), F.col("last").alias("mix_last_"), F.col("weight").alias("mix_weight"), F.col("repeats").alias("mix_repeats_")))
        rows = rows.join(cuts, F.col(source_col).eqNullSafe(F.col(s)) & (F.col("mix_block") == F.col(b)))
        times = _times(F.col("mix_repeats_"), F.col(o), F.col("mix_last_"))
    else:
        rows = sized.join(drawn.toDF(s, b, "mix_block", "mix_weight", n), (F.col(o) == F.col(b)) & F.col(source_col).eqNullSafe(F.col(s)))
        times = F.col(n)
    rows = rows.withColumn("mix_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(1), times))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *ADDED)


def _order(row_id: Column, seed: str) -> Column:
    """Where a row stands in its permutation: 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(row_id.cast("string"), F.lit(""))))


def _times(repeats: Column, order: Column, last: Column) -> Column:
    """How often a row is drawn: its source's whole repeats, and once more up to its block's cut-off."""
    return F.floor(repeats).cast("int") + F.when(order <= last, 1).otherwise(0)


def _block(order: Column, blocks: Column) -> Column:
    return F.pmod(F.conv(F.substring(order, 25, 8), 16, 10).cast("long"), blocks.cast("long"))
