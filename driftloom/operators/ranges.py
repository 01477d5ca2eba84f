"""Row comparison by a tree of digests over key ranges: rows are joined only where the digests of their ranges differ."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.canonical import ordered_columns, row_text
from driftloom.operators.rowdiff import aligned, row_diff
from driftloom.sources.staging import stage

#: Keys, or parts of the hash space, in a range of each level, from the root's children down.
WIDTHS = (1 << 20, 1 << 13, 1 << 6)
#: Runs of ranges up to which a scan gets them as bounds that it can skip files and row groups by; more are joined.
RUNS = 200


def by_value(df: DataFrame, key: Sequence[str]) -> bool:
    """Whether ranges are of the key's values: an integer key of one column. Others are dealt by a hash of their text."""
    return len(key) == 1 and isinstance(df.schema[key[0]].dataType, T.IntegralType)


def place(df: DataFrame, key: Sequence[str], values: bool) -> Column:
    """Where a row stands on the line that ranges cut."""
    if values:
        return F.col(f"`{key[0]}`").cast("long")
    return F.shiftright(F.xxhash64(*[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in key]), 20)


def _range(at: Column, width: int) -> Column:
    return F.floor(at / F.lit(float(width))) if width & (width - 1) else F.shiftright(at, width.bit_length() - 1)


def range_digests(df: DataFrame, key: Sequence[str], columns: Sequence[str], at: Column, width: int, mode: str = "compat", doubles: str = "cast") -> DataFrame:
    """(range, n, one, two): the number of rows of each range and 128 bits over their texts, in any order. Where keys lie together in files, tasks send one row per range."""
    text = row_text(df, columns, mode, doubles)
    rows = df.select(_range(at, width).alias("range"), text.alias("text")).select("range", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    return rows.groupBy("range").agg(F.count("*").alias("n"), F.bit_xor("h1").alias("one"), F.bit_xor("h2").alias("two"))


def within(df: DataFrame, at: Column, open_: DataFrame, width: int) -> DataFrame:
    """The rows of df that fall in the open ranges (range) of that width."""
    known = open_.where("range IS NOT NULL")
    edges = known.join(known.select((F.col("range") + 1).alias("range")), "range", "left_anti").select("range").limit(RUNS + 1).collect()
    if len(edges) <= RUNS and open_.where("range IS NULL").isEmpty():
        lows = sorted(r[0] for r in edges)
        ends = known.join(known.select((F.col("range") - 1).alias("range")), "range", "left_anti").select("range").limit(RUNS + 1).collect()
        runs = zip(lows, sorted(r[0] for r in ends), strict=True)
        return df.where(reduce(or_, [at.between(a * width, (b + 1) * width - 1) for a, b in runs], F.lit(False)))
    own = df.withColumn("_range", _range(at, width))
    return own.join(open_.select(F.col("range").alias("_open")), F.col("_range").eqNullSafe(F.col("_open")), "left_semi").drop("_range")


def differing_rows(prod: DataFrame, dev: DataFrame, key: Sequence[str], ignored: Callable[[str], bool] = lambda name: False, widths: Sequence[int] = WIDTHS, mode: str = "compat", doubles: str = "cast") -> tuple[DataFrame, DataFrame]:
    """The rows of both sides that lie in key ranges whose digests differ, found level by level from wide ranges to narrow ones.

    A level reads only what the level above left open: few runs of ranges go to the scan as bounds of the key. With changes in a few places the
    first level reads both tables once and the others next to nothing. Equal digests are taken for equal ranges.
    """
    dev = aligned(dev, prod)
    values = by_value(prod, key) and by_value(dev, key)
    sides = [(df, place(df, key, values), ordered_columns(df.columns, key, ignored)) for df in (prod, dev)]
    if [c.lower() for c in sides[0][2]] != [c.lower() for c in sides[1][2]]:
        return prod, dev  # a column of one side alone changes every row
    left = [df for df, _, _ in sides]
    for width in widths:
        p, d = (range_digests(df, key, columns, at, width, mode, doubles) for df, (_, at, columns) in zip(left, sides, strict=True))
        same = reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"d.{c}")) for c in ("n", "one", "two")])
        both = p.alias("p").join(d.alias("d"), F.col("p.range").eqNullSafe(F.col("d.range")), "full_outer").where(~same)
        open_ = stage(both.select(F.coalesce("p.range", "d.range").alias("range")), "open-ranges")
        left = [within(df, at, open_, width) for df, at, _ in sides]
    return left[0], left[1]


def row_diff_by_ranges(prod: DataFrame, dev: DataFrame, key: Sequence[str], status: str = "all", ignored: Callable[[str], bool] = lambda name: False, widths: Sequence[int] = WIDTHS, mode: str = "compat", doubles: str = "cast") -> DataFrame:
    """The rows of row_diff, of tables that mostly agree: what is hashed in full, shuffled and joined are the ranges that differ."""
    p, d = differing_rows(prod, dev, key, ignored, widths, mode, doubles)
    return row_diff(p, d, key, status, ignored, mode=mode, doubles=doubles)
