"""Cell comparison of changed rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.canonical import canonical_name, column_text, display_columns
from driftloom.operators.rowdiff import ADDED, REMOVED, UPDATED, _on, aligned

_RANK = {UPDATED: 0, REMOVED: 1, ADDED: 2}


def status_rank(status: Column) -> Column:
    """Updated rows come first, then removed, then added ones."""
    return reduce(lambda c, s: c.when(status == s, _RANK[s]), _RANK, F).otherwise(len(_RANK))


def limit_per_table(diff: DataFrame, n: int, table: str = "table") -> DataFrame:
    """The first n rows of each table by status and key. Spark keeps n rows per group before the shuffle."""
    own = Window.partitionBy(table).orderBy(status_rank(F.col("status")), "row_key")
    return diff.withColumn("position", F.row_number().over(own)).where(F.col("position") <= n)


def limit_keys(diff: DataFrame, n: int = 100) -> DataFrame:
    """The first n keys of each table and status, as a report lists them."""
    own = Window.partitionBy("table", "status").orderBy("row_key")
    return diff.withColumn("position", F.row_number().over(own)).where(F.col("position") <= n)


def changed_rows(diff: DataFrame, prod: DataFrame, dev: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each differing row with the values of both sides, as structs prod and dev of the key and then the other columns by name: two joins on the key instead of two reads per row."""
    dev = aligned(dev, prod)
    k, p, d = diff.alias("k"), prod.alias("p"), dev.alias("d")
    both = k.join(p, _on("k", "p", key), "left").join(d, _on("k", "d", key), "left")
    value = lambda side, df: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in display_columns(df.columns, key)])
    return both.select(*[F.col(f"k.{c}") for c in diff.columns], value("p", prod).alias("prod"), value("d", dev).alias("dev"))


def cell_diff(diff: DataFrame, prod: DataFrame, dev: DataFrame, key: Sequence[str], ignored: Callable[[str], bool] = lambda name: False, only_differing: bool = False, doubles: str = "cast") -> DataFrame:
    """(row_key, status, column, prod_value, dev_value, differs), one row per cell of each differing row.

    Columns are matched by canonical name; a column of one side alone differs. Values are compared as texts, null equal to null alone.
    """
    dev = aligned(dev, prod)
    names = sorted({*prod.columns, *dev.columns}, key=canonical_name)
    names = [n for n in names if n in key or not ignored(n)]
    text = lambda df, c: column_text(df, c, doubles) if c in df.columns else F.lit(None).cast("string")
    p = prod.select(*key, F.struct(*[text(prod, c).alias(c) for c in names]).alias("prod")).alias("p")
    d = dev.select(*key, F.struct(*[text(dev, c).alias(c) for c in names]).alias("dev")).alias("d")
    k = diff.alias("k")
    both = k.join(p, _on("k", "p", key), "left").join(d, _on("k", "d", key), "left")

    def cell(c: str) -> Column:
        a, b = F.col("p.prod")[c], F.col("d.dev")[c]
        one_sided = (c in prod.columns) != (c in dev.columns)
        differs = F.lit(True) if one_sided else ~a.eqNullSafe(b)
        return F.struct(F.lit(c).alias("column"), a.alias("prod_value"), b.alias("dev_value"), differs.alias("differs"))

    long = both.select("k.row_key", "k.status", F.inline(F.array(*[cell(c) for c in names])))
    return long.where("differs") if only_differing else long


def differing_columns(cells: DataFrame) -> DataFrame:
    """(row_key, columns): the sorted names of the columns that differ in each row."""
    return cells.where("differs").groupBy("row_key").agg(F.array_sort(F.collect_set("column")).alias("columns"))


def nested_report(cells: DataFrame, table: str = "") -> DataFrame:
    """One row per differing row, with its cells as an array ordered by column: as wide as the table, no more. A column `table` of cells names it."""
    cells = cells if "table" in cells.columns else cells.withColumn("table", F.lit(table))
    cell = F.struct(F.lower("column").alias("o"), "column", "prod_value", "dev_value", "differs")
    rows = cells.groupBy("table", "row_key", "status").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.select("table", "row_key", "status", F.transform("cells", lambda x: F.struct(x["column"].alias("Column"), x["prod_value"].alias("ProdVal"), x["dev_value"].alias("DevVal"), x["differs"].alias("Differs"))).alias("columns"))


def key_detail(prod: DataFrame, dev: DataFrame, key: dict[str, object], **options) -> DataFrame:
    """All cells of one key, read from each side with the key pushed down and nothing hashed; equal rows are unchanged."""
    from driftloom.functions.canonical import row_key
    from driftloom.operators.rowdiff import row_lookup

    dev = aligned(dev, prod)
    names = list(key)
    p, d = row_lookup(prod, key), row_lookup(dev, key)
    keys = p.select(*names, row_key(p, names).alias("row_key")).unionByName(d.select(*names, row_key(d, names).alias("row_key"))).distinct()
    cells = cell_diff(keys.withColumn("status", F.lit("")), p, d, names, **options)
    any_diff = Window.partitionBy("row_key")
    return cells.withColumn("status", F.when(F.bool_or("differs").over(any_diff), UPDATED).otherwise("unchanged"))
