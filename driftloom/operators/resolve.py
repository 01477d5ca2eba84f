"""Conflict resolution by policy, as DataFrame plans over (table, row_key, prod_hash, dev_hash)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.sources.staging import scratch, stage

MANUAL, OURS, THEIRS = "manual", "ours", "theirs"
PENDING, KEEP_PROD, USE_DEV = "pending", "keep_prod", "use_dev"


def decision_of(strategy: Column) -> Column:
    """ours keeps prod, theirs takes dev, all else waits for a person."""
    return F.when(strategy == OURS, KEEP_PROD).when(strategy == THEIRS, USE_DEV).otherwise(PENDING)


def apply_strategies(conflicts: DataFrame, strategies: DataFrame | None = None, default: str = MANUAL) -> DataFrame:
    """conflicts with strategy, decision and resolved. strategies is (table, strategy[, ord]); of several for a table the first counts.

    It has a row per configured table; Spark broadcasts it where its size allows and shuffles otherwise.
    """
    if strategies is None:
        chosen = conflicts.withColumn("strategy", F.lit(default))
    else:
        order = F.col("ord") if "ord" in strategies.columns else F.lit(0)
        first = strategies.groupBy("table").agg(F.min_by("strategy", order).alias("own"))
        chosen = conflicts.join(first, "table", "left").withColumn("strategy", F.coalesce("own", F.lit(default))).drop("own")
    chosen = chosen.withColumn("strategy", F.when(F.col("strategy").isin(OURS, THEIRS), F.col("strategy")).otherwise(MANUAL))
    return chosen.withColumn("decision", decision_of(F.col("strategy"))).withColumn("resolved", F.col("decision") != PENDING)


def still_open(conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Conflicts without a resolved resolution."""
    return conflicts.join(resolutions.where("resolved").select("table", "row_key"), ["table", "row_key"], "left_anti")


def already_resolved(conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    return conflicts.join(resolutions.where("resolved").select("table", "row_key"), ["table", "row_key"], "left_semi")


def with_decisions(diff: DataFrame, resolutions: DataFrame) -> DataFrame:
    """diff with the decision of each updated row, null for others."""
    own = resolutions.select("table", "row_key", "decision")
    return diff.join(own, ["table", "row_key"], "left").withColumn("decision", F.when(F.col("status") == "updated", F.col("decision")))


def filter_diff(diff: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The differences that policy lets through: added and removed rows, and updated ones unless prod is kept or the decision is pending."""
    found = with_decisions(diff, resolutions)
    return found.where(~F.coalesce(F.col("decision").isin(KEEP_PROD, PENDING), F.lit(False))).drop("decision")


def excluded_counts(diff: DataFrame, resolutions: DataFrame) -> DataFrame:
    """How many updated rows policy holds back, by decision."""
    return with_decisions(diff, resolutions).where(F.col("decision").isin(KEEP_PROD, PENDING)).groupBy("decision").agg(F.count("*").alias("n"))


def merge_resolutions(saved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The current conflicts with their saved decisions: new ones are manual and pending, stale ones are gone, hashes are the current ones."""
    own = saved.select("table", "row_key", "strategy", "decision", "resolved", *[c for c in ("created_at",) if c in saved.columns])
    merged = conflicts.select("table", "row_key", "prod_hash", "dev_hash").join(own, ["table", "row_key"], "left")
    return merged.withColumns({"strategy": F.coalesce("strategy", F.lit(MANUAL)), "decision": F.coalesce("decision", F.lit(PENDING)), "resolved": F.coalesce("resolved", F.lit(False))})


def bulk_resolve(resolutions: DataFrame, strategy: str, table: str | None = None) -> DataFrame:
    """The open resolutions of a table, or of all, decided by one strategy; resolved ones stay."""
    due = ~F.col("resolved")
    if table is not None:
        due &= F.col("table") == table
    decision = {OURS: KEEP_PROD, THEIRS: USE_DEV}.get(strategy, PENDING)
    return resolutions.withColumns({"strategy": F.when(due, strategy).otherwise(F.col("strategy")), "decision": F.when(due, decision).otherwise(F.col("decision")), "resolved": F.when(due, decision != PENDING).otherwise(F.col("resolved"))})


def set_decision(resolutions: DataFrame, table: str, row_key: str, decision: str) -> DataFrame:
    """One decision changed; resolved follows it. A key that is not there changes nothing."""
    here = (F.col("table") == table) & (F.col("row_key") == row_key)
    return resolutions.withColumns({"decision": F.when(here, decision).otherwise(F.col("decision")), "resolved": F.when(here, decision != PENDING).otherwise(F.col("resolved"))})


def count_by(resolutions: DataFrame, column: str) -> DataFrame:
    return resolutions.groupBy(column).agg(F.count("*").alias("n"))


def summary(resolutions: DataFrame) -> DataFrame:
    """Counts by strategy, by decision, by table and in all: rows are counted once by all three, and those few counts added up four ways."""
    counted = resolutions.groupBy("strategy", "decision", "table").agg(F.count("*").alias("n"), F.count_if("resolved").alias("done"))
    sets = counted.groupingSets([[F.col("strategy")], [F.col("decision")], [F.col("table")], []], F.col("strategy"), F.col("decision"), F.col("table"))
    return sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("done"), F.lit(0)).alias("n_resolved"))


def breakdown(resolutions: DataFrame) -> DataFrame:
    """Per table: its strategy, and how many rows were decided which way."""
    count = lambda d: F.count_if(F.col("decision") == d).alias(d)
    return resolutions.groupBy("table").agg(F.min_by("strategy", "row_key").alias("strategy"), count(KEEP_PROD), count(USE_DEV), count(PENDING), F.count("*").alias("total"))


def table_order(resolutions: DataFrame, order: str = "ord") -> DataFrame:
    """Tables in the order in which they first appear."""
    return resolutions.groupBy("table").agg(F.min(order).alias("first"))


def numbered(rows: DataFrame, group: str, order: str, name: str = "position") -> DataFrame:
    """rows with their number within their group, from 1 in the given order, in a column of that name.

    A group may hold all rows: they are dealt to tasks by ranges of (group, order), sorted and counted there, and a range's numbers begin after those of
    the ranges before it. The only window goes over one row per group and range. Ranges come from a sample of rows that are staged for it.
    """
    at, low, n, part, of = (f"_{name}_{x}" for x in ("at", "low", "n", "part", "of"))
    with scratch(rows.sparkSession):
        dealt = stage(rows, "unnumbered").repartitionByRange(group, order).sortWithinPartitions(group, order).withColumn(at, F.monotonically_increasing_id())
        dealt = stage(dealt, "numbered", lasting=True)
        ranges = dealt.groupBy(F.col(group).alias(of), F.shiftrightunsigned(at, 33).alias(part)).agg(F.count("*").alias(n), F.min(at).alias(low))
        ranges = stage(ranges, "number-ranges", lasting=True)
    before = F.sum(n).over(Window.partitionBy(of).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select(of, part, (F.col(low) - F.coalesce(before, F.lit(0))).alias(low))
    met = dealt.join(starts, F.col(group).eqNullSafe(F.col(of)) & (F.shiftrightunsigned(at, 33) == F.col(part)))
    return met.select(*rows.columns, (F.col(at) - F.col(low) + 1).alias(name))


def pending_position(resolutions: DataFrame, order: str = "row_key") -> DataFrame:
    """Open resolutions numbered within their table, as a person is led through them."""
    return numbered(resolutions.where(~F.col("resolved")), "table", order)


def pending_running(resolutions: DataFrame, order: str = "row_key") -> DataFrame:
    """Open resolutions with their position in one running order over all tables: that within the table after the pending ones of the tables before it.

    The tables' counts, one row each, are all that a window without groups sees.
    """
    own = pending_position(resolutions, order)
    before = F.sum("n").over(Window.orderBy("table").rowsBetween(Window.unboundedPreceding, -1))
    base = own.groupBy("table").agg(F.count("*").alias("n")).select("table", F.coalesce(before, F.lit(0)).alias("base"))
    return own.join(base, "table").withColumn("running", F.col("base") + F.col("position")).drop("base")


def group_by_table(resolutions: DataFrame, digits: int = 2) -> DataFrame:
    """(table, page, n, resolutions): each table's resolutions as arrays sorted by key, in pages named by so many hexadecimal digits of the key's hash, so that no table is one array."""
    page = F.substring(F.md5(F.coalesce("row_key", F.lit(""))), 1, digits)
    one = F.struct("row_key", "prod_hash", "dev_hash", "strategy", "decision", "resolved")
    return resolutions.groupBy("table", page.alias("page")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("resolutions"))


def conflict_items(conflicts: DataFrame, resolutions: DataFrame, cells: DataFrame) -> DataFrame:
    """conflicts as a report shows them: with strategy and decision, manual and pending where none is saved, and the names of the columns that differ.

    resolutions and cells are matched by row key and table, tables by their canonical name where the spelling differs. Two left joins on narrow keys.
    """
    own = F.lower(F.trim("table"))
    decided = resolutions.select(own.alias("t"), "row_key", "strategy", "decision").dropDuplicates(["t", "row_key"])
    differing = cells.where("differs").groupBy(own.alias("t"), "row_key").agg(F.array_sort(F.collect_set("column")).alias("columns"))
    found = conflicts.withColumn("t", own).join(decided, ["t", "row_key"], "left").join(differing, ["t", "row_key"], "left")
    return found.select("table", "row_key", "prod_hash", "dev_hash", F.coalesce("strategy", F.lit(MANUAL)).alias("strategy"), F.coalesce("decision", F.lit(PENDING)).alias("decision"), F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))
