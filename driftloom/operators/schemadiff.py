"""Schema comparison over catalog tables: one row per column, index, foreign key or other object, full-joined on its name.

Every function takes the prod and the dev catalog rows and returns long-form drift: the object's name, what happened to it
(added, removed, modified) and, for modified ones, which attributes differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.canonical import canonical, normal_action, normal_default, normal_definition, normal_type


def object_diff(prod: DataFrame, dev: DataFrame, name: Sequence[str], attributes: dict[str, object], case_insensitive: bool = False) -> DataFrame:
    """(name columns, change, attributes): objects matched by name; attributes maps each compared column to its normal form, a function or None."""
    norm = canonical if case_insensitive else (lambda c: c)
    keep = [*name, *attributes]
    p, d = prod.select(*keep, F.lit(1).alias("here")).alias("p"), dev.select(*keep, F.lit(1).alias("here")).alias("d")
    on = reduce(and_, [norm(F.col(f"p.{n}")) == norm(F.col(f"d.{n}")) for n in name])

    def differs(c: str, form) -> Column:
        a, b = F.col(f"p.{c}"), F.col(f"d.{c}")
        return F.when(~(form(a).eqNullSafe(form(b)) if form else a.eqNullSafe(b)), F.lit(c))

    listed = F.array_compact(F.array(*[differs(c, form) for c, form in attributes.items()])) if attributes else F.array().cast("array<string>")
    added, removed = F.col("p.here").isNull(), F.col("d.here").isNull()
    joined = p.join(d, on, "full_outer")
    found = joined.select(*[F.coalesce(f"p.{n}", f"d.{n}").alias(n) for n in name], F.when(added, "added").when(removed, "removed").otherwise("modified").alias("change"), F.when(added | removed, F.array().cast("array<string>")).otherwise(listed).alias("attributes"))
    return found.where((F.col("change") != "modified") | (F.size("attributes") > 0))


def diff_columns(prod: DataFrame, dev: DataFrame) -> DataFrame:
    """Columns of tables that both sides have: type without case, nullability, default without quotes (none differs from any)."""
    both = prod.select("table").distinct().join(dev.select("table").distinct(), "table")
    own = lambda side: side.join(both, "table", "left_semi")
    return object_diff(own(prod), own(dev), ["table", "column"], {"data_type": normal_type, "is_nullable": None, "default_value": normal_default})


def diff_tables(prod: DataFrame, dev: DataFrame) -> DataFrame:
    return object_diff(prod.select("table").distinct(), dev.select("table").distinct(), ["table"], {})


def primary_keys(columns: DataFrame) -> DataFrame:
    """(table, columns): each table's key columns in their order."""
    own = columns.where("pk_ordinal IS NOT NULL").groupBy("table").agg(F.array_sort(F.collect_list(F.struct("pk_ordinal", "column"))).alias("k"))
    return own.select("table", F.transform("k", lambda x: x["column"]).alias("columns"))


def diff_primary_keys(prod: DataFrame, dev: DataFrame) -> DataFrame:
    """Keys compared as ordered lists."""
    return object_diff(primary_keys(prod), primary_keys(dev), ["table"], {"columns": None})


def diff_indexes(prod: DataFrame, dev: DataFrame) -> DataFrame:
    return object_diff(prod, dev, ["table", "name"], {"columns": None, "is_unique": None})


def diff_foreign_keys(prod: DataFrame, dev: DataFrame) -> DataFrame:
    return object_diff(prod, dev, ["table", "name"], {"columns": None, "ref_table": None, "ref_columns": None, "on_delete": normal_action, "on_update": normal_action})


def diff_views(prod: DataFrame, dev: DataFrame) -> DataFrame:
    return object_diff(prod, dev, ["name"], {"definition": normal_definition, "is_materialized": None})


def diff_routines(prod: DataFrame, dev: DataFrame) -> DataFrame:
    return object_diff(prod, dev, ["name"], {"kind": F.lower, "language": F.lower, "return_type": F.lower, "definition": normal_definition, "parameters": None})


def diff_triggers(prod: DataFrame, dev: DataFrame) -> DataFrame:
    return object_diff(prod, dev, ["name"], {"table": None, "event": F.lower, "timing": F.lower, "definition": normal_definition})


def diff_sequences(prod: DataFrame, dev: DataFrame) -> DataFrame:
    return object_diff(prod, dev, ["name"], {c: None for c in ("start_value", "increment", "min_value", "max_value", "is_cyclic", "cache_size")})


def has_drift(*diffs: DataFrame) -> bool:
    return any(not d.isEmpty() for d in diffs)


def drift_flags(diffs: dict[str, DataFrame]) -> DataFrame:
    """(kind, drift): whether each kind of object differs at all; one row of a difference is enough to tell."""
    return reduce(DataFrame.unionByName, [d.limit(1).agg((F.count("*") > 0).alias("drift")).select(F.lit(kind).alias("kind"), "drift") for kind, d in diffs.items()])


def drift_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"))


def fold_columns(rows: DataFrame, group: Sequence[str], order: str = "ordinal", column: str = "column") -> DataFrame:
    """Catalog rows of one column each, folded to ordered arrays per object, as indexes and foreign keys are kept."""
    folded = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, column))).alias("_members"))
    return folded.select(*group, F.transform("_members", lambda x: x[column]).alias("columns"))
