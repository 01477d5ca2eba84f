"""The registered queries over the given tables, with the SQL that must give the same rows.

The dev side of each table is derived in both languages by the same rule: rows whose key is divisible by 10 are gone, those
whose key is divisible by 7 have one column changed, and rows whose key is divisible by 13 come again under a key raised by 10**9.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions import canonical
from driftloom.functions.ignore import column_ignorer
from driftloom.operators import celldiff, copartitioned, patch, ranges, resolve, rowdiff
from driftloom.plans import history
from driftloom.plans.dialects import Dialect
from driftloom.sources.staging import stage, staged_path
from driftloom.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RAISE = 1_000_000_000


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


@dataclass(frozen=True)
class Spec:
    """A table whose dev side is derived: its integer key and the text column that changes."""

    table: str
    key: str
    change: str
    others: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return [self.key, *sorted((self.change, *self.others))]

    def prod(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{self.table}.parquet")

    def dev(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df, key = self.prod(spark, sf_dir), F.col(self.key)
        stay = df.where(key % 10 != 0).withColumn(self.change, F.when(key % 7 == 0, F.concat(F.col(self.change), F.lit("*"))).otherwise(F.col(self.change)))
        return stay.unionByName(df.where(key % 13 == 0).withColumn(self.key, (key + RAISE).cast(df.schema[self.key].dataType)))

    def sides(self, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
        return self.prod(spark, sf_dir), self.dev(spark, sf_dir), [self.key]

    def dev_sql(self) -> str:
        k, others = self.key, ", ".join(self.others)
        return f"(SELECT {k}, CASE WHEN {k} % 7 = 0 THEN {self.change} || '*' ELSE {self.change} END AS {self.change}, {others} FROM {self.table} WHERE {k} % 10 <> 0 UNION ALL SELECT {k} + {RAISE}, {self.change}, {others} FROM {self.table} WHERE {k} % 13 = 0)"

    def diff_sql(self, columns: list[str] | None = None, where: str = "") -> str:
        """The row differences, all statuses."""
        return diff_sql([self.key], f"(SELECT * FROM {self.table})", self.dev_sql(), columns or self.columns, where)


def hash_sql(columns: list[str]) -> str:
    return "sha256(" + " || ".join(f"'{c}=' || coalesce(CAST({c} AS VARCHAR), '<nil>') || chr(10)" for c in columns) + ")"


def key_sql(key: list[str], of: str = "") -> str:
    return " || '|' || ".join(f"coalesce(CAST({of}{k} AS VARCHAR), '<nil>')" for k in key)


def diff_sql(key: list[str], prod: str, dev: str, columns: list[str], where: str = "", dev_columns: list[str] | None = None) -> str:
    keys = ", ".join(f"coalesce(p.{k}, d.{k}) AS {k}" for k in key)
    on = " AND ".join(f"p.{k} = d.{k}" for k in key)
    row_key = " || '|' || ".join(f"CAST(coalesce(p.{k}, d.{k}) AS VARCHAR)" for k in key)
    names = ", ".join(key)
    return f"""SELECT * FROM (SELECT {keys}, {row_key} AS row_key, CASE WHEN p.h IS NULL THEN 'added' WHEN d.h IS NULL THEN 'removed' ELSE 'updated' END AS status, p.h AS prod_hash, d.h AS dev_hash
      FROM (SELECT {names}, {hash_sql(columns)} AS h FROM {prod}) AS p FULL JOIN (SELECT {names}, {hash_sql(dev_columns or columns)} AS h FROM {dev}) AS d ON {on} WHERE p.h IS DISTINCT FROM d.h) {where}"""


CUSTOMER = Spec("customer", "c_custkey", "c_name", ("c_acctbal", "c_mktsegment", "c_nationkey"))
ORDERS = Spec("orders", "o_orderkey", "o_orderstatus", ("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice"))
SUPPLIER = Spec("supplier", "s_suppkey", "s_name", ("s_acctbal", "s_nationkey"))
PART = Spec("part", "p_partkey", "p_name", ("p_brand", "p_retailprice", "p_size", "p_type"))
NATION = Spec("nation", "n_nationkey", "n_name", ("n_regionkey",))
ALL = (CUSTOMER, ORDERS, SUPPLIER, PART, NATION)
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
LINE_COLUMNS = [*LINE_KEY, "l_discount", "l_linestatus", "l_quantity", "l_returnflag", "l_shipdate", "l_tax"]

# --- rows


@query(f"SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS row_key, {hash_sql(CUSTOMER.columns)} AS row_hash FROM customer")
def row_hash_customer(spark, d):
    return rowdiff.hashed(CUSTOMER.prod(spark, d), ["c_custkey"])


@query(f"SELECT conv_id, turn, {key_sql(['conv_id', 'turn'])} AS row_key, {hash_sql(['conv_id', 'turn', 'role', 'text'])} AS row_hash FROM conversations")
def row_key_composite(spark, d):
    return rowdiff.hashed(spark.read.parquet(f"{d}/conversations.parquet"), ["conv_id", "turn"])


@query("SELECT c_custkey, sha256(" + " || ".join(f"'{c}=' || coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-1:') || chr(10)" for c in CUSTOMER.columns) + ") AS row_hash FROM customer")
def row_hash_safe(spark, d):
    return rowdiff.hashed(CUSTOMER.prod(spark, d), ["c_custkey"], mode="safe").drop("row_key")


@query(CUSTOMER.diff_sql())
def row_diff_all(spark, d):
    return rowdiff.row_diff(*CUSTOMER.sides(spark, d))


@query(CUSTOMER.diff_sql())
def row_diff_by_ranges(spark, d):
    """The same rows by digests of key ranges."""
    return ranges.row_diff_by_ranges(*CUSTOMER.sides(spark, d))


@query(CUSTOMER.diff_sql())
def row_diff_copartitioned(spark, d):
    """The same rows from digests kept in buckets by key: the join shuffles nothing."""
    prod, dev, key = CUSTOMER.sides(spark, d)
    names = [f"driftloom_kept_{uuid.uuid4().hex}" for _ in range(2)]
    for name, df in zip(names, (prod, dev), strict=True):
        copartitioned.keep_digests(df, key, name, staged_path(spark, name, lasting=True), 8)
    return copartitioned.diff_kept(spark, *names, key)


_FEW = f"(SELECT o_orderkey, CASE WHEN o_orderkey % 4001 = 7 THEN o_orderstatus || '*' ELSE o_orderstatus END AS o_orderstatus, {', '.join(ORDERS.others)} FROM orders WHERE o_orderkey % 5003 <> 0)"


@query(diff_sql(["o_orderkey"], "(SELECT * FROM orders)", _FEW, ORDERS.columns))
def row_diff_few_changes(spark, d):
    """A table of which one row in some thousands differs: only the key ranges around those are joined."""
    prod, k = ORDERS.prod(spark, d), F.col("o_orderkey")
    dev = prod.where(k % 5003 != 0).withColumn("o_orderstatus", F.when(k % 4001 == 7, F.concat("o_orderstatus", F.lit("*"))).otherwise(F.col("o_orderstatus")))
    return ranges.row_diff_by_ranges(prod, dev, ["o_orderkey"])


@query(CUSTOMER.diff_sql())
def row_diff_resumable(spark, d):
    """The same rows by steps that a run cut off need not repeat: both sides' digests dealt to key ranges, then each range."""
    from driftloom.plans.resume import Manifest, run_ranges

    prod, dev, key = CUSTOMER.sides(spark, d)
    manifest = Manifest(staged_path(spark, "resumable", lasting=True), "one run")
    return run_ranges(spark, manifest, {"customer": (*rowdiff.digests(prod, dev, key), key, "all")}, {"customer": 4})["customer"]


@query(ORDERS.diff_sql(where="WHERE status = 'added'"))
def row_diff_added(spark, d):
    return rowdiff.row_diff(*ORDERS.sides(spark, d), status="added")


@query(SUPPLIER.diff_sql(where="WHERE status = 'removed'"))
def row_diff_removed(spark, d):
    return rowdiff.row_diff(*SUPPLIER.sides(spark, d), status="removed")


@query(ORDERS.diff_sql(where="WHERE status = 'updated'"))
def row_diff_updated(spark, d):
    return rowdiff.row_diff(*ORDERS.sides(spark, d), status="updated")


def _conflicts_sql(specs=(ORDERS,)) -> str:
    return " UNION ALL ".join(f"SELECT '{s.table}' AS \"table\", row_key, prod_hash, dev_hash FROM ({s.diff_sql()}) WHERE status = 'updated'" for s in specs)


def _conflicts(spark, d, specs=(ORDERS,)) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, [rowdiff.conflicts(*s.sides(spark, d), s.table) for s in specs])


@query(_conflicts_sql())
def conflicts(spark, d):
    return _conflicts(spark, d)


@query(diff_sql(["conv_id", "turn"], "conversations", "(SELECT conv_id, turn, role, CASE WHEN conv_id % 7 = 0 THEN text || '*' ELSE text END AS text FROM conversations WHERE NOT (conv_id % 10 = 0 AND turn = 0))", ["conv_id", "turn", "role", "text"]))
def row_diff_composite_pk(spark, d):
    prod = spark.read.parquet(f"{d}/conversations.parquet")
    dev = prod.where(~((F.col("conv_id") % 10 == 0) & (F.col("turn") == 0))).withColumn("text", F.when(F.col("conv_id") % 7 == 0, F.concat("text", F.lit("*"))).otherwise(F.col("text")))
    return rowdiff.row_diff(prod, dev, ["conv_id", "turn"])


@query(diff_sql(LINE_KEY, "lineitem", "(SELECT * REPLACE (CASE WHEN l_orderkey % 7 = 0 THEN l_returnflag || '*' ELSE l_returnflag END AS l_returnflag) FROM lineitem WHERE l_orderkey % 10 <> 0)", LINE_COLUMNS))
def row_diff_lineitem(spark, d):
    prod = spark.read.parquet(f"{d}/lineitem.parquet")
    dev = prod.where(F.col("l_orderkey") % 10 != 0).withColumn("l_returnflag", F.when(F.col("l_orderkey") % 7 == 0, F.concat("l_returnflag", F.lit("*"))).otherwise(F.col("l_returnflag")))
    return rowdiff.row_diff(prod, dev, LINE_KEY)


@query(PART.diff_sql(["p_partkey", "p_brand", "p_retailprice", "p_size", "p_type"]))
def row_diff_ignore_columns(spark, d):
    ignored = column_ignorer(["part.p_na*"])
    return rowdiff.row_diff(*PART.sides(spark, d), ignored=lambda c: ignored("part", c))


_EXTRA = f"(SELECT *, c_nationkey * 2 AS c_extra FROM {CUSTOMER.dev_sql()})"


@query(diff_sql(["c_custkey"], "customer", _EXTRA, CUSTOMER.columns, dev_columns=["c_custkey", "c_acctbal", "c_extra", "c_mktsegment", "c_name", "c_nationkey"]))
def row_diff_schema_drift_all(spark, d):
    p, dev, k = CUSTOMER.sides(spark, d)
    return rowdiff.row_diff(p, dev.withColumn("c_extra", F.col("c_nationkey") * 2), k)


@query(CUSTOMER.diff_sql())
def row_diff_intersection(spark, d):
    p, dev, k = CUSTOMER.sides(spark, d)
    return rowdiff.row_diff(p, dev.withColumn("C_EXTRA", F.col("c_nationkey") * 2), k, on_drift="intersect")


@query(diff_sql(["o_orderkey"], "orders", "(SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM orders)", ORDERS.columns))
def row_diff_null_values(spark, d):
    prod = ORDERS.prod(spark, d)
    return rowdiff.row_diff(prod, prod.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))), ["o_orderkey"])


_UNION = " UNION ALL ".join(f"SELECT '{s.table}' AS \"table\", row_key, status, prod_hash, dev_hash FROM ({s.diff_sql()})" for s in ALL)
_COUNTS = "count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'updated') AS updated"


def _all_diffs(spark, d) -> DataFrame:
    return rowdiff.diff_tables({s.table: s.sides(spark, d) for s in ALL})


@query(f'SELECT "table", {_COUNTS} FROM ({_UNION}) GROUP BY "table"')
def diff_counts_by_table(spark, d):
    return rowdiff.status_counts({s.table: s.sides(spark, d) for s in ALL})


@query(f'SELECT count(DISTINCT "table") AS tables, {_COUNTS}, count(*) AS total FROM ({_UNION})')
def diff_totals(spark, d):
    return rowdiff.diff_totals(_all_diffs(spark, d))


@query(f'SELECT "table", row_key, status, prod_hash, dev_hash, position FROM (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY CASE status WHEN \'updated\' THEN 0 WHEN \'removed\' THEN 1 ELSE 2 END, row_key) AS position FROM ({_UNION})) WHERE position <= 20')
def row_diff_limit_per_table(spark, d):
    return celldiff.limit_per_table(_all_diffs(spark, d), 20)


@query(f'SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "table", status ORDER BY row_key) AS position FROM ({_UNION})) WHERE position <= 100')
def key_lists_limited(spark, d):
    return celldiff.limit_keys(_all_diffs(spark, d), 100)


_LINE_MULTI = "(SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem)"
_LINE_DEV = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag FROM lineitem WHERE l_orderkey % 10 <> 0)"


@query(f"SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN n > 0 THEN 'removed' ELSE 'added' END AS status, abs(n)::BIGINT AS copies FROM (SELECT l_orderkey, l_linenumber, l_returnflag, sum(n) AS n FROM (SELECT *, 1 AS n FROM {_LINE_MULTI} UNION ALL SELECT *, -1 FROM {_LINE_DEV}) GROUP BY ALL) WHERE n <> 0")
def multiset_diff(spark, d):
    prod = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag")
    dev = prod.where(F.col("l_orderkey") % 10 != 0).withColumn("l_returnflag", F.when(F.col("l_orderkey") % 7 == 0, "X").otherwise(F.col("l_returnflag")))
    return rowdiff.multiset_diff(prod, dev)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return rowdiff.duplicate_keys(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


_BYTES = "CASE WHEN part_no % 3 = 0 THEN '\\xFF'::BLOB || encode(p_name) WHEN part_no % 3 = 1 THEN encode('\\x' || p_name) ELSE encode(p_name) END"
_BYTES_TEXT = "CASE WHEN part_no % 3 = 2 THEN decode(v) ELSE '\\x' || lower(hex(v)) END"


def _bytes_sql(change: str) -> str:
    return f"(SELECT p_partkey, {_BYTES_TEXT} AS p_bytes FROM (SELECT p_partkey, part_no, {_BYTES} AS v FROM (SELECT p_partkey, p_partkey AS part_no, {change} AS p_name FROM part)))"


@query(diff_sql(["p_partkey"], _bytes_sql("p_name"), _bytes_sql("CASE WHEN p_partkey % 7 = 0 THEN p_name || '*' ELSE p_name END"), ["p_partkey", "p_bytes"]))
def row_diff_binary(spark, d):
    """A binary column, some of whose values are no UTF-8 and some of which look like the form of those."""
    key, text = F.col("p_partkey"), F.col("p_name")
    whole = F.when(key % 3 == 0, F.concat(F.unhex(F.lit("FF")), F.encode(text, "UTF-8"))).when(key % 3 == 1, F.encode(F.concat(F.lit("\\x"), text), "UTF-8")).otherwise(F.encode(text, "UTF-8"))
    side = lambda df: df.select("p_partkey", whole.alias("p_bytes"))
    part = PART.prod(spark, d)
    return rowdiff.row_diff(side(part), side(part.withColumn("p_name", F.when(key % 7 == 0, F.concat(text, F.lit("*"))).otherwise(text))), ["p_partkey"])


@query(" UNION ALL ".join(f"SELECT '{s.table}' AS \"table\", count(*) AS n_rows FROM {s.table}" for s in ALL))
def row_counts(spark, d):
    return rowdiff.row_counts({s.table: s.prod(spark, d) for s in ALL})


# --- reading by key


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 500")
def keyset_page_first(spark, d):
    return rowdiff.keyset_page(ORDERS.prod(spark, d), ["o_orderkey"], 500)


@query("SELECT * FROM orders WHERE o_orderkey > 300 ORDER BY o_orderkey LIMIT 500")
def keyset_page_next(spark, d):
    return rowdiff.keyset_page(ORDERS.prod(spark, d), ["o_orderkey"], 500, [300])


@query("SELECT * FROM conversations WHERE (conv_id, turn) > (3, 1) ORDER BY conv_id, turn LIMIT 100")
def keyset_page_composite(spark, d):
    return rowdiff.keyset_page(spark.read.parquet(f"{d}/conversations.parquet"), ["conv_id", "turn"], 100, [3, 1])


@query("SELECT * FROM customer WHERE c_custkey = 77")
def row_lookup(spark, d):
    return rowdiff.row_lookup(CUSTOMER.prod(spark, d), {"c_custkey": 77})


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def rows_for_keys(spark, d):
    keys = ORDERS.prod(spark, d).where(F.col("o_orderkey") % 7 == 0).select(F.col("o_custkey").alias("c_custkey"))
    return rowdiff.rows_for_keys(CUSTOMER.prod(spark, d), keys, ["c_custkey"])


# --- cells

_CELLS = "SELECT k.row_key, k.status, c AS \"column\", p.v AS prod_value, d.v AS dev_value, p.v IS DISTINCT FROM d.v AS differs FROM ({diff}) AS k CROSS JOIN (VALUES {names}) AS n(c) LEFT JOIN {prod} AS p ON p.{key} = k.{key} AND p.n = c LEFT JOIN {dev} AS d ON d.{key} = k.{key} AND d.n = c"


def _long(table: str, key: str, columns: list[str]) -> str:
    return "(" + " UNION ALL ".join(f"SELECT {key}, '{c}' AS n, CAST({c} AS VARCHAR) AS v FROM {table}" for c in columns) + ")"


_CELL_SQL = _CELLS.format(diff=CUSTOMER.diff_sql(), names=", ".join(f"('{c}')" for c in CUSTOMER.columns), key="c_custkey", prod=_long("customer", "c_custkey", CUSTOMER.columns), dev=_long(CUSTOMER.dev_sql(), "c_custkey", CUSTOMER.columns))


def _cells(spark, d) -> DataFrame:
    p, dev, k = CUSTOMER.sides(spark, d)
    return celldiff.cell_diff(rowdiff.row_diff(p, dev, k), p, dev, k)


@query(_CELL_SQL)
def cell_diff_long(spark, d):
    return _cells(spark, d)


@query(f"SELECT row_key, list(DISTINCT \"column\" ORDER BY \"column\") AS columns FROM ({_CELL_SQL}) WHERE differs GROUP BY row_key")
def differing_columns(spark, d):
    return celldiff.differing_columns(_cells(spark, d))


@query('SELECT \'77\' AS row_key, \'updated\' AS status, n AS "column", v AS prod_value, CASE WHEN n = \'c_name\' THEN v || \'*\' ELSE v END AS dev_value, n = \'c_name\' AS differs FROM ' + _long("customer", "c_custkey", CUSTOMER.columns) + " WHERE c_custkey = 77")
def key_detail(spark, d):
    p, dev, k = CUSTOMER.sides(spark, d)
    return celldiff.key_detail(p, dev, {"c_custkey": 77})


# --- resolution

_THREE = (CUSTOMER, ORDERS, SUPPLIER)
_STRATEGY = "CASE \"table\" WHEN 'customer' THEN 'ours' WHEN 'orders' THEN 'theirs' ELSE 'manual' END"
_RESOLVED_SQL = f"SELECT *, CASE strategy WHEN 'ours' THEN 'keep_prod' WHEN 'theirs' THEN 'use_dev' ELSE 'pending' END AS decision, strategy <> 'manual' AS resolved FROM (SELECT *, {_STRATEGY} AS strategy FROM ({_conflicts_sql(_THREE)}))"


_ALL_RESOLVED_SQL = f"SELECT *, CASE \"table\" WHEN 'orders' THEN 'theirs' ELSE 'manual' END AS strategy, CASE \"table\" WHEN 'orders' THEN 'use_dev' ELSE 'pending' END AS decision, \"table\" = 'orders' AS resolved FROM ({_conflicts_sql(ALL)})"


def _resolved(spark, d, diff: DataFrame | None = None) -> DataFrame:
    """The policy over the conflicts of three tables, or of those in a difference that was staged."""
    found = _conflicts(spark, d, _THREE) if diff is None else diff.where(F.col("table").isin(*[s.table for s in _THREE]) & (F.col("status") == "updated")).drop("status")
    strategies = spark.createDataFrame([("customer", "ours", 0), ("orders", "theirs", 1), ("orders", "ours", 2)], "table string, strategy string, ord int")
    return resolve.apply_strategies(found, strategies)


@query(_RESOLVED_SQL)
def apply_strategies(spark, d):
    return _resolved(spark, d)


@query(f"SELECT decision, count(*) AS n FROM ({_RESOLVED_SQL}) GROUP BY decision")
def count_by_decision(spark, d):
    return resolve.count_by(_resolved(spark, d), "decision")


@query(f"SELECT strategy, count(*) AS n FROM ({_RESOLVED_SQL}) GROUP BY strategy")
def count_by_strategy(spark, d):
    return resolve.count_by(_resolved(spark, d), "strategy")


@query(f'SELECT strategy, decision, "table", count(*) AS n, count(*) FILTER (resolved) AS n_resolved FROM ({_RESOLVED_SQL}) GROUP BY GROUPING SETS ((strategy), (decision), ("table"), ())')
def resolution_summary(spark, d):
    return resolve.summary(_resolved(spark, d))


@query(f'SELECT "table", min(strategy) AS strategy, count(*) FILTER (decision = \'keep_prod\') AS keep_prod, count(*) FILTER (decision = \'use_dev\') AS use_dev, count(*) FILTER (decision = \'pending\') AS pending, count(*) AS total FROM ({_RESOLVED_SQL}) GROUP BY "table"')
def resolution_breakdown(spark, d):
    return resolve.breakdown(_resolved(spark, d))


@query(f"SELECT \"table\", row_key, prod_hash, dev_hash FROM ({_RESOLVED_SQL}) WHERE NOT resolved")
def filter_resolved(spark, d):
    return resolve.still_open(_conflicts(spark, d, _THREE), _resolved(spark, d))


@query(f"SELECT \"table\", row_key, prod_hash, dev_hash FROM ({_RESOLVED_SQL}) WHERE resolved")
def filter_unresolved(spark, d):
    return resolve.already_resolved(_conflicts(spark, d, _THREE), _resolved(spark, d))


_ALL_DECIDED = f"SELECT u.*, CASE WHEN status = 'updated' THEN r.decision END AS decision FROM ({_UNION}) AS u LEFT JOIN ({_RESOLVED_SQL}) AS r ON u.\"table\" = r.\"table\" AND u.row_key = r.row_key"


@query(f'SELECT "table", row_key, status, prod_hash, dev_hash FROM ({_ALL_DECIDED}) WHERE decision IS NULL OR decision = \'use_dev\'')
def filter_diff_by_resolutions(spark, d):
    diff = stage(_all_diffs(spark, d), "diffs")
    return resolve.filter_diff(diff, _resolved(spark, d, diff))


@query(f"SELECT decision, count(*) AS n FROM ({_ALL_DECIDED}) WHERE decision IN ('keep_prod', 'pending') GROUP BY decision")
def excluded_counts(spark, d):
    diff = stage(_all_diffs(spark, d), "diffs")
    return resolve.excluded_counts(diff, _resolved(spark, d, diff))


def _saved(spark, d) -> DataFrame:
    return _resolved(spark, d).where(F.col("row_key").cast("long") % 2 == 0)


@query(f"SELECT c.\"table\", c.row_key, c.prod_hash, c.dev_hash, coalesce(s.strategy, 'manual') AS strategy, coalesce(s.decision, 'pending') AS decision, coalesce(s.resolved, false) AS resolved FROM ({_conflicts_sql(_THREE)}) AS c LEFT JOIN (SELECT * FROM ({_RESOLVED_SQL}) WHERE CAST(row_key AS BIGINT) % 2 = 0) AS s ON c.\"table\" = s.\"table\" AND c.row_key = s.row_key")
def merge_resolutions(spark, d):
    return resolve.merge_resolutions(_saved(spark, d), _conflicts(spark, d, _THREE))


@query(f"SELECT \"table\", row_key, prod_hash, dev_hash, CASE WHEN NOT resolved AND \"table\" = 'supplier' THEN 'theirs' ELSE strategy END AS strategy, CASE WHEN NOT resolved AND \"table\" = 'supplier' THEN 'use_dev' ELSE decision END AS decision, resolved OR \"table\" = 'supplier' AS resolved FROM ({_RESOLVED_SQL})")
def bulk_resolution(spark, d):
    return resolve.bulk_resolve(_resolved(spark, d), "theirs", "supplier")


@query(f'SELECT "table", min(row_key) AS first FROM ({_RESOLVED_SQL}) GROUP BY "table"')
def table_order(spark, d):
    return resolve.table_order(_resolved(spark, d), "row_key")


@query(f'SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY row_key) AS position FROM ({_RESOLVED_SQL}) WHERE NOT resolved')
def pending_position(spark, d):
    return resolve.pending_position(_resolved(spark, d))


@query(f'SELECT *, row_number() OVER (ORDER BY "table", row_key) AS running FROM (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY row_key) AS position FROM ({_ALL_RESOLVED_SQL}) WHERE NOT resolved)')
def pending_running(spark, d):
    return resolve.pending_running(resolve.apply_strategies(_conflicts(spark, d, ALL), spark.createDataFrame([("orders", "theirs")], "table string, strategy string")))


@query(f"""SELECT "table", substr(md5(row_key), 1, 2) AS page, count(*) AS n, list(row_key ORDER BY row_key) AS row_keys, list(decision ORDER BY row_key) AS decisions FROM ({_RESOLVED_SQL}) GROUP BY 1, 2""")
def group_by_table(spark, d):
    pages = resolve.group_by_table(_resolved(spark, d))
    return pages.select("table", "page", "n", F.col("resolutions.row_key").alias("row_keys"), F.col("resolutions.decision").alias("decisions"))


@query(f"""SELECT c."table", c.row_key, c.prod_hash, c.dev_hash, coalesce(r.strategy, 'manual') AS strategy, coalesce(r.decision, 'pending') AS decision, coalesce(x.columns, []::VARCHAR[]) AS columns
    FROM ({_conflicts_sql((CUSTOMER, ORDERS))}) AS c LEFT JOIN (SELECT * FROM ({_RESOLVED_SQL}) WHERE CAST(row_key AS BIGINT) % 2 = 0) AS r ON c."table" = r."table" AND c.row_key = r.row_key
    LEFT JOIN (SELECT 'customer' AS "table", row_key, list(DISTINCT "column" ORDER BY "column") AS columns FROM ({_CELL_SQL}) WHERE differs GROUP BY row_key) AS x ON c."table" = x."table" AND c.row_key = x.row_key""")
def conflict_items(spark, d):
    return resolve.conflict_items(_conflicts(spark, d, (CUSTOMER, ORDERS)), _saved(spark, d), _cells(spark, d).withColumn("table", F.lit("CUSTOMER ")))


# --- patches


def _customer_patch(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    p, dev, k = CUSTOMER.sides(spark, d)
    diff = stage(rowdiff.row_diff(p, dev, k), "diff")  # read by deletes and upserts
    return p, patch.patch_deletes(diff, k), patch.patch_upserts(diff, dev, k), k


@query(f"SELECT c_custkey FROM ({CUSTOMER.diff_sql()}) WHERE status IN ('removed', 'updated')")
def patch_deletes(spark, d):
    return _customer_patch(spark, d)[1]


@query(f"SELECT * FROM {CUSTOMER.dev_sql()} WHERE c_custkey IN (SELECT c_custkey FROM ({CUSTOMER.diff_sql()}) WHERE status IN ('added', 'updated'))")
def patch_upserts(spark, d):
    return _customer_patch(spark, d)[2]


@query(f"SELECT * FROM {CUSTOMER.dev_sql()}")
def apply_patch(spark, d):
    return patch.apply_patch(*_customer_patch(spark, d))


@query("SELECT c_custkey, '' AS row_key, '' AS status, '' AS prod_hash, '' AS dev_hash FROM customer WHERE false")
def roundtrip_is_empty(spark, d):
    return rowdiff.row_diff(patch.apply_patch(*_customer_patch(spark, d)), CUSTOMER.dev(spark, d), ["c_custkey"])


@query(f"SELECT * FROM {CUSTOMER.dev_sql()}")
def apply_pack_versions(spark, d):
    """The whole way through files: both sides as folders, a pack from their comparison, its application as the next version of prod's folder, read back."""
    from driftloom.plans import packs
    from driftloom.plans.compare import Comparison
    from driftloom.sources import config, versions

    at = staged_path(spark, "applied", lasting=True)
    for side, df in zip(("prod", "dev"), CUSTOMER.sides(spark, d), strict=False):
        df.write.parquet(f"{at}/{side}/customer.parquet")
    raw = {"prod": {"path": f"{at}/prod"}, "dev": {"path": f"{at}/dev"}, "primary_keys": {"customer": ["c_custkey"]}, "output": {"dir": f"{at}/out"}}
    own = Comparison(spark, config.parse_config(raw))
    packs.write_changes(own, own.run(case_insensitive=False), None, f"{at}/pack", own.stamps())
    packs.apply_changes(own, f"{at}/pack")
    return versions.read(spark, f"{at}/prod", "customer")


_LITERAL = "coalesce('''' || replace(CAST({c} AS VARCHAR), '''', '''''') || '''', 'NULL')"


@query(f"SELECT s_suppkey, 'DELETE FROM \"supplier\" WHERE \"s_suppkey\" = ' || {_LITERAL.format(c='s_suppkey')} || ';' AS stmt FROM ({SUPPLIER.diff_sql()}) WHERE status IN ('removed', 'updated')")
def pack_delete_sql(spark, d):
    diff = rowdiff.row_diff(*SUPPLIER.sides(spark, d))
    return patch.delete_statements(patch.patch_deletes(diff, ["s_suppkey"]), "supplier", ["s_suppkey"], Dialect("postgres"))


_NAMES = ", ".join(f'"{c}"' for c in SUPPLIER.columns)
_VALUES = " || ', ' || ".join(_LITERAL.format(c=c) for c in SUPPLIER.columns)


@query(f"SELECT s_suppkey, 'INSERT INTO \"supplier\" ({_NAMES}) VALUES (' || {_VALUES} || ');' AS stmt FROM {SUPPLIER.dev_sql()} WHERE s_suppkey IN (SELECT s_suppkey FROM ({SUPPLIER.diff_sql()}) WHERE status IN ('added', 'updated'))")
def pack_insert_sql(spark, d):
    p, dev, k = SUPPLIER.sides(spark, d)
    return patch.insert_statements(patch.patch_upserts(rowdiff.row_diff(p, dev, k), dev, k), "supplier", k, Dialect("postgres"))


@query(
    f"""SELECT batch, n_rows, 'UPDATE "supplier" SET "s_name" = CASE ' || cases || ' ELSE "s_name" END WHERE ' || keys || ';' AS stmt FROM (
    SELECT s_suppkey % 16 AS batch, count(*) AS n_rows, string_agg('WHEN ("s_suppkey" = ' || {_LITERAL.format(c='s_suppkey')} || ') THEN ' || {_LITERAL.format(c='s_name')}, ' ' ORDER BY s_suppkey) AS cases,
    string_agg('("s_suppkey" = ' || {_LITERAL.format(c='s_suppkey')} || ')', ' OR ' ORDER BY s_suppkey) AS keys FROM supplier GROUP BY 1)"""
)
def backfill_batches(spark, d):
    return patch.backfill_by_hash(SUPPLIER.prod(spark, d), "supplier", ["s_suppkey"], ["s_name"], Dialect("postgres"), 16)


@query(
    f"""SELECT batch, n_rows, 'UPDATE "supplier" SET "s_name" = CASE ' || cases || ' ELSE "s_name" END WHERE ' || keys || ';' AS stmt FROM (
    SELECT floor(s_suppkey / {patch.BATCH_ROWS})::BIGINT AS batch, count(*) AS n_rows, string_agg('WHEN ("s_suppkey" = ' || {_LITERAL.format(c='s_suppkey')} || ') THEN ' || {_LITERAL.format(c='s_name')}, ' ' ORDER BY s_suppkey) AS cases,
    string_agg('("s_suppkey" = ' || {_LITERAL.format(c='s_suppkey')} || ')', ' OR ' ORDER BY s_suppkey) AS keys FROM supplier GROUP BY 1)"""
)
def backfill_bounded(spark, d):
    return patch.backfill_by_span(SUPPLIER.prod(spark, d), "supplier", ["s_suppkey"], ["s_name"], Dialect("postgres"))


_STAY = f"SELECT s_suppkey, s_nationkey * 2 AS s_extra FROM {SUPPLIER.dev_sql()} WHERE s_suppkey NOT IN (SELECT s_suppkey FROM ({SUPPLIER.diff_sql()}) WHERE status IN ('added', 'updated'))"


@query(
    f"""SELECT batch, n_rows, 'UPDATE "supplier" SET "s_extra" = CASE ' || cases || ' ELSE "s_extra" END WHERE ' || keys || ';' AS stmt FROM (
    SELECT floor(s_suppkey / {patch.BATCH_ROWS})::BIGINT AS batch, count(*) AS n_rows, string_agg('WHEN ("s_suppkey" = ' || {_LITERAL.format(c='s_suppkey')} || ') THEN ' || {_LITERAL.format(c='s_extra')}, ' ' ORDER BY s_suppkey) AS cases,
    string_agg('("s_suppkey" = ' || {_LITERAL.format(c='s_suppkey')} || ')', ' OR ' ORDER BY s_suppkey) AS keys FROM ({_STAY}) GROUP BY 1)"""
)
def pack_backfill_sql(spark, d):
    """A column that dev alone has, for the rows that a patch leaves in place."""
    prod, dev, key = SUPPLIER.sides(spark, d)
    dev = dev.withColumn("s_extra", F.col("s_nationkey") * 2)
    put = rowdiff.row_diff(prod, dev, key, on_drift="intersect").where("status IN ('added', 'updated')")
    return patch.backfill_by_span(dev.join(put, key, "left_anti"), "supplier", key, ["s_extra"], Dialect("postgres"))


# --- texts, single rows and batches of changes


@query(f"SELECT p.c_custkey, p.c_name AS prod_name, d.c_name AS dev_name, p.c_acctbal AS prod_acctbal, d.c_acctbal AS dev_acctbal FROM ({CUSTOMER.diff_sql()}) AS k LEFT JOIN customer AS p ON p.c_custkey = k.c_custkey LEFT JOIN {CUSTOMER.dev_sql()} AS d ON d.c_custkey = k.c_custkey WHERE k.status <> 'added'")
def changed_rows(spark, d):
    prod, dev, key = CUSTOMER.sides(spark, d)
    rows = celldiff.changed_rows(rowdiff.row_diff(prod, dev, key), prod, dev, key).where("status <> 'added'")
    return rows.select("c_custkey", *[F.col(f"{side}.{c}").alias(f"{side}_{c[2:]}") for c in ("c_name", "c_acctbal") for side in ("prod", "dev")])


@query(f"SELECT \"table\", row_key, CASE WHEN \"table\" = 'supplier' AND row_key = '7' THEN 'keep_prod' ELSE decision END AS decision, resolved OR (\"table\" = 'supplier' AND row_key = '7') AS resolved FROM ({_RESOLVED_SQL})")
def set_decision(spark, d):
    return resolve.set_decision(_resolved(spark, d), "supplier", "7", "keep_prod").select("table", "row_key", "decision", "resolved")


@query(f"SELECT \"table\", row_key, CASE decision WHEN 'keep_prod' THEN 'Keep Production' WHEN 'use_dev' THEN 'Use Development' ELSE 'Pending' END AS label, substr(prod_hash, 1, 9) || '...' AS prod FROM ({_RESOLVED_SQL})")
def decision_labels(spark, d):
    return _resolved(spark, d).select("table", "row_key", canonical.decision_label(F.col("decision")).alias("label"), canonical.truncated(F.col("prod_hash"), 12).alias("prod"))


@query("SELECT c_custkey, sha256('c_custkey=' || c_custkey || chr(10) || 'c_acctbal=' || CAST(CAST(c_acctbal AS DECIMAL(38, 6)) AS VARCHAR) || chr(10)) AS row_hash FROM customer")
def row_hash_decimal_doubles(spark, d):
    """Floating-point numbers rounded to six places, a text on which engines agree at every magnitude."""
    return rowdiff.hashed(CUSTOMER.prod(spark, d), ["c_custkey"], columns=["c_custkey", "c_acctbal"], doubles="decimal").drop("row_key")


@query("SELECT conv_id, turn, [CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)] AS parts, NULL::VARCHAR[] AS none FROM conversations")
def split_row_keys(spark, d):
    keys = rowdiff.hashed(spark.read.parquet(f"{d}/conversations.parquet"), ["conv_id", "turn"])
    return keys.select("conv_id", "turn", canonical.split_key(F.col("row_key"), 2).alias("parts"), canonical.split_key(F.col("row_key"), 3).alias("none"))


@query(f"SELECT 'customer' AS \"table\", row_key, status, list(\"column\" ORDER BY \"column\") AS names, list(differs ORDER BY \"column\") AS differs FROM ({_CELL_SQL}) GROUP BY row_key, status")
def nested_report(spark, d):
    nested = celldiff.nested_report(_cells(spark, d), "customer")
    return nested.select("table", "row_key", "status", F.col("columns.Column").alias("names"), F.col("columns.Differs").alias("differs"))


@query("""WITH c AS (SELECT c_custkey % 500 AS id, c_custkey AS seq, c_name AS v, CASE WHEN c_custkey % 7 = 0 THEN 'delete' ELSE 'upsert' END AS op FROM customer WHERE c_custkey % 3 = 0),
    last AS (SELECT id, arg_max(v, seq) AS v, arg_max(op, seq) AS op FROM c GROUP BY id), base AS (SELECT c_custkey AS id, c_name AS v FROM customer)
    SELECT id, v FROM base WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, v FROM last WHERE op <> 'delete'""")
def fold_changes(spark, d):
    """A batch of changes folded into a keyed table: only the last change of a key counts, and some are removals."""
    customer, k = CUSTOMER.prod(spark, d), F.col("c_custkey")
    batch = customer.where(k % 3 == 0).select((k % 500).alias("id"), k.alias("seq"), F.col("c_name").alias("v"), F.when(k % 7 == 0, "delete").otherwise("upsert").alias("op"))
    return changes.fold(customer.select(k.alias("id"), F.col("c_name").alias("v")), batch, ["id"], ["seq"])


def _running(spark, d, compact: bool) -> DataFrame:
    """The difference kept by streaming state: one side's rows, the other's as changes that first say something else, and those that put it right."""
    (prod, dev, key), order = CUSTOMER.sides(spark, d), {"seq": T.LongType()}
    at = staged_path(spark, "running", lasting=True)
    first = dev.where("c_custkey % 3 <> 0").withColumn("c_name", F.lit("first")).unionByName(prod.where("c_custkey % 5 = 0")).withColumn("op", F.lit("upsert"))
    gone = prod.where("c_custkey % 5 = 0").join(dev, key, "left_anti").withColumn("op", F.lit("delete"))
    said = [changes.sided(prod, "prod", key, CUSTOMER.columns, order)]
    said += [changes.sided(rows.withColumn("seq", F.lit(n)), "dev", key, CUSTOMER.columns, order, "op") for n, rows in enumerate((first, dev.withColumn("op", F.lit("upsert")), gone))]
    own = changes.RunningDiff(spark, at, key)
    for part in (said[:2], said[2:]) if compact else (said,):
        for rows in part:
            rows.write.parquet(f"{at}/in/{uuid.uuid4().hex}")
        stream = spark.readStream.schema(said[0].schema).option("maxFilesPerTrigger", 64).option("recursiveFileLookup", True).parquet(f"{at}/in")
        own.start(stream, availableNow=True).awaitTermination()
        if compact:
            own.compact()
    return own.current()


@query(f"SELECT c_custkey, status, prod_hash, dev_hash FROM ({CUSTOMER.diff_sql()})")
def running_difference(spark, d):
    return _running(spark, d, False)


@query(f"SELECT c_custkey, status, prod_hash, dev_hash FROM ({CUSTOMER.diff_sql()})")
def running_difference_compacted(spark, d):
    """The same, its batches folded into the keys that differ after each run of the stream."""
    return _running(spark, d, True)


# --- history


@query("WITH RECURSIVE c AS (SELECT c_custkey AS hash, CASE WHEN c_custkey - c_custkey % 3 - 1 > 0 THEN c_custkey - c_custkey % 3 - 1 END AS parent FROM customer), d AS (SELECT hash, hash AS root, 0 AS depth FROM c WHERE parent IS NULL UNION ALL SELECT c.hash, d.root, d.depth + 1 FROM c JOIN d ON c.parent = d.hash) SELECT hash, root, depth::BIGINT AS depth FROM d")
def commit_reachability(spark, d):
    up = F.col("c_custkey") - F.col("c_custkey") % 3 - 1
    commits = CUSTOMER.prod(spark, d).select(F.col("c_custkey").alias("hash"), F.when(up > 0, up).alias("parent"))
    return history.commit_depths(commits)


@query("WITH RECURSIVE c AS (SELECT c_custkey AS hash, CASE WHEN c_custkey - c_custkey % 3 - 1 > 0 THEN c_custkey - c_custkey % 3 - 1 END AS parent FROM customer), d AS (SELECT hash, parent, 0 AS back FROM c WHERE hash = (SELECT max(c_custkey) FROM customer) UNION ALL SELECT c.hash, c.parent, d.back + 1 FROM c JOIN d ON c.hash = d.parent) SELECT hash, back::BIGINT AS back FROM d")
def history_log(spark, d):
    up, customer = F.col("c_custkey") - F.col("c_custkey") % 3 - 1, CUSTOMER.prod(spark, d)
    return history.log_of(customer.select(F.col("c_custkey").alias("hash"), F.when(up > 0, up).alias("parent")), customer.agg(F.max("c_custkey")).first()[0])


_EARLIER = f"SELECT row_key, status, prod_hash, dev_hash FROM ({CUSTOMER.diff_sql()}) WHERE c_custkey % 4 <> 0"
_LATER = f"SELECT row_key, CASE WHEN c_custkey % 70 = 7 THEN 'removed' ELSE status END AS status, prod_hash, CASE WHEN c_custkey % 70 = 7 THEN NULL ELSE dev_hash END AS dev_hash FROM ({CUSTOMER.diff_sql()}) WHERE c_custkey % 6 <> 0"


@query(
    f"""SELECT 'customer' AS "table", coalesce(o.row_key, n.row_key) AS row_key, CASE WHEN o.row_key IS NULL THEN 'appeared' WHEN n.row_key IS NULL THEN 'resolved' ELSE 'changed' END AS change, o.status AS old_status, n.status AS new_status,
    o.prod_hash AS old_prod_hash, n.prod_hash AS new_prod_hash, o.dev_hash AS old_dev_hash, n.dev_hash AS new_dev_hash FROM ({_EARLIER}) AS o FULL JOIN ({_LATER}) AS n ON o.row_key = n.row_key
    WHERE o.row_key IS NULL OR n.row_key IS NULL OR o.status <> n.status OR o.prod_hash IS DISTINCT FROM n.prod_hash OR o.dev_hash IS DISTINCT FROM n.dev_hash"""
)
def version_data_diff(spark, d):
    """Row differences of two commits, kept as chunks that both share, compared: of a table whose difference moved on in between."""
    diff, k = stage(rowdiff.row_diff(*CUSTOMER.sides(spark, d)).withColumn("table", F.lit("customer")), "version-diff", lasting=True), F.col("c_custkey")
    store = history.Store(staged_path(spark, "versions", lasting=True))
    store.init()
    gone = k % 70 == 7
    later = diff.where(k % 6 != 0).withColumn("status", F.when(gone, "removed").otherwise(F.col("status"))).withColumn("dev_hash", F.when(~gone, F.col("dev_hash")))
    names = [store.save(history.Commit(m, "a", m, data=store.save_rows(rows, 64))) for m, rows in (("earlier", diff.where(k % 4 != 0)), ("later", later))]
    return store.data_diff(spark, *names)


from driftloom.plans import catalog_queries  # noqa: E402, F401  registers the catalog's queries
