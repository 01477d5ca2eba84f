"""Catalog comparisons over catalogs that are derived from the given tables, so that they grow with them.

Each catalog object is a row: parts are columns of the tables that their brands name, orders' lines are index columns, orders
are foreign keys, conversations are views and routines, events are triggers, customers are sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators import patch, rowdiff, schemadiff
from driftloom.plans.dialects import Dialect
from driftloom.plans.registry import query

_MARK = "list_filter([{tests}], lambda x: x IS NOT NULL)"


def _diff_sql(prod: str, dev: str, name: list[str], attributes: dict[str, str]) -> str:
    """attributes: a SQL form of each compared column, {x} standing for the column."""
    on = " AND ".join(f"p.{n} = d.{n}" for n in name)
    keys = ", ".join(f"coalesce(p.{n}, d.{n}) AS {n}" for n in name)
    tests = ", ".join(f"CASE WHEN {f.format(x=f'p.{a}')} IS DISTINCT FROM {f.format(x=f'd.{a}')} THEN '{a}' END" for a, f in attributes.items())
    both = "p.here IS NOT NULL AND d.here IS NOT NULL"
    return f"""SELECT * FROM (SELECT {keys}, CASE WHEN p.here IS NULL THEN 'added' WHEN d.here IS NULL THEN 'removed' ELSE 'modified' END AS change,
      CASE WHEN {both} THEN {_MARK.format(tests=tests or "NULL::VARCHAR")} ELSE []::VARCHAR[] END AS attributes
      FROM (SELECT *, 1 AS here FROM ({prod})) AS p FULL JOIN (SELECT *, 1 AS here FROM ({dev})) AS d ON {on}) WHERE change <> 'modified' OR len(attributes) > 0"""


_FOLD, _DEF = "lower(trim({x}))", "lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
_COLUMNS = "SELECT p_brand AS \"table\", 'c' || p_partkey AS \"column\", p_type AS data_type, p_size % 2 = 0 AS is_nullable, CASE WHEN p_size % 3 = 0 THEN NULL ELSE '''' || p_size || '''' END AS default_value, CASE WHEN p_partkey % 5 = 0 THEN p_partkey END AS pk_ordinal, p_partkey AS k FROM part"
_COLUMNS_DEV = f"SELECT \"table\", \"column\", CASE WHEN k % 7 = 0 THEN data_type || '2' ELSE upper(data_type) || ' ' END AS data_type, CASE WHEN k % 11 = 0 THEN NOT is_nullable ELSE is_nullable END AS is_nullable, replace(default_value, '''', '') AS default_value, CASE WHEN k % 35 = 0 THEN NULL ELSE pk_ordinal END AS pk_ordinal, k FROM ({_COLUMNS}) WHERE k % 10 <> 0"


def _columns(spark, d) -> tuple[DataFrame, DataFrame]:
    part, n = spark.read.parquet(f"{d}/part.parquet"), F.col("k")
    prod = part.select(
        F.col("p_brand").alias("table"), F.concat(F.lit("c"), "p_partkey").alias("column"), F.col("p_type").alias("data_type"), (F.col("p_size") % 2 == 0).alias("is_nullable"),
        F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("'"), "p_size", F.lit("'"))).alias("default_value"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey")).alias("pk_ordinal"), F.col("p_partkey").alias("k"),
    )
    dev = prod.where(n % 10 != 0).withColumns({"data_type": F.when(n % 7 == 0, F.concat("data_type", F.lit("2"))).otherwise(F.concat(F.upper("data_type"), F.lit(" "))), "is_nullable": F.when(n % 11 == 0, ~F.col("is_nullable")).otherwise(F.col("is_nullable")), "default_value": F.replace("default_value", F.lit("'"), F.lit("")), "pk_ordinal": F.when(n % 35 != 0, F.col("pk_ordinal"))})
    return prod, dev


@query(_diff_sql(_COLUMNS, _COLUMNS_DEV, ['"table"', '"column"'], {"data_type": _FOLD, "is_nullable": "{x}", "default_value": "replace({x}, '''', '')"}))
def schema_columns_diff(spark, d):
    return schemadiff.diff_columns(*_columns(spark, d))


_KEYS = 'SELECT "table", list("column" ORDER BY pk_ordinal) AS columns FROM ({}) WHERE pk_ordinal IS NOT NULL GROUP BY "table"'


@query(_diff_sql(_KEYS.format(_COLUMNS), _KEYS.format(_COLUMNS_DEV), ['"table"'], {"columns": "{x}"}))
def schema_pk_diff(spark, d):
    return schemadiff.diff_primary_keys(*_columns(spark, d))


_INDEX = "SELECT l_returnflag AS \"table\", 'i' || l_orderkey AS name, list('c' || l_partkey ORDER BY l_linenumber, 'c' || l_partkey) AS columns, l_orderkey % 2 = 0 AS is_unique FROM lineitem GROUP BY l_returnflag, l_orderkey"


def _indexes(spark, d) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("table"), F.concat(F.lit("i"), "l_orderkey").alias("name"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("c"), "l_partkey").alias("column"))
    prod = schemadiff.fold_columns(lines, ["table", "name", "k"]).withColumn("is_unique", F.col("k") % 2 == 0)
    dev = prod.where(F.col("k") % 10 != 0).withColumns({"columns": F.when(F.col("k") % 7 == 0, F.reverse("columns")).otherwise(F.col("columns")), "is_unique": F.when(F.col("k") % 11 == 0, ~F.col("is_unique")).otherwise(F.col("is_unique"))})
    return prod, dev


@query(_diff_sql(_INDEX, f"SELECT \"table\", name, CASE WHEN k % 7 = 0 THEN list_reverse(columns) ELSE columns END AS columns, CASE WHEN k % 11 = 0 THEN NOT is_unique ELSE is_unique END AS is_unique FROM (SELECT *, CAST(substr(name, 2) AS BIGINT) AS k FROM ({_INDEX})) WHERE k % 10 <> 0", ['"table"', "name"], {"columns": "{x}", "is_unique": "{x}"}))
def schema_indexes_diff(spark, d):
    return schemadiff.diff_indexes(*_indexes(spark, d))


_FK = "SELECT o_orderstatus AS \"table\", 'fk' || o_orderkey AS name, ['c' || o_custkey] AS columns, 't' || o_custkey AS ref_table, ['id'] AS ref_columns, CASE o_orderkey % 3 WHEN 0 THEN 'CASCADE' WHEN 1 THEN '' ELSE 'SET NULL' END AS on_delete, '' AS on_update, o_orderkey AS k FROM orders"
_ACTION = "coalesce(nullif(upper(trim({x})), ''), 'NO ACTION')"


@query(_diff_sql(_FK, f"SELECT * REPLACE (CASE WHEN k % 7 = 0 THEN ref_table || 'x' ELSE ref_table END AS ref_table, CASE WHEN k % 11 = 0 THEN 'RESTRICT' WHEN on_delete = '' THEN 'no action' ELSE lower(on_delete) END AS on_delete) FROM ({_FK}) WHERE k % 10 <> 0", ['"table"', "name"], {"columns": "{x}", "ref_table": "{x}", "ref_columns": "{x}", "on_delete": _ACTION, "on_update": _ACTION}))
def schema_fk_diff(spark, d):
    k = F.col("k")
    prod = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderstatus").alias("table"), F.concat(F.lit("fk"), "o_orderkey").alias("name"), F.array(F.concat(F.lit("c"), "o_custkey")).alias("columns"), F.concat(F.lit("t"), "o_custkey").alias("ref_table"), F.array(F.lit("id")).alias("ref_columns"),
        F.when(F.col("o_orderkey") % 3 == 0, "CASCADE").when(F.col("o_orderkey") % 3 == 1, "").otherwise("SET NULL").alias("on_delete"), F.lit("").alias("on_update"), F.col("o_orderkey").alias("k"),
    )
    dev = prod.where(k % 10 != 0).withColumns({"ref_table": F.when(k % 7 == 0, F.concat("ref_table", F.lit("x"))).otherwise(F.col("ref_table")), "on_delete": F.when(k % 11 == 0, "RESTRICT").when(F.col("on_delete") == "", "no action").otherwise(F.lower("on_delete"))})
    return schemadiff.diff_foreign_keys(prod, dev)


_VIEW = "SELECT conv_id || '.' || turn AS name, text AS definition, turn % 2 = 0 AS is_materialized, conv_id AS k FROM conversations"


def _messages(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").withColumns({"name": F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "k": F.col("conv_id"), "definition": F.col("text")})


@query(_diff_sql(_VIEW, f"SELECT * REPLACE (CASE WHEN k % 7 = 0 THEN definition || ' x' ELSE replace(definition, ' ', chr(10) || ' ') END AS definition, CASE WHEN k % 11 = 0 THEN NOT is_materialized ELSE is_materialized END AS is_materialized) FROM ({_VIEW}) WHERE k % 10 <> 0", ["name"], {"definition": _DEF, "is_materialized": "{x}"}))
def schema_views_diff(spark, d):
    prod, k = _messages(spark, d).select("name", "definition", (F.col("turn") % 2 == 0).alias("is_materialized"), "k"), F.col("k")
    dev = prod.where(k % 10 != 0).withColumns({"definition": F.when(k % 7 == 0, F.concat("definition", F.lit(" x"))).otherwise(F.replace("definition", F.lit(" "), F.lit("\n "))), "is_materialized": F.when(k % 11 == 0, ~F.col("is_materialized")).otherwise(F.col("is_materialized"))})
    return schemadiff.diff_views(prod, dev)


_ROUTINE = "SELECT conv_id || '.' || turn AS name, role AS kind, 'SQL' AS language, 'int' AS return_type, text AS definition, ['in:' || turn, 'out:' || conv_id] AS parameters, conv_id AS k FROM conversations"


@query(_diff_sql(_ROUTINE, f"SELECT * REPLACE (lower(language) AS language, CASE WHEN k % 7 = 0 THEN 'text' ELSE return_type END AS return_type, CASE WHEN k % 11 = 0 THEN list_reverse(parameters) ELSE parameters END AS parameters) FROM ({_ROUTINE}) WHERE k % 10 <> 0", ["name"], {"kind": "lower({x})", "language": "lower({x})", "return_type": "lower({x})", "definition": _DEF, "parameters": "{x}"}))
def schema_routines_diff(spark, d):
    k = F.col("k")
    prod = _messages(spark, d).select("name", F.col("role").alias("kind"), F.lit("SQL").alias("language"), F.lit("int").alias("return_type"), "definition", F.array(F.concat(F.lit("in:"), "turn"), F.concat(F.lit("out:"), "conv_id")).alias("parameters"), "k")
    dev = prod.where(k % 10 != 0).withColumns({"language": F.lower("language"), "return_type": F.when(k % 7 == 0, "text").otherwise(F.col("return_type")), "parameters": F.when(k % 11 == 0, F.reverse("parameters")).otherwise(F.col("parameters"))})
    return schemadiff.diff_routines(prod, dev)


_TRIGGER = "SELECT 'tr' || event_id AS name, 'u' || user_id AS \"table\", event_type AS event, 'AFTER' AS timing, coalesce(CAST(props AS VARCHAR), '') AS definition, event_id AS k FROM events"


@query(_diff_sql(_TRIGGER, f"SELECT * REPLACE (CASE WHEN k % 7 = 0 THEN 'u0' ELSE \"table\" END AS \"table\", upper(event) AS event, CASE WHEN k % 11 = 0 THEN 'BEFORE' ELSE 'after' END AS timing) FROM ({_TRIGGER}) WHERE k % 10 <> 0", ["name"], {'"table"': "{x}", "event": "lower({x})", "timing": "lower({x})", "definition": _DEF}).replace("'\"table\"'", "'table'"))
def schema_triggers_diff(spark, d):
    k = F.col("k")
    prod = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("tr"), "event_id").alias("name"), F.concat(F.lit("u"), "user_id").alias("table"), F.col("event_type").alias("event"), F.lit("AFTER").alias("timing"), F.coalesce(F.col("props").cast("string"), F.lit("")).alias("definition"), F.col("event_id").alias("k"))
    dev = prod.where(k % 10 != 0).withColumns({"table": F.when(k % 7 == 0, "u0").otherwise(F.col("table")), "event": F.upper("event"), "timing": F.when(k % 11 == 0, "BEFORE").otherwise("after")})
    return schemadiff.diff_triggers(prod, dev)


_SEQUENCE = "SELECT c_name AS name, c_custkey::BIGINT AS start_value, c_nationkey::BIGINT AS increment, 1::BIGINT AS min_value, 1000000::BIGINT AS max_value, c_custkey % 2 = 0 AS is_cyclic, 1::BIGINT AS cache_size, c_custkey AS k FROM customer"


@query(_diff_sql(_SEQUENCE, f"SELECT * REPLACE (CASE WHEN k % 7 = 0 THEN start_value + 1 ELSE start_value END AS start_value, CASE WHEN k % 11 = 0 THEN NOT is_cyclic ELSE is_cyclic END AS is_cyclic) FROM ({_SEQUENCE}) WHERE k % 10 <> 0", ["name"], {c: "{x}" for c in ("start_value", "increment", "min_value", "max_value", "is_cyclic", "cache_size")}))
def schema_sequences_diff(spark, d):
    k, one = F.col("k"), F.lit(1).cast("long")
    prod = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("name"), F.col("c_custkey").cast("long").alias("start_value"), F.col("c_nationkey").cast("long").alias("increment"), one.alias("min_value"), F.lit(1000000).cast("long").alias("max_value"), (F.col("c_custkey") % 2 == 0).alias("is_cyclic"), one.alias("cache_size"), F.col("c_custkey").alias("k"))
    dev = prod.where(k % 10 != 0).withColumns({"start_value": F.when(k % 7 == 0, F.col("start_value") + 1).otherwise(F.col("start_value")), "is_cyclic": F.when(k % 11 == 0, ~F.col("is_cyclic")).otherwise(F.col("is_cyclic"))})
    return schemadiff.diff_sequences(prod, dev)


@query("SELECT upper(p.c_name) || ' ' AS dev_table, p.c_name AS prod_table FROM customer AS p WHERE c_custkey % 10 <> 0")
def table_pairing_canonical(spark, d):
    prod = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("table"), "c_custkey")
    return rowdiff.pair_tables(prod, prod.where("c_custkey % 10 <> 0").select(F.concat(F.upper("table"), F.lit(" ")).alias("table")))


@query("SELECT DISTINCT 'o' || o_orderkey AS \"table\" FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_primary_keys(spark, d):
    tables = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("o"), "o_orderkey").alias("table")).distinct()
    return rowdiff.missing_keys(tables, spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("o"), "l_orderkey").alias("table")))


_DRIFT = _diff_sql(_COLUMNS, _COLUMNS_DEV, ['"table"', '"column"'], {"data_type": _FOLD, "is_nullable": "{x}", "default_value": "replace({x}, '''', '')"})


@query(f"SELECT change, count(*) AS n FROM ({_DRIFT}) GROUP BY change")
def schema_drift_counts(spark, d):
    return schemadiff.drift_counts(schema_columns_diff(spark, d))


_FLAGS = {"columns": _DRIFT, "primary_keys": _diff_sql(_KEYS.format(_COLUMNS), _KEYS.format(_COLUMNS_DEV), ['"table"'], {"columns": "{x}"}), "none": f"SELECT 1 FROM ({_DRIFT}) WHERE false"}


@query(" UNION ALL ".join(f"SELECT '{kind}' AS kind, count(*) > 0 AS drift FROM ({sql})" for kind, sql in _FLAGS.items()))
def schema_drift_flag(spark, d):
    columns = _columns(spark, d)
    return schemadiff.drift_flags({"columns": schemadiff.diff_columns(*columns), "primary_keys": schemadiff.diff_primary_keys(*columns), "none": schemadiff.diff_columns(columns[0], columns[0])})


@query(f"""SELECT p."table", p."column", 'ALTER TABLE "' || p."table" || '" ADD COLUMN "' || p."column" || '" ' || p.data_type || CASE WHEN p.is_nullable THEN '' ELSE ' NOT NULL' END || coalesce(' DEFAULT ' || p.default_value, '') || ';' AS stmt
    FROM ({_COLUMNS}) AS p WHERE NOT EXISTS (SELECT 1 FROM ({_COLUMNS_DEV}) AS d WHERE d."table" = p."table" AND d."column" = p."column")""")
def pack_alter_sql(spark, d):
    """The columns that the richer side alone has, as the script that brings them: here prod's catalog plays dev."""
    rich, poor = _columns(spark, d)
    return patch.add_column_statements(rich.join(poor.select("table", "column"), ["table", "column"], "left_anti"), Dialect("postgres"))


@query("SELECT DISTINCT 'o' || o_orderkey AS \"table\" FROM orders WHERE o_orderkey NOT IN (7, 77) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber > 3)")
def missing_primary_keys_ignored(spark, d):
    """The precondition of a comparison, without tables that the configuration ignores, whatever their case."""
    tables = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("o"), "o_orderkey").alias("table")).distinct()
    return rowdiff.missing_keys(tables, spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber > 3").select(F.concat(F.lit("o"), "l_orderkey").alias("table")), [" O7", "o77"])


@query("SELECT c_name AS prod_table, c_name AS dev_table FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 7 <> 0")
def table_pairing_exact(spark, d):
    """Pairs as scripts and packs need them: a name that differs in case alone has none."""
    prod, k = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("table"), "c_custkey"), F.col("c_custkey")
    dev = prod.where(k % 10 != 0).select(F.when(k % 7 == 0, F.upper("table")).otherwise(F.col("table")).alias("table"))
    return rowdiff.pair_tables(prod, dev, case_insensitive=False)
