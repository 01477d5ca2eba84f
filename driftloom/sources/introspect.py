"""Catalogs as schema models: SQLite files, and catalog queries that Spark sends to other databases."""

from __future__ import annotations

import re
import sqlite3
from collections import defaultdict

from pyspark.sql import SparkSession

from driftloom.functions.retry import DriftError, connected, retry
from driftloom.plans.catalog import Column, ForeignKey, Index, Schema, Table, Trigger, View
from driftloom.sources import catalog_sql
from driftloom.sources.config import Source
from driftloom.sources.tables import jdbc_query


def sqlite_schema(path: str) -> Schema:
    """Tables, keys, indexes, foreign keys, views and triggers of a SQLite file."""
    schema = Schema()
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        q = lambda sql, *a: db.execute(sql, a).fetchall()
        for name, sql, kind, table in q("SELECT name, sql, type, tbl_name FROM sqlite_master WHERE name NOT LIKE 'sqlite_%' ORDER BY name"):
            if kind == "table":
                schema.tables[name] = _sqlite_table(q, name)
            elif kind == "view":
                schema.views[name] = View(name, re.split(r"\sas\s", sql, maxsplit=1, flags=re.IGNORECASE)[-1].strip())
            elif kind == "trigger":
                schema.triggers[name] = Trigger(name, table, *trigger_event(sql), sql)
    return schema


def _sqlite_table(q, name: str) -> Table:
    table = Table(name)
    keys = []
    for _, column, kind, not_null, default, place in q("SELECT * FROM pragma_table_info(?)", name):
        table.columns[column] = Column(column, kind.lower(), not not_null, default)
        if place:
            keys.append((place, column))
    table.primary_key = [c for _, c in sorted(keys)]
    for _, index, unique, origin, *_ in q("SELECT * FROM pragma_index_list(?)", name):
        if origin == "c":
            table.indexes[index] = Index(index, [r[2] for r in sorted(q("SELECT * FROM pragma_index_info(?)", index))], bool(unique))
    parts = defaultdict(list)
    for row in q("SELECT * FROM pragma_foreign_key_list(?)", name):
        parts[row[0]].append(row)
    for number, rows in parts.items():
        rows.sort(key=lambda r: r[1])
        key = f"fk_{name}_{number}"
        table.foreign_keys[key] = ForeignKey(key, [r[3] for r in rows], rows[0][2], [r[4] for r in rows], rows[0][6], rows[0][5])
    return table


def trigger_event(sql: str) -> tuple[str, str]:
    """(timing, event) of a trigger's text."""
    found = re.search(r"\b(before|after|instead\s+of)?\s*\b(insert|update|delete)\b", sql, re.IGNORECASE)
    timing = re.sub(r"\s+", " ", found[1]).upper() if found and found[1] else "BEFORE"
    return timing, found[2].upper() if found else ""


#: The standard catalog's columns and key columns; other engines' are asked the same way with their own query. The last four columns tell what a type's text lacks.
COLUMNS_QUERY = """SELECT c.table_name, c.column_name, c.ordinal_position, {type} AS data_type, c.is_nullable, c.column_default, k.ordinal_position AS pk_ordinal,
c.character_maximum_length AS type_length, c.numeric_precision AS type_precision, c.numeric_scale AS type_scale, c.datetime_precision AS type_fraction
FROM information_schema.columns c JOIN information_schema.tables t ON t.table_schema = c.table_schema AND t.table_name = c.table_name AND t.table_type = 'BASE TABLE'
LEFT JOIN information_schema.table_constraints p ON p.table_schema = c.table_schema AND p.table_name = c.table_name AND p.constraint_type = 'PRIMARY KEY'
LEFT JOIN information_schema.key_column_usage k ON k.constraint_name = p.constraint_name AND k.table_schema = p.table_schema AND k.table_name = p.table_name AND k.column_name = c.column_name
WHERE c.table_schema = '{schema}'"""
TYPES = {"mysql": "c.column_type", "postgres": "c.udt_name", "mssql": "c.data_type"}
ORACLE_QUERY = """SELECT c.table_name, c.column_name, c.column_id AS ordinal_position, c.data_type, c.nullable AS is_nullable, c.data_default AS column_default, k.position AS pk_ordinal,
CASE c.data_type WHEN 'RAW' THEN c.data_length ELSE c.char_length END AS type_length, c.data_precision AS type_precision, c.data_scale AS type_scale, NULL AS type_fraction
FROM user_tab_columns c JOIN user_tables t ON t.table_name = c.table_name LEFT JOIN user_constraints p ON p.table_name = c.table_name AND p.constraint_type = 'P'
LEFT JOIN user_cons_columns k ON k.constraint_name = p.constraint_name AND k.column_name = c.column_name"""

#: The types, by engine, that take a length, a precision with its scale, and a fraction of seconds.
SIZED = {
    "postgres": ({"varchar", "bpchar", "bit", "varbit"}, {"numeric"}, set()),
    "mssql": ({"char", "nchar", "varchar", "nvarchar", "binary", "varbinary"}, {"decimal", "numeric"}, {"datetime2", "datetimeoffset", "time"}),
    "oracle": ({"char", "nchar", "varchar2", "nvarchar2", "raw"}, {"number", "float"}, set()),
}


def full_type(driver: str, kind: str, length: int | None = None, precision: int | None = None, scale: int | None = None, fraction: int | None = None) -> str:
    """A type as DDL takes it. MySQL's catalog gives it whole; PostgreSQL's arrays are named by a leading underscore."""
    own = kind.strip().lower()
    lengths, precisions, fractions = SIZED.get(driver, (set(), set(), set()))
    base = own.removeprefix("_") if driver == "postgres" else own
    inside = None
    if base in lengths and length is not None:
        inside = "max" if length == -1 else str(int(length))
    elif base in precisions and precision is not None:
        inside = str(int(precision)) if scale is None or base == "float" else f"{int(precision)},{int(scale)}"
    elif base in fractions and fraction is not None:
        inside = str(int(fraction))
    text = base if inside is None else f"{base}({inside})"
    return text + "[]" if base != own else text


def columns_query(source: Source) -> str:
    if source.driver == "oracle":
        return ORACLE_QUERY
    return COLUMNS_QUERY.format(type=TYPES[source.driver], schema=schema_name(source).replace("'", "''"))


def schema_name(source: Source) -> str:
    return {"postgres": "public", "mssql": "dbo"}.get(source.driver, source.database)


def fold_columns(rows: list[tuple], driver: str = "mysql") -> Schema:
    """Catalog rows (table, column, ordinal, type, nullable, default, key ordinal[, length, precision, scale, fraction]) as a schema; key columns in their order."""
    schema, keys = Schema(), defaultdict(list)
    for table, column, _, kind, nullable, default, place, *sizes in sorted(rows, key=lambda r: (r[0], r[2])):
        schema.tables.setdefault(table, Table(table)).columns[column] = Column(column, full_type(driver, kind, *sizes), str(nullable).upper() in ("YES", "Y", "TRUE", "1"), default)
        if place is not None:
            keys[table].append((place, column))
    for table, own in keys.items():
        schema.tables[table].primary_key = [c for _, c in sorted(own)]
    return schema


def jdbc_schema(spark: SparkSession, source: Source) -> Schema:
    """A database's schema, read from its catalog: as many rows as it has columns and other objects. A query that an older server refuses has a plainer one."""
    read = lambda query: [tuple(r) for r in retry(lambda: connected(jdbc_query(spark, source, query).collect))]
    found = {}
    for kind, query in catalog_sql.queries(source.driver, schema_name(source)).items():
        plainer = catalog_sql.PLAINER.get((source.driver, kind))
        try:
            found[kind] = read(query)
        except DriftError:
            raise
        except Exception:
            if plainer is None:
                raise
            found[kind] = read(plainer.format(schema=schema_name(source).replace("'", "''")))
    return catalog_sql.fold(fold_columns(read(columns_query(source)), source.driver), found)
