"""Catalog queries of network databases by kind of object, each with the same columns whatever the engine, and their folding into a schema model.

Spark sends them through its JDBC source; they return one row per column of an object, or per object.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from driftloom.plans.catalog import ForeignKey, Index, Routine, Schema, Sequence, Trigger, View

# (table_name, index_name, ordinal, column_name, is_unique), without primary keys
INDEXES = {
    "mysql": "SELECT table_name, index_name, seq_in_index AS ordinal, column_name, CASE non_unique WHEN 0 THEN 1 ELSE 0 END AS is_unique FROM information_schema.statistics WHERE table_schema = '{schema}' AND index_name <> 'PRIMARY'",
    "postgres": "SELECT t.relname AS table_name, i.relname AS index_name, k.n AS ordinal, a.attname AS column_name, CASE WHEN x.indisunique THEN 1 ELSE 0 END AS is_unique FROM pg_index x JOIN pg_class t ON t.oid = x.indrelid JOIN pg_class i ON i.oid = x.indexrelid JOIN pg_namespace s ON s.oid = t.relnamespace, unnest(x.indkey) WITH ORDINALITY AS k(attnum, n), pg_attribute a WHERE a.attrelid = t.oid AND a.attnum = k.attnum AND NOT x.indisprimary AND s.nspname = '{schema}'",
    "mssql": "SELECT t.name AS table_name, i.name AS index_name, c.key_ordinal AS ordinal, col.name AS column_name, CAST(i.is_unique AS int) AS is_unique FROM sys.indexes i JOIN sys.tables t ON t.object_id = i.object_id JOIN sys.index_columns c ON c.object_id = i.object_id AND c.index_id = i.index_id AND c.key_ordinal > 0 JOIN sys.columns col ON col.object_id = c.object_id AND col.column_id = c.column_id WHERE i.is_primary_key = 0 AND i.name IS NOT NULL AND SCHEMA_NAME(t.schema_id) = '{schema}'",
    "oracle": "SELECT i.table_name, i.index_name, c.column_position AS ordinal, c.column_name, CASE i.uniqueness WHEN 'UNIQUE' THEN 1 ELSE 0 END AS is_unique FROM user_indexes i JOIN user_ind_columns c ON c.index_name = i.index_name WHERE i.index_type = 'NORMAL' AND NOT EXISTS (SELECT 1 FROM user_constraints p WHERE p.index_name = i.index_name AND p.constraint_type = 'P')",
}

_STANDARD_KEYS = "SELECT k.table_name, r.constraint_name, k.ordinal_position AS ordinal, k.column_name, u.table_name AS ref_table, u.column_name AS ref_column, r.delete_rule, r.update_rule FROM information_schema.referential_constraints r JOIN information_schema.key_column_usage k ON k.constraint_schema = r.constraint_schema AND k.constraint_name = r.constraint_name JOIN information_schema.key_column_usage u ON u.constraint_schema = r.unique_constraint_schema AND u.constraint_name = r.unique_constraint_name AND u.ordinal_position = {place} WHERE r.constraint_schema = '{{schema}}'"
# (table_name, constraint_name, ordinal, column_name, ref_table, ref_column, delete_rule, update_rule)
FOREIGN_KEYS = {
    "postgres": _STANDARD_KEYS.format(place="k.position_in_unique_constraint"),
    "mssql": _STANDARD_KEYS.format(place="k.ordinal_position"),
    "mysql": "SELECT k.table_name, r.constraint_name, k.ordinal_position AS ordinal, k.column_name, k.referenced_table_name AS ref_table, k.referenced_column_name AS ref_column, r.delete_rule, r.update_rule FROM information_schema.referential_constraints r JOIN information_schema.key_column_usage k ON k.constraint_schema = r.constraint_schema AND k.constraint_name = r.constraint_name AND k.table_name = r.table_name WHERE r.constraint_schema = '{schema}'",
    "oracle": "SELECT k.table_name, k.constraint_name, c.position AS ordinal, c.column_name, u.table_name AS ref_table, u.column_name AS ref_column, k.delete_rule, 'NO ACTION' AS update_rule FROM user_constraints k JOIN user_cons_columns c ON c.constraint_name = k.constraint_name JOIN user_cons_columns u ON u.constraint_name = k.r_constraint_name AND u.position = c.position WHERE k.constraint_type = 'R'",
}

# (name, definition, is_materialized)
VIEWS = {
    "mysql": "SELECT table_name AS name, view_definition AS definition, 0 AS is_materialized FROM information_schema.views WHERE table_schema = '{schema}'",
    "postgres": "SELECT schemaname || '.' || viewname AS name, definition, 0 AS is_materialized FROM pg_views WHERE schemaname = '{schema}' UNION ALL SELECT schemaname || '.' || matviewname, definition, 1 FROM pg_matviews WHERE schemaname = '{schema}'",
}

# (name, kind, language, return_type, definition)
ROUTINES = {
    "mysql": "SELECT routine_name AS name, routine_type AS kind, 'SQL' AS language, data_type AS return_type, routine_definition AS definition FROM information_schema.routines WHERE routine_schema = '{schema}'",
    "postgres": "SELECT p.proname || '(' || pg_get_function_identity_arguments(p.oid) || ')' AS name, CASE p.prokind WHEN 'p' THEN 'PROCEDURE' ELSE 'FUNCTION' END AS kind, l.lanname AS language, pg_get_function_result(p.oid) AS return_type, pg_get_functiondef(p.oid) AS definition FROM pg_proc p JOIN pg_namespace s ON s.oid = p.pronamespace JOIN pg_language l ON l.oid = p.prolang WHERE s.nspname = '{schema}' AND p.prokind IN ('f', 'p')",
}

# (routine_name, ordinal, mode, parameter_name, data_type)
PARAMETERS = {
    "mysql": "SELECT specific_name AS routine_name, ordinal_position AS ordinal, parameter_mode AS mode, parameter_name, dtd_identifier AS data_type FROM information_schema.parameters WHERE specific_schema = '{schema}' AND ordinal_position > 0",
}

# (name, table_name, timing, event, definition)
TRIGGERS = {
    "mysql": "SELECT trigger_name AS name, event_object_table AS table_name, action_timing AS timing, event_manipulation AS event, action_statement AS definition FROM information_schema.triggers WHERE trigger_schema = '{schema}'",
    "postgres": "SELECT g.trigger_name AS name, g.event_object_table AS table_name, g.action_timing AS timing, string_agg(g.event_manipulation, ' OR ' ORDER BY g.event_manipulation) AS event, min(g.action_statement) AS definition FROM information_schema.triggers g WHERE g.trigger_schema = '{schema}' GROUP BY 1, 2, 3",
}

# (name, start_value, increment, min_value, max_value, cache_size, is_cyclic)
SEQUENCES = {
    "postgres": "SELECT sequencename AS name, start_value, increment_by AS increment, min_value, max_value, cache_size, CASE WHEN cycle THEN 1 ELSE 0 END AS is_cyclic FROM pg_sequences WHERE schemaname = '{schema}'",
}

#: For servers that lack a view of the query above: PostgreSQL before version 10 has no pg_sequences, and its standard view no cache size.
PLAINER = {
    ("postgres", "sequences"): "SELECT sequence_name AS name, CAST(start_value AS bigint) AS start_value, CAST(increment AS bigint) AS increment, CAST(minimum_value AS bigint) AS min_value, CAST(maximum_value AS bigint) AS max_value, 0 AS cache_size, CASE cycle_option WHEN 'YES' THEN 1 ELSE 0 END AS is_cyclic FROM information_schema.sequences WHERE sequence_schema = '{schema}'",
}

KINDS = {"indexes": INDEXES, "foreign_keys": FOREIGN_KEYS, "views": VIEWS, "routines": ROUTINES, "parameters": PARAMETERS, "triggers": TRIGGERS, "sequences": SEQUENCES}


def queries(driver: str, schema: str) -> dict[str, str]:
    """The queries that an engine has, by kind."""
    return {kind: own[driver].format(schema=schema.replace("'", "''")) for kind, own in KINDS.items() if driver in own}


def _grouped(rows: Iterable[tuple], order: int = 2) -> dict[tuple, list[tuple]]:
    """Rows by their first two fields, each group in order."""
    out = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[order])):
        out[row[:2]].append(row)
    return out


def fold(schema: Schema, found: dict[str, Iterable[tuple]]) -> Schema:
    """Add the rows of each kind to a schema; objects of tables that it lacks are left out."""
    for (table, name), rows in _grouped(found.get("indexes", ())).items():
        if table in schema.tables:
            schema.tables[table].indexes[name] = Index(name, [r[3] for r in rows], bool(rows[0][4]))
    for (table, name), rows in _grouped(found.get("foreign_keys", ())).items():
        if table in schema.tables:
            schema.tables[table].foreign_keys[name] = ForeignKey(name, [r[3] for r in rows], rows[0][4], [r[5] for r in rows], rows[0][6] or "", rows[0][7] or "")
    for name, definition, materialized in found.get("views", ()):
        schema.views[name] = View(name, definition or "", bool(materialized))
    parameters = defaultdict(list)
    for routine, _, mode, name, kind in sorted(found.get("parameters", ()), key=lambda r: (r[0], r[1])):
        parameters[routine].append((mode or "IN", name or "", kind or ""))
    for name, kind, language, returned, definition in found.get("routines", ()):
        schema.routines[name] = Routine(name, kind, definition or "", language or "", returned or "", parameters[name])
    for name, table, timing, event, definition in found.get("triggers", ()):
        schema.triggers[name] = Trigger(name, table, timing, event, definition or "")
    for name, start, step, low, high, cache, cyclic in found.get("sequences", ()):
        schema.sequences[name] = Sequence(name, int(start), int(step), int(low), int(high), int(cache), bool(cyclic))
    return schema
