"""Reports of a comparison. Tables of any size are written by Spark; what a person reads is limited first and then rendered on the driver."""

from __future__ import annotations

import html
import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.canonical import display_value, truncated
from driftloom.operators import celldiff, resolve, rowdiff
from driftloom.plans.drift import Change, Drift, drift_text
from driftloom.sources import files

#: Keys listed per table and status in a report for reading.
SHOWN = 100


def write_json(path: str, value) -> None:
    """A small JSON file."""
    files.write_text(path, json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")


def write_schema_reports(drift: Drift, folder: str) -> None:
    """schema_diff.json and schema_diff.txt."""
    write_json(f"{folder}/schema_diff.json", drift.to_dict())
    files.write_text(f"{folder}/schema_diff.txt", drift_text(drift))


def write_content(diff: DataFrame, folder: str) -> None:
    """content_diff and conflicts as folders of JSON lines, sorted by table and key within range partitions."""
    ordered = diff.repartitionByRange("table", "status", "row_key").sortWithinPartitions("table", "status", "row_key")
    ordered.write.mode("overwrite").json(f"{folder}/content_diff")
    files.write_text(f"{folder}/content_diff.txt", content_text(diff))
    diff.where(F.col("status") == "updated").select("table", "row_key", "prod_hash", "dev_hash").write.mode("overwrite").json(f"{folder}/conflicts")


def content_text(diff: DataFrame, shown: int = SHOWN) -> str:
    """The differing keys of each table and status for reading, the first ones of each."""
    lines, last = [], None
    for r in celldiff.limit_keys(diff, shown).orderBy("table", "status", "row_key").collect():
        if (r["table"], r["status"]) != last:
            last = (r["table"], r["status"])
            lines.append(f"{r['table']}: {r['status']}")
        lines.append(f"  {r['row_key']}")
    return "\n".join(lines or ["No data differences found."]) + "\n"


def load_conflicts(spark, path: str) -> DataFrame:
    """The conflicts that a comparison wrote to a folder, as input of a resolution."""
    return spark.read.schema("table string, row_key string, prod_hash string, dev_hash string").json(path)


def summary_rows(diff: DataFrame) -> list[dict]:
    """Counts per table, one row each."""
    return [r.asDict() for r in rowdiff.diff_counts(diff).orderBy("table").collect()]


def summary_text(counts: list[dict], drift: bool, resolutions: dict[str, int] | None = None) -> str:
    """summary.txt: the schema's real status, counts per table and in all, decisions if there are any."""
    total = {s: sum(c[s] for c in counts) for s in ("added", "removed", "updated")}
    lines = [f"Schema: {'DRIFT' if drift else 'OK'}", f"Tables with changes: {sum(any(c[s] for s in total) for c in counts)}", *[f"{s.capitalize()} rows: {n}" for s, n in total.items()], ""]
    lines += [f"{c['table']}: +{c['added']} -{c['removed']} ~{c['updated']}" for c in counts]
    if resolutions:
        lines += ["", "Resolutions:", *[f"  {d}: {n}" for d, n in sorted(resolutions.items())]]
    return "\n".join(lines) + "\n"


def write_reports(diff: DataFrame, folder: str, drift: Drift, resolutions: DataFrame | None = None) -> list[dict]:
    """All files of a comparison: content, conflicts, summary and the summary of resolutions."""
    write_schema_reports(drift, folder)
    write_content(diff, folder)
    counts = summary_rows(diff)
    decided = None
    if resolutions is not None:
        rows = resolve.summary(resolutions).collect()
        decided = {r["decision"]: r["n"] for r in rows if r["decision"] is not None}
        by = lambda k: {r[k]: r["n"] for r in rows if r[k] is not None}
        write_json(f"{folder}/resolutions_summary.json", {"by_strategy": by("strategy"), "by_decision": decided, "by_table": by("table"), "total": sum(decided.values())})
    files.write_text(f"{folder}/summary.txt", summary_text(counts, bool(drift), decided))
    return counts


def _with_table(cells: DataFrame, table: str) -> DataFrame:
    return cells if "table" in cells.columns else cells.withColumn("table", F.lit(table))


def row_diff_text(cells: DataFrame, table: str = "", n: int = 1000) -> str:
    """The first n cells in columns for reading; a differing cell has a star."""
    lines = []
    last = None
    shown = [truncated(display_value(F.col(c)), 24).alias(c) for c in ("prod_value", "dev_value")]
    for r in _with_table(cells, table).orderBy("table", "row_key", F.lower("column")).limit(n).select("table", "row_key", "status", "column", *shown, "differs").collect():
        if (r["table"], r["row_key"], r["status"]) != last:
            last = (r["table"], r["row_key"], r["status"])
            lines.append(f"[{last[2]}] {last[0] + ': ' if last[0] else ''}{last[1]}")
        lines.append(f"  {r['column']:<20} {r['prod_value']:<24} {r['dev_value']:<24}{' *' if r['differs'] else ''}")
    return "\n".join(lines) + "\n"


def row_diff_json(cells: DataFrame, n: int = 1000) -> str:
    """The first n rows with nested cells as lines of JSON."""
    rows = celldiff.nested_report(cells).orderBy("table", "row_key").limit(n).toJSON()
    return "".join(x + "\n" for x in rows.collect())


def write_row_diff(cells: DataFrame, folder: str, text: bool = True) -> None:
    """row_diff as JSON lines with nested columns, and row_diff.txt for reading, of the tables that cells names."""
    celldiff.nested_report(cells).write.mode("overwrite").json(f"{folder}/row_diff")
    if text:
        files.write_text(f"{folder}/row_diff.txt", row_diff_text(cells))


def save_resolutions(resolutions: DataFrame, folder: str) -> None:
    """Resolutions beside earlier ones, then in their place, so that a run that reads and writes them never loses them."""
    import uuid

    part = f"resolutions-{uuid.uuid4().hex}"
    made = F.coalesce("created_at", F.current_timestamp()) if "created_at" in resolutions.columns else F.current_timestamp()
    resolutions.withColumn("created_at", made).write.parquet(f"{folder}/{part}")
    write_json(f"{folder}/resolutions.json", {"version": "1.0", "data": part})


def load_resolutions(spark, folder: str) -> DataFrame:
    own = json.loads(files.read_text(f"{folder}/resolutions.json"))
    if own["version"] != "1.0":
        raise ValueError(f"resolutions of version {own['version']}")
    return spark.read.parquet(f"{folder}/{own['data']}")


def decision_text(decision: str) -> str:
    """A decision for reading."""
    return {"keep_prod": "Keep Production", "use_dev": "Use Development", "pending": "Pending"}.get(decision, decision)


_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #ccc;padding:3px 8px;text-align:left}.added{background:#e6ffed}.removed{background:#ffeef0}.updated{background:#fff8e1}pre{background:#f6f8fa;padding:1em}"


def object_changes(prod: dict, dev: dict, change: Change) -> list[tuple]:
    """(name, attribute, prod's value, dev's, change) of views, routines, triggers or sequences that came, went or differ, each attribute that differs by itself."""
    rows = []
    for kind in ("added", "removed", "modified"):
        for name in getattr(change, kind):
            ours, theirs = (asdict(side[name]) if name in side else {} for side in (prod, dev))
            for attribute in ours or theirs:
                values = ours.get(attribute), theirs.get(attribute)
                if attribute != "name" and values[0] != values[1] and any(x not in (None, "", [], False) for x in values):
                    rows.append((name, attribute, *["" if x is None else ", ".join(" ".join(p) for p in x) if isinstance(x, list) else x for x in values], kind))
    return rows


def html_report(diff: DataFrame, drift: Drift, script: str = "", cells: DataFrame | None = None, resolutions: DataFrame | None = None, schemas: tuple | None = None, shown: int = SHOWN, title: str = "Comparison") -> str:
    """One page: counts, keys (the first ones of each table and status), cells, resolutions, schema drift and SQL."""
    e = lambda x: html.escape("" if x is None else str(x))
    table = lambda head, rows: "<table><tr>" + "".join(f"<th>{e(h)}</th>" for h in head) + "</tr>" + "".join(f'<tr class="{e(r[-1])}">' + "".join(f"<td>{e(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"
    counts = summary_rows(diff)
    keys = celldiff.limit_keys(diff, shown).select("table", "row_key", F.substring("prod_hash", 1, 12), F.substring("dev_hash", 1, 12), "status").orderBy("table", "status", "row_key").collect()
    parts = [f"<!doctype html><meta charset=utf-8><title>{e(title)}</title><style>{_STYLE}</style><h1>{e(title)}</h1>", f"<p>Schema: {'DRIFT' if drift else 'OK'}</p>", "<h2>Data</h2>", table(["table", "added", "removed", "updated"], [(c["table"], c["added"], c["removed"], c["updated"]) for c in counts]), "<h2>Keys</h2>", table(["table", "key", "prod", "dev", "status"], [tuple(r) for r in keys])]
    if cells is not None:
        first = _with_table(cells, "").where("differs").orderBy("table", "row_key", "column").limit(10 * shown).collect()
        parts += ["<h2>Cells</h2>", table(["table", "key", "column", "prod", "dev", "status"], [(r["table"], r["row_key"], r["column"], r["prod_value"], r["dev_value"], r["status"]) for r in first])]
    if resolutions is not None:
        own = resolve.breakdown(resolutions).orderBy("table").collect()
        parts += ["<h2>Resolutions</h2>", table(["table", "strategy", "keep prod", "use dev", "pending", "total"], [tuple(r) for r in own])]
        items = celldiff.limit_keys(resolutions.withColumn("status", F.col("decision")), shown).select("table", "row_key", "prod_hash", "dev_hash", "strategy", "decision")
        none = items.sparkSession.createDataFrame([], "table string, row_key string, column string, differs boolean")
        each = resolve.conflict_items(items.drop("strategy", "decision"), items, none if cells is None else _with_table(cells, "")).orderBy("table", "decision", "row_key").collect()
        parts += ["<h2>Conflicts</h2>", table(["table", "key", "prod", "dev", "strategy", "columns", "decision"], [(r["table"], r["row_key"], (r["prod_hash"] or "")[:12], (r["dev_hash"] or "")[:12], r["strategy"], ", ".join(r["columns"]), decision_text(r["decision"])) for r in each])]
    parts += ["<h2>Schema</h2>", f"<pre>{e(drift_text(drift))}</pre>"]
    if schemas:
        prod, dev = schemas
        column = lambda side, t, c: side.tables[t].columns[c].type_text if t in side.tables and c in side.tables[t].columns else ""
        rows = [(t, c, column(prod, t, c), column(dev, t, c), kind) for t, own in drift.tables.items() for kind in ("added", "removed", "modified") for c in getattr(own.columns, kind)]
        parts += [table(["table", "column", "prod", "dev", "change"], rows)] if rows else []
    for kind in ("views", "routines", "triggers", "sequences") if schemas else ():
        rows = object_changes(*(getattr(s, kind) for s in schemas), getattr(drift, kind))
        parts += [f"<h3>{kind.capitalize()}</h3>", table(["name", "attribute", "prod", "dev", "change"], rows)] if rows else []
    if script:
        parts += ["<h2>SQL</h2>", f"<pre>{e(script)}</pre>"]
    return "\n".join(parts) + "\n"
