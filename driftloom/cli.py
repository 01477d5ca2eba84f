"""Commands: check, schema-diff, schema-migrate, diff, row-diff, gen-pack, apply, resolve-conflicts and version."""

from __future__ import annotations

import argparse
import sqlite3
import sys
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.retry import DriftError
from driftloom.operators import celldiff, resolve
from driftloom.operators.patch import add_column_statements, read_pack, write_pack, write_pack_order
from driftloom.plans import history, packs, reports
from driftloom.plans.compare import Comparison
from driftloom.plans.dialects import Dialect
from driftloom.plans.migration import Gates, default_literal, migration_script, split_statements, without_transaction
from driftloom.sources import files
from driftloom.sources.config import load_config


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="driftloom")
    top.add_argument("--config", default="driftloom.yaml")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, *flags: [sub_ for sub_ in [sub.add_parser(name)] if [sub_.add_argument(f, **o) for f, o in flags] or True][0]
    flag, text = {"action": "store_true"}, {"default": None}
    sizes = [("--batch-size", {"type": int, "default": None, "dest": "fetch_size"}), ("--parallel", {"type": int, "default": None, "dest": "partitions"})]
    add("check", ("--counts", flag))
    add("schema-diff", ("--output-dir", text), ("--quiet", flag))
    add("schema-migrate", ("--dry-run", flag), ("--driver", text))
    add("diff", ("--html", flag), ("--row-diff", flag), ("--resume", flag), *sizes)
    add("row-diff", ("--table", text), ("--key", {"action": "append", "default": None}), ("--status", {"default": "updated", "choices": ["updated", "added", "removed", "all"]}), ("--limit", {"type": int, "default": None}), ("--output", text), ("--format", {"default": "table", "choices": ["table", "json"]}), *sizes)
    add("gen-pack", ("--html", flag), ("--resume", flag), ("--driver", text), ("--keep-rows", flag), *sizes)
    add("apply", ("--pack", {"required": True}), ("--dry-run", flag), ("--keep-rows", flag), ("--allow-dev-changes", flag))
    add("resolve-conflicts", ("--auto", {"choices": ["ours", "theirs", "manual"], "default": None}), ("--table", text), ("--key", text), ("--decision", {"choices": ["keep_prod", "use_dev", "pending"], "default": None}), ("--resume", flag), ("--conflicts", text), ("--resolutions", text))
    version = sub.add_parser("version").add_subparsers(dest="action", required=True)
    version.add_parser("init")
    for name, flags in {"commit": ("--message", "--author"), "log": ("--limit",), "diff": (), "rollback": ("--driver", "--out"), "branch": ("--from",), "checkout": (), "tree": ()}.items():
        own = version.add_parser(name)
        own.add_argument("names", nargs="*")
        for f in flags:
            own.add_argument(f, default=None)
    return top


def apply_sqlite(texts: Iterable[str], path: str, dry_run: bool = False) -> int:
    """Run a pack's texts, one at a time, against a SQLite file in one transaction, all or nothing; dry_run rolls it back. The number of statements."""
    db, n = sqlite3.connect(path, isolation_level=None), 0
    try:
        db.execute("BEGIN")
        try:
            for text in texts:
                for s in without_transaction(split_statements(text, "sqlite")):
                    db.execute(s)
                    n += 1
        except sqlite3.Error as e:
            db.execute("ROLLBACK")
            raise DriftError("APPLY_FAILED", str(e)) from e
        db.execute("ROLLBACK" if dry_run else "COMMIT")
    finally:
        db.close()
    return n


def _apply(args, own: Comparison) -> None:
    """Apply a pack to a SQLite file, to a folder of Parquet tables as its next version, or to a database in one transaction."""
    config, spark = own.config, own.spark
    if config.prod.driver == "sqlite":
        n = apply_sqlite(read_pack(spark, args.pack), config.prod.path or config.prod.database, args.dry_run)
        print(f"{n} statements {'checked' if args.dry_run else 'applied'}")
    elif config.prod.driver == "parquet":
        made = packs.apply_changes(own, f"{args.pack}/{packs.FOLDER}", args.dry_run, not args.keep_rows, args.allow_dev_changes)
        if made is None:
            print("applied before")
        elif args.dry_run:
            print(f"{len(made)} tables would change")
        else:
            print("\n".join(f"{table}: {len(parts)} parts" for table, parts in made.items()) or "nothing to change")
    else:
        for table, (gone, come) in packs.apply_database(own, f"{args.pack}/{packs.FOLDER}", args.dry_run, not args.keep_rows).items():
            print(f"{table}: {gone} rows deleted, {come} inserted{', then rolled back' if args.dry_run else ''}")


def _decisions(spark: SparkSession, own: Comparison, out: str, diff: DataFrame) -> DataFrame:
    """Saved decisions, brought up to the current conflicts, or else the configured policy's."""
    if files.exists(f"{out}/resolutions.json"):
        return resolve.merge_resolutions(reports.load_resolutions(spark, out), diff.where("status = 'updated'"))
    return own.resolutions(diff)


def _key_values(given: list[str], key: list[str]) -> dict[str, str]:
    """The values of --key, given once for each key column in its order; a single column's value may hold any character."""
    if len(given) != len(key):
        raise DriftError("CONFIG_INVALID", f"--key must be given {len(key)} times, for {', '.join(key)}")
    return dict(zip(key, given, strict=True))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; an error with a code is told with its hint."""
    try:
        return _run(_parser().parse_args(argv), spark)
    except DriftError as e:
        print(f"{e}\n{e.hint}", file=sys.stderr)
        return 2


def _run(args: argparse.Namespace, spark: SparkSession | None) -> int:
    config = load_config(args.config)
    out = config.output_dir.rstrip("/")
    spark = spark or SparkSession.builder.appName("driftloom").config("spark.scheduler.mode", "FAIR").getOrCreate()
    for name in ("fetch_size", "partitions"):
        if getattr(args, name, None):
            setattr(config, name, getattr(args, name))
    own = Comparison(spark, config)
    if args.command == "apply":
        _apply(args, own)
        return 0
    driver = getattr(args, "driver", None) or (config.prod.driver if config.prod.driver != "parquet" else "postgres")
    gates = Gates(**{k.removeprefix("allow_drop_"): v for k, v in config.allow.items() if k.removeprefix("allow_drop_") in Gates.__dataclass_fields__})
    if args.command == "check":
        missing = own.check()
        print("\n".join(f"no primary key: {t}" for t in missing) or "all tables have primary keys")
        if args.counts and not missing:
            for r in own.counts().orderBy("table", "side").collect():
                print(f"{r['table']} {r['side']}: {r['n_rows']} rows")
        return int(bool(missing))
    if args.command == "schema-diff":
        drift = own.drift()
        reports.write_schema_reports(drift, args.output_dir or out)
        if not args.quiet:
            print(reports.drift_text(drift), end="")
        return int(bool(drift))
    if args.command == "schema-migrate":
        script = migration_script(own.prod, own.dev, Dialect(driver), gates)
        if script and not args.dry_run:
            files.write_text(f"{out}/schema_migration.sql", script)
        print(script or "no drift")
        return 0
    if args.command == "row-diff":
        if args.key:
            name, (p, d, key) = own.pair(args.table or "")
            cells = celldiff.key_detail(p, d, _key_values(args.key, key), ignored=own.ignorer(name)).withColumn("table", F.lit(name))
        else:
            cells = own.cells(args.table, args.status, args.limit).withColumn("table", F.lit(own.pair(args.table)[0])) if args.table else own.row_cells(args.status, args.limit)
        reports.write_row_diff(cells, args.output or out)
        print(reports.row_diff_json(cells) if args.format == "json" else reports.row_diff_text(cells), end="")
        return 0
    if args.command == "diff":
        drift, diffs = own.drift(), own.run(args.resume)
        diff = own.union(diffs)
        counts = reports.write_reports(diff, out, drift, own.resolutions(diff))
        reports.write_json(f"{out}/metrics.json", own.metrics)
        cells = own.row_cells(diffs=diffs) if args.row_diff else None
        if args.row_diff:
            reports.write_row_diff(cells, f"{out}/row_diff")
        if args.html:
            files.write_text(f"{out}/report.html", reports.html_report(diff, drift, cells=cells, schemas=(own.prod, own.dev)))
        print(reports.summary_text(counts, bool(drift)), end="")
        return int(bool(drift))
    if args.command == "gen-pack":
        stamps, diffs = own.stamps(), own.run(args.resume, case_insensitive=False)
        diff, drift = own.union(diffs), own.drift()
        decided = _decisions(spark, own, out, diff)
        new = f"{out}/pack-{uuid.uuid4().hex}"
        scripts = own.packs(diffs, Dialect(driver), decided, not args.keep_rows)
        new_columns = [(t, c.name, c.data_type, c.is_nullable, None if c.default is None else default_literal(c.default)) for t in scripts for c in own.new_columns(t)]
        added = {}
        for r in add_column_statements(spark.createDataFrame(new_columns, "table string, column string, data_type string, is_nullable boolean, default_value string"), Dialect(driver)).collect():
            added.setdefault(r["table"], []).append(r["stmt"])  # a row for each column that dev's schema has and prod's has not
        for t, statements in scripts.items():
            write_pack(statements, ["phase", *own.prod.tables[t].primary_key], f"{new}/{t}", Dialect(driver), before=sorted(added.get(t, [])))
        write_pack_order(spark, list(scripts), new)
        if config.prod.driver != "sqlite":
            packs.write_changes(own, diffs, decided, f"{new}/{packs.FOLDER}", stamps)
        files.move(new, f"{out}/pack")  # whole, in the place of an earlier one
        reports.write_reports(diff, out, drift, decided)
        if args.html:
            files.write_text(f"{out}/report.html", reports.html_report(diff, drift, migration_script(own.prod, own.dev, Dialect(driver), gates), cells=own.row_cells(limit=reports.SHOWN, diffs=diffs), resolutions=decided, schemas=(own.prod, own.dev)))
        return 0
    if args.command == "resolve-conflicts":
        at, saved = args.conflicts or f"{out}/conflicts", (args.resolutions or out).rstrip("/")
        if args.conflicts and not files.exists(at):
            raise DriftError("FILE_FAILED", f"{at} holds no conflicts")
        # what a comparison wrote is not compared again
        current = reports.load_conflicts(spark, at) if files.exists(at) else own.union(own.diffs()).where("status = 'updated'").select("table", "row_key", "prod_hash", "dev_hash")
        fresh = own.resolutions(current.withColumn("status", F.lit("updated")))
        decided = resolve.merge_resolutions(reports.load_resolutions(spark, saved), current) if args.resume and files.exists(f"{saved}/resolutions.json") else fresh
        if args.auto:  # only what is still open
            decided = resolve.bulk_resolve(decided, args.auto, args.table)
        if args.decision:  # of one row, by its key as the reports show it
            decided = resolve.set_decision(decided, args.table or "", args.key or "", args.decision)
        reports.save_resolutions(decided, saved)
        return 0
    return _version(args, own, out, driver, gates)


def _version(args, own: Comparison, out: str, driver: str, gates: Gates) -> int:
    store, names = history.Store(out), getattr(args, "names", [])
    if args.action == "init":
        store.init()
    elif args.action == "commit":
        diff = own.union(own.run(case_insensitive=False))
        counts = {c.pop("table"): c for c in reports.summary_rows(diff)}
        print(store.save(history.Commit(args.message or "", args.author or "", history.now(), prod_schema=own.prod.to_dict(), dev_schema=own.dev.to_dict(), counts=counts, data=store.save_rows(diff))))
    elif args.action == "log":
        for c in store.log(int(args.limit or 20)):
            print(f"{c.hash[:8]} {c.timestamp} {c.author} {c.message}")
    elif args.action == "diff":
        print(reports.drift_text(store.diff(*names)), end="")
        changes = store.data_diff(own.spark, *names)
        changes.write.mode("overwrite").json(f"{out}/version_diff")
        for r in changes.groupBy("table", "change").count().orderBy("table", "change").collect():
            print(f"{r['table']}: {r['count']} rows {r['change']}")
    elif args.action == "rollback":
        script = store.rollback_script(names[0], Dialect(driver), gates)
        files.write_text(args.out or f"{out}/rollback.sql", script)
    elif args.action == "branch":
        if names:
            store.create_branch(names[0], vars(args)["from"] or "HEAD")
        else:
            print("\n".join(store.branches()))
    elif args.action == "checkout":
        store.checkout(names[0])
    else:
        print(store.tree(), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
