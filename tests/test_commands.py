"""Packs, commands, database reads and reports over whole comparisons."""

import json
import sqlite3
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftloom import cli
from driftloom.functions import canonical
from driftloom.functions.retry import DriftError, connected, retry
from driftloom.operators import patch, rowdiff
from driftloom.plans import migration, reports
from driftloom.plans.catalog import Column, Schema, Table
from driftloom.plans.compare import Comparison
from driftloom.plans.dialects import Dialect
from driftloom.plans.resume import Manifest, run_tables
from driftloom.sources import catalog_sql, introspect, staging, tables, versions, writes
from driftloom.sources import config as cfg

BYTES = [(1, b"abc"), (2, b"\xff\xfe"), (3, None), (4, b"\\xfffe"), (5, b""), (6, "é".encode())]


def test_binary_columns(spark):
    df = spark.createDataFrame(BYTES, "id int, v binary")
    text = {r["id"]: r["t"] for r in df.select("id", canonical.column_text(df, "v").alias("t")).collect()}
    assert text == {1: "abc", 2: "\\xfffe", 3: None, 4: "\\x" + b"\\xfffe".hex(), 5: "", 6: "é"}
    other = spark.createDataFrame([(i, b"\xff\xfe" if i == 4 else v) for i, v in BYTES], "id int, v binary")
    assert [r["id"] for r in rowdiff.row_diff(df, other, ["id"]).collect()] == [4]
    literal = lambda driver: {r["id"]: r["t"] for r in df.select("id", canonical.sql_literal(F.col("v"), df.schema["v"].dataType, driver=driver).alias("t")).collect()}
    assert [literal(d)[2] for d in ("mysql", "postgres", "mssql", "oracle", "sqlite")] == ["X'fffe'", "'\\xfffe'::bytea", "0xfffe", "HEXTORAW('fffe')", "X'fffe'"]
    assert literal("mysql")[3] == "NULL"


def test_backslashes_are_doubled_for_mysql_alone(spark):
    df = spark.createDataFrame([("C:\\'",)], "s string")
    literal = lambda driver: df.select(canonical.sql_literal(F.col("s"), df.schema["s"].dataType, driver=driver)).first()[0]
    assert (literal("mysql"), literal("postgres")) == (r"'C:\\'''", r"'C:\'''")


def test_statements_by_dialect():
    text = "INSERT INTO t VALUES ('C:\\'); INSERT INTO t VALUES ('D;');"
    assert migration.split_statements(text) == ["INSERT INTO t VALUES ('C:\\')", "INSERT INTO t VALUES ('D;')"]
    assert migration.split_statements(text, "postgres") == migration.split_statements(text)
    assert migration.split_statements("INSERT INTO t VALUES ('it\\'s; x'); SELECT 1;", "mysql") == ["INSERT INTO t VALUES ('it\\'s; x')", "SELECT 1"]


def test_types_as_ddl_takes_them():
    of = introspect.full_type
    assert [of("postgres", *x) for x in (("varchar", 255), ("numeric", None, 10, 2), ("numeric",), ("int4", None, 32, 0), ("_varchar", 9), ("float8", None, 53))] == ["varchar(255)", "numeric(10,2)", "numeric", "int4", "varchar(9)[]", "float8"]
    assert [of("mssql", *x) for x in (("nvarchar", 50), ("varbinary", -1), ("decimal", None, 9, 3), ("datetime2", None, None, None, 7), ("int", None, 10, 0))] == ["nvarchar(50)", "varbinary(max)", "decimal(9,3)", "datetime2(7)", "int"]
    assert [of("oracle", *x) for x in (("VARCHAR2", 20), ("NUMBER", 0, 10, 0), ("NUMBER", 0, 10), ("FLOAT", 0, 126), ("DATE", 0))] == ["varchar2(20)", "number(10,0)", "number(10)", "float(126)", "date"]
    assert of("mysql", "varchar(50)", 50) == "varchar(50)"
    rows = lambda n: introspect.fold_columns([("t", "a", 1, "varchar", "NO", None, 1, n, None, None, None)], "postgres")
    assert migration.migration_script(rows(50), rows(255), Dialect("postgres")).count("TYPE varchar(255) USING") == 1
    assert Column("a", "int", False).type_text == "int NOT NULL"


def test_sequences_of_older_servers(spark, monkeypatch):
    asked = []

    def answer(_, source, query):
        asked.append(query)
        if "pg_sequences" in query:
            raise ValueError("relation pg_sequences does not exist")
        rows = [("s", 1, 2, 1, 9, 0, 1)] if "information_schema.sequences" in query else []
        return spark.createDataFrame(rows, "a string, b long, c long, d long, e long, f long, g long")

    monkeypatch.setattr(introspect, "jdbc_query", answer)
    schema = introspect.jdbc_schema(spark, cfg.Source("postgres", "h", database="d"))
    assert schema.sequences["s"].increment == 2 and schema.sequences["s"].is_cyclic and len(asked) == len(catalog_sql.queries("postgres", "public")) + 2


def make(path, rows, orders=()):
    with sqlite3.connect(path) as db:
        db.executescript("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT, secret TEXT); CREATE TABLE orders (id INTEGER PRIMARY KEY, user_id INTEGER REFERENCES users (id), note TEXT);")
        db.executemany("INSERT INTO users VALUES (?, ?, ?)", rows)
        db.executemany("INSERT INTO orders VALUES (?, ?, ?)", orders)


def config(tmp_path, prod, dev, more=""):
    (tmp_path / "c.yaml").write_text(f"prod: {{driver: {prod[0]}, path: {prod[1]}}}\ndev: {{driver: {dev[0]}, path: {dev[1]}}}\noutput: {{dir: {tmp_path / 'out'}}}\nconflict_resolution: {{default_strategy: theirs}}\n{more}")
    return lambda spark, *a: cli.main(["--config", str(tmp_path / "c.yaml"), *a], spark)


def test_whole_pack_brings_prod_to_dev(spark, tmp_path):
    """New columns, rows, changes and removals of two tables that refer to each other, with the keys enforced: then nothing differs."""
    prod, dev = str(tmp_path / "p.db"), str(tmp_path / "d.db")
    make(prod, [(1, "a", None), (2, "b\r\nc;'", None), (3, "gone", None)], [(1, 1, "x"), (2, 3, "y"), (5, 2, "same")])
    make(dev, [(1, "a2", None), (2, "b\r\nc;'", None), (4, "new -- row", None)], [(1, 1, "C:\\"), (3, 4, "z\r\n;"), (5, 2, "same")])
    with sqlite3.connect(dev) as db:
        db.executescript("ALTER TABLE orders ADD COLUMN city TEXT; UPDATE orders SET city = 'c' || id;")
    run = config(tmp_path, ("sqlite", prod), ("sqlite", dev))
    assert run(spark, "gen-pack") == 0
    texts = list(patch.read_pack(spark, str(tmp_path / "out" / "pack")))
    script = "".join(texts)
    assert script.index('DELETE FROM "orders"') < script.index('DELETE FROM "users"') < script.index('INSERT INTO "users"') < script.index('INSERT INTO "orders"')
    db = sqlite3.connect(prod, isolation_level=None)
    db.execute("PRAGMA foreign_keys = ON")
    db.execute("BEGIN")
    for s in (s for t in texts for s in migration.without_transaction(migration.split_statements(t))):
        db.execute(s)
    db.execute("ROLLBACK")
    db.close()
    assert run(spark, "apply", "--pack", str(tmp_path / "out" / "pack"), "--dry-run") == 0
    assert run(spark, "apply", "--pack", str(tmp_path / "out" / "pack")) == 0
    own = Comparison(spark, cfg.load_config(str(tmp_path / "c.yaml")))
    assert own.union(own.diffs()).isEmpty() and not own.drift()
    assert sorted((r["table"], r["side"], r["n_rows"]) for r in own.counts().collect()) == [("orders", "dev", 3), ("orders", "prod", 3), ("users", "dev", 3), ("users", "prod", 3)]


def test_ignored_columns_stay_out_of_packs_and_cells(spark, tmp_path):
    prod, dev = str(tmp_path / "p.db"), str(tmp_path / "d.db")
    make(prod, [(1, "a", "p1")])
    make(dev, [(1, "b", "d1"), (2, "c", "d2")])
    run = config(tmp_path, ("sqlite", prod), ("sqlite", dev), "ignore: {columns: [users.secret]}\n")
    assert run(spark, "gen-pack") == 0 and run(spark, "row-diff", "--table", "users", "--format", "json", "--status", "all") == 0
    assert "secret" not in "".join(patch.read_pack(spark, str(tmp_path / "out" / "pack"))) and "d1" not in (tmp_path / "out" / "row_diff.txt").read_text()


def test_commands_over_all_tables(spark, tmp_path, capsys):
    prod, dev = str(tmp_path / "p.db"), str(tmp_path / "d.db")
    make(prod, [(1, "a", None)], [(1, 1, "x")])
    make(dev, [(1, "b", None)], [(1, 1, "y")])
    run = config(tmp_path, ("sqlite", prod), ("sqlite", dev))
    assert run(spark, "check", "--counts") == 0 and "users prod: 1 rows" in capsys.readouterr().out
    assert run(spark, "row-diff", "--batch-size", "100", "--parallel", "2") == 0
    assert "[updated] orders: 1" in capsys.readouterr().out
    assert run(spark, "row-diff", "--table", "users", "--key", "1", "--format", "json") == 0
    row = json.loads(capsys.readouterr().out)
    assert (row["table"], row["row_key"], row["status"]) == ("users", "1", "updated")
    assert run(spark, "row-diff", "--table", "users", "--key", "1", "--key", "2") == 2 and run(spark, "row-diff", "--table", "none") == 2
    assert run(spark, "diff", "--html", "--row-diff") == 0
    assert "<h2>Cells</h2>" in (tmp_path / "out" / "report.html").read_text() and "users: updated" in (tmp_path / "out" / "content_diff.txt").read_text()
    assert set(json.loads((tmp_path / "out" / "metrics.json").read_text())) == {"orders", "users"}
    assert reports.load_conflicts(spark, str(tmp_path / "out" / "conflicts")).count() == 2
    assert run(spark, "resolve-conflicts") == 0
    first = {r["table"]: r["created_at"] for r in reports.load_resolutions(spark, str(tmp_path / "out")).collect()}
    assert run(spark, "resolve-conflicts", "--resume", "--table", "users", "--key", "1", "--decision", "keep_prod") == 0
    decided = {r["table"]: r for r in reports.load_resolutions(spark, str(tmp_path / "out")).collect()}
    assert (decided["users"]["decision"], decided["orders"]["decision"]) == ("keep_prod", "use_dev") and {t: r["created_at"] for t, r in decided.items()} == first
    elsewhere = str(tmp_path / "decided")
    spark.createDataFrame([("users", "9", "p", "d")], "table string, row_key string, prod_hash string, dev_hash string").write.json(str(tmp_path / "given"))
    assert run(spark, "resolve-conflicts", "--conflicts", str(tmp_path / "given"), "--resolutions", elsewhere, "--auto", "ours") == 0
    assert [(r["row_key"], r["decision"]) for r in reports.load_resolutions(spark, elsewhere).collect()] == [("9", "use_dev")]  # the policy decided before
    assert run(spark, "resolve-conflicts", "--conflicts", str(tmp_path / "given"), "--resolutions", elsewhere, "--resume", "--table", "users", "--key", "9", "--decision", "keep_prod") == 0
    assert [r["decision"] for r in reports.load_resolutions(spark, elsewhere).collect()] == ["keep_prod"]
    assert run(spark, "resolve-conflicts", "--conflicts", str(tmp_path / "nowhere")) == 2
    assert run(spark, "gen-pack", "--html") == 0
    assert 'INSERT INTO "users"' not in "".join(patch.read_pack(spark, str(tmp_path / "out" / "pack")))
    assert "Keep Production" in (tmp_path / "out" / "report.html").read_text()


def test_tables_that_differ_in_case_and_no_shared_table(spark, tmp_path):
    for side, name in (("p", "t"), ("d", "T"), ("d", "other")):
        spark.range(3 if side == "p" else 4).withColumnRenamed("id", "k").write.parquet(str(tmp_path / side / f"{name}.parquet"))
    raw = {"prod": {"path": str(tmp_path / "p")}, "dev": {"path": str(tmp_path / "d")}, "primary_keys": {"t": ["k"], "other": ["k"]}, "output": {"dir": str(tmp_path / "o")}}
    own = Comparison(spark, cfg.parse_config(raw))
    assert own.union(own.diffs()).count() == 1
    exact = own.run(case_insensitive=False)
    assert exact == {} and own.packs(exact, Dialect("postgres")) == {} and own.union(exact).isEmpty() and own.row_cells("removed").isEmpty()


def sides(spark, tmp_path, prod, dev, more=""):
    """Parquet sides of one table t (k, v), in several files by key, and the commands over them."""
    for side, rows in (("p", prod), ("d", dev)):
        write_side(spark, tmp_path, side, rows)
    return config(tmp_path, ("parquet", tmp_path / "p"), ("parquet", tmp_path / "d"), "primary_keys: {t: [k]}\n" + more)


def write_side(spark, tmp_path, side, rows, schema="k int, v string", table="t"):
    spark.createDataFrame(rows, schema).repartitionByRange(3, "k").write.mode("overwrite").parquet(str(tmp_path / side / f"{table}.parquet"))


def held(spark, tmp_path, side="p", table="t"):
    return sorted(map(tuple, versions.read(spark, str(tmp_path / side), table).collect()))


def test_parquet_apply(spark, tmp_path, capsys):
    """A pack with a new column becomes the folder's next version, which readers see; then nothing differs, and applying again does nothing."""
    run = sides(spark, tmp_path, [(1, "a"), (2, "b"), (3, "c")], [])
    write_side(spark, tmp_path, "d", [(1, "a", 7), (2, "x", 8), (4, "d", 9)], "k int, v string, w int")
    pack = str(tmp_path / "out" / "pack")
    assert run(spark, "gen-pack") == 0 and run(spark, "apply", "--pack", pack, "--dry-run") == 0 and "1 tables" in capsys.readouterr().out
    assert held(spark, tmp_path) == [(1, "a"), (2, "b"), (3, "c")]
    assert run(spark, "apply", "--pack", pack) == 0
    assert held(spark, tmp_path) == [(1, "a", 7), (2, "x", 8), (4, "d", 9)]
    own = Comparison(spark, cfg.load_config(str(tmp_path / "c.yaml")))
    assert own.union(own.diffs()).isEmpty() and not own.drift() and run(spark, "diff", "--resume") == 0
    assert run(spark, "apply", "--pack", pack) == 0 and "applied before" in capsys.readouterr().out
    assert versions.current(str(tmp_path / "p")).number == 1


def test_parquet_apply_refuses_what_it_was_not_made_from(spark, tmp_path, capsys):
    """Neither stale differences nor another pack's name may write anything."""
    run = sides(spark, tmp_path, [(1, "a"), (2, "b")], [(1, "a"), (2, "z")])
    pack = str(tmp_path / "out" / "pack")
    assert run(spark, "diff") == 0
    assert run(spark, "apply", "--pack", "nonsense") == 2 and "PACK_MISSING" in capsys.readouterr().err
    assert run(spark, "gen-pack") == 0
    write_side(spark, tmp_path, "d", [(1, "NEW"), (2, "z"), (9, "added")])
    assert run(spark, "apply", "--pack", pack) == 2 and "BASE_CHANGED" in capsys.readouterr().err and held(spark, tmp_path) == [(1, "a"), (2, "b")]
    assert run(spark, "gen-pack", "--resume") == 0 and run(spark, "apply", "--pack", pack) == 0  # other input files: nothing is resumed
    assert held(spark, tmp_path) == [(1, "NEW"), (2, "z"), (9, "added")]
    write_side(spark, tmp_path, "d", [(1, "a")])
    assert run(spark, "gen-pack") == 0
    write_side(spark, tmp_path, "d", [(1, "later")])
    assert run(spark, "apply", "--pack", pack, "--keep-rows", "--allow-dev-changes") == 0 and held(spark, tmp_path) == [(1, "a"), (2, "z"), (9, "added")]
    write_side(spark, tmp_path, "d", [(1, "a"), (3, "c")])
    assert run(spark, "gen-pack") == 0
    assert versions.commit(str(tmp_path / "p"), versions.current(str(tmp_path / "p")), {"t": ["t.parquet"]}, "x").number == 3  # another run came first
    assert run(spark, "apply", "--pack", pack) == 2 and held(spark, tmp_path) == [(1, "a"), (2, "b")]


def test_two_writers_of_a_version(spark, tmp_path):
    write_side(spark, tmp_path, "p", [(1, "a")])
    base = versions.current(str(tmp_path / "p"))
    versions.commit(str(tmp_path / "p"), base, {}, "one")
    with pytest.raises(DriftError, match="BASE_CHANGED"):
        versions.commit(str(tmp_path / "p"), base, {}, "two")
    assert versions.current(str(tmp_path / "p")).applied == ("one",) and len(list((tmp_path / "p" / "_versions").iterdir())) == 1


def test_parquet_apply_rewrites_only_touched_files(spark, tmp_path):
    """All tables change at once; of a table, files without a key that goes are kept as they are, and names may hold odd signs."""
    run = sides(spark, tmp_path, [(i, "a") for i in range(30)], [(i, "b" if i == 3 else "a") for i in range(31)], "")
    for side in "pd":
        write_side(spark, tmp_path, side, [(1, side)], table="odd name%")
    (tmp_path / "c.yaml").write_text((tmp_path / "c.yaml").read_text().replace("{t: [k]}", "{t: [k], 'odd name%': [k]}"))
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "p" / "t.parquet").glob("part*")}
    assert run(spark, "gen-pack") == 0 and run(spark, "apply", "--pack", str(tmp_path / "out" / "pack")) == 0
    assert held(spark, tmp_path) == held(spark, tmp_path, "d") and held(spark, tmp_path, table="odd name%") == [(1, "d")]
    parts = versions.current(str(tmp_path / "p")).tables["t"]
    assert len(parts) == 3 and sum(p.startswith("t.parquet/part") for p in parts) == 2
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "p" / "t.parquet").glob("part*")}
    write_side(spark, tmp_path, "d", [(i, "a") for i in range(2, 29)])
    assert run(spark, "gen-pack") == 0 and run(spark, "apply", "--pack", str(tmp_path / "out" / "pack")) == 0
    assert held(spark, tmp_path) == held(spark, tmp_path, "d")


def test_gen_pack_twice(spark, tmp_path):
    """A second pack replaces the first whole."""
    prod, dev = str(tmp_path / "p.db"), str(tmp_path / "d.db")
    make(prod, [(1, "a", None)], [(1, 1, "x")])
    make(dev, [(1, "b", None)], [(1, 1, "y")])
    run = config(tmp_path, ("sqlite", prod), ("sqlite", dev))
    assert run(spark, "gen-pack") == 0
    with sqlite3.connect(dev) as db:
        db.execute("UPDATE users SET name = 'c'")
        db.execute("UPDATE orders SET note = 'x'")
    assert run(spark, "gen-pack", "--resume") == 0
    script = "".join(patch.read_pack(spark, str(tmp_path / "out" / "pack")))
    assert "'c'" in script and "'b'" not in script and "'y'" not in script
    assert sum(p.name.startswith("pack") for p in (tmp_path / "out").iterdir()) == 1


def derby(tmp_path, monkeypatch):
    """The embedded database that comes with Spark, in the place of a network one."""
    monkeypatch.setattr(tables, "jdbc_url", lambda _: f"jdbc:derby:{tmp_path / 'db'};create=true")
    return cfg.Source("postgres", "h", database="d", user="u", password="p")


def test_apply_to_a_database(spark, tmp_path, monkeypatch):
    """Two tables that refer to each other, changed in one transaction or not at all; what was counted must be there."""
    source = derby(tmp_path, monkeypatch)
    db = writes.Connection(spark, source)
    db.run('CREATE TABLE "a" ("k" VARCHAR(9) PRIMARY KEY, "v" INT)')
    db.run('CREATE TABLE "b" ("k" INT PRIMARY KEY, "a" VARCHAR(9) REFERENCES "a" ("k"), "w" VARCHAR(20) CHECK ("w" <> \'bad\'))')
    db.run("INSERT INTO \"a\" VALUES ('x', 1), ('y', 2), ('it''s', 3)")
    db.run("INSERT INTO \"b\" VALUES (1, 'x', 'one'), (2, 'y', 'two')")
    held = lambda t: sorted(map(tuple, tables.read_table(spark, source, t).collect()))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    before = held("a"), held("b")
    gone_a, come_a = frame([("y",), ("it's",)], "k string"), frame([("it's", 30), ("z", 4)], "k string, v int")
    changes = lambda word: {"a": (gone_a, come_a, ["k"]), "b": (frame([(2,)], "k int"), frame([(2, "z", word), (3, "it's", "n")], "k int, a string, w string"), ["k"])}
    with pytest.raises(DriftError, match="APPLY_FAILED"):
        writes.apply_to_database(spark, source, changes("bad"))
    assert (held("a"), held("b")) == before
    assert writes.apply_to_database(spark, source, changes("new"), dry_run=True) == {"a": (2, 2), "b": (1, 2)} and (held("a"), held("b")) == before
    assert writes.apply_to_database(spark, source, changes("new")) == {"a": (2, 2), "b": (1, 2)}
    assert held("a") == [("it's", 30), ("x", 1), ("z", 4)] and held("b") == [(1, "x", "one"), (2, "z", "new"), (3, "it's", "n")]
    with pytest.raises(DriftError, match="BASE_CHANGED"):  # y went before
        writes.apply_to_database(spark, source, {"a": (gone_a.where("k = 'y'"), come_a.limit(0), ["k"])})
    assert held("a") == [("it's", 30), ("x", 1), ("z", 4)]
    assert not tables.jdbc_query(spark, source, "SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLENAME LIKE 'dl%'").count()
    db.own.close()


def test_pack_of_a_database(spark, tmp_path, monkeypatch, capsys):
    """gen-pack and apply against a database whose catalog is given: then nothing differs."""
    source = derby(tmp_path, monkeypatch)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    rows.write.format("jdbc").options(url=tables.jdbc_url(source), dbtable='"t"', user="u", password="p", createTableColumnTypes="v VARCHAR(20)").save()
    write_side(spark, tmp_path, "d", [(1, "a"), (2, "x"), (4, "d")])
    (tmp_path / "c.yaml").write_text(f"prod: {{driver: postgres, host: h, database: d, user: u, password: p}}\ndev: {{path: {tmp_path / 'd'}}}\noutput: {{dir: {tmp_path / 'out'}}}\nprimary_keys: {{t: [k]}}\nconflict_resolution: {{default_strategy: theirs}}\n")
    columns = {"k": Column("k", "int", False), "v": Column("v", "string")}
    monkeypatch.setattr(introspect, "jdbc_schema", lambda *_: Schema({"t": Table("t", columns, ["k"])}))
    run = lambda *a: cli.main(["--config", str(tmp_path / "c.yaml"), *a], spark)
    assert run("apply", "--pack", str(tmp_path / "out" / "pack")) == 2 and run("gen-pack") == 0
    assert run("apply", "--pack", str(tmp_path / "out" / "pack")) == 0 and "t: 2 rows deleted, 2 inserted" in capsys.readouterr().out
    own = Comparison(spark, cfg.load_config(str(tmp_path / "c.yaml")))
    assert own.union(own.diffs()).isEmpty() and own.stamps() is None
    assert run("apply", "--pack", str(tmp_path / "out" / "pack")) == 2  # key 3 is gone, so prod is not what the pack was made from


def test_database_keys_are_cut_at_their_quantiles(spark, tmp_path, monkeypatch):
    """Text and composite keys with skew: each row is read once, in parts of about one size."""
    source = derby(tmp_path, monkeypatch)
    rows = [("a", i, "v") for i in range(90)] + [(f"it's {i}", 0, "v") for i in range(10)]
    spark.createDataFrame(rows, "k string, n int, v string").write.format("jdbc").options(url=tables.jdbc_url(source), dbtable='"s"', user="u", password="p", createTableColumnTypes="k VARCHAR(20), v VARCHAR(5)").save()
    own = tables.read_table(spark, source, "s", ["k", "n"], partitions=5)
    sizes = [r["count"] for r in own.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sizes == [20] * 5 and sorted((r["k"], r["n"]) for r in own.collect()) == sorted(r[:2] for r in rows)
    text = tables.read_table(spark, source, "s", ["k"], partitions=4)  # one value holds most rows
    assert sorted((r["k"], r["n"]) for r in text.collect()) == sorted(r[:2] for r in rows)
    assert tables.quantile_predicates(spark, source, "s", ["k"], 3) == ["(((\"k\" < 'a') OR (\"k\" = 'a')) OR \"k\" IS NULL)", "((\"k\" > 'a'))"]


def test_duplicate_keys_are_refused(spark, tmp_path):
    for side in "pd":
        spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string").write.parquet(str(tmp_path / side / "t.parquet"))
    raw = {"prod": {"path": str(tmp_path / "p")}, "dev": {"path": str(tmp_path / "d")}, "primary_keys": {"t": ["k"]}}
    with pytest.raises(DriftError, match=r"DUPLICATE_KEY.*\(1,\)"):
        Comparison(spark, cfg.parse_config(raw)).diffs()
    assert Comparison(spark, cfg.parse_config(raw | {"performance": {"check_keys": False}})).diffs()["t"].count() > 0


def test_database_tables_are_read_in_parts(spark, tmp_path, monkeypatch):
    """Against the embedded database that comes with Spark: integer keys by ranges, others by conditions, and what is sent to the source."""
    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    monkeypatch.setattr(tables, "jdbc_url", lambda _: url)
    source = cfg.Source("postgres", "h", database="d", user="u", password="p")
    df = spark.range(1, 101).selectExpr("id AS k", "concat('v', id) AS v")
    df.write.format("jdbc").options(url=url, dbtable='"t"', user="u", password="p", createTableColumnTypes="v VARCHAR(20)").save()
    own = tables.read_table(spark, source, "t", ["k"], partitions=4, fetch_size=7)
    parts = own.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert own.count() == 100 and len(parts) == 4 and max(r["count"] for r in parts) <= 26
    assert tables.jdbc_options(source, "t", ("k", 1, 9), 4, 7) == {"url": url, "dbtable": '"t"', "user": "u", "password": "p", "fetchsize": "7", "connectTimeout": "5", "partitionColumn": '"k"', "lowerBound": "1", "upperBound": "9", "numPartitions": "4"}
    by_text = tables.read_table(spark, source, "t", ["v"], partitions=3)
    assert by_text.rdd.getNumPartitions() == 3 and by_text.count() == 100
    assert tables.read_table(spark, source, "t").rdd.getNumPartitions() == 1
    assert tables.hash_predicates("mysql", ["a", "b"], 2)[1] == "MOD(CRC32(CONCAT(`a`, `b`)), 2) = 1"
    assert rowdiff.row_diff(own, own.where("k <> 5"), ["k"]).count() == 1


def test_connections_are_tried_again():
    calls, slept = [], []

    def call(text):
        calls.append(text)
        raise ValueError(text)

    for text in ("Connection refused", "FATAL: password authentication failed", "syntax error"):
        with pytest.raises(DriftError if "syntax" not in text else ValueError):
            retry(lambda: connected(lambda: call(text)), sleep=slept.append)  # noqa: B023
    assert [calls.count(x) for x in sorted(set(calls))] == [3, 1, 1] and slept == [1.0, 2.0]


def test_metrics_and_scratch(spark, tmp_path):
    seen = {}
    run_tables(spark, Manifest(str(tmp_path / "m"), "f"), {"a": spark.range(30)}, metrics=seen)
    assert seen["a"]["rows"] == 30 and seen["a"]["rows_per_second"] > 0
    folder = lambda df: Path(df.inputFiles()[0].removeprefix("file://")).parent
    with staging.scratch(spark):
        with staging.scratch(spark):
            inner, lasting = staging.stage(spark.range(3), "x"), staging.stage(spark.range(4), "y", lasting=True)
            assert inner.count() == 3
        inner_folder, lasting_folder = folder(inner), folder(lasting)
        assert lasting.count() == 4 and lasting_folder.exists() and not inner_folder.exists()
    assert not lasting_folder.exists()
