import contextlib
import io
import sqlite3

import pytest

from driftloom.functions.retry import DriftError, retry
from driftloom.operators import schemadiff
from driftloom.plans import history, migration, ordering, reports
from driftloom.plans.catalog import Column, ForeignKey, Index, Routine, Schema, Sequence, Table, Trigger, View
from driftloom.plans.dialects import Dialect
from driftloom.plans.drift import drift_text, schema_drift
from driftloom.plans.resume import Manifest, run_tables
from driftloom.sources import config as cfg
from driftloom.sources import catalog_sql, introspect, tables


def users(*extra: Column, **more) -> Table:
    own = [Column("id", "int", False), Column("name", "varchar(50)"), *extra]
    return Table("users", {c.name: c for c in own}, ["id"], **more)


def two(dev: Table) -> tuple[Schema, Schema]:
    return Schema({"users": users()}), Schema({"users": dev})


def script(prod, dev, driver="postgres", **gates):
    return migration.migration_script(prod, dev, Dialect(driver), migration.Gates(**gates))


def test_no_drift_no_script():
    assert script(*two(users())) == ""
    assert drift_text(schema_drift(*two(users()))).startswith("No schema drift")


def test_forms_that_are_equal():
    prod, dev = Schema({"t": Table("t", {"a": Column("a", "INT ", True, "'x'")})}), Schema({"t": Table("t", {"a": Column("a", "int", True, "x")})})
    assert not schema_drift(prod, dev)
    dev.tables["t"].columns["a"].default = None
    assert schema_drift(prod, dev).tables["t"].columns.modified == ["a"]


@pytest.mark.parametrize(("driver", "text"), [("mysql", "ALTER TABLE `users` ADD COLUMN `age` int"), ("postgres", 'ALTER TABLE "users" ADD COLUMN "age" int'), ("mssql", "ALTER TABLE [users] ADD [age] int"), ("oracle", 'ALTER TABLE "users" ADD "age" int')])
def test_add_column(driver, text):
    assert text in script(*two(users(Column("age", "int"))), driver)


@pytest.mark.parametrize(("driver", "text"), [("mysql", "MODIFY COLUMN `name` varchar(255)"), ("postgres", 'ALTER COLUMN "name" TYPE varchar(255)'), ("mssql", "ALTER COLUMN [name] varchar(255)"), ("oracle", 'MODIFY ("name" varchar(255))'), ("sqlite", "-- SQLite can't modify")])
def test_modify_column(driver, text):
    dev = users()
    dev.columns["name"] = Column("name", "varchar(255)")
    assert text in script(*two(dev), driver)


def test_drops_are_comments_unless_allowed():
    dev, prod = two(users(Column("age", "int")))
    assert '\n-- ALTER TABLE "users" DROP COLUMN "age";' in script(prod, dev)
    assert '\nALTER TABLE "users" DROP COLUMN "age";' in script(prod, dev, columns=True)
    assert "-- DROP TABLE" in script(prod, Schema()) and "\nDROP TABLE" in script(prod, Schema(), tables=True)


def test_indexes_and_foreign_keys():
    key = ForeignKey("fk_o", ["user_id"], "users", ["id"], "cascade")
    orders = Table("orders", {"id": Column("id", "int", False), "user_id": Column("user_id", "int")}, ["id"], {"i": Index("i", ["user_id"], True)}, {"fk_o": key})
    text = script(Schema(), Schema({"orders": orders, "users": users()}), "mysql")
    assert text.index("CREATE TABLE `users`") < text.index("CREATE TABLE `orders`") < text.index("ADD CONSTRAINT `fk_o`")
    assert "CREATE UNIQUE INDEX `i` ON `orders` (`user_id`);" in text and "ON DELETE CASCADE" in text and "ENGINE=InnoDB" in text
    gone = script(Schema({"orders": orders, "users": users()}), Schema(), tables=True)
    assert gone.index('DROP TABLE "orders"') < gone.index('DROP TABLE "users"')


def test_key_change_waits_for_confirmation():
    dev = users()
    dev.primary_key = ["id", "name"]
    assert '-- ALTER TABLE "users" ADD PRIMARY KEY ("id", "name");' in script(*two(dev))
    assert '\nALTER TABLE "users" DROP CONSTRAINT "users_pkey";' in script(*two(dev), confirm=False)


def test_other_objects():
    prod = Schema(views={"v": View("v", "select 1", True)}, sequences={"s": Sequence("s")})
    dev = Schema(views={"v": View("v", "select 2", True)}, triggers={"t": Trigger("t", "users", "AFTER", "INSERT", "CREATE TRIGGER t AFTER INSERT ON users BEGIN END")}, sequences={"s": Sequence("s", cache_size=20)})
    text = script(prod, dev)
    assert 'DROP MATERIALIZED VIEW IF EXISTS "v";' in text and "CREATE TRIGGER t" in text and "CACHE 20" in text
    dev.triggers["t"].definition = " "
    with pytest.raises(ValueError, match="no definition"):
        script(prod, dev)
    assert not schema_drift(Schema(views={"v": View("v", "SELECT  1")}), Schema(views={"v": View("v", "select 1")}))


def test_cycles_are_reported_not_fatal():
    refs = {"a": {"b"}, "b": {"a"}, "c": {"a"}}
    assert ordering.created_in_order(["a", "b", "c"], refs) == ["a", "b", "c"]
    order, cycle = ordering.topological_order(ordering.dependency_graph([ordering.Operation("create_table", t) for t in "abc"], refs))
    assert len(order) == 3 and len(cycle) == 3
    assert ordering.dropped_in_order(["a", "b"], {"b": {"a"}}) == ["b", "a"]


def test_statements():
    text = "BEGIN;\nINSERT INTO t VALUES ('a;b', \"c;d\"); -- note; more\n/* x; y */ UPDATE t SET a = 'it''s; fine';\nCOMMIT;"
    own = migration.split_statements(text)
    assert own == ["BEGIN", "INSERT INTO t VALUES ('a;b', \"c;d\")", "UPDATE t SET a = 'it''s; fine'", "COMMIT"]
    assert len(migration.without_transaction(own)) == 2


def test_catalog_rows_agree_with_the_model(spark):
    prod, dev = two(users(Column("age", "int")))
    found = schemadiff.diff_columns(prod.column_rows(spark), dev.column_rows(spark)).collect()
    assert [(r["table"], r["column"], r["change"]) for r in found] == [("users", "age", "added")]
    assert not schemadiff.has_drift(schemadiff.diff_primary_keys(prod.column_rows(spark), dev.column_rows(spark)))


def test_version_rows(spark, tmp_path):
    """Commits share the chunks whose rows are the same; only others are written and read."""
    store = history.Store(str(tmp_path))
    store.init()
    schema = "table string, row_key string, status string, prod_hash string, dev_hash string"
    rows = [("t", str(i), "updated", f"p{i}", f"d{i}") for i in range(200)] + [("u", "1", "added", None, "x"), ("u", "2", "removed", "y", None)]
    later = [r if r[1] != "7" else ("t", "7", "removed", "p7", None) for r in rows if r[:2] != ("u", "2")] + [("u", "3", "added", None, "z")]
    empty = spark.createDataFrame([], schema)
    names = [store.save(history.Commit(str(n), "me", f"2024-01-0{n}", data=store.save_rows(spark.createDataFrame(own, schema), 16))) for n, own in ((1, rows), (2, later), (3, rows))]
    names.append(store.save(history.Commit("4", "me", "2024-01-04", data=store.save_rows(empty))))
    one, two, three, four = (store.load(n).data for n in names)
    assert one == three and four == {} and len(one["t"]) == 16 and len(set(one["t"]) & set(two["t"])) == 15 and not set(one["u"]) & set(two["u"])
    assert len(list((tmp_path / ".driftloom" / "chunks").iterdir())) == 16 + 1 + 1 + 1
    assert sorted(map(tuple, store.rows(spark, names[1]).collect()), key=str) == sorted(later, key=str)
    changed = {(r["table"], r["row_key"]): (r["change"], r["old_status"], r["new_status"], r["new_dev_hash"]) for r in store.data_diff(spark, names[0], names[1]).collect()}
    assert changed == {("t", "7"): ("changed", "updated", "removed", None), ("u", "2"): ("resolved", "removed", None, None), ("u", "3"): ("appeared", None, "added", "z")}
    assert store.data_diff(spark, names[0], names[2]).isEmpty() and store.data_diff(spark, names[0], names[3]).count() == 202


def test_version_rows_of_many_chunks(spark, tmp_path):
    """Many small chunks share folders, whose number is bounded; they are still known, kept and read one by one."""
    store = history.Store(str(tmp_path))
    store.init()
    schema = "table string, row_key string, status string, prod_hash string, dev_hash string"
    rows = [("t", str(i), "updated", f"p{i}", f"d{i}") for i in range(2000)]
    later = [r if r[1] != "7" else ("t", "7", "removed", "p7", None) for r in rows]
    save = lambda m, own: store.save(history.Commit(m, "me", m, data=store.save_rows(spark.createDataFrame(own, schema), 2)))
    names = [save("1", rows)]
    folders = lambda: len(list((tmp_path / ".driftloom" / "chunks").iterdir()))
    first = folders()
    names += [save("2", later), save("3", rows)]
    one, two, three = (set(store.load(n).data["t"]) for n in names)
    assert len(one) > 2 * history.FOLDERS >= 2 * first and one == three and len(one - two) == 1 and folders() == first + 1
    for n, own in ((names[0], rows), (names[1], later)):
        assert sorted(map(tuple, store.rows(spark, n).collect()), key=str) == sorted(own, key=str)
    assert [tuple(r)[:5] for r in store.data_diff(spark, names[0], names[1]).collect()] == [("t", "7", "changed", "updated", "removed")]


def test_histories_are_not_broadcast(spark, monkeypatch):
    """Depths and logs of chains, stars, several roots and parents that are not there; no join sends a side of the history to the driver."""
    parents = {i: i - 1 for i in range(1, 40)} | {0: None, 100: None, 200: 999, 201: 200, 202: 201} | {i: 100 for i in range(101, 120)} | {120: 101, 121: 120, 300: None}
    commits, plans, stage = spark.createDataFrame(list(parents.items()), "hash long, parent long"), [], history.stage

    def staged(df, *rest):
        with contextlib.redirect_stdout(io.StringIO()) as said:
            df.explain()
        plans.append(said.getvalue())
        return stage(df, *rest)

    def walk(h):
        way = [h]
        while parents.get(way[-1]) is not None:
            way.append(parents[way[-1]])
        return way

    monkeypatch.setattr(history, "stage", staged)
    ways = {h: walk(h) for h in parents}
    assert sorted(map(tuple, history.commit_depths(commits).collect())) == sorted((h, way[-1], len(way) - 1) for h, way in ways.items() if way[-1] in parents)
    assert sorted(map(tuple, history.log_of(commits, 39).collect())) == sorted((h, 39 - h) for h in range(40))
    assert history.commit_depths(commits.where("false")).isEmpty()
    assert sum("Join" in x for x in plans) > 10 and not any("Broadcast" in x for x in plans)


def test_history(spark, tmp_path):
    store = history.Store(str(tmp_path))
    store.init()
    prod, dev = two(users(Column("age", "int")))
    first = store.save(history.Commit("one", "me", "2024-01-01", prod_schema=prod.to_dict(), dev_schema=prod.to_dict()))
    store.create_branch("side")
    second = store.save(history.Commit("two", "me", "2024-01-02", prod_schema=prod.to_dict(), dev_schema=dev.to_dict()))
    assert [c.hash for c in store.log()] == [second, first] and store.load(second[:8]).message == "two"
    assert store.branches() == ["main", "side"] and store.diff(first, second).tables["users"].columns.added == ["age"]
    assert "-- ALTER TABLE" in store.rollback_script(second, Dialect("postgres"))
    store.checkout("side")
    assert store.head() == first and store.reachable("main") == {first, second}
    assert store.tree().count("\n") == 2
    with pytest.raises(ValueError, match="no branch name"):
        store.create_branch("a/b")
    with pytest.raises(KeyError):
        store.resolve("dead")


def test_manifest(spark, tmp_path):
    clock = [100.0]
    manifest = Manifest(str(tmp_path), "f", lambda: clock[0])
    run_tables(spark, manifest, {"a": spark.range(3), "b": spark.range(4)})
    assert set(manifest.load()) == {"a", "b"} and Manifest(str(tmp_path), "g", lambda: clock[0]).load() == {}
    again = run_tables(spark, manifest, {"a": spark.range(99)})  # done, so it is read back
    assert again["a"].count() == 3
    clock[0] += 25 * 3600
    assert manifest.load() == {}


def test_config():
    raw = {"prod": {"driver": "sqlite", "path": "a.db"}, "dev": {"driver": "mysql", "host": "h", "database": "d", "password": "p"}, "conflict_resolution": {"default_strategy": "ours", "strategies": [{"table": "t", "strategy": "theirs"}]}}
    own = cfg.parse_config(raw)
    assert (own.strategy_for("t"), own.strategy_for("T"), own.fetch_size) == ("theirs", "ours", 10_000)
    raw["dev"]["password"] = "q"
    assert cfg.parse_config(raw).fingerprint == own.fingerprint
    for bad in ({}, {**raw, "prod": {"driver": "db2"}}, {**raw, "conflict_resolution": {"default_strategy": "mine"}}):
        with pytest.raises(cfg.ConfigError):
            cfg.parse_config(bad)
    assert tables.jdbc_url(cfg.Source("mssql", "h", database="d")) == "jdbc:sqlserver://h:1433;databaseName=d"
    assert tables.jdbc_options(own.dev, "t", ("id", 1, 9))["numPartitions"] == "8"
    assert "udt_name" in introspect.columns_query(cfg.Source("postgres", "h", database="d"))
    folded = introspect.fold_columns([("t", "b", 2, "INT", "YES", None, 1), ("t", "a", 1, "Text", "NO", "x", 2)])
    assert folded.tables["t"].primary_key == ["b", "a"] and folded.tables["t"].columns["a"].data_type == "text"


def test_catalog_rows_fold():
    schema = introspect.fold_columns([("t", "a", 1, "int", "NO", None, 1), ("t", "b", 2, "int", "YES", None, None)])
    found = {
        "indexes": [("t", "i", 2, "a", 1), ("t", "i", 1, "b", 1), ("gone", "j", 1, "x", 0)], "foreign_keys": [("t", "f", 1, "b", "u", "id", "CASCADE", None)],
        "views": [("v", "select 1", 1)], "routines": [("r", "FUNCTION", "SQL", "int", "return 1")], "parameters": [("r", 2, "OUT", "y", "int"), ("r", 1, "IN", "x", "int")],
        "triggers": [("g", "t", "AFTER", "INSERT", "x")], "sequences": [("s", 1, 2, 1, 9, 5, 0)],
    }
    own = catalog_sql.fold(schema, found)
    assert own.tables["t"].indexes == {"i": Index("i", ["b", "a"], True)} and own.tables["t"].foreign_keys["f"].ref_columns == ["id"]
    assert own.views["v"].is_materialized and own.routines["r"].parameters == [("IN", "x", "int"), ("OUT", "y", "int")]
    assert own.sequences["s"].increment == 2 and own.triggers["g"].event == "INSERT"
    assert set(catalog_sql.queries("postgres", "public")) == {"indexes", "foreign_keys", "views", "routines", "triggers", "sequences"}
    assert all("{" not in q for d in ("mysql", "postgres", "mssql", "oracle") for q in catalog_sql.queries(d, "x'y").values())


def test_retry():
    calls, slept = [], []

    def fails(code):
        calls.append(code)
        raise DriftError(code, "x")

    with pytest.raises(DriftError):
        retry(lambda: fails("CONNECT_FAILED"), sleep=slept.append)
    with pytest.raises(DriftError):
        retry(lambda: fails("AUTH_FAILED"), sleep=slept.append)
    assert calls == ["CONNECT_FAILED"] * 3 + ["AUTH_FAILED"] and slept == [1.0, 2.0]


def make(path, rows, extra=""):
    with sqlite3.connect(path) as db:
        db.executescript(f"CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, email TEXT {extra}); CREATE TABLE tags (id INTEGER PRIMARY KEY, user_id INTEGER REFERENCES users (id) ON DELETE CASCADE, tag TEXT); CREATE INDEX by_user ON tags (user_id, tag); CREATE VIEW v AS SELECT name FROM users; CREATE TRIGGER tr AFTER INSERT ON users BEGIN SELECT 1; END;")
        db.executemany("INSERT INTO users (id, name, email) VALUES (?, ?, ?)", rows)


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "p.db")
    make(path, [(i, f"n{i}", None) for i in range(1, 101)])
    schema = introspect.sqlite_schema(path)
    assert schema.tables["users"].primary_key == ["id"] and schema.tables["tags"].indexes["by_user"].columns == ["user_id", "tag"]
    assert schema.tables["tags"].foreign_keys["fk_tags_0"].on_delete == "CASCADE" and schema.views["v"].definition == "SELECT name FROM users"
    assert (schema.triggers["tr"].timing, schema.triggers["tr"].event) == ("AFTER", "INSERT")
    df = tables.sqlite_table(spark, path, "users", 3)
    assert df.rdd.getNumPartitions() == 3 and df.agg({"id": "sum"}).first()[0] == 5050
    assert Schema.from_dict(schema.to_dict()) == schema


def test_commands_round_trip(spark, tmp_path):
    from driftloom import cli

    prod, dev, out = str(tmp_path / "p.db"), str(tmp_path / "d.db"), tmp_path / "out"
    make(prod, [(1, "Alice", "alice@example.com"), (2, "Bob", "bob@example.com")])
    make(dev, [(2, "Bob Updated", "o'b@example.com"), (3, "Charlie", None)])
    (tmp_path / "c.yaml").write_text(f"prod: {{driver: sqlite, path: {prod}}}\ndev: {{driver: sqlite, path: {dev}}}\noutput: {{dir: {out}}}\nconflict_resolution: {{default_strategy: theirs}}\n")
    run = lambda *a: cli.main(["--config", str(tmp_path / "c.yaml"), *a], spark)
    assert run("check") == 0 and run("schema-diff") == 0 and run("diff", "--html", "--row-diff") == 0
    assert "Updated rows: 1" in (out / "summary.txt").read_text() and "Charlie" not in (out / "summary.txt").read_text()
    assert "<h2>Keys</h2>" in (out / "report.html").read_text()
    assert run("resolve-conflicts", "--auto", "theirs") == 0 and run("gen-pack") == 0
    assert run("apply", "--pack", str(out / "pack" / "users"), "--dry-run") == 0
    assert run("apply", "--pack", str(out / "pack" / "users")) == 0
    with sqlite3.connect(prod) as a, sqlite3.connect(dev) as b:
        read = "SELECT * FROM users ORDER BY id"
        assert a.execute(read).fetchall() == b.execute(read).fetchall()
    assert run("row-diff", "--table", "USERS") == 0 and run("version", "init") == 0 and run("version", "commit", "--message", "m") == 0
    assert run("version", "log") == 0 and run("version", "tree") == 0


@pytest.mark.parametrize("strategy", ["theirs", "ours"])
def test_pack_brings_a_new_column(spark, tmp_path, strategy):
    from driftloom import cli

    prod, dev, out = str(tmp_path / "p.db"), str(tmp_path / "d.db"), tmp_path / "out"
    make(prod, [(i, f"n{i}", None) for i in range(1200)])
    make(dev, [(i, f"m{i}", None) for i in range(1, 1201)])
    with sqlite3.connect(dev) as db:
        db.execute("ALTER TABLE users ADD COLUMN city TEXT")
        db.execute("UPDATE users SET city = printf('c%d', id) WHERE id <> 7")
    (tmp_path / "c.yaml").write_text(f"prod: {{driver: sqlite, path: {prod}}}\ndev: {{driver: sqlite, path: {dev}}}\noutput: {{dir: {out}}}\nconflict_resolution: {{default_strategy: {strategy}}}\n")
    run = lambda *a: cli.main(["--config", str(tmp_path / "c.yaml"), *a], spark)
    assert run("gen-pack") == 0 and run("apply", "--pack", str(out / "pack" / "users")) == 0
    with sqlite3.connect(prod) as a, sqlite3.connect(dev) as b:
        assert a.execute("SELECT id, city FROM users ORDER BY id").fetchall() == b.execute("SELECT id, city FROM users ORDER BY id").fetchall()
        assert a.execute("SELECT name FROM users WHERE id = 5").fetchone() == (("m5",) if strategy == "theirs" else ("n5",))


def test_parquet_comparison(spark, tmp_path):
    from driftloom.plans.compare import Comparison

    for side, n in (("p", 5), ("d", 6)):
        spark.range(n).withColumnRenamed("id", "k").write.parquet(str(tmp_path / side / "t.parquet"))
    own = Comparison(spark, cfg.parse_config({"prod": {"path": str(tmp_path / "p")}, "dev": {"path": str(tmp_path / "d")}, "primary_keys": {"T": ["k"]}, "output": {"dir": str(tmp_path / "o")}}))
    assert own.check() == [] and [r["status"] for r in own.union(own.diffs()).collect()] == ["added"]


def test_html_shows_other_objects(spark):
    """Views, routines, triggers and sequences that came, went or differ, attribute by attribute."""
    prod = Schema(views={"v": View("v", "SELECT <1>"), "w": View("w", "SELECT 3")}, triggers={"t": Trigger("t", "orders", "BEFORE", "INSERT", "x")}, sequences={"s": Sequence("s", 1, 1)})
    dev = Schema(views={"v": View("v", "SELECT 2", True)}, routines={"f": Routine("f", "FUNCTION", "body", "sql", "int", [("IN", "a", "int")])}, triggers={"t": Trigger("t", "orders", "AFTER", "INSERT", "x")}, sequences={"s": Sequence("s", 1, 5)})
    own = schema_drift(prod, dev)
    none = spark.createDataFrame([], "table string, row_key string, status string, prod_hash string, dev_hash string")
    page = reports.html_report(none, own, schemas=(prod, dev))
    rows = ["<td>v</td><td>definition</td><td>SELECT &lt;1&gt;</td><td>SELECT 2</td><td>modified</td>", "<td>v</td><td>is_materialized</td><td>False</td><td>True</td><td>modified</td>", "<td>w</td><td>definition</td><td>SELECT 3</td><td></td><td>removed</td>"]
    rows += ["<td>f</td><td>parameters</td><td></td><td>IN a int</td><td>added</td>", "<td>t</td><td>timing</td><td>BEFORE</td><td>AFTER</td><td>modified</td>", "<td>s</td><td>increment</td><td>1</td><td>5</td><td>modified</td>"]
    assert all(r in page for r in rows) and page.count("<h3>") == 4 and "<td>t</td><td>event</td>" not in page
