"""Migration scripts of each dialect, object by object; and comparison over paths that only Spark's file systems open."""

import pytest

from driftloom.plans import migration
from driftloom.plans.catalog import Column, ForeignKey, Index, Routine, Schema, Sequence, Table, Trigger, View
from driftloom.plans.dialects import DRIVERS, Dialect
from driftloom.plans.migration import Gates, migration_script

ALL = Gates(tables=True, columns=True, indexes=True, foreign_keys=True, views=True, routines=True, triggers=True, sequences=True, confirm=False)


def schema(*tables, **kinds):
    own = Schema()
    for t in tables:
        own.tables[t.name] = t
    for kind, objects in kinds.items():
        getattr(own, kind).update({x.name: x for x in objects})
    return own


def table(name="t", columns=(("id", "int", False, None),), key=("id",), indexes=(), keys=()):
    return Table(name, {c[0]: Column(*c) for c in columns}, list(key), {i.name: i for i in indexes}, {k.name: k for k in keys})


def lines(prod, dev, driver, gates=ALL):
    own = migration_script(prod, dev, Dialect(driver), gates).split("\n")
    assert own[0] == "BEGIN;" and own[-2:] == ["COMMIT;", ""]
    return own[1:-2]


BASE = table(columns=(("id", "int", False, None), ("a", "text", True, None)))


@pytest.mark.parametrize("driver", DRIVERS)
def test_no_drift_is_no_script(driver):
    assert migration_script(schema(BASE), schema(BASE), Dialect(driver)) == ""


@pytest.mark.parametrize(
    ("driver", "want"),
    [
        ("mysql", "ALTER TABLE `t` ADD COLUMN `b` text DEFAULT 'x y';"),
        ("postgres", 'ALTER TABLE "t" ADD COLUMN "b" text DEFAULT \'x y\';'),
        ("sqlite", 'ALTER TABLE "t" ADD COLUMN "b" text DEFAULT \'x y\';'),
        ("mssql", "ALTER TABLE [t] ADD [b] text DEFAULT 'x y';"),
        ("oracle", 'ALTER TABLE "t" ADD "b" text DEFAULT \'x y\';'),
    ],
)
def test_added_and_dropped_columns(driver, want):
    more = table(columns=(*[(c.name, c.data_type, c.is_nullable, c.default) for c in BASE.columns.values()], ("b", "text", True, "x y")))
    assert lines(schema(BASE), schema(more), driver) == [want]
    d = Dialect(driver)
    drop = f"ALTER TABLE {d.quote('t')} DROP COLUMN {d.quote('b')};"
    assert lines(schema(more), schema(BASE), driver)[-1] == drop and lines(schema(more), schema(BASE), driver, Gates())[-1] == "-- " + drop


@pytest.mark.parametrize(
    ("driver", "want"),
    [
        ("mysql", ["ALTER TABLE `t` MODIFY COLUMN `a` varchar(9) NOT NULL DEFAULT '5';"]),
        ("postgres", ['ALTER TABLE "t" ALTER COLUMN "a" TYPE varchar(9) USING "a"::varchar(9);', 'ALTER TABLE "t" ALTER COLUMN "a" SET NOT NULL;', 'ALTER TABLE "t" ALTER COLUMN "a" SET DEFAULT \'5\';']),
        ("mssql", ["ALTER TABLE [t] ALTER COLUMN [a] varchar(9) NOT NULL;", "-- drop the default constraint of t.a by its name first", "ALTER TABLE [t] ADD DEFAULT '5' FOR [a];"]),
        ("oracle", ['ALTER TABLE "t" MODIFY ("a" varchar(9) DEFAULT \'5\' NOT NULL);']),
        ("sqlite", ['-- SQLite can\'t modify t.a to "a" varchar(9) NOT NULL DEFAULT \'5\'; rebuild the table']),
    ],
)
def test_modified_columns(driver, want):
    new = table(columns=(("id", "int", False, None), ("a", "varchar(9)", False, "'5'")))
    assert lines(schema(BASE), schema(new), driver) == want


def test_postgres_drops_what_is_gone():
    old = table(columns=(("id", "int", False, None), ("a", "text", False, "5")))
    assert lines(schema(old), schema(BASE), "postgres") == ['ALTER TABLE "t" ALTER COLUMN "a" DROP NOT NULL;', 'ALTER TABLE "t" ALTER COLUMN "a" DROP DEFAULT;']


@pytest.mark.parametrize("driver", DRIVERS)
def test_tables_come_in_the_order_of_their_references(driver):
    parent, child = table("z_parent"), table("a_child", (("id", "int", False, None), ("p", "int", True, None)), keys=(ForeignKey("fk", ["p"], "z_parent", ["id"], "CASCADE", "SET NULL"),))
    d, both = Dialect(driver), schema(parent, child)
    made = "\n".join(lines(schema(), both, driver))
    assert made.index(f"CREATE TABLE {d.quote('z_parent')}") < made.index(f"CREATE TABLE {d.quote('a_child')}")
    assert "ON DELETE CASCADE" in made and ("ON UPDATE SET NULL" in made) == (driver != "oracle")
    assert (f"ALTER TABLE {d.quote('a_child')} ADD CONSTRAINT" in made) == (driver != "sqlite") and ("ENGINE=InnoDB" in made) == (driver == "mysql")
    gone = "\n".join(lines(both, schema(), driver))
    assert gone.index(f"DROP TABLE {d.quote('a_child')}") < gone.index(f"DROP TABLE {d.quote('z_parent')}")
    assert all(x.startswith("-- ") for x in lines(both, schema(), driver, Gates()))


@pytest.mark.parametrize("driver", DRIVERS)
def test_indexes(driver):
    d, own = Dialect(driver), table(indexes=(Index("i", ["id", "a"], True),))
    on = f" ON {d.quote('t')}" if driver in ("mysql", "mssql") else ""
    plain = table()
    assert lines(schema(plain), schema(own), driver) == [f"CREATE UNIQUE INDEX {d.quote('i')} ON {d.quote('t')} ({d.quote('id')}, {d.quote('a')});"]
    assert lines(schema(own), schema(plain), driver) == [f"DROP INDEX {d.quote('i')}{on};"]
    changed = table(indexes=(Index("i", ["id"], False),))
    assert [x.split(" ")[0] for x in lines(schema(own), schema(changed), driver)] == ["DROP", "CREATE"]


@pytest.mark.parametrize("driver", DRIVERS)
def test_foreign_keys_are_replaced(driver):
    of = lambda action: schema(table("p"), table("c", keys=(ForeignKey("f", ["id"], "p", ["id"], action),)))
    own = lines(of("CASCADE"), of("RESTRICT"), driver)
    if driver == "sqlite":
        assert len(own) == 2 and all(x.startswith("-- SQLite") for x in own)
    else:
        kind = "FOREIGN KEY" if driver == "mysql" else "CONSTRAINT"
        assert f"DROP {kind} {Dialect(driver).quote('f')};" in own[0] and own[1].endswith("ON DELETE RESTRICT;")
    assert migration_script(of(""), of("no action"), Dialect(driver)) == ""


@pytest.mark.parametrize(("driver", "first"), [("mysql", "DROP PRIMARY KEY;"), ("postgres", 'DROP CONSTRAINT "t_pkey";'), ("mssql", "DROP CONSTRAINT [PK_t];"), ("oracle", "DROP PRIMARY KEY;")])
def test_primary_keys(driver, first):
    two = table(columns=(("id", "int", False, None), ("b", "int", False, None)), key=("id", "b"))
    one = table(columns=(("id", "int", False, None), ("b", "int", False, None)))
    own = lines(schema(one), schema(two), driver)
    q = Dialect(driver).quote
    assert own == [f"ALTER TABLE {q('t')} {first}", f"ALTER TABLE {q('t')} ADD PRIMARY KEY ({q('id')}, {q('b')});"]
    assert all(x.startswith("-- ") for x in lines(schema(one), schema(two), driver, Gates()))


@pytest.mark.parametrize("driver", DRIVERS)
def test_views(driver):
    q = Dialect(driver).quote
    view = lambda text, materialized=False: schema(views=[View("v", text, materialized)])
    assert lines(schema(), view("SELECT 1;"), driver) == [f"CREATE VIEW {q('v')} AS SELECT 1;"]
    assert lines(view("SELECT 1"), schema(), driver) == [f"DROP VIEW IF EXISTS {q('v')};"]
    assert migration_script(view("SELECT  1"), view("select 1"), Dialect(driver)) == ""
    own = lines(view("SELECT 1"), view("SELECT 2"), driver)
    assert own == ([f"DROP VIEW IF EXISTS {q('v')};", f"CREATE VIEW {q('v')} AS SELECT 2;"] if driver in ("sqlite", "mssql") else [f"CREATE OR REPLACE VIEW {q('v')} AS SELECT 2;"])
    assert lines(view("SELECT 1", True), view("SELECT 2", True), driver)[0] == f"DROP MATERIALIZED VIEW IF EXISTS {q('v')};"


def test_routines_and_triggers():
    routine = lambda body: schema(routines=[Routine("r", "FUNCTION", body, "SQL", "int", [("IN", "x", "int")])])
    assert lines(schema(), routine("CREATE FUNCTION r() RETURN 1;"), "mysql") == ["CREATE FUNCTION r() RETURN 1;"]
    assert lines(routine("CREATE FUNCTION r() RETURN 1"), routine("CREATE FUNCTION r() RETURN 2"), "mysql") == ["DROP FUNCTION IF EXISTS `r`;", "CREATE FUNCTION r() RETURN 2;"]
    with pytest.raises(ValueError, match="no definition"):
        lines(schema(), routine(" "), "mysql")
    trigger = schema(triggers=[Trigger("g", "t", "AFTER", "INSERT", "CREATE TRIGGER g AFTER INSERT ON t BEGIN SELECT 1; END")])
    assert lines(trigger, schema(), "postgres") == ['DROP TRIGGER IF EXISTS "g" ON "t";'] and lines(trigger, schema(), "mysql") == ["DROP TRIGGER IF EXISTS `g`;"]
    assert lines(trigger, schema(), "mysql", Gates()) == ["-- DROP TRIGGER IF EXISTS `g`;"] and lines(schema(), trigger, "sqlite")[0].endswith("END;")


def test_sequences():
    sequence = lambda step: schema(sequences=[Sequence("s", 1, step, 1, 99, 5, False)])
    assert lines(schema(), sequence(2), "postgres") == ['CREATE SEQUENCE "s" INCREMENT BY 2 MINVALUE 1 MAXVALUE 99 START WITH 1 CACHE 5 NO CYCLE;']
    assert lines(sequence(2), sequence(3), "postgres")[0].startswith('ALTER SEQUENCE "s" INCREMENT BY 3') and lines(sequence(2), schema(), "postgres") == ['DROP SEQUENCE IF EXISTS "s";']


@pytest.mark.parametrize(("default", "want"), [("5", "5"), ("-1.5", "-1.5"), ("now()", "now()"), ("CURRENT_TIMESTAMP", "CURRENT_TIMESTAMP"), ("'x'", "'x'"), ("it's", "'it''s'"), ("null", "null"), ("true", "true"), ("5 apples", "'5 apples'")])
def test_defaults(default, want):
    assert migration.default_literal(default) == want


@pytest.mark.parametrize(("driver", "want"), [("mysql", "`a``b`.`c`"), ("mssql", "[a`b].[c]"), ("postgres", '"a`b"."c"')])
def test_identifiers(driver, want):
    assert Dialect(driver).quote("a`b.c") == want
    assert Dialect("mssql").quote("x]y") == "[x]]y]" and Dialect("oracle").quote('x"y') == '"x""y"'


def test_files_lie_where_spark_has_them(spark, tmp_path):
    """Both sides, the output and the reports by addresses that Python's own files don't take."""
    from driftloom import cli
    from driftloom.sources import files

    root = f"file://{tmp_path}"
    for side, n in (("p", 5), ("d", 6)):
        spark.range(n).withColumnRenamed("id", "k").write.parquet(f"{root}/{side}/t.parquet")
    (tmp_path / "c.yaml").write_text(f"prod: {{path: '{root}/p'}}\ndev: {{path: '{root}/d'}}\nprimary_keys: {{t: [k]}}\noutput: {{dir: '{root}/out'}}\n")
    run = lambda *a: cli.main(["--config", str(tmp_path / "c.yaml"), *a], spark)
    assert run("diff", "--html") == 0 and "Added rows: 1" in files.read_text(f"{root}/out/summary.txt") and (tmp_path / "out" / "report.html").exists()
    assert run("gen-pack") == 0 and run("resolve-conflicts", "--resume") == 0 and not list(tmp_path.rglob(".resolutions.json.crc"))
    files.write_text(f"{root}/out/x", "é")
    files.write_text(f"{root}/out/x", "ü")
    assert files.read_text(f"{root}/out/x") == "ü" and files.exists(f"{root}/out/x")
    files.remove(f"{root}/out/x")
    assert not files.exists(f"{root}/out/x") and "summary.txt" in files.names(f"{root}/out")
    with pytest.raises(FileNotFoundError):
        files.read_text(f"{root}/none")
