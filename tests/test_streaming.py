from pyspark.sql import types as T

from driftloom.operators.rowdiff import row_diff
from driftloom.streaming import changes


def test_stream_folds_and_reports(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, seq long")
    batches = [[(1, "A", 1, "upsert"), (1, "AA", 2, "upsert")], [(2, "b", 3, "delete"), (3, "c", 4, "upsert")]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "id long, v string, seq long, op string").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    state, reports = {"path": str(tmp_path / "t0")}, {}
    base.write.parquet(state["path"])

    def write(df, n):
        path = str(tmp_path / f"t{n + 1}")
        df.write.mode("overwrite").parquet(path)
        state["path"] = path

    stream = spark.readStream.schema("id long, v string, seq long, op string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    own = changes.running_diff(stream, ["id"], ["seq"], lambda: spark.read.parquet(state["path"]), write, base, lambda d, n: reports.setdefault(n, {(r["row_key"], r["status"]) for r in d.collect()}), str(tmp_path / "cp"))
    own.processAllAvailable()
    own.stop()
    assert reports[max(reports)] == {("1", "updated"), ("2", "removed"), ("3", "added")}
    assert {(r["id"], r["v"]) for r in spark.read.parquet(state["path"]).collect()} == {(1, "AA"), (3, "c")}


def test_changes_sent_again_are_folded_once(spark, tmp_path):
    schema = "id long, v string, seq long, op string, at timestamp"
    rows = "SELECT {} AS id, '{}' AS v, {} AS seq, 'upsert' AS op, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {}) AS at"
    for i, batch in enumerate([[(1, "a", 1, 0), (1, "a", 1, 0)], [(1, "old again", 9, 0), (2, "b", 2, 1)]]):
        spark.sql(" UNION ALL ".join(rows.format(*x) for x in batch)).selectExpr("id", "v", "CAST(seq AS BIGINT) AS seq", "op", "CAST(at AS TIMESTAMP) AS at").selectExpr("CAST(id AS BIGINT) AS id", "v", "seq", "op", "at").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    state, seen = {"df": spark.createDataFrame([], schema)}, []

    def write(df, n):
        df.write.mode("overwrite").parquet(str(tmp_path / f"t{n}"))
        state["df"] = spark.read.parquet(str(tmp_path / f"t{n}"))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    own = changes.running_diff(stream, ["id"], ["seq"], lambda: state["df"], write, spark.createDataFrame([], schema), lambda d, n: seen.append(d.count()), str(tmp_path / "cp"), late=("at", "1 hour"))
    own.processAllAvailable()
    own.stop()
    assert {(r["id"], r["v"]) for r in state["df"].collect()} == {(1, "a"), (2, "b")} and seen[-1] == 2


def test_positions(spark):
    rows = spark.createDataFrame([(1, 5), (1, 3), (2, 1)], "id long, seq long")
    assert {(r["seq"], r["position"]) for r in changes.change_positions(rows, ["id"], ["seq"]).collect()} == {(3, 1), (5, 2), (1, 1)}


def test_running_difference_costs_what_changes(spark, tmp_path):
    """Each batch emits the keys that it touches alone; what is current equals a whole comparison after every batch, and a late change does not undo a later one."""
    columns, order = ["id", "v"], {"seq": T.LongType()}
    prod = [(i, f"v{i}") for i in range(40)]
    put = lambda rows, side, n, op=None: changes.sided(spark.createDataFrame(rows, "id int, v string" + (", op string, seq long" if op else "")), side, ["id"], columns, order, op).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(prod, "prod", 0)
    put([(i, v, "upsert", 1) for i, v in prod if i != 5] + [(None, "n", "upsert", 1)], "dev", 1, "op")
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    own = changes.RunningDiff(spark, str(tmp_path / "state"), ["id"])
    view = lambda: sorted(((r["id"], r["status"]) for r in own.current().collect()), key=str)
    own.start(stream, availableNow=True).awaitTermination()
    assert view() == [(5, "removed"), (None, "added")]
    put([(3, "x", "upsert", 7), (4, None, "delete", 7), (4, "again", "upsert", 6), (99, "new", "upsert", 7), (3, "old", "upsert", 2)], "dev", 2, "op")
    own.start(stream, availableNow=True).awaitTermination()
    assert view() == [(3, "updated"), (4, "removed"), (5, "removed"), (99, "added"), (None, "added")]
    assert own.batches().where("batch = 1").count() == 3
    put([(3, "v3", "upsert", 8), (4, "v4", "upsert", 8), (99, "late", "upsert", 5), (None, None, "delete", 9)], "dev", 3, "op")
    own.start(stream, availableNow=True).awaitTermination()
    assert view() == [(5, "removed"), (99, "added")] and own.batches().where("batch = 2").count() == 4
    dev = spark.createDataFrame([(i, v) for i, v in prod if i != 5] + [(99, "new")], "id int, v string")
    whole = row_diff(spark.createDataFrame(prod, "id int, v string"), dev, ["id"]).select("id", "status", "prod_hash", "dev_hash")
    assert sorted(map(tuple, own.current().collect())) == sorted(map(tuple, whole.collect()))


def test_compaction_keeps_what_differs(spark, tmp_path):
    """Folded batches leave the keys that differ, as before; later batches undo and add; a compaction that was cut off, and one without news, change nothing."""
    columns, order = ["id", "v"], {"seq": T.LongType()}
    put = lambda rows, side, n: changes.sided(spark.createDataFrame(rows, "id int, v string, op string, seq long"), side, ["id"], columns, order, "op").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(i, f"v{i}", "upsert", 0) for i in range(20)], "prod", 0)
    put([(i, f"v{i}" if i > 2 else "x", "upsert", 1) for i in range(19)], "dev", 1)
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    own = changes.RunningDiff(spark, str(tmp_path / "state"), ["id"])
    view = lambda: sorted((r["id"], r["status"]) for r in own.current().collect())
    assert own.compact() == -1
    run = lambda: own.start(stream, availableNow=True).awaitTermination()
    run()
    before = [(0, "updated"), (1, "updated"), (2, "updated"), (19, "removed")]
    assert view() == before
    (tmp_path / "state" / "base" / "1").mkdir(parents=True)
    (tmp_path / "state" / "base" / "1" / "half").write_text("cut off")
    (tmp_path / "state" / "status" / "batch=2").mkdir()  # in flight: not committed yet
    (tmp_path / "state" / "status" / "batch=2" / "part.parquet").write_bytes(next((tmp_path / "state" / "status" / "batch=1").glob("*.parquet")).read_bytes())
    assert own.compact() == 1 and own.compact() == 1
    assert own.batches().select("batch").distinct().collect() == [(2,)]
    assert spark.read.parquet(str(tmp_path / "state" / "base" / "1")).count() == 4
    put([(0, "v0", "upsert", 2), (5, None, "delete", 2), (7, "late", "upsert", 0)], "dev", 2)
    run()  # the batch in flight is written anew
    after = [(1, "updated"), (2, "updated"), (5, "removed"), (19, "removed")]
    assert view() == after and own.compact() == 2 and view() == after
    assert own.batches().count() == 0 and sorted(x.name for x in (tmp_path / "state" / "base").iterdir()) == ["2"]
    put([(i, f"v{i}", "upsert", 3) for i in (1, 2, 5, 19)], "dev", 3)
    run()
    assert view() == [] and own.compact() == 3 and view() == []
