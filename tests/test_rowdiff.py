import pytest
from pyspark.sql import functions as F

from driftloom.functions import canonical
from driftloom.functions.ignore import column_ignorer, name_ignorer
from driftloom.operators import celldiff, patch, resolve, rowdiff
from driftloom.plans.dialects import Dialect, keyset_query


@pytest.fixture
def users(spark):
    schema = "id long, name string, email string"
    prod = spark.createDataFrame([(1, "Alice", "alice@example.com"), (2, "Bob", "bob@example.com")], schema)
    dev = spark.createDataFrame([(2, "Bob Updated", "bob.new@example.com"), (3, "Charlie", "charlie@example.com")], schema)
    return prod, dev


def statuses(diff):
    return {r["row_key"]: r["status"] for r in diff.collect()}


def test_users(users):
    assert statuses(rowdiff.row_diff(*users, ["id"])) == {"1": "removed", "2": "updated", "3": "added"}


@pytest.mark.parametrize("status", ["added", "removed", "updated"])
def test_each_status_alone_is_a_part_of_all(users, status):
    whole = rowdiff.row_diff(*users, ["id"])
    assert rowdiff.row_diff(*users, ["id"], status=status).exceptAll(whole.where(F.col("status") == status)).isEmpty()


def test_a_side_equals_itself(users):
    assert rowdiff.row_diff(users[0], users[0], ["id"]).isEmpty()
    assert not rowdiff.has_changes(rowdiff.row_diff(users[0], users[0].repartition(3), ["id"]))


def test_swapping_sides_swaps_added_and_removed(users):
    swap = {"added": "removed", "removed": "added", "updated": "updated"}
    there, back = statuses(rowdiff.row_diff(*users, ["id"])), statuses(rowdiff.row_diff(users[1], users[0], ["id"]))
    assert back == {k: swap[s] for k, s in there.items()}


def test_patch_makes_the_sides_equal(users):
    prod, dev = users
    diff = rowdiff.row_diff(prod, dev, ["id"])
    applied = patch.apply_patch(prod, patch.patch_deletes(diff, ["id"]), patch.patch_upserts(diff, dev, ["id"]), ["id"])
    assert rowdiff.row_diff(applied, dev, ["id"]).isEmpty()


def test_kept_rows_stay_different(users):
    prod, dev = users
    diff = rowdiff.row_diff(prod, dev, ["id"]).withColumn("table", F.lit("users"))
    conflicts = rowdiff.conflicts(prod, dev, ["id"], "users")
    decided = resolve.apply_strategies(conflicts, default="ours")
    let_through = resolve.filter_diff(diff, decided)
    applied = patch.apply_patch(prod, patch.patch_deletes(let_through, ["id"]), patch.patch_upserts(let_through, dev, ["id"]), ["id"])
    assert statuses(rowdiff.row_diff(applied, dev, ["id"])) == {"2": "updated"}


def test_hash_ignores_column_order_and_case(users):
    prod = users[0]
    other = prod.select(F.col("email").alias("EMAIL"), F.col("id").alias("ID"), F.col("name").alias("Name"))
    assert rowdiff.row_diff(prod, other, ["id"]).isEmpty()


def test_key_is_joined_by_its_typed_columns(spark):
    prod = spark.createDataFrame([("a|b", "c", 1)], "x string, y string, v int")
    dev = spark.createDataFrame([("a", "b|c", 1)], "x string, y string, v int")
    assert {r["status"] for r in rowdiff.row_diff(prod, dev, ["x", "y"]).collect()} == {"added", "removed"}


def test_null_and_its_text_collide_only_in_compat_mode(spark):
    a, b = (spark.createDataFrame([(1, v)], "id int, v string") for v in (None, "<nil>"))
    assert rowdiff.row_diff(a, b, ["id"]).isEmpty()
    assert rowdiff.row_diff(a, b, ["id"], mode="safe").count() == 1


def test_null_keys_match(spark):
    a = spark.createDataFrame([(None, "x")], "id int, v string")
    assert rowdiff.row_diff(a, a, ["id"]).isEmpty()


def test_composite_keys_with_nulls_come_back_as_they_are(spark):
    """Nulls of several key columns and the values that stand for them in the join are told apart, for every status."""
    schema = "a int, b string, c double, v string"
    ours = [(None, "", 0.0, "x"), (0, None, 0.0, "x"), (0, "", None, "x"), (0, "", 0.0, "x"), (None, None, None, "x"), (1, "b", -0.0, "x")]
    theirs = [(None, "", 0.0, "y"), (0, None, 0.0, "x"), (0, "", None, "y"), (None, None, 0.0, "new"), (1, "b", -0.0, "y")]
    prod, dev = (spark.createDataFrame(x, schema) for x in (ours, theirs))
    want = {((None, "", 0.0), "updated"), ((0, "", None), "updated"), ((1, "b", 0.0), "updated"), ((0, "", 0.0), "removed"), ((None, None, None), "removed"), ((None, None, 0.0), "added")}
    found = lambda status: {((r["a"], r["b"], r["c"]), r["status"]) for r in rowdiff.row_diff(prod, dev, ["a", "b", "c"], status).collect()}
    assert found("all") == want
    for status in ("added", "removed", "updated"):
        assert found(status) == {x for x in want if x[1] == status}


def test_rows_are_numbered_within_groups_of_any_size(spark):
    """One group that holds most rows, one of a single row, one without a name; the numbers go over ranges in several tasks."""
    rows = spark.range(5000, numPartitions=7).selectExpr("CASE WHEN id = 3 THEN 'one' WHEN id % 50 <> 4 THEN 'hot' END AS `table`", "lpad(cast(id * 7919 % 5000 AS string), 5, '0') AS row_key", "id AS part", "id AS n")
    got = resolve.numbered(rows, "table", "row_key")
    assert got.columns == ["table", "row_key", "part", "n", "position"]
    found = got.collect()
    for name in ("hot", "one", None):
        own = sorted((r["row_key"], r["position"]) for r in found if r["table"] == name)
        assert [p for _, p in own] == list(range(1, len(own) + 1))
    assert len(found) == 5000 and resolve.numbered(rows.limit(0), "table", "row_key").count() == 0


def test_no_key_is_an_error_and_multisets_need_none(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    b = spark.createDataFrame([(1,), (3,)], "v int")
    with pytest.raises(rowdiff.MissingKey):
        rowdiff.row_diff(a, b, [])
    assert {(r["v"], r["status"], r["copies"]) for r in rowdiff.multiset_diff(a, b).collect()} == {(1, "removed", 1), (2, "removed", 1), (3, "added", 1)}


def test_ignored_columns(spark):
    ignored = column_ignorer(["*.updated_at", "users.Secret", "tmp_*"])
    assert [ignored("Users", c) for c in ("UPDATED_AT", "secret", "tmp_x", "name")] == [True, True, True, False]
    assert name_ignorer(["Audit"])("AUDIT")
    a = spark.createDataFrame([(1, "x", "1")], "id int, name string, updated_at string")
    assert rowdiff.row_diff(a, a.withColumn("updated_at", F.lit("2")), ["id"], ignored=lambda c: ignored("users", c)).isEmpty()


def test_ignored_columns_are_not_read(spark, tmp_path):
    spark.createDataFrame([(1, "x", "1")], "id int, name string, updated_at string").write.parquet(str(tmp_path / "t"))
    own = rowdiff.hashed(spark.read.parquet(str(tmp_path / "t")), ["id"], ignored=lambda c: c == "updated_at")
    assert "updated_at" not in own._jdf.queryExecution().executedPlan().toString()


def test_cells(spark):
    schema = "id long, title string, price double"
    prod = spark.createDataFrame([(1, "Book", 10.5), (2, "Pen", 1.5), (3, "Notebook", 4.0)], schema)
    dev = spark.createDataFrame([(1, "Book", 12.0), (2, "Pen", 1.5), (4, "Eraser", 0.5)], schema)
    diff = rowdiff.row_diff(prod, dev, ["id"])
    cells = celldiff.cell_diff(diff, prod, dev, ["id"])
    assert {(r["row_key"], tuple(r["columns"])) for r in celldiff.differing_columns(cells).collect()} == {("1", ("price",)), ("3", ("id", "price", "title")), ("4", ("id", "price", "title"))}
    assert celldiff.changed_rows(diff, prod, dev, ["id"]).count() == 3
    assert {r["status"] for r in celldiff.key_detail(prod, dev, {"id": 2}).collect()} == {"unchanged"}
    nested = celldiff.nested_report(cells, "items").where("row_key = '1'").first()
    assert [(c["Column"], c["Differs"]) for c in nested["columns"]] == [("id", False), ("price", True), ("title", False)]


def test_one_sided_column_differs(spark):
    a = spark.createDataFrame([(1, None)], "id int, v string")
    b = a.withColumn("w", F.lit(None).cast("string"))
    diff = rowdiff.row_diff(a, b, ["id"])
    assert {r["column"] for r in celldiff.cell_diff(diff, a, b, ["id"]).where("differs").collect()} == {"w"}


def test_merge_and_bulk(spark):
    current = spark.createDataFrame([("t", "1", "p", "d"), ("t", "2", "p", "d"), ("u", "3", "p", "d")], "table string, row_key string, prod_hash string, dev_hash string")
    saved = resolve.apply_strategies(current.where("row_key = '1'").withColumn("prod_hash", F.lit("old")), default="theirs")
    merged = resolve.merge_resolutions(saved, current)
    assert {(r["row_key"], r["decision"], r["prod_hash"]) for r in merged.collect()} == {("1", "use_dev", "p"), ("2", "pending", "p"), ("3", "pending", "p")}
    bulk = resolve.bulk_resolve(merged, "ours", "t")
    assert {(r["row_key"], r["decision"]) for r in bulk.collect()} == {("1", "use_dev"), ("2", "keep_prod"), ("3", "pending")}
    one = resolve.set_decision(bulk, "u", "3", "use_dev")
    assert one.where("resolved").count() == 3
    assert resolve.set_decision(bulk, "u", "9", "use_dev").exceptAll(bulk).isEmpty()


def test_literals(spark):
    from pyspark.sql import types as T

    df = spark.sql("SELECT \"O'Hara\" AS s, 5 AS i, true AS b, CAST(NULL AS INT) AS n, TIMESTAMP_NTZ '2024-01-02 03:04:05.678' AS t")
    text = lambda c, typed=False: df.select(canonical.sql_literal(F.col(c), df.schema[c].dataType, typed)).first()[0]
    assert (text("s"), text("i"), text("i", True), text("b"), text("n"), text("t")) == ("'O''Hara'", "'5'", "5", "TRUE", "NULL", "'2024-01-02 03:04:05.678'")
    assert isinstance(df.schema["t"].dataType, T.TimestampNTZType)


def test_default_and_split_key(spark):
    df = spark.createDataFrame([("'a'",), ('"b"',), (" c ",), ("'d",), (None,)], "x string")
    assert [r[0] for r in df.select(canonical.normal_default(F.col("x"))).collect()] == ["a", "b", "c", "'d", None]
    keys = spark.createDataFrame([("1|2",), ("1",)], "k string")
    assert [r[0] for r in keys.select(canonical.split_key(F.col("k"), 2)).collect()] == [["1", "2"], None]


def test_backfill_batches_hold_all_rows(spark):
    df = spark.range(2500).selectExpr("id", "concat('v', id) AS v")
    own = patch.backfill_statements(df, "t", ["id"], ["v"], Dialect("mysql"))
    rows = own.collect()
    assert sum(r["n_rows"] for r in rows) == 2500 and max(r["n_rows"] for r in rows) <= 1000
    assert rows[0]["stmt"].startswith("UPDATE `t` SET `v` = CASE WHEN (`id` = '")


def test_backfill_spans_are_bounded_when_keys_share_a_residue(spark):
    df = spark.range(-500, 2500).selectExpr("id * 16 AS id", "concat('v', id) AS v")
    rows = patch.backfill_by_span(df, "t", ["id"], ["v"], Dialect("mysql"), 160).collect()
    assert sum(r["n_rows"] for r in rows) == 3000 and max(r["n_rows"] for r in rows) <= 160 and min(r["batch"] for r in rows) == -50


def test_keyset_query_text():
    assert keyset_query(Dialect("oracle"), "t", ["a", "b"], ["a", "b"], 10, ["1", "2"]).endswith("FETCH NEXT 10 ROWS ONLY")
    assert '("a" = 1 AND "b" > 2)' in keyset_query(Dialect("sqlite"), "t", ["a", "b"], ["a", "b"], 10, ["1", "2"])
    assert "WHERE" not in keyset_query(Dialect("mysql"), "t", ["a"], ["a"], 10)


def test_pages_lose_nothing(spark):
    df = spark.range(250).withColumn("v", F.col("id") * 2)
    seen, last = [], None
    while page := rowdiff.keyset_page(df, ["id"], 60, last).collect():
        seen += [r["id"] for r in page]
        last = [page[-1]["id"]]
    assert seen == list(range(250))
