"""Patches that turn prod into dev: as DataFrames, and as SQL statements."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions.canonical import shared_columns, sql_literal
from driftloom.operators.rowdiff import _on, aligned
from driftloom.plans.dialects import Dialect

#: Rows that one back-fill statement updates.
BATCH_ROWS = 1000
#: The same for SQLite, whose expressions are at most 1000 deep, an OR being one deeper for each term.
SQLITE_BATCH_ROWS = 500


def patch_deletes(diff: DataFrame, key: Sequence[str], delete_rows: bool = True) -> DataFrame:
    """Keys that leave prod: updated ones, to come back with new values, and removed ones unless delete_rows is off."""
    return diff.where(F.col("status").isin("removed", "updated") if delete_rows else F.col("status") == "updated").select(*key)


def patch_upserts(diff: DataFrame, dev: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The dev rows of added and updated keys: one join instead of a read per key."""
    k = diff.where(F.col("status").isin("added", "updated")).select(*key).alias("k")
    rows = dev.alias("d").join(k, _on("d", "k", key), "left_semi")
    return rows.select(*columns) if columns else rows


def apply_patch(prod: DataFrame, deletes: DataFrame, upserts: DataFrame, key: Sequence[str]) -> DataFrame:
    """prod after the patch; columns that only upserts have are null in the rows that stay."""
    upserts = aligned(upserts, prod)
    stay = prod.alias("p").join(deletes.alias("x"), _on("p", "x", key), "left_anti")
    return stay.unionByName(upserts, allowMissingColumns=True)


def _equals(df: DataFrame, key: Sequence[str], dialect: Dialect) -> Column:
    return F.concat_ws(" AND ", *[F.concat(F.lit(f"{dialect.quote(k)} = "), sql_literal(F.col(k), df.schema[k].dataType, dialect.typed, dialect.name)) for k in key])


def delete_statements(deletes: DataFrame, table: str, key: Sequence[str], dialect: Dialect) -> DataFrame:
    """(key columns, stmt): one DELETE per row."""
    return deletes.select(*key, F.concat(F.lit(f"DELETE FROM {dialect.quote(table)} WHERE "), _equals(deletes, key, dialect), F.lit(";")).alias("stmt"))


def insert_statements(upserts: DataFrame, table: str, key: Sequence[str], dialect: Dialect, columns: Sequence[str] | None = None) -> DataFrame:
    """(key columns, stmt): one INSERT per row, of the given columns or the key and then the others by name."""
    columns = columns or shared_columns(upserts.columns, upserts.columns, key)
    head = f"INSERT INTO {dialect.quote(table)} ({', '.join(map(dialect.quote, columns))}) VALUES ("
    values = F.concat_ws(", ", *[sql_literal(F.col(c), upserts.schema[c].dataType, dialect.typed, dialect.name) for c in columns])
    return upserts.select(*key, F.concat(F.lit(head), values, F.lit(");")).alias("stmt"))


def add_column_statements(columns: DataFrame, dialect: Dialect) -> DataFrame:
    """(table, column, stmt): an ALTER TABLE per catalog row (table, column, data_type, is_nullable, default_value), which dev has and prod lacks.

    A default is written as the catalog has it; a column without one that may not be null needs an empty table, as the script's comment says.
    """
    a, b = dialect.marks
    quoted = lambda c: F.concat(F.lit(a), F.replace(F.col(c), F.lit(b), F.lit(b + b)), F.lit(b))
    parts = [F.lit("ALTER TABLE"), quoted("table"), F.lit(dialect.add_column), quoted("column"), F.col("data_type"), F.when(~F.col("is_nullable"), "NOT NULL"), F.concat(F.lit("DEFAULT "), F.col("default_value"))]
    return columns.select("table", "column", F.concat(F.concat_ws(" ", *parts), F.lit(";")).alias("stmt"))


def backfill_statements(rows: DataFrame, table: str, key: Sequence[str], new_columns: Sequence[str], dialect: Dialect, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """(part, batch, n_rows, first, stmt), first being the key of a batch's first row: UPDATE .. CASE statements that fill new columns, at most batch_rows rows each.

    Rows are dealt to key-ordered partitions by range and numbered within them, so no window spans the table: batches are of
    (part, number within it).
    """
    own = rows.select(*key, *new_columns).repartitionByRange(*key).withColumn("part", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy("part").orderBy(*key))
    own = own.withColumn("batch", F.floor((number - 1) / batch_rows)).withColumn("_where", F.concat(F.lit("("), _equals(rows, key, dialect), F.lit(")")))
    return _case_updates(own, ["part", "batch"], table, key, new_columns, dialect, rows)


def backfill_by_hash(rows: DataFrame, table: str, key: Sequence[str], new_columns: Sequence[str], dialect: Dialect, buckets: int) -> DataFrame:
    """The same with batches named by the integer key modulo a number of buckets: no window at all; for keys that are dealt evenly."""
    own = rows.select(*key, *new_columns).withColumn("batch", F.pmod(F.col(key[0]), F.lit(buckets))).withColumn("_where", F.concat(F.lit("("), _equals(rows, key, dialect), F.lit(")")))
    return _case_updates(own, ["batch"], table, key, new_columns, dialect, rows).drop("first")


def backfill_by_span(rows: DataFrame, table: str, key: Sequence[str], new_columns: Sequence[str], dialect: Dialect, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The same with batches named by the integer key divided by batch_rows: a unique key gives at most batch_rows rows each, however it is dealt, without a window."""
    if len(key) != 1:
        raise ValueError("spans need a key of one column")
    own = rows.select(*key, *new_columns).withColumn("batch", F.expr(f"(`{key[0]}` - pmod(`{key[0]}`, {batch_rows})) div {batch_rows}")).withColumn("_where", F.concat(F.lit("("), _equals(rows, key, dialect), F.lit(")")))
    return _case_updates(own, ["batch"], table, key, new_columns, dialect, rows).drop("first")


def _case_updates(own: DataFrame, groups: list[str], table: str, key: Sequence[str], new_columns: Sequence[str], dialect: Dialect, typed: DataFrame) -> DataFrame:
    lines = {c: F.concat(F.lit("WHEN "), F.col("_where"), F.lit(" THEN "), sql_literal(F.col(c), typed.schema[c].dataType, dialect.typed, dialect.name)) for c in new_columns}
    listed = own.groupBy(*groups).agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.struct(*key, F.col("_where").alias("_w"), *[x.alias(f"_c{i}") for i, x in enumerate(lines.values())]))).alias("rows"))
    cases = [F.concat(F.lit(f"{dialect.quote(c)} = CASE "), F.array_join(F.transform("rows", _field(f"_c{i}")), " "), F.lit(f" ELSE {dialect.quote(c)} END")) for i, c in enumerate(new_columns)]
    where = F.array_join(F.transform("rows", _field("_w")), " OR ")
    stmt = F.concat(F.lit(f"UPDATE {dialect.quote(table)} SET "), F.concat_ws(", ", *cases), F.lit(" WHERE "), where, F.lit(";"))
    first = F.struct(*[F.col("rows")[0][k].alias(k) for k in key])
    return listed.select(*groups, "n_rows", first.alias("first"), stmt.alias("stmt"))


def _field(name: str):
    return lambda x: x[name]


def pack_statements(diff: DataFrame, prod: DataFrame, dev: DataFrame, table: str, key: Sequence[str], dialect: Dialect, delete_rows: bool = True, new_columns: Sequence[str] = (), ignored: Callable[[str], bool] = lambda name: False) -> DataFrame:
    """(phase, key columns, stmt) of a table's deletes, inserts and back-fills; ordering by (phase, key) gives the script's order.

    New columns, which dev alone has, must have been added to the table. Inserted rows bring their values; the other rows of dev,
    which stay in prod, get them by back-fill, named by the key of a batch's first row. Ignored columns are never written.
    """
    dev = aligned(dev, prod)
    columns = [*shared_columns(dev.columns, prod.columns, key, ignored), *new_columns]
    gone = delete_statements(patch_deletes(diff, key, delete_rows), table, key, dialect).withColumn("phase", F.lit(1))
    come = insert_statements(patch_upserts(diff, dev, key), table, key, dialect, columns).withColumn("phase", F.lit(2))
    found = gone.unionByName(come).select("phase", *key, "stmt")
    if not new_columns:
        return found
    put = diff.where(F.col("status").isin("added", "updated")).select(*key)
    stay = dev.alias("d").join(put.alias("k"), _on("d", "k", key), "left_anti")
    fill = backfill_statements(stay, table, key, new_columns, dialect, SQLITE_BATCH_ROWS if dialect.name == "sqlite" else BATCH_ROWS)
    return found.unionByName(fill.select(F.lit(3).alias("phase"), *[F.col("first")[k].alias(k) for k in key], "stmt"))


def write_pack(statements: DataFrame, order: Sequence[str], path: str, dialect: Dialect, before: Sequence[str] = (), after: Sequence[str] = ()) -> None:
    """A table's pack as text files in path, whose names in order give the script: header, body by phase in range-sorted parts, footer."""
    spark = statements.sparkSession
    head, foot = [*dialect.begin(), *before], [*after, *dialect.commit()]
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{path}/0-header")
    statements.orderBy(*order).select(F.col("stmt").alias("value"), "phase").write.partitionBy("phase").text(f"{path}/1-body")
    spark.createDataFrame([("\n".join(foot),)], "value string").coalesce(1).write.text(f"{path}/2-footer")


def write_pack_order(spark: SparkSession, tables: Sequence[str], path: str) -> None:
    """The order of a folder of tables' packs, referenced tables first, as a file beside them."""
    spark.createDataFrame([("\n".join(tables),)], "value string").coalesce(1).write.text(f"{path}/order")


def read_pack(spark: SparkSession, path: str) -> Iterator[str]:
    """The texts of a pack's files in the order of the script, one at a time; each holds whole statements.

    path is one table's pack, or a folder of packs with their order: then all headers come first, with the schema changes, then all tables'
    deletes, children before their parents, then inserts and back-fills, parents before children. Files are listed and read by Spark, wherever they lie.
    """
    files = [unquote(x) for x in spark.read.text(path, recursiveFileLookup=True).inputFiles()]
    whole = lambda file: spark.read.text(file, wholetext=True).first()
    rank = {}
    for file in files:
        if file.split("/")[-2] == "order":
            rank = {t: n for n, t in enumerate(whole(file)[0].split("\n"))}

    def place(file: str) -> tuple:
        *_, table, section, phase, name = ["", *file.split("/")] if "phase=" in file.split("/")[-2] else [*file.split("/")[:-1], "", file]
        n = rank.get(table, 0)
        return section, phase, -n if phase == "phase=1" else n, name

    for file in sorted((x for x in files if x.split("/")[-2] != "order"), key=place):
        if found := whole(file):
            yield found[0]
