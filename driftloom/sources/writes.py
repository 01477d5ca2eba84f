"""Applying changes to a network database: Spark writes them to staging tables in parallel, then one transaction of set statements moves them over."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from driftloom.functions.retry import DriftError, connected, retry
from driftloom.plans.dialects import Dialect
from driftloom.sources import tables
from driftloom.sources.config import Source


def create_like(dialect: Dialect, new: str, table: str, columns: Sequence[str]) -> str:
    """The statement that makes an empty table with some columns of another, in the types that these have there."""
    q, names = dialect.quote, ", ".join(map(dialect.quote, columns))
    if dialect.name == "mssql":
        return f"SELECT {names} INTO {q(new)} FROM {q(table)} WHERE 1 = 0"
    return f"CREATE TABLE {q(new)} AS SELECT {names} FROM {q(table)} {'WITH NO DATA' if dialect.name == 'postgres' else 'WHERE 1 = 0'}"


class Connection:
    """One connection of the driver's, through Java, for statements that return no rows."""

    def __init__(self, spark: SparkSession, source: Source):
        jvm, url = spark._jvm, tables.jdbc_url(source)
        properties = jvm.java.util.Properties()
        for k, v in {"user": source.user, "password": source.password, **tables.connect_timeout(source.driver)}.items():
            properties.setProperty(k, v)
        self.own = retry(lambda: connected(lambda: jvm.java.sql.DriverManager.getConnection(url, properties)))

    def run(self, statement: str) -> int:
        """The number of rows that a statement changed."""
        own = self.own.createStatement()
        try:
            return own.executeUpdate(statement)
        finally:
            own.close()


def apply_to_database(spark: SparkSession, source: Source, changes: dict[str, tuple[DataFrame, DataFrame, Sequence[str]]], dry_run: bool = False) -> dict[str, tuple[int, int]]:
    """Apply each table's (keys that go, rows that come, key), given with referenced tables first; the numbers of rows deleted and inserted, or with dry_run those that would be.

    Spark's tasks write staging tables, which nobody reads yet; a task that runs again may write a row twice, which is told by counting.
    Then one transaction deletes, children before their parents, and inserts, parents before children. If a statement fails or the rows it changes
    are not as many as the changes name, so that prod is not what they were made from, all is rolled back. Staging tables go in any case.
    """
    dialect, run_id = Dialect(source.driver), uuid.uuid4().hex[:12]
    q, out, staged = dialect.quote, {}, {}
    db = Connection(spark, source)
    try:
        for n, (table, (deletes, upserts, key)) in enumerate(changes.items()):
            staged[table] = f"dl_{run_id}_{n}_del", f"dl_{run_id}_{n}_new"
            for name, rows in zip(staged[table], (deletes.select(*key), upserts), strict=True):
                db.run(create_like(dialect, name, table, rows.columns))
                properties = {"user": source.user, "password": source.password, "batchsize": "1000"}
                rows.write.jdbc(tables.jdbc_url(source), q(name), "append", properties)
            out[table] = deletes.count(), upserts.count()
        db.own.setAutoCommit(False)
        try:
            for table in reversed(list(changes)):
                same = " AND ".join(f"s.{q(k)} = {q(table)}.{q(k)}" for k in changes[table][2])
                _exactly(db.run(f"DELETE FROM {q(table)} WHERE EXISTS (SELECT 1 FROM {q(staged[table][0])} s WHERE {same})"), out[table][0], f"{table}: deleted")
            for table, (_, upserts, _) in changes.items():
                names = ", ".join(map(q, upserts.columns))
                _exactly(db.run(f"INSERT INTO {q(table)} ({names}) SELECT {names} FROM {q(staged[table][1])}"), out[table][1], f"{table}: inserted")
        except Exception as e:
            db.own.rollback()
            raise e if isinstance(e, DriftError) else DriftError("APPLY_FAILED", " ".join(str(e).split("\n")[:2])) from e
        db.own.rollback() if dry_run else db.own.commit()
    finally:
        db.own.setAutoCommit(True)
        for name in (x for own in staged.values() for x in own):
            try:
                db.run(f"DROP TABLE {q(name)}")
            except Exception:  # noqa: BLE001  it was never made
                pass
        db.own.close()
    return out


def _exactly(rows: int, wanted: int, what: str) -> None:
    if rows != wanted:
        raise DriftError("BASE_CHANGED", f"{what} {rows} rows, {wanted} expected")
