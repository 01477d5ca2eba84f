"""Reading tables: Parquet directories, JDBC databases in key ranges, SQLite files in row ranges."""

from __future__ import annotations

import sqlite3
from datetime import date
from decimal import Decimal
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftloom.functions.retry import connected, retry
from driftloom.plans.dialects import PORTS, Dialect
from driftloom.sources import versions
from driftloom.sources.config import Source


def parquet_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a folder, as its last version has it."""
    return versions.read(spark, path, table)


def jdbc_url(source: Source) -> str:
    """The JDBC address; credentials go into properties, not into the text."""
    port = source.port or PORTS.get(source.driver, 0)
    return {
        "mysql": f"jdbc:mysql://{source.host}:{port}/{source.database}",
        "postgres": f"jdbc:postgresql://{source.host}:{port}/{source.database}",
        "mssql": f"jdbc:sqlserver://{source.host}:{port};databaseName={source.database}",
        "oracle": f"jdbc:oracle:thin:@//{source.host}:{port}/{source.database}",
        "sqlite": f"jdbc:sqlite:{source.path or source.database}",
    }[source.driver]


#: Seconds that a driver waits for its database to answer.
CONNECT_SECONDS = 5


def connect_timeout(driver: str) -> dict[str, str]:
    """The property by which an engine's driver takes that time, in its unit."""
    own = {"mysql": ("connectTimeout", 1000), "postgres": ("connectTimeout", 1), "mssql": ("loginTimeout", 1), "oracle": ("oracle.net.CONNECT_TIMEOUT", 1000)}
    return {own[driver][0]: str(own[driver][1] * CONNECT_SECONDS)} if driver in own else {}


def jdbc_options(source: Source, table: str, split: tuple[str, int, int] | None = None, partitions: int = 8, fetch_size: int = 10_000) -> dict[str, str]:
    """Options of a scan: with split (an integer key column with its least and greatest value) the database is read in so many ranges at once."""
    own = {"url": jdbc_url(source), "dbtable": Dialect(source.driver).quote(table), "user": source.user, "password": source.password, "fetchsize": str(fetch_size), **connect_timeout(source.driver)}
    if split:
        own |= {"partitionColumn": Dialect(source.driver).quote(split[0]), "lowerBound": str(split[1]), "upperBound": str(split[2]), "numPartitions": str(partitions)}
    return own


def jdbc_query(spark: SparkSession, source: Source, query: str) -> DataFrame:
    """The rows of a query that the database runs; refused or broken connections are tried again."""
    return retry(lambda: connected(lambda: spark.read.format("jdbc").options(url=jdbc_url(source), user=source.user, password=source.password, query=query, **connect_timeout(source.driver)).load()))


#: By engine, whether a row's key falls in the given of so many parts, for keys that are no integers.
HASHED = {
    "mysql": "MOD(CRC32({k}), {n}) = {i}", "postgres": "MOD(ABS(CAST(HASHTEXT(CAST({k} AS text)) AS bigint)), {n}) = {i}",
    "mssql": "ABS(CAST(CHECKSUM({k}) AS bigint)) % {n} = {i}", "oracle": "ORA_HASH({k}, {n} - 1) = {i}",
}


def hash_predicates(driver: str, key: Sequence[str], partitions: int) -> list[str]:
    """A condition per partition over the key's columns as one text; each row meets one of them."""
    own = [Dialect(driver).quote(k) for k in key]
    joined = own[0] if len(own) == 1 else f"CONCAT({', '.join(own)})" if driver == "mysql" else (" + '|' + " if driver == "mssql" else " || '|' || ").join(f"CAST({k} AS {'text' if driver == 'postgres' else 'varchar(4000)'})" for k in own)
    return [HASHED[driver].format(k=joined, n=partitions, i=i) for i in range(partitions)]


def _literal(value, driver: str) -> str | None:
    """A key's value in SQL; None for types whose literals differ too much between engines."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, str):
        return "'" + (value.replace("\\", "\\\\") if driver == "mysql" else value).replace("'", "''") + "'"
    return f"DATE '{value}'" if type(value) is date else None


def _beyond(names: Sequence[str], values: Sequence[str], sign: str) -> str:
    """The condition that a key of some columns lies after the values, or before or at them, compared column by column."""
    tests = [" AND ".join([*(f"{k} = {v}" for k, v in zip(names[:i], values[:i], strict=True)), f"{names[i]} {sign} {values[i]}"]) for i in range(len(names))]
    whole = " AND ".join(f"{k} = {v}" for k, v in zip(names, values, strict=True))
    return "(" + " OR ".join(f"({t})" for t in [*tests, *([whole] if sign == "<" else [])]) + ")"


def quantile_predicates(spark: SparkSession, source: Source, table: str, key: Sequence[str], partitions: int) -> list[str] | None:
    """A condition per partition: ranges of the whole key that hold as many rows each, so that every row is read by one of them and found by the key's index.

    The bounds are keys that the database finds by their position in key order, a walk along the index each. None if a bound has no plain literal.
    """
    dialect = Dialect(source.driver)
    names, q = [dialect.quote(k) for k in key], dialect.quote
    n = int(jdbc_query(spark, source, f"SELECT COUNT(*) AS n FROM {q(table)}").first()[0])
    bounds: list[list[str]] = []
    for at in sorted({n * i // partitions for i in range(1, partitions)} - {0}):
        page = f"LIMIT 1 OFFSET {at - 1}" if source.driver == "mysql" else f"OFFSET {at - 1} ROWS FETCH NEXT 1 ROWS ONLY"
        row = jdbc_query(spark, source, f"SELECT {', '.join(names)} FROM {q(table)} ORDER BY {', '.join(names)} {page}").first()
        values = [_literal(v, source.driver) for v in row] if row else []
        if None in values:
            return None
        if values and values not in bounds:
            bounds.append(values)
    if not bounds:
        return ["1 = 1"]
    first = f"({_beyond(names, bounds[0], '<')} OR {' OR '.join(f'{k} IS NULL' for k in names)})"
    between = [f"{_beyond(names, a, '>')} AND {_beyond(names, b, '<')}" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return [first, *between, _beyond(names, bounds[-1], ">")]


def jdbc_table(spark: SparkSession, source: Source, table: str, key: Sequence[str] = (), partitions: int = 8, fetch_size: int = 10_000) -> DataFrame:
    """A table, read in several connections at once: in ranges of the key's first column if it is an integer, else of the whole key by its quantiles, or where its values have no plain literals by its hash; without a key in one."""
    load = lambda **o: retry(lambda: connected(lambda: spark.read.format("jdbc").options(**jdbc_options(source, table, **o, partitions=partitions, fetch_size=fetch_size)).load()))
    whole = load()
    if not key or partitions < 2:
        return whole
    if isinstance(whole.schema[key[0]].dataType, T.IntegralType) or (isinstance(whole.schema[key[0]].dataType, T.DecimalType) and whole.schema[key[0]].dataType.scale == 0):
        q = Dialect(source.driver).quote
        low, high = jdbc_query(spark, source, f"SELECT MIN({q(key[0])}) AS low, MAX({q(key[0])}) AS high FROM {q(table)}").first()
        return whole if low is None or low == high else load(split=(key[0], int(low), int(high)))
    properties = {"user": source.user, "password": source.password, "fetchsize": str(fetch_size), **connect_timeout(source.driver)}
    return spark.read.jdbc(jdbc_url(source), Dialect(source.driver).quote(table), predicates=quantile_predicates(spark, source, table, key, partitions) or hash_predicates(source.driver, key, partitions), properties=properties)


_SQLITE_TYPES = (("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("BLOB", T.BinaryType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()))


def sqlite_type(declared: str) -> T.DataType:
    """The Spark type of a declared SQLite type, by its affinity; text where numbers may be anything."""
    return next((t for part, t in _SQLITE_TYPES if part in declared.upper()), T.StringType())


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.parts, self.kinds = options["path"], options["table"], int(options.get("partitions", 4)), schema

    def partitions(self) -> Sequence[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            quoted = self.table.replace('"', '""')
            try:
                low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{quoted}"').fetchone()
            except sqlite3.OperationalError:  # a table without row ids is read at once
                return [_Rows(0, -1)]
        if low is None:
            return [_Rows(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        quoted = self.table.replace('"', '""')
        names = ", ".join('"' + f.name.replace('"', '""') + '"' for f in self.kinds)
        where = f" WHERE rowid >= {part.low} AND rowid < {part.high}" if part.high >= 0 else ""
        cast = [str if isinstance(f.dataType, T.StringType) else float if isinstance(f.dataType, T.DoubleType) else bytes if isinstance(f.dataType, T.BinaryType) else int for f in self.kinds]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f'SELECT {names} FROM "{quoted}"{where}'):
                yield tuple(v if v is None else v.encode() if c is bytes and isinstance(v, str) else c(v) for v, c in zip(row, cast, strict=True))


class SqliteSource(DataSource):
    """spark.read.format("sqlite_rows").options(path=.., table=..): a table in ranges of its row ids. The file must be on every executor."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> T.StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            quoted = self.options["table"].replace('"', '""')
            rows = db.execute(f'PRAGMA table_info("{quoted}")').fetchall()
        return T.StructType([T.StructField(r[1], sqlite_type(r[2] or "")) for r in rows])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


def sqlite_table(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_rows").options(path=path, table=table, partitions=str(partitions)).load()


def read_table(spark: SparkSession, source: Source, table: str, key: Sequence[str] = (), partitions: int = 8, fetch_size: int = 10_000) -> DataFrame:
    """A table of a side. Parquet is split by Spark, a database by its key into so many ranges, read so many rows at a time."""
    if source.driver == "parquet":
        return parquet_table(spark, source.path or source.database, table)
    if source.driver == "sqlite":
        return sqlite_table(spark, source.path or source.database, table, partitions)
    return jdbc_table(spark, source, table, key, partitions, fetch_size)
