"""Row comparison of digests that are kept dealt and sorted by key, so that comparing them again and again shuffles nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from driftloom.functions.retry import DriftError
from driftloom.operators import rowdiff

#: Rows that a bucket, and so a task of the join, holds, about.
BUCKET_ROWS = 1 << 22


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made inside read a bucket of one file in its order, without sorting it again."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep_digests(df: DataFrame, key: Sequence[str], table: str, path: str, buckets: int | None = None, ignored: Callable[[str], bool] = lambda name: False) -> None:
    """Write (key columns, digest) of a side as a table of buckets by key, one sorted file each, in a folder that all executors share.

    Both sides need the same number of buckets: a power of two by the rows of the larger, or what is given. Null keys are refused, as no join by
    storage could match them.
    """
    if df.where(" OR ".join(f"`{k}` IS NULL" for k in key)).limit(1).count():
        raise DriftError("NULL_KEY", f"table {table}")
    digests = rowdiff.digests(df, df, key, ignored)[0]
    n = buckets or bucket_count(df.count())
    digests.repartition(n, *key).write.bucketBy(n, *key).sortBy(*key).option("path", path).mode("overwrite").saveAsTable(table)


def bucket_count(rows: int) -> int:
    return 1 << max(0, (rows - 1) // BUCKET_ROWS).bit_length()


def diff_kept(spark: SparkSession, prod: str, dev: str, key: Sequence[str], status: str = "all") -> DataFrame:
    """The row difference of two kept tables, joined bucket by bucket as they are stored. The plan is fixed as it is asked for."""
    with sorted_scans(spark):
        found = rowdiff.diff_of_digests(spark.table(prod).hint("merge"), spark.table(dev), key, status, null_keys=False)
        found._jdf.queryExecution().executedPlan()
    return found
