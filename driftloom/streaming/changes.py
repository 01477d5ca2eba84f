"""Change capture: a stream of row changes folded into a keyed table, and the running difference from a fixed side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from driftloom.functions.canonical import row_hash
from driftloom.operators.rowdiff import ADDED, REMOVED, UNCHANGED, UPDATED, row_diff
from driftloom.sources import files


def latest(changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last change of each key, later ones by the order columns."""
    rest = [c for c in changes.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def fold(table: DataFrame, changes: DataFrame, key: Sequence[str], order: Sequence[str], op: str = "op") -> DataFrame:
    """table after a batch of changes, each an upsert or, where op is "delete", a removal; only the last change of a key counts."""
    last = latest(changes, key, order)
    stay = table.join(last.select(*key), list(key), "left_anti")
    return stay.unionByName(last.where(F.col(op) != "delete").select(table.columns))


def running_diff(stream: DataFrame, key: Sequence[str], order: Sequence[str], read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], fixed: DataFrame, report: Callable[[DataFrame, int], None], checkpoint: str, late: tuple[str, str] | None = None) -> StreamingQuery:
    """Fold each micro-batch into the table that read gives and write replaces, and report its difference from the fixed side.

    write gets the batch's number and must be idempotent for it, as a batch can come again after a failure. late names the time column and how
    long after it a change sent again is still known as one that came before.
    """
    stream = late_bounded(stream, *late, key) if late else stream

    def batch(changes: DataFrame, number: int) -> None:
        write(fold(read(), changes, key, order), number)
        report(row_diff(fixed, read(), key), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def sided(rows: DataFrame, side: str, key: Sequence[str], columns: Sequence[str], order: dict[str, T.DataType], op: str | None = None) -> DataFrame:
    """(key columns, side, digest, gone, place) of a side's rows, or of its changes where op names their kind: what a running difference takes in.

    order gives the columns that order changes, with their types; rows without them come before any change.
    """
    place = F.struct(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in order.items()])
    gone = F.col(op) == "delete" if op else F.lit(False)
    return rows.select(*key, F.lit(side).alias("side"), F.unhex(row_hash(rows, columns)).alias("digest"), F.coalesce(gone, F.lit(False)).alias("gone"), place.alias("place"))


def status_changes(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key columns, status, prod_hash, dev_hash) of the keys that a micro-batch of sided() rows touches; status is unchanged where the sides agree, or neither has the key.

    The state is one row per key: the last digest of each side. So a batch of k changes reads and emits k keys, whatever the tables hold. For the update output mode.
    """
    last = lambda side: F.max_by(F.struct("digest", "gone"), F.when(F.col("side") == side, F.col("place")))
    held = rows.groupBy(*key).agg(last("prod").alias("p"), last("dev").alias("d"))
    ours, theirs = (F.when(~F.col(f"{x}.gone"), F.col(f"{x}.digest")) for x in ("p", "d"))
    status = F.when(ours.eqNullSafe(theirs), UNCHANGED).when(ours.isNull(), ADDED).when(theirs.isNull(), REMOVED).otherwise(UPDATED)
    return held.select(*key, status.alias("status"), F.lower(F.hex(ours)).alias("prod_hash"), F.lower(F.hex(theirs)).alias("dev_hash"))


class RunningDiff:
    """The difference of two sides kept up to date by streams of their changes: a folder of status changes, one part for each micro-batch."""

    def __init__(self, spark: SparkSession, folder: str, key: Sequence[str]):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), list(key)

    def start(self, rows: DataFrame, **trigger) -> StreamingQuery:
        """Take in a stream of sided() rows. A batch that comes again after a failure overwrites its own part."""

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.folder}/status/batch={number}")

        query = status_changes(rows, self.key).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (query.trigger(**trigger) if trigger else query).start()

    def _numbers(self, place: str, prefix: str = "") -> list[int]:
        """The numbers that a folder's members are named by."""
        found = files.names(f"{self.folder}/{place}") if files.exists(f"{self.folder}/{place}") else []
        return sorted(int(x.removeprefix(prefix)) for x in found if x.removeprefix(prefix).isdigit())

    def _folded(self) -> int:
        return max(self._numbers("folded"), default=-1)

    def batches(self) -> DataFrame:
        """The status changes of the batches that are not folded, with the number of their batch."""
        own = [f"{self.folder}/status/batch={n}" for n in self._numbers("status", "batch=") if n > self._folded()]
        if own:
            return self.spark.read.option("basePath", f"{self.folder}/status").parquet(*own)
        return self.spark.read.parquet(f"{self.folder}/status" if self._folded() < 0 else self._base(self._folded())).limit(0)

    def _base(self, number: int) -> str:
        return f"{self.folder}/base/{number}"

    def _last(self, upto: int | None = None) -> DataFrame:
        """The last status of each key by that batch; of keys that were folded, those that differ."""
        rows, folded = self.batches(), self._folded()
        rows = rows if upto is None else rows.where(F.col("batch") <= upto)
        return latest(rows if folded < 0 else self.spark.read.parquet(self._base(folded)).unionByName(rows), self.key, ["batch"])

    def current(self) -> DataFrame:
        """(key columns, status, prod_hash, dev_hash) of the keys that differ now: the last status of each."""
        return self._last().where(F.col("status") != UNCHANGED).drop("batch")

    def compact(self) -> int:
        """Fold the batches that the stream has committed into one table of the keys that differ; what is current reads that and later batches. Returns the last batch folded, or -1.

        So what is kept and read grows with the keys that differ and the batches since, not with all changes there were. A compaction that is cut off
        leaves no mark and changes nothing: its table is written anew by the next. One runs at a time, beside the stream or not; the folded parts go at
        its end, so ask again for what is current after it.
        """
        folded, upto = self._folded(), max(self._numbers("checkpoint/commits"), default=-1)
        if upto <= folded:
            return folded
        self._last(upto).where(F.col("status") != UNCHANGED).write.mode("overwrite").parquet(self._base(upto))
        files.create_text(f"{self.folder}/folded/{upto}", "")
        for place in [f"status/batch={n}" for n in self._numbers("status", "batch=") if n <= upto] + [f"base/{n}" for n in self._numbers("base") if n < upto]:
            files.remove(f"{self.folder}/{place}")
        return upto


def late_bounded(stream: DataFrame, time: str, delay: str, key: Sequence[str]) -> DataFrame:
    """The stream without changes that came before, by key and time, within the watermark's delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([*key, time])


def change_positions(changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each change numbered within its key, for replaying a batch."""
    return changes.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
