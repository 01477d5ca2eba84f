"""Line deduplication over levelled sorted runs of line hashes.

A run is a table (h1, h2, n) in the folder that driver and executors share: a line key's 128 hash bits and how many documents hold it, bucketed and sorted by
the hashes, so that merging with it neither shuffles nor sorts it again. Runs stand on levels; when a level has `fanout` of them they are
merged into one of the next level, so that R batches leave O(log R) runs and each count is rewritten O(log R) times. Each new
batch merge-anti-joins the runs: of what they have decided already nothing is added again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import BROADCAST_BYTES, maybe_broadcast, scratch, stage, text_of
from driftloom.sources import files
from driftloom.sources.staging import staged_path

#: Documents are dealt by hash into so many batches when a table is deduplicated at once.
BATCHES = 4
FANOUT = 2


def stripped(line: Column) -> Column:
    """The line without ASCII white space at its ends."""
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def line_key(line: Column) -> Column:
    """A stripped line with A-Z in lower case. Spark's lower does just that unless other capitals stand in the line."""
    plain = (F.octet_length(line) == F.char_length(line)) | ~line.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(plain, F.lower(line)).otherwise(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _hashes(key: Column) -> Column:
    """128 bits of a key, null for the empty one."""
    return F.when(key != "", F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))


def line_hashes(text: Column) -> Column:
    """The array of the hashes of a text's lines, in order; null where a key is empty."""
    keys = F.transform(F.transform(F.split(text, "\n", -1), stripped), line_key)
    return F.transform(keys, _hashes)


class LineRuns:
    """Levelled runs of line counts, as tables in the shared folder; drop() deletes them, and so does the scratch() around them."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout, self.levels, self.paths = spark, fanout, [], {}
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _run(self, counts: DataFrame, level: int) -> str:
        """Write a run, one sorted file per bucket, and return its name."""
        name = f"driftloom_lines_{level}_{uuid.uuid4().hex}"
        self.paths[name] = staged_path(self.spark, name)
        with _sorted_scans(self.spark):
            counts.repartition(self.buckets, "h1", "h2").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).saveAsTable(name)
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, counts: DataFrame) -> None:
        """Add a batch's counts (h1, h2, n; one row per key) as a run of level 0, then compact the full levels."""
        carry, level = self._run(counts, 0), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(carry)
            if len(self.levels[level]) < self.fanout:
                return
            merged, self.levels[level] = self.levels[level], []
            carry = self._run(self._summed([self.spark.table(x) for x in merged]), level + 1)
            self._delete(merged)
            level += 1

    @staticmethod
    def _summed(runs: list[DataFrame]) -> DataFrame:
        """Runs merged, counts of common keys added. Two runs meet as they are stored; a union would not do, since Spark takes one of bucketed tables for dealt by key when it is not."""
        merge = lambda a, b: a.join(b.withColumnRenamed("n", "m").hint("merge"), ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return reduce(merge, runs)

    def counts(self) -> DataFrame:
        """The counts of all batches so far."""
        runs = self.tables()
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        return runs[0] if len(runs) == 1 else self._summed(runs)

    def frequent(self, min_docs: int) -> DataFrame:
        return self.counts().where(F.col("n") >= min_docs).select("h1", "h2")

    def new_lines(self, lines: DataFrame, min_docs: int = 1) -> DataFrame:
        """The rows of lines (with h1, h2) whose key no run has with so many documents: one merge anti-join with each."""
        for run in self.tables():
            lines = lines.join(run.where(F.col("n") >= min_docs).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return lines

    def drop(self) -> None:
        self._delete([name for level in self.levels for name in level])
        self.levels = []

    def _delete(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            files.remove(self.paths.pop(name))


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made inside read a bucket of one file in its order, without sorting it again."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def batch_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h1, h2, n): in how many rows of docs each non-empty line key stands."""
    keys = F.array_distinct(F.array_compact(line_hashes(text_of(text_col))))
    return docs.select(F.explode(keys).alias("k")).groupBy("k.h1", "k.h2").agg(F.count("*").alias("n"))


def add_batch(runs: LineRuns, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Incremental use: the lines of this batch that no earlier batch had, as (id, line_no, line); then the batch joins the runs.

    Lines with an empty key are always new. Lines repeated within the batch all count as new.
    """
    text = text_of(text_col)
    lines = docs.select(F.col(id_col), F.posexplode(F.arrays_zip(F.split(text, "\n", -1).alias("line"), line_hashes(text).alias("h"))).alias("line_no", "x"))
    lines = lines.select(id_col, "line_no", F.col("x.line").alias("line"), F.col("x.h.h1").alias("h1"), F.col("x.h.h2").alias("h2"))
    with _sorted_scans(docs.sparkSession):
        new = stage(runs.new_lines(lines).select(id_col, "line_no", "line"), "lines-new")
    runs.add(batch_counts(docs, text_col))
    return new


def dedup_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fanout: int = FANOUT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with its lines of keys found in at least min_docs rows removed, and n_lines, n_dropped added.

    Keys are counted in batches that go through LineRuns: each batch is merge-anti-joined with the runs, which leaves out the keys
    that earlier batches have shown to be frequent, and its other counts are added. Counts are summed before and after each shuffle, so a line that
    stands in a third of all documents is one row per task. A text that loses all its lines becomes empty; a null or empty
    one is a single empty line, whose empty key never counts. Repeated rows count as so many documents. All other columns
    pass through unchanged, whatever their names but n_lines and n_dropped, which are replaced.
    """
    text = text_of(text_col)
    batch = F.pmod(F.xxhash64(text), F.lit(batches)).alias("batch")
    keys = F.array_distinct(F.array_compact(line_hashes(text)))
    with scratch(docs.sparkSession):
        by_batch = stage(docs.select(batch, F.explode(keys).alias("k")).groupBy("batch", "k.h1", "k.h2").agg(F.count("*").alias("n")), "lines-batches")
        runs = LineRuns(docs.sparkSession, fanout)
        try:
            for b in range(batches):
                runs.add(runs.new_lines(by_batch.where(F.col("batch") == b).select("h1", "h2", "n"), min_docs))
            frequent = maybe_broadcast(stage(runs.frequent(min_docs), "lines-frequent"), 32, broadcast_bytes)
        finally:
            runs.drop()

        # A text's frequent lines, by the text's own 128 bits: rows with equal texts share them.
        mark = F.struct(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
        at = docs.select(mark.alias("mark"), F.posexplode(line_hashes(text)).alias("line_no", "k"))
        hits = at.where("k is not null").select("mark.t1", "mark.t2", "line_no", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
        hits = hits.join(frequent, ["h1", "h2"], "left_semi")
        drops = hits.groupBy("t1", "t2").agg(F.array_sort(F.collect_set("line_no")).alias("drop"))
        drops = stage(drops, "lines-drops", lasting=True)
    width = drops.agg(F.coalesce(F.sum(F.size("drop") * 4 + 64), F.lit(0))).first()[0]
    drops = F.broadcast(drops) if width <= broadcast_bytes else drops

    out = docs.drop("n_lines", "n_dropped")
    # internal names that no column of docs has
    names = {x.lower() for x in docs.columns}
    t1, t2, drop = (next(n for n in (f"{x}{'_' * i}" for i in range(99)) if n not in names) for x in ("t1", "t2", "drop"))
    out = out.withColumn(t1, F.xxhash64(text)).withColumn(t2, F.xxhash64(F.lit(1), text))
    out = out.join(drops.toDF(t1, t2, drop), [t1, t2], "left")
    lines = F.split(text, "\n", -1)
    kept = F.when(F.col(drop).isNull(), text).otherwise(F.array_join(_without(lines, F.col(drop)), "\n"))
    dropped = F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long")
    order = [kept.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.drop("n_lines", "n_dropped").columns]
    return out.select(*order, F.size(lines).cast("long").alias("n_lines"), dropped.alias("n_dropped"))


def _without(lines: Column, drop: Column) -> Column:
    """The lines whose positions are not in the sorted array drop: the slices between its members, joined."""
    ends = F.concat(drop, F.array(F.size(lines)))
    gaps = F.transform(ends, lambda e, j: F.slice(lines, F.coalesce(F.get(drop, j - 1) + 2, F.lit(1)), e - F.coalesce(F.get(drop, j - 1) + 1, F.lit(0))))
    return F.flatten(gaps)
