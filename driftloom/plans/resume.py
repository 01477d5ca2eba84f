"""Resumable comparisons: each table's result, or each key range's, is Parquet of its own, and a manifest names those that are done."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Event, Lock, Thread

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import rowdiff
from driftloom.sources import files

log = logging.getLogger(__name__)

#: Seconds after which a manifest is too old to resume from.
EXPIRES = 24 * 3600


class Manifest:
    """The state of a run in a folder that the driver and executors share."""

    def __init__(self, folder: str, fingerprint: str, now: Callable[[], float] = time.time):
        self.folder, self.fingerprint, self.now = folder.rstrip("/"), fingerprint, now
        self.path = f"{self.folder}/manifest.json"

    def load(self) -> dict[str, str]:
        """The finished tables and their paths; none if the manifest is missing, expired or of another configuration."""
        try:
            own = json.loads(files.read_text(self.path))
        except (FileNotFoundError, ValueError):
            return {}
        return own["tables"] if own["fingerprint"] == self.fingerprint and self.now() - own["started"] < EXPIRES else {}

    def done(self, table: str, path: str) -> None:
        own = {"fingerprint": self.fingerprint, "started": self.now(), "tables": self.load() | {table: path}}
        files.write_text(self.path, json.dumps(own, indent=1))

    def clear(self) -> None:
        files.remove(self.path)


class Progress:
    """Tells, while it is open, how many tasks of each table's jobs are done of all that Spark has begun; jobs are known by their group."""

    def __init__(self, spark: SparkSession, tell: Callable[[str, int, int], None], every: float = 2.0):
        self.spark, self.tell, self.every = spark, tell, every
        self.groups: dict[str, str] = {}
        self.stop = Event()

    def group(self, table: str) -> None:
        """From now on this thread's jobs are the table's."""
        name = f"driftloom-{table}-{uuid.uuid4().hex}"
        self.spark.sparkContext.setJobGroup(name, f"comparing {table}")
        self.groups[table] = name

    def counts(self, table: str) -> tuple[int, int]:
        tracker = self.spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self.groups[table])]
        stages = [tracker.getStageInfo(s) for s in sorted({s for j in jobs if j for s in j.stageIds})]
        return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)

    def report(self) -> None:
        for table in sorted(self.groups):
            self.tell(table, *self.counts(table))

    def __enter__(self) -> Progress:
        def watch() -> None:
            while not self.stop.wait(self.every):
                self.report()

        self.thread = Thread(target=watch, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.stop.set()
        self.thread.join()
        self.report()


def _logged(table: str, done: int, tasks: int) -> None:
    log.info("%s: %s of %s tasks", table, done, tasks)


def run_tables(spark: SparkSession, manifest: Manifest, plans: dict[str, DataFrame], parallel: int = 4, metrics: dict[str, dict] | None = None, tell: Callable[[str, int, int], None] = _logged) -> dict[str, DataFrame]:
    """Write each table's plan to the manifest's folder, several at a time, skipping those that are done; return them read back.

    metrics gets each written table's rows, as Spark observed them on the way, its seconds and its rows per second; the same is logged. tell hears of
    the tasks of each table as they end.
    """
    finished, lock = manifest.load(), Lock()

    def run(item: tuple[str, DataFrame]) -> None:
        table, plan = item
        path = f"{manifest.folder}/{table}.parquet"
        progress.group(table)
        seen, began = Observation(f"rows of {table}"), time.perf_counter()
        plan.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
        _measured(metrics, lock, table, seen.get["rows"], began)
        with lock:
            manifest.done(table, path)

    with Progress(spark, tell) as progress, ThreadPoolExecutor(parallel) as pool:
        list(pool.map(run, [(t, p) for t, p in sorted(plans.items()) if t not in finished]))
    return {t: spark.read.parquet(f"{manifest.folder}/{t}.parquet") for t in plans}


def _measured(metrics: dict[str, dict] | None, lock: Lock, table: str, rows: int, began: float) -> None:
    took = time.perf_counter() - began
    own = {"rows": rows, "seconds": round(took, 3), "rows_per_second": round(rows / max(took, 1e-9))}
    log.info("%s: %s", table, own)
    if metrics is not None:
        with lock:
            metrics[table] = own


def run_ranges(spark: SparkSession, manifest: Manifest, sides: dict[str, tuple[DataFrame, DataFrame, list[str], str]], ranges: dict[str, int], parallel: int = 4, metrics: dict[str, dict] | None = None, tell: Callable[[str, int, int], None] = _logged) -> dict[str, DataFrame]:
    """The row differences of tables whose comparison can be taken up inside a table. sides: both sides' (key columns, digest), the key and the status asked for.

    A table's steps are written one by one and noted in the manifest: each side's digests, dealt to so many ranges of a hash of the key, and then
    each range's difference, from the two folders of that range alone. A step overwrites its own folder only, so one that was cut
    off is done again with the same result, and what the manifest names is never read or written again.
    """
    finished, lock = set(manifest.load()), Lock()

    def step(name: str, table: str, plan: Callable[[], DataFrame], path: str, by: str | None = None) -> None:
        if name in finished:
            return
        progress.group(table)
        writer = plan().write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        with lock:
            manifest.done(name, path)

    def run(table: str) -> None:
        *both, key, status = sides[table]
        n, at, began = ranges[table], f"{manifest.folder}/{table}.steps", time.perf_counter()
        text = F.xxhash64(*[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in key])
        for side, df in zip(("prod", "dev"), both, strict=True):
            dealt = df.withColumn("range_", F.pmod(text, F.lit(n)).cast("int"))
            step(f"{table}/{side}", table, lambda dealt=dealt: dealt.repartition("range_", F.pmod(F.xxhash64("digest"), F.lit(8))), f"{at}/{side}", "range_")
        for k in range(n):
            p, d = (spark.read.schema(df.schema).parquet(f"{at}/{side}/range_={k}") if files.exists(f"{at}/{side}/range_={k}") else df.limit(0) for side, df in zip(("prod", "dev"), both, strict=True))
            step(f"{table}/{k}", table, lambda p=p, d=d: rowdiff.diff_of_digests(p, d, key, status), f"{manifest.folder}/{table}.parquet/range_={k}")
        out = spark.read.parquet(f"{manifest.folder}/{table}.parquet")
        _measured(metrics, lock, table, out.count(), began)

    with Progress(spark, tell) as progress, ThreadPoolExecutor(parallel) as pool:
        list(pool.map(run, sorted(sides)))
    return {t: spark.read.parquet(f"{manifest.folder}/{t}.parquet").drop("range_") for t in sides}
