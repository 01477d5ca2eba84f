"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query runs once to warm up and is then timed three times; the fastest run counts."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import rowdiff
from driftloom.plans import registry
from driftloom.sources.staging import scratch

NAMES = ("row_diff_all", "row_diff_updated", "row_diff_lineitem", "diff_counts_by_table", "multiset_diff", "cell_diff_long", "resolution_summary", "apply_patch", "pack_insert_sql", "schema_columns_diff")


def hash_orders(spark: SparkSession, d: str) -> DataFrame:
    """The published workload's shape: hash a table of an integer key and two other columns."""
    return rowdiff.hashed(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"])


def hash_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return rowdiff.hashed(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_orderkey", "l_linenumber"])


def hash_lineitem_dealt(spark: SparkSession, d: str) -> DataFrame:
    """The same after dealing the rows to all cores: the file is one row group, so that its scan alone is one task."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate")
    return rowdiff.hashed(lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), ["l_orderkey", "l_linenumber"])


def hash_lineitem_text(spark: SparkSession, d: str) -> DataFrame:
    """An integer key and two texts, as the published workload has, on the larger table."""
    return rowdiff.hashed(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_returnflag", "l_linestatus"), ["l_orderkey"])


def task_seconds(spark: SparkSession) -> float:
    """CPU seconds of all tasks so far, as Spark counts them."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).executorCpuTime() for i in range(stages.size())) / 1e9


def diff_orders(spark: SparkSession, d: str) -> DataFrame:
    prod, dev, key = registry.ORDERS.sides(spark, d)
    three = ("o_orderkey", "o_orderstatus", "o_orderpriority")
    return rowdiff.row_diff(prod.select(*three), dev.select(*three), key)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans = {"hash_orders": hash_orders, "hash_lineitem": hash_lineitem, "hash_lineitem_dealt": hash_lineitem_dealt, "hash_lineitem_text": hash_lineitem_text, "diff_orders": diff_orders} | {n: registry.QUERIES[n] for n in NAMES}
    took, busy = {}, {}
    for name, plan in plans.items():
        runs, tasks = [], []
        for _ in range(4):
            began, before = time.perf_counter(), task_seconds(spark)
            with scratch(spark):
                plan(spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
            tasks.append(task_seconds(spark) - before)
        took[name], busy[name] = round(min(runs[1:]), 3), round(min(tasks[1:]), 3)
    rows = {t: spark.read.parquet(f"{folder}/{t}.parquet").agg(F.count("*")).first()[0] for t in ("orders", "lineitem")}
    hashed = {"hash_orders": rows["orders"], "hash_lineitem": rows["lineitem"], "hash_lineitem_dealt": rows["lineitem"], "hash_lineitem_text": rows["lineitem"], "diff_orders": 2 * rows["orders"]}
    rates = {n: round(k / took[n]) for n, k in hashed.items()}
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows_per_sec": rates, "rows_per_task_cpu_sec": {n: round(k / max(busy[n], 1e-9)) for n, k in hashed.items()}, "task_cpu_sec": busy, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
