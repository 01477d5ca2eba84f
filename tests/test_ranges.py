"""Comparison by digests of key ranges, in steps that can be taken up again, and its progress."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftloom.functions.retry import DriftError
from driftloom.operators import copartitioned, ranges, rowdiff
from driftloom.plans import resume
from driftloom.plans.compare import Comparison
from driftloom.sources import config as cfg


def view(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def pair(spark, n=4000, few=4, text_key=False):
    df = spark.range(-n // 2, n // 2, 1, 4).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v"))
    r = random.Random(1)
    changed = r.sample(range(-n // 2, n // 2), few)
    dev = df.withColumn("v", F.when(F.col("k").isin(changed), "new").otherwise(F.col("v"))).where(F.col("k") != changed[0]).unionByName(spark.createDataFrame([(10 * n, "added")], "k long, v string"))
    if text_key:
        df, dev = (x.withColumn("k", F.concat(F.lit("key"), F.col("k"))) for x in (df, dev))
    return df, dev


@pytest.mark.parametrize("text_key", [False, True])
def test_only_differing_ranges_are_joined(spark, text_key):
    """With one row in a thousand changed, a few hundredths of the rows are left to join, and nothing is lost."""
    prod, dev = pair(spark, text_key=text_key)
    widths = (512, 64) if not text_key else (1 << 36, 1 << 33)  # of 2**44 places that hashes of text keys take
    assert view(ranges.row_diff_by_ranges(prod, dev, ["k"], widths=widths)) == view(rowdiff.row_diff(prod, dev, ["k"]))
    p, d = ranges.differing_rows(prod, dev, ["k"], widths=widths)
    assert 4 <= p.count() <= 0.08 * 4000 and d.count() <= 0.08 * 4000
    assert ranges.row_diff_by_ranges(prod, prod, ["k"]).isEmpty() and ranges.row_diff_by_ranges(prod.limit(0), dev.limit(0), ["k"]).isEmpty()


def test_ranges_of_odd_keys(spark, monkeypatch):
    """Null keys, keys of two columns, other types and columns of one side alone; many runs of ranges are joined instead of listed."""
    rows = [(None, 1, "a"), (1, None, "b"), (1, 2, "c"), (-5, 0, "d")]
    a = spark.createDataFrame(rows, "x long, y int, v string")
    b = spark.createDataFrame([(x, y, v + "!" if v == "a" else v) for x, y, v in rows] + [(9, 9, None)], "X int, y int, v string")
    for key in (["x", "y"], ["x"]):
        sides = (a, b) if len(key) == 2 else (a.where("y is null or y <> 2"), b.where("y is null or y <> 2"))
        assert view(ranges.row_diff_by_ranges(*sides, key)) == view(rowdiff.row_diff(*sides, key))
    more = a.withColumn("extra", F.lit(1))
    assert view(ranges.row_diff_by_ranges(a, more, ["x", "y"])) == view(rowdiff.row_diff(a, more, ["x", "y"]))
    prod, dev = pair(spark, few=40)
    monkeypatch.setattr(ranges, "RUNS", 3)
    assert view(ranges.row_diff_by_ranges(prod, dev, ["k"], widths=(512, 64))) == view(rowdiff.row_diff(prod, dev, ["k"]))


def test_open_ranges_reach_the_scan(spark, tmp_path):
    prod, dev = pair(spark, few=1)
    for name, df in (("p", prod), ("d", dev)):
        df.write.parquet(str(tmp_path / name))
    p, _ = ranges.differing_rows(spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "d")), ["k"], widths=(512, 64))
    assert "GreaterThanOrEqual(k" in p._jdf.queryExecution().executedPlan().toString()


def test_a_run_cut_off_repeats_only_open_ranges(spark, tmp_path, monkeypatch):
    """What was finished before a failure is neither written nor read again; other inputs start afresh."""
    prod, dev = pair(spark)
    for side, df in (("p", prod), ("d", dev)):
        df.write.parquet(str(tmp_path / side / "t.parquet"))
    raw = {"prod": {"path": str(tmp_path / "p")}, "dev": {"path": str(tmp_path / "d")}, "primary_keys": {"t": ["k"]}, "output": {"dir": str(tmp_path / "o")}, "performance": {"key_ranges": 6}}
    own = Comparison(spark, cfg.parse_config(raw))
    calls, keep = [], rowdiff.diff_of_digests

    def failing(*a):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("cut off")
        return keep(*a)

    monkeypatch.setattr(rowdiff, "diff_of_digests", failing)
    with pytest.raises(RuntimeError, match="cut off"):
        own.run()
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(tmp_path / "o" / "rows").rglob("part-*")}
    before = files()
    again = Comparison(spark, cfg.parse_config(raw)).run(resume=True)
    assert len(calls) == 4 + 3 and all(files()[p] == t for p, t in before.items())
    monkeypatch.undo()
    assert view(again["t"]) == view(rowdiff.row_diff(prod, dev, ["k"]))
    dev.where("k <> 3").write.mode("overwrite").parquet(str(tmp_path / "d" / "t.parquet"))
    assert view(Comparison(spark, cfg.parse_config(raw)).run(resume=True)["t"]) == view(rowdiff.row_diff(prod, dev.where("k <> 3"), ["k"]))


@pytest.mark.parametrize("key", [["k"], ["k", "v"]])
def test_kept_digests_are_joined_as_stored(spark, tmp_path, key):
    """Neither side is shuffled or sorted below the join, and the rows are those of a plain comparison."""
    prod, dev = pair(spark, few=40)
    dev = dev if len(key) == 1 else dev.withColumn("w", F.lit(1))
    prod = prod if len(key) == 1 else prod.withColumn("w", (F.col("k") % 7 != 0).cast("int"))
    for name, df in (("kept_p", prod), ("kept_d", dev)):
        copartitioned.keep_digests(df, key, name + str(len(key)), str(tmp_path / name), 4)
    got = copartitioned.diff_kept(spark, f"kept_p{len(key)}", f"kept_d{len(key)}", key)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert view(got) == view(rowdiff.row_diff(prod, dev, key))
    with pytest.raises(DriftError):
        copartitioned.keep_digests(prod.withColumn("k", F.lit(None).cast("long")), key, "kept_null", str(tmp_path / "n"), 4)
    assert [copartitioned.bucket_count(n) for n in (0, 1, 1 << 22, (1 << 22) + 1, 1 << 24)] == [1, 1, 1, 2, 4]


def test_progress_counts_the_tasks_of_each_table(spark, tmp_path):
    heard = {}
    tell = lambda table, done, tasks: heard.setdefault(table, []).append((done, tasks))
    resume.run_tables(spark, resume.Manifest(str(tmp_path), "f"), {"a": spark.range(100, numPartitions=5), "b": spark.range(10, numPartitions=2)}, tell=tell)
    assert heard["a"][-1] == (5, 5) and heard["b"][-1] == (2, 2)
    assert all(d <= n for own in heard.values() for d, n in own)
