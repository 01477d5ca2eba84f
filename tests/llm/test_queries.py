"""The registered text queries against their SQL, and the pipeline against its stages in plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftloom.llm import quality, queries
from tests.llm.test_texts import brute_quality
from tests.oracle import SF, actual, expected


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert actual(queries.queries()[name](spark, SF)) == expected(queries.oracle_sql()[name])


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def brute_kept(t):
    """The verdict of the quality rules, each threshold written out."""
    t = t or ""
    n, chars, symbols, dup, repeats = brute_quality(t)
    words = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    upper, lower = len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t))
    stop = sum(w.lower() in quality.STOP_WORDS for w in words)
    ends = sum(bool(re.search(r"(?:\.\.\.|\u2026)[\x20\x09-\x0d]*\Z", x)) for x in t.split("\n"))
    if n < 10 or 100 * repeats > 20 * n:
        return False
    return not (
        not 2 <= chars / n <= 20 or symbols / n > 0.1 or t.count("!") / n > 0.3 or (upper + lower > 0 and upper / (upper + lower) > 0.6) or (n >= 100 and stop / n < 0.01)
        or (n >= 20 and dup / len(lines) > 0.5) or (n >= 20 and ends / len(lines) > 0.6)
    )


def odd_documents(spark, n=40):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names the stages use inside."""
    plain = "the cat sat on the mat and of course in the end it was all for a good reason said {0} to {1} with the word {2}"
    rows = [(i, plain.format(f"w{i}", f"x{i * 7}", f"y{i % 3}") + "\nsame line for all of them here", "en", "a" if i % 3 else None, 1) for i in range(n)]
    rows += [(100, None, None, None, None), (101, "", "en", "b", 0), (102, " \n\t", "en", "b", 3), (103, rows[3][1], "en", "b", 1), (103, rows[3][1], "en", "b", 1), (None, rows[4][1], "en", "b", 1), (104, "word the " * 40_000, "en", "b", 1)]
    rows += [(105, " ".join(f"of{k} the" for k in range(30_000)), "de", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(3) for c in ("kept", "quality", "id", "mark", "band", "t1", "h1", "mix_tokens", "piece", "verdict_", "ids")})


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_stages_take_odd_and_empty_tables(spark, n):
    import corpus_pipeline as c

    docs = odd_documents(spark)
    name, stage_of = c.STAGES[n]
    out = stage_of(spark, docs, SF)
    if n < 4:
        assert out.columns == list(c.COLUMNS)
    ids = Counter(r["doc_id"] for r in out.select("doc_id").distinct().collect())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    if name == "quality_rules":
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(((i, t) for i, t in rows if brute_kept(t)), key=str)
    if name == "line_dedup":
        from tests.llm.test_dedup import brute_lines

        assert sorted(((r["doc_id"], r["text"] or "") for r in out.collect()), key=str) == sorted(((i, t) for i, _, _, t in brute_lines(rows, 10)), key=str)
    if name == "near_dedup":
        assert {100, 101, 102, 104, 105} <= set(ids) and 103 not in ids and 3 in ids
    if name in ("mixing", "best_fit_packing"):
        assert {i for i in ids if i is not None} <= {i for i, _ in rows}
    empty = stage_of(spark, docs.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns


def test_near_dedup_stage_decides_by_id_and_text(spark):
    """A text found nowhere else stays whatever else its id holds, and a copy goes though it has no id."""
    import corpus_pipeline as c

    a, b, e = (" ".join(f"{x}{k}" for k in range(40)) for x in "abe")
    near_b = b.replace("b39", "other")
    rows = [(1, a), (None, a), (5, a), (5, b), (3, near_b), (7, e), (7, a), (None, "short"), (8, None), (8, e + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in c.near_dedup_stage(spark, docs, SF).collect()), key=str)
    assert kept == sorted([(1, a), (3, near_b), (7, e), (None, "short"), (8, None)], key=str)
    alone = c.near_dedup_stage(spark, docs.where("doc_id IS NULL OR doc_id <> 3"), SF).collect()
    assert (5, b) in {(r["doc_id"], r["text"]) for r in alone}


def test_pipeline_leaves_only_what_its_result_reads(spark):
    import corpus_pipeline as c
    from driftloom.sources import files
    from driftloom.sources.staging import scratch, shared_folder

    before = set(files.names(shared_folder(spark)))
    with scratch(spark):
        assert c.run(spark, SF).count() > 0
        left = set(files.names(shared_folder(spark))) - before
        assert left and all("pieces" in x for x in left)
    assert set(files.names(shared_folder(spark))) == before


def test_pipeline(spark, tmp_path):
    """Each stage against brute force on what the stage before it gave."""
    import corpus_pipeline as c
    from tests.llm.test_dedup import brute_lines, brute_near

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = c.quality_rules(spark, docs, SF).cache()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in one.collect()}
    for i, t in texts.items():
        words, _, _, _, repeats = brute_quality(t)
        assert i not in kept or (words >= 10 and 100 * repeats <= 20 * words)
    assert kept == {i for i, t in texts.items() if brute_kept(t)}
    two = c.line_dedup_stage(spark, one, SF).cache()
    want = {i: t for i, _, _, t in brute_lines([(r["doc_id"], r["text"]) for r in one.collect()], 10)}
    assert {r["doc_id"]: r["text"] for r in two.collect()} == want and all(r["n_chars"] == len(r["text"]) for r in two.collect())
    three = c.near_dedup_stage(spark, two, SF).cache()
    groups = brute_near(list(want.items()))
    assert {r["doc_id"] for r in three.collect()} == {i for i, (_, root) in groups.items() if i == root}
    four = c.mixing_stage(spark, three, SF).cache()
    assert four.columns == list(c.COLUMNS) and four.select("doc_id").distinct().join(three, "doc_id", "left_anti").isEmpty()
    three.write.parquet(str(tmp_path / "three"))
    drawn = duckdb.connect().execute(f"SELECT doc_id, mix_epoch FROM ({queries.mix_sql(repr(str(tmp_path / 'three' / '*.parquet')))})").fetchall()
    assert Counter(i for i, _ in drawn) == Counter(r["doc_id"] for r in four.collect())
    five = c.packing_stage(spark, four, SF).cache()
    whole, want = Tokenizer.from_file(queries.public_tokenizer()), Counter()
    for r in four.collect():
        own = [*whole.encode(r["text"], add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(own) % 1024 or 1024, len(own) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[(r["doc_id"], piece, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes()))] += 1
    packed = five.collect()
    assert Counter(tuple(r)[:5] for r in packed) == want
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in own) <= 1024 and [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] for own in bins.values())
    firsts = five.where("piece = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in firsts} == {r["doc_id"]: r["count"] for r in four.groupBy("doc_id").count().collect()}
