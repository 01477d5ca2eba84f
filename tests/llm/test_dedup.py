"""Exact, line and near deduplication, repeated passages and their edge cases, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import exact_dedup, line_dedup, near_dedup, repeats, shingles
from driftloom.llm.components import components

SCHEMA = "doc_id long, text string, keep_id string, n long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA).repartition(parts)


ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "A"), (5, "a\n\na"), (None, "a"), (6, "word " * 5000), (7, "word " * 5000), (8, " \t\n")]


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
@pytest.mark.parametrize("hash_all", [False, True])
def test_exact(spark, broadcast, hash_all):
    got = exact_dedup.exact_duplicates(frame(spark, ODD), hash_all=hash_all, broadcast_bytes=broadcast).collect()
    groups = defaultdict(list)
    for i, t in ODD:
        groups[t or ""].append(i)
    want = []
    for i, t in ODD:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        if hash_all or r["group_size"] > 1:
            assert r["text_sha256"] in {hashlib.sha256((t or "").encode()).hexdigest() for i, t in ODD if i == r["doc_id"]}
    assert exact_dedup.exact_duplicates(frame(spark, ODD).limit(0)).count() == 0


def test_exact_keeps_the_smallest(spark):
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup.exact_duplicates(frame(spark, [(1, "x"), (2, "x"), (3, "y")]), keep="min").collect()} == {(1, 1), (2, 1), (3, 3)}


def brute_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = defaultdict(int)
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            seen[k] += 1
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < least or not key(x)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_lines(spark, broadcast):
    r = random.Random(5)
    pool = ["Alpha", " alpha\t", "ALPHA ", "É", "é", "ÉA", "éa", "", " ", "İx", "rare %d", "b\r"]
    rows = [(i, "\n".join((x % r.randint(0, 40)) if "%" in x else x for x in r.choices(pool, k=r.randint(0, 8)))) for i in range(60)] + ODD
    got = line_dedup.dedup_lines(frame(spark, rows), min_docs=3, batches=3, broadcast_bytes=broadcast)
    assert got.columns == ["doc_id", "text", "keep_id", "n", "n_lines", "n_dropped"]
    assert sorted(((x["doc_id"], x["n_lines"], x["n_dropped"], x["text"] or "") for x in got.collect()), key=str) == brute_lines(rows, 3)


def test_line_runs_merge_and_anti_join(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    batches = [[(1, "a\nb"), (2, "c")], [(3, "b\nd\nD")], [(4, "a\nd\ne"), (5, None)]]
    new = [{(r["doc_id"], r["line"]) for r in line_dedup.add_batch(runs, frame(spark, b)).collect()} for b in batches]
    assert new == [{(1, "a"), (1, "b"), (2, "c")}, {(3, "d"), (3, "D")}, {(4, "e"), (5, "")}]
    assert [len(x) for x in runs.levels] == [1, 1]
    assert sorted(r["n"] for r in runs.counts().collect()) == [1, 1, 2, 2, 2]
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("driftloom_lines")]


def test_line_runs_are_merged_without_shuffling_or_sorting_them(spark):
    runs = line_dedup.LineRuns(spark, fanout=9)
    keys = spark.range(3000).selectExpr("id AS h1", "-id AS h2", "1 + id % 12 AS n")
    runs.add(keys.where("h1 < 2000"))
    batch = keys.where("h1 >= 1000")
    assert sorted(r["h1"] for r in runs.new_lines(batch, 10).collect()) == [i for i in range(1000, 3000) if i >= 2000 or 1 + i % 12 < 10]
    with line_dedup._sorted_scans(spark):
        plan = runs.new_lines(batch, 10)._jdf.queryExecution().executedPlan().toString()
    right = plan[plan.index("SortMergeJoin") :].split("+- ")[-1] if "SortMergeJoin" in plan else ""
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "FileScan parquet" in right
    runs.drop()


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_near(spark, broadcast):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(14):
        base = r.choices(vocabulary, k=r.choice([3, 8, 60, 150]))
        for _ in range(r.choice([1, 2, 9])):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((len(rows) * 3, r.choice([" ", "\n", "\t "]).join(own).replace("w1", "W1")))
    rows += [(1, None), (2, ""), (4, " \n"), (5, "solo"), (7, "SOLO"), (8, "wordé " * 9000)]
    r.shuffle(rows)
    got = {x["doc_id"]: x for x in near_dedup.near_duplicates(frame(spark, rows), broadcast_bytes=broadcast).collect()}
    want = brute_near(rows)
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in got.items()} == want
    assert all(x["kept"] == (i == x["component_id"]) for i, x in got.items())


def test_near_odd_rows(spark):
    got = near_dedup.near_duplicates(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and {(x["doc_id"], x["component_id"]) for x in got if x["doc_id"] in (6, 7, 1)} == {(6, 6), (7, 6), (1, 1)}
    assert near_dedup.near_duplicates(frame(spark, ODD).limit(0)).count() == 0


def test_near_resolves_buckets_of_texts_that_are_not_similar(spark):
    """With one-row bands every text that shares the least shingle meets; all true links are found and no other."""
    r = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(40):
        own = passage + [f"u{i}_{j}" for j in range(r.choice([2, 60]))]
        rows.append((i, " ".join(own)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(frame(spark, rows), bands=16, rows=1).collect()}
    assert got == brute_near(rows)


def test_near_ids_with_several_texts(spark):
    """Texts under one id are apart; an id that leads two groups does not join them."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (6, a), (3, b + " tail"), (None, c), (None, c + " tail"), (9, c), (None, "x y z"), (4, a + " tail")]
    got = near_dedup.near_duplicates(frame(spark, rows), carry=["text", "n"]).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str) == sorted([(5, 4, False), (5, 3, False), (6, 4, False), (3, 3, True), (None, 9, False), (None, 9, False), (9, 9, True), (None, None, True), (4, 4, True)], key=str)
    assert {(r["doc_id"], r["text"], r["n"]) for r in got} == {(i, t, 7) for i, t in rows}


@pytest.mark.parametrize("n", [50, 100, 200])
def test_near_bucket_of_unlike_texts_stages_members_once(spark, n, monkeypatch):
    """Texts of one template share buckets and are not alike: as many rows are staged for comparing as there are members, once for each side."""
    rows = [(i, " ".join([*(f"t{k}" for k in range(100)), *(f"u{i}_{k}" for k in range(30))])) for i in range(n)]
    seen = {}
    keep = near_dedup.stage

    def counted(df, name, lasting=False):
        out = keep(df, name, lasting)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "stage", counted)
    assert near_dedup.near_duplicates(frame(spark, rows)).where("not kept").count() == 0
    assert n < seen["open-members"] <= seen["bucket-members"] and seen["open-minors"] <= seen["open-members"]


def test_signature_is_circulant():
    first, shifts = near_dedup._circulant(8)
    assert sorted(first[:]) == list(range(near_dedup.CIRCLE)) and (shifts[5][1:] == shifts[6][:-1]).all()
    a, b = (np.unique(shingles.mix(np.arange(x, x + 800, dtype=np.uint64))) for x in (0, 100))
    n = 1024
    agree = (near_dedup.signature(a, n) == near_dedup.signature(b, n)).mean()
    assert abs(agree - 700 / 900) < 0.06


def test_components(spark):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(200, 100 + i) for i in range(50)] + [(r.randint(300, 340), r.randint(300, 340)) for _ in range(30)]
    up = {}
    for a, b in pairs:
        for x in (a, b):
            up.setdefault(x, x)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()} == {x: root(x) for x in linked}


def brute_repeats(rows, k):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - k + 1):
            first[b[j : j + k]] = min(first.get(b[j : j + k], i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for j in range(len(b) - k + 1):
            if first[b[j : j + k]] < i:
                gone[j : j + k] = [True] * k
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(left).hexdigest())
    return out


def passages(n=120):
    r = random.Random(1)
    words = ["alpha", "beta", "gamma", "é", "x"]
    base = [" ".join(r.choice(words) for _ in range(60)) for _ in range(5)]
    rows = [(1000, None), (1001, ""), (1002, "é" * 24), (1003, "é" * 25), (1004, "é" * 25)]
    for i in range(n):
        t = " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(r.randint(0, 40)))
        for _ in range(r.randint(0, 3)):
            x, p = r.choice(base), r.randint(0, len(t))
            a = r.randint(0, len(x))
            t = t[:p] + x[a : r.randint(a, len(x))] + t[p:]
        rows.append((i, r.choice([t, t, t, "aaaa" * r.randint(0, 60), "abcab" * r.randint(0, 60), base[0]])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "hot"), [(50, repeats.HOT), (37, repeats.HOT), (50, 2), (37, 3), (50, 0)])
def test_repeats(spark, width, hot):
    rows = passages()
    got = {x["doc_id"]: tuple(x)[1:5] for x in repeats.remove_repeats(frame(spark, rows), min_bytes=width, hot=hot).collect()}
    assert got == brute_repeats(rows, width)


def test_repeats_of_a_common_gram_between_differing_texts(spark):
    """A rule that most documents hold, alone or in a shared passage: its bucket is dealt out by whole prefixes."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    passage = " ".join(word() for _ in range(12))
    rows = [(i, f"{word()} {word()}{'-' * 40}{passage if i % 3 == 0 else word() + word()} {word()}" + ("=" * 300 if i % 5 == 0 else "")) for i in range(150)]
    r.shuffle(rows)
    for hot in (10, repeats.HOT):
        got = {x["doc_id"]: tuple(x)[1:5] for x in repeats.remove_repeats(frame(spark, rows, 5), hot=hot).collect()}
        assert got == brute_repeats(rows, 50)


def test_prefix_hashes_tell_prefixes_apart():
    text = bytes(random.Random(3).choices(b"ab", k=4000)) + b"x" * 100
    for n in (50, 37):
        starts = np.arange(len(text) - n + 1)
        by_hash, by_text = defaultdict(set), defaultdict(set)
        for a, h in zip(starts.tolist(), zip(*(x.tolist() for x in repeats._prefix_hashes(text, starts, n)), strict=True), strict=True):
            by_hash[h].add(text[a : a + n])
            by_text[text[a : a + n]].add(h)
        assert {len(x) for x in by_hash.values()} == {len(x) for x in by_text.values()} == {1}


def test_repeats_odd_rows(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, long), (1, long), (1, long + "!"), (None, long), (2, long), (3, "0" + long), (3, None)]
    got = sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"], len(x["kept"])) for x in repeats.remove_repeats(frame(spark, rows), keep_bytes=True).collect())
    n = len(long)
    assert got == sorted([("1", n, 0, n)] * 2 + [("1", n + 1, 0, n + 1), ("None", n, 0, n), ("2", n, n, 0), ("3", n + 1, n, 1), ("3", 0, 0, 0)])
    assert repeats.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_repeats_one_copied_and_one_own_text_of_an_id(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve", "red orange yellow green blue indigo violet black white grey brown"
    rows = [(1, a), (5, a), (5, b), (9, "0" + b + "!"), (9, "x" + a)]
    got = sorted(tuple(x)[:5] for x in repeats.remove_repeats(frame(spark, rows)).collect())
    assert got == sorted((i, *brute_repeats([*rows, (i, t)], 50)[i]) for i, t in rows)


def test_repeats_bucket_over_many_chunks(monkeypatch):
    """A bucket that is solved in parts gives what it gives as a whole."""
    rows = passages(60)
    sorted_rows = []
    for i, t in rows:
        b = (t or "").encode()
        bucket, first = repeats.bucket_runs(b)
        if not len(first):
            continue
        for h, a, e in zip(bucket.tolist(), first.tolist(), [*first.tolist()[1:], len(b) - 49], strict=True):
            sorted_rows.append((h, i, 0, a, b[a : e + 49]))
    sorted_rows.sort(key=lambda x: x[:2])

    def solve(chunk):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        own = repeats._Buckets(50)
        for row in sorted_rows:
            own.add(*row)
        own.solve(False)
        covered = defaultdict(set)
        for doc, _, a, e in own.out:
            covered[doc] |= set(range(a, e))
        return covered

    assert solve(1 << 21) == solve(64) == solve(1000)


def test_nearest_smaller():
    r = random.Random(9)
    for _ in range(50):
        v = np.array([r.randint(0, 9) for _ in range(r.randint(0, 40))])
        want = [next((j for j in range(i - 1, -1, -1) if v[j] < v[i]), -1) for i in range(len(v))]
        assert repeats._nearest_smaller(v).tolist() == want


def test_word_hashes_tell_words_apart():
    texts = [b"a b", b"ab", b"", b"  b\ta\x0b", b"x" * 3000]
    h, bounds = shingles.word_hashes(texts)
    assert bounds.tolist() == [0, 2, 3, 3, 5, 6] and h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 4


def test_shared_runs_over_batches():
    import pyarrow as pa

    r = random.Random(6)
    rows = sorted((r.randint(0, 12), r.randint(0, 3)) for _ in range(60))
    docs = defaultdict(set)
    for b, d in rows:
        docs[b].add(d)
    want = [x for x in rows if len(docs[x[0]]) > 1]
    for size, hot in ((1, 99), (3, 99), (7, 99), (60, 99), (1, 2), (3, 4), (7, 1), (60, 4)):
        batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in part]), pa.array([x[1] for x in part])], names=["bucket", "doc"]) for part in (rows[i : i + size] for i in range(0, 60, size))]
        found = [x for out in repeats._shared(iter(batches), hot) for x in zip(*(c.to_pylist() for c in out.columns), strict=True)]
        assert {x[:2] for x in found} == set(want)


def test_shared_runs_tell_hot_buckets():
    import pyarrow as pa

    r = random.Random(7)
    rows = sorted({(r.randint(0, 12), r.randint(0, 9)) for _ in range(60)})
    size_of = Counter(b for b, _ in rows)
    for size, hot in ((1, 2), (3, 4), (7, 1), (60, 4), (5, 99)):
        batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in part]), pa.array([x[1] for x in part])], names=["bucket", "doc"]) for part in (rows[i : i + size] for i in range(0, len(rows), size))]
        found = [x for out in repeats._shared(iter(batches), hot) for x in zip(*(c.to_pylist() for c in out.columns), strict=True)]
        assert found == [(b, d, size_of[b] > hot) for b, d in rows if size_of[b] > 1]


def test_other_columns_do_not_clash(spark):
    df = frame(spark, [(1, "a"), (2, "a")]).withColumn("id", F.lit(1)).withColumn("mark", F.lit(2)).withColumn("t1", F.lit(3)).withColumn("batch", F.lit(4))
    for f in (exact_dedup.exact_duplicates, line_dedup.dedup_lines, near_dedup.near_duplicates, repeats.remove_repeats):
        assert f(df).count() == 2
