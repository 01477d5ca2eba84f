"""Collocation mining, centroid clustering and fingerprint links, against brute force and on odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from driftloom.llm import centroids, collocations, fingerprints, queries
from tests.oracle import SF

LONG = "lorem ipsum dolor sit amet " * 20000


def docs(spark, rows, parts=3):
    """(doc_id, text, lang) with columns whose names the operators use themselves."""
    named = [(i, t, lang, "x", 1, 2) for i, t, lang in rows]
    return spark.createDataFrame(named, "doc_id long, text string, lang string, phrase string, n int, fp int").repartition(parts)


def brute_collocations(rows, least, top, absorb=100):
    f, total = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        often = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        inside = defaultdict(int)
        for g, a in often.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], a)
        ranked = []
        for g, a in often.items():
            score, k = min((1000 * a * total[lang] // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
            if not (inside[g] and 100 * inside[g] >= absorb * a):
                ranked.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def corpus(seed, n=120):
    r = random.Random(seed)
    common = ["big red dog", "New York  City", "a b a b a", "É é", "x\ty z"]
    words = [f"w{i}" for i in range(30)] + ["é", "日本", "İ"]
    def text():
        return r.choice([" ", ". ", "\n"]).join(r.choice(common) if r.random() < 0.4 else " ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(r.randint(0, 12)))
    rows = [(i, text(), r.choice(["en", "de", None, ""])) for i in range(n)]
    return rows + [(None, None, "en"), (1, "", None), (3, "big red dog", "fr"), (3, "big red dog", "fr"), (7, LONG, "en"), (8, " \t\n.,", "xx")]


@pytest.mark.parametrize("options", [{}, {"sample": 1 << 40}, {"sample": 3, "bits": 8}, {"broadcast_bytes": 0, "sample": 2}, {"absorb": 60, "sample": 1}, {"sample": 1, "slack": 3.0}, {"sample": 1, "slack": 1.5}])
def test_collocations(spark, options):
    rows = corpus(4)
    passes = []
    got = collocations.collocations(docs(spark, rows), min_count=8, top=40, on_pass=passes.append, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut"]
    want = brute_collocations(rows, 8, 40, options.get("absorb", 100))
    assert sorted(tuple(r)[:-1] for r in got.collect()) == want and len(want) > 20
    assert passes[:2] == ["sample", "full"] and len(passes) == 3
    shuffled = docs(spark, rows).where("rand() >= 0").repartition(7)  # other tasks hold other texts each time: none is lost
    again = collocations.collocations(shuffled, min_count=8, top=40, **options)
    assert sorted(tuple(r)[:-1] for r in again.collect()) == want
    if options.get("sample") == 1 << 40:  # an empty sample proposes nothing, and one expansion still finds all
        assert passes[2] == "expansion"


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs(spark, corpus(4)).limit(0)).count() == 0
    assert collocations.collocations(docs(spark, [(1, None, None), (2, "one", "en")]), min_count=1).count() == 0
    shared = [(i, "same words here again", "en") for i in range(200)]  # every text a copy: all in the sample or none
    assert [tuple(r)[2:4] for r in collocations.collocations(docs(spark, shared)).collect()] == [("same words here again", 200)]


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int").repartition(parts)


def brute_clusters(rows, n=64, k=16, rounds=3, seed=1):
    ok = lambda v: v is not None and len(v) == n and all(x is not None and np.isfinite(x) and abs(x) < 1 << 56 for x in v)
    kept = [(i, [int(np.floor(x * 64)) for x in v]) for i, v in rows if ok(v)]
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "z"
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else m for j, m in enumerate(c)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    long = lambda x: x if x < 1 << 63 else None
    return [(i, j, long(d), long(sum(e for _, m, e in found if m == j)), long(sum(e for _, _, e in found)), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found]


def test_clusters(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=64) * r.choice([0.01, 1, 50]) + i % 5).tolist()) for i in range(300)]
    rows += [(300 + i, [float(i % 3)] * 64) for i in range(60)] + [(1, rows[1][1]), (1, rows[1][1]), (2, rows[5][1]), (None, rows[9][1])]
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [float("nan")] + [1.0] * 63), (905, [float("-inf")] + [1.0] * 63), (906, [1.0] * 65), (907, [1e300] * 64)]
    got = centroids.cluster_vectors(vectors(spark, rows + odd))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]
    assert sorted(map(str, (tuple(x) for x in got.drop("centroid").collect()))) == sorted(map(str, brute_clusters(rows)))
    assert centroids.cluster_vectors(vectors(spark, odd)).count() == 0
    few = rows[:5]
    assert sorted(map(str, (tuple(x) for x in centroids.cluster_vectors(vectors(spark, few)).drop("centroid").collect()))) == sorted(map(str, brute_clusters(few)))


def test_clusters_of_large_numbers(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=64) * (1e7 if i % 4 else 1e3)).tolist()) for i in range(80)]
    got = sorted(map(str, (tuple(x) for x in centroids.cluster_vectors(vectors(spark, rows)).drop("centroid").collect())))
    assert got == sorted(map(str, brute_clusters(rows)))
    huge = rows + [(99, [1e15] * 64), (98, [-1e15] * 64)]  # squares that do not fit a long
    assert sorted(map(str, (tuple(x) for x in centroids.cluster_vectors(vectors(spark, huge), k=1).drop("centroid").collect()))) == sorted(map(str, brute_clusters(huge, k=1)))


def test_progressive_search_drops_no_winner():
    r = np.random.default_rng(5)
    for scale in (2, 100, 1 << 20):
        x, c = r.integers(-scale, scale, (200, 64)), r.integers(-scale, scale, (16, 64))
        c[9] = c[3]  # a tie goes to the smaller number
        c[4] = x[0]
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own, far = centroids.nearest(x, c)
        assert (own == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
    h = centroids.hadamard(np.eye(64, dtype=np.int64))
    assert [int((np.diff(h[:, i]) != 0).sum()) for i in range(64)] == list(range(64))  # coarse to fine
    assert (h.T @ h == 64 * np.eye(64)).all()


def brute_fingerprint(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if grams else 0


def brute_components(fps, radius=4):
    """The least id that each (id, fingerprint) reaches."""
    left, out = set(range(len(fps))), {}
    while left:
        own, queue = set(), [left.pop()]
        while queue:
            i = queue.pop()
            own.add(i)
            near = {j for j in left if (fps[i][1] ^ fps[j][1]).bit_count() <= radius}
            left -= near
            queue += near
        ids = [fps[i][0] for i in own if fps[i][0] is not None]
        out |= {i: min(ids, default=None) for i in own}
    return sorted(((fps[i][0], f"{fps[i][1]:016x}", c) for i, c in out.items()), key=str)


def test_fingerprints(spark):
    r = random.Random(6)
    base = [" ".join(r.choices("abcdefghij", k=r.randint(1, 400))) for _ in range(25)]
    rows = []
    for t in base:
        for _ in range(r.randint(1, 6)):
            words = t.split()
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = r.choice("klmnop")
            rows.append((len(rows), r.choice([" ", "  ", "\t", "\n"]).join(words).upper(), "en"))
    rows += [(None, rows[3][1], None), (None, "only here", None), (4, "one two", "x"), (5, "ONE  two", "x"), (9, None, "x"), (10, "", "x"), (11, " \n", "x"), (12, LONG, "x"), (12, LONG, "x"), (13, "É é É é", "x")]
    want = brute_components([(i, brute_fingerprint(t)) for i, t, _ in rows])
    for options in ({}, {"broadcast_bytes": 0}, {"bucket": 1}):
        got = fingerprints.near_fingerprints(docs(spark, rows), **options)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted((tuple(x) for x in got.collect()), key=str) == want
    assert fingerprints.near_fingerprints(docs(spark, rows).limit(0)).count() == 0


def test_covering_masks():
    """Any differing bits up to the radius are left out of a mask; checked for all pairs and many sets of four."""
    masks = fingerprints.covering_masks()
    assert len(masks) == 31
    r = random.Random(7)
    sets = [*combinations(range(64), 2), *(r.sample(range(64), 4) for _ in range(20000))]
    assert all(any(not m & sum(1 << b for b in own) for m in masks) for own in sets)


@pytest.mark.parametrize("bucket", [1, 16, 4096])
def test_dense_fingerprints(spark, bucket):
    """Components of fingerprints drawn around few centres, by buckets and by neighbourhoods, equal brute force."""
    r = random.Random(8)
    fps = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))))
    fps = sorted(fps)
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(3)
    members = fingerprints._buckets(rows, 4)
    links = fingerprints.bucket_links(members) if bucket > 1 else fingerprints.neighbourhood_links(rows)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = 0
    for a, b in links.collect():
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        n += 1
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted(((f, f"{f:016x}", find(f)) for f in fps), key=str) == brute_components([(f, f) for f in fps])
    assert n < 31 * len(fps) * (1 if bucket > 1 else 100)


def test_fingerprint_query(spark):
    got = queries.op13_fingerprints(spark, SF).collect()
    texts = [(r["doc_id"], brute_fingerprint(r["text"])) for r in queries.table(spark, SF, "documents").collect()]
    assert sorted((tuple(r) for r in got), key=str) == brute_components(texts)
