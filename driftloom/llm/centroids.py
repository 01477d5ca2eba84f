"""Centroid clustering of integer vectors, nearest centroids found by a progressive search over Walsh-Hadamard coefficients."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import scratch, stage

DIMENSIONS, CENTROIDS, ROUNDS = 64, 16, 3
#: Components are multiplied by this and floored.
SCALE = 64
#: Coefficients that a step of the search adds.
BLOCK = 8
#: Vectors that are searched at once.
ROWS = 1 << 14
#: Within it coefficients' squares and their sum stay in 64 bits; beyond it Python's integers take over.
EXACT = 1 << 24
#: Scaled components of larger size do not fit a long.
LIMIT = 1 << 62


def hadamard(values: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, coarse coefficients first: in the order of their functions' sign changes."""
    n = values.shape[1]
    out, width = values, 1
    while width < n:
        pairs = out.reshape(len(out), n // (2 * width), 2, width)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), n)
        width *= 2
    bits = n.bit_length() - 1
    gray = [i ^ (i >> 1) for i in range(n)]
    return out[:, [int(f"{g:0{bits}b}"[::-1], 2) for g in gray]]


def nearest(values: np.ndarray, centroids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; of equally near ones the smaller number.

    The transform multiplies squared distances by the number of components, so the sum over some coefficients is a lower bound. After the
    first, coarsest block each row finishes the centroid that leads, and every further block drops the centroids whose sum is already
    strictly larger than that. Those that stay to the end have all coefficients summed.
    """
    n = values.shape[1]
    w, c = hadamard(values), hadamard(centroids)
    sums = np.zeros((len(w), len(c)), w.dtype)
    for k in range(min(block, n)):
        sums += (w[:, k, None] - c[None, :, k]) ** 2
    lead = sums.argmin(axis=1)
    best = ((w - c[lead]) ** 2).sum(axis=1)
    row, own = np.nonzero(sums <= best[:, None])
    part = sums[row, own]
    for k in range(block, n, block):
        part = part + ((w[row, k : k + block] - c[own, k : k + block]) ** 2).sum(axis=1)
        stay = part <= best[row]
        row, own, part = row[stay], own[stay], part[stay]
        if k + block >= n:
            break
    order = np.lexsort((own, part, row)) if part.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], part[i], own[i])), int)
    row, own, part = row[order], own[order], part[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
    return own[first], part[first] // n


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of each component, exact."""
    return np.floor(vectors * SCALE).astype(np.int64)


def _working(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers, or as Python's where squares might not fit."""
    wide = max(int(np.abs(values).max(initial=0)), int(np.abs(centroids).max(initial=0))) >= EXACT
    return (values.astype(object), centroids.astype(object)) if wide else (values, centroids)


def _blocks(batches: Iterator[pa.RecordBatch], at: int, dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            own = batch.slice(i, ROWS)
            yield own, scaled(own.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))


def _kept(vector: Column, dimensions: int) -> Column:
    """Whether a vector has the right number of components, all known and finite, and none too large for a long."""
    return vector.isNotNull() & (F.size(vector) == dimensions) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < LIMIT // SCALE, F.lit(False)))


def _start(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids hash least, in that order; without an id last. Equal ids stand in the order of their vectors."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    found = rows.orderBy(name.asc_nulls_last(), "vector").limit(k).collect()
    return scaled(np.array([r["vector"] for r in found], np.float64)) if found else np.zeros((0, 1), np.int64)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floored mean of their vectors. Each task sums its own vectors; one row per centroid and component comes back."""
    k, n = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = [[0] * n for _ in range(k)], [0] * k
        for _, values in _blocks(batches, 0, n):
            own, _ = nearest(*_working(values, centroids))
            for c in np.unique(own):
                mine = values[own == c]
                mine = mine if np.abs(mine).max() < EXACT else mine.astype(object)
                total[c] = [a + int(b) for a, b in zip(total[c], mine.sum(axis=0), strict=True)]
                counts[c] += len(mine)
        some = [c for c in range(k) if counts[c]]
        if some:
            numbers = pa.array([[Decimal(x) for x in (counts[c], *total[c])] for c in some], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), numbers], names=["cluster", "sums"])

    parts = rows.select("vector").mapInArrow(sums, "cluster int, sums array<decimal(38,0)>")
    moved = [list(map(int, c)) for c in centroids]
    totals = [[0] * (n + 1) for _ in range(k)]
    for r in parts.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect():
        totals[r["cluster"]][r["at"]] = int(r["x"])
    for c, (count, *sums_) in enumerate(totals):
        if count:
            moved[c] = [s // count for s in sums_]
    return np.array(moved, np.int64)


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """Assign each vector, its components scaled and floored to integers, to one of k centroids that move for some rounds.

    Returns per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid (its components) and
    centroid_sha256 (of those as decimal numbers joined by commas). All arithmetic is in integers; a sum that does not fit a long is null.

    A round is one scan: tasks assign their vectors and send a sum per centroid, so nothing else is shuffled, however full a
    centroid is. The driver holds the centroids alone, k times dimensions numbers. dimensions must be a power of two.

    Vectors of another length, null ones, and those with a component that is null, not finite or of 2**56 and more are left out. Rows that
    share an id are vectors of their own; null ids are assigned too and start as centroids only if there are too few others. With fewer
    than k vectors there are fewer centroids. An empty table gives an empty result. Other columns are ignored.
    """
    if dimensions & (dimensions - 1) or dimensions < 1:
        raise ValueError("dimensions must be a power of two")
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(_kept(F.col("vector"), dimensions))
    centroids = _start(rows, k, seed)
    schema = f"id {kind}, cluster int, distance long"
    if not len(centroids):
        assigned = spark.createDataFrame([], schema)
    else:
        for _ in range(rounds):
            centroids = _moved(rows, centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, values in _blocks(batches, 1, dimensions):
                own, far = nearest(*_working(values, centroids))
                far = pa.array([int(x) if x < 1 << 63 else None for x in far] if far.dtype == object else far, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), far], names=["id", "cluster", "distance"])

        assigned = stage(rows.mapInArrow(assign, schema), "assigned")
    with scratch(spark):
        sums = stage(assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")), "inertia")
        inertia = {r["cluster"]: None if r["lost"] else int(r["s"]) for r in sums.collect()}  # a row per centroid
    long = lambda x: x if x is not None and x < 1 << 63 else None
    total = None if None in inertia.values() else sum(inertia.values())
    texts = [[int(x) for x in c] for c in centroids]
    model = [(c, long(inertia[c]), long(total), t, hashlib.sha256(",".join(map(str, t)).encode()).hexdigest()) for c, t in enumerate(texts) if c in inertia]
    known = spark.createDataFrame(model, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
