"""Near-duplicate components of SimHash fingerprints, found by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm import shingles
from driftloom.llm.common import BROADCAST_BYTES, maybe_broadcast, scratch, stage, text_of
from driftloom.llm.components import components

WORDS, RADIUS, SEED = 4, 4, 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Members up to which a bucket is compared within one task; the members of larger ones meet by their neighbourhoods.
BUCKET = 4096


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The bits set in more than half of the hashes of a text's word shingles, A-Z lowered; a shorter text is one shingle, without words it is 0."""
    own = text.lower().split()
    if not own:
        return 0
    joined = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(own) - words + 1, 1)
    last = ends[words - 1 :] if len(own) >= words else ends[-1:]
    set_ = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        spans = zip(starts[i : min(i + CHUNK, n)].tolist(), last[i : i + CHUNK].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans], "<u8")
        set_ += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, fp) of docs (id, text), the 64 bits as a signed long."""
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t, words, seed) for t in shingles.texts_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], names=["id", "fp"])

    return docs.mapInArrow(sign, f"id {kind}, fp long")


def covering_masks(radius: int = RADIUS, seed: int = shingles.SEED) -> list[int]:
    """2**(radius + 1) - 1 masks of 64 bits of which at least one leaves out any `radius` bits.

    Each bit has a vector of radius + 1 bits, dealt evenly. The mask of a non-zero vector v keeps the bits whose vectors have an odd product with
    v. The vectors of `radius` bits span less than the whole space, so some v is orthogonal to all of them, and its mask keeps none.
    """
    size = 1 << (radius + 1)
    codes = np.random.default_rng(seed).permutation(np.arange(64) % (size - 1) + 1)
    return [sum(1 << b for b in range(64) if (int(codes[b]) & v).bit_count() & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _buckets(fps: DataFrame, radius: int) -> DataFrame:
    """(mask, kept, fp): each fingerprint under every mask, with the bits that it keeps."""
    masks = F.array(*[F.struct(F.lit(i).alias("mask"), F.lit(_signed(m)).alias("bits")) for i, m in enumerate(covering_masks(radius))])
    return fps.select("fp", F.explode(masks).alias("m")).select("m.mask", F.col("fp").bitwiseAND(F.col("m.bits")).alias("kept"), "fp")


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each component of some fingerprints at that radius: at most one for each but the first."""
    if len(fps) == 2:  # most buckets
        n = int(np.bitwise_count(fps[0] ^ fps[1]) <= radius)
        return fps[:n], fps[1 : 1 + n]
    seen, a, b = np.zeros(len(fps), bool), [], []
    for start in range(len(fps)):
        if seen[start]:
            continue
        seen[start] = True
        queue = [start]
        while queue:
            at = queue.pop()
            open_ = np.flatnonzero(~seen)
            near = open_[np.bitwise_count(fps[open_] ^ fps[at]) <= radius]
            seen[near] = True
            queue += near.tolist()
            a += [at] * len(near)
            b += near.tolist()
    return fps[np.array(a, int)], fps[np.array(b, int)]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[np.ndarray]:
    """The last column's values of each run of rows that agree in the first `keys` columns, over the batches of a sorted partition."""
    rest = None
    for batch in batches:
        own = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        own = own if rest is None else np.concatenate([rest, own])
        cuts = np.flatnonzero((own[1:, :keys] != own[:-1, :keys]).any(axis=1)) + 1
        for i, j in zip(np.concatenate([[0], cuts[:-1]]) if len(cuts) else [], cuts, strict=True):
            if j - i > 1:
                yield own[i:j, -1]
        rest = own[cuts[-1] :] if len(cuts) else own
    if rest is not None and len(rest) > 1:
        yield rest[:, -1]


def _edges(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    own, n = [], 0
    for pair in found:
        own.append(pair)
        n += len(pair[0])
        if n >= 1 << 16:
            yield _edge_batch(own)
            own, n = [], 0
    if n:
        yield _edge_batch(own)


def _edge_batch(own: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    both = np.unique(np.stack([np.concatenate([x[i] for x in own]).view(np.int64) for i in (0, 1)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def bucket_links(members: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that join the components inside each bucket of members (mask, kept, fp), whose sizes are bounded."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _edges(_forest(own.view(np.uint64), radius) for own in _groups(batches, 2))

    return members.repartition("mask", "kept").sortWithinPartitions("mask", "kept").mapInArrow(link, "a long, b long")


def neighbourhood_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that join the components of fingerprints (fp), however dense they lie.

    Each visits all points within half the radius. Two within an even radius meet at a point between them, and those that meet are within the
    radius of each other. A point has a fixed number of others so near, so no group grows with the data and no pairs are compared.
    """
    flips = [0, *[sum(1 << b for b in own) for k in range(1, radius // 2 + 1) for own in combinations(range(64), k)]]
    flips = np.array(flips, np.uint64)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(own), 64):
                points = (own[i : i + 64, None] ^ flips).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(points.view(np.int64)), pa.array(np.repeat(own[i : i + 64], len(flips)).view(np.int64))], names=["point", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _edges((np.repeat(own.min(), len(own)), own) for own in _groups(batches, 1))

    points = fps.select("fp").mapInArrow(visit, "point long, fp long")
    return points.repartition("point").sortWithinPartitions("point").mapInArrow(link, "a long, b long").where("a <> b")


def near_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, seed: int = SEED, bucket: int = BUCKET, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Link texts whose fingerprints differ in `radius` bits or fewer, and group them.

    Returns per row: id, fingerprint (16 hexadecimal digits), component_id (the least id among the rows that links reach). Equal
    fingerprints are one node. The others meet in buckets of equal bits under each mask, where any two within the radius meet at least once. A bucket
    of up to `bucket` fingerprints gives the links of a forest over its components; the fingerprints of larger buckets, distinct and so dense,
    meet at the points around them instead, which is exact and linear at any density. No pairs of a group are ever sent.

    Null texts, empty ones and those without words have fingerprint 0. Rows that share an id but not the fingerprint are apart; a null id
    is linked like others and names only components without an id. Other columns are ignored. An empty table gives an empty result.
    """
    if radius % 2 or radius < 2:
        raise ValueError("radius must be even")
    body = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    with scratch(docs.sparkSession):
        signed = stage(fingerprints(body, words, seed), "fingerprints", lasting=True)
        classes = stage(signed.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "fingerprint-classes")
        every = _buckets(classes, radius)
        sizes = stage(every.groupBy("mask", "kept").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
        members = stage(every.join(maybe_broadcast(sizes, 24, broadcast_bytes), ["mask", "kept"]).select("mask", "kept", "fp", (F.col("size") > bucket).alias("dense")), "bucket-members")
        links = bucket_links(members.where("not dense").select("mask", "kept", "fp"), radius)
        dense = stage(members.where("dense").select("fp").distinct(), "dense-fingerprints")
        if not dense.isEmpty():
            links = links.unionByName(neighbourhood_links(dense.repartition("fp"), radius))
        links = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "fingerprint-links")
        found = stage(components(links), "fingerprint-components")
        joined = found.join(classes.select(F.col("fp").alias("id"), "least"), "id")
        named = stage(joined.groupBy("component").agg(F.min("least").alias("name")), "component-names")
        linked = found.join(maybe_broadcast(named, 24, broadcast_bytes), "component").select(F.col("id").alias("fp"), "name")
        repeated = classes.where("n > 1").join(found.select(F.col("id").alias("fp")), "fp", "left_anti").select("fp", F.col("least").alias("name"))
        named = stage(linked.unionByName(repeated), "fingerprint-names", lasting=True)
    out = signed.join(maybe_broadcast(named, 24, broadcast_bytes), "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("name", "id").alias("component_id"))
