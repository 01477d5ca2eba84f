"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm import shingles
from driftloom.llm.common import BROADCAST_BYTES, maybe_broadcast, scratch, stage, text_of
from driftloom.llm.components import components

WORDS = 5
#: Links need at least so many hundredths of the union in common.
PERCENT = 75
#: BANDS * ROWS signature coordinates. A pair at the threshold misses all bands with probability (1 - 0.75**6)**64, 4 in a million; pairs that share little seldom meet.
BANDS, ROWS = 64, 6
#: Places of the circle that the two permutations act on.
CIRCLE = 1 << 20
#: Coordinates of which the sketches of texts that buckets leave open keep one bit each.
SKETCH = 2048
#: Deviations that a pair's sketches may differ by more than expected at the threshold.
SIGMAS = 4.5
#: Members of a bucket that one task compares with the bucket's minor ones; only the minor members of larger buckets go to several tasks.
SPLIT = 16384


@cache
def _circulant(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two permutations of the circle: the first places a shingle, row p of the second's windows holds its shifts by 0..n-1."""
    rng = np.random.default_rng(shingles.SEED)
    first, second = rng.permutation(CIRCLE).astype(np.int32), rng.permutation(CIRCLE).astype(np.uint32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:n]]), n)


def signature(own: np.ndarray, n: int) -> np.ndarray:
    """n coordinates of a set of hashes; coordinate k is the least of the second permutation, shifted by k, over the first one's places."""
    first, shifts = _circulant(n)
    places = first[(own & np.uint64(CIRCLE - 1)).astype(np.int64)]
    least = np.full(n, CIRCLE, np.uint32)
    for i in range(0, len(places), 512):
        np.minimum(least, shifts[places[i : i + 512]].min(axis=0), out=least)
    return least


def _digests(own: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that name a set of hashes."""
    return own.sum(dtype=np.uint64), np.bitwise_xor.reduce(shingles.mix(own + np.uint64(1)), initial=0)


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, d1, d2, bands, and the columns of docs after the text): the set's size, 128 bits that name it, and its band hashes."""
    kind = docs.schema["id"].dataType.simpleString()
    more = docs.schema.fields[2:]
    salts = shingles.mix(np.arange(1, rows + 1, dtype=np.uint64))
    places = shingles.mix(np.arange(100, 100 + bands, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, d1, d2, keys = [], [], [], []
            for own in shingles.shingle_sets(shingles.texts_of(batch.column(1)), words):
                sizes.append(len(own))
                one, two = _digests(own)
                d1.append(one)
                d2.append(two)
                least = signature(own, bands * rows).astype(np.uint64).reshape(bands, rows)
                keys.append(shingles.mix((least * salts).sum(axis=1, dtype=np.uint64) + places))
            if sizes:
                longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), longs(d1), longs(d2), _lists(keys), *batch.columns[2:]], names=["id", "n_shingles", "d1", "d2", "bands", *[f.name for f in more]])

    return docs.mapInArrow(sign, ", ".join([f"id {kind}, n_shingles long, d1 long, d2 long, bands array<long>", *[f"{f.name} {f.dataType.simpleString()}" for f in more]]))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit values as a column of lists."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).astype(np.uint64, copy=False).view(np.int64)))


def _sketches(sets: DataFrame, coordinates: int) -> DataFrame:
    """(id, sketch): a bit of each of many signature coordinates of sets (id, own)."""
    kind = sets.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own in batch.column(1):
                least = signature(own.values.to_numpy().view(np.uint64), coordinates).astype(np.uint64)
                rows.append(np.frombuffer(np.packbits((shingles.mix(least) & np.uint64(1)).astype(np.uint8)).tobytes(), np.uint64))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(rows)], names=["id", "sketch"])

    return sets.select("id", "own").mapInArrow(sketch, f"id {kind}, sketch array<long>")


def _alike(a: Column, b: Column, coordinates: int, percent: int) -> Column:
    """Whether two sketches differ in few enough bits for the threshold.

    Bits of a pair that meets the threshold j differ with probability (1 - j) / 2; the bound lies SIGMAS deviations above, which
    such a pair crosses about as seldom as it misses all bands.
    """
    p = (1 - percent / 100) / 2
    bound = int(coordinates * p + SIGMAS * (coordinates * p * (1 - p)) ** 0.5) + 1
    return reduce(add, [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(coordinates // 64)]) <= bound


def _node(row_id: Column, d1: Column) -> Column:
    """The node of a class of equal sets: its least id and a digest, so that an id with several texts is as many nodes. Without an id it comes last."""
    return F.struct(row_id.isNull().alias("none"), row_id.alias("id"), d1.alias("d1"))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, d1, own): the array of the hashes of each text's full shingle set, and its digest."""
    kind = docs.schema["id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(shingles.shingle_sets(shingles.texts_of(batch.column(1)), words))
            if own:
                d1 = pa.array(np.array([_digests(x)[0] for x in own], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), d1, _lists(own)], names=["id", "d1", "own"])

    return docs.select("id", "text").mapInArrow(sets, f"id {kind}, d1 long, own array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs (a, b, ..) whose full sets meet the threshold."""
    both = pairs.join(sets.toDF("a", "own_a"), "a").join(sets.toDF("b", "own_b"), "b")
    common = F.size(F.array_intersect("own_a", "own_b"))
    return both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.size("own_a") + F.size("own_b") - F.col("common")))


def _alike_in_size(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's least id, once for all bands that join them."""
    reps = stage(members.groupBy("band").agg(F.min(F.struct("id", "n")).alias("rep")), "bucket-reps")
    pairs = members.join(reps, "band").where((F.col("id") != F.col("rep.id")) & _alike_in_size(F.col("n"), F.col("rep.n"), percent))
    return pairs.select(F.col("rep.id").alias("a"), F.col("id").alias("b")).distinct()


def _open_pairs(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int, broadcast_bytes: int, split: int) -> DataFrame:
    """(a, b, ca, cb): the pairs of different components that a bucket still holds, if their sketches allow a link.

    In such a bucket the members outside of its largest component, the minor ones, are compared with all others, so a large group
    and a text that only resembles it cost one comparison a member, and a bucket of unlike texts is compared in full. Comparing
    happens inside the join, whose condition lets out a pair only in the least bucket that it shares. The members of a bucket of more than `split` are
    dealt out, once each; its minor ones go to every part, so each copy is compared with about `split` members, and in smaller buckets there are none.
    """
    labelled = members.join(found, "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("c"))
    sizes = labelled.groupBy("band", "c").agg(F.count("*").alias("k")).groupBy("band").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("size"), F.count("*").alias("components"))
    mixed = maybe_broadcast(stage(sizes.where("components > 1").select("band", "main", "size"), "mixed"), 32, broadcast_bytes)
    live = stage(labelled.join(mixed, "band"), "live")
    own = live.groupBy("id").agg(F.collect_set("band").alias("bands"))
    known = stage(_sketches(sets.join(maybe_broadcast(stage(live.select("id").distinct(), "open-ids"), 16, broadcast_bytes), "id", "left_semi"), SKETCH).join(own, "id"), "sketches")
    live = live.join(known, "id").withColumn("parts", F.ceil(F.col("size") / split).cast("int"))
    every = live.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts", "size")
    minor = live.where("c <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("band", "part", *[F.col(x).alias(f"minor_{x}") for x in ("id", "n", "c", "sketch", "bands")])
    every, minor = stage(every, "open-members"), stage(minor, "open-minors")
    differ = (F.col("c") != F.col("minor_c")) & ((F.col("c") == F.col("main")) | (F.col("minor_id") < F.col("id")))
    alike = _alike_in_size(F.col("n"), F.col("minor_n"), percent) & _alike(F.col("sketch"), F.col("minor_sketch"), SKETCH, percent)
    met = (F.col("e.band") == F.col("m.band")) & (F.col("e.part") == F.col("m.part"))
    once = F.col("e.band") == F.array_min(F.array_intersect("bands", "minor_bands"))
    pairs = every.alias("e").join(minor.alias("m"), met & differ & alike & once)
    return pairs.select(F.least("id", "minor_id").alias("a"), F.greatest("id", "minor_id").alias("b"), F.least("c", "minor_c").alias("ca"), F.greatest("c", "minor_c").alias("cb")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, broadcast_bytes: int = BROADCAST_BYTES, split: int = SPLIT, carry: Sequence[str] = ()) -> DataFrame:
    """Link documents whose sets of distinct word shingles are similar, and group them.

    Returns per row: id, n_shingles, component_id (the least id reachable over links), kept (id = component_id), and the columns of docs that carry names. Texts with
    equal sets are one class from the start, and one of each class goes on. Those that agree in a band share a bucket. First each member is
    compared with its bucket's least id, which makes most groups whole at one comparison a member. Then buckets that still hold
    several components compare all pairs of different components, but for those within the bucket's largest, first by sketches and then, as
    every link, on the full sets. Nothing is capped: every pair that shares a bucket is linked, compared or in one component.

    A text without words, or null, is empty and linked with nothing. A shorter text than `words` is one shingle. Rows that
    share an id but not the text are apart; a null id is linked like others but never names a component that has an id. Only id, text and what is
    carried of docs are read. An empty table gives an empty result.
    """
    carried = [F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)]
    body = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), *carried)
    with scratch(docs.sparkSession):
        signed = stage(_signed(body, words, bands, rows), "minhash", lasting=True)
        classes = stage(signed.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep")), "set-classes", lasting=True)

        # One row of each class carries its bands on; from here on an id is a class's node.
        named = classes.select("rep", F.col("d1").alias("one"), F.col("d2").alias("two"))
        firsts = signed.where("n_shingles > 0").join(named, F.col("id").eqNullSafe(F.col("rep")) & (F.col("d1") == F.col("one")) & (F.col("d2") == F.col("two")), "left_semi")
        exploded = firsts.select("id", "d1", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
        buckets = exploded.groupBy("band").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo < hi").select("band")
        buckets = maybe_broadcast(stage(buckets, "buckets"), 16, broadcast_bytes)
        members = exploded.join(buckets, "band", "left_semi").select(_node(F.col("id"), F.col("d1")).alias("id"), "n", "band")
        members = stage(members.distinct(), "bucket-members")
        ids = maybe_broadcast(stage(members.select("id.id").distinct().withColumnRenamed("id", "rep"), "bucket-ids"), 16, broadcast_bytes)
        found_sets = _sets(body.join(ids, F.col("id").eqNullSafe(F.col("rep")), "left_semi"), words).select(_node(F.col("id"), F.col("d1")).alias("id"), "own")
        nodes = maybe_broadcast(stage(members.select("id").distinct(), "bucket-nodes"), 32, broadcast_bytes)
        sets = stage(found_sets.join(nodes, "id", "left_semi").dropDuplicates(["id"]), "bucket-sets")

        star = stage(_verified(_star_pairs(members, percent), sets, percent).select("a", "b"), "star-links")
        found = stage(components(star), "star-components", lasting=True)
        more = _verified(stage(_open_pairs(members, found, sets, percent, broadcast_bytes, split), "open-pairs"), sets, percent)
        joined = stage(components(stage(more.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "open-links")), "joined-components", lasting=True)

    named = signed.drop("bands").join(classes, ["d1", "d2", "n_shingles"], "left").withColumn("node", _node(F.col("rep"), F.col("d1")))
    named = named.join(maybe_broadcast(found.toDF("node", "first"), 56, broadcast_bytes), "node", "left").withColumn("first", F.coalesce("first", "node"))
    named = named.join(maybe_broadcast(joined.toDF("first", "last"), 56, broadcast_bytes), "first", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("last", "first")["id"]).otherwise(F.col("id"))
    kept = F.col("id").eqNullSafe(component)
    return named.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), kept.alias("kept"), *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])
