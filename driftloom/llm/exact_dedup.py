"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import BROADCAST_BYTES, maybe_broadcast, scratch, small, stage, text_of

#: Code points of a text that the second level hashes.
PREFIX_CHARS = 64


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", prefix_chars: int = PREFIX_CHARS, hash_all: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Group equal texts and say which row of each group stays.

    Returns one row per input row: id, keep_id, group_size, kept, text_sha256. The hash is null where an earlier level
    already showed a text to be unique, unless hash_all asks for it everywhere: groups are found without it all the same.

    Level 1 counts lengths, level 2 counts (length, prefix hash) among lengths found twice, level 3 hashes the full
    content of the pairs found twice. What is shuffled is a length and a hash per row; texts stay where they are unless there
    are so many open groups that neither these nor their rows' ids may be broadcast, and the surviving rows' contents have to meet their ids. Counts are
    combined before each shuffle, and the joins read staged tables on both sides, so that Spark splits a hot group.

    Nulls count as empty texts and equal them. keep="max" keeps the largest id ("min" the smallest); null ids lose to any
    other, and rows that share both the text and the kept id all stay. Other columns of docs are ignored. An empty table
    gives an empty result.
    """
    pick = {"max": F.max, "min": F.min}[keep]
    body = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    length, prefix = F.octet_length("body").alias("n_bytes"), F.xxhash64(F.substring("body", 1, prefix_chars)).alias("prefix_hash")

    with scratch(docs.sparkSession):
        sketch = stage(body.select(length, prefix).groupBy("n_bytes", "prefix_hash").agg(F.count("*").alias("n")), "exact-sketch")
        lengths = sketch.groupBy("n_bytes").agg(F.sum("n").alias("of_length")).where("of_length > 1")
        groups = stage(sketch.where("n > 1").join(lengths, "n_bytes", "left_semi").select("n_bytes", "prefix_hash", F.lit(True).alias("open")), "exact-open")

        full = F.sha2("body", 256)
        if small(groups, 40, broadcast_bytes):
            met = body.select("id", "body", length, prefix).join(F.broadcast(groups), ["n_bytes", "prefix_hash"], "left")
            members = met.select("id", "n_bytes", "open", F.when(F.col("open"), full).alias("text_sha256"))
        else:  # narrow rows find the survivors; contents are read of their ids alone
            narrow = stage(body.select("id", length, prefix).join(groups, ["n_bytes", "prefix_hash"], "left").select("id", "n_bytes", "prefix_hash", "open"), "exact-narrow")
            alive = stage(narrow.where("open").select(F.col("id").alias("alive")).distinct(), "exact-alive")
            read = body.join(maybe_broadcast(alive, 24, broadcast_bytes), F.col("id").eqNullSafe(F.col("alive")), "left_semi").select("id", length, prefix, full.alias("text_sha256"))
            known = read.join(groups, ["n_bytes", "prefix_hash"], "left_semi").select("id", "n_bytes", F.lit(True).alias("open"), "text_sha256")
            members = narrow.where("open IS NULL").select("id", "n_bytes", F.lit(None).cast("boolean").alias("open"), F.lit(None).cast("string").alias("text_sha256")).unionByName(known)
        members = stage(members, "exact-members", lasting=True)

        classes = members.where("open").groupBy("n_bytes", "text_sha256").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
        classes = stage(classes, "exact-classes", lasting=True)
    if hash_all:  # the groups are known; what is hashed now is for the result's column alone
        members = body.select("id", length, full.alias("text_sha256"))
    found = members.join(maybe_broadcast(classes, 96, broadcast_bytes), ["n_bytes", "text_sha256"], "left")
    in_group = F.col("group_size").isNotNull()
    keep_id = F.when(in_group, F.col("keep_id")).otherwise(F.col("id"))
    return found.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )
