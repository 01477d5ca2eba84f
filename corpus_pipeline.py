"""The corpus pipeline: quality rules, line dedup, near dedup, mixing, packing. Each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import line_dedup, mixing, near_dedup, packing, quality
from driftloom.llm.common import maybe_broadcast, scratch, stage, text_of
from driftloom.llm.queries import public_tokenizer
from driftloom.sources import files
from driftloom.sources.staging import staged_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others stay as they are."""
    return quality.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every document; n_chars follows the text. All documents stay."""
    lines = line_dedup.dedup_lines(docs.select(*COLUMNS), min_docs=10)
    return lines.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays. Decisions hold for an id with its text: one that comes with several texts, or none, too."""
    marked = docs.select(*COLUMNS, F.xxhash64(text_of()).alias("mark_1"), F.xxhash64(F.lit(1), text_of()).alias("mark_2"))
    found = near_dedup.near_duplicates(marked, carry=["mark_1", "mark_2"]).where("not kept")
    gone = stage(found.select(F.col("doc_id").alias("gone_id"), F.col("mark_1").alias("gone_1"), F.col("mark_2").alias("gone_2")).distinct(), "near-gone")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("mark_1") == F.col("gone_1")) & (F.col("mark_2") == F.col("gone_2"))
    return marked.join(maybe_broadcast(gone, 32), same, "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their temperature weights; a document drawn in several epochs comes as so many equal rows."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's tokens, cut and packed into sequences of at most 1024."""
    return packing.pack(packing.token_pieces(docs, public_tokenizer()))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Near dedup and tokenization have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables go once its result is written, and that once the next one's is; the packed pieces stay for the result to read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage_of in STAGES[:-1]:
        with scratch(spark):
            out, path = stage_of(spark, docs, sf_dir), staged_path(spark, f"pipeline-{name}", lasting=True)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            files.remove(before)
        before = path
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written by now
    files.remove(before)
    return packed
