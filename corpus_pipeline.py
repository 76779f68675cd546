"""The training-data pipeline: each stage works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import contamination, lines, minhash, mixing, quality
from tallyspark.llm.store import pin

# The stage takes a similarity of 0.8 or more, with half-keys enough to find a pair at 0.8 with probability 0.999 (op3's query has its own, 0.85).
NEAR_PERCENT = 80
NEAR_COLLECTIONS = 11
# Columns that the last stage adds; columns of the documents with these names are replaced.
MIXED = ("size", "target", "copies", "taken")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.without_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that an earlier document (or place) has too are cut out; documents that were nothing else go, and near copies are left
    whole for the next stage."""
    return lines.with_unique_chunks(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return minhash.without_near_duplicates(docs, percent=NEAR_PERCENT, collections=NEAR_COLLECTIONS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return contamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies and the words taken."""
    found = mixing.mixed(docs).where("copies > 0")
    taken = found.groupBy(F.col("doc_id").alias("__llm_id"), F.col("text_hash").alias("__llm_hash"), F.col("source").alias("__llm_source")).agg(
        F.max("size").alias("__llm_size"), F.max("target").alias("__llm_target"), F.max("copies").alias("__llm_copies"))
    own = [c for c in docs.columns if c not in MIXED]
    rows = docs.select(*own, F.xxhash64("text").alias("__llm_key"))
    same = rows["doc_id"].cast("long").eqNullSafe(taken["__llm_id"]) & (rows["__llm_key"] == taken["__llm_hash"]) & rows["source"].eqNullSafe(taken["__llm_source"])
    return rows.join(taken, same).select(
        *own, F.col("__llm_size").alias("size"), F.col("__llm_target").alias("target"), F.col("__llm_copies").alias("copies"),
        (F.col("__llm_copies") * F.col("__llm_size")).alias("taken"),
    )


STAGES = [
    ("quality_classifier", good_documents), ("line_dedup", unique_lines), ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated), ("mixing", mixture),
]

# A learnt model, hashing, confirmed candidates and random rounding have no SQL form; run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), name)
    return docs
