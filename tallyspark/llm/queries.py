"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, idfiles, language, lexical, lines, minhash, mixing, pivots, pseudonyms, quality, repeats, secrets, whitening
from .store import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_quality")
def good_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


# In production the key comes from a secret store; the results below are reproducible for anyone who has it.
PSEUDONYM_KEY = "registered-query-key"


@_query("op2_pseudonyms")
def pseudonymised(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.with_pseudonyms(_table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    of = lambda k: F.size(F.filter("__llm_found", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", *[of(k) for k in pseudonyms.KINDS],
        F.size(F.filter("__llm_found", lambda f: f["value"] != f["pseudonym"])).cast("long").alias("n_changed"),
    )


@_query("op3_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@_query("op4_secrets")
def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(_table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, secrets.KINDS))
    label = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] < 3), label), ",")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"), F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


@_query("op5_near_vectors")
def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(_table(spark, sf_dir, "embeddings"))


@_query("op6_repeated_bytes")
def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query("op7_mixing")
def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query("op8_language")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(_table(spark, sf_dir, "documents"))


@_query("op9_contamination")
def contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


@_query("op10_line_chunks")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_repeated_chunks(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("__llm_lines").alias("n_lines"), F.col("__llm_chunks").alias("n_chunks"),
        F.col("__llm_gone_lines").alias("n_removed_lines"), F.col("__llm_gone_chunks").alias("n_removed_chunks"), F.col("__llm_kept").alias("text"),
    )


@_query("op11_lexical_search")
def best_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# Vocabulary of op12's query; the operator takes any file that the tokenizers library reads.
VOCABULARY, END_ID = "word_bpe_49k.json", 2


@_query("op12_token_ids")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_folder(spark, "token-ids")
    idfiles.write_ids(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY), END_ID)
    return idfiles.read_documents(spark, path)


@_query("op13_whitening")
def whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))
