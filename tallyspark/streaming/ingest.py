"""Streams that change tables: payments applied once, touched years refreshed, files imported as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import billing
from ..sources import textfiles


def exists(spark: SparkSession, path: str) -> bool:
    """True when a table folder is already there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def payment_applier(invoices: DataFrame, table: str) -> Callable[[DataFrame, int], None]:
    """Apply each reference once, ever: the table of applied references is the state, so nothing has to stay in memory.

    A batch writes its own sub-folder; a replay ignores what that same batch wrote before.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = billing.apply_payments(batch, invoices)
        if exists(spark, table):
            done = spark.read.parquet(table).where(F.col("batch_id") != batch_id).select("reference")
            fresh = fresh.join(done, "reference", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return apply


def year_refresher(recompute: Callable[[DataFrame], DataFrame], facts: Callable[[], DataFrame], path: str, year: str = "fiscal_year") -> Callable[[DataFrame, int], None]:
    """Recompute only the years named in a batch of change events and overwrite just those partitions."""
    from ..sources.sinks import write_years

    def refresh(batch: DataFrame, batch_id: int) -> None:
        years = batch.select(year).distinct()
        write_years(recompute(facts().join(years, year, "left_semi")), path, year)

    return refresh


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Section text files arriving in a folder, one row per file."""
    raw = (spark.readStream.schema("value string").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).format("text").load(folder))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def importer(table: str) -> Callable[[DataFrame, int], None]:
    """Parse each batch of survey files and store its values; the newest batch wins per (file, field) on reading."""
    def store(batch: DataFrame, batch_id: int) -> None:
        parsed = textfiles.parse_survey(batch.where(textfiles.sniff_format("content") == "survey_data"))
        head = parsed["headers"].select("file", "company_name", "fiscal_year")
        parsed["values"].join(head, "file").write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return store


def imported_values(spark: SparkSession, table: str) -> DataFrame:
    """One value per company, year and field over all batches; the newest batch wins, its blanks never erase."""
    rows = spark.read.parquet(table)
    best = F.max(F.struct("batch_id", "file", "value"))
    return rows.groupBy("company_name", "fiscal_year", "field").agg(best["value"].alias("value"))
