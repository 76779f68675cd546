"""Exports: the caller names the folder; every writer is a distributed Spark write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels

# Tables that hold credentials and never leave.
PRIVATE_TABLES = ("users", "sessions", "tokens", "recovery_codes")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_financials_csv(flat: DataFrame, path: str, company_id: int, period: str | None = None) -> None:
    """Raw rows of one company, newest first."""
    rows = flat.where(F.col("company_id") == company_id)
    rows = rows.where(F.col("period") == period) if period else rows
    write_csv(rows.orderBy(F.col("period").desc()), path)


def export_portfolio(rows: DataFrame, path: str, label: str = "fiscal_year") -> None:
    """One row per company: its latest period (by year, the annual one first), with the ratios where the rows are statements."""
    from ..operators import finance

    if {"revenue", "net_income", "total_equity", "total_liabilities"} <= set(rows.columns):
        rows = finance.with_flat_ratios(rows)
    latest = rows.groupBy("company_id").agg(F.max(labels.period_key(label))["label"].alias(label))
    rows.join(latest, ["company_id", label], "left_semi").write.mode("overwrite").parquet(path)


def export_comparison(rows: DataFrame, path: str) -> None:
    """A summary, and a data set in ranges of companies with the years newest first; a large company spans several files."""
    rows.groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("companies")).write.mode("overwrite").parquet(f"{path}/summary")
    rows.repartitionByRange("company_id", F.col("fiscal_year").desc()).sortWithinPartitions("company_id", F.col("fiscal_year").desc()).write.mode(
        "overwrite").parquet(f"{path}/companies")


def used_columns(df: DataFrame, fields: list[str]) -> list[str]:
    """Fields with at least one value: one aggregation, one collected row."""
    counts = df.agg(*[F.count(f).alias(f) for f in fields]).first()
    return [f for f in fields if counts[f]]


def export_group(rows: DataFrame, fields: list[str], path: str, keys: tuple[str, ...] = ("company_id", "fiscal_year")) -> list[str]:
    """One field group; columns and rows without any value are left out. Returns the columns written."""
    used = used_columns(rows, fields)
    if used:
        rows.select(*keys, *used).dropna("all", subset=used).write.mode("overwrite").parquet(path)
    return used


def export_snapshot(tables: dict[str, DataFrame], path: str, exclude: tuple[str, ...] = PRIVATE_TABLES) -> dict[str, int]:
    """Every table except the private ones, with row counts taken while writing."""
    from pyspark.sql import Observation

    counts = {}
    for name, df in tables.items():
        if name in exclude:
            continue
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = seen.get["rows"]
    return counts


def export_activity_csv(log: DataFrame, path: str, offset: int = 0) -> None:
    from ..operators import events

    write_csv(events.export_rows(log, offset), path)


def export_company_metrics(matrix: DataFrame, path: str) -> None:
    write_csv(matrix, path)


def export_pay_audit(flagged: DataFrame, path: str) -> None:
    """Flagged pay rows with the stated and the corrected amount and the evidence."""
    write_csv(flagged.withColumn("flags", F.array_join("flags", ";")), path)


def write_years(df: DataFrame, path: str, year: str = "fiscal_year", rows_per_file: int = 5_000_000) -> None:
    """Rewrite only the years present in ``df`` (dynamic partition overwrite).

    Rows stay where they are, so a year that holds most of them is written by all tasks that have some; files are cut by rows.
    """
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy(year).parquet(path))


def upsert_years(spark: SparkSession, updates: DataFrame, path: str, keys: list[str], mode: str = "coalesce", year: str = "fiscal_year") -> None:
    """Merge updates into a year-partitioned table, touching only the years that occur in them.

    The merged years go to a folder of this call's own and are then swapped in, because a job must not overwrite what it reads.
    """
    from ..operators.merge import upsert

    old = spark.read.parquet(path)
    years = updates.select(year).distinct()
    touched = old.join(years, year, "left_semi")
    staged = f"{path.rstrip('/')}_staged_{uuid.uuid4().hex}"
    upsert(touched, updates, keys, mode).write.partitionBy(year).parquet(staged)
    write_years(spark.read.schema(old.schema).parquet(staged), path, year)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
