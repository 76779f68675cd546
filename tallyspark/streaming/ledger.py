"""Year tables that change batch by batch: a batch is written, checked, and only then published in a ledger.

A table is a folder of versions, ``rows/version=<batch>/<year>=...``, and a ledger, one small file a batch, that names the years a version holds and
how many rows of each. Readers take every year from the newest version that the ledger names. So a batch that dies between its steps is not seen,
one that is replayed writes its version anew, and one that is already published does nothing; a year is never half old and half new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..session import cut
from ..sources import textfiles
from .ingest import exists

_LEDGER = "batch long, year string, rows long"


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """``batch, year, rows`` of all published batches."""
    path = f"{root}/ledger"
    return spark.read.schema(_LEDGER).parquet(f"{path}/entry=*") if exists(spark, path) else spark.createDataFrame([], _LEDGER)


def published(spark: SparkSession, root: str, schema: str, year: str = "fiscal_year") -> DataFrame:
    """The rows of every year's newest published version; only the folders of these versions are read."""
    newest = ledger(spark, root).groupBy(F.col("year").alias(year)).agg(F.max("batch").alias("version"))
    if not exists(spark, f"{root}/rows"):
        return spark.createDataFrame([], schema)
    held = spark.read.schema(f"{schema}, version long").parquet(f"{root}/rows")
    columns = [c for c in held.columns if c != "version"]
    return held.join(newest, [year, "version"], "left_semi").select(*columns)


def publish(rows: DataFrame, root: str, batch: int, year: str = "fiscal_year", step: Callable[[str], None] | None = None) -> None:
    """Make ``rows``, whole years, the newest version of these years. ``step`` is called between the steps (for tests that end a batch there)."""
    spark, done = rows.sparkSession, step or (lambda name: None)
    entry = f"{root}/ledger/entry={batch}"
    if exists(spark, f"{entry}/_SUCCESS"):
        return
    path = f"{root}/rows/version={batch}"
    observed = rows.withColumn("__in", F.lit(1))
    counted = {r[year]: r.n for r in observed.groupBy(year).agg(F.count("__in").alias("n")).collect()}  # one row for each year
    rows.write.mode("overwrite").partitionBy(year).parquet(path)
    done("written")
    found = {str(r[year]): r.n for r in spark.read.schema(rows.schema).parquet(path).groupBy(year).agg(F.count(F.lit(1)).alias("n")).collect()} if counted else {}
    if found != {str(k): n for k, n in counted.items()}:
        raise ValueError(f"batch {batch}: {found} rows were written of {counted}")
    done("checked")
    spark.createDataFrame([(batch, str(k), n) for k, n in counted.items()], _LEDGER).coalesce(1).write.mode("overwrite").parquet(entry)
    done("published")


def upserter(root: str, schema: str, keys: list[str], mode: str = "coalesce", year: str = "fiscal_year", step: Callable[[str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer that merges each batch into the years it touches; other years are not read."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if exists(spark, f"{root}/ledger/entry={batch_id}/_SUCCESS"):
            return
        years = batch.select(year).distinct()
        old = published(spark, root, schema, year).join(years, year, "left_semi")
        publish(merge.upsert(old, batch, keys, mode).select(*old.columns), root, batch_id, year, step)

    return apply


VALUES = "company_name string, field string, value double, file string, fiscal_year string"


def survey_importer(root: str, step: Callable[[str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Parse each batch of survey files and merge its values into the stored years: a file's value wins, a field it lacks stays as it was.

    Of files of one batch that state the same field of a company-year the last by name counts.
    """
    merge_in = upserter(root, VALUES, ["company_name", "fiscal_year", "field"], "coalesce", "fiscal_year", step)

    def apply(batch: DataFrame, batch_id: int) -> None:
        if exists(batch.sparkSession, f"{root}/ledger/entry={batch_id}/_SUCCESS"):
            return
        # a batch may be one file of the store: its texts are dealt out before they are parsed, and the parsed values are written, since counting and writing read them
        tasks = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parsed = textfiles.parse_survey(batch.where(textfiles.sniff_format("content") == "survey_data").repartition(tasks, "file"))
        head = parsed["headers"].select("file", "company_name", "fiscal_year").where("company_name IS NOT NULL AND fiscal_year IS NOT NULL")
        last = F.max(F.struct("file", "value"))
        values = parsed["values"].join(head, "file").groupBy("company_name", "fiscal_year", "field").agg(last.alias("l"))
        merge_in(cut(values.select("company_name", "field", "l.value", "l.file", "fiscal_year")), batch_id)

    return apply


PEOPLE = "company_id long, director_name string, role string, gender string, origin string, fiscal_year string"


def register_importer(root: str, pay_people: Callable[[SparkSession], DataFrame], step: Callable[[str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Replace the registers that a batch brings (company_id, fiscal_year, director_name, role, gender) and reconcile them with the pay tables of
    the same company-years, person by person; other companies of the years touched stay as they are."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if exists(spark, f"{root}/ledger/entry={batch_id}/_SUCCESS"):
            return
        parents = batch.select("company_id", "fiscal_year").distinct()
        pay = pay_people(spark).join(parents, ["company_id", "fiscal_year"], "left_semi")
        fresh = merge.reconcile_people(batch.select("company_id", "fiscal_year", "director_name", "role", "gender"), pay, ["company_id", "fiscal_year"])
        old = published(spark, root, PEOPLE).join(parents.select("fiscal_year").distinct(), "fiscal_year", "left_semi")
        whole = merge.replace_children(old, fresh.select(*old.columns), ["company_id", "fiscal_year"])
        publish(whole, root, batch_id, "fiscal_year", step)

    return apply
