"""Declared schemas of the engine's tables, and a scan that never infers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as fl

_MAPS = ("ned_benefits map<string,struct<provided:boolean,detail:string>>, field_sources map<string,string>, "
         "field_confidence map<string,double>, field_review_status map<string,string>")

SCHEMAS = {
    "company": "company_id long, name string, ticker string, exchange string, sector string, country string, slug string, created_at timestamp",
    "survey": "company_id long, fiscal_year string, sector string, source_filename string, uploaded_at timestamp, currency string, "
              "unit string, director_figures_unit string, "
              + ", ".join(f"{f} {'string' if fl.KIND[f] in ('text', 'yesno') else 'double'}" for f in fl.KIND) + ", " + _MAPS,
    "financials": "id long, company_id long, period string, fiscal_year int, currency string, revenue double, net_income double, "
                  "total_assets double, total_liabilities double, total_equity double, source string, updated_at timestamp",
    "line_items": "id long, statement_id long, parent_id long, label string, normalized_name string, section string, amount double, "
                  "currency string, page int, confidence double, order_index int",
    "activity": "id long, user_id long, actor string, actor_email string, actor_role string, action string, category string, "
                "company_id long, fiscal_year string, http_method string, path string, detail string, created_at timestamp",
    "pages": "doc_id long, page int, text string",
    "readings": "reading_id long, company_id long, fiscal_year string, field string, value double, confidence double, source string, reader string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Parquet scan with the declared schema; only the columns a query uses are read."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: load_table(spark, f"{folder}/{n}", n) for n in names}


def store_pages(pages: DataFrame, path: str, year: str = "fiscal_year") -> None:
    """Page text partitioned by year, clustered by document so one report is read from few files."""
    pages.repartition(year, F.col("doc_id")).sortWithinPartitions("doc_id", "page").write.mode("overwrite").partitionBy(year).parquet(path)


def load_pages(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    df = spark.read.schema("doc_id long, page int, text string, fiscal_year string").parquet(path)
    return df.where(F.col("doc_id") == doc_id).orderBy("page") if doc_id is not None else df
