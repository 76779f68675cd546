"""Exports and stores written to a fresh shared folder and read back, so that what lands in the files is what is compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import finance as fin
from ..session import shared_base
from ..sources import sinks, tables
from . import views
from .finance import fin_sql, flat
from .filings import doc_pages
from .registry import query


def folder(spark) -> str:
    return f"{shared_base(spark).rstrip('/')}/export-{uuid.uuid4().hex}"


def read_csv(spark, path):
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("exported_company_csv", views.oracle("SELECT id, period, revenue FROM financials WHERE company_id = (SELECT max(company_id) FROM financials)"))
def exported_company_csv(spark, sf_dir):
    path, rows = folder(spark), flat(spark, sf_dir)
    sinks.export_financials_csv(rows.select("id", "company_id", "period", "revenue"), path, rows.agg(F.max("company_id")).first()[0])
    return read_csv(spark, path).select(F.col("id").cast("long").alias("id"), "period", F.col("revenue").cast("double").alias("revenue"))


@query("exported_portfolio", fin_sql("""SELECT company_id, arg_max(period, (year_no, annual, period)) AS period, round_even(arg_max(coalesce(roe, -9e9), (year_no, annual, period)), 4) AS roe
 FROM (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(period, '((?:19|20)[0-9]{2})', 1), '') AS INT), 0) AS year_no, CASE WHEN starts_with(upper(period), 'FY') THEN 1 ELSE 0 END AS annual FROM rated) GROUP BY company_id"""))
def exported_portfolio(spark, sf_dir):
    path = folder(spark)
    sinks.export_portfolio(flat(spark, sf_dir), path, "period")
    return spark.read.parquet(path).select("company_id", "period", F.bround(F.coalesce("roe", F.lit(-9e9)), 4).alias("roe")).distinct()


@query("exported_comparison", views.oracle("SELECT company_id, fiscal_year, turnover FROM survey"))
def exported_comparison(spark, sf_dir):
    path = folder(spark)
    sinks.export_comparison(views.survey(spark, sf_dir).select("company_id", "fiscal_year", "turnover"), path)
    return spark.read.parquet(f"{path}/companies")


@query("exported_comparison_summary", views.oracle("SELECT fiscal_year, count(*) AS companies FROM survey GROUP BY 1"))
def exported_comparison_summary(spark, sf_dir):
    path = folder(spark)
    sinks.export_comparison(views.survey(spark, sf_dir).select("company_id", "fiscal_year", "turnover"), path)
    return spark.read.parquet(f"{path}/summary")


@query("exported_group", views.oracle("SELECT company_id, fiscal_year, turnover, audit_fee FROM survey WHERE turnover IS NOT NULL OR audit_fee IS NOT NULL"))
def exported_group(spark, sf_dir):
    path = folder(spark)
    rows = views.survey(spark, sf_dir).select("company_id", "fiscal_year", "turnover", "audit_fee", F.lit(None).cast("double").alias("never_stated"))
    sinks.export_group(rows, ["turnover", "audit_fee", "never_stated"], path)
    return spark.read.parquet(path)


@query("exported_snapshot", views.oracle("SELECT 'financials' AS table_name, count(*) AS rows FROM financials UNION ALL SELECT 'activity', count(*) FROM activity"))
def exported_snapshot(spark, sf_dir):
    path, log = folder(spark), views.view(spark, sf_dir, "activity").select("id", "user_id", "action")
    written = sinks.export_snapshot({"financials": flat(spark, sf_dir), "activity": log, "users": log.select("user_id").distinct()}, path)
    parts = [spark.read.parquet(f"{path}/{t}").agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("rows")) for t in written]
    return parts[0].unionByName(parts[1])


@query("stored_pages", "SELECT doc_id, CAST(ceil(len(string_split(text, chr(10))) / 20.0) AS BIGINT) AS pages, CAST(length(text) AS BIGINT) AS chars FROM documents")
def stored_pages(spark, sf_dir):
    path = folder(spark)
    pages = doc_pages(spark, sf_dir).withColumn("fiscal_year", F.concat(F.lit("FY"), (2020 + F.col("doc_id") % 5).cast("string")))
    tables.store_pages(pages, path)
    loaded = tables.load_pages(spark, path).groupBy("doc_id")
    # the line breaks between pages are not on the pages
    return loaded.agg(F.count(F.lit(1)).alias("pages"), (F.sum(F.length("text")) + F.count(F.lit(1)) - 1).alias("chars"))


@query("exported_metrics_csv", fin_sql("SELECT company_id, period, round_even(roe, 4) AS roe FROM rated"))
def exported_metrics_csv(spark, sf_dir):
    path = folder(spark)
    sinks.export_company_metrics(fin.with_flat_ratios(flat(spark, sf_dir)).select("company_id", "period", F.bround("roe", 4).alias("roe")), path)
    return read_csv(spark, path).select(F.col("company_id").cast("long").alias("company_id"), "period", F.col("roe").cast("double").alias("roe"))


@query("exported_pay_audit", views.oracle("SELECT company_id, y, person_no, order_index, 'missing_unit' AS flags FROM pay_row"))
def exported_pay_audit(spark, sf_dir):
    path = folder(spark)
    pay = views.view(spark, sf_dir, "pay_row").select("company_id", "y", "person_no", "order_index", F.array(F.lit("missing_unit")).alias("flags"))
    sinks.export_pay_audit(pay, path)
    return read_csv(spark, path).select(*[F.col(c).cast(pay.schema[c].dataType).alias(c) for c in ("company_id", "y", "person_no", "order_index")], "flags")


@query("declared_tables", "SELECT event_id, user_id, event_type FROM events")
def declared_tables(spark, sf_dir):
    """A table read by its declared schema; the columns that are not asked for are not read."""
    return tables.load_table(spark, f"{sf_dir}/events.parquet", "events").select("event_id", "user_id", "event_type")
