import datetime as dt

from pyspark.sql import functions as F

from tallyspark.operators import finance as fin
from tallyspark.operators import merge as mg
from tallyspark.operators import quality as qu
from tallyspark.operators import reports as rp
from tallyspark.operators import survey as sv
from tallyspark.sources import sinks

from .test_benchmark import norm, survey


def test_overview_has_every_part(spark):
    n = norm(spark, {"company_id": 1, "turnover": 5.0, "unit": "millions", "auditor_name": "A & B LLP", "audit_opinion": "qualified ", "chair_independent": "Yes"},
             {"company_id": 2, "turnover": 7.0, "unit": "millions", "auditor_name": "A and B"})
    d = spark.createDataFrame([(1, "FY2025", 3, 4), (1, "FY2025", 5, 4), (2, "FY2025", None, 4)], "company_id long, fiscal_year string, board_meetings_attended int, board_meetings_eligible int")
    parts = sv.overview(n, d)
    assert parts["metrics"].where("metric = 'turnover'").first()["average"] == 6.0
    assert parts["auditors"].first()["companies"] == 2
    assert parts["opinions"].first()["opinion"] == "Qualified"
    a = parts["attendance"].first()
    assert (a["directors"], a["average_pct"], a["full_attendance"], a["below_75"]) == (2, 87.5, 1, 0)
    assert parts["companies"].count() == 2 and parts["governance_auditors"].count() == 0


def test_sorting_puts_missing_last(spark):
    df = spark.createDataFrame([(1, "b", None, 5), (2, "A", 10.0, None), (3, "c", 20.0, 7)], "company_id long, name string, revenue double, financial_score int")
    order = lambda m: [r["company_id"] for r in fin.sort_companies(df, m).collect()]
    assert (order("name"), order("revenue"), order("score")) == ([2, 1, 3], [3, 2, 1], [3, 1, 2])


def test_items_of_a_document(spark):
    items = spark.createDataFrame([(1, 10), (2, 20)], "id long, statement_id long")
    st = spark.createDataFrame([(10, "equity", 7), (20, "equity", 8)], "id long, statement_type string, source_document_id long")
    assert [r["id"] for r in mg.items_with_statement(items, st, 8).collect()] == [2]


def test_activity_csv(spark, tmp_path):
    log = spark.createDataFrame([(1, None, "logged_in", "x", "Other", dt.datetime(2026, 1, 1, 22, 30))], "id long, actor string, action string, detail string, category string, created_at timestamp")
    sinks.export_activity_csv(log, f"{tmp_path}/a", -180)
    r = spark.read.option("header", True).csv(f"{tmp_path}/a").first()
    assert (r["date"], r["time"], r["account"]) == ("2026-01-02", "01:30:00", "Guest")


def test_copied_year_needs_the_same_file(spark):
    base = {"board_size": 7.0, "committees_per_board": 3.0, "ceo_monthly_salary": 9.0}
    s = survey(spark, {"company_id": 1, "fiscal_year": "FY2024", **base}, {"company_id": 1, "fiscal_year": "FY2025", **base}, {"company_id": 2, "fiscal_year": "FY2025", **base})
    fields = list(base)
    same = s.withColumn("source_filename", F.when(F.col("company_id") == 1, "R.pdf").otherwise("r.pdf"))
    r = qu.copied_years(same, fields).collect()
    assert [(x["company_id"], x["same_values"], x["severity"]) for x in r] == [(1, 3, "error")]
    assert qu.copied_years(s.withColumn("source_filename", F.col("fiscal_year")), fields).count() == 0


def test_dossier_keeps_every_row(spark):
    many = spark.range(500).select(F.lit(1).cast("long").alias("company_id"), F.lit("FY2025").alias("fiscal_year"), "id")
    d = rp.company_dossier({"a": many, "b": many.limit(3)})
    assert {r["section"]: r["count"] for r in d.groupBy("section").count().collect()} == {"a": 500, "b": 3}


def test_snapshot(spark):
    rows = [(1, 1, "FY2024", 2024, 100.0, 20.0, 100.0, 50.0, 50.0), (2, 1, "FY2025", 2025, 121.0, 30.0, 100.0, 40.0, 60.0), (3, 2, "FY2025", 2025, 10.0, -5.0, 100.0, 90.0, 10.0)]
    flat = spark.createDataFrame(rows, "id long, company_id long, period string, fiscal_year int, revenue double, net_income double, total_assets double, total_liabilities double, total_equity double")
    company = spark.createDataFrame([(1, "A", "Banks"), (2, "B", "Banks")], "company_id long, name string, sector string")
    got = {r["company_id"]: r for r in fin.company_snapshot(company, flat).collect()}
    assert (got[1]["period"], got[1]["outlook"], got[1]["sector_rank"], round(got[1]["revenue_cagr"], 6)) == ("FY2025", "Positive", 1, 21.0)
    assert got[2]["sector_rank"] == 2 and got[2]["risk_band"] == "Very High Risk"
