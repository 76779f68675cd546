import pytest
from pyspark.sql import functions as F

from tallyspark.functions import fields as fl
from tallyspark.functions import labels, money
from tallyspark.operators import peers
from tallyspark.operators import quality as qu
from tallyspark.operators import survey as sv

COLUMNS = ["company_id", "fiscal_year", "sector", "currency", "unit", "director_figures_unit", *fl.KIND]
SCHEMA = ", ".join(
    f"{c} {'long' if c == 'company_id' else 'string' if c not in fl.NUMERIC_FIELDS else 'double'}" for c in COLUMNS)


def survey(spark, *rows):
    return spark.createDataFrame([tuple({"fiscal_year": "FY2025", **r}.get(c) for c in COLUMNS) for r in rows], SCHEMA)


def company(spark, n=5):
    return spark.createDataFrame([(i, f"Company {i}", f"T{i}", "Banking") for i in range(1, n + 1)], "company_id long, name string, ticker string, sector string")


def norm(spark, *rows):
    return sv.normalised(survey(spark, *rows), company(spark), money.rate_table(spark))


def average(spark, metric, *rows):
    t = sv.extended_stats(sv.company_rows(norm(spark, *rows)), [metric]).collect()
    return t[0] if t else None


def test_headline_units_are_brought_together(spark):
    row = average(spark, "audit_fee", {"company_id": 1, "audit_fee": 50.0, "unit": "millions"}, {"company_id": 2, "audit_fee": 150_000.0, "unit": "thousands"})
    assert row["average"] == 100_000_000


def test_key_management_total_falls_back_to_parts(spark):
    row = average(spark, "kmp_total", {"company_id": 1, "kmp_short_term_benefits": 200_000.0, "director_figures_unit": "thousands"},
                  {"company_id": 2, "kmp_short_term_benefits": 400_000_000.0, "director_figures_unit": "units"})
    assert row["average"] == 300_000_000


def test_staff_cost_per_employee(spark):
    row = average(spark, "staff_cost_per_employee", {"company_id": 1, "staff_costs": 300.0, "employees_count": 1000.0, "unit": "millions"},
                  {"company_id": 2, "staff_costs": 500_000.0, "employees_count": 2000.0, "unit": "thousands"})
    assert row["average"] == 275_000


def test_one_company_is_never_an_average(spark):
    row = average(spark, "free_float_pct", {"company_id": 1, "free_float_pct": 10.0})
    assert row["average"] is None and row["company_count"] == 1


def test_yes_no_share(spark):
    rows = norm(spark, {"company_id": 1, "chair_independent": "Yes"}, {"company_id": 2, "chair_independent": "No"}, {"company_id": 3})
    row = sv.yesno_share(rows, ["chair_independent"]).first()
    assert (row["pct_yes"], row["answered"]) == (50.0, 2)


def test_currency_is_converted_into_the_common_one(spark):
    rows = norm(spark, *[{"company_id": i, "turnover": 100.0, "unit": "millions", "currency": c} for i, c in ((1, "RWF"), (2, "KES"), (3, None))])
    got = {r["company_id"]: r for r in sv.company_rows(rows).collect()}
    assert got[2]["currency"] == "KES" and got[2]["turnover"] == 100e6
    assert 0 < got[1]["turnover"] < 100e6


def test_no_rate_means_left_out_and_listed(spark):
    rows = norm(spark, {"company_id": 1, "turnover": 5.0, "currency": "GBP", "unit": "millions"}, {"company_id": 2, "turnover": 5.0, "unit": "millions"},
                {"company_id": 3, "turnover": 5.0, "unit": "millions"})
    assert sv.company_rows(rows).where("company_id = 1").first()["turnover"] is None
    assert [r["company_id"] for r in sv.normalisation_report(rows).where("status = 'excluded'").collect()] == [1]


def test_implausible_figures_are_dropped_and_named(spark):
    rows = norm(spark, {"company_id": 1, "turnover": 9e9, "unit": "millions"}, {"company_id": 2, "turnover": 9.0, "unit": "millions"})
    got = {r["company_id"]: r for r in sv.company_rows(rows).collect()}
    assert got[1]["turnover"] is None and got[1]["implausible_fields"] == ["turnover"]
    assert got[2]["turnover"] == 9e6


def test_unknown_unit_is_excluded_but_currency_code_is_whole_units(spark):
    df = spark.createDataFrame([("KES",), ("lakhs",), (None,), (" Millions",)], "u string")
    assert [r[0] for r in df.select(money.scale_headline("u")).collect()] == [1.0, None, 1.0, 1e6]


def test_pay_conversion(spark):
    df = spark.createDataFrame([(86916.418, "thousands", "units"), (1000.0, "thousands", "millions"), (5.0, None, "units")], "v double, s string, t string")
    got = [r["c"] for r in df.select(money.convert_pay("v", "s", "t").alias("c")).collect()]
    assert got[0]["value"] == pytest.approx(86_916_418) and got[1]["value"] == 1
    assert got[2]["value"] is None and got[2]["reason"]


def test_governance_scales_a_single_known_half(spark):
    df = spark.createDataFrame([(1.0, 2.0, None, None), (1.0, 2.0, 0.0, 5.0), (None, None, None, None)],
                               "independent_neds_count double, non_independent_neds_count double, directors_female double, directors_male double")
    assert [r["g"]["score"] for r in df.select(sv.governance().alias("g")).collect()] == [100.0, 50.0, None]


def test_full_year_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("FY2025", "2024", "H1 2025", "1H2025", "Q3 2025", "Half year", "semi-annual", "", None)], "l string")
    assert [r[0] for r in df.select(labels.is_full_year("l")).collect()] == [True, True] + [False] * 7


def test_latest_year_is_the_default(spark):
    s = survey(spark, {"company_id": 1, "fiscal_year": "FY2024"}, {"company_id": 2, "fiscal_year": "FY2024"}, {"company_id": 1, "fiscal_year": "FY2025"}, {"company_id": 1, "fiscal_year": "H1 2026"})
    assert sv.default_year(s).first()[0] == "FY2025"


def test_women_on_board_and_independents_cap(spark):
    r = sv.company_rows(norm(spark, {"company_id": 1, "directors_female": 3.0, "directors_male": 5.0, "independent_neds_count": 12.0, "board_size": 8.0})).first()
    assert r["women_on_board_pct"] == 37.5 and r["independent_pct"] == 100.0


def test_like_for_like(spark):
    now, prev = [100, 200, 300, 400, 500], [90, 210, 250, 380, 520]
    rows = [(i, y, "other_ned_annual_retainer", "money", float(v)) for y, vs in (("FY2025", now), ("FY2024", prev)) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "company_id long, fiscal_year string, metric string, kind string, value double")
    r = peers.like_for_like(df, "FY2025", "FY2024").first()
    assert (r["change_pct"], r["rose"], r["fell"], r["like_for_like"]) == (20.0, 3, 2, 5)


def test_own_change(spark):
    df = spark.createDataFrame([(4, "FY2025", "a", "money", 400.0), (4, "FY2024", "a", "money", 380.0), (4, "FY2025", "p", "pct", 37.5), (4, "FY2024", "p", "pct", 37.5)],
                               "company_id long, fiscal_year string, metric string, kind string, value double")
    got = {r["metric"]: r for r in peers.own_change(df).collect()}
    assert got["a"]["change_pct"] == 5.3 and got["p"]["change_pts"] == 0.0


def test_quality_score(spark):
    filled = {f: 1.0 for f in ("board_size", "turnover", "net_profit", "market_cap")}
    s = survey(spark, {"company_id": 1, **filled, "ceo_monthly_conversion_basis": "  "}).withColumn(
        "field_confidence", F.create_map(F.lit("board_size"), F.lit(0.6), F.lit("turnover"), F.lit(0.75)))
    r = qu.company_quality(s).first()
    n = len(fl.CORE_FIELDS)
    assert n == 40
    assert (r["complete"], r["needs_review"], r["missing"], r["score"]) == (3, 1, n - 4, round(3 / n * 100))


def test_field_counts():
    assert len(fl.CORE_FIELDS) == 40 and len(fl.EXTENDED_FIELDS) == 35


def test_null_rows_do_not_move_averages(spark):
    base = [{"company_id": 1, "free_float_pct": 10.0}, {"company_id": 2, "free_float_pct": 30.0}]
    assert average(spark, "free_float_pct", *base)["average"] == average(spark, "free_float_pct", *base, {"company_id": 3})["average"] == 20.0
