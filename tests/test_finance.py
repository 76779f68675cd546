import pytest

from tallyspark.functions.numeric import accounting_number, adaptive_round, cagr, pct_change
from tallyspark.operators import finance as fin
from tallyspark.operators import quality as qu
from tallyspark.operators import reports as rp
from tallyspark.operators import stats


def test_growth_rates(spark):
    df = spark.createDataFrame([(100.0, 121.0, 2), (0.0, 10.0, 2), (100.0, None, 2), (100.0, 0.0, 2), (100.0, -5.0, 2)], "a double, b double, n int")
    got = [r[0] for r in df.select(cagr("a", "b", "n")).collect()]
    assert got[0] == pytest.approx(10.0) and got[1:] == [None, None, -100.0, None]


def test_percent_change_uses_the_absolute_base(spark):
    df = spark.createDataFrame([(10.0, -20.0), (5.0, 0.0), (None, 1.0)], "n double, o double")
    assert [r[0] for r in df.select(pct_change("n", "o")).collect()] == [150.0, None, None]


def test_accounting_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ("(1,234)", "328,920", "-", "nil", "12.5", "-7", "abc", "")], "t string")
    assert [r[0] for r in df.select(accounting_number("t")).collect()] == [-1234.0, 328920.0, None, None, 12.5, -7.0, None, None]


def test_ratios_from_lines(spark):
    rows = [(1, "revenue", 200e6, 1), (1, "net_income", 40e6, 2), (2, "net_income", 40e6, 1), (3, "total_assets", 10.0, 1), (3, "total_liabilities", 6.0, 2),
            (3, "total_equity", 4.0, 3), (1, "revenue", 1.0, 9)]
    items = spark.createDataFrame(rows, "period_id long, normalized_name string, amount double, order_index int")
    got = {(r["period_id"], r["metric_name"]): r["value"] for r in fin.ratio_metrics(fin.amounts_by_name(items, ["period_id"]), ["period_id"]).collect()}
    assert got[(1, "net_margin")] == 20.0
    assert (2, "net_margin") not in got
    assert got[(3, "debt_equity")] == 1.5 and (3, "roe") not in got


def test_score_needs_all_inputs(spark):
    df = spark.createDataFrame([(20.0, 20.0, 1.0), (None, 20.0, 1.0), (-5.0, 90.0, 30.0)], "m double, r double, d double")
    assert [r[0] for r in df.select(fin.financial_score("m", "r", "d")).collect()] == [58, None, 40]


def test_risk_score_renormalises(spark):
    df = spark.createDataFrame([(4.0, None, None, None), (None, None, None, None), (2.0, 1.5, 8.0, 3.0)], "d double, c double, i double, m double")
    assert [r[0] for r in df.select(fin.risk_score("d", "c", "i", "m")).collect()] == [100.0, None, 18.0]


def test_rank_movement(spark):
    rows = [(1, "FY2024", 2.0), (2, "FY2024", 4.0), (1, "FY2025", 5.0), (2, "FY2025", 5.0)]
    r = stats.competition_rank(spark.createDataFrame(rows, "company_id long, y string, v double"), ["y"], "v").collect()
    rank = {(x["company_id"], x["y"]): x["rank"] for x in r}
    assert rank[(1, "FY2024")] - rank[(1, "FY2025")] == 1


def test_period_order_annual_before_interim(spark):
    df = spark.createDataFrame([(1, "H1 2025"), (1, "FY2025"), (1, "FY2024")], "company_id long, period string")
    norm = fin.with_prior(df, ["period"], "normalised", 1).where("recency = 1").first()
    label = fin.with_prior(df, ["period"], "label", 1).where("recency = 1").first()
    assert (norm["period"], label["period"]) == ("FY2025", "H1 2025")


def test_split_current_prior(spark):
    df = spark.createDataFrame([(1, "FY2024", "Revenue", 10.0, 9.0), (1, "H1 2024", "Tax", None, 3.0)],
                               "company_id long, period string, label string, current_amount double, prior_amount double")
    got = {(r["period"], r["label"]): r["amount"] for r in fin.split_current_prior(df, ["company_id"]).collect()}
    assert got == {("FY2024", "Revenue"): 10.0, ("FY2023", "Revenue"): 9.0, ("H1 2023", "Tax"): 3.0}


def test_adaptive_rounding(spark):
    df = spark.createDataFrame([(1234.5, "money"), (0.123, "pct"), (12.34, "pct")], "v double, k string")
    assert [r[0] for r in df.select(adaptive_round("v", "k")).collect()] == [1234.0, 0.12, 12.3]


def test_reconcile(spark):
    rows = [("ok", 100.0, False), ("ok", 200.0, False), ("ok", 300.0, True), ("off", 100.0, False), ("off", 200.0, False), ("off", 400.0, True), ("hole", None, False), ("hole", 5.0, True)]
    got = {r["t"]: r["within_rounding"] for r in qu.reconcile(spark.createDataFrame(rows, "t string, amount double, is_total boolean"), ["t"]).collect()}
    assert got == {"ok": True, "off": False, "hole": None}


def test_pay_flags(spark):
    df = spark.createDataFrame([(1, 110_347_259.0, "millions", 41_654_200_000.0, None), (2, 110_347_259.0, "units", 41_654_200_000.0, None)],
                               "id long, total double, unit string, turnover_full double, ceo_annual double")
    got = {r["id"]: r["flags"] for r in qu.pay_audit_flags(df).collect()}
    assert got == {1: ["pay_exceeds_turnover"]}


def test_composition_is_all_or_nothing(spark):
    rows = [(1, "executive", None, "Male", "Kenyan", 50.0), (1, "non_executive", True, "Female", "Kenyan", 60.0), (1, "non_executive", False, None, "British", 61.0)]
    r = qu.derive_composition(spark.createDataFrame(rows, "company_id long, role string, independent boolean, gender string, nationality string, age double"), ["company_id"]).first()
    assert r["directors_female"] is None and r["board_size"] == 3
    assert (r["executive_directors_count"], r["independent_neds_count"], r["neds_kenyan_count"], r["avg_age_non_executive_directors"]) == (1, 1, 1, 60.5)


def test_identity_checks(spark):
    df = spark.createDataFrame([(100.0, 60.0, 40.0, 7.0, 10.0, 3.0), (100.0, 60.0, 30.0, 9.0, 10.0, -9.0)],
                               "total_assets double, total_liabilities double, total_equity double, net_income double, profit_before_tax double, tax double")
    assert [(r["balance_ok"], r["profit_ok"]) for r in fin.identity_checks(df).collect()] == [(True, True), (False, False)]


def test_tree(spark):
    rows = [(1, 1, None, 1, "a", 5.0), (1, 2, 1, 2, "b", 6.0), (1, 3, 2, 1, "b", 7.0)]
    t = rp.flatten_tree(spark.createDataFrame(rows, "statement_id long, id long, parent_id long, order_index int, normalized_name string, amount double"))
    assert sorted((r["id"], r["depth"], r["has_children"]) for r in t.collect()) == [(1, 0, True), (2, 1, True), (3, 2, False)]
    assert rp.find_amount(t, "b").first()["b"] == 6.0


def test_tree_has_no_depth_limit(spark):
    chain = [(1, i, i - 1 if i else None, 0, "x", 1.0) for i in range(13)] + [(1, 50, 51, 0, "x", 1.0), (1, 51, 50, 0, "x", 1.0), (1, 60, 99, 0, "x", 1.0)]
    t = rp.flatten_tree(spark.createDataFrame(chain, "statement_id long, id long, parent_id long, order_index int, normalized_name string, amount double"))
    assert sorted((r["id"], r["depth"]) for r in t.collect()) == [(i, i) for i in range(13)]  # a cycle and an orphan hang on no root


def test_pay_rows_are_cleaned(spark):
    rows = [("Patricia Ithau***", {"Fees": "10", "Total Emoluments 2025 Shs": "1,200", "Total Emoluments 2024 Shs": "900"}, None, 2025), ("2023", {"x": "1"}, None, 2025),
            ("Agnes Lutukai(3)", {"Fees": "-"}, None, 2025), ("Total", {"Total": "5,000"}, None, 2025), ("Left Early", {"Total 2024": "70"}, None, 2025)]
    df = spark.createDataFrame(rows, "director_name string, components map<string,string>, total string, year int")
    got = {r["director_name"]: (r["total"], r["is_grand_total"]) for r in qu.clean_pay_rows(df).collect()}
    assert got == {"Patricia Ithau": (1200.0, False), "Total": (5000.0, True)}
    assert qu.clean_pay_rows(df)._jdf.queryExecution().optimizedPlan().toString().count("map_entries(") == 1  # amounts are read once a row


def test_fixed_fee_component(spark):
    df = spark.createDataFrame([({"Sitting fees": 5.0, "Annual fees": 9.0, "Total fees": 14.0},)], "c map<string,double>")
    assert df.select(qu.fixed_fee("c").alias("f")).first()["f"] == 9.0


def test_comparison_width(spark):
    df = spark.createDataFrame([(1, "FY2024")], "company_id long, fiscal_year string")
    with pytest.raises(ValueError):
        fin.matched_cohort(df, ["FY2024"])
    assert fin.matched_cohort(df, ["FY2024", "FY2025"]).count() == 0
