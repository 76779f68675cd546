import pytest

from tallyspark.operators import finance as fin
from tallyspark.sources import sinks, tables
from tallyspark.sources import textfiles as tf

CONDENSED = """# comment
===COMPANY===
Name: Safe Co
Ticker: SAF
Unit: millions

===PERIOD===
Label: FY2025
PriorLabel: FY2024

===INCOME_STATEMENT===
Revenue: 349,447.2, 310904.8
NetIncome: 100
EPS: 1.5, 1.2
===MARKET_DATA===
SharePrice: 20.5, 18
===MANAGEMENT_GUIDANCE===
GuidancePeriod: FY2026
ROE: current=18.4, low=15.5, high=21.5, commentary=More branches open in spring
===PRINCIPAL_RISKS===
[Credit Risk]
Description: borrowers default
Mitigation: limits
[Market Risk]
Description: prices move
===DIRECTOR_REMUNERATION===
Peter N, Executive: 1,000; Fees=100, Salaries=900
"""
SURVEY = """===COMPANY===
Name: Safe Co
Unit: millions
===PERIOD===
FiscalYear: FY2025
===PERFORMANCE===
Turnover: 1,500
Mystery: 4
===BOARD_COMPOSITION===
BoardSize: 11
IndependentNEDsCount: 5
===NED_BENEFITS===
MedicalCover: Yes — family too
MealAllowance: perhaps
TravelAccommodation: Reimbursed
IndemnityInsurance: No
===SOURCE===
BoardSize: page 40
A note
"""


def folder(tmp_path, **files):
    for name, body in files.items():
        (tmp_path / f"{name}.txt").write_text(body)
    return str(tmp_path)


def test_condensed_files(spark, tmp_path):
    p = tf.parse_condensed(tf.read_files(spark, folder(tmp_path, good=CONDENSED, bad="===COMPANY===\nTicker: X\n===PERIOD===\nLabel: FY2025\n")))
    assert [(r["name"], r["ticker"], r["label"]) for r in p["filings"].collect()] == [("Safe Co", "SAF", "FY2025")]
    assert p["errors"].count() == 1
    items = {r["normalized_name"]: (r["amount"], r["prior_amount"]) for r in p["line_items"].collect()}
    assert items == {"revenue": (349447.2, 310904.8), "net_income": (100.0, None), "eps": (1.5, 1.2)}
    assert {r["field"]: r["prior_value"] for r in p["market_data"].collect()} == {"share_price": 18.0}
    g = p["guidance"].first()
    assert (g["guidance_low"], g["guidance_period"], g["commentary"]) == (15.5, "FY2026", "More branches open in spring")
    assert [(r["category"], r["mitigation"]) for r in p["risks"].orderBy("order_index").collect()] == [("Credit Risk", "limits"), ("Market Risk", "")]
    d = p["pay_rows"].first()
    assert (d["director_name"], d["role"], d["total"], d["components"]) == ("Peter N", "executive", 1000.0, {"Fees": 100.0, "Salaries": 900.0})


def test_survey_files(spark, tmp_path):
    row = tf.survey_rows(tf.parse_survey(tf.read_files(spark, folder(tmp_path, s=SURVEY)))).first()
    assert (row["company_name"], row["fiscal_year"], row["turnover"], row["board_size"], row["independent_neds_count"]) == ("Safe Co", "FY2025", 1500.0, 11.0, 5.0)
    assert row["field_sources"] == {"board_size": "page 40"}
    assert {k: v["provided"] for k, v in row["ned_benefits"].items()} == {"MedicalCover": True, "TravelAccommodation": True, "IndemnityInsurance": False}
    assert row["ned_benefits"]["MedicalCover"]["detail"] == "family too"


def test_sniffing(spark):
    df = spark.createDataFrame([(CONDENSED,), (SURVEY,), ("plain",)], "content string")
    assert [r[0] for r in df.select(tf.sniff_format("content")).collect()] == ["condensed", "survey_data", "other"]


def flat(spark):
    rows = [(i, 1 + i % 2, f"FY202{i}", 2020 + i, "KES", 10.0 * i, None, None, None, None, "manual", None) for i in range(4)]
    return spark.createDataFrame(rows, tables.SCHEMAS["financials"])


def test_declared_schema_scan(spark, tmp_path):
    flat(spark).write.parquet(f"{tmp_path}/financials")
    df = tables.load_tables(spark, str(tmp_path), ["financials"])["financials"]
    assert df.count() == 4 and df.schema["revenue"].dataType.typeName() == "double"
    plan = df.where("company_id = 1").select("revenue")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(company_id), EqualTo(company_id,1)]" in plan
    assert "ReadSchema: struct<company_id:bigint,revenue:double>" in plan


def test_pages_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1, 2, "b", "FY2025"), (1, 1, "a", "FY2025"), (2, 1, "x", "FY2024")], "doc_id long, page int, text string, fiscal_year string")
    tables.store_pages(p, f"{tmp_path}/pages")
    assert [r["text"] for r in tables.load_pages(spark, f"{tmp_path}/pages", 1).collect()] == ["a", "b"]


def test_csv_exports(spark, tmp_path):
    sinks.export_financials_csv(flat(spark), f"{tmp_path}/f", 1)
    assert spark.read.option("header", True).csv(f"{tmp_path}/f").count() == 2
    flagged = spark.createDataFrame([(1, 5.0, ["a", "b"])], "id long, amount double, flags array<string>")
    sinks.export_pay_audit(flagged, f"{tmp_path}/p")
    assert spark.read.option("header", True).csv(f"{tmp_path}/p").first()["flags"] == "a;b"


def test_portfolio_comparison_and_group_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "FY2024", 1.0, None), (1, "FY2025", None, None), (2, "FY2024", 3.0, None)], "company_id long, fiscal_year string, a double, b double")
    sinks.export_portfolio(rows, f"{tmp_path}/portfolio")
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(f"{tmp_path}/portfolio").collect()) == [(1, "FY2025"), (2, "FY2024")]
    sinks.export_comparison(rows, f"{tmp_path}/cmp")
    assert spark.read.parquet(f"{tmp_path}/cmp/companies").where("company_id = 1").count() == 2
    assert sinks.export_group(rows, ["a", "b"], f"{tmp_path}/g") == ["a"]
    assert spark.read.parquet(f"{tmp_path}/g").count() == 2


def test_snapshot_leaves_private_tables_out(spark, tmp_path):
    t = {"financials": flat(spark), "users": flat(spark)}
    assert sinks.export_snapshot(t, f"{tmp_path}/snap") == {"financials": 4}
    assert not (tmp_path / "snap" / "users").exists()


def test_company_metric_export(spark, tmp_path):
    long = spark.createDataFrame([(1, "a", "FY2023", 10.0), (1, "a", "FY2025", 12.1)], "company_id long, metric string, fiscal_year string, value double")
    sinks.export_company_metrics(fin.comparison_matrix(long, ["company_id"], ["FY2023", "FY2025"]), f"{tmp_path}/m")
    assert abs(float(spark.read.option("header", True).csv(f"{tmp_path}/m").first()["cagr"]) - 10) < 1e-9


def test_upsert_touches_only_the_years_in_the_updates(spark, tmp_path):
    path = f"{tmp_path}/survey"
    base = spark.createDataFrame([(1, 1.0, "FY2024"), (1, 2.0, "FY2025"), (2, 3.0, "FY2025")], "company_id long, v double, fiscal_year string")
    sinks.write_years(base, path)
    untouched = sorted(f.name for f in (tmp_path / "survey" / "fiscal_year=FY2024").glob("*.parquet"))
    up = spark.createDataFrame([(1, None, "FY2025"), (2, 30.0, "FY2025"), (9, 9.0, "FY2026")], "company_id long, v double, fiscal_year string")
    for _ in range(2):
        sinks.upsert_years(spark, up, path, ["company_id", "fiscal_year"])
        got = sorted((r["company_id"], r["fiscal_year"], r["v"]) for r in spark.read.parquet(path).collect())
        assert got == [(1, "FY2024", 1.0), (1, "FY2025", 2.0), (2, "FY2025", 30.0), (9, "FY2026", 9.0)]
    assert untouched == sorted(f.name for f in (tmp_path / "survey" / "fiscal_year=FY2024").glob("*.parquet"))


FILING = """# a comment
===COMPANY===
Name: Big Works Ltd
Currency: KES

===PERIOD===
Label: FY2025
===INCOME_STATEMENT===
Revenue: 1,234.5, 1,100
NetProfit: n/a
EPS: 4
===MARKET_DATA===
SharePrice: 12.5, 11
===MANAGEMENT_GUIDANCE===
GuidancePeriod: FY2026
ROE: current=1, low=2, high=3, commentary=a, b
===PRINCIPAL_RISKS===
[Credit Risk]
Description: borrowers
[Other]
Mitigation: care
===DIRECTOR_REMUNERATION===
[GRAND TOTAL - Board] Total: 9
John Doe, Executive: 10; Fees=1, Salary=1,200
Jane Roe, Non-Executive: 5
not a row
"""


def udtf_rows(spark, part, *contents):
    from tallyspark.sources import udtf

    files = spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "file string, content string")
    return udtf.condensed_rows(files, part)


@pytest.mark.parametrize("part", ["line_items", "market_data", "guidance", "risks", "pay_rows"])
def test_table_function_gives_the_tables_of_the_column_parser(spark, part):
    contents = (FILING, FILING.replace("\n", "\r\n"), FILING.replace("FY2025", "FY2024").replace("Big Works", "Small Works"), "===COMPANY===\nName: x\n", "nothing", "")
    got = udtf_rows(spark, part, *contents)
    files = spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "file string, content string")
    want = tf.parse_condensed(files)[part]
    columns = [c for c in got.columns if c in want.columns]
    assert len(columns) >= 4
    rows = lambda df: sorted(map(str, (r.asDict() for r in df.select(*columns).collect())))
    assert rows(got.where("error IS NULL")) == rows(want) and rows(want)
    assert sorted((r.file, r.error) for r in got.where("error IS NOT NULL").collect()) == [
        ("f3", "PERIOD section or its Label is missing"), ("f4", "COMPANY section or its Name is missing"), ("f5", "COMPANY section or its Name is missing")]


def test_table_function_in_sql(spark):
    from tallyspark.sources import udtf

    udtf.register(spark)
    files = spark.createDataFrame([("a", FILING), ("b", None)], "file string, content string")
    got = spark.sql("SELECT f.file, t.kind, count(*) AS n FROM {files} f, LATERAL condensed(f.content, 'all') t GROUP BY ALL", files=files).collect()
    assert sorted((r.file, str(r.kind), r.n) for r in got) == [("a", "guidance", 1), ("a", "income_statement", 2), ("a", "market", 1), ("a", "pay", 2), ("a", "risk", 2), ("b", "None", 1)]
    [head] = spark.sql("SELECT t.* FROM {files} f, LATERAL condensed(f.content, 'filings') t WHERE f.file = 'a'", files=files).collect()
    assert (head.name, head.currency, head.label, head.ticker, head.error) == ("Big Works Ltd", "KES", "FY2025", None, None)
    for bad in ("'no such table'", "f.file"):
        with pytest.raises(Exception, match="second argument"):
            spark.sql("SELECT t.* FROM {files} f, LATERAL condensed(f.content, " + bad + ") t", files=files).collect()
    with pytest.raises(Exception, match="text of a file"):
        spark.sql("SELECT * FROM condensed(5, 'all')").collect()
