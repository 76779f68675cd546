"""Report queries and the section-file readers run over files printed from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as fl
from ..functions import labels, names
from ..operators import finance as fin
from ..operators import merge as mg
from ..operators import quality as qu
from ..operators import reports as rp
from ..operators import stats
from ..operators import survey as sv
from ..sources import textfiles as tf
from ..sources import udtf as ud
from . import views
from .benchmark import crow_sql, gated_sql, metric_sql, norm, norm_sql, pay_sql, rows
from .finance import fin_sql, flat, pct
from .quality import status_cte, survey as quality_survey
from .registry import query


def company(spark, sf_dir):
    return views.view(spark, sf_dir, "company")


# ---------------------------------------------------------------- section files
def condensed_files(spark, sf_dir):
    f = flat(spark, sf_dir)
    num = lambda c: F.format_number(F.col(c), 1)
    head = F.concat(
        F.lit("# printed\n===COMPANY===\n"), F.when(F.col("id") % 9 != 0, F.concat(F.lit("Name: Company "), F.col("company_id").cast("string"), F.lit("\n"))).otherwise(""),
        F.lit("Ticker: T"), F.col("company_id").cast("string"), F.lit("\nCurrency: KES\nUnit: millions\n\n===PERIOD===\nLabel: "), F.col("period"), F.lit("\nPriorLabel: x\n"))
    inc = F.concat(F.lit("===INCOME_STATEMENT===\nRevenue: "), F.coalesce(num("revenue"), F.lit("")), F.lit(", 1,000.5\n"),
                   F.when(F.col("net_income").isNotNull(), F.concat(F.lit("NetIncome: "), num("net_income"), F.lit("\n"))).otherwise(""))
    bal = F.concat(F.lit("===BALANCE_SHEET===\nTotalAssets: "), num("total_assets"), F.lit(", 7\n"))
    md = F.concat(F.lit("===MARKET_DATA===\nSharePrice: 12.5, 11\nDividendPerShare: "), (F.col("id") % 10).cast("string"), F.lit("\n"))
    gd = F.lit("===MANAGEMENT_GUIDANCE===\nGuidancePeriod: FY2026\nROE: current=18.4, low=15.5, high=21.5, commentary=More branches open in spring\nMargin: current=5, low=4, high=6\n")
    rk = F.lit("===PRINCIPAL_RISKS===\n[Credit Risk]\nDescription: borrowers\nMitigation: limits\n[Market Risk]\nDescription: prices\n")
    py = F.concat(F.lit("===DIRECTOR_REMUNERATION===\nJohn Doe, Executive: "), (F.col("id") % 97 + 1).cast("string"), F.lit("; Fees=10, Salary=1,200\nJane Roe, Non-Executive: 55\nGRAND TOTAL: 99\n"))
    return f.select(F.concat(F.lit("file-"), F.col("id").cast("string"), F.lit(".txt")).alias("file"), F.concat(head, inc, bal, md, gd, rk, py).alias("content"))


_FILE = "'file-' || CAST(id AS VARCHAR) || '.txt' AS file"


@query("condensed_filings", views.oracle(f"SELECT {_FILE}, 'Company ' || CAST(company_id AS VARCHAR) AS name, 'T' || CAST(company_id AS VARCHAR) AS ticker, 'KES' AS currency, period AS label FROM financials WHERE id % 9 <> 0"))
def condensed_filings(spark, sf_dir):
    return tf.parse_condensed(condensed_files(spark, sf_dir))["filings"].select("file", "name", "ticker", "currency", "label")


@query("condensed_errors", views.oracle(f"SELECT {_FILE}, 'COMPANY section or its Name is missing' AS error FROM financials WHERE id % 9 = 0"))
def condensed_errors(spark, sf_dir):
    return tf.parse_condensed(condensed_files(spark, sf_dir))["errors"]


@query("condensed_line_items", views.oracle(f"""SELECT {_FILE}, 'income_statement' AS statement_type, 'revenue' AS normalized_name, revenue AS amount, 1000.5::DOUBLE AS prior_amount FROM financials WHERE id % 9 <> 0 AND revenue IS NOT NULL
 UNION ALL SELECT {_FILE}, 'income_statement', 'net_income', net_income, NULL FROM financials WHERE id % 9 <> 0 AND net_income IS NOT NULL
 UNION ALL SELECT {_FILE}, 'balance_sheet', 'total_assets', total_assets, 7 FROM financials WHERE id % 9 <> 0"""))
def condensed_line_items(spark, sf_dir):
    return tf.parse_condensed(condensed_files(spark, sf_dir))["line_items"].select("file", "statement_type", "normalized_name", "amount", "prior_amount")


@query("condensed_items_lateral", views.oracle(f"""SELECT {_FILE}, 'income_statement' AS statement_type, 'revenue' AS normalized_name, revenue AS amount, 1000.5::DOUBLE AS prior_amount, NULL AS error FROM financials WHERE id % 9 <> 0 AND revenue IS NOT NULL
 UNION ALL SELECT {_FILE}, 'income_statement', 'net_income', net_income, NULL, NULL FROM financials WHERE id % 9 <> 0 AND net_income IS NOT NULL
 UNION ALL SELECT {_FILE}, 'balance_sheet', 'total_assets', total_assets, 7, NULL FROM financials WHERE id % 9 <> 0
 UNION ALL SELECT {_FILE}, NULL, NULL, NULL, NULL, 'COMPANY section or its Name is missing' FROM financials WHERE id % 9 = 0"""))
def condensed_items_lateral(spark, sf_dir):
    """The line items again, by the table function in SQL; a malformed file gives its error row."""
    ud.register(spark)
    files = condensed_files(spark, sf_dir)
    return spark.sql("SELECT f.file, t.statement_type, t.normalized_name, t.amount, t.prior_amount, t.error FROM {files} f, LATERAL condensed(f.content, 'line_items') t", files=files)


@query("condensed_records_lateral", views.oracle(f"""WITH ok AS (SELECT * FROM financials WHERE id % 9 <> 0)
 SELECT {_FILE}, 'income_statement' AS kind, 'Revenue' AS label, revenue AS amount, 'prior 1000.5' AS note FROM ok WHERE revenue IS NOT NULL
 UNION ALL SELECT {_FILE}, 'income_statement', 'NetIncome', net_income, NULL FROM ok WHERE net_income IS NOT NULL UNION ALL SELECT {_FILE}, 'balance_sheet', 'TotalAssets', total_assets, 'prior 7' FROM ok
 UNION ALL SELECT {_FILE}, 'market', 'share_price', 12.5, NULL FROM ok UNION ALL SELECT {_FILE}, 'market', 'dividend_per_share', id % 10, NULL FROM ok
 UNION ALL SELECT {_FILE}, 'guidance', 'ROE', 15.5, 'More branches open in spring' FROM ok UNION ALL SELECT {_FILE}, 'guidance', 'Margin', 4, NULL FROM ok
 UNION ALL SELECT {_FILE}, 'risk', 'Credit Risk', NULL, 'limits' FROM ok UNION ALL SELECT {_FILE}, 'risk', 'Market Risk', NULL, '' FROM ok
 UNION ALL SELECT {_FILE}, 'pay', 'John Doe', id % 97 + 1, 'executive' FROM ok UNION ALL SELECT {_FILE}, 'pay', 'Jane Roe', 55, 'non_executive' FROM ok UNION ALL SELECT {_FILE}, 'pay', 'GRAND TOTAL', 99, 'non_executive' FROM ok"""))
def condensed_records_lateral(spark, sf_dir):
    """Everything a file holds in one pass over it."""
    return ud.condensed_rows(condensed_files(spark, sf_dir), "all").where("error IS NULL").select("file", "kind", "label", "amount", "note")


@query("condensed_pay_rows", views.oracle(f"""SELECT {_FILE}, 'John Doe' AS director_name, 'executive' AS role, CAST(id % 97 + 1 AS DOUBLE) AS total, 1200::DOUBLE AS salary, FALSE AS is_grand_total FROM financials WHERE id % 9 <> 0
 UNION ALL SELECT {_FILE}, 'Jane Roe', 'non_executive', 55, NULL, FALSE FROM financials WHERE id % 9 <> 0 UNION ALL SELECT {_FILE}, 'GRAND TOTAL', 'non_executive', 99, NULL, TRUE FROM financials WHERE id % 9 <> 0"""))
def condensed_pay_rows(spark, sf_dir):
    p = tf.parse_condensed(condensed_files(spark, sf_dir))["pay_rows"]
    return p.select("file", "director_name", "role", "total", F.try_element_at("components", F.lit("Salary")).alias("salary"), "is_grand_total")


@query("condensed_guidance_risks", views.oracle(f"""SELECT {_FILE}, 'guidance' AS kind, 'ROE' AS label, 15.5::DOUBLE AS low, 'More branches open in spring' AS note FROM financials WHERE id % 9 <> 0
 UNION ALL SELECT {_FILE}, 'guidance', 'Margin', 4, NULL FROM financials WHERE id % 9 <> 0 UNION ALL SELECT {_FILE}, 'risk', 'Credit Risk', NULL, 'limits' FROM financials WHERE id % 9 <> 0
 UNION ALL SELECT {_FILE}, 'risk', 'Market Risk', NULL, '' FROM financials WHERE id % 9 <> 0 UNION ALL SELECT {_FILE}, 'market', 'share_price', 12.5, NULL FROM financials WHERE id % 9 <> 0
 UNION ALL SELECT {_FILE}, 'market', 'dividend_per_share', id % 10, NULL FROM financials WHERE id % 9 <> 0"""))
def condensed_guidance_risks(spark, sf_dir):
    p = tf.parse_condensed(condensed_files(spark, sf_dir))
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    g = p["guidance"].select("file", F.lit("guidance").alias("kind"), F.col("metric_name").alias("label"), F.col("guidance_low").alias("low"), F.col("commentary").alias("note"))
    r = p["risks"].select("file", F.lit("risk").alias("kind"), F.col("category").alias("label"), none_d.alias("low"), F.col("mitigation").alias("note"))
    m = p["market_data"].select("file", F.lit("market").alias("kind"), F.col("field").alias("label"), F.col("value").alias("low"), none_s.alias("note"))
    return g.unionByName(r).unionByName(m)


def survey_files(spark, sf_dir):
    s = views.survey(spark, sf_dir)
    line = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(label + ": "), F.format_number(F.col(c), 0), F.lit("\n"))).otherwise("")
    body = F.concat(
        F.lit("===COMPANY===\nName: Company "), F.col("company_id").cast("string"), F.lit("\nUnit: millions\n===PERIOD===\nFiscalYear: "), F.col("fiscal_year"),
        F.lit("\n===PERFORMANCE===\n"), line("Turnover", "turnover"), line("NetProfit", "net_profit"), F.lit("Nonsense: 12\n===BOARD_COMPOSITION===\n"),
        line("BoardSize", "board_size"), line("IndependentNEDsCount", "independent_neds_count"), line("NEDsKenyanCount", "neds_kenyan_count"),
        F.lit("===CEO_PAY===\n"), line("CEOMonthlySalary", "ceo_monthly_salary"), F.lit("===NED_BENEFITS===\nMedicalCover: "),
        F.when(F.col("n_lines") % 2 == 0, "Yes — family too").otherwise("No"), F.lit("\nClubMembership: perhaps\n===SOURCE===\nBoardSize: page 12\nSome general note\n"))
    return s.select(F.concat(F.lit("s-"), F.col("company_id").cast("string"), F.lit("-"), F.col("fiscal_year")).alias("file"), body.alias("content"))


_SFILE = "'s-' || CAST(company_id AS VARCHAR) || '-' || fiscal_year AS file"


@query("survey_file_values", views.oracle(" UNION ALL ".join(f"SELECT {_SFILE}, '{f}' AS field, {f} AS value FROM survey WHERE {f} IS NOT NULL" for f in
                                                             ("turnover", "net_profit", "board_size", "independent_neds_count", "neds_kenyan_count", "ceo_monthly_salary"))))
def survey_file_values(spark, sf_dir):
    return tf.parse_survey(survey_files(spark, sf_dir))["values"]


@query("survey_file_rows", views.oracle(f"""SELECT {_SFILE}, 'Company ' || CAST(company_id AS VARCHAR) AS company_name, fiscal_year, board_size, ceo_monthly_salary, 'page 12' AS board_source, n_lines % 2 = 0 AS medical,
 CASE WHEN n_lines % 2 = 0 THEN 'family too' END AS medical_detail FROM survey"""))
def survey_file_rows(spark, sf_dir):
    w = tf.survey_rows(tf.parse_survey(survey_files(spark, sf_dir)))
    b = F.try_element_at("ned_benefits", F.lit("MedicalCover"))
    return w.select("file", "company_name", "fiscal_year", "board_size", "ceo_monthly_salary", F.try_element_at("field_sources", F.lit("board_size")).alias("board_source"),
                    b["provided"].alias("medical"), b["detail"].alias("medical_detail"))


@query("sniffed_formats", views.oracle("""SELECT 'survey_data' AS format, count(*) AS files FROM survey UNION ALL SELECT 'condensed', count(*) FROM financials UNION ALL SELECT 'other', count(*) FROM documents"""))
def sniffed_formats(spark, sf_dir):
    files = survey_files(spark, sf_dir).unionByName(condensed_files(spark, sf_dir)).unionByName(
        views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content")))
    return files.groupBy(tf.sniff_format("content").alias("format")).agg(F.count(F.lit(1)).alias("files"))


# ---------------------------------------------------------------- trees
def tree_items(spark, sf_dir):
    """Line items of an order as a tree: line 1 is the root, odd lines hang on it, even lines on the line before."""
    li = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("amount"))
    n = F.col("l_linenumber")
    return li.select(F.col("l_orderkey").alias("statement_id"), n.cast("long").alias("id"), F.when(n == 1, None).when(n % 2 == 0, n - 1).otherwise(F.lit(1)).cast("long").alias("parent_id"),
                     n.alias("order_index"), "amount", F.concat(F.lit("name"), (n % 3).cast("string")).alias("normalized_name"))


_TREE = """li AS (SELECT l_orderkey AS statement_id, l_linenumber::BIGINT AS id, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber % 2 = 0 THEN l_linenumber - 1 ELSE 1 END AS parent_id, sum(l_quantity) AS amount, 'name' || (l_linenumber % 3)::VARCHAR AS normalized_name FROM lineitem GROUP BY 1, l_linenumber),
 tr AS (SELECT *, 0 AS depth, [id] AS path FROM li WHERE parent_id IS NULL UNION ALL SELECT li.*, tr.depth + 1, list_append(tr.path, li.id) FROM li JOIN tr ON li.statement_id = tr.statement_id AND li.parent_id = tr.id)"""


@query("flattened_tree", f"""WITH RECURSIVE {_TREE} SELECT statement_id, id, depth, array_to_string(path, '.') AS print_path,
 EXISTS (SELECT 1 FROM li c WHERE c.statement_id = tr.statement_id AND c.parent_id = tr.id) AS has_children FROM tr""")
def flattened_tree(spark, sf_dir):
    return rp.flatten_tree(tree_items(spark, sf_dir)).select(
        "statement_id", "id", "depth", F.array_join(F.transform("path", lambda p: p["i"].cast("string")), ".").alias("print_path"), "has_children")


@query("amounts_in_tree", f"WITH RECURSIVE {_TREE} SELECT statement_id, arg_min(amount, path) AS name2 FROM tr WHERE normalized_name = 'name2' GROUP BY 1")
def amounts_in_tree(spark, sf_dir):
    return rp.find_amount(rp.flatten_tree(tree_items(spark, sf_dir)), "name2")


# ---------------------------------------------------------------- reports
@query("named_activity", views.oracle("""SELECT a.id, CASE WHEN a.company_id IS NOT NULL THEN coalesce(c.name, 'Company ' || CAST(a.company_id AS VARCHAR)) END AS company_name FROM activity a LEFT JOIN company c USING (company_id)"""))
def named_activity(spark, sf_dir):
    return rp.enrich_left(views.view(spark, sf_dir, "activity").select("id", "company_id"), company(spark, sf_dir)).select("id", "company_name")


@query("coverage_stats", views.oracle("SELECT count(DISTINCT company_id) AS companies, count(DISTINCT fiscal_year) AS years, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year, (SELECT count(*) FROM register) AS directors FROM survey"))
def coverage_stats(spark, sf_dir):
    return rp.coverage_stats(views.survey(spark, sf_dir).select("company_id", "fiscal_year"), views.view(spark, sf_dir, "register"))


@query("companies_per_sector", views.oracle("SELECT coalesce(sector, 'Other') AS sector, count(*) AS companies FROM company WHERE company_id IN (SELECT company_id FROM survey) GROUP BY 1"))
def companies_per_sector(spark, sf_dir):
    return rp.companies_per_sector(views.survey(spark, sf_dir), company(spark, sf_dir))


@query("home_summary", crow_sql("SELECT fiscal_year, round_even(sum(directors_female) * 100.0 / nullif(sum(directors_female) + sum(directors_male), 0), 1) AS women_on_boards_pct, count(*) AS companies_surveyed FROM crow GROUP BY 1"))
def home_summary(spark, sf_dir):
    return rp.women_on_boards(rows(spark, sf_dir))


@query("public_board_rows", norm_sql("""SELECT f.company_id, c.name, fiscal_year, board_size, executive_directors_count, non_executive_directors_count, directors_female, directors_male, CAST(substr(fiscal_year, 3) AS INT) AS year
 FROM full_year f JOIN company c ON c.company_id = f.company_id WHERE board_size <> 0"""))
def public_board_rows(spark, sf_dir):
    return rp.public_board_rows(views.survey(spark, sf_dir), company(spark, sf_dir))


@query("unique_slugs", """WITH s AS (SELECT p_partkey AS company_id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part)
 SELECT company_id, CASE WHEN company_id <> min(company_id) OVER (PARTITION BY slug) THEN slug || '-' || CAST(company_id AS VARCHAR) ELSE slug END AS slug FROM s""")
def unique_slugs(spark, sf_dir):
    return rp.unique_slugs(views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("company_id"), F.col("p_name").alias("name")))


@query("representative_year", views.oracle("""WITH s AS (SELECT company_id, fiscal_year FROM survey), n AS (SELECT fiscal_year, count(*) AS n FROM s GROUP BY 1),
 m AS (SELECT company_id, fiscal_year, n, max(n) OVER (PARTITION BY company_id) AS b FROM s JOIN n USING (fiscal_year)) SELECT company_id, max(fiscal_year) AS fiscal_year FROM m WHERE n >= b / 2.0 GROUP BY 1"""))
def representative_year(spark, sf_dir):
    return rp.representative_year(views.survey(spark, sf_dir))


@query("file_inventory", views.oracle("""WITH u AS (SELECT company_id, lower(source_filename) AS file_key, fiscal_year AS label, TRUE AS s, FALSE AS d FROM survey UNION ALL SELECT company_id, lower(filename), period_label, FALSE, TRUE FROM doc_meta)
 SELECT company_id, file_key, max(label) AS fiscal_year, bool_or(s) AS has_survey, bool_or(d) AS has_document, count(*) AS records FROM u GROUP BY 1, 2"""))
def file_inventory(spark, sf_dir):
    return rp.file_inventory(views.survey(spark, sf_dir), views.view(spark, sf_dir, "doc_meta"))


@query("remuneration_history", views.oracle("""SELECT company_id, y, count(*) FILTER (WHERE order_index <> 7) AS named_rows, (sum(amount) FILTER (WHERE order_index <> 7))::BIGINT AS named_total, max(amount) FILTER (WHERE order_index = 7) AS printed_total
 FROM pay_row GROUP BY 1, 2"""))
def remuneration_history(spark, sf_dir):
    return rp.remuneration_history(views.view(spark, sf_dir, "pay_row").withColumn("is_total", F.col("order_index") == 7))


@query("name_occurrences", views.oracle("""SELECT period_id, director_name, person_no, order_index, fees, CAST(row_number() OVER (PARTITION BY period_id, director_name ORDER BY order_index, person_no, fees) AS INT) AS occurrence FROM pay_row"""))
def name_occurrences(spark, sf_dir):
    p = views.view(spark, sf_dir, "pay_row").select("period_id", "director_name", "person_no", "order_index", "fees")
    return rp.occurrence_number(p, ["period_id", "director_name"], ["order_index", "person_no", "fees"])


_CAND = """k AS (SELECT company_id, lower(director_name) AS nk, table_kind, y, count(*) AS c FROM pay_row GROUP BY ALL),
 cd AS (SELECT company_id, nk, table_kind FROM k GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND max(c) = 1 AND length(nk) - length(replace(nk, ' ', '')) >= 1)"""


@query("director_series", views.oracle(f"""WITH {_CAND}, p AS (SELECT p.company_id, lower(director_name) AS name_key, p.table_kind, y, amount, fees FROM pay_row p JOIN cd ON cd.company_id = p.company_id AND cd.nk = lower(director_name) AND cd.table_kind = p.table_kind)
 SELECT company_id, name_key, table_kind, y, 'total' AS component, amount::DOUBLE AS amount FROM p UNION ALL SELECT company_id, name_key, table_kind, y, 'fees', fees::DOUBLE FROM p"""))
def director_series(spark, sf_dir):
    p = views.view(spark, sf_dir, "pay_row").withColumns({"name_key": names.person_key("director_name"), "total": F.col("amount").cast("double"),
                                                          "components": F.create_map(F.lit("fees"), F.col("fees").cast("double"))})
    cand = mg.align_directors(p.withColumn("fiscal_year", F.col("y").cast("string")))
    return rp.director_series(p, cand)


@query("policy_from_pay", views.oracle("""WITH p AS (SELECT company_id, 'FY' || y::VARCHAR AS fiscal_year, order_index = 1 AS is_chair, amount AS fee FROM pay_row),
 c AS (SELECT company_id, fiscal_year, fee, count(*) AS k FROM p WHERE NOT is_chair AND fee > 0 GROUP BY ALL), m AS (SELECT company_id, fiscal_year, arg_max(fee, (k, fee)) AS mode, max(k) AS times FROM c GROUP BY ALL),
 d AS (SELECT company_id, fiscal_year, quantile_cont(fee, 0.5) AS med FROM p WHERE NOT is_chair AND fee > 0 GROUP BY ALL), n AS (SELECT company_id, fiscal_year, CASE WHEN times > 1 THEN mode ELSE med END AS ned FROM m JOIN d USING (company_id, fiscal_year)),
 h AS (SELECT company_id, fiscal_year, max(fee) AS chair FROM p WHERE is_chair AND fee > 0 GROUP BY ALL)
 SELECT s.company_id, s.fiscal_year, CAST(CASE WHEN other_ned_annual_retainer IS NULL AND ned IS NOT NULL AND n_units % 3 <> 0 THEN ned ELSE other_ned_annual_retainer END AS DOUBLE) AS other_ned_annual_retainer,
  CAST(CASE WHEN chairperson_annual_retainer IS NULL AND chair IS NOT NULL AND n_units % 3 <> 0 THEN chair ELSE chairperson_annual_retainer END AS DOUBLE) AS chairperson_annual_retainer,
  CAST(CASE WHEN n_units % 3 <> 0 AND ((other_ned_annual_retainer IS NULL AND ned IS NOT NULL) OR (chairperson_annual_retainer IS NULL AND chair IS NOT NULL)) THEN 0.45 END AS DOUBLE) AS confidence
 FROM survey s LEFT JOIN n USING (company_id, fiscal_year) LEFT JOIN h USING (company_id, fiscal_year)"""))
def policy_from_pay(spark, sf_dir):
    p = views.view(spark, sf_dir, "pay_row").select("company_id", F.concat(F.lit("FY"), F.col("y").cast("string")).alias("fiscal_year"),
                                                   (F.col("order_index") == 1).alias("is_chair"), F.col("amount").cast("double").alias("fee"))
    return rp.policy_from_pay(views.survey(spark, sf_dir), p, F.col("n_units") % 3 == 0)


@query("key_findings", crow_sql("""SELECT fiscal_year, arg_max(name, (total_director_remuneration, -company_id)) FILTER (WHERE total_director_remuneration > 0) AS highest_paying, count(*) FILTER (WHERE total_director_remuneration > 0) AS ranked_companies,
 count(*) FILTER (WHERE ip IS NOT NULL) AS independence_known, count(*) FILTER (WHERE independence_compliant) AS independence_met, count(*) FILTER (WHERE gp IS NOT NULL) AS gender_known, count(*) FILTER (WHERE gender_compliant) AS gender_met FROM crow GROUP BY 1"""))
def key_findings(spark, sf_dir):
    return rp.key_findings(rows(spark, sf_dir))


@query("sector_pay_extremes", norm_sql(f"""WITH s AS (SELECT fiscal_year, coalesce(sector, 'Unclassified') AS sector, {gated_sql(pay_sql('other_ned_annual_retainer'))} AS a FROM norm GROUP BY ALL)
 SELECT fiscal_year, arg_max(sector, (a, sector)) AS best_sector, arg_min(sector, (a, sector)) AS lowest_sector, count(*) AS sectors FROM s WHERE a IS NOT NULL GROUP BY 1"""))
def sector_pay_extremes(spark, sf_dir):
    return rp.sector_extremes(sv.sector_comparison(norm(spark, sf_dir)), "avg_other_ned_annual_retainer")


_LINES = ["women_in_workforce_pct", "board_attendance_pct", "key_audit_matters_count", "free_float_pct"]


@query("market_lines", crow_sql(f"""WITH e AS (SELECT fiscal_year, company_id, {", ".join(_LINES)} FROM crow), le AS (UNPIVOT e ON {", ".join(_LINES)} INTO NAME metric VALUE value), m AS ({metric_sql("le", "fiscal_year")})
 SELECT fiscal_year, metric, CASE WHEN metric LIKE '%_pct' THEN printf('%.1f%%', round_even(p50, 1)) ELSE printf('%.0f', round_even(p50, 0)) END AS headline, company_count AS companies FROM m WHERE p50 IS NOT NULL"""))
def market_lines(spark, sf_dir):
    m = sv.metric_table(sv.unpivot(rows(spark, sf_dir), ["fiscal_year", "company_id"], _LINES), ["fiscal_year"])
    kinds = spark.createDataFrame([(f, "pct" if f.endswith("_pct") else "count") for f in _LINES], "metric string, kind string")
    return rp.market_lines(m, kinds).drop("detail")


@query("skewed_metrics", norm_sql("""WITH g AS (SELECT fiscal_year, count(net_profit) AS n, avg(net_profit) AS a, quantile_cont(net_profit, 0.5) AS p FROM norm GROUP BY 1)
 SELECT fiscal_year, coalesce(n >= 3 AND round_even(p, 2) <> 0 AND round_even(a, 2) > 3 * round_even(p, 2), FALSE) AS skewed, CASE WHEN abs((round_even(a, 2) - round_even(p, 2)) / abs(round_even(p, 2)) * 100) < 3 THEN 'in line with' WHEN a > p THEN 'above' ELSE 'below' END AS position FROM g"""))
def skewed_metrics(spark, sf_dir):
    m = sv.metric_table(sv.unpivot(norm(spark, sf_dir), ["fiscal_year", "company_id"], ["net_profit"]), ["fiscal_year"])
    phrase = labels.relative_phrase("average", "p50")
    return m.select("fiscal_year", labels.skewed("average", "p50", "company_count").alias("skewed"),
                    F.regexp_replace(phrase, r"^[\d,]+% ", "").alias("position"))


@query("reading_tasks", views.oracle(f"""WITH {status_cte(fl.CORE_FIELDS)} SELECT company_id, fiscal_year, CASE field {" ".join(f"WHEN '{f}' THEN '{s}'" for f, s in fl.SECTION.items())} END AS section, count(*) AS fields_to_read
 FROM fs JOIN survey s USING (company_id, fiscal_year) WHERE status = 'missing' AND (s.n_units + length(field)) % 3 = 0 GROUP BY ALL"""))
def reading_tasks(spark, sf_dir):
    s = quality_survey(spark, sf_dir)
    st = qu.field_status(s, fl.CORE_FIELDS)
    f = F.explode(F.filter(F.array(*[F.lit(x) for x in fl.CORE_FIELDS]), lambda x: (F.col("n_units") + F.length(x)) % 3 == 0)).alias("field")
    return rp.gap_tasks(st, s.select("company_id", "fiscal_year", f))


@query("imports_needing_attention", views.oracle("""WITH s AS (SELECT l_orderkey AS doc_id, round_even(avg(CAST(round(l_discount * 100) AS INT)) * 10, 1) AS extraction_score FROM lineitem GROUP BY 1)
 SELECT o_orderkey AS doc_id, extraction_score, coalesce(extraction_score < 60, TRUE) AS needs_attention FROM orders LEFT JOIN s ON s.doc_id = o_orderkey"""))
def imports_needing_attention(spark, sf_dir):
    s = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.bround(F.avg(F.round(F.col("l_discount") * 100).cast("int")) * 10, 1).alias("extraction_score"))
    return rp.needs_attention(views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")), s)


_NAMED = ("revenue", "net_income", "total_assets", "total_equity")
_LAGS = ", ".join(f"{n}, lag({n}) OVER (PARTITION BY company_id ORDER BY fiscal_year, CASE WHEN period LIKE 'FY%' THEN 1 ELSE 0 END, period) AS lag_{n}" for n in _NAMED)
_NAMED_ROWS = " UNION ALL ".join(
    f"SELECT company_id, period, '{n}' AS line, {n} AS current, lag_{n} AS prior, round_even({pct(n, 'lag_' + n)}, 4) AS change_pct FROM w2 WHERE {n} IS NOT NULL AND lag_{n} IS NOT NULL" for n in _NAMED)


@query("period_report", fin_sql(f"WITH w2 AS (SELECT company_id, period, {_LAGS} FROM rated) {_NAMED_ROWS}", "normalised"))
def period_report(spark, sf_dir):
    p = fin.with_prior(flat(spark, sf_dir), ["revenue", "net_income", "total_assets", "total_equity"], "normalised", 1)
    return rp.period_report(p).select("company_id", "period", F.explode("yoy").alias("x")).select("company_id", "period", "x.line", "x.current", "x.prior", F.bround("x.change_pct", 4).alias("change_pct"))


@query("company_dossiers", views.oracle("""SELECT company_id, fiscal_year, 'readings' AS section, count(*) AS records FROM reading GROUP BY 1, 2 UNION ALL SELECT company_id, period_label, 'documents', count(*) FROM doc_meta GROUP BY 1, 2
 UNION ALL SELECT company_id, fiscal_year, 'survey', 1 FROM survey"""))
def company_dossiers(spark, sf_dir):
    r = views.view(spark, sf_dir, "reading").select("company_id", "fiscal_year", "field", "value", "reader", "reading_id")
    d = views.view(spark, sf_dir, "doc_meta").select("company_id", F.col("period_label").alias("fiscal_year"), "id", "filename")
    s = views.survey(spark, sf_dir).select("company_id", "fiscal_year", "turnover", "board_size")
    return rp.company_dossier({"survey": s, "readings": r, "documents": d}).groupBy("company_id", "fiscal_year", "section").agg(F.count("record").alias("records"))


@query("flattened_records", crow_sql("""SELECT company_id, fiscal_year, 'governance / score' AS path, CAST(CAST(governance_score AS DOUBLE) AS VARCHAR) AS value FROM crow
 UNION ALL SELECT company_id, fiscal_year, 'sector', sector FROM crow"""))
def flattened_records(spark, sf_dir):
    r = rows(spark, sf_dir).select("company_id", "fiscal_year", F.struct("sector", F.struct("governance.score").alias("governance")).alias("record"))
    return rp.flatten_record(r, ["company_id", "fiscal_year"], "record")


@query("open_tables", views.oracle("""WITH cy AS (SELECT company_id, fiscal_year FROM survey), g AS (SELECT DISTINCT company_id, 'FY' || y::VARCHAR AS fiscal_year FROM register), p AS (SELECT DISTINCT company_id, 'FY' || y::VARCHAR AS fiscal_year FROM pay_row),
 c AS (SELECT company_id, fiscal_year, count(*) AS n FROM reading WHERE reader = 'human' GROUP BY 1, 2)
 SELECT cy.company_id, cy.fiscal_year, array_to_string(list_filter([CASE WHEN g.company_id IS NULL THEN 'register' END, CASE WHEN p.company_id IS NULL THEN 'pay_rows' END], lambda x: x IS NOT NULL), ',') AS empty_tables, coalesce(c.n, 0) AS open_conflicts
 FROM cy LEFT JOIN g USING (company_id, fiscal_year) LEFT JOIN p USING (company_id, fiscal_year) LEFT JOIN c USING (company_id, fiscal_year)"""))
def open_tables(spark, sf_dir):
    fy = F.concat(F.lit("FY"), F.col("y").cast("string")).alias("fiscal_year")
    g = views.view(spark, sf_dir, "register").select("company_id", fy)
    p = views.view(spark, sf_dir, "pay_row").select("company_id", fy)
    c = views.view(spark, sf_dir, "reading").where("reader = 'human'")
    return rp.tables_open(views.survey(spark, sf_dir), {"register": g, "pay_rows": p}, c).withColumn("empty_tables", F.array_join("empty_tables", ","))


_OWN = ["audit_fee", "employees_count", "free_float_pct", "kmp_total", "earnings_per_share"]


@query("company_lines", crow_sql(f"""WITH e AS (SELECT fiscal_year, company_id, {", ".join(_OWN)} FROM crow), le AS (UNPIVOT e ON {", ".join(_OWN)} INTO NAME metric VALUE value),
 m AS (SELECT fiscal_year, metric, count(*) AS n, quantile_cont(value, 0.5) AS med FROM le GROUP BY ALL)
 SELECT company_id, le.fiscal_year, le.metric, round_even(value, 2) AS value, CASE WHEN n >= 2 THEN round_even(med, 2) END AS market_median,
  CASE WHEN n >= 2 THEN CAST(rank() OVER (PARTITION BY le.fiscal_year, le.metric ORDER BY value DESC) AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) ELSE '' END AS place FROM le JOIN m ON m.fiscal_year = le.fiscal_year AND m.metric = le.metric"""))
def company_lines(spark, sf_dir):
    """Each company's own figure with the market median and its place."""
    long = sv.unpivot(rows(spark, sf_dir), ["fiscal_year", "company_id"], _OWN)
    placed = stats.competition_rank(long, ["fiscal_year", "metric"], "value")
    med = stats.percentiles(long, ["fiscal_year", "metric"], "value", (0.5,), ["market_median"]).drop("n")
    enough = F.col("n") >= 2
    return placed.join(med, ["fiscal_year", "metric"]).select(
        "company_id", "fiscal_year", "metric", F.bround("value", 2).alias("value"), "market_median",
        F.when(enough, F.concat(F.col("rank").cast("string"), F.lit(" of "), F.col("n").cast("string"))).otherwise("").alias("place"))


@query("comparable_metric_names", crow_sql("""SELECT company_id, fiscal_year, 'turnover (' || currency || ')' AS metric, round_even(turnover, 2) AS value FROM crow WHERE turnover IS NOT NULL
 UNION ALL SELECT company_id, fiscal_year, 'board_size', board_size FROM crow WHERE board_size IS NOT NULL"""))
def comparable_metric_names(spark, sf_dir):
    long = rows(spark, sf_dir).unpivot(["company_id", "fiscal_year", "currency"], ["turnover", "board_size"], "metric", "value").where("value IS NOT NULL")
    money = F.col("metric") == "turnover"
    return long.select("company_id", "fiscal_year", F.when(money, F.concat("metric", F.lit(" ("), "currency", F.lit(")"))).otherwise(F.col("metric")).alias("metric"),
                       F.when(money, F.bround("value", 2)).otherwise(F.col("value")).alias("value"))


@query("collapsed_year_blocks", views.oracle("""WITH i AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(2020 + l_linenumber % 3 AS INT) END AS block, CASE l_returnflag WHEN 'A' THEN 'Profit for 2024' WHEN 'N' THEN 'Profit for' ELSE 'Dividends' END AS label,
  l_quantity AS amount, l_partkey AS o FROM lineitem), y AS (SELECT k, list_sort(list_distinct(list(block) FILTER (WHERE block IS NOT NULL))) AS ys FROM i GROUP BY k),
 j AS (SELECT i.*, trim(regexp_replace(lower(label), '[^a-z]+', ' ', 'g')) AS lk, ys[-1] AS l, CASE WHEN len(ys) >= 2 THEN ys[-2] END AS e FROM i LEFT JOIN y USING (k)),
 p AS (SELECT k, lk, arg_min(amount, (o, amount)) AS prior_amount FROM j WHERE block = e GROUP BY 1, 2)
 SELECT k, label, block, amount, CASE WHEN block = l THEN prior_amount END AS prior_amount, o AS order_index FROM j LEFT JOIN p USING (k, lk) WHERE e IS NULL OR block IS NULL OR block = l"""))
def collapsed_year_blocks(spark, sf_dir):
    from ..operators import readers as rd
    n = F.col("l_linenumber")
    i = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.when(n != 7, 2020 + n % 3).cast("int").alias("block"),
        F.when(F.col("l_returnflag") == "A", "Profit for 2024").when(F.col("l_returnflag") == "N", "Profit for").otherwise("Dividends").alias("label"),
        F.col("l_quantity").alias("amount"), F.col("l_partkey").alias("order_index"))
    return rd.collapse_year_blocks(i, ["k"])


@query("missing_field_parity", views.oracle(f"""WITH {status_cte(fl.PORTFOLIO_QUALITY_FIELDS)}, a AS (SELECT company_id, field FROM fs WHERE fiscal_year = 'FY2024' AND status = 'missing'), b AS (SELECT company_id, field FROM fs WHERE fiscal_year = 'FY2023' AND status = 'missing')
 (SELECT *, 'only_now' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL (SELECT *, 'only_before' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))"""))
def missing_field_parity(spark, sf_dir):
    """Fields missing in one year but not the other, both ways."""
    st = qu.field_status(quality_survey(spark, sf_dir), fl.PORTFOLIO_QUALITY_FIELDS).where("status = 'missing'")
    a = st.where("fiscal_year = 'FY2024'").select("company_id", "field")
    b = st.where("fiscal_year = 'FY2023'").select("company_id", "field")
    return a.subtract(b).withColumn("side", F.lit("only_now")).unionByName(b.subtract(a).withColumn("side", F.lit("only_before")))


@query("common_companies", views.oracle("SELECT company_id FROM survey WHERE fiscal_year = 'FY2023' INTERSECT SELECT company_id FROM survey WHERE fiscal_year = 'FY2025'"))
def common_companies(spark, sf_dir):
    s = views.survey(spark, sf_dir)
    return s.where("fiscal_year = 'FY2023'").select("company_id").intersect(s.where("fiscal_year = 'FY2025'").select("company_id"))


@query("field_trace", views.oracle("""SELECT company_id, fiscal_year, field, value, source, 'value' AS status FROM reading WHERE value IS NOT NULL UNION ALL SELECT company_id, fiscal_year, field, NULL, NULL, 'gap' FROM reading WHERE value IS NULL"""))
def field_trace(spark, sf_dir):
    r = views.view(spark, sf_dir, "reading")
    have = r.where("value IS NOT NULL").select("company_id", "fiscal_year", "field", "value", "source", F.lit("value").alias("status"))
    return have.unionByName(r.where("value IS NULL").select("company_id", "fiscal_year", "field", F.lit("gap").alias("status")), allowMissingColumns=True)


@query("open_conflicts_first", views.oracle("""SELECT reading_id, field, resolved FROM (SELECT reading_id, field, reading_id % 3 = 0 AS resolved FROM reading WHERE value IS NOT NULL) ORDER BY resolved, reading_id DESC"""))
def open_conflicts_first(spark, sf_dir):
    r = views.view(spark, sf_dir, "reading").where("value IS NOT NULL").select("reading_id", "field", (F.col("reading_id") % 3 == 0).alias("resolved"))
    return r.orderBy("resolved", F.col("reading_id").desc())


@query("copied_years", views.oracle("""WITH s AS (SELECT company_id, 'report-' || CAST(year_no // 3 AS VARCHAR) AS f, fiscal_year, board_size, committees_per_board, board_meetings_per_year, directors_female, executive_directors_count, ceo_monthly_salary FROM survey),
 l AS (UNPIVOT s ON board_size, committees_per_board, board_meetings_per_year, directors_female, executive_directors_count, ceo_monthly_salary INTO NAME field VALUE value),
 g AS (SELECT a.company_id, a.f AS file, a.fiscal_year AS earlier_year, b.fiscal_year AS later_year, count(*) AS same_values, count(*) FILTER (WHERE a.field LIKE 'ceo_%') AS same_pay
  FROM l a JOIN l b ON a.company_id = b.company_id AND a.f = b.f AND a.field = b.field AND a.value = b.value AND a.fiscal_year < b.fiscal_year GROUP BY ALL)
 SELECT *, CASE WHEN same_pay > 0 THEN 'error' ELSE 'warning' END AS severity FROM g WHERE same_values >= 2"""))
def copied_years(spark, sf_dir):
    s = views.survey(spark, sf_dir).withColumn("source_filename", F.concat(F.lit("REPORT-"), F.floor(F.col("year_no") / 3).cast("string")))
    return qu.copied_years(s, ["board_size", "committees_per_board", "board_meetings_per_year", "directors_female", "executive_directors_count", "ceo_monthly_salary"], 2)


@query("company_snapshots", fin_sql(f"""WITH x AS (SELECT *, {pct('revenue', 'prior_revenue')} AS ry, {pct('net_income', 'prior_net_income')} AS ny, net_margin - prior_net_margin AS md, roe - prior_roe AS rd FROM win WHERE recency = 1),
 g AS (SELECT company_id, count(*) AS years_on_record FROM financials WHERE revenue IS NOT NULL GROUP BY 1)
 SELECT x.company_id, c.name, period, round_even(ry, 4) AS revenue_yoy, financial_score,
  CASE WHEN debt_equity IS NULL AND md IS NULL THEN NULL ELSE round_even((coalesce(0.35::DOUBLE * greatest(0, least(100, debt_equity / 4 * 100)) * CASE WHEN debt_equity IS NULL THEN NULL ELSE 1 END, 0)
   + coalesce(0.15::DOUBLE * greatest(0, least(100, -md * 10)) * CASE WHEN md IS NULL THEN NULL ELSE 1 END, 0)) / (CASE WHEN debt_equity IS NOT NULL THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN md IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END), 0) END AS risk_score,
  CASE WHEN (coalesce(ry > 0, FALSE)::INT + coalesce(ny > 0, FALSE)::INT + coalesce(rd > 0, FALSE)::INT + coalesce(md > 0, FALSE)::INT) >= 3 THEN 'Positive'
   WHEN (coalesce(ry < 0, FALSE)::INT + coalesce(ny < 0, FALSE)::INT + coalesce(rd < 0, FALSE)::INT + coalesce(md < 0, FALSE)::INT) >= 3 THEN 'Negative' ELSE 'Neutral' END AS outlook,
  years_on_record, CASE WHEN c.sector IS NOT NULL AND financial_score IS NOT NULL THEN rank() OVER (PARTITION BY c.sector, financial_score IS NULL ORDER BY financial_score DESC) END AS sector_rank
 FROM x JOIN fin_company c USING (company_id) LEFT JOIN g USING (company_id)""", "normalised"))
def company_snapshots(spark, sf_dir):
    s = fin.company_snapshot(views.view(spark, sf_dir, "fin_company"), flat(spark, sf_dir))
    return s.select("company_id", "name", "period", F.bround("revenue_yoy", 4).alias("revenue_yoy"), "financial_score", "risk_score", "outlook", "years_on_record", "sector_rank")
