"""Data-quality, audit, merge and repair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as fl
from ..functions import money
from ..operators import merge as mg
from ..operators import quality as qu
from ..operators import stats
from ..operators import survey as sv
from . import views
from .benchmark import norm_sql
from .finance import company as fin_company
from .finance import flat
from .registry import query


def survey(spark, sf_dir):
    """Survey rows with the confidence map and an array of reviewed fields."""
    s = views.survey(spark, sf_dir, maps=True)
    reviewed = F.filter(F.array(*[F.lit(f) for f in fl.KIND]), lambda f: (F.col("n_units") + F.length(f)) % 3 == 0)
    return s.withColumn("reviewed", reviewed)


def company(spark, sf_dir):
    return views.view(spark, sf_dir, "company")


def _conf(f):
    return views.CONFIDENCE_RULE.format(f=f)


def _status(f):
    return (f"CASE WHEN {f} IS NULL OR trim(CAST({f} AS VARCHAR)) = '' THEN 'missing' WHEN ({_conf(f)}) < 0.75 THEN 'needs_review' ELSE 'complete' END AS {f}")


def status_cte(fields, name="fs"):
    return (f"{name} AS (SELECT company_id, fiscal_year, field, status FROM (UNPIVOT (SELECT company_id, fiscal_year, {', '.join(_status(f) for f in fields)} FROM survey) "
            f"ON {', '.join(fields)} INTO NAME field VALUE status))")


_SECTION = "CASE field " + " ".join(f"WHEN '{f}' THEN '{s}'" for f, s in fl.SECTION.items()) + " END"
_CONF_LONG = ("cf AS (UNPIVOT (SELECT company_id, fiscal_year, n_units, " + ", ".join(f"{_conf(f)} AS {f}" for f in fl.KIND) + " FROM survey) ON "
              + ", ".join(fl.KIND) + " INTO NAME field VALUE confidence)")
_QUALITY = f"""{status_cte(fl.CORE_FIELDS)}, q AS (SELECT company_id, fiscal_year, count(*) FILTER (WHERE status = 'complete') AS complete,
 count(*) FILTER (WHERE status = 'needs_review') AS needs_review, count(*) FILTER (WHERE status = 'missing') AS missing,
 CAST(round_even((count(*) FILTER (WHERE status = 'complete'))::DOUBLE / {len(fl.CORE_FIELDS)} * 100, 0) AS INT) AS score FROM fs GROUP BY ALL)"""


@query("field_status", views.oracle(f"WITH {status_cte(fl.CORE_FIELDS)} SELECT company_id, fiscal_year, field, {_SECTION} AS section, status FROM fs"))
def field_status(spark, sf_dir):
    return qu.field_status(survey(spark, sf_dir), fl.CORE_FIELDS)


@query("company_quality", views.oracle(f"""WITH {_QUALITY} SELECT company_id, fiscal_year, complete, needs_review, missing, {len(fl.CORE_FIELDS)} AS total, score,
 CASE WHEN score >= 75 THEN 'Good' WHEN score >= 50 THEN 'Fair' ELSE 'Needs Attention' END AS grade FROM q"""))
def company_quality(spark, sf_dir):
    return qu.company_quality(survey(spark, sf_dir))


@query("section_quality", views.oracle(f"""WITH {status_cte(fl.CORE_FIELDS)} SELECT company_id, fiscal_year, {_SECTION} AS section, count(*) FILTER (WHERE status = 'complete') AS complete,
 count(*) FILTER (WHERE status = 'needs_review') AS needs_review, count(*) FILTER (WHERE status = 'missing') AS missing,
 round_even(100.0 * (count(*) FILTER (WHERE status = 'complete'))::DOUBLE / count(*), 0) AS score FROM fs GROUP BY ALL"""))
def section_quality(spark, sf_dir):
    return qu.section_quality(survey(spark, sf_dir))


@query("portfolio_quality", views.oracle(f"""WITH {_QUALITY} SELECT fiscal_year, count(*) AS companies_counted, round_even(avg(score), 0) AS average_score,
 round_even(sum(complete)::DOUBLE * 100.0 / (count(*) * {len(fl.CORE_FIELDS)}), 0) AS pooled_score, sum(complete)::BIGINT AS complete, sum(needs_review)::BIGINT AS needs_review,
 sum(missing)::BIGINT AS missing, arg_max(company_id, (score, -company_id)) AS best_company, arg_min(company_id, (score, -company_id)) AS lowest_company FROM q GROUP BY fiscal_year"""))
def portfolio_quality(spark, sf_dir):
    return qu.portfolio_quality(survey(spark, sf_dir))


@query("portfolio_quality_counts", views.oracle(f"""WITH {status_cte(fl.PORTFOLIO_QUALITY_FIELDS)}, la AS (SELECT company_id, max(fiscal_year) AS fiscal_year FROM survey GROUP BY 1)
 SELECT count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'needs_review') AS needs_review, count(*) FILTER (WHERE status = 'missing') AS missing,
 count(DISTINCT company_id) AS companies_counted FROM fs JOIN la USING (company_id, fiscal_year)"""))
def portfolio_quality_counts(spark, sf_dir):
    return qu.portfolio_counts(survey(spark, sf_dir))


@query("not_on_file", views.oracle("SELECT company_id, name FROM company WHERE company_id NOT IN (SELECT company_id FROM survey WHERE fiscal_year = 'FY2025')"))
def not_on_file(spark, sf_dir):
    return qu.not_on_file(company(spark, sf_dir), views.survey(spark, sf_dir), "FY2025")


@query("missing_ranking", views.oracle(f"""WITH {_QUALITY}, la AS (SELECT company_id, max(fiscal_year) AS fiscal_year FROM survey GROUP BY 1)
 SELECT company_id, name, fiscal_year, missing, score, has_data, row_number() OVER (ORDER BY missing, -score, lower(name), company_id) AS rank FROM (
 SELECT c.company_id, c.name, q.fiscal_year, coalesce(q.missing, {len(fl.CORE_FIELDS)}) AS missing, coalesce(q.score, 0) AS score, q.fiscal_year IS NOT NULL AS has_data
 FROM company c LEFT JOIN (q JOIN la USING (company_id, fiscal_year)) q USING (company_id))"""))
def missing_ranking(spark, sf_dir):
    return qu.missing_ranking(company(spark, sf_dir), survey(spark, sf_dir))


@query("review_buckets", views.oracle(f"""WITH {_CONF_LONG} SELECT company_id, fiscal_year,
 array_to_string(coalesce(list(field ORDER BY field) FILTER (WHERE confidence >= 0.75), []), ',') AS high,
 array_to_string(coalesce(list(field ORDER BY field) FILTER (WHERE confidence >= 0.45 AND confidence < 0.75), []), ',') AS review,
 array_to_string(coalesce(list(field ORDER BY field) FILTER (WHERE (n_units + length(field)) % 3 <> 0), []), ',') AS pending FROM cf GROUP BY ALL"""))
def review_buckets(spark, sf_dir):
    b = qu.review_buckets(survey(spark, sf_dir))
    return b.select("company_id", "fiscal_year", *[F.array_join(c, ",").alias(c) for c in ("high", "review", "pending")])


@query("review_progress", views.oracle(f"""WITH {_CONF_LONG}, g AS (SELECT company_id, fiscal_year, CAST(round_even(100.0 * (count(*) FILTER (WHERE (n_units + length(field)) % 3 = 0))::DOUBLE / count(*), 0) AS INT) AS progress_pct FROM cf GROUP BY ALL)
 SELECT *, CASE WHEN progress_pct = 100 THEN 'completed' WHEN progress_pct > 0 THEN 'in-progress' ELSE 'pending' END AS review_status FROM g"""))
def review_progress(spark, sf_dir):
    return qu.review_progress(survey(spark, sf_dir))


@query("tab_status", views.oracle(f"""WITH {status_cte(list(fl.KIND))} SELECT company_id, fiscal_year, {_SECTION} AS section, count(*) FILTER (WHERE status <> 'missing') AS filled, count(*) AS total FROM fs GROUP BY ALL"""))
def tab_status(spark, sf_dir):
    return qu.tab_status(survey(spark, sf_dir))


_METRIC_COUNT = [f for f in fl.KIND]


@query("report_completeness", views.oracle(f"""WITH la AS (SELECT company_id, max(fiscal_year) AS fiscal_year FROM survey GROUP BY 1),
 s AS (SELECT company_id, 40 + least(9, floor(({' + '.join(f'({f} IS NOT NULL)::INT' for f in _METRIC_COUNT)}) / 4)) AS s FROM survey JOIN la USING (company_id, fiscal_year)),
 p AS (SELECT DISTINCT company_id FROM pay_row), c AS (SELECT DISTINCT company_id FROM register)
 SELECT c0.company_id, CAST(coalesce(s.s, 0) + CASE WHEN p.company_id IS NOT NULL THEN 40 ELSE 0 END + CASE WHEN c.company_id IS NOT NULL THEN 20 ELSE 0 END AS INT) AS completeness
 FROM company c0 LEFT JOIN s USING (company_id) LEFT JOIN p USING (company_id) LEFT JOIN c USING (company_id)"""))
def report_completeness(spark, sf_dir):
    pay = views.view(spark, sf_dir, "pay_row")
    com = views.view(spark, sf_dir, "register")
    return qu.completeness(company(spark, sf_dir), views.survey(spark, sf_dir), pay, com, _METRIC_COUNT)


def _issue(cond, rule, field, sev, amount):
    return f"SELECT company_id, fiscal_year, '{rule}' AS rule, '{field}' AS field, '{sev}' AS severity, CAST({amount} AS DOUBLE) AS amount FROM survey WHERE {cond}"


def _issues_sql() -> str:
    out = [_issue(f"abs({a} + {b} - {t}) > 0.5", f"sum:{a}", t, "error", f"{a} + {b}") for (a, b), t in qu.SUM_RULES]
    out += [_issue(f"{f} NOT BETWEEN {lo} AND {hi}", "range", f, sev, f) for f, lo, hi, sev in qu.RANGES]
    out += [_issue(f"{f} NOT BETWEEN 25 AND 95", "age", f, "error", f) for f in qu.AGES]
    out.append(_issue("ceo_monthly_salary <> 0 AND ceo_annual_salary_as_stated <> 0 AND abs(ceo_annual_salary_as_stated / 12 - ceo_monthly_salary) > greatest(1.0, 0.02 * ceo_monthly_salary)",
                      "annual_vs_monthly", "ceo_monthly_salary", "error", "ceo_annual_salary_as_stated / 12"))
    parts = " + ".join(f"coalesce({f}, 0)" for f in qu.CEO_PARTS)
    out.append(_issue(f"ceo_monthly_cost_of_employment <> 0 AND ({parts}) > ceo_monthly_cost_of_employment * 1.02", "ceo_parts", "ceo_monthly_cost_of_employment", "error", parts))
    out += [_issue(f"{a} < {b}", "chair_below_member", a, "warning", a) for a, b in qu.CHAIR_PAIRS]
    out.append(_issue("turnover <> 0 AND net_profit <> 0 AND abs(net_profit) > abs(turnover)", "profit_over_turnover", "net_profit", "warning", "net_profit"))
    unit = "CASE lower(coalesce(nullif(unit, ''), 'millions')) " + " ".join(f"WHEN '{u}' THEN {s}" for u, s in money.HEADLINE_SCALE.items()) + " END"
    out += [_issue(f"coalesce(nullif(currency, ''), 'KES') = 'KES' AND abs({f}) * ({unit}) / 1000000 > {c}", "above_ceiling", f, "error", f) for f, c in money.CEILING_MILLIONS.items()]
    return " UNION ALL ".join(out)


@query("consistency_issues", views.oracle(_issues_sql()))
def consistency_issues(spark, sf_dir):
    return qu.consistency_issues(views.survey(spark, sf_dir))


@query("issue_ranking", views.oracle(f"""WITH {status_cte(fl.CORE_FIELDS)}, iss AS ({_issues_sql()}), i AS (SELECT company_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) AS issues FROM iss GROUP BY 1)
 SELECT company_id, count(*) FILTER (WHERE status = 'missing') AS missing, coalesce(any_value(errors), 0) AS errors, coalesce(any_value(issues), 0) AS issues FROM fs LEFT JOIN i USING (company_id) GROUP BY 1
 ORDER BY errors DESC, issues DESC, missing DESC, company_id"""))
def issue_ranking(spark, sf_dir):
    s = survey(spark, sf_dir)
    return qu.issue_ranking(qu.consistency_issues(s), qu.field_status(s, fl.CORE_FIELDS))


_REPEAT = ["turnover", "net_profit", "market_cap", *[f for f, _ in fl.CEO if f.startswith("ceo_monthly")], "board_size"]


@query("repeated_figures", views.oracle(f"""WITH l AS (UNPIVOT (SELECT company_id, fiscal_year, {', '.join(_REPEAT)} FROM survey) ON {', '.join(_REPEAT)} INTO NAME field VALUE value),
 p AS (SELECT a.company_id, a.fiscal_year AS earlier_year, b.fiscal_year AS later_year, count(*) AS same_values, count(*) FILTER (WHERE a.field IN ('turnover', 'net_profit', 'market_cap')) AS same_headline
  FROM l a JOIN l b ON a.company_id = b.company_id AND a.field = b.field AND a.value = b.value AND a.fiscal_year < b.fiscal_year WHERE a.value <> 0 GROUP BY ALL)
 SELECT *, CASE WHEN same_headline > 0 THEN 'error' ELSE 'warning' END AS severity FROM p WHERE same_headline > 0 OR same_values >= 2"""))
def repeated_figures(spark, sf_dir):
    return qu.repeated_figures(views.survey(spark, sf_dir), _REPEAT)


_AUDIT = """SELECT p.company_id, p.y, p.person_no, p.order_index, p.amount * 100000 AS total, CASE p.order_index % 4 WHEN 0 THEN 'thousands' WHEN 1 THEN 'lakhs' WHEN 2 THEN NULL ELSE 'units' END AS unit,
 s.turnover AS turnover_full, s.ceo_monthly_cost_of_employment * 12 AS ceo_annual FROM pay_row p JOIN survey s ON s.company_id = p.company_id AND s.fiscal_year = 'FY' || CAST(p.y AS VARCHAR)"""


@query("pay_audit_flags", views.oracle(f"""WITH a AS ({_AUDIT}), b AS (SELECT *, total::DOUBLE * CASE unit WHEN 'thousands' THEN 1000 ELSE 1 END AS amount FROM a),
 c AS (SELECT company_id, y, person_no, order_index, amount, array_to_string(list_filter([CASE WHEN turnover_full > 0 AND abs(amount) > turnover_full THEN 'pay_exceeds_turnover' END,
  CASE WHEN ceo_annual > 0 AND abs(amount) > ceo_annual * 100 THEN 'pay_over_100x_ceo_cost' END, CASE WHEN coalesce(unit, '') = '' THEN 'missing_unit' END,
  CASE WHEN unit = 'lakhs' THEN 'unknown_unit' END], lambda x: x IS NOT NULL), ',') AS flags FROM b)
 SELECT * FROM c WHERE flags <> ''"""))
def pay_audit_flags(spark, sf_dir):
    p = views.view(spark, sf_dir, "pay_row").select(
        "company_id", "y", "person_no", "order_index", (F.col("amount") * 100000).alias("total"),
        F.when(F.col("order_index") % 4 == 0, "thousands").when(F.col("order_index") % 4 == 1, "lakhs").when(F.col("order_index") % 4 == 3, "units").alias("unit"))
    s = views.survey(spark, sf_dir).select("company_id", "fiscal_year", F.col("turnover").alias("turnover_full"),
                                           (F.col("ceo_monthly_cost_of_employment") * 12).alias("ceo_annual"))
    joined = p.withColumn("fiscal_year", F.concat(F.lit("FY"), F.col("y").cast("string"))).join(s, ["company_id", "fiscal_year"])
    return qu.pay_audit_flags(joined).select("company_id", "y", "person_no", "order_index", "amount", F.array_join("flags", ",").alias("flags"))


@query("pay_table_reconciliation", views.oracle("""WITH g AS (SELECT period_id, table_kind, count(*) FILTER (WHERE order_index <> 7) AS named_rows, sum(amount) FILTER (WHERE order_index <> 7) AS s,
  max(amount) FILTER (WHERE order_index = 7) AS t FROM pay_row GROUP BY ALL), h AS (SELECT *, CASE WHEN named_rows > 0 AND t IS NOT NULL THEN s - t END AS d FROM g)
 SELECT period_id, table_kind, named_rows, CAST(d AS DOUBLE) AS difference, abs(d) <= (named_rows + 1) / 2.0 AS within_rounding,
  CAST(CASE WHEN abs(d) <= (named_rows + 1) / 2.0 THEN 0.9 WHEN t IS NOT NULL THEN 0.75 ELSE 0.6 END AS DOUBLE) AS confidence FROM h"""))
def pay_table_reconciliation(spark, sf_dir):
    rows = views.view(spark, sf_dir, "pay_row").withColumn("is_total", F.col("order_index") == 7)
    return qu.reconcile(rows, ["period_id", "table_kind"])


@query("board_composition", views.oracle("""WITH r AS (SELECT *, role IN ('executive', 'non_executive') AS rk, role = 'non_executive' AS ned, role = 'executive' AS ex FROM register),
 g AS (SELECT company_id, y, count(*) AS n, bool_and(rk) AS roles, bool_and(CASE WHEN ned THEN independent IS NOT NULL ELSE TRUE END) AS ik, bool_and(CASE WHEN ned THEN coalesce(trim(nationality), '') <> '' ELSE TRUE END) AS nk,
  bool_and(coalesce(trim(gender), '') <> '') AS gk, count(*) FILTER (WHERE ex) AS nx, count(*) FILTER (WHERE ned) AS nn, count(*) FILTER (WHERE ned AND independent) AS ni,
  count(*) FILTER (WHERE ned AND lower(trim(nationality)) IN ('kenyan', 'kenya')) AS nke, count(*) FILTER (WHERE gender = 'Female') AS nf,
  count(age) FILTER (WHERE ex) AS ax, avg(age) FILTER (WHERE ex) AS vx, count(age) FILTER (WHERE ned) AS an, avg(age) FILTER (WHERE ned) AS vn FROM r GROUP BY ALL)
 SELECT company_id, y, n AS board_size, CASE WHEN roles THEN nx END AS executive_directors_count, CASE WHEN roles THEN nn END AS non_executive_directors_count,
  CASE WHEN roles AND ik THEN ni END AS independent_neds_count, CASE WHEN roles AND ik THEN nn - ni END AS non_independent_neds_count,
  CASE WHEN roles AND nk AND nn > 0 THEN nke END AS neds_kenyan_count, CASE WHEN roles AND nk AND nn > 0 THEN nn - nke END AS neds_non_kenyan_count,
  CASE WHEN gk THEN nf END AS directors_female, CASE WHEN gk THEN n - nf END AS directors_male,
  CASE WHEN roles AND nx > 0 AND ax = nx THEN round_even(vx, 1) END AS avg_age_executive_directors, CASE WHEN roles AND nn > 0 AND an = nn THEN round_even(vn, 1) END AS avg_age_non_executive_directors FROM g"""))
def board_composition(spark, sf_dir):
    return qu.derive_composition(views.view(spark, sf_dir, "register"), ["company_id", "y"])


@query("committee_summary", views.oracle("""WITH c AS (SELECT period_id, CASE WHEN order_index % 3 = 0 THEN NULL ELSE amount % 9 END AS meetings_held, CASE WHEN fees % 4 = 0 THEN NULL ELSE amount END AS attended, amount + fees % 5 AS eligible FROM pay_row)
 SELECT period_id, count(*) AS committees, round_even(avg(meetings_held), 1) AS mean_meetings,
 round_even(sum(attended)::DOUBLE * 100.0 / nullif(sum(eligible) FILTER (WHERE attended IS NOT NULL), 0), 1) AS attendance_rate FROM c GROUP BY 1"""))
def committee_summary(spark, sf_dir):
    c = views.view(spark, sf_dir, "pay_row").select(
        "period_id", F.when(F.col("order_index") % 3 != 0, F.col("amount") % 9).alias("meetings_held"),
        F.when(F.col("fees") % 4 != 0, F.col("amount")).alias("attended"), (F.col("amount") + F.col("fees") % 5).alias("eligible"))
    return qu.committee_summary(c, ["period_id"])


@query("typical_fees", views.oracle("""WITH c AS (SELECT company_id, table_kind, amount, count(*) AS k FROM pay_row GROUP BY ALL), m AS (SELECT company_id, table_kind, arg_max(amount, (k, amount)) AS mode, max(k) AS times FROM c GROUP BY ALL),
 d AS (SELECT company_id, table_kind, quantile_cont(amount, 0.5) AS med, count(*) AS values FROM pay_row GROUP BY ALL)
 SELECT company_id, table_kind, CAST(CASE WHEN times > 1 THEN mode ELSE med END AS DOUBLE) AS typical, values FROM m JOIN d USING (company_id, table_kind)"""))
def typical_fees(spark, sf_dir):
    pay = views.view(spark, sf_dir, "pay_row").withColumn("amount", F.col("amount").cast("double"))
    return stats.mode_or_median(pay, ["company_id", "table_kind"], "amount")


def _components():
    return F.create_map(F.lit("Sitting allowance"), F.col("amount").cast("double"), F.lit("Director fees"), (F.col("fees") % 3).cast("double"),
                        F.lit("Annual retainer"), (F.col("fees") % 5).cast("double"), F.lit("Pension benefits"), F.col("pension").cast("double"))


@query("fixed_fees", views.oracle("""SELECT period_id, person_no, order_index, CAST(CASE WHEN fees % 3 > 0 THEN fees % 3 WHEN fees % 5 > 0 THEN fees % 5 END AS DOUBLE) AS fixed_fee,
 'Pension benefits,Sitting allowance' AS benefit_keys FROM pay_row"""))
def fixed_fees(spark, sf_dir):
    return views.view(spark, sf_dir, "pay_row").withColumn("components", _components()).select(
        "period_id", "person_no", "order_index", qu.fixed_fee("components").alias("fixed_fee"),
        F.array_join(F.array_sort(F.map_keys(qu.benefit_components("components"))), ",").alias("benefit_keys"))


@query("cleaned_pay_rows", views.oracle("""WITH r AS (SELECT *, CASE order_index WHEN 7 THEN 'Total' WHEN 6 THEN '2023' ELSE director_name END AS nm FROM pay_row)
 SELECT period_id, person_no, order_index, nm AS director_name, CASE WHEN amount % 4 = 0 THEN NULL WHEN amount % 4 = 1 THEN CAST(-amount AS DOUBLE) ELSE CAST(amount AS DOUBLE) END AS total, order_index = 7 AS is_grand_total
 FROM r WHERE order_index <> 6 AND (order_index = 7 OR amount % 4 <> 0)"""))
def cleaned_pay_rows(spark, sf_dir):
    r = views.view(spark, sf_dir, "pay_row")
    name = F.when(F.col("order_index") == 7, "Total").when(F.col("order_index") == 6, "2023").otherwise(
        F.concat("director_name", F.when(F.col("mark") == "O", "***").otherwise("")))
    a = F.col("amount")
    this = F.when(a % 4 == 0, "-").when(a % 4 == 1, F.format_string("(%,d)", a)).otherwise(F.format_string("%,d", a))
    comps = F.create_map(F.concat(F.lit("Total Emoluments "), F.col("y").cast("string"), F.lit(" Shs")), this,
                         F.concat(F.lit("Total Emoluments "), (F.col("y") - 1).cast("string"), F.lit(" Shs")), F.format_string("%,d", a * 7))
    rows = r.select("period_id", "person_no", "order_index", name.alias("director_name"), comps.alias("components"),
                    F.lit(None).cast("string").alias("total"), F.col("y").alias("year"))
    return qu.clean_pay_rows(rows).select("period_id", "person_no", "order_index", "director_name", "total", "is_grand_total")


@query("prior_year_tables_dropped", views.oracle("""WITH r AS (SELECT period_id AS doc_id, order_index AS page, table_kind, person_no, y FROM pay_row),
 h AS (SELECT DISTINCT doc_id, page, y - (page + doc_id) % 2 AS hy FROM r WHERE (page + doc_id) % 5 <> 0),
 s AS (SELECT r.*, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.doc_id = r.doc_id AND h.page = r.page AND h.hy = r.y) THEN 'current'
   WHEN EXISTS (SELECT 1 FROM h WHERE h.doc_id = r.doc_id AND h.page = r.page) THEN 'prior' ELSE 'unknown' END AS st FROM r)
 SELECT doc_id, page, table_kind, person_no, y AS year FROM s WHERE st <> 'prior' OR doc_id NOT IN (SELECT doc_id FROM s WHERE st = 'current')"""))
def prior_year_tables_dropped(spark, sf_dir):
    r = views.view(spark, sf_dir, "pay_row").select(F.col("period_id").alias("doc_id"), F.col("order_index").alias("page"), "table_kind", "person_no", F.col("y").alias("year"))
    h = r.where((F.col("page") + F.col("doc_id")) % 5 != 0).select("doc_id", "page", (F.col("year") - ((F.col("page") + F.col("doc_id")) % 2)).cast("int").alias("heading_year"))
    return qu.drop_prior_year_tables(r, h)


_REASON = "CASE WHEN n_units % 5 = 0 THEN 'rejected' WHEN n_lines % 7 = 0 THEN 'no_trace' WHEN n_units % 100 < 30 THEN 'scanned' WHEN (n_units + length(field)) % 3 = 0 THEN 'not_in_text' ELSE 'topic_found' END"


def _gaps(spark, sf_dir):
    s = survey(spark, sf_dir)
    st = qu.field_status(s, fl.CORE_FIELDS, ("company_id", "fiscal_year", "n_units", "n_lines"))
    facts = st.withColumns({"rejected": F.col("n_units") % 5 == 0, "has_trace": F.col("n_lines") % 7 != 0, "text_pages_pct": F.col("n_units") % 100,
                            "topic_pages": (F.col("n_units") + F.length("field")) % 3})
    return qu.diagnose_missing(facts)


@query("missing_reasons", views.oracle(f"""WITH {status_cte(fl.CORE_FIELDS)} SELECT fs.company_id, fs.fiscal_year, field, {_REASON} AS reason_code FROM fs JOIN survey USING (company_id, fiscal_year) WHERE status = 'missing'"""))
def missing_reasons(spark, sf_dir):
    return _gaps(spark, sf_dir).where("status = 'missing'").select("company_id", "fiscal_year", "field", "reason_code")


@query("extraction_rollup", views.oracle(f"""WITH {status_cte(fl.CORE_FIELDS)}, a AS (SELECT field, status, {_REASON} AS reason_code FROM fs JOIN survey USING (company_id, fiscal_year)),
 w AS (SELECT field, arg_min(reason_code, (-k, reason_code)) AS top_reason FROM (SELECT field, reason_code, count(*) AS k FROM a WHERE status <> 'complete' GROUP BY ALL) GROUP BY field)
 SELECT field, count(*) FILTER (WHERE status = 'complete') AS filled, count(*) FILTER (WHERE status = 'needs_review') AS low_confidence, count(*) FILTER (WHERE status = 'missing') AS missing,
  any_value(top_reason) AS top_reason, round_even(100.0 * (count(*) FILTER (WHERE status <> 'complete'))::DOUBLE / count(*), 0) AS fail_pct FROM a LEFT JOIN w USING (field) GROUP BY field"""))
def extraction_rollup(spark, sf_dir):
    return qu.extraction_rollup(_gaps(spark, sf_dir))


@query("extraction_scores", views.oracle("""WITH u AS (SELECT period_id AS doc_id, pension / 10.0 AS c FROM pay_row UNION ALL SELECT l_orderkey, l_discount * 10 FROM lineitem)
 SELECT doc_id, round_even(greatest(0, least(1, avg(CAST(c AS DOUBLE)))) * 100, 1) AS extraction_score, count(*) AS rows FROM u GROUP BY 1"""))
def extraction_scores(spark, sf_dir):
    a = views.view(spark, sf_dir, "pay_row").select(F.col("period_id").alias("doc_id"), (F.col("pension") / 10.0).alias("confidence"))
    b = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_discount") * 10).alias("confidence"))
    return qu.extraction_score([a, b])


@query("source_stages", views.oracle("""SELECT CASE WHEN source = '' THEN 'Unknown' WHEN source LIKE 'from the document scan%' THEN 'Layout-independent reader' WHEN source LIKE 'from the board table%' THEN 'Board reader'
 WHEN source LIKE 'from AI%' THEN 'AI extraction' ELSE 'Manual entry form' END AS stage, count(*) AS readings FROM reading GROUP BY 1"""))
def source_stages(spark, sf_dir):
    return views.view(spark, sf_dir, "reading").groupBy(qu.source_stage("source").alias("stage")).agg(F.count(F.lit(1)).alias("readings"))


# ---------------------------------------------------------------- merges
_KEYS = ["company_id", "fiscal_year", "field"]
_WIN = """win AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY company_id, fiscal_year, field) AS readings, row_number() OVER (PARTITION BY company_id, fiscal_year, field ORDER BY
 CASE reader WHEN 'human' THEN 0 WHEN 'rules' THEN 1 WHEN 'auto' THEN 2 ELSE 3 END, coalesce(confidence, 0) DESC, reading_id) AS rn FROM reading WHERE value IS NOT NULL) WHERE rn = 1)"""


def readings(spark, sf_dir):
    return views.view(spark, sf_dir, "reading")


@query("precedence_merge", views.oracle(f"WITH {_WIN} SELECT company_id, fiscal_year, field, value, confidence, source, reader, reading_id, readings FROM win"))
def precedence_merge(spark, sf_dir):
    return mg.precedence_merge(readings(spark, sf_dir), _KEYS)


_LOG = """lg AS (SELECT r.company_id, r.fiscal_year, r.field, r.reading_id, r.reader, r.value, CASE WHEN r.reading_id = w.reading_id THEN 'written' WHEN w.reader = 'human' THEN 'kept_human' ELSE 'kept_existing' END AS decision,
 abs(w.value - r.value) > 0.005::DOUBLE * greatest(abs(w.value), 1e-9) AS disagrees, w.value AS wv FROM reading r JOIN win w USING (company_id, fiscal_year, field) WHERE r.value IS NOT NULL)"""


@query("decision_log", views.oracle(f"WITH {_WIN}, {_LOG} SELECT * EXCLUDE (wv) FROM lg"))
def decision_log(spark, sf_dir):
    r = readings(spark, sf_dir)
    return mg.decision_log(r, mg.precedence_merge(r, _KEYS), _KEYS)


@query("conflicts", views.oracle(f"""WITH {_WIN}, {_LOG} SELECT company_id, fiscal_year, field, value AS candidate_b_value, min(reading_id) AS candidate_b_id, any_value(wv) AS candidate_a_value
 FROM lg WHERE disagrees GROUP BY 1, 2, 3, 4"""))
def conflicts(spark, sf_dir):
    r = readings(spark, sf_dir)
    return mg.detect_conflicts(r, mg.precedence_merge(r, _KEYS), _KEYS)


_UP_T, _UP_U = "SELECT o_orderkey AS k, floor(o_totalprice) AS a, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS b FROM orders WHERE o_orderkey % 4 <> 1", \
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE floor(o_totalprice) + 1 END AS a, 'new' AS b FROM orders WHERE o_orderkey % 2 = 1"


def _upsert(spark, sf_dir, mode):
    o = views.table(spark, sf_dir, "orders")
    price = F.floor("o_totalprice").cast("double")
    t = o.where("o_orderkey % 4 <> 1").select(F.col("o_orderkey").alias("k"), price.alias("a"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("b"))
    u = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 != 0, price + 1).alias("a"), F.lit("new").alias("b"))
    return mg.upsert(t, u, ["k"], mode)


@query("upsert_replace", f"WITH t AS ({_UP_T}), u AS ({_UP_U}) SELECT k, CASE WHEN u.k IS NOT NULL THEN u.a ELSE t.a END AS a, CASE WHEN u.k IS NOT NULL THEN u.b ELSE t.b END AS b FROM t FULL JOIN u USING (k)")
def upsert_replace(spark, sf_dir):
    return _upsert(spark, sf_dir, "replace")


@query("upsert_keep_old_when_null", f"WITH t AS ({_UP_T}), u AS ({_UP_U}) SELECT k, coalesce(u.a, t.a) AS a, coalesce(u.b, t.b) AS b FROM t FULL JOIN u USING (k)")
def upsert_keep_old_when_null(spark, sf_dir):
    return _upsert(spark, sf_dir, "coalesce")


@query("upsert_fill_only", f"WITH t AS ({_UP_T}), u AS ({_UP_U}) SELECT k, coalesce(t.a, u.a) AS a, coalesce(t.b, u.b) AS b FROM t FULL JOIN u USING (k)")
def upsert_fill_only(spark, sf_dir):
    return _upsert(spark, sf_dir, "fill_only")


@query("children_replaced", """SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 3 = 0)
 UNION ALL SELECT l_orderkey, l_partkey, 0 FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 3 = 0""")
def children_replaced(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    new = li.where("l_returnflag = 'R' AND l_orderkey % 3 = 0").select("l_orderkey", "l_partkey", F.lit(0).alias("l_linenumber"))
    return mg.replace_children(li.select("l_orderkey", "l_partkey", "l_linenumber"), new, ["l_orderkey"])


_OLD = "o AS (SELECT * FROM (SELECT company_id, fiscal_year, field, max(value) AS value, bool_or(reader = 'human') AS reviewed FROM reading WHERE reading_id % 2 = 0 GROUP BY ALL))"
_NEW = "n AS (SELECT company_id, fiscal_year, field, min(value) AS nv FROM reading WHERE reading_id % 2 = 1 AND value IS NOT NULL GROUP BY ALL)"


@query("reupload_changes", views.oracle(f"""WITH {_OLD}, {_NEW} SELECT company_id, fiscal_year, field, CASE WHEN coalesce(reviewed, FALSE) THEN value ELSE nv END AS new_value,
 CASE WHEN coalesce(reviewed, FALSE) THEN 'kept_reviewed' WHEN nv IS NULL THEN 'cleared' WHEN value IS NULL THEN 'added' WHEN value = nv THEN 'unchanged' ELSE 'replaced' END AS action
 FROM o FULL JOIN n USING (company_id, fiscal_year, field)"""))
def reupload_changes(spark, sf_dir):
    r = readings(spark, sf_dir)
    old = r.where("reading_id % 2 = 0").groupBy(*_KEYS).agg(F.max("value").alias("value"), F.bool_or(F.col("reader") == "human").alias("reviewed"))
    new = r.where("reading_id % 2 = 1 AND value IS NOT NULL").groupBy(*_KEYS).agg(F.min("value").alias("value"))
    return mg.reupload_replace(old, new, _KEYS)


_FORM = """f AS (SELECT company_id, fiscal_year, field, min(value) AS nv, bool_or(reading_id % 3 = 0) AS ok, CASE WHEN max(reading_id) % 2 = 0 THEN max(value) END AS prefill FROM reading WHERE reading_id % 3 <> 1 GROUP BY ALL),
 c AS (SELECT company_id, fiscal_year, field, max(value) AS cv FROM reading WHERE reading_id % 3 <> 0 GROUP BY ALL),
 x AS (SELECT company_id, fiscal_year, field, cv AS current, nv AS new_value, prefill, CASE WHEN ok AND cv IS NOT NULL AND (nv IS NULL OR abs(cv - nv) <= 1e-9 * greatest(1, abs(cv))) THEN 'confirm' WHEN nv IS NULL THEN 'unchanged' WHEN cv IS NULL THEN 'add'
  WHEN abs(cv - nv) <= 1e-9 * greatest(1, abs(cv)) THEN 'unchanged' ELSE 'update' END AS op FROM f LEFT JOIN c USING (company_id, fiscal_year, field))"""


def _changes(spark, sf_dir):
    r = readings(spark, sf_dir)
    form = r.where("reading_id % 3 <> 1").groupBy(*_KEYS).agg(
        F.min("value").alias("value"), F.bool_or(F.col("reading_id") % 3 == 0).alias("ok"),
        F.when(F.max("reading_id") % 2 == 0, F.max("value")).alias("prefill"))
    cur = r.where("reading_id % 3 <> 0").groupBy(*_KEYS).agg(F.max("value").alias("value"))
    return cur, mg.change_set(cur, form, _KEYS)


@query("change_set", views.oracle(f"WITH {_FORM} SELECT company_id, fiscal_year, field, current, new_value, op, current IS NOT NULL AND prefill IS NULL AND op = 'update' AS warn FROM x"))
def change_set(spark, sf_dir):
    return _changes(spark, sf_dir)[1]


@query("changes_applied", views.oracle(f"""WITH {_FORM} SELECT company_id, fiscal_year, field, CASE WHEN op IN ('add', 'update') AND NOT (current IS NOT NULL AND prefill IS NULL AND op = 'update') THEN new_value ELSE cv END AS value,
 CASE WHEN op IS NULL THEN 'untouched' WHEN op IN ('add', 'update') AND NOT (current IS NOT NULL AND prefill IS NULL AND op = 'update') THEN 'applied' WHEN op = 'confirm' THEN 'confirmed' ELSE 'skipped' END AS result
 FROM c FULL JOIN x USING (company_id, fiscal_year, field)"""))
def changes_applied(spark, sf_dir):
    cur, ch = _changes(spark, sf_dir)
    return mg.apply_changes(cur, ch.withColumn("approved", ~F.col("warn")), _KEYS)


@query("duplicate_line_items", """WITH k AS (SELECT l_orderkey, l_linenumber, l_returnflag, min(l_partkey) AS kept_id, count(*) AS c FROM lineitem GROUP BY ALL HAVING count(*) > 1)
 SELECT l.l_partkey AS dropped_id, k.kept_id FROM lineitem l JOIN k USING (l_orderkey, l_linenumber, l_returnflag) WHERE l.l_partkey <> k.kept_id""")
def duplicate_line_items(spark, sf_dir):
    return mg.exact_copies(views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey"),
                           ["l_orderkey", "l_linenumber", "l_returnflag"], "l_partkey")


_FLAT5 = ["revenue", "net_income", "total_assets", "total_liabilities", "total_equity"]


@query("most_complete_financials", views.oracle(f"""WITH f AS (SELECT *, {' + '.join(f'coalesce({c} <> 0, FALSE)::INT' for c in _FLAT5)} AS filled FROM financials)
 SELECT company_id, id, revenue, copies FROM (SELECT *, count(*) OVER (PARTITION BY company_id) AS copies, row_number() OVER (PARTITION BY company_id ORDER BY filled DESC, updated_at DESC, id DESC) AS rn FROM f) WHERE rn = 1"""))
def most_complete_financials(spark, sf_dir):
    f = flat(spark, sf_dir).select("company_id", "id", "updated_at", *_FLAT5)
    return mg.most_complete(f, ["company_id"], _FLAT5).select("company_id", "id", "revenue", "copies")


@query("newest_documents", views.oracle("SELECT company_id, content_hash AS doc_key, period_label, max(id) AS kept_id, count(*) AS copies FROM doc_meta GROUP BY 1, 2, 3"))
def newest_documents(spark, sf_dir):
    return mg.newest_documents(views.view(spark, sf_dir, "doc_meta"))


@query("files_under_several_years", views.oracle("SELECT company_id, filename, count(DISTINCT period_label) AS labels, count(*) AS rows FROM doc_meta GROUP BY 1, 2 HAVING count(DISTINCT period_label) > 1"))
def files_under_several_years(spark, sf_dir):
    return mg.filed_under_several_years(views.view(spark, sf_dir, "doc_meta"))


@query("repointed_keys", views.oracle("""WITH m AS (SELECT d.id AS dropped_id, k.kept_id FROM doc_meta d JOIN (SELECT content_hash, max(id) AS kept_id FROM doc_meta GROUP BY 1) k USING (content_hash) WHERE d.id <> k.kept_id)
 SELECT l.doc_id AS child_id, coalesce(m.kept_id, l.doc_id) AS source_document_id, quality FROM labels l LEFT JOIN m ON m.dropped_id = l.doc_id"""))
def repointed_keys(spark, sf_dir):
    d = views.view(spark, sf_dir, "doc_meta").select("id", "content_hash")
    kept = d.groupBy("content_hash").agg(F.max("id").alias("kept_id"))
    mapping = d.join(kept, "content_hash").where("id <> kept_id").select(F.col("id").alias("dropped_id"), "kept_id")
    children = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("child_id"), F.col("doc_id").alias("source_document_id"), "quality")
    return mg.repoint(children, mapping, "source_document_id")


@query("duplicate_report", views.oracle("SELECT company_id, fiscal_year, field, count(*) AS copies FROM reading GROUP BY ALL HAVING count(*) > 1"))
def duplicate_report(spark, sf_dir):
    return qu.duplicate_report(readings(spark, sf_dir), _KEYS)


@query("purge_plan", """SELECT 'lineitem' AS table_name, count(*) AS rows FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderstatus = 'P'""")
def purge_plan(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "key")
    li = views.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "key")
    return mg.purge_plan({"lineitem": li, "orders": o}, o.where("o_orderstatus = 'P'"), "key")


@query("empty_periods", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def empty_periods(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select("o_orderkey")
    return mg.empty_parents(o, views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("companies_without_periods", views.oracle("SELECT p_partkey AS company_id, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT company_id FROM financials)"))
def companies_without_periods(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("company_id"), F.col("p_name").alias("name"))
    return mg.empty_parents(parts, flat(spark, sf_dir), "company_id").select("company_id", "name")


@query("missing_company_years", views.oracle("""SELECT company_id, fiscal_year FROM company CROSS JOIN (VALUES ('FY2018'), ('FY2024'), ('FY2025')) AS y(fiscal_year)
 EXCEPT SELECT company_id, fiscal_year FROM survey"""))
def missing_company_years(spark, sf_dir):
    return mg.missing_company_years(company(spark, sf_dir), ["FY2018", "FY2024", "FY2025"], views.survey(spark, sf_dir))


@query("sector_backfill", views.oracle("SELECT company_id, ticker, coalesce(nullif(trim(sector), ''), CASE WHEN ticker IS NOT NULL THEN 'Roster ' || country END) AS sector FROM company"))
def sector_backfill(spark, sf_dir):
    c = company(spark, sf_dir)
    roster = c.where("ticker IS NOT NULL").select(F.upper("ticker").alias("ticker"), F.concat(F.lit("Roster "), "country").alias("sector"))
    return mg.backfill_dimension(c, roster).select("company_id", "ticker", "sector")


@query("headline_backfill", norm_sql("""SELECT n.company_id, n.fiscal_year, coalesce(n.turnover, f.revenue / n.headline_scale) AS turnover,
 CASE WHEN n.turnover IS NULL AND f.revenue IS NOT NULL AND n.headline_scale IS NOT NULL THEN 'from parsed financial statements' END AS turnover_source
 FROM norm n LEFT JOIN (SELECT company_id, period, revenue FROM financials) f ON f.company_id = n.company_id AND f.period = n.fiscal_year"""))
def headline_backfill(spark, sf_dir):
    from .benchmark import norm
    st = flat(spark, sf_dir).select("company_id", F.col("period").alias("fiscal_year"), "revenue")
    s = norm(spark, sf_dir).select("company_id", "fiscal_year", "headline_scale", "turnover")
    return mg.headline_backfill(s, st, {"turnover": "revenue"}).select("company_id", "fiscal_year", "turnover", "turnover_source")


@query("comparative_fill", views.oracle("""WITH p AS (SELECT company_id, fiscal_year, field, value, reader = 'rules' AS is_primary FROM reading WHERE reading_id % 3 = 0), c AS (SELECT company_id, fiscal_year, field, value, FALSE AS is_primary FROM reading WHERE reading_id % 3 <> 0),
 h AS (SELECT company_id, fiscal_year, count(*) AS have, bool_or(is_primary) AS pr FROM p GROUP BY ALL), o AS (SELECT company_id, fiscal_year, count(*) AS offer FROM c GROUP BY ALL),
 v AS (SELECT o.company_id, o.fiscal_year, CASE WHEN have IS NULL THEN 'fill' WHEN NOT pr AND have < offer THEN 'replace' ELSE 'keep' END AS verdict FROM o LEFT JOIN h USING (company_id, fiscal_year))
 SELECT p.* FROM p LEFT JOIN v USING (company_id, fiscal_year) WHERE coalesce(verdict, 'keep') <> 'replace' UNION ALL SELECT c.* FROM c JOIN v USING (company_id, fiscal_year) WHERE verdict <> 'keep'"""))
def comparative_fill(spark, sf_dir):
    r = readings(spark, sf_dir)
    p = r.where("reading_id % 3 = 0").select(*_KEYS, "value", (F.col("reader") == "rules").alias("is_primary"))
    c = r.where("reading_id % 3 <> 0").select(*_KEYS, "value", F.lit(False).alias("is_primary"))
    return mg.comparative_fill(p, c, ["company_id", "fiscal_year"])


@query("aligned_directors", views.oracle("""WITH k AS (SELECT company_id, lower(director_name) AS nk, table_kind, y, count(*) AS c FROM pay_row GROUP BY ALL)
 SELECT company_id, nk AS name_key, table_kind, count(*) AS years, 'FY' || min(y)::VARCHAR AS first_year, 'FY' || max(y)::VARCHAR AS last_year FROM k GROUP BY 1, 2, 3
 HAVING count(*) >= 2 AND max(c) = 1 AND length(nk) - length(replace(nk, ' ', '')) >= 1"""))
def aligned_directors(spark, sf_dir):
    from ..functions import names
    r = views.view(spark, sf_dir, "pay_row").select("company_id", names.person_key("director_name").alias("name_key"), "table_kind",
                                                   F.concat(F.lit("FY"), F.col("y").cast("string")).alias("fiscal_year"))
    return mg.align_directors(r)


@query("register_reconciled", views.oracle("""WITH r AS (SELECT company_id, y, lower(p_name) AS name_key, CASE WHEN l_linenumber = 1 THEN 'unknown' ELSE 'executive' END AS role, CASE WHEN l_linenumber = 2 THEN 'Male' END AS gender
  FROM (SELECT l_suppkey AS company_id, year(l_shipdate) + 24 AS y, l_partkey, l_linenumber FROM lineitem WHERE l_linenumber <= 3) JOIN part ON p_partkey = l_partkey),
 p AS (SELECT l_suppkey AS company_id, year(l_shipdate) + 24 AS y, lower(p_name) AS name_key, 'non_executive' AS role, 'Female' AS gender FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber > 3),
 n AS (SELECT company_id, y, count(*) AS n FROM r GROUP BY ALL), f AS (SELECT company_id, y, name_key, min(role) AS fr, min(gender) AS fg FROM p GROUP BY ALL)
 SELECT r.company_id, r.y, r.name_key, coalesce(CASE WHEN role <> 'unknown' THEN role END, fr, 'unknown') AS role, coalesce(gender, fg) AS gender, 'register' AS origin FROM r JOIN n USING (company_id, y) LEFT JOIN f USING (company_id, y, name_key) WHERE n >= 35
 UNION ALL SELECT p.company_id, p.y, p.name_key, p.role, p.gender, 'pay_table' FROM p LEFT JOIN n USING (company_id, y) WHERE coalesce(n, 0) < 35"""))
def register_reconciled(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").join(views.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("company_id"), (F.year("l_shipdate") + 24).alias("y"), F.lower("p_name").alias("name_key"), "l_partkey", "l_linenumber")
    reg = li.where("l_linenumber <= 3").select("company_id", "y", "name_key", F.when(F.col("l_linenumber") == 1, "unknown").otherwise("executive").alias("role"),
                                                                F.when(F.col("l_linenumber") == 2, "Male").alias("gender"))
    pay = li.where("l_linenumber > 3").select("company_id", "y", "name_key", F.lit("non_executive").alias("role"), F.lit("Female").alias("gender"))
    return mg.reconcile_register(reg, pay, ["company_id", "y"], 35)


# six people of each company-year: on the register, and as the pay table prints them (with a title; a middle name; a letter short; turned round)
_PEOPLE = """SELECT company_id, y, i, upper(substr(a, 1, 1)) || substr(a, 2) AS one, upper(substr(b, 1, 1)) || substr(b, 2) AS two FROM (SELECT company_id, y, i, substr(h, 1, 9) AS a, substr(h, 10, 9) AS b FROM (
 SELECT company_id, y, i, translate(md5(CAST(company_id * 100 + i AS VARCHAR(20))), '0123456789', 'ghijklmnop') AS h FROM (SELECT s.company_id, s.year_no AS y, k.i FROM {survey} s CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS k(i)) t) u) v"""
_REGISTERED = "SELECT company_id, y, one || ' ' || two AS director_name, CASE WHEN i % 3 = 0 THEN 'unknown' ELSE 'executive' END AS role, CASE WHEN i % 2 = 0 THEN '' ELSE 'Male' END AS gender FROM {people} p WHERE i <= CASE WHEN company_id % 4 = 0 THEN 2 ELSE 6 END"
_PRINTED = """SELECT company_id, y, CASE i % 4 WHEN 0 THEN 'Ms. ' || one || ' ' || two WHEN 1 THEN one || ' Middlename ' || two WHEN 2 THEN substr(one, 1, 4) || substr(one, 6) || ' ' || two ELSE two || ' ' || one END AS director_name, 'non_executive' AS role, 'Female' AS gender FROM {people} p
 UNION ALL SELECT company_id, y, one || ' ' || substr(two, 1, 3) || 'zz' || substr(two, 6), 'executive', 'Male' FROM {people} p WHERE i = 6"""
_P = _PEOPLE.format(survey="survey")


@query("people_reconciled", views.oracle(f"""WITH pe AS ({_P}), rg AS (SELECT r.*, pe.i FROM ({_REGISTERED.format(people='pe')}) r JOIN pe ON pe.company_id = r.company_id AND pe.y = r.y AND r.director_name = pe.one || ' ' || pe.two)
 SELECT company_id, y, director_name, CASE WHEN role <> 'unknown' THEN role ELSE 'non_executive' END AS role, CASE WHEN gender <> '' THEN gender ELSE 'Female' END AS gender, 'register' AS origin FROM rg
 UNION ALL SELECT p.company_id, p.y, p.director_name, p.role, p.gender, 'pay_table' FROM ({_PRINTED.format(people='(SELECT * FROM pe WHERE company_id % 4 = 0 AND i > 2)')}) p"""))
def people_reconciled(spark, sf_dir):
    """Registers and pay tables that spell the same people differently; a second, worse reading of a name stays nobody's."""
    people = spark.sql(_PEOPLE, survey=views.survey(spark, sf_dir).select("company_id", "year_no"))
    register, printed = spark.sql(_REGISTERED, people=people), spark.sql(_PRINTED, people=people)
    return mg.reconcile_people(register, printed, ["company_id", "y"])


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in views.TABLES))
def table_counts(spark, sf_dir):
    from functools import reduce
    parts = [views.table(spark, sf_dir, t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("rows")) for t in views.TABLES]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("normalised_field_values", norm_sql("""SELECT company_id, fiscal_year, round_even(audit_fee * headline_scale * fx, 2) AS audit_fee, round_even(total_directors_fees * pay_scale * fx, 2) AS total_directors_fees,
 round_even(earnings_per_share * fx, 4) AS earnings_per_share, employees_count FROM norm"""))
def normalised_field_values(spark, sf_dir):
    from .benchmark import norm
    return norm(spark, sf_dir).select(
        "company_id", "fiscal_year", F.bround(sv.field_value("audit_fee"), 2).alias("audit_fee"), F.bround(sv.field_value("total_directors_fees"), 2).alias("total_directors_fees"),
        F.bround(sv.field_value("earnings_per_share"), 4).alias("earnings_per_share"), "employees_count")
