"""Benchmarking queries: overview, sectors, coverage, company rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as fl
from ..functions import labels, money
from ..operators import stats
from ..operators import survey as sv
from . import views
from .registry import query

_RATES = ", ".join(f"('{c}', {y}, CAST({r} AS DOUBLE))" for c, y, r in money.RATES_PER_USD)
_PART_YEAR = r"(?:^|[^a-z])(?:h[12]|[12]h|hy|q[1-4]|half|interim|semi)"


def _scale_case(col: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN '{u}' THEN CAST({s} AS DOUBLE)" for u, s in table.items())
    return f"CASE {col} {whens} ELSE {default} END"


NORM = f"""
rates(currency, yr, per_usd) AS (VALUES {_RATES}),
full_year AS (SELECT * FROM survey WHERE fiscal_year <> '' AND NOT regexp_matches(fiscal_year, '{_PART_YEAR}', 'i')),
cur AS (SELECT fiscal_year, upper(trim(coalesce(nullif(currency, ''), 'KES'))) AS c, count(*) AS k FROM full_year GROUP BY ALL),
modal AS (SELECT fiscal_year, c AS survey_currency FROM (SELECT *, row_number() OVER (PARTITION BY fiscal_year ORDER BY k DESC, c) AS rn FROM cur) WHERE rn = 1),
norm0 AS (
  SELECT f.* EXCLUDE (sector), co.name, co.ticker, coalesce(f.sector, co.sector) AS sector, m.survey_currency,
         upper(trim(coalesce(nullif(f.currency, ''), 'KES'))) AS reported_currency,
         lower(trim(coalesce(f.unit, ''))) AS lu, lower(trim(coalesce(nullif(f.director_figures_unit, ''), 'units'))) AS lp
  FROM full_year f JOIN modal m USING (fiscal_year) JOIN company co ON co.company_id = f.company_id),
norm AS (
  SELECT n.*, CASE WHEN n.reported_currency = n.survey_currency THEN CAST(1 AS DOUBLE) ELSE t.per_usd / s.per_usd END AS fx,
         {_scale_case('lu', money.HEADLINE_SCALE, "CASE WHEN regexp_matches(lu, '^[a-z]{3}$') THEN CAST(1 AS DOUBLE) END")} AS headline_scale,
         {_scale_case('lp', money.PAY_SCALE, 'CAST(1 AS DOUBLE)')} AS pay_scale
  FROM norm0 n
  LEFT JOIN rates t ON t.currency = n.survey_currency AND t.yr = TRY_CAST(substr(regexp_replace(n.fiscal_year, '[^0-9]', '', 'g'), 1, 4) AS INT)
  LEFT JOIN rates s ON s.currency = n.reported_currency AND s.yr = TRY_CAST(substr(regexp_replace(n.fiscal_year, '[^0-9]', '', 'g'), 1, 4) AS INT))
"""


def norm_sql(body: str) -> str:
    """Oracle SQL over the normalised survey rows."""
    sql = f"WITH {NORM}, {body.strip()[5:]}" if body.strip()[:5].upper() == "WITH " else f"WITH {NORM} {body}"
    return views.oracle(sql)


def norm(spark, sf_dir, maps: bool = False):
    return sv.normalised(views.survey(spark, sf_dir, maps), views.view(spark, sf_dir, "company"), money.rate_table(spark))


def rows(spark, sf_dir):
    return sv.company_rows(norm(spark, sf_dir))


def _plausible_sql(f: str, divisor: str = " / 1000000.0") -> str:
    v = f"({f} * (headline_scale{divisor} * fx))"
    ceiling = money.CEILING_MILLIONS[f] * (1 if divisor else 1_000_000)
    return f"CASE WHEN survey_currency = 'KES' AND abs({v}) > {ceiling} THEN NULL ELSE {v} END"


def pay_sql(f: str) -> str:
    return f"({f} * pay_scale * fx)"


def value_sql(f: str) -> str:
    kind = fl.KIND[f]
    if kind == "headline":
        return f"({f} * headline_scale * fx)"
    if kind == "pay":
        return pay_sql(f)
    if kind == "pershare":
        return f"({f} * fx)"
    return f


def gated_sql(v: str, g: int = 2) -> str:
    return f"CASE WHEN count({v}) >= {g} THEN round_even(avg({v}), 2) END"


def metric_sql(source: str, keys: str, g: int = 2, extra: str = "") -> str:
    return f"""SELECT {keys}, metric, {gated_sql('value', g)} AS average,
      CASE WHEN count(value) >= {g} THEN round_even(quantile_cont(value, 0.25), 2) END AS p25,
      CASE WHEN count(value) >= {g} THEN round_even(quantile_cont(value, 0.5), 2) END AS p50,
      CASE WHEN count(value) >= {g} THEN round_even(quantile_cont(value, 0.75), 2) END AS p75, {extra}
      count(value) AS company_count FROM {source} WHERE value IS NOT NULL GROUP BY {keys}, metric"""


def rows_sql() -> str:
    """Oracle CTE ``crow``: comparable company rows."""
    cols = []
    for f in fl.NUMERIC_FIELDS:
        cols.append(f"{_plausible_sql(f, '') if f in sv.HEADLINE else value_sql(f)} AS {f}")
    for f in fl.YESNO_FIELDS + fl.TEXT_FIELDS:
        cols.append(f"nullif({f}, '') AS {f}")
    third = "(1.0::DOUBLE / 3.0::DOUBLE)"
    return f"""crow0 AS (SELECT company_id, name, ticker, sector, fiscal_year, survey_currency AS currency, unit, reported_currency,
        CASE WHEN reported_currency <> survey_currency THEN round_even(fx, 6) END AS fx_rate,
        turnover * headline_scale * fx AS turnover_full,
        independent_neds_count / nullif(independent_neds_count + non_independent_neds_count, 0) AS ip,
        directors_female / nullif(directors_female + directors_male, 0) AS gp,
        {", ".join(cols)} FROM norm),
      crow AS (SELECT *, net_profit / nullif(turnover, 0) * 100 AS profit_margin,
        CASE WHEN coalesce(chairperson_annual_retainer, other_ned_annual_retainer, executive_director_annual_retainer) IS NOT NULL
          THEN round_even(coalesce(chairperson_annual_retainer, 0) + coalesce(other_ned_annual_retainer, 0) + coalesce(executive_director_annual_retainer, 0), 2) END AS total_director_remuneration,
        coalesce(kmp_total_compensation, CASE WHEN kmp_short_term_benefits IS NOT NULL THEN coalesce(kmp_short_term_benefits, 0)
          + coalesce(kmp_post_employment_benefits, 0) + coalesce(kmp_share_based_payments, 0) + coalesce(kmp_termination_benefits, 0) END) AS kmp_total,
        staff_costs / nullif(employees_count, 0) AS staff_cost_per_employee,
        staff_costs / nullif(turnover_full, 0) * 100 AS staff_costs_pct_of_turnover,
        audit_fee / nullif(turnover_full, 0) * 100 AS audit_fee_pct_of_turnover,
        CASE WHEN earnings_per_share > 0 THEN dividend_per_share / earnings_per_share * 100 END AS payout_ratio_pct,
        directors_female / nullif(directors_female + directors_male, 0) * 100 AS women_on_board_pct,
        CASE WHEN independent_neds_count IS NOT NULL AND board_size <> 0 THEN least(100.0, independent_neds_count / board_size * 100) END AS independent_pct,
        CASE WHEN ip IS NULL AND gp IS NULL THEN NULL
             WHEN ip IS NULL THEN least(50, round_even(50 * gp / {third}, 0)) * 2
             WHEN gp IS NULL THEN least(50, round_even(50 * ip / {third}, 0)) * 2
             ELSE least(50, round_even(50 * ip / {third}, 0)) + least(50, round_even(50 * gp / {third}, 0)) END AS governance_score,
        round_even(ip * 100, 1) AS independence_pct, round_even(gp * 100, 1) AS gender_pct,
        coalesce(ip >= {third}, FALSE) AS independence_compliant, coalesce(gp >= {third}, FALSE) AS gender_compliant FROM crow0)"""


def crow_sql(body: str) -> str:
    body = body.strip()
    sep = ", " + body[5:] if body[:5].upper() == "WITH " else " " + body
    return views.oracle(f"WITH {NORM}, {rows_sql()}{sep}")


_OVERVIEW_COLS = (
    [f"{_plausible_sql(f)} AS {f}" for f in sv.HEADLINE]
    + sv.BOARD_AVERAGES
    + [f"{pay_sql(f)} AS {f}" for f in fl.PAY_FIELDS]
)
_OVERVIEW_FIELDS = [*sv.HEADLINE, "profit_margin", *sv.BOARD_AVERAGES, *fl.PAY_FIELDS]
OVERVIEW_LONG = f"""
WITH w0 AS (SELECT fiscal_year, company_id, {", ".join(_OVERVIEW_COLS)} FROM norm),
w AS (SELECT *, net_profit / nullif(turnover, 0) * 100 AS profit_margin FROM w0),
longw AS (UNPIVOT w ON {", ".join(_OVERVIEW_FIELDS)} INTO NAME metric VALUE value)
"""


@query("survey_overview_by_year", norm_sql(OVERVIEW_LONG + metric_sql("longw", "fiscal_year")))
def survey_overview_by_year(spark, sf_dir):
    """Every averaged overview figure for every year (overview and historical trends in one pass)."""
    return sv.metric_table(sv.overview_figures(norm(spark, sf_dir)), ["fiscal_year"])


@query("survey_overview_latest", norm_sql(
    OVERVIEW_LONG + ", latest AS (SELECT max(fiscal_year) AS fiscal_year FROM norm) "
    + metric_sql("longw JOIN latest USING (fiscal_year)", "fiscal_year")))
def survey_overview_latest(spark, sf_dir):
    survey = views.survey(spark, sf_dir)
    n = sv.normalised(sv.latest_year_only(survey), views.view(spark, sf_dir, "company"), money.rate_table(spark))
    return sv.metric_table(sv.overview_figures(n), ["fiscal_year"])


@query("board_totals", norm_sql(f"""
SELECT fiscal_year, count(*) AS companies_with_data, round_even(sum({_plausible_sql('market_cap')}), 2) AS total_market_cap,
{", ".join(f"round_even(sum({f}), 2) AS total_{f}" for f in sv.BOARD_TOTALS)} FROM norm GROUP BY fiscal_year"""))
def board_totals(spark, sf_dir):
    return sv.board_totals(norm(spark, sf_dir))


def _paired(hi, lo):
    both = f"{pay_sql(hi)} IS NOT NULL AND {pay_sql(lo)} <> 0"
    return (f"CASE WHEN count(*) FILTER (WHERE {both}) >= 2 THEN round_even(avg({pay_sql(hi)}) FILTER (WHERE {both}) "
            f"/ nullif(avg({pay_sql(lo)}) FILTER (WHERE {both}), 0), 2) END AS {hi}_vs_{lo}")


@query("paired_pay_ratios", norm_sql(
    f"SELECT fiscal_year, {', '.join(_paired(h, l) for h, l in sv.RATIO_PAIRS)} FROM norm GROUP BY fiscal_year"))
def paired_pay_ratios(spark, sf_dir):
    return sv.paired_ratios(norm(spark, sf_dir))


@query("compa_ratios", norm_sql(f"""SELECT fiscal_year, round_even(({gated_sql(pay_sql('chairperson_annual_retainer'))})
 / nullif({gated_sql(pay_sql('other_ned_annual_retainer'))}, 0), 2) AS compa_ratio FROM norm GROUP BY fiscal_year"""))
def compa_ratios(spark, sf_dir):
    return norm(spark, sf_dir).groupBy("fiscal_year").agg(stats.compa_ratio(
        sv.pay_value("chairperson_annual_retainer"), sv.pay_value("other_ned_annual_retainer")).alias("compa_ratio"))


def _sector_sql(where: str = "") -> str:
    cols = []
    for f in sv.SECTOR_PAY:
        v = pay_sql(f)
        cols += [f"{gated_sql(v)} AS avg_{f}", f"count({v}) AS avg_{f}_company_count",
                 f"CASE WHEN count({v}) = 1 THEN max({v}) END AS single_{f}"]
    return norm_sql(f"""SELECT fiscal_year, coalesce(sector, 'Unclassified') AS sector, count(*) AS company_count,
      {", ".join(cols)} FROM norm {where} GROUP BY ALL""")


@query("sector_comparison", _sector_sql("WHERE fiscal_year = (SELECT max(fiscal_year) FROM norm)"))
def sector_comparison(spark, sf_dir):
    survey = sv.latest_year_only(views.survey(spark, sf_dir))
    return sv.sector_comparison(sv.normalised(survey, views.view(spark, sf_dir, "company"), money.rate_table(spark)))


@query("sector_comparison_all_years", _sector_sql())
def sector_comparison_all_years(spark, sf_dir):
    return sv.sector_comparison(norm(spark, sf_dir))


@query("benefit_coverage", views.oracle("""SELECT fiscal_year, benefit_key,
 round_even(100.0 * sum(CASE WHEN provided THEN 1 ELSE 0 END)::DOUBLE / count(*), 1) AS percent_provided, count(*) AS companies_addressing
 FROM benefits GROUP BY ALL"""))
def benefit_coverage(spark, sf_dir):
    return sv.benefit_coverage(views.survey(spark, sf_dir, maps=True))


@query("survey_currency", norm_sql("SELECT fiscal_year, survey_currency FROM modal"))
def survey_currency(spark, sf_dir):
    return sv.survey_currency(sv.full_years(views.survey(spark, sf_dir)))


@query("available_years", norm_sql("SELECT DISTINCT fiscal_year FROM full_year"))
def available_years(spark, sf_dir):
    return sv.available_years(views.survey(spark, sf_dir))


@query("default_year", norm_sql("SELECT max(fiscal_year) AS fiscal_year FROM full_year"))
def default_year(spark, sf_dir):
    return sv.default_year(views.survey(spark, sf_dir))


def _implausible(f):
    v = f"({f} * (headline_scale / 1000000.0 * fx))"
    return (f"SELECT fiscal_year, company_id, name, 'implausible' AS status, '{f}' AS field, 'above the credible ceiling' AS reason, "
            f"round_even({v} * 1000000, 0) AS full_value FROM norm WHERE survey_currency = 'KES' AND abs({v}) > {money.CEILING_MILLIONS[f]}")


@query("normalisation_report", norm_sql(f"""
SELECT fiscal_year, company_id, name, 'excluded' AS status, CAST(NULL AS VARCHAR) AS field,
  'no exchange rate ' || reported_currency || ' to ' || survey_currency AS reason, CAST(NULL AS DOUBLE) AS full_value FROM norm WHERE fx IS NULL
UNION ALL SELECT fiscal_year, company_id, name, 'converted', NULL, reported_currency, round_even(fx, 6) FROM norm WHERE fx IS NOT NULL AND reported_currency <> survey_currency
UNION ALL SELECT fiscal_year, company_id, name, 'excluded', NULL, 'unrecognised unit ' || coalesce(unit, ''), NULL FROM norm WHERE fx IS NOT NULL AND headline_scale IS NULL
UNION ALL {" UNION ALL ".join(_implausible(f) for f in sv.HEADLINE)}"""))
def normalisation_report(spark, sf_dir):
    return sv.normalisation_report(norm(spark, sf_dir))


_MONEY_ROWS = [*sv.HEADLINE, "chairperson_annual_retainer", "ceo_monthly_salary", "total_director_remuneration", "kmp_total",
               "profit_margin", "staff_cost_per_employee", "staff_costs_pct_of_turnover", "audit_fee_pct_of_turnover",
               "payout_ratio_pct", "women_on_board_pct", "independent_pct"]


@query("company_rows", crow_sql(f"""SELECT company_id, name, ticker, sector, fiscal_year, currency, reported_currency, fx_rate, board_size,
 {", ".join(f"round_even({f}, 2) AS {f}" for f in _MONEY_ROWS)} FROM crow"""))
def company_rows(spark, sf_dir):
    return rows(spark, sf_dir).select(
        "company_id", "name", "ticker", "sector", "fiscal_year", "currency", "reported_currency", "fx_rate", "board_size",
        *[F.bround(f, 2).alias(f) for f in _MONEY_ROWS])


@query("governance_scores", crow_sql("""SELECT company_id, fiscal_year, CAST(governance_score AS DOUBLE) AS score, independence_pct, gender_pct,
 independence_compliant, gender_compliant FROM crow"""))
def governance_scores(spark, sf_dir):
    return rows(spark, sf_dir).select("company_id", "fiscal_year", "governance.*")


def _fits(unit, scale):
    conds = []
    for f, ceiling in money.CEILING_MILLIONS.items():
        lo = money.FLOOR_FULL.get(f, 0)
        conds.append(f"({f} IS NULL OR (abs({f} * {scale}) <= {ceiling} * 1000000.0 AND abs({f} * {scale}) >= {lo}))")
    return f"CASE WHEN coalesce(turnover, net_profit, market_cap) IS NOT NULL AND {' AND '.join(conds)} THEN '{unit}' END"


@query("suggested_units", views.oracle(f"""SELECT company_id, fiscal_year, array_to_string(list_filter([
 {", ".join(_fits(u, money.HEADLINE_SCALE[u]) for u in money.UNIT_CHOICES)}], lambda x: x IS NOT NULL), ',') AS suggested FROM survey"""))
def suggested_units(spark, sf_dir):
    return views.survey(spark, sf_dir).select(
        "company_id", "fiscal_year", F.array_join(money.suggest_units(), ",").alias("suggested"))


_EXT_STATS = [f for f in fl.EXTENDED_FIELDS if fl.KIND[f] not in ("text", "yesno")] + [
    "kmp_total", "staff_cost_per_employee", "staff_costs_pct_of_turnover", "audit_fee_pct_of_turnover", "payout_ratio_pct"]


@query("extended_statistics", crow_sql(f"""WITH e AS (SELECT fiscal_year, company_id, {", ".join(_EXT_STATS)} FROM crow),
 longe AS (UNPIVOT e ON {", ".join(_EXT_STATS)} INTO NAME metric VALUE value)
 {metric_sql("longe", "fiscal_year", 2, "CASE WHEN count(value) >= 2 THEN round_even(min(value), 2) END AS min, CASE WHEN count(value) >= 2 THEN round_even(max(value), 2) END AS max,")}"""))
def extended_statistics(spark, sf_dir):
    return sv.extended_stats(rows(spark, sf_dir), _EXT_STATS)


_LEAD = ["audit_fee", "kmp_total", "employees_count", "women_on_board_pct", "profit_margin"]


@query("metric_leaders", crow_sql(f"""WITH e AS (SELECT fiscal_year, company_id, name, {", ".join(_LEAD)} FROM crow),
 longe AS (UNPIVOT e ON {", ".join(_LEAD)} INTO NAME metric VALUE value)
 SELECT fiscal_year, company_id, name, metric, round_even(value, 2) AS value, CAST(place AS INT) AS place FROM (
 SELECT *, row_number() OVER (PARTITION BY fiscal_year, metric ORDER BY value DESC, name, company_id) AS place FROM longe) WHERE place <= 5"""))
def metric_leaders(spark, sf_dir):
    return sv.leaders(rows(spark, sf_dir), _LEAD)


def _yn(f):
    return f"SELECT fiscal_year, company_id, name, '{f}' AS field, substr(lower(trim({f})), 1, 1) AS answer FROM norm"


_YN = f"yn AS (SELECT * FROM ({' UNION ALL '.join(_yn(f) for f in fl.YESNO_FIELDS)}) WHERE answer IN ('y', 'n'))"


@query("yes_no_shares", norm_sql(f"""WITH {_YN} SELECT fiscal_year, field, count(*) FILTER (WHERE answer = 'y') AS yes,
 count(*) FILTER (WHERE answer = 'n') AS no, count(*) AS answered,
 round_even(100.0 * (count(*) FILTER (WHERE answer = 'y'))::DOUBLE / count(*), 1) AS pct_yes FROM yn GROUP BY ALL"""))
def yes_no_shares(spark, sf_dir):
    return sv.yesno_share(norm(spark, sf_dir), fl.YESNO_FIELDS)


@query("yes_no_companies", norm_sql(f"WITH {_YN} SELECT * FROM yn"))
def yes_no_companies(spark, sf_dir):
    return sv.yesno_companies(norm(spark, sf_dir), fl.YESNO_FIELDS)


@query("auditor_shares", norm_sql("""WITH a AS (SELECT fiscal_year, trim(auditor_name) AS label,
 trim(regexp_replace(replace(replace(lower(replace(auditor_name, '&', 'and')), 'llp', ''), '.', ''), '\\s+', ' ', 'g')) AS key FROM norm WHERE auditor_name <> ''),
 b AS (SELECT fiscal_year, key, min(label) AS label, count(*) AS companies FROM a GROUP BY fiscal_year, key)
 SELECT fiscal_year, key, label, companies, round_even(100.0 * companies::DOUBLE / sum(companies) OVER (PARTITION BY fiscal_year)::DOUBLE, 1) AS pct FROM b"""))
def auditor_shares(spark, sf_dir):
    return sv.label_shares(norm(spark, sf_dir), "auditor_name")


@query("audit_opinions", norm_sql("""SELECT fiscal_year, upper(substr(trim(audit_opinion), 1, 1)) || lower(substr(trim(audit_opinion), 2)) AS opinion,
 count(*) AS companies FROM norm WHERE audit_opinion <> '' GROUP BY ALL"""))
def audit_opinions(spark, sf_dir):
    return sv.opinion_counts(norm(spark, sf_dir))


_DIRECTORS = """SELECT company_id, 'FY' || CAST(y AS VARCHAR(4)) AS fiscal_year, person_no, amount % 12 AS board_meetings_attended,
 CASE WHEN fees % 7 = 0 THEN NULL ELSE fees % 9 + 3 END AS board_meetings_eligible FROM pay_row"""


@query("director_attendance", views.oracle(f"""WITH d AS ({_DIRECTORS}), e AS (SELECT *, least(100.0, board_meetings_attended * 100.0 / board_meetings_eligible)::DOUBLE AS p
 FROM d WHERE board_meetings_attended IS NOT NULL AND board_meetings_eligible <> 0)
 SELECT fiscal_year, count(*) AS directors, round_even(avg(p), 1) AS average_pct, count(*) FILTER (WHERE p >= 100) AS full_attendance,
 count(*) FILTER (WHERE p < 75) AS below_75, count(DISTINCT company_id) AS companies FROM e GROUP BY fiscal_year"""))
def director_attendance(spark, sf_dir):
    pr = views.view(spark, sf_dir, "pay_row")
    d = pr.select("company_id", F.concat(F.lit("FY"), F.col("y").cast("string")).alias("fiscal_year"),
                  (F.col("amount") % 12).alias("board_meetings_attended"),
                  F.when(F.col("fees") % 7 != 0, F.col("fees") % 9 + 3).alias("board_meetings_eligible"))
    return sv.director_attendance(d)
