"""Statement queries: ratios, scores, portfolio, sectors, peers, growth and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import adaptive_round, midpoint
from ..operators import finance as fin
from ..operators import stats
from ..operators import survey as sv
from . import views
from .benchmark import crow_sql, rows
from .registry import query

_ORDER = {"normalised": "fiscal_year, CASE WHEN period LIKE 'FY%' THEN 1 ELSE 0 END, period", "label": "period"}


def _clamp(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(0, least(100, {x})) END"


def fin_sql(body: str, order: str = "label") -> str:
    """Oracle SQL over rated flat rows (``rated``) and their lags (``win``)."""
    o = _ORDER[order]
    desc = ", ".join(x + " DESC" for x in o.split(", "))
    head = f"""flat AS (SELECT *, net_income / nullif(revenue, 0) * 100 AS net_margin, net_income / nullif(total_equity, 0) * 100 AS roe,
        total_liabilities / nullif(total_equity, 0) AS debt_equity FROM financials),
      flat2 AS (SELECT *, CASE WHEN net_margin IS NOT NULL AND roe IS NOT NULL AND debt_equity IS NOT NULL THEN
        CAST(round_even({_clamp(f"({_clamp('net_margin * 2.5')} * 0.4 + {_clamp('roe * 2.5')} * 0.4 + {_clamp('100.0 - debt_equity * 10')} * 0.2)")}, 0) AS INT) END AS financial_score FROM flat),
      rated AS (SELECT *, CASE WHEN financial_score >= 70 THEN 'strong' WHEN financial_score >= 40 THEN 'moderate'
        WHEN financial_score IS NOT NULL THEN 'weak' END AS score_band FROM flat2),
      win AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY {desc}) AS recency,
        {", ".join(f"lag({c}) OVER (PARTITION BY company_id ORDER BY {o}) AS prior_{c}" for c in ("period", "revenue", "net_income", "net_margin", "roe"))},
        lag(revenue, 2) OVER (PARTITION BY company_id ORDER BY {o}) AS prior2_revenue FROM rated)"""
    body = body.strip()
    sep = ", " + body[5:] if body[:5].upper() == "WITH " else " " + body
    return views.oracle(f"WITH {head}{sep}")


def pct(new: str, old: str) -> str:
    return f"(({new} - {old}) / nullif(abs({old}), 0) * 100)"


def flat(spark, sf_dir):
    return views.view(spark, sf_dir, "financials")


def company(spark, sf_dir):
    return views.view(spark, sf_dir, "fin_company")


@query("flat_ratios_scores", fin_sql("""SELECT company_id, period, round_even(net_margin, 4) AS net_margin, round_even(roe, 4) AS roe,
 round_even(debt_equity, 4) AS debt_equity, financial_score, score_band FROM rated"""))
def flat_ratios_scores(spark, sf_dir):
    return fin.with_flat_ratios(flat(spark, sf_dir)).select(
        "company_id", "period", *[F.bround(c, 4).alias(c) for c in ("net_margin", "roe", "debt_equity")], "financial_score", "score_band")


_METRICS = [("net_margin", "net_income / nullif(revenue, 0) * 100", "net_income / revenue * 100"),
            ("gross_margin", "gross_profit / nullif(revenue, 0) * 100", "gross_profit / revenue * 100"),
            ("operating_margin", "operating_profit / nullif(revenue, 0) * 100", "operating_profit / revenue * 100"),
            ("roe", "net_income / nullif(total_equity, 0) * 100", "net_income / total_equity * 100"),
            ("debt_equity", "total_liabilities / nullif(total_equity, 0)", "total_liabilities / total_equity"),
            ("roa", "net_income / nullif(total_assets, 0) * 100", "net_income / total_assets * 100"),
            ("debt_assets", "total_liabilities / nullif(total_assets, 0)", "total_liabilities / total_assets")]


@query("ratio_metrics", views.oracle("SELECT company_id, period, metric_name, round_even(value, 4) AS value, formula_description FROM ("
       + " UNION ALL ".join(f"SELECT company_id, period, '{n}' AS metric_name, {e} AS value, '{t}' AS formula_description FROM financials" for n, e, t in _METRICS)
       + """ UNION ALL SELECT company_id, period, 'eps', coalesce(eps, net_income / nullif(shares_outstanding, 0)),
         CASE WHEN eps IS NOT NULL THEN 'as reported' ELSE 'net_income / shares_outstanding' END FROM financials) WHERE value IS NOT NULL"""))
def ratio_metrics(spark, sf_dir):
    items = fin.flat_to_line_items(flat(spark, sf_dir))
    wide = fin.amounts_by_name(items, ["company_id", "period"])
    return fin.ratio_metrics(wide, ["company_id", "period"]).withColumn("value", F.bround("value", 4))


@query("flat_to_line_items", views.oracle("""SELECT company_id, period, normalized_name, amount,
 CASE WHEN normalized_name LIKE 'total%' THEN 'balance_sheet' ELSE 'income_statement' END AS statement_type
 FROM (UNPIVOT (SELECT company_id, period, source, revenue, net_income, total_assets, total_liabilities, total_equity, gross_profit, operating_profit, eps, shares_outstanding FROM financials)
 ON revenue, net_income, total_assets, total_liabilities, total_equity, gross_profit, operating_profit, eps, shares_outstanding INTO NAME normalized_name VALUE amount)
 WHERE source IS DISTINCT FROM 'manual'"""))
def flat_to_line_items(spark, sf_dir):
    f = flat(spark, sf_dir)
    existing = f.where("source = 'manual'").select("company_id", "period")
    return fin.flat_to_line_items(f, existing).drop("order_index")


@query("year_over_year", fin_sql(f"""SELECT company_id, period, prior_period, round_even({pct('revenue', 'prior_revenue')}, 4) AS revenue_yoy,
 round_even({pct('net_income', 'prior_net_income')}, 4) AS net_income_yoy, CASE WHEN round_even(net_margin - prior_net_margin, 4) = 0 THEN 0 ELSE round_even(net_margin - prior_net_margin, 4) END AS net_margin_delta,
 CASE WHEN round_even(roe - prior_roe, 4) = 0 THEN 0 ELSE round_even(roe - prior_roe, 4) END AS roe_delta, recency FROM win""", "normalised"))
def year_over_year(spark, sf_dir):
    df = fin.yoy(fin.with_flat_ratios(flat(spark, sf_dir)))
    return df.select("company_id", "period", "prior_period",
                     *[F.bround(c, 4).alias(c) for c in ("revenue_yoy", "net_income_yoy", "net_margin_delta", "roe_delta")],
                     F.col("recency").cast("long").alias("recency"))


@query("score_trend", fin_sql("""SELECT company_id, array_to_string(list(coalesce(CAST(financial_score AS VARCHAR), '-') ORDER BY period), ',') AS score_trend
 FROM win WHERE recency <= 8 GROUP BY company_id"""))
def score_trend(spark, sf_dir):
    t = fin.last_scores(fin.with_flat_ratios(flat(spark, sf_dir)), 8, "label")
    text = F.transform("score_trend", lambda s: F.coalesce(s.cast("string"), F.lit("-")))
    return t.select("company_id", F.array_join(text, ",").alias("score_trend"))


@query("latest_three_periods", fin_sql("SELECT company_id, period, revenue, CAST(recency AS BIGINT) AS recency FROM win WHERE recency <= 3", "normalised"))
def latest_three_periods(spark, sf_dir):
    return stats.latest_n(flat(spark, sf_dir), ["company_id"], [fin.period_order().desc()], 3).select(
        "company_id", "period", "revenue", F.col("recency").cast("long").alias("recency"))


_RISKS = f"""r AS (SELECT *, {pct('net_income', 'prior_net_income')} AS ic, {pct('revenue', 'prior_revenue')} AS rc FROM win),
 cand AS (SELECT company_id, period, recency, updated_at, CASE WHEN debt_equity > 3 THEN 3 ELSE 2 END AS severity, 0 AS ord, 'High Debt' AS issue, round_even(debt_equity, 1) AS amount FROM r WHERE debt_equity > 2
  UNION ALL SELECT company_id, period, recency, updated_at, CASE WHEN ic < -20 THEN 3 ELSE 2 END, 1, 'Falling Profit', round_even(abs(ic), 0) FROM r WHERE ic < 0
  UNION ALL SELECT company_id, period, recency, updated_at, CASE WHEN rc < -15 THEN 3 ELSE 2 END, 2, 'Revenue Decline', round_even(abs(rc), 0) FROM r WHERE rc < 0
  UNION ALL SELECT company_id, period, recency, updated_at, 2, 3, 'Weak Financial Health', CAST(financial_score AS DOUBLE) FROM r
   WHERE score_band = 'weak' AND NOT coalesce(debt_equity > 2, FALSE) AND NOT coalesce(ic < 0, FALSE) AND NOT coalesce(rc < 0, FALSE))"""


@query("risk_candidates", fin_sql(f"WITH {_RISKS} SELECT company_id, period, severity, issue, amount FROM cand WHERE recency = 1"))
def risk_candidates(spark, sf_dir):
    latest = fin.with_prior(fin.with_flat_ratios(flat(spark, sf_dir)), ["revenue", "net_income"], "label", 1).where("recency = 1")
    return latest.select("company_id", "period", F.explode(fin.risk_candidates()).alias("r")).select("company_id", "period", "r.*")


@query("opportunities", fin_sql(f"""SELECT company_id, period, round_even({pct('revenue', 'prior_revenue')}, 0) AS growth FROM win
 WHERE recency = 1 AND {pct('revenue', 'prior_revenue')} > 20"""))
def opportunities(spark, sf_dir):
    latest = fin.with_prior(fin.with_flat_ratios(flat(spark, sf_dir)), ["revenue"], "label", 1).where("recency = 1")
    return latest.select("company_id", "period", fin.opportunity().alias("growth")).where("growth IS NOT NULL")


_CR, _IC = "(total_assets / nullif(total_liabilities, 0) / 2)", "(operating_profit / nullif(gross_profit, 0) * 6)"


def _weighted(parts: list[tuple[float, str]]) -> str:
    top = " + ".join(f"coalesce({_clamp(p)} * {w}, 0)" for w, p in parts)
    bottom = " + ".join(f"CASE WHEN {p} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for w, p in parts)
    return f"round_even(({top}) / nullif({bottom}, 0), 0)"


_RISK_SQL = _weighted([(0.35, "(debt_equity / 4 * 100)"), (0.25, "((1.5 - CASE WHEN cr IS NOT NULL THEN least(cr, 1.5) END) / 1.5 * 100)"),
                       (0.25, "((8 - CASE WHEN ic IS NOT NULL THEN least(ic, 8.0) END) / 8 * 100)"), (0.15, "(-(net_margin - prior_net_margin) * 10)")])


@query("financial_risk_score", fin_sql(f"""WITH x AS (SELECT *, {_CR} AS cr, {_IC} AS ic FROM win),
 y AS (SELECT company_id, period, {_RISK_SQL} AS risk_score FROM x)
 SELECT *, CASE WHEN risk_score <= 20 THEN 'Very Low Risk' WHEN risk_score <= 40 THEN 'Low Risk' WHEN risk_score <= 60 THEN 'Moderate Risk'
 WHEN risk_score <= 80 THEN 'High Risk' WHEN risk_score IS NOT NULL THEN 'Very High Risk' END AS risk_band FROM y"""))
def financial_risk_score(spark, sf_dir):
    df = fin.with_prior(fin.with_flat_ratios(flat(spark, sf_dir)), ["net_margin"], "label", 1)
    cr = F.try_divide(F.try_divide("total_assets", "total_liabilities"), F.lit(2))
    ic = F.try_divide("operating_profit", "gross_profit") * 6
    out = df.select("company_id", "period", fin.risk_score("debt_equity", cr, ic, F.col("net_margin") - F.col("prior_net_margin")).alias("risk_score"))
    return out.withColumn("risk_band", fin.risk_band("risk_score"))


@query("strengths_outlook", fin_sql(f"""WITH x AS (SELECT *, {_CR} AS cr, {_IC} AS ic, {pct('revenue', 'prior_revenue')} AS ry, {pct('net_income', 'prior_net_income')} AS ny,
  net_margin - prior_net_margin AS md, roe - prior_roe AS rd FROM win)
 SELECT company_id, period,
  array_to_string(list_filter([CASE WHEN md > 0 THEN 'Net margin improved' END, CASE WHEN rd > 0 THEN 'ROE improved' END, CASE WHEN ry > 0 THEN 'Revenue grew' END,
   CASE WHEN ny > 0 THEN 'Net profit grew' END, CASE WHEN score_band = 'strong' THEN 'Rated strong' END], lambda x: x IS NOT NULL), ';') AS strengths,
  array_to_string(list_filter([CASE WHEN debt_equity > 2 THEN 'High Leverage' END, CASE WHEN cr < 1 THEN 'Liquidity Strain' END, CASE WHEN ic < 2 THEN 'Weak Interest Coverage' END,
   CASE WHEN md < -2 THEN 'Margin Compression' END], lambda x: x IS NOT NULL), ';') AS exposures,
  CASE WHEN (coalesce(ry > 0, FALSE)::INT + coalesce(ny > 0, FALSE)::INT + coalesce(rd > 0, FALSE)::INT + coalesce(md > 0, FALSE)::INT) >= 3 THEN 'Positive'
   WHEN (coalesce(ry < 0, FALSE)::INT + coalesce(ny < 0, FALSE)::INT + coalesce(rd < 0, FALSE)::INT + coalesce(md < 0, FALSE)::INT) >= 3 THEN 'Negative' ELSE 'Neutral' END AS outlook,
  CASE WHEN prior2_revenue IS NOT NULL THEN 'High' WHEN prior_period IS NOT NULL THEN 'Medium' ELSE 'Low' END AS confidence FROM x""", "normalised"))
def strengths_outlook(spark, sf_dir):
    df = fin.with_prior(fin.yoy(fin.with_flat_ratios(flat(spark, sf_dir))).drop("recency", "prior_revenue", "prior_period"), ["period", "revenue"], "normalised", 2)
    df = df.withColumns({"current_ratio": F.try_divide(F.try_divide("total_assets", "total_liabilities"), F.lit(2)),
                         "interest_coverage": F.try_divide("operating_profit", "gross_profit") * 6})
    conf = F.when(F.col("prior2_revenue").isNotNull(), "High").when(F.col("prior_period").isNotNull(), "Medium").otherwise("Low")
    return df.select("company_id", "period", F.array_join(fin.strengths(), ";").alias("strengths"),
                     F.array_join(fin.risk_exposures(), ";").alias("exposures"), fin.outlook().alias("outlook"), conf.alias("confidence"))


@query("guidance_scenarios", """SELECT p_partkey AS metric_id, CASE WHEN p_size % 5 <> 0 THEN floor(p_retailprice) END AS bear_case,
 CASE WHEN p_size % 7 <> 0 THEN floor(p_retailprice) + p_size END AS bull_case,
 CASE WHEN p_size % 5 <> 0 AND p_size % 7 <> 0 THEN round_even((floor(p_retailprice) + floor(p_retailprice) + p_size) / 2, 2) END AS base_case FROM part""")
def guidance_scenarios(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("metric_id"),
        F.when(F.col("p_size") % 5 != 0, F.floor("p_retailprice").cast("double")).alias("bear_case"),
        F.when(F.col("p_size") % 7 != 0, F.floor("p_retailprice").cast("double") + F.col("p_size")).alias("bull_case"))
    return p.withColumn("base_case", midpoint("bear_case", "bull_case"))


_PO = f"""SELECT count(*) AS companies_with_data, sum(nullif(revenue, 0)) AS combined_revenue, sum(nullif(net_income, 0)) AS combined_net_income,
 round_even(avg(net_margin), 6) AS avg_net_margin, round_even(avg(roe), 6) AS avg_roe, avg(financial_score) AS avg_financial_score,
 round_even(avg({pct('revenue', 'prior_revenue')}), 6) AS avg_revenue_growth, count(*) FILTER (WHERE score_band = 'strong') AS strong,
 count(*) FILTER (WHERE score_band = 'moderate') AS moderate, count(*) FILTER (WHERE score_band = 'weak') AS weak,
 count(*) FILTER (WHERE updated_at >= TIMESTAMP '2001-07-01') AS updated_this_month,
 count(*) FILTER (WHERE updated_at >= TIMESTAMP '2001-07-01' AND score_band = 'weak') AS high_risk_added_this_month, max(updated_at) AS last_updated,
 round_even({pct('coalesce(sum(nullif(revenue, 0)), 0)', 'sum(nullif(prior_revenue, 0))')}, 6) AS combined_revenue_yoy,
 round_even({pct('coalesce(sum(nullif(net_income, 0)), 0)', 'sum(nullif(prior_net_income, 0))')}, 6) AS combined_income_yoy,
 round_even(avg(net_margin) - avg(prior_net_margin), 6) AS net_margin_delta, round_even(avg(roe) - avg(prior_roe), 6) AS roe_delta,
 round_even(avg({pct('revenue', 'prior_revenue')}) - avg({pct('prior_revenue', 'prior2_revenue')}), 6) AS revenue_growth_delta,
 (SELECT count(*) FROM fin_company) AS total_companies, round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM fin_company), 6) AS updated_pct_of_total
 FROM win WHERE recency = 1"""


@query("portfolio_overview", fin_sql(_PO))
def portfolio_overview(spark, sf_dir):
    df = fin.portfolio_overview(company(spark, sf_dir), flat(spark, sf_dir), F.lit("2001-07-01").cast("timestamp"))
    six = ["avg_net_margin", "avg_roe", "avg_revenue_growth", "combined_revenue_yoy", "combined_income_yoy", "net_margin_delta",
           "roe_delta", "revenue_growth_delta", "updated_pct_of_total"]
    return df.withColumns({c: F.bround(c, 6) for c in six})


@query("revenue_trend", views.oracle(f"""WITH a AS (SELECT company_id, TRY_CAST(regexp_extract(period, '(?:19|20)\\d{{2}}') AS INT) AS year, revenue, updated_at, id FROM financials WHERE revenue <> 0),
 b AS (SELECT *, row_number() OVER (PARTITION BY company_id, year ORDER BY updated_at DESC, id DESC) AS rn FROM a),
 c AS (SELECT year, sum(revenue) AS combined_revenue FROM b WHERE rn = 1 GROUP BY year ORDER BY year DESC LIMIT 4)
 SELECT year, combined_revenue, round_even({pct('combined_revenue', 'lag(combined_revenue) OVER (ORDER BY year)')}, 6) AS growth_pct FROM c"""))
def revenue_trend(spark, sf_dir):
    return fin.revenue_trend(flat(spark, sf_dir)).withColumn("growth_pct", F.bround("growth_pct", 6))


@query("sector_rollup", fin_sql(f"""WITH s AS (SELECT c.sector, count(*) AS company_count, sum(revenue) AS total_revenue,
 round_even(avg({pct('revenue', 'prior_revenue')}), 2) AS avg_revenue_growth, round_even(avg(net_margin), 2) AS avg_net_margin,
 round_even(round_even(avg(financial_score), 2), 0) AS avg_financial_score FROM win JOIN fin_company c USING (company_id) WHERE recency = 1 AND c.sector <> '' GROUP BY 1)
 SELECT *, round_even(coalesce(total_revenue, 0) * 100.0::DOUBLE / nullif(sum(total_revenue) OVER (), 0), 1) AS weight_pct FROM s"""))
def sector_rollup(spark, sf_dir):
    return fin.sector_rollup(company(spark, sf_dir), flat(spark, sf_dir))


@query("sector_performance", fin_sql("""SELECT coalesce(c.sector, 'Unclassified') AS sector, CAST(round_even(avg(financial_score), 0) AS INT) AS avg_score
 FROM win JOIN fin_company c USING (company_id) WHERE recency = 1 AND financial_score IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"""))
def sector_performance(spark, sf_dir):
    return fin.sector_performance(company(spark, sf_dir), flat(spark, sf_dir))


@query("data_summary", views.oracle("""SELECT count(*) AS total_statements, count(*) FILTER (WHERE regexp_matches(upper(period), '\\bQ[1-4]\\b|\\b[369]M\\b')) AS quarterly_reports,
 count(*) FILTER (WHERE NOT regexp_matches(upper(period), '\\bQ[1-4]\\b|\\b[369]M\\b')) AS annual_reports, count(DISTINCT source) AS data_sources FROM financials"""))
def data_summary(spark, sf_dir):
    return fin.data_summary(flat(spark, sf_dir))


@query("top_performers", fin_sql("""SELECT company_id, period, financial_score FROM win WHERE recency = 1 AND financial_score IS NOT NULL
 ORDER BY financial_score DESC, company_id LIMIT 5"""))
def top_performers(spark, sf_dir):
    latest = fin.with_prior(fin.with_flat_ratios(flat(spark, sf_dir)), [], "label", 0).where("recency = 1 AND financial_score IS NOT NULL")
    return latest.orderBy(F.col("financial_score").desc(), "company_id").limit(5).select("company_id", "period", "financial_score")


_ALERTS = f"""{_RISKS}, worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY severity DESC, ord) AS rn FROM cand WHERE recency = 1) WHERE rn = 1),
 feed AS (SELECT company_id, updated_at AS last_updated, 'risk' AS kind, CASE issue WHEN 'High Debt' THEN 'High Debt Alert' WHEN 'Falling Profit' THEN 'Profit Declining'
   WHEN 'Revenue Decline' THEN 'Revenue Slowing' ELSE issue END AS title, amount, CASE severity WHEN 3 THEN 'High' ELSE 'Medium' END AS severity FROM worst
  UNION ALL SELECT company_id, updated_at, 'opportunity', 'Strong Opportunity', round_even(rc, 0), 'Positive' FROM r WHERE recency = 1 AND rc > 20)"""


@query("alerts", fin_sql(f"WITH {_ALERTS} SELECT f.*, c.name FROM feed f JOIN fin_company c USING (company_id)"))
def alerts(spark, sf_dir):
    return fin.alerts(company(spark, sf_dir), flat(spark, sf_dir)).drop("rank_key")


@query("alert_feed", fin_sql(f"""WITH {_ALERTS}, p AS (SELECT f.*, c.name, row_number() OVER (PARTITION BY kind ORDER BY CASE severity WHEN 'Medium' THEN 1 ELSE 0 END,
   CASE WHEN kind = 'risk' THEN last_updated END, last_updated DESC, company_id) AS place FROM feed f JOIN fin_company c USING (company_id))
 SELECT company_id, name, last_updated, kind, title, amount, severity, CAST(place AS INT) AS place FROM p WHERE CASE WHEN kind = 'risk' THEN place <= 3
  ELSE place <= 4 - (SELECT count(*) FROM p WHERE kind = 'risk' AND place <= 3) END"""))
def alert_feed(spark, sf_dir):
    return fin.alert_feed(company(spark, sf_dir), flat(spark, sf_dir))


@query("recent_feed", views.oracle("""SELECT kind, label, happened_at FROM (
 SELECT 'company_added' AS kind, name || ' added to portfolio' AS label, TIMESTAMP '2001-01-01' + INTERVAL 1 HOUR * (company_id % 5000) AS happened_at FROM fin_company
 UNION ALL SELECT 'financials_added', c.name || ' ' || f.period || ' financials added', f.updated_at FROM financials f JOIN fin_company c USING (company_id))
 ORDER BY happened_at DESC, label LIMIT 8"""))
def recent_feed(spark, sf_dir):
    c = company(spark, sf_dir)
    added = c.select(F.lit("company_added").alias("kind"), F.concat("name", F.lit(" added to portfolio")).alias("label"),
                     F.expr("TIMESTAMP '2001-01-01' + make_dt_interval(0, cast(company_id % 5000 as int))").alias("happened_at"))
    stated = flat(spark, sf_dir).join(c.select("company_id", "name"), "company_id").select(
        F.lit("financials_added").alias("kind"), F.concat("name", F.lit(" "), "period", F.lit(" financials added")).alias("label"),
        F.col("updated_at").alias("happened_at"))
    return added.unionByName(stated).orderBy(F.col("happened_at").desc(), "label").limit(8)


_POS = ["revenue", "net_margin", "roe", "debt_equity", "eps", "financial_score"]


@query("sector_position", fin_sql(f"""WITH l AS (SELECT w.company_id, c.name, c.sector, {", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in _POS)} FROM win w JOIN fin_company c USING (company_id)
  WHERE recency = 1 AND c.sector IS NOT NULL), u AS (UNPIVOT l ON {", ".join(_POS)} INTO NAME metric VALUE value),
 v AS (SELECT *, CASE WHEN metric = 'debt_equity' THEN -value ELSE value END AS s FROM u)
 SELECT company_id, metric, sector, value, round_even(avg(value) OVER (PARTITION BY sector, metric), 4) AS sector_avg, count(*) OVER (PARTITION BY sector, metric) AS peers,
  first_value(value) OVER (PARTITION BY sector, metric ORDER BY s DESC, company_id) AS top, first_value(name) OVER (PARTITION BY sector, metric ORDER BY s DESC, company_id) AS top_name,
  rank() OVER (PARTITION BY sector, metric ORDER BY s DESC) AS rank,
  CASE WHEN rank() OVER (PARTITION BY sector, metric ORDER BY s DESC) <= greatest(1, round_even(count(*) OVER (PARTITION BY sector, metric) / 3.0::DOUBLE, 0)) THEN 'Outperformer'
   WHEN rank() OVER (PARTITION BY sector, metric ORDER BY s DESC) > count(*) OVER (PARTITION BY sector, metric) - greatest(1, round_even(count(*) OVER (PARTITION BY sector, metric) / 3.0::DOUBLE, 0)) THEN 'Underperformer'
   ELSE 'In-line' END AS market_position FROM v"""))
def sector_position(spark, sf_dir):
    latest = fin.with_prior(fin.with_flat_ratios(flat(spark, sf_dir)), [], "label", 0).where("recency = 1")
    named = latest.join(company(spark, sf_dir).select("company_id", "name", "sector"), "company_id")
    return fin.sector_position(named, _POS).drop("name", "signed").withColumns({
        "sector_avg": F.bround("sector_avg", 4), "market_position": fin.market_position(F.col("rank"), F.col("peers"))})


@query("revenue_cagr", views.oracle("""WITH a AS (SELECT company_id, fiscal_year AS year, revenue AS value FROM financials WHERE revenue IS NOT NULL),
 b AS (SELECT company_id, min(year) AS first_year, max(year) AS last_year, count(*) AS points, arg_min(value, year) AS v0, arg_max(value, year) AS v1 FROM a GROUP BY company_id)
 SELECT company_id, first_year, last_year, points, round_even(CASE WHEN v0 > 0 AND v1 >= 0 AND last_year > first_year THEN
  CASE WHEN v1 = 0 THEN -100.0 ELSE (exp((ln(CASE WHEN v1 > 0 THEN v1 END) - ln(CASE WHEN v0 > 0 THEN v0 END)) / (last_year - first_year)) - 1) * 100 END END, 6) AS cagr FROM b"""))
def revenue_cagr(spark, sf_dir):
    long = flat(spark, sf_dir).select("company_id", F.col("fiscal_year").alias("year"), F.col("revenue").alias("value"))
    return fin.series_cagr(long, ["company_id"]).withColumn("cagr", F.bround("cagr", 6))


_YEARS = ["FY2023", "FY2024", "FY2025"]
_MATRIX = ["turnover", "board_size", "chairperson_annual_retainer", "profit_margin"]


@query("comparison_matrix", crow_sql(f"""WITH m AS (SELECT company_id, fiscal_year, {", ".join(_MATRIX)} FROM crow),
 lm AS (SELECT * FROM (UNPIVOT m ON {", ".join(_MATRIX)} INTO NAME metric VALUE value) WHERE fiscal_year IN ('FY2023', 'FY2024', 'FY2025')),
 w AS (SELECT company_id, metric, max(value) FILTER (WHERE fiscal_year = 'FY2023') AS a, max(value) FILTER (WHERE fiscal_year = 'FY2024') AS b,
  max(value) FILTER (WHERE fiscal_year = 'FY2025') AS c FROM lm GROUP BY ALL)
 SELECT company_id, metric, round_even(a, 3) AS FY2023, round_even(b, 3) AS FY2024, round_even(c, 3) AS FY2025, round_even(c - a, 3) AS change,
  round_even((c - a) / nullif(abs(a), 0) * 100, 3) AS change_pct,
  round_even(CASE WHEN a > 0 AND c = 0 THEN -100 WHEN a > 0 AND c > 0 THEN (exp((ln(CASE WHEN c > 0 THEN c END) - ln(CASE WHEN a > 0 THEN a END)) / 2) - 1) * 100 END, 3) AS cagr FROM w"""))
def comparison_matrix(spark, sf_dir):
    long = sv.unpivot(rows(spark, sf_dir), ["company_id", "fiscal_year"], _MATRIX)
    out = fin.comparison_matrix(long, ["company_id"], _YEARS)
    return out.withColumns({c: F.bround(c, 3) for c in [*_YEARS, "change", "change_pct", "cagr"]})


@query("matched_cohort", crow_sql("""SELECT company_id, fiscal_year, round_even(profit_margin, 3) AS profit_margin FROM crow WHERE fiscal_year IN ('FY2023', 'FY2024', 'FY2025')
 AND company_id IN (SELECT company_id FROM crow WHERE fiscal_year IN ('FY2023', 'FY2024', 'FY2025') GROUP BY 1 HAVING count(DISTINCT fiscal_year) = 3)"""))
def matched_cohort(spark, sf_dir):
    return fin.matched_cohort(rows(spark, sf_dir), _YEARS).select("company_id", "fiscal_year", F.bround("profit_margin", 3).alias("profit_margin"))


_RANKED = ["net_profit", "turnover", "ceo_monthly_salary", "chairperson_annual_retainer", "other_ned_annual_retainer"]


@query("rankings_movement", crow_sql(f"""WITH m AS (SELECT company_id, currency, fiscal_year, {", ".join(_RANKED)} FROM crow),
 lm AS (UNPIVOT m ON {", ".join(_RANKED)} INTO NAME metric VALUE value),
 r AS (SELECT *, rank() OVER (PARTITION BY metric, currency, fiscal_year ORDER BY value DESC) AS rk FROM lm)
 SELECT metric, currency, company_id, max(rk) FILTER (WHERE fiscal_year = 'FY2023') AS first_rank, max(rk) FILTER (WHERE fiscal_year = 'FY2025') AS last_rank,
  max(rk) FILTER (WHERE fiscal_year = 'FY2023') - max(rk) FILTER (WHERE fiscal_year = 'FY2025') AS movement
 FROM r WHERE fiscal_year IN ('FY2023', 'FY2024', 'FY2025') GROUP BY ALL"""))
def rankings_movement(spark, sf_dir):
    long = sv.unpivot(rows(spark, sf_dir), ["company_id", "currency", "fiscal_year"], _RANKED).where(F.col("fiscal_year").isin(*_YEARS))
    ranked = stats.competition_rank(long, ["metric", "currency", "fiscal_year"], "value")
    first = F.max(F.when(F.col("fiscal_year") == _YEARS[0], F.col("rank")))
    last = F.max(F.when(F.col("fiscal_year") == _YEARS[-1], F.col("rank")))
    return ranked.groupBy("metric", "currency", "company_id").agg(first.alias("first_rank"), last.alias("last_rank"), (first - last).alias("movement"))


_DASH = {"chairperson_annual_retainer": "money", "other_ned_annual_retainer": "money", "other_ned_meeting_allowance": "money",
         "total_directors_fees": "money", "ceo_monthly_cost_of_employment": "money", "kmp_total": "money", "board_size": "count",
         "women_on_board_pct": "pct", "independent_pct": "pct", "board_meetings_per_year": "count", "board_attendance_pct": "pct",
         "profit_margin": "pct", "staff_cost_per_employee": "money", "women_in_workforce_pct": "pct",
         "audit_fee_pct_of_turnover": "pct", "payout_ratio_pct": "pct"}
_KIND_SQL = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{k}'" for m, k in _DASH.items()) + " END"


def dashboard_kind():
    return F.element_at(F.create_map(*[F.lit(x) for p in _DASH.items() for x in p]), F.col("metric"))


@query("market_position_by_metric", crow_sql(f"""WITH m AS (SELECT company_id, fiscal_year, {", ".join(_DASH)} FROM crow),
 lm AS (UNPIVOT m ON {", ".join(_DASH)} INTO NAME metric VALUE value),
 p AS (SELECT *, count(*) OVER g AS companies, rank() OVER (PARTITION BY fiscal_year, metric ORDER BY value DESC) AS rk,
   rank() OVER (PARTITION BY fiscal_year, metric ORDER BY value) - 1 AS below, count(*) OVER (PARTITION BY fiscal_year, metric, value) - 1 AS eq
   FROM lm WINDOW g AS (PARTITION BY fiscal_year, metric))
 SELECT company_id, fiscal_year, metric, round_even(value, 3) AS value, companies,
  CASE WHEN companies >= 3 THEN CAST(round_even((below + eq / 2.0::DOUBLE) / (companies - 1) * 100, 0) AS BIGINT) END AS percentile,
  CASE WHEN companies >= 3 THEN rk END AS rank FROM p"""))
def market_position_by_metric(spark, sf_dir):
    long = sv.unpivot(rows(spark, sf_dir), ["company_id", "fiscal_year"], list(_DASH))
    return stats.percentile_position(long, ["fiscal_year", "metric"], "value").withColumn("value", F.bround("value", 3))


def _ar(x):
    return f"CASE WHEN {_KIND_SQL} = 'money' THEN round_even({x}, 0) WHEN abs({x}) < 1 THEN round_even({x}, 2) ELSE round_even({x}, 1) END"


@query("market_benchmarks", crow_sql(f"""WITH m AS (SELECT company_id, fiscal_year, {", ".join(_DASH)} FROM crow),
 lm AS (UNPIVOT m ON {", ".join(_DASH)} INTO NAME metric VALUE value),
 g AS (SELECT fiscal_year, metric, count(*) AS companies, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, min(value) AS lo, max(value) AS hi
  FROM lm GROUP BY ALL HAVING count(*) >= 3)
 SELECT fiscal_year, metric, companies, {_ar('md')} AS median, {_ar('q1')} AS p25, {_ar('q3')} AS p75, {_ar('lo')} AS min, {_ar('hi')} AS max FROM g"""))
def market_benchmarks(spark, sf_dir):
    """Market median, middle half and extremes of the dashboard metrics, at least three companies."""
    long = sv.unpivot(rows(spark, sf_dir), ["company_id", "fiscal_year"], list(_DASH))
    out = stats.percentiles(long, ["fiscal_year", "metric"], "value", (0.25, 0.5, 0.75), ["p25", "median", "p75"], min_count=3, digits=None,
                            extra=[F.min("value").alias("min"), F.max("value").alias("max")]).where("n >= 3")
    return out.select("fiscal_year", "metric", F.col("n").alias("companies"),
                      *[adaptive_round(c, dashboard_kind()).alias(c) for c in ("median", "p25", "p75", "min", "max")])


@query("sector_medians", crow_sql(f"""WITH m AS (SELECT company_id, fiscal_year, sector, {", ".join(_DASH)} FROM crow WHERE sector IS NOT NULL),
 lm AS (UNPIVOT m ON {", ".join(_DASH)} INTO NAME metric VALUE value)
 SELECT fiscal_year, sector, metric, count(*) AS sector_companies, CASE WHEN count(*) >= 2 THEN round_even(quantile_cont(value, 0.5), 3) END AS sector_median FROM lm GROUP BY ALL"""))
def sector_medians(spark, sf_dir):
    long = sv.unpivot(rows(spark, sf_dir).where("sector IS NOT NULL"), ["company_id", "fiscal_year", "sector"], list(_DASH))
    out = stats.percentiles(long, ["fiscal_year", "sector", "metric"], "value", (0.5,), ["sector_median"], digits=3)
    return out.select("fiscal_year", "sector", "metric", F.col("n").alias("sector_companies"), "sector_median")


@query("change_against_own_past", crow_sql(f"""WITH m AS (SELECT company_id, fiscal_year, {", ".join(_DASH)} FROM crow),
 lm AS (UNPIVOT m ON {", ".join(_DASH)} INTO NAME metric VALUE value),
 p AS (SELECT a.company_id, a.fiscal_year, a.metric, a.value, b.value AS pv FROM lm a JOIN lm b ON a.company_id = b.company_id AND a.metric = b.metric
   AND CAST(substr(b.fiscal_year, 3) AS INT) = CAST(substr(a.fiscal_year, 3) AS INT) - 1)
 SELECT company_id, fiscal_year, metric, CASE WHEN {_KIND_SQL} = 'pct' THEN CASE WHEN round_even(value - pv, 1) = 0 THEN 0 ELSE round_even(value - pv, 1) END END AS change_pts,
  CASE WHEN {_KIND_SQL} <> 'pct' THEN round_even((value - pv) / nullif(abs(pv), 0) * 100, 1) END AS change_pct FROM p"""))
def change_against_own_past(spark, sf_dir):
    """Each company's metric against its own previous year: points for percentages, percent for the rest."""
    from ..operators.peers import own_change
    long = sv.unpivot(rows(spark, sf_dir), ["company_id", "fiscal_year"], list(_DASH)).withColumn("kind", dashboard_kind())
    return own_change(long).drop("kind", "value", "prior_value")


_HEAD = ["ceo_monthly_cost_of_employment", "chairperson_annual_retainer", "other_ned_annual_retainer", "other_ned_meeting_allowance",
         "women_on_board_pct", "board_attendance_pct"]


@query("like_for_like", crow_sql(f"""WITH m AS (SELECT company_id, fiscal_year, {", ".join(_HEAD)} FROM crow),
 lm AS (UNPIVOT m ON {", ".join(_HEAD)} INTO NAME metric VALUE value),
 p AS (SELECT a.metric, a.value AS now, b.value AS prev FROM lm a JOIN lm b USING (company_id, metric) WHERE a.fiscal_year = 'FY2025' AND b.fiscal_year = 'FY2024'),
 g AS (SELECT metric, count(*) AS like_for_like, quantile_cont(now, 0.5) AS mn, quantile_cont(prev, 0.5) AS mp, count(*) FILTER (WHERE now > prev) AS rose, count(*) FILTER (WHERE now < prev) AS fell FROM p GROUP BY metric)
 SELECT metric, like_for_like, CASE WHEN like_for_like >= 3 AND metric NOT LIKE '%_pct' THEN round_even((mn - mp) / nullif(abs(mp), 0) * 100, 1) END AS change_pct,
  CASE WHEN like_for_like >= 3 AND metric LIKE '%_pct' THEN round_even(mn - mp, 1) END AS change_pts,
  CASE WHEN like_for_like >= 3 THEN rose END AS rose, CASE WHEN like_for_like >= 3 THEN fell END AS fell FROM g"""))
def like_for_like(spark, sf_dir):
    from ..operators.peers import like_for_like as lfl
    long = sv.unpivot(rows(spark, sf_dir), ["company_id", "fiscal_year"], _HEAD).withColumn("kind", dashboard_kind())
    return lfl(long, "FY2025", "FY2024")


_ITEM_ORDER = "CASE normalized_name WHEN 'revenue' THEN 0 WHEN 'net_income' THEN 1 WHEN 'total_assets' THEN 2 WHEN 'total_liabilities' THEN 3 WHEN 'total_equity' THEN 4 WHEN 'gross_profit' THEN 5 WHEN 'operating_profit' THEN 6 WHEN 'eps' THEN 7 ELSE 8 END"


@query("aligned_statements", fin_sql(f"""WITH u AS (SELECT company_id, recency, normalized_name AS line_key, amount, {_ITEM_ORDER} AS o,
   CASE WHEN normalized_name LIKE 'total%' THEN 'balance_sheet' ELSE 'income_statement' END AS statement_type
   FROM (UNPIVOT (SELECT company_id, recency, revenue, net_income, total_assets, total_liabilities, total_equity, gross_profit, operating_profit, eps, shares_outstanding FROM win WHERE recency <= 3)
   ON revenue, net_income, total_assets, total_liabilities, total_equity, gross_profit, operating_profit, eps, shares_outstanding INTO NAME normalized_name VALUE amount)),
 g AS (SELECT company_id, statement_type, line_key, max(amount) FILTER (WHERE recency = 1) AS amount_1, max(amount) FILTER (WHERE recency = 2) AS amount_2,
  max(amount) FILTER (WHERE recency = 3) AS amount_3, min(recency * 100 + o) AS f FROM u GROUP BY ALL)
 SELECT company_id, statement_type, line_key, amount_1, amount_2, amount_3, round_even({pct('amount_1', 'amount_2')}, 4) AS yoy_change_pct,
  CAST(f // 100 AS INT) AS first_recency, CAST(f % 100 AS INT) AS first_order FROM g""", "normalised"))
def aligned_statements(spark, sf_dir):
    f = flat(spark, sf_dir)
    recency = fin.with_prior(f, [], "normalised", 0).select("company_id", "period", "recency")
    items = fin.flat_to_line_items(f).join(recency, ["company_id", "period"]).withColumn("label", F.initcap(F.replace("normalized_name", F.lit("_"), F.lit(" "))))
    return fin.align_statements(items).drop("label").withColumn("yoy_change_pct", F.bround("yoy_change_pct", 4))


@query("prior_period_asof", views.oracle("""WITH p AS (SELECT id, company_id, fiscal_year, CASE WHEN period LIKE 'FY%' THEN 'annual' ELSE 'interim' END AS period_type FROM financials),
 j AS (SELECT a.id, a.company_id, a.fiscal_year, a.period_type, b.fiscal_year AS prior_year, b.id AS prior_id, row_number() OVER (PARTITION BY a.id ORDER BY b.fiscal_year DESC NULLS LAST, b.id DESC) AS rn
  FROM p a LEFT JOIN p b ON a.company_id = b.company_id AND a.period_type = b.period_type AND b.fiscal_year < a.fiscal_year)
 SELECT id, company_id, fiscal_year, period_type, prior_year, prior_id FROM j WHERE rn = 1"""))
def prior_period_asof(spark, sf_dir):
    p = flat(spark, sf_dir).select("id", "company_id", "fiscal_year", F.when(F.col("period").startswith("FY"), "annual").otherwise("interim").alias("period_type"))
    return fin.prior_period(p)


@query("identity_checks", views.oracle("""SELECT company_id, period, total_assets - (total_liabilities + total_equity) AS balance_gap,
 abs(total_assets - (total_liabilities + total_equity)) <= greatest(2, 0.002::DOUBLE * greatest(abs(total_assets), abs(total_liabilities + total_equity))) AS balance_ok
 FROM financials"""))
def identity_checks(spark, sf_dir):
    return fin.identity_checks(flat(spark, sf_dir)).select("company_id", "period", "balance_gap", "balance_ok")


@query("derived_liabilities", views.oracle("""SELECT company_id, period, coalesce(total_liabilities, total_assets - total_equity) AS total_liabilities,
 total_liabilities IS NULL AS liabilities_derived FROM financials"""))
def derived_liabilities(spark, sf_dir):
    return fin.derive_total_liabilities(flat(spark, sf_dir)).select("company_id", "period", "total_liabilities", "liabilities_derived")


@query("current_prior_split", views.oracle("""SELECT company_id, period, revenue AS amount, 'current' AS "column" FROM financials WHERE revenue IS NOT NULL
 UNION ALL SELECT company_id, replace(period, CAST(fiscal_year AS VARCHAR), CAST(fiscal_year - 1 AS VARCHAR)), gross_profit, 'prior' FROM financials WHERE gross_profit IS NOT NULL"""))
def current_prior_split(spark, sf_dir):
    items = flat(spark, sf_dir).select("company_id", "period", F.col("revenue").alias("current_amount"), F.col("gross_profit").alias("prior_amount"))
    return fin.split_current_prior(items, ["company_id"])


@query("available_periods", views.oracle("SELECT DISTINCT period, fiscal_year AS year FROM financials"))
def available_periods(spark, sf_dir):
    return flat(spark, sf_dir).select("period", labels.year_of("period").alias("year")).distinct()


@query("compare_at_period", fin_sql("""SELECT c.company_id, c.name, w.period, w.revenue, round_even(w.roe, 4) AS roe, w.financial_score FROM fin_company c LEFT JOIN (SELECT * FROM win WHERE recency = 1) w USING (company_id)"""))
def compare_at_period(spark, sf_dir):
    return fin.compare_at_period(company(spark, sf_dir), flat(spark, sf_dir), None).select(
        "company_id", "name", "period", "revenue", F.bround("roe", 4).alias("roe"), "financial_score")


@query("companies_by_revenue", fin_sql("""SELECT c.company_id, c.name, w.revenue, w.financial_score FROM fin_company c LEFT JOIN (SELECT * FROM win WHERE recency = 1) w USING (company_id)
 ORDER BY w.revenue DESC NULLS LAST, c.company_id"""))
def companies_by_revenue(spark, sf_dir):
    """The company list, largest revenue first."""
    listed = fin.compare_at_period(company(spark, sf_dir), flat(spark, sf_dir), None)
    return listed.orderBy(F.col("revenue").desc_nulls_last(), "company_id").select("company_id", "name", "revenue", "financial_score")
