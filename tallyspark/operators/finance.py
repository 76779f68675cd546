"""Statement figures: ratios, health score, risk rules, growth, peers and statement alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import cagr, clamp, pct_change, ratio
from . import stats

# Figures the ratio set is worked out from.
RATIO_INPUTS = [
    "revenue", "net_income", "total_assets", "total_liabilities", "total_equity", "gross_profit", "operating_profit",
    "eps", "shares_outstanding",
]
# Ratio name and the formula text stored with it.
FORMULAS = [
    ("net_margin", "net_income / revenue * 100"), ("gross_margin", "gross_profit / revenue * 100"),
    ("operating_margin", "operating_profit / revenue * 100"), ("roe", "net_income / total_equity * 100"),
    ("debt_equity", "total_liabilities / total_equity"), ("roa", "net_income / total_assets * 100"),
    ("debt_assets", "total_liabilities / total_assets"),
]
SCORE_BANDS = (70, 40)
ALERT_TITLES = {
    "High Debt": "High Debt Alert", "Falling Profit": "Profit Declining", "Revenue Decline": "Revenue Slowing",
    "Weak Financial Health": "Weak Financial Health",
}


def financial_score(net_margin, roe, debt_equity) -> Column:
    """0-100 health score: 40 % margin, 40 % return on equity, 20 % low leverage; all three inputs needed."""
    m, r, d = (F.col(x) if isinstance(x, str) else x for x in (net_margin, roe, debt_equity))
    blend = clamp(m * 2.5) * 0.4 + clamp(r * 2.5) * 0.4 + clamp(F.lit(100.0) - d * 10) * 0.2
    return F.bround(clamp(blend), 0).cast("int")


def score_band(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= SCORE_BANDS[0], "strong").when(s >= SCORE_BANDS[1], "moderate").when(s.isNotNull(), "weak")


def with_flat_ratios(df: DataFrame) -> DataFrame:
    """Margin, ROE, debt/equity, score and band on the flat five-figure table."""
    df = df.withColumns({
        "net_margin": ratio("net_income", "revenue", 100), "roe": ratio("net_income", "total_equity", 100),
        "debt_equity": ratio("total_liabilities", "total_equity"),
    }).withColumn("financial_score", financial_score("net_margin", "roe", "debt_equity"))
    return df.withColumn("score_band", score_band("financial_score"))


def amounts_by_name(items: DataFrame, keys: list[str], order: str = "order_index", names: list[str] = RATIO_INPUTS) -> DataFrame:
    """First amount in print order per normalised name, one wide row per period (map-side combined)."""
    def first(name: str) -> Column:
        hit = F.col("normalized_name") == name
        return F.min_by(F.when(hit, F.col("amount")), F.when(hit & F.col("amount").isNotNull(), F.col(order))).alias(name)

    return items.where(F.col("normalized_name").isin(*names)).groupBy(*keys).agg(*[first(n) for n in names])


def flat_to_line_items(flat: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Flat figures as statement lines; company periods that already have statements are skipped."""
    if existing is not None:
        flat = flat.join(existing.select("company_id", "period").distinct(), ["company_id", "period"], "left_anti")
    figures = [c for c in RATIO_INPUTS if c in flat.columns]
    kind = F.when(F.col("normalized_name").isin("total_assets", "total_liabilities", "total_equity"), "balance_sheet").otherwise("income_statement")
    order = F.create_map(*[F.lit(x) for i, f in enumerate(figures) for x in (f, i)])
    return flat.unpivot(["company_id", "period"], figures, "normalized_name", "amount").where(F.col("amount").isNotNull()).select(
        "company_id", "period", kind.alias("statement_type"), "normalized_name", "amount",
        F.element_at(order, F.col("normalized_name")).alias("order_index"))


def with_ratios(wide: DataFrame) -> DataFrame:
    return wide.withColumns({
        "net_margin": ratio("net_income", "revenue", 100), "gross_margin": ratio("gross_profit", "revenue", 100),
        "operating_margin": ratio("operating_profit", "revenue", 100), "roe": ratio("net_income", "total_equity", 100),
        "debt_equity": ratio("total_liabilities", "total_equity"), "roa": ratio("net_income", "total_assets", 100),
        "debt_assets": ratio("total_liabilities", "total_assets"),
        "eps_value": F.coalesce("eps", ratio("net_income", "shares_outstanding")),
    })


def ratio_metrics(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Long (keys, metric_name, value, formula_description); ratios without a value give no row."""
    df = with_ratios(wide)
    entries = [F.struct(F.lit(n).alias("metric_name"), F.col(n).alias("value"), F.lit(t).alias("formula_description")) for n, t in FORMULAS]
    entries.append(F.struct(F.lit("eps").alias("metric_name"), F.col("eps_value").alias("value"),
                            F.when(F.col("eps").isNotNull(), "as reported").otherwise("net_income / shares_outstanding").alias("formula_description")))
    return df.select(*keys, F.explode(F.array(*entries)).alias("m")).select(*keys, "m.*").where(F.col("value").isNotNull())


def period_order(order: str = "normalised") -> Column:
    """Sort key of a period: (year, annual first), or the plain label as the flat table orders it."""
    return labels.period_key("period") if order == "normalised" else F.col("period")


def with_prior(df: DataFrame, cols: list[str], order: str = "normalised", back: int = 2) -> DataFrame:
    """Each row with the same columns of the period before (``prior_``) and, for ``back=2``, the one before that."""
    w = W.partitionBy("company_id").orderBy(period_order(order).asc())
    out = df
    for i in range(1, back + 1):
        prefix = "prior_" if i == 1 else f"prior{i}_"
        out = out.withColumns({prefix + c: F.lag(c, i).over(w) for c in cols})
    return out.withColumn("recency", F.row_number().over(W.partitionBy("company_id").orderBy(period_order(order).desc())))


def yoy(df: DataFrame, order: str = "normalised") -> DataFrame:
    """Percent change of money and point change of ratios against the previous period."""
    cols = ["period", "revenue", "net_income", "net_margin", "roe"]
    p = with_prior(df, cols, order, 1)
    return p.withColumns({
        "revenue_yoy": pct_change("revenue", "prior_revenue"), "net_income_yoy": pct_change("net_income", "prior_net_income"),
        "net_margin_delta": F.col("net_margin") - F.col("prior_net_margin"), "roe_delta": F.col("roe") - F.col("prior_roe"),
    })


def last_scores(df: DataFrame, n: int = 8, order: str = "normalised") -> DataFrame:
    """The last ``n`` scores per company, oldest first, missing ones kept as NULL."""
    w = W.partitionBy("company_id").orderBy(period_order(order).asc()).rowsBetween(-(n - 1), 0)
    last = W.partitionBy("company_id").orderBy(period_order(order).desc())
    trend = F.transform(F.collect_list(F.struct("financial_score")).over(w), lambda s: s["financial_score"])
    return df.select("company_id", "period", trend.alias("score_trend"), F.row_number().over(last).alias("__r")).where("__r = 1").drop("__r")


def risk_candidates() -> Column:
    """Array of (severity, issue, amount) from leverage, falling profit, falling revenue; a weak score if nothing else."""
    income = pct_change("net_income", "prior_net_income")
    revenue = pct_change("revenue", "prior_revenue")

    def issue(sev: Column, name: str, amount: Column) -> Column:
        return F.struct(sev.cast("int").alias("severity"), F.lit(name).alias("issue"), amount.cast("double").alias("amount"))

    de = F.col("debt_equity")
    first = F.array_compact(F.array(
        F.when(de > 2.0, issue(F.when(de > 3.0, 3).otherwise(2), "High Debt", F.bround(de, 1))),
        F.when(income < 0, issue(F.when(income < -20, 3).otherwise(2), "Falling Profit", F.bround(F.abs(income), 0))),
        F.when(revenue < 0, issue(F.when(revenue < -15, 3).otherwise(2), "Revenue Decline", F.bround(F.abs(revenue), 0))),
    ))
    weak = F.array(issue(F.lit(2), "Weak Financial Health", F.col("financial_score")))
    return F.when((F.size(first) == 0) & (F.col("score_band") == "weak"), weak).otherwise(first)


def opportunity() -> Column:
    growth = pct_change("revenue", "prior_revenue")
    return F.when(growth > 20, F.bround(growth, 0))


def risk_score(debt_equity, current_ratio, interest_coverage, margin_delta) -> Column:
    """Weighted 0-100 risk; weights renormalise over the inputs that are present."""
    de, cr, ic, md = (F.col(x) if isinstance(x, str) else x for x in (debt_equity, current_ratio, interest_coverage, margin_delta))
    parts = [
        (0.35, clamp(de / 4 * 100)), (0.25, clamp((1.5 - F.when(cr.isNotNull(), F.least(cr, F.lit(1.5)))) / 1.5 * 100)),
        (0.25, clamp((8 - F.when(ic.isNotNull(), F.least(ic, F.lit(8.0)))) / 8 * 100)), (0.15, clamp(-md * 10)),
    ]
    total = reduce(lambda a, b: a + b, [F.coalesce(p * w, F.lit(0.0)) for w, p in parts])
    weight = reduce(lambda a, b: a + b, [F.when(p.isNotNull(), w).otherwise(0.0) for w, p in parts])
    return F.bround(F.try_divide(total, weight), 0)


def risk_band(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return (F.when(s <= 20, "Very Low Risk").when(s <= 40, "Low Risk").when(s <= 60, "Moderate Risk")
            .when(s <= 80, "High Risk").when(s.isNotNull(), "Very High Risk"))


def risk_exposures() -> Column:
    """Array of exposure names: leverage, liquidity, interest cover, margin compression."""
    return F.array_compact(F.array(
        F.when(F.col("debt_equity") > 2.0, "High Leverage"), F.when(F.col("current_ratio") < 1.0, "Liquidity Strain"),
        F.when(F.col("interest_coverage") < 2.0, "Weak Interest Coverage"),
        F.when(F.col("net_margin_delta") < -2, "Margin Compression"),
    ))


def strengths() -> Column:
    return F.array_compact(F.array(
        F.when(F.col("net_margin_delta") > 0, "Net margin improved"), F.when(F.col("roe_delta") > 0, "ROE improved"),
        F.when(F.col("revenue_yoy") > 0, "Revenue grew"), F.when(F.col("net_income_yoy") > 0, "Net profit grew"),
        F.when(F.col("score_band") == "strong", "Rated strong"),
    ))


def outlook() -> Column:
    """Positive / Negative when at least three of four change signals agree."""
    signals = F.array("revenue_yoy", "net_income_yoy", "roe_delta", "net_margin_delta")
    pos = F.size(F.filter(signals, lambda x: x > 0))
    neg = F.size(F.filter(signals, lambda x: x < 0))
    return F.when(pos >= 3, "Positive").when(neg >= 3, "Negative").otherwise("Neutral")


def portfolio_overview(company: DataFrame, flat: DataFrame, month_start: Column, order: str = "label") -> DataFrame:
    """One row of portfolio figures from the latest, prior and earlier period of every company.

    A revenue or profit of 0 is left out of the sums, as a missing one is.
    """
    rated = with_flat_ratios(flat)
    latest = with_prior(rated, ["period", "revenue", "net_income", "net_margin", "roe"], order, 2).where("recency = 1")
    fresh = F.coalesce(F.col("updated_at") >= month_start, F.lit(False))
    growth = pct_change("revenue", "prior_revenue")
    earlier = pct_change("prior_revenue", "prior2_revenue")
    rev, inc = F.when(F.col("revenue") != 0, F.col("revenue")), F.when(F.col("net_income") != 0, F.col("net_income"))
    prev = F.when(F.col("prior_revenue") != 0, F.col("prior_revenue"))
    pinc = F.when(F.col("prior_net_income") != 0, F.col("prior_net_income"))
    agg = latest.agg(
        F.count(F.lit(1)).alias("companies_with_data"), F.sum(rev).alias("combined_revenue"),
        F.sum(inc).alias("combined_net_income"), F.avg("net_margin").alias("avg_net_margin"), F.avg("roe").alias("avg_roe"),
        F.avg("financial_score").alias("avg_financial_score"), F.avg(growth).alias("avg_revenue_growth"),
        F.count_if(F.col("score_band") == "strong").alias("strong"), F.count_if(F.col("score_band") == "moderate").alias("moderate"),
        F.count_if(F.col("score_band") == "weak").alias("weak"), F.count_if(fresh).alias("updated_this_month"),
        F.count_if(fresh & (F.col("score_band") == "weak")).alias("high_risk_added_this_month"),
        F.max("updated_at").alias("last_updated"),
        pct_change(F.coalesce(F.sum(rev), F.lit(0.0)), F.sum(prev)).alias("combined_revenue_yoy"),
        pct_change(F.coalesce(F.sum(inc), F.lit(0.0)), F.sum(pinc)).alias("combined_income_yoy"),
        (F.avg("net_margin") - F.avg("prior_net_margin")).alias("net_margin_delta"),
        (F.avg("roe") - F.avg("prior_roe")).alias("roe_delta"),
        (F.avg(growth) - F.avg(earlier)).alias("revenue_growth_delta"),
    )
    total = company.agg(F.count(F.lit(1)).alias("total_companies")).scalar()
    return agg.withColumn("total_companies", total).withColumn(
        "updated_pct_of_total", F.try_divide(F.col("companies_with_data") * 100.0, F.col("total_companies")))


def one_per_year(flat: DataFrame) -> DataFrame:
    """The most recently updated non-zero revenue row per company and year."""
    rows = flat.withColumn("year", labels.year_of("period")).where(F.col("year").isNotNull() & (F.col("revenue") != 0))
    best = rows.groupBy("company_id", "year").agg(F.max(F.struct("updated_at", "id", "revenue")).alias("b"))
    return best.select("company_id", "year", "b.revenue")


def revenue_trend(flat: DataFrame, years: int = 4) -> DataFrame:
    """Combined revenue and growth of the last ``years`` years with data."""
    per_year = one_per_year(flat).groupBy("year").agg(F.sum("revenue").alias("combined_revenue"))
    last = per_year.orderBy(F.col("year").desc()).limit(years)
    w = W.partitionBy(F.lit(1)).orderBy("year")  # at most ``years`` rows
    return last.withColumn("growth_pct", pct_change("combined_revenue", F.lag("combined_revenue").over(w)))


def sector_rollup(company: DataFrame, flat: DataFrame, order: str = "label") -> DataFrame:
    """Company count, revenue, share of the total and averages per sector, from latest periods."""
    latest = with_prior(with_flat_ratios(flat), ["revenue"], order, 1).where("recency = 1")
    named = latest.join(company.where(F.col("sector") != "").select("company_id", "sector"), "company_id")
    per = named.groupBy("sector").agg(
        F.count(F.lit(1)).alias("company_count"), F.sum("revenue").alias("total_revenue"),
        F.bround(F.avg(pct_change("revenue", "prior_revenue")), 2).alias("avg_revenue_growth"),
        F.bround(F.avg("net_margin"), 2).alias("avg_net_margin"),
        F.bround(F.bround(F.avg("financial_score"), 2), 0).alias("avg_financial_score"),
    )
    total = per.agg(F.sum("total_revenue").alias("t")).scalar()
    return per.withColumn(
        "weight_pct", F.bround(F.try_divide(F.coalesce("total_revenue", F.lit(0.0)) * 100.0, total), 1))


def sector_performance(company: DataFrame, flat: DataFrame, k: int = 8, order: str = "label") -> DataFrame:
    latest = with_prior(with_flat_ratios(flat), [], order, 0).where("recency = 1 AND financial_score IS NOT NULL")
    named = latest.join(company.select("company_id", F.coalesce("sector", F.lit("Unclassified")).alias("sector")), "company_id")
    return (named.groupBy("sector").agg(F.bround(F.avg("financial_score"), 0).cast("int").alias("avg_score"))
            .orderBy(F.col("avg_score").desc(), "sector").limit(k))


def data_summary(flat: DataFrame) -> DataFrame:
    q = F.count_if(labels.is_quarterly("period"))
    return flat.agg(F.count(F.lit(1)).alias("total_statements"), q.alias("quarterly_reports"),
                    (F.count(F.lit(1)) - q).alias("annual_reports"), F.count_distinct("source").alias("data_sources"))


def alert_feed(company: DataFrame, flat: DataFrame, risks: int = 3, total: int = 4, order: str = "label") -> DataFrame:
    """Up to ``risks`` worst risks, filled up to ``total`` with opportunities; top rows are picked per kind."""
    full = alerts(company, flat, order)
    kind_order = [F.col("rank_key").asc(), F.when(F.col("kind") == "risk", F.col("last_updated")).asc(),
                  F.col("last_updated").desc(), F.col("company_id").asc()]
    best = stats.top_k(full, ["kind"], kind_order, total)
    n_risk = F.count_if((F.col("kind") == "risk") & (F.col("place") <= risks)).over(W.partitionBy(F.lit(1)))  # <= 8 rows
    return best.withColumn("__n", n_risk).where(
        F.when(F.col("kind") == "risk", F.col("place") <= risks).otherwise(F.col("place") <= total - F.col("__n"))
    ).drop("__n", "rank_key")


def alerts(company: DataFrame, flat: DataFrame, order: str = "label") -> DataFrame:
    """Every risk (the worst per company) and every opportunity."""
    latest = with_prior(with_flat_ratios(flat), ["period", "revenue", "net_income"], order, 1).where("recency = 1")
    named = latest.join(company.select("company_id", "name"), "company_id")
    titles = F.create_map(*[F.lit(x) for pair in ALERT_TITLES.items() for x in pair])
    place = F.create_map(*[F.lit(x) for i, k in enumerate(ALERT_TITLES) for x in (k, i)])
    cands = F.transform(risk_candidates(), lambda r: F.struct((-r["severity"]).alias("s"), F.element_at(place, r["issue"]).alias("i"), r.alias("r")))
    worst = F.array_min(cands)["r"]
    risk = F.when(F.size(cands) > 0, F.struct(
        F.lit("risk").alias("kind"), F.element_at(titles, worst["issue"]).alias("title"), worst["amount"].alias("amount"),
        F.when(worst["severity"] == 3, "High").otherwise("Medium").alias("severity"),
        F.when(worst["severity"] == 3, 0).otherwise(1).alias("rank_key")))
    opp = F.when(opportunity().isNotNull(), F.struct(
        F.lit("opportunity").alias("kind"), F.lit("Strong Opportunity").alias("title"), opportunity().alias("amount"),
        F.lit("Positive").alias("severity"), F.lit(0).alias("rank_key")))
    return named.select("company_id", "name", F.col("updated_at").alias("last_updated"),
                        F.explode(F.array_compact(F.array(risk, opp))).alias("x")).select("company_id", "name", "last_updated", "x.*")


def sector_position(latest: DataFrame, metrics: list[str], low_is_good: tuple[str, ...] = ("debt_equity",)) -> DataFrame:
    """Per company and metric: sector average, best value and its company, and the company's rank in the sector."""
    long = latest.where(F.col("sector").isNotNull()).unpivot(
        ["company_id", "name", "sector"], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value"
    ).where(F.col("value").isNotNull())
    low = F.col("metric").isin(*low_is_good)
    signed = F.when(low, -F.col("value")).otherwise(F.col("value"))
    sector = long.withColumn("__s", signed).groupBy("sector", "metric").agg(
        F.avg("value").alias("sector_avg"), F.count(F.lit(1)).alias("peers"),
        F.max(F.struct(F.col("__s"), (-F.col("company_id")).alias("c"), "name", "value")).alias("t"))
    ranked = stats.competition_rank(long.withColumn("signed", signed), ["sector", "metric"], "signed", "rank").drop("n", "signed")
    return ranked.join(sector.select("sector", "metric", "sector_avg", "peers", F.col("t.value").alias("top"), F.col("t.name").alias("top_name")),
                       ["sector", "metric"])


def market_position(rank: Column, peers: Column) -> Column:
    third = F.greatest(F.lit(1), F.bround(peers / 3.0, 0))
    return F.when(rank <= third, "Outperformer").when(rank > peers - third, "Underperformer").otherwise("In-line")


def series_cagr(long: DataFrame, keys: list[str]) -> DataFrame:
    """Compound growth between the first and last year on record per series (``year``, ``value``)."""
    rows = long.where(F.col("value").isNotNull())
    ends = rows.groupBy(*keys).agg(
        F.min(F.struct("year", "value")).alias("a"), F.max(F.struct("year", "value")).alias("b"), F.count(F.lit(1)).alias("points"))
    return ends.select(*keys, F.col("a.year").alias("first_year"), F.col("b.year").alias("last_year"), "points",
                       cagr(F.col("a.value"), F.col("b.value"), F.col("b.year") - F.col("a.year")).alias("cagr"))


def comparison_matrix(long: DataFrame, keys: list[str], years: list[str]) -> DataFrame:
    """metric x year matrix with change, percent change and compound growth between the first and last year."""
    wide = long.where(F.col("fiscal_year").isin(*years)).groupBy(*keys, "metric").pivot("fiscal_year", years).agg(F.max("value"))
    a, b = F.col(years[0]), F.col(years[-1])
    span = int(years[-1][2:]) - int(years[0][2:])
    return wide.withColumns({"change": b - a, "change_pct": pct_change(b, a), "cagr": cagr(a, b, F.lit(span))})


def matched_cohort(rows: DataFrame, years: list[str], key: str = "company_id") -> DataFrame:
    """Rows of the companies present in every one of 2 to 10 selected years."""
    if not 2 <= len(set(years)) <= 10:
        raise ValueError("select between 2 and 10 years")
    picked = rows.where(F.col("fiscal_year").isin(*years))
    flags = [F.max(F.when(F.col("fiscal_year") == y, 1).otherwise(0)).alias(f"y{i}") for i, y in enumerate(years)]
    full = picked.groupBy(key).agg(*flags).where(reduce(lambda a, b: a & b, [F.col(f"y{i}") == 1 for i in range(len(years))]))
    return picked.join(full.select(key), key, "left_semi")


def align_statements(items: DataFrame, periods: int = 3) -> DataFrame:
    """Line items of each company's newest periods side by side, keyed by normalised name else label.

    Sort by (first_recency, first_order, line_key) for the order of first appearance, newest period first.

    ``items`` has company_id, statement_type, recency (1 = newest), normalized_name, label, amount, order_index.
    """
    key = F.coalesce("normalized_name", "label")
    rows = items.where(F.col("recency") <= periods).withColumn("line_key", key)
    last = F.struct(F.col("order_index"), F.col("amount"), F.col("label"))
    cells = [F.max(F.when(F.col("recency") == i, last)).alias(f"c{i}") for i in range(1, periods + 1)]
    wide = rows.groupBy("company_id", "statement_type", "line_key").agg(
        F.min(F.struct("recency", "order_index")).alias("first_seen"), *cells)
    return wide.select(
        "company_id", "statement_type", "line_key",
        F.coalesce(*[F.col(f"c{i}.label") for i in range(1, periods + 1)]).alias("label"),
        *[F.col(f"c{i}.amount").alias(f"amount_{i}") for i in range(1, periods + 1)],
        pct_change(F.col("c1.amount"), F.col("c2.amount")).alias("yoy_change_pct"),
        F.col("first_seen.recency").alias("first_recency"), F.col("first_seen.order_index").alias("first_order"))


def prior_period(periods: DataFrame) -> DataFrame:
    """Each period with the newest earlier year of the same company and period type."""
    w = W.partitionBy("company_id", "period_type").orderBy("fiscal_year").rangeBetween(W.unboundedPreceding, -1)
    latest = F.max(F.struct("fiscal_year", F.col("id").alias("pid"))).over(w)
    return periods.withColumns({"prior_year": latest["fiscal_year"], "prior_id": latest["pid"]})


def identity_checks(wide: DataFrame) -> DataFrame:
    """assets = liabilities + equity and profit - tax = net income, within max(2, 0.2 %)."""
    def off(a: Column, b: Column) -> Column:
        return F.abs(a - b) > F.greatest(F.lit(2.0), F.lit(0.002) * F.greatest(F.abs(a), F.abs(b)))

    bs = F.col("total_liabilities") + F.col("total_equity")
    pl = F.col("profit_before_tax") - F.col("tax") if "tax" in wide.columns else F.lit(None).cast("double")
    return wide.withColumns({
        "balance_ok": ~off(F.col("total_assets"), bs), "balance_gap": F.col("total_assets") - bs,
        "profit_ok": ~off(F.col("net_income"), pl) if "tax" in wide.columns else F.lit(None).cast("boolean"),
    })


def derive_total_liabilities(wide: DataFrame) -> DataFrame:
    return wide.withColumns({
        "liabilities_derived": F.col("total_liabilities").isNull() & F.col("total_assets").isNotNull() & F.col("total_equity").isNotNull(),
        "total_liabilities": F.coalesce("total_liabilities", F.col("total_assets") - F.col("total_equity")),
    })


def split_current_prior(items: DataFrame, keys: list[str]) -> DataFrame:
    """Two-column statement lines as one row per period, empty cells dropped; the prior label is one year back."""
    cells = F.array(
        F.struct(F.col("period").alias("period"), F.col("current_amount").alias("amount"), F.lit("current").alias("column")),
        F.struct(labels.prior_label("period").alias("period"), F.col("prior_amount").alias("amount"), F.lit("prior").alias("column")))
    rest = [c for c in items.columns if c not in ("period", "current_amount", "prior_amount") and c not in keys]
    return items.select(*keys, *rest, F.explode(cells).alias("c")).select(*keys, *rest, "c.*").where(
        F.col("amount").isNotNull() & F.col("period").isNotNull())


def compare_at_period(company: DataFrame, flat: DataFrame, period: str | None, order: str = "label") -> DataFrame:
    """One row per company at a period label, or at its latest period; missing companies keep NULLs."""
    picked = flat.where(F.col("period") == period) if period else with_prior(flat, [], order, 0).where("recency = 1").drop("recency")
    return company.select("company_id", "name").join(with_flat_ratios(picked), "company_id", "left")


def sort_companies(df: DataFrame, mode: str = "name") -> DataFrame:
    """Company list by name, score or revenue; missing figures last."""
    if mode == "name":
        return df.orderBy(F.lower("name"), "company_id")
    column = {"score": "financial_score", "revenue": "revenue"}[mode]
    return df.orderBy(F.col(column).desc_nulls_last(), F.lower("name"), "company_id")


def company_snapshot(company: DataFrame, flat: DataFrame, order: str = "normalised") -> DataFrame:
    """One row per company for its latest period: figures, changes, health and risk score, outlook, growth, sector place."""
    rated = with_flat_ratios(flat)
    y = yoy(rated, order)
    if "current_ratio" not in y.columns:
        y = y.withColumns({"current_ratio": F.lit(None).cast("double"), "interest_coverage": F.lit(None).cast("double")})
    score = risk_score("debt_equity", "current_ratio", "interest_coverage", "net_margin_delta")
    latest = y.withColumns({"risk_score": score, "outlook": outlook(), "strengths": strengths(), "exposures": risk_exposures()}).where("recency = 1")
    growth = series_cagr(flat.select("company_id", F.col("fiscal_year").alias("year"), F.col("revenue").alias("value")), ["company_id"]).select(
        "company_id", F.col("cagr").alias("revenue_cagr"), F.col("points").alias("years_on_record"))
    named = company.select("company_id", "name", "sector")
    place = sector_position(latest.select("company_id", "financial_score").join(named, "company_id"), ["financial_score"]).select(
        "company_id", F.col("rank").alias("sector_rank"), "peers", market_position(F.col("rank"), F.col("peers")).alias("market_position"))
    cols = ["company_id", "period", "revenue", "revenue_yoy", "net_income", "net_income_yoy", "net_margin", "net_margin_delta", "roe", "roe_delta",
            "debt_equity", "financial_score", "score_band", "risk_score", "outlook", "strengths", "exposures"]
    return latest.select(*cols).join(named, "company_id").join(growth, "company_id", "left").join(place, "company_id", "left").withColumn(
        "risk_band", risk_band("risk_score"))
