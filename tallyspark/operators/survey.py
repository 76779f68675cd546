"""Company-year benchmarking: currency and unit normalisation, company rows, market and sector figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as fl
from ..functions import labels, money
from ..functions.numeric import clamp, ratio
from . import stats

HEADLINE = [f for f, _ in fl.OVERVIEW]
SECTOR_PAY = [f for f, _ in fl.POLICY] + ["ceo_monthly_salary", "ceo_monthly_cost_of_employment"]
BOARD_AVERAGES = [
    "board_size", "board_meetings_per_year", "committees_per_board", "committee_meetings_per_year",
    "avg_age_executive_directors", "avg_age_non_executive_directors", "avg_age_independent_neds",
    "avg_age_non_independent_neds",
]
BOARD_TOTALS = [
    "directors_female", "directors_male", "executive_directors_count", "non_executive_directors_count",
    "independent_neds_count", "non_independent_neds_count", "neds_kenyan_count", "neds_non_kenyan_count",
]
RATIO_PAIRS = [
    ("chairperson_annual_retainer", "other_ned_annual_retainer"),
    ("chairperson_meeting_allowance", "other_ned_meeting_allowance"),
    ("committee_chair_annual_retainer", "committee_member_annual_retainer"),
    ("committee_chair_meeting_allowance", "committee_member_meeting_allowance"),
]
KMP_PARTS = [
    "kmp_short_term_benefits", "kmp_post_employment_benefits", "kmp_share_based_payments", "kmp_termination_benefits",
]


def full_years(survey: DataFrame) -> DataFrame:
    return survey.where(labels.is_full_year("fiscal_year"))


def available_years(survey: DataFrame) -> DataFrame:
    return full_years(survey).select("fiscal_year").distinct()


def default_year(survey: DataFrame) -> DataFrame:
    """One row: the latest full year on file."""
    return full_years(survey).agg(F.max(labels.fy_key("fiscal_year"))["label"].alias("fiscal_year"))


def latest_year_only(survey: DataFrame) -> DataFrame:
    """Rows of the latest full year (a scalar subquery, so nothing is collected)."""
    return survey.where(F.col("fiscal_year") == default_year(survey).scalar())


def survey_currency(survey: DataFrame) -> DataFrame:
    """Most common currency per year; ties go to the first in the alphabet."""
    stated = survey.select("fiscal_year", money.currency_of("currency").alias("survey_currency"))
    return stats.modal_value(stated, ["fiscal_year"], "survey_currency").select("fiscal_year", "survey_currency")


def with_rate(df: DataFrame, rates: DataFrame, target: str = "survey_currency", source: str = "reported_currency",
              year: str = "fiscal_year", name: str = "fx") -> DataFrame:
    """Units of ``target`` per unit of ``source`` for the label's year, crossed through the dollar.

    1 for the same currency, NULL when either rate is missing.
    """
    side = rates
    to = side.select(F.col("currency").alias("__tc"), F.col("year").alias("__ty"), F.col("per_usd").alias("__t"))
    fr = side.select(F.col("currency").alias("__sc"), F.col("year").alias("__sy"), F.col("per_usd").alias("__s"))
    y = labels.rate_year(year)
    return (
        df.withColumn("__y", y)
        .join(to, (F.col(target) == F.col("__tc")) & (F.col("__y") == F.col("__ty")), "left")
        .join(fr, (F.col(source) == F.col("__sc")) & (F.col("__y") == F.col("__sy")), "left")
        .withColumn(name, F.when(F.col(target) == F.col(source), F.lit(1.0)).otherwise(F.try_divide("__t", "__s")))
        .drop("__y", "__tc", "__ty", "__t", "__sc", "__sy", "__s")
    )


def with_company(survey: DataFrame, company: DataFrame) -> DataFrame:
    """Company name, ticker and sector; the survey's own sector wins. Spark sizes the join itself."""
    c = company.select("company_id", "name", "ticker", F.col("sector").alias("__sector"))
    return survey.join(c, "company_id").withColumn("sector", F.coalesce("sector", "__sector")).drop("__sector")


def normalised(survey: DataFrame, company: DataFrame, rates: DataFrame) -> DataFrame:
    """Survey rows with company, currencies, rate and the two unit scales attached."""
    full = full_years(survey)
    df = full.join(survey_currency(full), "fiscal_year")
    df = df.withColumn("reported_currency", money.currency_of("currency"))
    df = with_rate(with_company(df, company), rates)
    return df.withColumn("headline_scale", money.scale_headline("unit")).withColumn(
        "pay_scale", money.scale_pay("director_figures_unit"))


def headline_millions(field: str) -> Column:
    return F.expr(f"{field} * (headline_scale / 1000000.0D * fx)")


def pay_value(field: str) -> Column:
    return F.expr(f"{field} * pay_scale * fx")


def field_value(field: str) -> Column:
    """One figure made comparable by its kind: headline, pay and per-share money converted, the rest as stated."""
    kind = fl.KIND[field]
    if kind == "headline":
        return F.expr(f"{field} * headline_scale * fx")
    if kind == "pay":
        return pay_value(field)
    if kind == "pershare":
        return F.expr(f"{field} * fx")
    if kind in ("text", "yesno"):
        return F.expr(f"nullif({field}, '')")
    return F.col(field)


def kmp_total(total: Column, parts: list[Column]) -> Column:
    """The stated total, else the stated parts added up - salaries (the first part) must be among them."""
    added = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.coalesce(total, F.when(parts[0].isNotNull(), added))


def governance(indep="independent_neds_count", non_indep="non_independent_neds_count",
               female="directors_female", male="directors_male") -> Column:
    """Illustrative score: up to 50 points each for a third of independents and a third of women.

    One unknown half scales the known one to 100; both unknown give NULL.
    """
    third = 1.0 / 3.0
    ip = F.try_divide(F.col(indep), F.col(indep) + F.col(non_indep))
    gp = F.try_divide(F.col(female), F.col(female) + F.col(male))

    def part(p: Column) -> Column:
        return F.when(p.isNotNull(), F.least(F.lit(50.0), F.bround(50 * p / third, 0)))

    both = part(ip) + part(gp)
    one = F.coalesce(part(ip), part(gp))
    return F.struct(
        F.bround(F.coalesce(both, one * 2), 0).alias("score"),
        F.bround(ip * 100, 1).alias("independence_pct"), F.bround(gp * 100, 1).alias("gender_pct"),
        F.coalesce(ip >= third, F.lit(False)).alias("independence_compliant"),
        F.coalesce(gp >= third, F.lit(False)).alias("gender_compliant"),
    )


def company_rows(norm: DataFrame) -> DataFrame:
    """One comparable row per company-year: whole survey currency, margin, governance, implausible field names."""
    kes = F.col("survey_currency") == money.HOME_CURRENCY
    cols, bad = {}, []
    for f in HEADLINE:
        full = F.col(f) * (F.col("headline_scale") * F.col("fx"))
        too_big = F.coalesce(kes & (F.abs(full) > money.CEILING_MILLIONS[f] * 1e6), F.lit(False))
        cols[f] = F.when(~too_big, full)
        bad.append(F.when(too_big, F.lit(f)))
    for f in fl.NUMERIC_FIELDS:
        if f not in HEADLINE:
            cols[f] = field_value(f)
    for f in fl.YESNO_FIELDS + fl.TEXT_FIELDS:
        cols[f] = field_value(f)
    ident = [
        "company_id", "name", "ticker", "sector", "fiscal_year", F.col("survey_currency").alias("currency"), "unit",
        "reported_currency",
        F.when(F.col("reported_currency") != F.col("survey_currency"), F.bround("fx", 6)).alias("fx_rate"),
    ]
    raw_turnover = F.col("turnover") * F.col("headline_scale") * F.col("fx")
    base = norm.select(
        *ident, *[c.alias(f) for f, c in cols.items()],
        F.array_compact(F.array(*bad)).alias("implausible_fields"),
        raw_turnover.alias("turnover_full"), governance().alias("governance"),
    )
    eps = F.col("earnings_per_share")
    retainers = [F.col(f) for f in ("chairperson_annual_retainer", "other_ned_annual_retainer",
                                    "executive_director_annual_retainer")]
    return base.select(
        "*",
        ratio("net_profit", "turnover", 100).alias("profit_margin"),
        F.when(F.coalesce(*retainers).isNotNull(),
               F.bround(reduce(lambda a, b: a + b, [F.coalesce(r, F.lit(0.0)) for r in retainers]), 2)
               ).alias("total_director_remuneration"),
        kmp_total(F.col("kmp_total_compensation"), [F.col(p) for p in KMP_PARTS]).alias("kmp_total"),
        ratio("staff_costs", "employees_count").alias("staff_cost_per_employee"),
        ratio("staff_costs", "turnover_full", 100).alias("staff_costs_pct_of_turnover"),
        ratio("audit_fee", "turnover_full", 100).alias("audit_fee_pct_of_turnover"),
        F.when(eps > 0, ratio("dividend_per_share", eps, 100)).alias("payout_ratio_pct"),
        ratio("directors_female", F.col("directors_female") + F.col("directors_male"), 100).alias("women_on_board_pct"),
        clamp(ratio("independent_neds_count", "board_size", 100), -1e300, 100.0).alias("independent_pct"),
    )


def unpivot(df: DataFrame, keys: list[str], fields: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Long form with the missing values left out (they count for nothing downstream)."""
    return df.unpivot(keys, [F.expr(f"CAST({f} AS DOUBLE) AS {f}") for f in fields], name, value).where(F.col(value).isNotNull())


def metric_table(long: DataFrame, keys: list[str], gate_n: int = stats.MIN_COMPANIES) -> DataFrame:
    """average, p25, p50, p75 and company_count per (keys, metric), gated."""
    out = stats.percentiles(
        long, [*keys, "metric"], "value", min_count=gate_n,
        extra=[stats.gated_avg("value", gate_n).alias("average")],
    )
    return out.select(*keys, "metric", "average", "p25", "p50", "p75", F.col("n").alias("company_count"))


def overview_figures(norm: DataFrame) -> DataFrame:
    """Every averaged figure of the survey overview, as (fiscal_year, company_id, metric, value)."""
    kes_rule = {f: money.plausible(headline_millions(f), f, F.col("survey_currency")) for f in HEADLINE}
    df = norm.select(
        "fiscal_year", "company_id", *[c.alias(f) for f, c in kes_rule.items()],
        *BOARD_AVERAGES, *[pay_value(f).alias(f) for f in fl.PAY_FIELDS],
    ).withColumn("profit_margin", ratio("net_profit", "turnover", 100))
    return unpivot(df, ["fiscal_year", "company_id"], [*HEADLINE, "profit_margin", *BOARD_AVERAGES, *fl.PAY_FIELDS])


def board_totals(norm: DataFrame) -> DataFrame:
    return norm.groupBy("fiscal_year").agg(
        F.count(F.lit(1)).alias("companies_with_data"),
        stats.sum_or_null(money.plausible(headline_millions("market_cap"), "market_cap", F.col("survey_currency"))).alias("total_market_cap"),
        *[stats.sum_or_null(f).alias(f"total_{f}") for f in BOARD_TOTALS],
    )


def paired_ratios(norm: DataFrame) -> DataFrame:
    return norm.groupBy("fiscal_year").agg(*[
        stats.paired_ratio(pay_value(hi), pay_value(lo)).alias(f"{hi}_vs_{lo}") for hi, lo in RATIO_PAIRS
    ])


def sector_comparison(norm: DataFrame) -> DataFrame:
    """Per sector: gated averages of pay, how many companies, and the lone figure where exactly one states it."""
    exprs = []
    for f in SECTOR_PAY:
        v = pay_value(f)
        exprs += [
            stats.gated_avg(v).alias(f"avg_{f}"), F.count(v).alias(f"avg_{f}_company_count"),
            F.when(F.count(v) == 1, F.max(v)).alias(f"single_{f}"),
        ]
    sector = F.coalesce("sector", F.lit("Unclassified")).alias("sector")
    return norm.groupBy("fiscal_year", sector).agg(F.count(F.lit(1)).alias("company_count"), *exprs)


def benefit_coverage(survey: DataFrame) -> DataFrame:
    """Share of companies providing each benefit, among those that addressed it at all."""
    rows = survey.select("fiscal_year", F.explode("ned_benefits").alias("benefit_key", "b"))
    return rows.groupBy("fiscal_year", "benefit_key").agg(
        F.bround(F.avg(F.coalesce(F.col("b.provided"), F.lit(False)).cast("double")) * 100, 1).alias("percent_provided"),
        F.count(F.lit(1)).alias("companies_addressing"),
    )


def normalisation_report(norm: DataFrame) -> DataFrame:
    """Excluded, converted and implausible company figures, one row each."""
    cur, home = F.col("reported_currency"), F.col("survey_currency")
    no_rate, no_unit = F.col("fx").isNull(), F.col("headline_scale").isNull()
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")

    def note(status: str, field: Column, reason: Column, value: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), field.alias("field"), reason.alias("reason"), value.alias("full_value"))

    no_rate_text = F.concat(F.lit("no exchange rate "), cur, F.lit(" to "), home)
    no_unit_text = F.concat(F.lit("unrecognised unit "), F.coalesce("unit", F.lit("")))
    notes = [
        F.when(no_rate, note("excluded", none_s, no_rate_text, none_d)),
        F.when(~no_rate & (cur != home), note("converted", none_s, cur, F.bround("fx", 6))),
        F.when(~no_rate & no_unit, note("excluded", none_s, no_unit_text, none_d)),
    ]
    for f in HEADLINE:
        full = headline_millions(f)
        notes.append(F.when((home == money.HOME_CURRENCY) & (F.abs(full) > money.CEILING_MILLIONS[f]),
                            note("implausible", F.lit(f), F.lit("above the credible ceiling"), F.bround(full * 1e6, 0))))
    return norm.select("fiscal_year", "company_id", "name", F.explode(F.array_compact(F.array(*notes))).alias("x")).select(
        "fiscal_year", "company_id", "name", "x.*")


def yesno_share(rows: DataFrame, fields: list[str]) -> DataFrame:
    """yes, no, answered and % yes per year and question. The companies behind each answer are ``yesno_companies``."""
    return yesno_companies(rows, fields).groupBy("fiscal_year", "field").agg(
        F.count_if(F.col("answer") == "y").alias("yes"), F.count_if(F.col("answer") == "n").alias("no"),
        F.count(F.lit(1)).alias("answered"),
        F.bround(F.try_divide(F.count_if(F.col("answer") == "y") * 100.0, F.count(F.lit(1))), 1).alias("pct_yes"),
    )


def yesno_companies(rows: DataFrame, fields: list[str]) -> DataFrame:
    return (
        rows.unpivot(["fiscal_year", "company_id", "name"], fields, "field", "raw")
        .withColumn("answer", labels.answer_side("raw")).where(F.col("answer").isNotNull()).drop("raw")
    )


def label_shares(rows: DataFrame, field: str) -> DataFrame:
    """Companies and share per label, spellings of one firm merged (the alphabetically first spelling is shown)."""
    stated = rows.where(F.col(field) != "").select("fiscal_year", F.trim(field).alias("label"), labels.share_key(field).alias("key"))
    counts = stated.groupBy("fiscal_year", "key").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("companies"))
    totals = counts.groupBy("fiscal_year").agg(F.sum("companies").alias("__t"))
    return counts.join(totals, "fiscal_year").select(
        "fiscal_year", "key", "label", "companies",
        F.bround(F.try_divide(F.col("companies") * 100.0, F.col("__t")), 1).alias("pct"))


def opinion_counts(rows: DataFrame, field: str = "audit_opinion") -> DataFrame:
    t = F.trim(field)
    label = F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.expr(f"substring(trim({field}), 2)")))
    return rows.where(F.col(field) != "").groupBy("fiscal_year", label.alias("opinion")).agg(F.count(F.lit(1)).alias("companies"))


def extended_stats(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Metric table plus min and max per (year, field)."""
    long = unpivot(rows, ["fiscal_year", "company_id"], fields)
    g = stats.MIN_COMPANIES
    out = stats.percentiles(long, ["fiscal_year", "metric"], "value", extra=[
        stats.gated_avg("value").alias("average"),
        F.when(F.count("value") >= g, F.bround(F.min("value"), 2)).alias("min"),
        F.when(F.count("value") >= g, F.bround(F.max("value"), 2)).alias("max"),
    ])
    return out.select("fiscal_year", "metric", "average", "p25", "p50", "p75", "min", "max", F.col("n").alias("company_count"))


def leaders(rows: DataFrame, fields: list[str], k: int = 5, low_is_good: bool = False) -> DataFrame:
    """Top ``k`` companies per (year, metric), names breaking ties."""
    long = unpivot(rows, ["fiscal_year", "company_id", "name"], fields)
    value = F.col("value").asc() if low_is_good else F.col("value").desc()
    return stats.top_k(long, ["fiscal_year", "metric"], [value, F.col("name"), F.col("company_id")], k).withColumn(
        "value", F.bround("value", 2))


def director_attendance(directors: DataFrame) -> DataFrame:
    """Per year: mean attendance of directors (capped at 100 %), full and below 75 %."""
    pct = F.least(F.lit(100.0), F.try_divide(F.col("board_meetings_attended") * 100.0, F.col("board_meetings_eligible")))
    d = directors.where(F.col("board_meetings_attended").isNotNull() & (F.col("board_meetings_eligible") != 0)).withColumn("__p", pct)
    return d.groupBy("fiscal_year").agg(
        F.count(F.lit(1)).alias("directors"), F.bround(F.avg("__p"), 1).alias("average_pct"),
        F.count_if(F.col("__p") >= 100).alias("full_attendance"), F.count_if(F.col("__p") < 75).alias("below_75"),
        F.count_distinct("company_id").alias("companies"),
    )


def overview(norm: DataFrame, directors: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole survey overview as tables, for one year or for every year at once."""
    rows = company_rows(norm)
    extended = [f for f in fl.EXTENDED_FIELDS if fl.KIND[f] not in ("text", "yesno")] + [
        "kmp_total", "staff_cost_per_employee", "staff_costs_pct_of_turnover", "audit_fee_pct_of_turnover", "payout_ratio_pct"]
    out = {
        "metrics": metric_table(overview_figures(norm), ["fiscal_year"]), "totals": board_totals(norm), "pay_ratios": paired_ratios(norm),
        "sectors": sector_comparison(norm), "companies": rows.select("company_id", "fiscal_year", "name", "sector"),
        "normalisation": normalisation_report(norm), "extended": extended_stats(rows, extended), "answers": yesno_share(norm, fl.YESNO_FIELDS),
        "auditors": label_shares(norm, "auditor_name"), "governance_auditors": label_shares(norm, "governance_audit_by"), "opinions": opinion_counts(norm),
    }
    if "ned_benefits" in norm.columns:
        out["benefits"] = benefit_coverage(norm)
    if directors is not None:
        out["attendance"] = director_attendance(directors)
    return out
