"""Data quality: field status, scores, consistency rules, audit flags, gaps and pay-row cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as fl
from ..functions import labels, money
from ..functions.numeric import accounting_number, is_number
from . import stats
from .carry import pin

LOW_CONFIDENCE = 0.75
REVIEW_FLOOR = 0.45


def grade(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 75, "Good").when(s >= 50, "Fair").otherwise("Needs Attention")


def _status_sql(field: str) -> str:
    """Status of one field as SQL text: one parse for a whole field list is far cheaper to build than nested columns."""
    return (f"CASE WHEN {field} IS NULL OR trim(CAST({field} AS STRING)) = '' THEN 'missing' "
            f"WHEN try_element_at(field_confidence, '{field}') < {LOW_CONFIDENCE} THEN 'needs_review' ELSE 'complete' END")


def field_status(survey: DataFrame, fields: list[str], keys: tuple[str, ...] = ("company_id", "fiscal_year")) -> DataFrame:
    """Long (keys, field, status): complete, needs_review (confidence below 0.75) or missing.

    One explode per row inside the scan stage; nothing is shuffled here.
    """
    cells = ", ".join(f"struct('{f}' AS field, \"{fl.SECTION[f]}\" AS section, {_status_sql(f)} AS status)" for f in fields)
    return survey.select(*keys, F.expr(f"explode(array({cells})) AS x")).select(*keys, "x.*")


def row_status_counts(survey: DataFrame, fields: list[str]) -> DataFrame:
    """complete / needs_review / missing of each row as columns, without exploding."""
    statuses = F.expr(f"array({', '.join(_status_sql(f) for f in fields)}) AS __st")
    return survey.select("*", statuses).select(
        *survey.columns, *[F.expr(f"size(filter(__st, s -> s = '{k}')) AS {k}") for k in ("complete", "needs_review", "missing")])


def company_quality(survey: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per survey row: counts, score (share of complete fields) and grade."""
    fields = fields or fl.CORE_FIELDS
    counted = row_status_counts(survey, fields)
    score = F.bround(F.col("complete") / float(len(fields)) * 100, 0).cast("int")
    return counted.select("company_id", "fiscal_year", "complete", "needs_review", "missing",
                          F.lit(len(fields)).alias("total"), score.alias("score"), grade(score).alias("grade"))


def section_quality(survey: DataFrame) -> DataFrame:
    """Per company row and section: counts and score."""
    st = field_status(survey, fl.CORE_FIELDS)
    done = F.count_if(F.col("status") == "complete")
    return st.groupBy("company_id", "fiscal_year", "section").agg(
        done.alias("complete"), F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("status") == "missing").alias("missing"),
        F.bround(F.try_divide(done * 100.0, F.count(F.lit(1))), 0).alias("score"))


def portfolio_quality(survey: DataFrame) -> DataFrame:
    """Per year: mean of company scores, pooled score, and the best and lowest company."""
    q = company_quality(survey)
    best = F.max(F.struct(F.col("score"), (-F.col("company_id")).alias("c")))
    low = F.min(F.struct(F.col("score"), (-F.col("company_id")).alias("c")))
    return q.groupBy("fiscal_year").agg(
        F.count(F.lit(1)).alias("companies_counted"), F.bround(F.avg("score"), 0).alias("average_score"),
        F.bround(F.try_divide(F.sum("complete") * 100.0, F.sum("total")), 0).alias("pooled_score"),
        F.sum("complete").alias("complete"), F.sum("needs_review").alias("needs_review"), F.sum("missing").alias("missing"),
        (-best["c"]).alias("best_company"), (-low["c"]).alias("lowest_company"))


def latest_rows(survey: DataFrame) -> DataFrame:
    """Each company's newest survey row: the latest label is found by aggregation, then semi-joined."""
    newest = survey.groupBy("company_id").agg(F.max("fiscal_year").alias("fiscal_year"))
    return survey.join(newest, ["company_id", "fiscal_year"], "left_semi")


def portfolio_counts(survey: DataFrame) -> DataFrame:
    """complete / needs_review / missing over the latest row of every company."""
    c = row_status_counts(latest_rows(survey), fl.PORTFOLIO_QUALITY_FIELDS)
    return c.agg(F.sum("complete").alias("complete"), F.sum("needs_review").alias("needs_review"), F.sum("missing").alias("missing"),
                 F.count(F.lit(1)).alias("companies_counted"))


def not_on_file(company: DataFrame, survey: DataFrame, year: str) -> DataFrame:
    return company.join(survey.where(F.col("fiscal_year") == year), "company_id", "left_anti").select("company_id", "name")


def missing_ranking(company: DataFrame, survey: DataFrame) -> DataFrame:
    """Every company by fewest missing fields, then score, then name; numbered without a one-task window."""
    q = company_quality(latest_rows(survey))
    n = len(fl.CORE_FIELDS)
    rows = company.select("company_id", "name").join(q, "company_id", "left").select(
        "company_id", "name", "fiscal_year", F.coalesce("missing", F.lit(n)).alias("missing"), F.coalesce("score", F.lit(0)).alias("score"),
        F.col("fiscal_year").isNotNull().alias("has_data"))
    return stats.number_rows(rows, [F.col("missing"), -F.col("score"), F.lower(F.coalesce("name", F.lit(""))), F.col("company_id")])


def review_buckets(survey: DataFrame) -> DataFrame:
    """Field lists per row: high confidence, to review, and scored but not yet reviewed (a ``reviewed`` array column)."""
    conf = F.col("field_confidence")
    keys = lambda m: F.array_sort(F.map_keys(m))
    return survey.select(
        "company_id", "fiscal_year", keys(F.map_filter(conf, lambda k, v: v >= LOW_CONFIDENCE)).alias("high"),
        keys(F.map_filter(conf, lambda k, v: (v >= REVIEW_FLOOR) & (v < LOW_CONFIDENCE))).alias("review"),
        F.array_sort(F.array_except(F.map_keys(conf), F.col("reviewed"))).alias("pending"))


def review_progress(survey: DataFrame) -> DataFrame:
    """Share of scored fields a person has reviewed, and the resulting status."""
    scored = F.size(F.map_keys("field_confidence"))
    done = F.size(F.array_intersect(F.map_keys("field_confidence"), F.col("reviewed")))
    pct = F.when(scored == 0, 100).otherwise(F.bround(F.try_divide(done * 100.0, scored), 0)).cast("int")
    return survey.select("company_id", "fiscal_year", pct.alias("progress_pct"),
                         F.when(pct == 100, "completed").when(pct > 0, "in-progress").otherwise("pending").alias("review_status"))


def completeness(company: DataFrame, survey: DataFrame, pay: DataFrame, committees: DataFrame, fields: list[str]) -> DataFrame:
    """40 for a survey row, up to 9 for its filled fields, 40 for pay rows, 20 for committees."""
    filled = reduce(lambda a, b: a + b, [F.col(f).isNotNull().cast("int") for f in fields])
    s = latest_rows(survey).select("company_id", (40 + F.least(F.lit(9), F.floor(filled / 4))).alias("s"))
    p = pay.select("company_id").distinct().withColumn("p", F.lit(40))
    c = committees.select("company_id").distinct().withColumn("c", F.lit(20))
    out = company.select("company_id").join(s, "company_id", "left").join(p, "company_id", "left").join(c, "company_id", "left")
    return out.select("company_id", (F.coalesce("s", F.lit(0)) + F.coalesce("p", F.lit(0)) + F.coalesce("c", F.lit(0))).cast("int").alias("completeness"))


# Sums that must hold, ranges, ages and chair / member pairs of the consistency rules.
SUM_RULES = [
    (("executive_directors_count", "non_executive_directors_count"), "board_size"),
    (("independent_neds_count", "non_independent_neds_count"), "non_executive_directors_count"),
    (("directors_female", "directors_male"), "board_size"),
    (("neds_kenyan_count", "neds_non_kenyan_count"), "non_executive_directors_count"),
]
RANGES = [("board_size", 3, 25, "error"), ("board_meetings_per_year", 1, 30, "warning"),
          ("committees_per_board", 1, 15, "warning"), ("committee_meetings_per_year", 1, 150, "warning")]
AGES = ["avg_age_executive_directors", "avg_age_non_executive_directors", "avg_age_independent_neds", "avg_age_non_independent_neds"]
CEO_PARTS = ["ceo_monthly_salary", "ceo_monthly_allowances", "ceo_monthly_incentive_bonus", "ceo_monthly_deferred_incentive",
             "ceo_monthly_non_cash_benefits", "ceo_monthly_pension", "ceo_monthly_gratuity", "ceo_monthly_share_value"]
CHAIR_PAIRS = [("chairperson_annual_retainer", "other_ned_annual_retainer"), ("chairperson_meeting_allowance", "other_ned_meeting_allowance"),
               ("committee_chair_annual_retainer", "committee_member_annual_retainer"),
               ("committee_chair_meeting_allowance", "committee_member_meeting_allowance")]


def consistency_issues(survey: DataFrame) -> DataFrame:
    """One row per broken rule: (company_id, fiscal_year, rule, field, severity, amount)."""
    c = F.col

    def issue(cond: Column, rule: str, field: str, severity: str, amount: Column) -> Column:
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(field).alias("field"), F.lit(severity).alias("severity"),
                                     amount.cast("double").alias("amount")))

    checks = []
    for (a, b), total in SUM_RULES:
        checks.append(issue(F.abs(c(a) + c(b) - c(total)) > 0.5, f"sum:{a}", total, "error", c(a) + c(b)))
    for f, lo, hi, sev in RANGES:
        checks.append(issue(~c(f).between(lo, hi), "range", f, sev, c(f)))
    for f in AGES:
        checks.append(issue(~c(f).between(25, 95), "age", f, "error", c(f)))
    sal, ann = c("ceo_monthly_salary"), c("ceo_annual_salary_as_stated")
    checks.append(issue((sal != 0) & (ann != 0) & (F.abs(ann / 12 - sal) > F.greatest(F.lit(1.0), 0.02 * sal)),
                        "annual_vs_monthly", "ceo_monthly_salary", "error", ann / 12))
    parts = reduce(lambda x, y: x + y, [F.coalesce(c(f), F.lit(0.0)) for f in CEO_PARTS])
    tot = c("ceo_monthly_cost_of_employment")
    checks.append(issue((tot != 0) & (parts > tot * 1.02), "ceo_parts", "ceo_monthly_cost_of_employment", "error", parts))
    for a, b in CHAIR_PAIRS:
        checks.append(issue(c(a) < c(b), "chair_below_member", a, "warning", c(a)))
    t, p = c("turnover"), c("net_profit")
    checks.append(issue((t != 0) & (p != 0) & (F.abs(p) > F.abs(t)), "profit_over_turnover", "net_profit", "warning", p))
    unit = F.lower(F.coalesce(F.when(c("unit") != "", c("unit")), F.lit("millions")))
    scale = F.try_element_at(F.create_map(*[F.lit(x) for pair in money.HEADLINE_SCALE.items() for x in pair]), unit)
    home = F.coalesce(F.when(c("currency") != "", c("currency")), F.lit(money.HOME_CURRENCY)) == money.HOME_CURRENCY
    for f, ceiling in money.CEILING_MILLIONS.items():
        checks.append(issue(home & (F.abs(c(f)) * scale / 1e6 > ceiling), "above_ceiling", f, "error", c(f)))
    return survey.select("company_id", "fiscal_year", F.explode(F.array_compact(F.array(*checks))).alias("x")).select(
        "company_id", "fiscal_year", "x.*")


def repeated_figures(survey: DataFrame, fields: list[str], headline: tuple[str, ...] = ("turnover", "net_profit", "market_cap")) -> DataFrame:
    """Company-year pairs that share exact non-zero figures (an equi join on the figure, not on the company)."""
    long = survey.unpivot(["company_id", "fiscal_year"], [F.col(f).cast("double").alias(f) for f in fields], "field", "value").where(
        F.col("value").isNotNull() & (F.col("value") != 0))
    later = long.withColumnRenamed("fiscal_year", "later_year")
    same = long.withColumnRenamed("fiscal_year", "earlier_year").join(later, ["company_id", "field", "value"]).where(
        F.col("earlier_year") < F.col("later_year"))
    return same.groupBy("company_id", "earlier_year", "later_year").agg(
        F.count(F.lit(1)).alias("same_values"), F.count_if(F.col("field").isin(*headline)).alias("same_headline")).where(
        (F.col("same_headline") > 0) | (F.col("same_values") >= 2)).withColumn(
        "severity", F.when(F.col("same_headline") > 0, "error").otherwise("warning"))


def pay_audit_flags(pay: DataFrame) -> DataFrame:
    """Flags per printed total: non-finite, above turnover, above 100x the CEO's yearly cost, unit missing or unknown.

    ``pay`` has total, unit, turnover_full and ceo_annual, and may have previous_unit, the unit the figures were shown in before: a change of
    scale is flagged. Rows without a flag are left out.
    """
    amount = F.col("total").cast("double") * money.scale_pay("unit")
    u = F.lower(F.trim(F.coalesce("unit", F.lit(""))))
    known = u.isin(*money.PAY_SCALE)
    finite = is_number(amount)
    flags = F.array_compact(F.array(
        F.when(F.col("total").isNotNull() & ~finite, "non_finite"),
        F.when(finite & (F.col("turnover_full") > 0) & (F.abs(amount) > F.col("turnover_full")), "pay_exceeds_turnover"),
        F.when(finite & (F.col("ceo_annual") > 0) & (F.abs(amount) > F.col("ceo_annual") * 100), "pay_over_100x_ceo_cost"),
        F.when(F.col("total").isNotNull() & (u == ""), "missing_unit"), F.when(F.col("total").isNotNull() & (u != "") & ~known, "unknown_unit"),
        *([F.when(F.col("total").isNotNull() & (money.scale_pay("previous_unit") != money.scale_pay("unit")), "scale_changed")] if "previous_unit" in pay.columns else [])))
    return pay.withColumns({"amount": amount, "flags": flags}).where(F.size("flags") > 0)


def reconcile(rows: DataFrame, keys: list[str], amount: str = "amount", is_total: str = "is_total", unit_scale: Column | None = None) -> DataFrame:
    """Per table: sum of named rows against the printed total, within half a unit per row; confidence .9 / .75 / .6.

    Decimal sums, so rounding never depends on row order. NULL where a named amount is missing.
    """
    dec = F.col(amount).cast("decimal(38,6)")
    named, printed = ~F.col(is_total), F.col(is_total)
    g = rows.groupBy(*keys).agg(
        F.sum(F.when(named, dec)).alias("named_sum"), F.count_if(named).alias("named_rows"),
        F.count_if(named & F.col(amount).isNull()).alias("missing"), F.max(F.when(printed, dec)).alias("printed_total"))
    complete = (F.col("missing") == 0) & (F.col("named_rows") > 0) & F.col("printed_total").isNotNull()
    diff = F.when(complete, F.col("named_sum") - F.col("printed_total"))
    scale = unit_scale if unit_scale is not None else F.lit(1)
    within = F.abs(diff) <= (F.col("named_rows") + 1) / F.lit(2)
    return g.select(*keys, "named_rows", (diff * scale).cast("double").alias("difference"), within.alias("within_rounding"),
                    F.when(within, 0.9).when(F.col("printed_total").isNotNull(), 0.75).otherwise(0.6).alias("confidence"))


def derive_composition(register: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and ages from a register; a count appears only when every row states the fact it counts."""
    ned, ex = F.col("role") == "non_executive", F.col("role") == "executive"
    roles_known = F.bool_and(F.coalesce(ned | ex, F.lit(False)))
    ind_known = roles_known & F.bool_and(F.when(ned, F.col("independent").isNotNull()).otherwise(True))
    nat_known = roles_known & (F.count_if(ned) > 0) & F.bool_and(F.when(ned, labels.has_value("nationality")).otherwise(True))
    gen_known = F.bool_and(labels.has_value("gender"))
    kenyan = ned & F.lower(F.trim("nationality")).isin("kenyan", "kenya")

    def age(group: Column, known: Column) -> Column:
        ages = F.when(group & (F.col("age") > 0), F.col("age"))
        return F.when(known & (F.count_if(group) > 0) & (F.count(ages) == F.count_if(group)), F.bround(F.avg(ages), 1))

    ind = ned & F.col("independent")
    return register.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("board_size"),
        F.when(roles_known, F.count_if(ex)).alias("executive_directors_count"),
        F.when(roles_known, F.count_if(ned)).alias("non_executive_directors_count"),
        F.when(ind_known, F.count_if(ind)).alias("independent_neds_count"),
        F.when(ind_known, F.count_if(ned) - F.count_if(ind)).alias("non_independent_neds_count"),
        F.when(nat_known, F.count_if(kenyan)).alias("neds_kenyan_count"),
        F.when(nat_known, F.count_if(ned) - F.count_if(kenyan)).alias("neds_non_kenyan_count"),
        F.when(gen_known, F.count_if(F.col("gender") == "Female")).alias("directors_female"),
        F.when(gen_known, F.count(F.lit(1)) - F.count_if(F.col("gender") == "Female")).alias("directors_male"),
        age(ex, roles_known).alias("avg_age_executive_directors"), age(ned, roles_known).alias("avg_age_non_executive_directors"))


def committee_summary(committees: DataFrame, keys: list[str]) -> DataFrame:
    """Committees per board, mean meetings among those stating them, attendance over all members."""
    return committees.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("committees"), F.bround(F.avg("meetings_held"), 1).alias("mean_meetings"),
        F.bround(F.try_divide(F.sum("attended") * 100.0, F.sum(F.when(F.col("attended").isNotNull(), F.col("eligible")))), 1).alias("attendance_rate"))


def fixed_fee(components) -> Column:
    """First positive fee or retainer component that is not a sitting, allowance, total, expense or benefit column."""
    m = F.col(components) if isinstance(components, str) else components
    fee = F.map_filter(m, lambda k, v: k.rlike(r"(?i)\bfees?\b|retainer|honorari")
                       & ~k.rlike(r"(?i)sitting|attendance|allowance|total|expense|non-?cash|benefit|committee") & (v > 0))
    return F.try_element_at(F.map_values(fee), F.lit(1)).cast("double")


def benefit_components(components) -> Column:
    m = F.col(components) if isinstance(components, str) else components
    return F.map_filter(m, lambda k, v: k.rlike(r"(?i)housing|vehicle|car|medical|health|travel|pension|benefit|allowance|insurance|mortgage|fuel")
                        & ~F.lower(k).startswith("total"))


def clean_pay_rows(rows: DataFrame) -> DataFrame:
    """Printed pay rows made usable: junk names dropped, markers stripped, the year's Total column picked, totals flagged.

    ``rows`` has director_name, components (map of printed header to printed text), total (text) and year.
    """
    name = F.regexp_replace(F.trim("director_name"), r"[\*†‡^#]+$", "")
    name = F.trim(F.regexp_replace(name, r"\s*\(\s*\d{1,2}\s*\)\s*$", ""))
    # what the next step reads more than once is pinned, or filters would work it out anew for each mention
    df = pin(rows, components=F.col("components"), clean_name=name).where(
        (F.col("clean_name") != "") & ~F.col("clean_name").rlike(r"^(?:19|20)\d\d$")
        & ~F.exists(F.map_keys("components"), lambda k: F.length(k) > 70))
    amounts = F.filter(F.transform(F.map_entries("components"), lambda e: F.struct(
        e["key"].alias("k"), accounting_number(e["value"]).alias("v"),
        F.coalesce(F.regexp_extract(e["key"], r"\b((?:19|20)\d\d)\b", 1).try_cast("int"), F.lit(0)).alias("y"))), lambda e: e["v"].isNotNull())
    df = pin(df, __a=amounts, is_total_name=F.lower("clean_name").rlike(r"^(?:grand\s+)?total(?:\s+.*)?$"))
    df = pin(df, __totals=F.filter("__a", lambda e: e["k"].rlike(r"(?i)\btotal\b")))
    mine = F.filter("__totals", lambda e: (e["y"] == 0) | (e["y"] == F.col("year")))
    picked = F.array_max(F.transform(mine, lambda e: F.struct(e["y"].alias("y"), e["v"].alias("v"))))["v"]
    df = pin(df, total=F.coalesce(accounting_number("total"), picked))
    words = F.size(F.split("clean_name", r"\s+"))
    kept = df.where(F.col("is_total_name") | ((F.size("__a") > 0) & (words <= 6) & ~(F.col("total").isNull() & (F.size("__totals") > 0))))
    return kept.select(*[c for c in rows.columns if c != "director_name"], F.col("clean_name").alias("director_name"), "is_total_name",
                       F.lower("clean_name").rlike(r"^(?:grand\s+)?total$").alias("is_grand_total"))


def drop_prior_year_tables(rows: DataFrame, headings: DataFrame) -> DataFrame:
    """Drop a table whose page is headed only by another year, when some table of the document is headed by this one.

    ``headings`` is (doc_id, page, heading_year); ``rows`` has doc_id, page, table_kind and year.
    """
    page_years = headings.groupBy("doc_id", "page").agg(F.collect_set("heading_year").alias("years"))  # a few years per page
    tagged = rows.join(page_years, ["doc_id", "page"], "left").withColumn(
        "status", F.when(F.array_contains("years", F.col("year")), "current").when(F.col("years").isNotNull(), "prior").otherwise("unknown"))
    has_current = tagged.where("status = 'current'").select("doc_id").distinct().withColumn("__c", F.lit(True))
    return tagged.join(has_current, "doc_id", "left").where(
        (F.col("status") != "prior") | F.col("__c").isNull()).drop("years", "status", "__c")


def source_stage(source) -> Column:
    """Which reader a stored source text came from."""
    # Source prefixes and reader names.
    stages = [
        ("from the document scan", "Layout-independent reader"), ("from the board table", "Board reader"),
        ("from the attendance table", "Board reader"), ("from the director roster", "Board reader"),
        ("from the director pay table", "Pay-table reader"), ("from the remuneration policy text", "Remuneration policy reader"),
        ("from the remuneration report", "Remuneration policy reader"), ("stated in the report", "Board reader"),
        ("from parsed financial statements", "Financial statements parser"), ("from AI extraction", "AI extraction"),
        ("entered manually: form upload", "Manual entry form"), ("entered manually", "Manual entry (typed)"),
    ]
    s = F.trim(F.coalesce(F.col(source) if isinstance(source, str) else source, F.lit("")))
    out = F.when(s == "", "Unknown").otherwise("Survey file / other")
    for prefix, label in reversed(stages):
        out = F.when(s.startswith(prefix), label).otherwise(out)
    return out


def diagnose_missing(gaps: DataFrame) -> DataFrame:
    """Reason code per missing field from joined facts: rejected, has_trace, text_pages_pct, topic_pages."""
    return gaps.withColumn("reason_code", F.when(F.coalesce("rejected", F.lit(False)), "rejected").when(~F.coalesce("has_trace", F.lit(False)), "no_trace")
                           .when(F.col("text_pages_pct") < 30, "scanned").when(F.coalesce("topic_pages", F.lit(0)) == 0, "not_in_text").otherwise("topic_found"))


def extraction_rollup(status: DataFrame) -> DataFrame:
    """Per field: counts by status, failure share and the most common reason (first in the alphabet on ties)."""
    fails = F.col("status") != "complete"
    per = status.groupBy("field", "status", "reason_code").agg(F.count(F.lit(1)).alias("n"))
    worst = per.where(fails & F.col("reason_code").isNotNull()).groupBy("field", "reason_code").agg(F.sum("n").alias("k")).groupBy("field").agg(
        F.min(F.struct((-F.col("k")).alias("k"), "reason_code"))["reason_code"].alias("top_reason"))
    counts = per.groupBy("field").agg(
        F.sum(F.when(F.col("status") == "complete", F.col("n")).otherwise(0)).alias("filled"),
        F.sum(F.when(F.col("status") == "needs_review", F.col("n")).otherwise(0)).alias("low_confidence"),
        F.sum(F.when(F.col("status") == "missing", F.col("n")).otherwise(0)).alias("missing"), F.sum("n").alias("__n"))
    return counts.join(worst, "field", "left").withColumn(
        "fail_pct", F.bround(F.try_divide((F.col("missing") + F.col("low_confidence")) * 100.0, F.col("__n")), 0)).drop("__n")


def extraction_score(sources: list[DataFrame], doc: str = "doc_id") -> DataFrame:
    """Mean confidence of every scored row of a document, 0-100; the sources are partially aggregated before the union."""
    parts = [s.where(F.col("confidence").isNotNull()).select(doc, F.col("confidence").cast("double").alias("c")) for s in sources]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    mean = F.avg("c")
    return every.groupBy(doc).agg(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)) * 100, 1).alias("extraction_score"), F.count("c").alias("rows"))


def issue_ranking(issues: DataFrame, status: DataFrame, k: int | None = None) -> DataFrame:
    """Companies by errors, then issues, then missing fields."""
    i = issues.groupBy("company_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count(F.lit(1)).alias("issues"))
    m = status.groupBy("company_id").agg(F.count_if(F.col("status") == "missing").alias("missing"))
    out = m.join(i, "company_id", "left").fillna(0, ["errors", "issues"])
    order = [F.col("errors").desc(), F.col("issues").desc(), F.col("missing").desc(), F.col("company_id")]
    return out.orderBy(*order).limit(k) if k else out


def tab_status(survey: DataFrame) -> DataFrame:
    """Filled and total fields per row and tab."""
    st = field_status(survey, list(fl.KIND))
    return st.groupBy("company_id", "fiscal_year", "section").agg(
        F.count_if(F.col("status") != "missing").alias("filled"), F.count(F.lit(1)).alias("total"))


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key groups that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def copied_years(survey: DataFrame, fields: list[str], least: int = 3) -> DataFrame:
    """Years of a company labelled with the same report file that share at least ``least`` values.

    Years meet on (company, file, field, value), so only equal values ever pair up. Equal CEO pay makes it an error.
    """
    long = survey.where(F.col("source_filename") != "").select("company_id", F.lower(F.trim("source_filename")).alias("file"), "fiscal_year", *fields).unpivot(
        ["company_id", "file", "fiscal_year"], [F.expr(f"CAST({f} AS DOUBLE) AS {f}") for f in fields], "field", "value").where(F.col("value").isNotNull())
    later = long.withColumnRenamed("fiscal_year", "later_year")
    same = long.withColumnRenamed("fiscal_year", "earlier_year").join(later, ["company_id", "file", "field", "value"]).where(F.col("earlier_year") < F.col("later_year"))
    g = same.groupBy("company_id", "file", "earlier_year", "later_year").agg(
        F.count(F.lit(1)).alias("same_values"), F.count_if(F.col("field").startswith("ceo_")).alias("same_pay"))
    return g.where(F.col("same_values") >= least).withColumn("severity", F.when(F.col("same_pay") > 0, "error").otherwise("warning"))
