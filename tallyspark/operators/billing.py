"""Subscriptions, invoices and payments: status, receivables, recurring revenue, customer health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timefns
from . import stats

GRACE_DAYS = 7
# How much access each effective status gives.
LEVEL = {"trialing": "full", "active": "full", "past_due": "full", "read_only": "read_only"}
# Urgency order of customer tones.
TONE_ORDER = ["red", "amber", "blue", "green", "faint"]


def effective_status(at: Column, grace_days: int = GRACE_DAYS) -> Column:
    """Status as of ``at`` from the stored status and dates."""
    end, trial = F.col("current_period_end"), F.col("trial_end")
    return (
        F.when(F.col("status").isin("pending", "cancelled", "expired"), F.col("status"))
        .when(F.col("status") == "trialing", F.when(at <= trial, "trialing").otherwise("expired"))
        .when(end.isNull(), "expired").when(at <= end, "active")
        .when(F.col("cancel_at_period_end"), "cancelled")
        .when(at <= end + F.make_dt_interval(F.lit(grace_days)), "past_due").otherwise("read_only")
    )


def access_level(status) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LEVEL.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(status) if isinstance(status, str) else status), F.lit("none"))


def level_rank(level) -> Column:
    c = F.col(level) if isinstance(level, str) else level
    return F.when(c == "full", 2).when(c == "read_only", 1).otherwise(0)


def best_subscription(subs: DataFrame, at: Column, grace_days: int = GRACE_DAYS) -> DataFrame:
    """Per organisation the subscription giving the most access; the newest on ties."""
    rated = subs.withColumn("effective", effective_status(at, grace_days)).withColumn("level", access_level("effective"))
    rest = [c for c in rated.columns if c not in ("org_id", "sub_id")]
    best = rated.groupBy("org_id").agg(F.max(F.struct(level_rank("level").alias("r"), F.col("sub_id"), *rest)).alias("b"))
    return best.select("org_id", "b.*").drop("r")


def invoice_balances(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Invoices with what is paid and what is still owed (never below 0)."""
    paid = payments.groupBy("invoice_id").agg(F.sum("amount").alias("paid"))
    return invoices.join(paid, "invoice_id", "left").withColumn("paid", F.coalesce("paid", F.lit(0))).withColumn(
        "balance", F.greatest(F.lit(0), F.col("total") - F.col("paid")))


def receivables(balances: DataFrame, at: Column) -> DataFrame:
    late = (F.col("due_at") < at) & (F.col("balance") > 0)
    return balances.where(F.col("status") == "open").groupBy("currency").agg(
        F.sum("balance").alias("outstanding"), F.sum(F.when(late, F.col("balance"))).alias("overdue"),
        F.count_if(late).alias("overdue_invoices"))


def overdue_list(balances: DataFrame, at: Column, k: int = 6) -> DataFrame:
    late = balances.where((F.col("status") == "open") & (F.col("due_at") < at) & (F.col("balance") > 0))
    return late.withColumn("days", timefns.days_between(at, "due_at")).orderBy(F.col("days").desc(), "invoice_id").limit(k)


def cash_collected(payments: DataFrame, at: Column) -> DataFrame:
    """Per currency: this year, the same stretch of last year, the last 30 days."""
    p, a = F.col("paid_at"), F.col("amount")
    return payments.groupBy("currency").agg(
        F.sum(F.when((p >= timefns.year_start(at)) & (p <= at), a)).alias("ytd"),
        F.sum(F.when((p >= timefns.last_year(timefns.year_start(at))) & (p <= timefns.last_year(at)), a)).alias("last_year"),
        F.sum(F.when(p >= at - F.make_dt_interval(F.lit(30)), a)).alias("last_30_days"))


def revenue_by_month(payments: DataFrame, at: Column, months: int = 12) -> DataFrame:
    """Money received per month and currency for the last ``months`` months, zero-filled."""
    first = timefns.add_months(timefns.month_start(at), -(months - 1))
    spark = payments.sparkSession
    grid = spark.range(months).select(
        (timefns.month_start(at) - F.make_ym_interval(F.lit(0), F.col("id").cast("int"))).alias("month_start"))
    got = payments.where(F.col("paid_at") >= first).groupBy(
        timefns.month_start("paid_at").alias("month_start"), "currency").agg(F.sum("amount").alias("amount"))
    currencies = payments.groupBy().agg(F.collect_set("currency").alias("cs")).select("cs").scalar()  # a handful of codes
    cells = grid.withColumn("currency", F.explode(currencies))
    return cells.join(got, ["month_start", "currency"], "left").select(
        F.date_format("month_start", "yyyy-MM").alias("month"), "currency", F.coalesce("amount", F.lit(0)).alias("amount"))


def recurring_revenue(best: DataFrame) -> DataFrame:
    """Monthly and yearly recurring revenue per currency and plan of the paying customers."""
    paying = best.where(F.col("effective").isin("active", "past_due"))
    per = F.col("price") / F.greatest(F.lit(1), F.col("interval_months"))
    return paying.groupBy("currency", "plan").agg(
        F.count(F.lit(1)).alias("customers"), F.sum(per).alias("mrr"), F.sum(per * 12).alias("arr"))


def status_counts(best: DataFrame) -> DataFrame:
    return best.groupBy("effective").agg(F.count(F.lit(1)).alias("customers"))


def trial_conversion(best: DataFrame, trial_used: DataFrame) -> DataFrame:
    used = best.join(trial_used.select("org_id").distinct(), "org_id", "left_semi")
    won = F.count_if(F.col("effective").isin("active", "past_due"))
    return used.agg(F.count(F.lit(1)).alias("trials"), won.alias("converted"),
                    F.bround(F.try_divide(won * 100.0, F.count(F.lit(1))), 0).alias("pct"))


def upcoming_renewals(best: DataFrame, at: Column, days: int = 30) -> DataFrame:
    end = F.when(F.col("effective") == "trialing", F.col("trial_end")).otherwise(F.col("current_period_end"))
    return best.withColumn("ends_at", end).where(
        F.col("effective").isin("trialing", "active") & F.col("ends_at").between(at, at + F.make_dt_interval(F.lit(days))))


def customer_health(customers: DataFrame) -> DataFrame:
    """Health and tone from overdue, effective status, cancelling flag, users active and idle days."""
    paying, idle = F.col("effective").isin("active", "past_due"), F.col("idle_days")
    cases = [
        (F.col("overdue"), "Payment overdue", "red"), (paying & F.col("cancel_at_period_end"), "Cancelling", "amber"),
        ((F.col("effective") == "trialing") & (F.col("active_users") > 0), "Trial - in use", "blue"),
        (F.col("effective") == "trialing", "Trial - not used yet", "amber"),
        (paying & (idle.isNull() | (idle > 21)), "At risk - inactive", "red"), (paying, "Healthy", "green"),
    ]
    health, tone = F.lit("No active plan"), F.lit("faint")
    for cond, h, t in reversed(cases):
        c = F.coalesce(cond, F.lit(False))
        health, tone = F.when(c, h).otherwise(health), F.when(c, t).otherwise(tone)
    order = F.create_map(*[F.lit(x) for i, t in enumerate(TONE_ORDER) for x in (t, i)])
    return customers.withColumns({"health": health, "tone": tone}).withColumn("urgency", F.element_at(order, F.col("tone")))


def seat_index(members: DataFrame, seats: DataFrame) -> DataFrame:
    """Place of each member (owner first, then id) and whether it is over the organisation's seats."""
    key = F.when(F.col("org_role") == "owner", F.lit(0)).otherwise(F.lit(1 << 52)) + F.col("user_id")
    placed = stats.with_positions(members.withColumn("__k", key.cast("long")), ["org_id"], "__k")
    return placed.withColumn("seat", (F.col("below") + 1).cast("int")).drop("__k", "equal", "below", "n").join(seats, "org_id", "left").withColumn(
        "over_limit", F.col("seat") > F.coalesce("seats", F.lit(0)))


def apply_payments(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """One payment per reference (the first), currency equal to its invoice, with a note on closed invoices."""
    first = payments.groupBy("reference").agg(F.min(F.struct("paid_at", "invoice_id", "amount", "currency")).alias("p")).select(
        "reference", "p.*")
    inv = invoices.select("invoice_id", F.col("currency").alias("__c"), F.col("status").alias("__s"))
    return first.join(inv, "invoice_id").where(F.col("currency") == F.col("__c")).select(
        "reference", "invoice_id", "amount", "currency", "paid_at",
        F.when(F.col("__s") != "open", F.concat(F.lit("received on a "), F.col("__s"), F.lit(" invoice"))).alias("note"))


def business_dashboard(customers: DataFrame, payments: DataFrame, at: Column) -> DataFrame:
    """One row: customers by tone and status, balance due, paying share, money received this year and in 30 days."""
    tone = {t: F.count_if(F.col("tone") == t).alias(f"tone_{t}") for t in TONE_ORDER}
    c = customers.agg(
        F.count(F.lit(1)).alias("customers_total"), F.count_if(F.col("effective").isin("active", "past_due")).alias("paying"),
        F.count_if(F.col("effective") == "trialing").alias("trialing"), F.sum("balance_due").alias("balance_due"), *tone.values())
    paid = payments.where((F.col("paid_at") <= at) & (F.col("paid_at") >= timefns.year_start(at)))
    recent = payments.where(F.col("paid_at") >= at - F.make_dt_interval(F.lit(30)))
    return c.withColumns({"payments_ytd": paid.agg(F.count(F.lit(1))).scalar(), "payments_30d": recent.agg(F.count(F.lit(1))).scalar()})
