"""Activity and billing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timefns
from ..operators import billing as bl
from ..operators import events as ev
from ..operators import reports as rp
from . import views
from .registry import query

_TZ = -180
_AT = "2024-01-31 00:00:00"
_BILL_AT = "2001-06-15 00:00:00"


def ts(text: str):
    return F.lit(text).cast("timestamp")


def log(spark, sf_dir):
    return views.view(spark, sf_dir, "activity")


_LOCAL = "CAST(created_at + INTERVAL 180 MINUTE AS DATE)"


@query("activity_by_account", views.oracle(f"""SELECT user_id, count(*) AS events, count(DISTINCT {_LOCAL}) AS active_days, min(created_at) AS first_at,
 max(created_at) AS last_at, arg_max(actor, (created_at, id)) AS account, arg_max(actor_email, (created_at, id)) AS email FROM activity GROUP BY user_id"""))
def activity_by_account(spark, sf_dir):
    return ev.by_account(ev.daily_base(log(spark, sf_dir), _TZ))


@query("activity_by_category", views.oracle("SELECT category, count(*) AS events, count(DISTINCT user_id) AS accounts FROM activity GROUP BY category"))
def activity_by_category(spark, sf_dir):
    return ev.by_category(ev.daily_base(log(spark, sf_dir), _TZ))


@query("activity_by_day", views.oracle(f"""SELECT {_LOCAL} AS day, count(*) AS events, count(DISTINCT user_id) AS accounts, dayname({_LOCAL}) AS weekday FROM activity GROUP BY ALL"""))
def activity_by_day(spark, sf_dir):
    return ev.by_day(ev.daily_base(log(spark, sf_dir), _TZ))


@query("activity_filtered", views.oracle(f"""SELECT id, user_id, category, detail FROM activity WHERE created_at >= TIMESTAMP '{_AT}' - INTERVAL 7 DAY
 AND category = 'Viewing' AND (detail ILIKE '%VALUE 3%' OR action ILIKE '%VALUE 3%' OR actor ILIKE '%VALUE 3%' OR actor_email ILIKE '%VALUE 3%')"""))
def activity_filtered(spark, sf_dir):
    return ev.activity_filter(log(spark, sf_dir), ts(_AT), 7, None, "Viewing", "VALUE 3").select("id", "user_id", "category", "detail")


@query("guest_activity", views.oracle("SELECT id, actor, category FROM activity WHERE user_id IS NULL"))
def guest_activity(spark, sf_dir):
    return ev.activity_filter(log(spark, sf_dir), user_id="guest").select("id", "actor", "category")


_URL = " ".join(f"WHEN regexp_matches(lower(path), '{w}') THEN '{c}'" for c, w in ev.URL_WORDS)
_ROUTE = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in ev.ROUTES if "<" not in r[1])
_SEG = "list_filter(string_split(lower(path), '/'), lambda s: s <> '' AND s <> 'api' AND NOT starts_with(s, '<'))"


@query("classified_actions", views.oracle(f"""WITH rt(http_method, path, ra, rc, rl) AS (VALUES {_ROUTE}),
 a AS (SELECT l.id, l.http_method, l.path, rt.ra, rt.rc, rt.rl, {_SEG.replace('path', 'l.path')} AS seg,
  CASE {_URL.replace('path', 'l.path')} WHEN starts_with(lower(l.path), '/api/companies') AND l.http_method IN ('POST', 'DELETE') AND length(l.path) - length(replace(l.path, '/', '')) <= 3 THEN 'Companies'
   WHEN l.http_method IN ('POST', 'PUT', 'PATCH', 'DELETE') THEN 'Data Entry & Edits' ELSE 'Other' END AS gc FROM activity l LEFT JOIN rt USING (http_method, path))
 SELECT id, coalesce(ra, substr(lower(http_method) || ':' || array_to_string(seg, '/'), 1, 80)) AS action_name, coalesce(rc, gc) AS action_category,
  coalesce(rl, CASE WHEN gc = 'Exports & Downloads' THEN 'Downloaded' WHEN http_method = 'POST' THEN 'Saved' WHEN http_method = 'GET' THEN 'Downloaded' END
   || ' ' || replace(array_to_string(seg[-2:], ' / '), '-', ' ')) AS action_label FROM a"""))
def classified_actions(spark, sf_dir):
    return ev.classify(log(spark, sf_dir), ev.route_table(spark)).select("id", "action_name", "action_category", "action_label")


@query("entry_budget", views.oracle(f"""WITH t AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rn FROM activity)
 SELECT {_LOCAL} AS day, count(*) AS total, count(*) FILTER (WHERE rn <= 1500) AS shown, count(*) FILTER (WHERE rn <= 1500) < count(*) AS entries_truncated FROM t GROUP BY ALL"""))
def entry_budget(spark, sf_dir):
    return ev.entry_budget(log(spark, sf_dir), 1500, _TZ)


@query("account_choices", views.oracle("""SELECT coalesce(CAST(user_id AS VARCHAR), 'guest') AS value, arg_min(actor, (created_at, id)) AS label,
 arg_min(actor_email, (created_at, id)) AS email FROM activity GROUP BY user_id"""))
def account_choices(spark, sf_dir):
    return ev.account_choices(log(spark, sf_dir))


@query("active_users_week", views.oracle(f"SELECT count(DISTINCT user_id) AS active_users FROM activity WHERE created_at >= TIMESTAMP '{_AT}' - INTERVAL 7 DAY"))
def active_users_week(spark, sf_dir):
    return ev.active_since(log(spark, sf_dir), ts(_AT), 7)


@query("most_viewed", views.oracle("""SELECT company_id, count(*) AS views, count(DISTINCT user_id) AS users FROM activity WHERE company_id IS NOT NULL
 GROUP BY company_id ORDER BY views DESC, company_id LIMIT 8"""))
def most_viewed(spark, sf_dir):
    return ev.most_viewed(log(spark, sf_dir))


@query("views_once_per_day", views.oracle("SELECT DISTINCT user_id, company_id, CAST(created_at AS DATE) AS day FROM activity WHERE company_id IS NOT NULL AND user_id IS NOT NULL"))
def views_once_per_day(spark, sf_dir):
    return ev.views_once_per_day(log(spark, sf_dir))


_KIND = """CASE WHEN regexp_matches(path, '\\.zip|/bulk|export-db') OR starts_with(path, '/api/export/portfolio') OR starts_with(path, '/api/export/comparison') THEN 'bulk'
 WHEN regexp_matches(path, '\\.csv|\\.xlsx|\\.json|/snapshot|/raw') THEN 'data' ELSE 'report' END"""


@query("downloads_used", views.oracle(f"""SELECT user_id, {_KIND} AS kind, count(*) AS used FROM activity
 WHERE (path LIKE '%/export%' OR path LIKE '%workbook%') AND created_at >= TIMESTAMP '2024-01-01' GROUP BY ALL"""))
def downloads_used(spark, sf_dir):
    return ev.downloads_used(log(spark, sf_dir), timefns.month_start(ts(_AT)))


@query("daily_cap_breaches", views.oracle("SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS downloads FROM activity WHERE user_id IS NOT NULL GROUP BY ALL HAVING count(*) > 5"))
def daily_cap_breaches(spark, sf_dir):
    return ev.over_daily_cap(log(spark, sf_dir), 5)


@query("rate_breaches", views.oracle("""SELECT user_id, time_bucket(INTERVAL 1 HOUR, created_at) AS window_start, time_bucket(INTERVAL 1 HOUR, created_at) + INTERVAL 1 HOUR AS window_end,
 count(*) AS requests FROM activity GROUP BY ALL HAVING count(*) > 2"""))
def rate_breaches(spark, sf_dir):
    return ev.rate_breaches(log(spark, sf_dir), 2, "1 hour")


@query("user_sessions", views.oracle("""WITH a AS (SELECT user_id, id, created_at, epoch_us(created_at) AS us, lag(epoch_us(created_at)) OVER (PARTITION BY user_id ORDER BY created_at, id) AS p FROM activity WHERE user_id IS NOT NULL),
 b AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS session_no FROM a),
 c AS (SELECT *, min(us) OVER (PARTITION BY user_id, session_no) AS s0 FROM b)
 SELECT user_id, CAST(session_no AS BIGINT) AS session_no, CAST(floor((us - s0) / 43200000000) AS BIGINT) AS piece, min(created_at) AS started_at, max(created_at) AS ended_at, count(*) AS events FROM c GROUP BY 1, 2, 3"""))
def user_sessions(spark, sf_dir):
    """Sessions with a six-hour silence rule (the given events are sparse) and the twelve-hour cap."""
    return ev.sessions(log(spark, sf_dir), 6 * 3600)


@query("activity_export", views.oracle("""SELECT id, strftime(created_at + INTERVAL 180 MINUTE, '%Y-%m-%d') AS date, strftime(created_at + INTERVAL 180 MINUTE, '%H:%M:%S') AS time,
 strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc, coalesce(actor, 'Guest') AS account, coalesce(actor_email, '') AS email, CASE WHEN user_id IS NULL THEN '' WHEN user_id % 3 = 0 THEN 'admin' ELSE 'member' END AS role,
 category, coalesce(detail, upper(substr(action, 1, 1)) || substr(action, 2)) AS activity, CASE WHEN company_id IS NULL THEN '' ELSE coalesce(name, 'Company ' || CAST(company_id AS VARCHAR)) END AS company, '' AS fiscal_year,
 coalesce(detail, '') AS detail FROM activity LEFT JOIN company USING (company_id) ORDER BY created_at DESC, id DESC"""))
def activity_export(spark, sf_dir):
    named = rp.enrich_left(log(spark, sf_dir), views.view(spark, sf_dir, "company"))
    return ev.export_rows(named.withColumn("actor_role", F.when(F.col("user_id") % 3 == 0, "admin").when(F.col("user_id").isNotNull(), "member")), _TZ)


@query("activity_page", views.oracle("SELECT id, action, (SELECT count(*) FROM activity) AS total FROM activity ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50"))
def activity_page(spark, sf_dir):
    return ev.page(log(spark, sf_dir), [F.col("created_at").desc(), F.col("id").desc()], 3, 25).select("id", "action", "total")


# ---------------------------------------------------------------- billing
_STATUS = f"""CASE WHEN status IN ('pending', 'cancelled', 'expired') THEN status
 WHEN status = 'trialing' THEN CASE WHEN TIMESTAMP '{_BILL_AT}' <= trial_end THEN 'trialing' ELSE 'expired' END
 WHEN current_period_end IS NULL THEN 'expired' WHEN TIMESTAMP '{_BILL_AT}' <= current_period_end THEN 'active' WHEN cancel_at_period_end THEN 'cancelled'
 WHEN TIMESTAMP '{_BILL_AT}' <= current_period_end + INTERVAL 7 DAY THEN 'past_due' ELSE 'read_only' END"""
_BEST = f"""st AS (SELECT *, {_STATUS} AS effective FROM subscription),
 lv AS (SELECT *, CASE WHEN effective IN ('trialing', 'active', 'past_due') THEN 'full' WHEN effective = 'read_only' THEN 'read_only' ELSE 'none' END AS level FROM st),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY CASE level WHEN 'full' THEN 2 WHEN 'read_only' THEN 1 ELSE 0 END DESC, sub_id DESC) AS rn FROM lv) WHERE rn = 1),
 paid AS (SELECT invoice_id, sum(amount)::BIGINT AS paid FROM payment GROUP BY 1),
 bal AS (SELECT i.*, coalesce(p.paid, 0) AS paid, greatest(0, i.total - coalesce(p.paid, 0)) AS balance FROM invoice i LEFT JOIN paid p USING (invoice_id))"""


def bill_sql(body: str) -> str:
    return views.oracle(f"WITH {_BEST} {body}")


def best(spark, sf_dir):
    return bl.best_subscription(views.view(spark, sf_dir, "subscription"), ts(_BILL_AT))


def balances(spark, sf_dir):
    return bl.invoice_balances(views.view(spark, sf_dir, "invoice"), views.view(spark, sf_dir, "payment"))


@query("subscription_status", bill_sql("SELECT sub_id, effective, level FROM lv"))
def subscription_status(spark, sf_dir):
    subs = views.view(spark, sf_dir, "subscription").withColumn("effective", bl.effective_status(ts(_BILL_AT)))
    return subs.select("sub_id", "effective", bl.access_level("effective").alias("level"))


@query("best_subscription", bill_sql("SELECT org_id, sub_id, plan, effective, level FROM best"))
def best_subscription(spark, sf_dir):
    return best(spark, sf_dir).select("org_id", "sub_id", "plan", "effective", "level")


@query("recurring_revenue", bill_sql("""SELECT currency, plan, count(*) AS customers, round_even(sum(price::DOUBLE / greatest(1, interval_months)), 3) AS mrr,
 round_even(sum(price::DOUBLE / greatest(1, interval_months) * 12), 3) AS arr FROM best WHERE effective IN ('active', 'past_due') GROUP BY ALL"""))
def recurring_revenue(spark, sf_dir):
    return bl.recurring_revenue(best(spark, sf_dir)).withColumns({"mrr": F.bround("mrr", 3), "arr": F.bround("arr", 3)})


@query("customers_by_status", bill_sql("SELECT effective, count(*) AS customers FROM best GROUP BY effective"))
def customers_by_status(spark, sf_dir):
    return bl.status_counts(best(spark, sf_dir))


@query("trial_conversion", bill_sql("""SELECT count(*) AS trials, count(*) FILTER (WHERE effective IN ('active', 'past_due')) AS converted,
 round_even(100.0 * (count(*) FILTER (WHERE effective IN ('active', 'past_due')))::DOUBLE / count(*), 0) AS pct FROM best WHERE org_id IN (SELECT org_id FROM subscription WHERE status = 'trialing')"""))
def trial_conversion(spark, sf_dir):
    used = views.view(spark, sf_dir, "subscription").where("status = 'trialing'")
    return bl.trial_conversion(best(spark, sf_dir), used)


@query("upcoming_renewals", bill_sql(f"""SELECT * FROM (SELECT org_id, plan, effective, CASE WHEN effective = 'trialing' THEN trial_end ELSE current_period_end END AS ends_at FROM best WHERE effective IN ('trialing', 'active'))
 WHERE ends_at BETWEEN TIMESTAMP '{_BILL_AT}' AND TIMESTAMP '{_BILL_AT}' + INTERVAL 30 DAY"""))
def upcoming_renewals(spark, sf_dir):
    return bl.upcoming_renewals(best(spark, sf_dir), ts(_BILL_AT)).select("org_id", "plan", "effective", "ends_at")


@query("receivables", bill_sql(f"""SELECT currency, sum(balance)::BIGINT AS outstanding, (sum(balance) FILTER (WHERE due_at < TIMESTAMP '{_BILL_AT}' AND balance > 0))::BIGINT AS overdue,
 count(*) FILTER (WHERE due_at < TIMESTAMP '{_BILL_AT}' AND balance > 0) AS overdue_invoices FROM bal WHERE status = 'open' GROUP BY currency"""))
def receivables(spark, sf_dir):
    return bl.receivables(balances(spark, sf_dir), ts(_BILL_AT))


@query("overdue_invoices", bill_sql(f"""SELECT invoice_id, org_id, balance, currency, CAST(floor((epoch(TIMESTAMP '{_BILL_AT}') - epoch(due_at)) / 86400) AS BIGINT) AS days FROM bal
 WHERE status = 'open' AND due_at < TIMESTAMP '{_BILL_AT}' AND balance > 0 ORDER BY days DESC, invoice_id LIMIT 6"""))
def overdue_invoices(spark, sf_dir):
    return bl.overdue_list(balances(spark, sf_dir), ts(_BILL_AT)).select("invoice_id", "org_id", "balance", "currency", "days")


@query("cash_collected", views.oracle(f"""SELECT currency, (sum(amount) FILTER (WHERE paid_at >= TIMESTAMP '2001-01-01' AND paid_at <= TIMESTAMP '{_BILL_AT}'))::BIGINT AS ytd,
 (sum(amount) FILTER (WHERE paid_at >= TIMESTAMP '2000-01-01' AND paid_at <= TIMESTAMP '2000-06-15'))::BIGINT AS last_year,
 (sum(amount) FILTER (WHERE paid_at >= TIMESTAMP '{_BILL_AT}' - INTERVAL 30 DAY))::BIGINT AS last_30_days FROM payment GROUP BY currency"""))
def cash_collected(spark, sf_dir):
    return bl.cash_collected(views.view(spark, sf_dir, "payment"), ts(_BILL_AT))


@query("revenue_by_month", views.oracle(f"""WITH m AS (SELECT unnest(generate_series(TIMESTAMP '2000-07-01', TIMESTAMP '2001-06-01', INTERVAL 1 MONTH)) AS ms), c AS (SELECT DISTINCT currency FROM payment),
 g AS (SELECT date_trunc('month', paid_at) AS ms, currency, sum(amount)::BIGINT AS amount FROM payment GROUP BY 1, 2)
 SELECT strftime(m.ms, '%Y-%m') AS month, c.currency, coalesce(g.amount, 0) AS amount FROM m CROSS JOIN c LEFT JOIN g ON g.ms = m.ms AND g.currency = c.currency"""))
def revenue_by_month(spark, sf_dir):
    return bl.revenue_by_month(views.view(spark, sf_dir, "payment"), ts(_BILL_AT))


@query("applied_payments", views.oracle("""WITH p AS (SELECT * FROM payment UNION ALL SELECT * FROM payment)
 SELECT DISTINCT reference, p.invoice_id, amount, p.currency, paid_at, CASE WHEN i.status <> 'open' THEN 'received on a ' || i.status || ' invoice' END AS note
 FROM p JOIN invoice i ON i.invoice_id = p.invoice_id AND i.currency = p.currency"""))
def applied_payments(spark, sf_dir):
    p = views.view(spark, sf_dir, "payment")
    return bl.apply_payments(p.unionByName(p), views.view(spark, sf_dir, "invoice"))


_HEALTH = f"""od AS (SELECT org_id, bool_or(due_at < TIMESTAMP '{_BILL_AT}' AND balance > 0) AS overdue, sum(balance)::BIGINT AS owed FROM bal WHERE status = 'open' GROUP BY 1),
 act AS (SELECT user_id AS org_id, max(created_at) AS last_at, count(DISTINCT CASE WHEN created_at >= TIMESTAMP '2024-01-01' THEN id END) AS active_users FROM activity WHERE user_id IS NOT NULL GROUP BY 1),
 cu AS (SELECT b.org_id, b.effective, b.cancel_at_period_end, coalesce(od.overdue, FALSE) AS overdue, coalesce(od.owed, 0) AS balance_due, coalesce(a.active_users, 0) AS active_users,
  CAST(floor((epoch(TIMESTAMP '{_AT}') - epoch(a.last_at)) / 86400) AS BIGINT) AS idle_days FROM best b LEFT JOIN od USING (org_id) LEFT JOIN act a USING (org_id)),
 hh AS (SELECT org_id, effective, balance_due, idle_days, CASE WHEN overdue THEN 'Payment overdue' WHEN effective IN ('active', 'past_due') AND cancel_at_period_end THEN 'Cancelling'
  WHEN effective = 'trialing' AND active_users > 0 THEN 'Trial - in use' WHEN effective = 'trialing' THEN 'Trial - not used yet'
  WHEN effective IN ('active', 'past_due') AND (idle_days IS NULL OR idle_days > 21) THEN 'At risk - inactive' WHEN effective IN ('active', 'past_due') THEN 'Healthy' ELSE 'No active plan' END AS health FROM cu)"""


def customers(spark, sf_dir):
    at = ts(_BILL_AT)
    owed = balances(spark, sf_dir).where("status = 'open'").groupBy("org_id").agg(
        F.bool_or((F.col("due_at") < at) & (F.col("balance") > 0)).alias("overdue"), F.sum("balance").alias("balance_due"))
    act = log(spark, sf_dir).where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("org_id")).agg(
        F.max("created_at").alias("last_at"), F.count_if(F.col("created_at") >= ts("2024-01-01")).alias("active_users"))
    c = best(spark, sf_dir).join(owed, "org_id", "left").join(act, "org_id", "left")
    return bl.customer_health(c.withColumns({
        "overdue": F.coalesce("overdue", F.lit(False)), "balance_due": F.coalesce("balance_due", F.lit(0)),
        "active_users": F.coalesce("active_users", F.lit(0)), "idle_days": timefns.days_between(ts(_AT), "last_at")}))


@query("customer_health", views.oracle(f"WITH {_BEST}, {_HEALTH} SELECT * FROM hh"))
def customer_health(spark, sf_dir):
    return customers(spark, sf_dir).select("org_id", "effective", "balance_due", "idle_days", "health")


@query("customers_by_urgency", views.oracle(f"""WITH {_BEST}, {_HEALTH} SELECT org_id, health, balance_due FROM hh ORDER BY CASE health WHEN 'Payment overdue' THEN 0 WHEN 'At risk - inactive' THEN 0
 WHEN 'Cancelling' THEN 1 WHEN 'Trial - not used yet' THEN 1 WHEN 'Trial - in use' THEN 2 WHEN 'Healthy' THEN 3 ELSE 4 END, org_id"""))
def customers_by_urgency(spark, sf_dir):
    return customers(spark, sf_dir).orderBy("urgency", "org_id").select("org_id", "health", "balance_due")


@query("organisation_accounts", bill_sql("""SELECT b.org_id, b.plan, b.level, count(i.invoice_id) AS invoices, coalesce(sum(CASE WHEN i.status = 'open' THEN i.balance END), 0)::BIGINT AS balance_due
 FROM best b LEFT JOIN bal i ON i.org_id = b.org_id GROUP BY ALL"""))
def organisation_accounts(spark, sf_dir):
    inv = balances(spark, sf_dir).groupBy("org_id").agg(
        F.count(F.lit(1)).alias("invoices"), F.sum(F.when(F.col("status") == "open", F.col("balance"))).alias("b"))
    return best(spark, sf_dir).join(inv, "org_id", "left").select(
        "org_id", "plan", "level", F.coalesce("invoices", F.lit(0)).alias("invoices"), F.coalesce("b", F.lit(0)).alias("balance_due"))


@query("seat_limits", """WITH m AS (SELECT c_nationkey AS org_id, c_custkey AS user_id, CASE WHEN c_custkey % 50 = 7 THEN 'owner' ELSE 'member' END AS org_role FROM customer)
 SELECT *, CAST(row_number() OVER (PARTITION BY org_id ORDER BY CASE org_role WHEN 'owner' THEN 0 ELSE 1 END, user_id) AS INT) AS seat,
 row_number() OVER (PARTITION BY org_id ORDER BY CASE org_role WHEN 'owner' THEN 0 ELSE 1 END, user_id) > (org_id % 5 + 1) * 10 AS over_limit FROM m""")
def seat_limits(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    m = c.select(F.col("c_nationkey").alias("org_id"), F.col("c_custkey").alias("user_id"),
                 F.when(F.col("c_custkey") % 50 == 7, "owner").otherwise("member").alias("org_role"))
    seats = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("org_id"), ((F.col("n_nationkey") % 5 + 1) * 10).alias("seats"))
    return bl.seat_index(m, seats).drop("seats")


@query("business_dashboard", views.oracle(f"""WITH {_BEST}, {_HEALTH} SELECT count(*) AS customers_total, count(*) FILTER (WHERE effective IN ('active', 'past_due')) AS paying, count(*) FILTER (WHERE effective = 'trialing') AS trialing, sum(balance_due)::BIGINT AS balance_due,
 count(*) FILTER (WHERE health IN ('Payment overdue', 'At risk - inactive')) AS tone_red, count(*) FILTER (WHERE health IN ('Cancelling', 'Trial - not used yet')) AS tone_amber, count(*) FILTER (WHERE health = 'Trial - in use') AS tone_blue,
 count(*) FILTER (WHERE health = 'Healthy') AS tone_green, count(*) FILTER (WHERE health = 'No active plan') AS tone_faint,
 (SELECT count(*) FROM payment WHERE paid_at BETWEEN TIMESTAMP '2001-01-01' AND TIMESTAMP '{_BILL_AT}') AS payments_ytd, (SELECT count(*) FROM payment WHERE paid_at >= TIMESTAMP '{_BILL_AT}' - INTERVAL 30 DAY) AS payments_30d FROM hh"""))
def business_dashboard(spark, sf_dir):
    return bl.business_dashboard(customers(spark, sf_dir), views.view(spark, sf_dir, "payment"), ts(_BILL_AT))
