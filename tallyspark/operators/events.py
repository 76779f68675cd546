"""Activity log: filters, classification, per-account and per-day reports, sessions, breaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import timefns

# Category names, in display order.
CATEGORIES = [
    "Sign-in & Accounts", "User Management", "Uploads & Extraction", "Review & Corrections", "Data Entry & Edits",
    "Companies", "AI", "Exports & Downloads", "Other",
]
AUTH, USERS, UPLOAD, REVIEW, DATA, COMPANIES, AI, EXPORT, OTHER = CATEGORIES
# Logged actions -> category, label.
ACTIONS = {
    "login": (AUTH, "Signed in"),
    "logout": (AUTH, "Signed out"),
    "login_failed": (AUTH, "Failed sign-in attempt"),
    "register": (AUTH, "Created an account"),
    "profile_updated": (AUTH, "Updated their profile"),
    "survey_uploaded": (UPLOAD, "Uploaded survey data"),
    "survey_updated": (UPLOAD, "Updated survey data"),
    "survey_pdf_extracted": (UPLOAD, "Imported a report PDF"),
    "field_approved": (REVIEW, "Approved a field"),
    "field_rejected": (REVIEW, "Rejected a field"),
    "field_corrected": (REVIEW, "Corrected a field"),
    "unit_corrected": (REVIEW, "Corrected a headline unit"),
    "ai_apply": (AI, "Applied an AI result"),
    "committees_updated": (DATA, "Saved committees"),
    "company_year_deleted": (COMPANIES, "Deleted a company's year of data"),
    "company_deleted": (COMPANIES, "Deleted a company"),
    "company_viewed": (COMPANIES, "Opened a company's report"),
    "email_verified": (AUTH, "Confirmed their email address"),
    "password_reset": (AUTH, "Reset their password by email link"),
    "invite_accepted": (AUTH, "Set their password from an invitation"),
}
# Known routes -> action, category, label.
ROUTES = [
    ("POST", "/api/login", "login", AUTH, "Signed in"),
    ("POST", "/api/logout", "logout", AUTH, "Signed out"),
    ("POST", "/api/register", "register", AUTH, "Created an account"),
    ("PUT", "/api/profile", "profile_updated", AUTH, "Updated their profile"),
    ("POST", "/api/users", "user_created", USERS, "Created a user account"),
    ("PATCH", "/api/users/<int:user_id>/role", "user_role_changed", USERS, "Changed a user's role"),
    ("POST", "/api/users/<int:user_id>/reset-password", "user_password_reset", USERS, "Reset a user's password"),
    ("DELETE", "/api/users/<int:user_id>", "user_deleted", USERS, "Deleted a user account"),
    ("POST", "/api/companies", "company_added", COMPANIES, "Added a company"),
    ("DELETE", "/api/companies/<int:company_id>", "company_deleted", COMPANIES, "Deleted a company"),
    ("POST", "/api/companies/bulk-delete", "companies_deleted", COMPANIES, "Deleted several companies"),
    ("POST", "/api/companies/delete-year", "company_years_deleted", COMPANIES, "Deleted a year of data for several companies"),
    ("POST", "/api/companies/<int:company_id>/financials", "financials_saved", DATA, "Saved company financials"),
    ("POST", "/api/import/upload-batch", "upload_batch", UPLOAD, "Uploaded a batch of reports"),
    ("POST", "/api/survey-data/import", "survey_import", UPLOAD, "Imported survey data"),
    ("POST", "/api/survey-data/import-pdf", "survey_import_pdf", UPLOAD, "Imported a report PDF"),
    ("POST", "/api/survey-data/import-policy-pdf", "policy_import_pdf", UPLOAD, "Imported a policy PDF"),
    ("DELETE", "/api/survey/companies/<int:company_id>/<fiscal_year>", "survey_deleted", DATA, "Deleted a company-year of survey data"),
    ("POST", "/api/ai/run", "ai_run", AI, "Started an AI extraction run"),
    ("POST", "/api/ai/jobs/<int:job_id>/collect", "ai_collect", AI, "Collected AI results"),
    ("POST", "/api/ai/items/<int:item_id>/apply", "ai_apply", AI, "Applied an AI result"),
    ("POST", "/api/ai/items/<int:item_id>/discard", "ai_discard", AI, "Discarded an AI result"),
]
# URL words that decide the category of an unknown route, first hit wins.
URL_WORDS = [
    (EXPORT, r"export|download|\.pdf|\.docx|\.csv|\.zip"), (UPLOAD, r"upload|import|extract|scan"),
    (REVIEW, r"/review|approve|reject|resolve|conflict|reconcile|discard"), (AI, r"/api/ai"), (USERS, r"/api/users"),
]
VERBS = {"POST": "Saved", "PUT": "Updated", "PATCH": "Updated", "DELETE": "Deleted", "GET": "Downloaded"}


def route_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "http_method string, path string, r_action string, r_category string, r_label string")


def route_key(path) -> Column:
    """A path or a route as both are compared: numbers and named parts by what they stand for."""
    p = F.col(path) if isinstance(path, str) else path
    p = F.regexp_replace(F.regexp_replace(p, r"<int:\w+>", "<int>"), r"/\d+(?=/|$)", "/<int>")
    return F.regexp_replace(p, r"^(/api/survey/companies/<int>)/[^/]+$", "$1/<text>")


def action_label(action, detail) -> Column:
    """How an entry reads: the label of its action or route, else the start of its detail, else the action itself."""
    labels = {a: label for _, _, a, _, label in reversed(ROUTES)} | {a: label for a, (_, label) in ACTIONS.items()}
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    words = F.trim(F.translate(F.coalesce(F.col(action), F.lit("")), "_:", "  "))
    own = F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, F.lit(2), F.length(words))))
    return F.coalesce(F.try_element_at(table, F.col(action)), F.nullif(F.split(detail, " · ")[0], F.lit("")), own)


def action_category(action) -> Column:
    table = F.create_map(*[F.lit(x) for a, (category, _) in ACTIONS.items() for x in (a, category)])
    return F.coalesce(F.try_element_at(table, F.col(action)), F.lit(OTHER))


def classify(log: DataFrame, routes: DataFrame) -> DataFrame:
    """action, category and label of each request: the route table first, the shape of the URL otherwise."""
    method, path = F.upper("http_method"), F.lower(F.coalesce("path", F.lit("")))
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.startswith("<") & (s != "api"))
    n = F.size(segments)
    noun = F.replace(F.array_join(F.slice(segments, F.greatest(n - 1, F.lit(1)), F.lit(2)), " / "), F.lit("-"), F.lit(" "))
    category = F.lit(None).cast("string")
    for name, words in reversed(URL_WORDS):
        category = F.when(path.rlike(words), name).otherwise(category)
    changes = method.isin("POST", "PUT", "PATCH", "DELETE")
    own = path.startswith("/api/companies") & method.isin("POST", "DELETE") & (F.regexp_count(path, F.lit("/")) <= 3)
    category = F.coalesce(category, F.when(own, COMPANIES).when(changes, DATA).otherwise(OTHER))
    verbs = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])
    verb = F.when(category == EXPORT, "Downloaded").otherwise(F.coalesce(F.try_element_at(verbs, method), F.initcap("http_method")))
    generic = F.substring(F.concat(F.lower("http_method"), F.lit(":"), F.when(n == 0, "root").otherwise(F.array_join(segments, "/"))), 1, 80)
    known = routes.select(F.col("http_method").alias("r_method"), route_key("path").alias("r_key"), "r_action", "r_category", "r_label")
    joined = log.join(known, (F.col("http_method") == F.col("r_method")) & (route_key("path") == F.col("r_key")), "left")
    return joined.withColumns({
        "action_name": F.coalesce("r_action", generic), "action_category": F.coalesce("r_category", category),
        "action_label": F.coalesce("r_label", F.concat(verb, F.lit(" "), F.when(n == 0, "item").otherwise(noun))),
    }).drop("r_method", "r_key", "r_action", "r_category", "r_label")


def activity_filter(log: DataFrame, at: Column | None = None, days: int | None = None, user_id: int | str | None = None,
                    category: str | None = None, term: str | None = None) -> DataFrame:
    """Time window, account (or ``guest``), category and a case-insensitive search over four columns."""
    if days is not None and at is not None:
        log = log.where(F.col("created_at") >= at - F.make_dt_interval(F.lit(days)))
    if user_id is not None:
        log = log.where(F.col("user_id").isNull() if str(user_id).startswith("guest") else F.col("user_id") == int(user_id))
    if category:
        log = log.where(F.col("category") == category)
    if term and term.strip():
        needle = F.lower(F.lit(term.strip()))
        hit = F.lit(False)
        for c in ("detail", "action", "actor", "actor_email"):
            hit = hit | F.coalesce(F.contains(F.lower(c), needle), F.lit(False))
        log = log.where(hit)
    return log


def daily_base(log: DataFrame, offset: int = 0) -> DataFrame:
    """Counts per account, local day and category: the one shuffle all activity reports share."""
    newest = F.max(F.when(F.col("actor").isNotNull(), F.struct("created_at", "id", "actor", "actor_email")))
    return log.withColumn("day", timefns.local_day("created_at", offset)).groupBy("user_id", "day", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), newest.alias("newest"))


def by_account(base: DataFrame) -> DataFrame:
    return base.groupBy("user_id").agg(
        F.sum("n").alias("events"), F.count_distinct("day").alias("active_days"), F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"), F.coalesce(F.max("newest")["actor"], F.lit("Guest")).alias("account"),
        F.max("newest")["actor_email"].alias("email"))


def by_category(base: DataFrame) -> DataFrame:
    return base.groupBy("category").agg(F.sum("n").alias("events"), F.count_distinct("user_id").alias("accounts"))


def by_day(base: DataFrame) -> DataFrame:
    return base.groupBy("day").agg(F.sum("n").alias("events"), F.count_distinct("user_id", ).alias("accounts")).withColumn(
        "weekday", timefns.weekday("day"))


def entry_budget(log: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """Per day: how many of the ``n`` newest entries it shows and whether it is cut short."""
    day = timefns.local_day("created_at", offset).alias("day")
    totals = log.groupBy(day).agg(F.count(F.lit(1)).alias("total"))
    shown = log.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n).groupBy(day).agg(F.count(F.lit(1)).alias("shown"))
    return totals.join(shown, "day", "left").select(
        "day", "total", F.coalesce("shown", F.lit(0)).alias("shown"), (F.coalesce("shown", F.lit(0)) < F.col("total")).alias("entries_truncated"))


def account_choices(log: DataFrame) -> DataFrame:
    """One label per account: the first one on record."""
    return log.groupBy("user_id").agg(F.min(F.struct("created_at", "id", "actor", "actor_email")).alias("f")).select(
        F.coalesce(F.col("user_id").cast("string"), F.lit("guest")).alias("value"),
        F.coalesce("f.actor", F.lit("Guest")).alias("label"), F.col("f.actor_email").alias("email"))


def active_since(log: DataFrame, at: Column, days: int) -> DataFrame:
    return log.where(F.col("created_at") >= at - F.make_dt_interval(F.lit(days))).agg(F.count_distinct("user_id").alias("active_users"))


def most_viewed(log: DataFrame, k: int = 8) -> DataFrame:
    views = log.where(F.col("company_id").isNotNull()).groupBy("company_id", "user_id").agg(F.count(F.lit(1)).alias("v"))
    return views.groupBy("company_id").agg(F.sum("v").alias("views"), F.count("user_id").alias("users")).orderBy(
        F.col("views").desc(), "company_id").limit(k)


def views_once_per_day(log: DataFrame) -> DataFrame:
    """One view per user, company and UTC day."""
    return log.where(F.col("company_id").isNotNull() & F.col("user_id").isNotNull()).select(
        "user_id", "company_id", F.to_date("created_at").alias("day")).distinct()


def download_kind(path) -> Column:
    """Which allowance a download uses: bulk, data or report."""
    p = F.split(F.lower(F.coalesce(F.col(path) if isinstance(path, str) else path, F.lit(""))), r"\?")[0]
    bulk = p.rlike(r"\.zip|/bulk|export-db") | p.startswith("/api/export/portfolio") | p.startswith("/api/export/comparison")
    return F.when(bulk, "bulk").when(p.rlike(r"\.csv|\.xlsx|\.json|/snapshot|/raw"), "data").otherwise("report")


def downloads_used(log: DataFrame, month_start: Column) -> DataFrame:
    exports = log.where(F.col("path").contains("/export") | F.col("path").contains("workbook")).where(F.col("created_at") >= month_start)
    return exports.groupBy("user_id", download_kind("path").alias("kind")).agg(F.count(F.lit(1)).alias("used"))


def over_daily_cap(log: DataFrame, limit: int = 5) -> DataFrame:
    """Users and UTC days with more than ``limit`` entries."""
    return log.where(F.col("user_id").isNotNull()).groupBy("user_id", F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("downloads")).where(F.col("downloads") > limit)


def rate_breaches(log: DataFrame, limit: int, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Accounts with more than ``limit`` requests in a (sliding) window."""
    win = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    return log.groupBy("user_id", win.alias("w")).agg(F.count(F.lit(1)).alias("requests")).where(F.col("requests") > limit).select(
        "user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests")


def sessions(log: DataFrame, gap_seconds: int = 180, cap_seconds: int = 12 * 3600, chunk: str = "hour") -> DataFrame:
    """Sessions per user: ended by ``gap_seconds`` of silence, cut every ``cap_seconds`` from their start.

    Events are ordered inside (user, hour) chunks; the chunks of a user are stitched through one summary row each, so
    a user with most of the events is still spread over many tasks.
    """
    ev = log.where(F.col("user_id").isNotNull()).select(
        "user_id", "id", F.unix_micros("created_at").alias("us"), F.date_trunc(chunk, "created_at").alias("chunk"))
    gap = gap_seconds * 1_000_000
    inner = W.partitionBy("user_id", "chunk").orderBy("us", "id")
    marked = ev.withColumn("prev", F.lag("us").over(inner)).withColumn(
        "new_here", F.when(F.col("prev").isNotNull(), (F.col("us") - F.col("prev") > gap).cast("int")).otherwise(0))
    ordered = marked.withColumn("local_no", F.sum("new_here").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    chunks = ordered.groupBy("user_id", "chunk", "local_no").agg(
        F.min("us").alias("start"), F.max("us").alias("end"), F.count(F.lit(1)).alias("events"))
    # one row per (user, chunk, local session): far fewer than events; stitch neighbours that are within the gap
    order = W.partitionBy("user_id").orderBy("start")
    stitched = chunks.withColumn(
        "fresh", F.coalesce((F.col("start") - F.lag("end").over(order) > gap).cast("int"), F.lit(1)))
    numbered = stitched.withColumn("session_no", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    starts = numbered.groupBy("user_id", "session_no").agg(F.min("start").alias("session_start"))
    located = numbered.join(starts, ["user_id", "session_no"]).select("user_id", "chunk", "local_no", "session_no", "session_start")
    placed = ordered.join(located, ["user_id", "chunk", "local_no"]).withColumn(
        "piece", F.floor((F.col("us") - F.col("session_start")) / (cap_seconds * 1_000_000)))
    return placed.groupBy("user_id", "session_no", "piece").agg(
        F.timestamp_micros(F.min("us")).alias("started_at"), F.timestamp_micros(F.max("us")).alias("ended_at"),
        F.count(F.lit(1)).alias("events"))


def export_rows(log: DataFrame, offset: int = 0, newest: int | None = None) -> DataFrame:
    """All entries, newest first, as the CSV export shows them; only the ``newest`` so many where asked.

    Role, company name and fiscal year are left blank where the log does not carry them.
    """
    local = timefns.to_local("created_at", offset)
    listed = log.orderBy(F.col("created_at").desc(), F.col("id").desc())
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in log.columns else F.lit("")
    return (listed if newest is None else listed.limit(newest)).select(
        "id", F.date_format(local, "yyyy-MM-dd").alias("date"), F.date_format(local, "HH:mm:ss").alias("time"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc"), F.coalesce("actor", F.lit("Guest")).alias("account"),
        text("actor_email").alias("email"), text("actor_role").alias("role"), F.coalesce("category", action_category("action")).alias("category"),
        action_label("action", F.col("detail")).alias("activity"), text("company_name").alias("company"), text("fiscal_year").alias("fiscal_year"),
        text("detail").alias("detail"))


def latest_entries(log: DataFrame, k: int) -> DataFrame:
    return log.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(k)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) in a total order, with the total count on each row."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total)


