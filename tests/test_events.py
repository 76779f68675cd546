import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import timefns
from tallyspark.operators import billing as bl
from tallyspark.operators import events as ev

LOG = "id long, user_id long, actor string, actor_email string, action string, category string, company_id long, path string, http_method string, detail string, created_at timestamp"


def at(text):
    return dt.datetime.fromisoformat(text)


def log(spark, *rows):
    return spark.createDataFrame([(i, u, a, None, "view", "Viewing", c, None, "GET", d, at(t)) for i, (u, a, c, d, t) in enumerate(rows)], LOG)


THREE = [(1, "Martin", None, "x", "2026-10-03T20:59:00"), (1, "Martin", None, "y", "2026-10-03T08:00:00"), (2, "Amina", None, "z", "2026-10-03T21:30:00")]


def test_days_follow_the_viewer(spark):
    base = ev.daily_base(log(spark, *THREE), -180)
    assert {str(r["day"]): r["events"] for r in ev.by_day(base).collect()} == {"2026-10-03": 2, "2026-10-04": 1}
    assert {r["account"]: r["events"] for r in ev.by_account(base).collect()} == {"Martin": 2, "Amina": 1}


def test_most_recent_name_is_shown(spark):
    base = ev.daily_base(log(spark, (1, "Old Name", None, "", "2026-01-01T00:00:00"), (1, "New Name", None, "", "2026-02-01T00:00:00")))
    r = ev.by_account(base).first()
    assert (r["account"], r["active_days"]) == ("New Name", 2)


def test_classification(spark):
    rows = [("POST", "/api/login"), ("GET", "/api/survey/combined-report.pdf"), ("POST", "/api/review/7/approve"), ("PUT", "/api/things"), ("GET", "/api/companies")]
    df = spark.createDataFrame(rows, "http_method string, path string")
    got = {(r["http_method"], r["path"]): (r["action_name"], r["action_category"]) for r in ev.classify(df, ev.route_table(spark)).collect()}
    assert got[rows[0]] == ("login", "Sign-in & Accounts")
    assert got[rows[1]][1] == "Exports & Downloads" and got[rows[2]][1] == "Review & Corrections"
    assert got[rows[3]][1] == "Data Entry & Edits" and got[rows[4]][1] == "Other"


@pytest.mark.parametrize("method,path,action", [
    ("PATCH", "/api/users/17/role", "user_role_changed"), ("DELETE", "/api/users/17", "user_deleted"), ("POST", "/api/companies/4/financials", "financials_saved"),
    ("DELETE", "/api/survey/companies/4/FY2025", "survey_deleted"), ("POST", "/api/ai/items/9/discard", "ai_discard"), ("POST", "/api/users/<int:user_id>/reset-password", "user_password_reset"),
    ("GET", "/api/users/17", "get:users/17"),
])
def test_templated_routes(spark, method, path, action):
    df = spark.createDataFrame([(1, method, path)], "id long, http_method string, path string")
    assert ev.classify(df, ev.route_table(spark)).first()["action_name"] == action


def test_export_labels(spark):
    rows = [(1, "field_approved", None, None), (2, "user_deleted", "x", None), (3, "post:other", "Saved other · 4", None), (4, "post:new_thing", None, "AI")]
    df = spark.createDataFrame(rows, "id long, action string, detail string, category string").selectExpr("*", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS created_at", "CAST(NULL AS STRING) AS actor")
    got = {r["id"]: (r["category"], r["activity"], r["role"], r["timestamp_utc"]) for r in ev.export_rows(df).collect()}
    assert got == {1: ("Review & Corrections", "Approved a field", "", "2024-01-01T00:00:01Z"), 2: ("Other", "Deleted a user account", "", "2024-01-01T00:00:02Z"),
                   3: ("Other", "Saved other", "", "2024-01-01T00:00:03Z"), 4: ("AI", "Post new thing", "", "2024-01-01T00:00:04Z")}
    assert [r["id"] for r in ev.export_rows(df, newest=2).collect()] == [4, 3]


def test_search_is_literal_and_case_insensitive(spark):
    df = log(spark, (1, "A", None, "50% off", "2026-01-01T00:00:00"), (1, "A", None, "500 off", "2026-01-01T00:00:00"))
    assert [r["detail"] for r in ev.activity_filter(df, term="50% OFF").collect()] == ["50% off"]


def test_guests(spark):
    df = log(spark, (None, None, None, "", "2026-01-01T00:00:00"), (3, "A", None, "", "2026-01-01T00:00:00"))
    assert ev.activity_filter(df, user_id="guest").count() == 1
    assert sorted(r["value"] for r in ev.account_choices(df).collect()) == ["3", "guest"]


def test_budget(spark):
    df = log(spark, *[(1, "A", None, "", f"2026-01-0{d}T0{h}:00:00") for d in (1, 2) for h in range(3)])
    got = {str(r["day"]): (r["shown"], r["entries_truncated"]) for r in ev.entry_budget(df, 4).collect()}
    assert got == {"2026-01-02": (3, False), "2026-01-01": (1, True)}


def brute_sessions(stamps, gap, cap):
    out, start, last, no = {}, None, None, 0
    for t in sorted(stamps):
        if last is None or t - last > gap:
            start, no = t, no + 1
        last = t
        piece = (t - start) // cap
        out[(no, piece)] = out.get((no, piece), 0) + 1
    return out


def test_sessions_across_chunk_borders_and_the_cap(spark):
    base = at("2026-03-01T00:00:00")
    minutes = [0, 1, 59, 61, 62, 70, *range(200, 200 + 13 * 60, 2), 5000]
    df = log(spark, *[(7, "A", None, "", (base + dt.timedelta(minutes=m)).isoformat()) for m in minutes]).repartition(5)
    got = {(r["session_no"], r["piece"]): r["events"] for r in ev.sessions(df, 180, 12 * 3600).collect()}
    assert got == brute_sessions([m * 60 for m in minutes], 180, 12 * 3600)


def test_most_viewed(spark):
    df = log(spark, *[(u, "A", c, "", "2026-01-01T00:00:00") for u, c in ((1, 5), (1, 5), (2, 5), (1, 6))])
    assert [tuple(r) for r in ev.most_viewed(df).collect()] == [(5, 3, 2), (6, 1, 1)]
    assert ev.views_once_per_day(df).count() == 3


def test_download_kinds(spark):
    df = spark.createDataFrame([(p,) for p in ("/api/export/portfolio.xlsx", "/x/data.csv?y=1", "/x/report.pdf", "/x/all.zip")], "p string")
    assert [r[0] for r in df.select(ev.download_kind("p")).collect()] == ["bulk", "data", "report", "bulk"]


SUB = "org_id long, sub_id long, status string, trial_end timestamp, current_period_end timestamp, cancel_at_period_end boolean"


def test_subscription_status(spark):
    now, d = at("2026-06-15T00:00:00"), dt.timedelta(days=1)
    rows = [(1, 1, "trialing", now + d, None, False), (2, 1, "trialing", now - d, None, False), (3, 1, "active", None, now + d, False), (4, 1, "active", None, now - 3 * d, False),
            (5, 1, "active", None, now - 30 * d, False), (6, 1, "active", None, now - d, True), (7, 1, "active", None, None, False), (8, 1, "pending", None, now, False)]
    df = spark.createDataFrame(rows, SUB)
    got = {r["org_id"]: (r["s"], r["l"]) for r in df.select("org_id", bl.effective_status(F.lit(now)).alias("s")).withColumn("l", bl.access_level("s")).collect()}
    assert got == {1: ("trialing", "full"), 2: ("expired", "none"), 3: ("active", "full"), 4: ("past_due", "full"), 5: ("read_only", "read_only"), 6: ("cancelled", "none"),
                   7: ("expired", "none"), 8: ("pending", "none")}


def test_best_subscription_most_access_then_newest(spark):
    now, d = at("2026-06-15T00:00:00"), dt.timedelta(days=1)
    df = spark.createDataFrame([(1, 1, "active", None, now + d, False), (1, 2, "active", None, now - 60 * d, False), (2, 1, "pending", None, None, False), (2, 2, "cancelled", None, None, False)], SUB)
    assert {r["org_id"]: r["sub_id"] for r in bl.best_subscription(df, F.lit(now)).collect()} == {1: 1, 2: 2}


def test_seats_owner_first(spark):
    m = spark.createDataFrame([(1, 5, "member"), (1, 9, "owner"), (1, 2, "member")], "org_id long, user_id long, org_role string")
    s = spark.createDataFrame([(1, 2)], "org_id long, seats int")
    got = {r["user_id"]: (r["seat"], r["over_limit"]) for r in bl.seat_index(m, s).collect()}
    assert got == {9: (1, False), 2: (2, False), 5: (3, True)}


def test_reference_is_applied_once(spark):
    p = spark.createDataFrame([("R1", 1, 10, "KES", at("2026-01-01T00:00:00")), ("R1", 1, 10, "KES", at("2026-01-02T00:00:00")), ("R2", 1, 5, "USD", at("2026-01-01T00:00:00")), ("R3", 2, 5, "KES", at("2026-01-01T00:00:00"))],
                              "reference string, invoice_id long, amount long, currency string, paid_at timestamp")
    i = spark.createDataFrame([(1, "KES", "open"), (2, "KES", "void")], "invoice_id long, currency string, status string")
    got = {r["reference"]: r["note"] for r in bl.apply_payments(p, i).collect()}
    assert got == {"R1": None, "R3": "received on a void invoice"}


def test_month_arithmetic(spark):
    df = spark.createDataFrame([(at("2024-03-31T05:00:00"),)], "t timestamp")
    r = df.select(timefns.add_months("t", -1).alias("m"), timefns.last_year("t").alias("y"), timefns.month_start("t").alias("s"), timefns.days_left(F.lit(at("2024-04-01T06:00:00")), "t").alias("d")).first()
    assert (r["m"], r["y"], r["s"], r["d"]) == (at("2024-02-29T05:00:00"), at("2023-03-31T05:00:00"), at("2024-03-01T00:00:00"), 2)


def test_months_are_zero_filled(spark):
    p = spark.createDataFrame([("KES", 10, at("2026-05-03T00:00:00"))], "currency string, amount long, paid_at timestamp")
    got = [(r["month"], r["amount"]) for r in bl.revenue_by_month(p, F.lit(at("2026-06-15T00:00:00")), 3).orderBy("month").collect()]
    assert got == [("2026-04", 0), ("2026-05", 10), ("2026-06", 0)]
