"""Streams run to completion over the given event files and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_base
from ..streaming import activity as st
from ..streaming import ingest, ledger, sinks
from . import views
from .registry import query

_CATEGORY = "CASE event_type WHEN 'signup' THEN 'Sign-in & Accounts' WHEN 'purchase' THEN 'Data Entry & Edits' WHEN 'click' THEN 'Exports & Downloads' WHEN 'view' THEN 'Other' ELSE 'Other' END"
_LOG = f"SELECT *, CAST(created_at AS DATE) AS day FROM (SELECT event_id AS id, user_id, event_type AS action, value, ts AS created_at, CASE WHEN event_type = 'view' THEN event_id % 50 END AS company_id, {_CATEGORY} AS category FROM events)"


def logged(stream):
    """The event stream as an activity log: what the log view makes of the event table, request by request."""
    view = F.col("action") == "view"
    path = (F.when(view, F.concat(F.lit("/api/companies/"), (F.col("id") % 50).cast("string"))).when(F.col("action") == "click", "/api/export/portfolio.xlsx")
            .when(F.col("action") == "signup", "/api/login").otherwise("/api/other"))
    return st.classified(stream.withColumns({"company_id": F.when(view, F.col("id") % 50), "path": path, "http_method": F.when(F.col("action").isin("signup", "purchase"), "POST").otherwise("GET")}))


def source(spark, sf_dir):
    return logged(st.event_stream(spark, f"{sf_dir}/events.parquet*"))


PIECES, LATE = 4, 97


def arriving(spark, sf_dir):
    """The events as files that arrive one after another, each a quarter of the time; one in ``LATE`` events of the first quarter comes last."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(us), F.max(us)).first()
    piece = F.floor((us - low) * PIECES / (high - low + 1)).cast("int")
    late = (piece == 0) & (F.col("event_id") % LATE == 0)
    folder = sinks.shared_folder(spark, "arriving", shared_base(spark))
    for i in range(PIECES):  # one write after another, so that the files' times are in this order
        events.where(F.when(late, PIECES - 1).otherwise(piece) == i).coalesce(1).write.parquet(f"{folder}/part={i}")
    return logged(st.event_stream(spark, f"{folder}/part=*", 1))


# the events that arrive in time
_TIMELY = f"""SELECT *, CAST(created_at AS DATE) AS day FROM (SELECT event_id AS id, user_id, event_type AS action, value, ts AS created_at, CASE WHEN event_type = 'view' THEN event_id % 50 END AS company_id, {_CATEGORY} AS category,
 event_id % {LATE} = 0 AND (epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) * {PIECES} // ((SELECT epoch_us(max(ts)) - epoch_us(min(ts)) FROM events) + 1) = 0 AS late FROM events)"""


def updated(spark, stream, name, keys, mode="update"):
    out, check = sinks.shared_folder(spark, name, shared_base(spark)), sinks.shared_folder(spark, f"{name}-checkpoint", shared_base(spark))
    sinks.run_available(stream, sinks.batch_writer(out), check, mode)
    return sinks.latest_updates(spark, out, keys)


@query("stream_daily_counts", f"WITH l AS ({_LOG}) SELECT CAST(created_at + INTERVAL 180 MINUTE AS DATE) AS day, category, user_id, count(*) AS events FROM l GROUP BY ALL")
def stream_daily_counts(spark, sf_dir):
    return updated(spark, st.daily_counts(source(spark, sf_dir), -180), "daily", ["day", "category", "user_id"])


@query("stream_views_once_per_day", f"WITH l AS ({_LOG}) SELECT DISTINCT user_id, company_id, CAST(day AS TIMESTAMP) AS day FROM l WHERE company_id IS NOT NULL")
def stream_views_once_per_day(spark, sf_dir):
    return updated(spark, st.views_once_per_day(source(spark, sf_dir)), "views", ["user_id", "company_id", "day"], "append")


@query("stream_daily_cap", f"WITH l AS ({_LOG}) SELECT user_id, day, count(*) AS downloads FROM l GROUP BY ALL HAVING count(*) > 5")
def stream_daily_cap(spark, sf_dir):
    return updated(spark, st.over_daily_cap(source(spark, sf_dir)), "cap", ["user_id", "day"])


@query("stream_rate_breaches", f"""WITH l AS ({_LOG}), w AS (SELECT user_id, unnest([time_bucket(INTERVAL 30 MINUTE, created_at), time_bucket(INTERVAL 30 MINUTE, created_at) - INTERVAL 30 MINUTE]) AS window_start FROM l)
 SELECT user_id, window_start, count(*) AS requests FROM w GROUP BY ALL HAVING count(*) > 2""")
def stream_rate_breaches(spark, sf_dir):
    return updated(spark, st.rate_breaches(source(spark, sf_dir), 2, "1 hour", "30 minutes", "2 days"), "rate", ["user_id", "window_start"])


@query("stream_sessions", """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
 b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM a)
 SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS events FROM b GROUP BY user_id, no HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_sessions(spark, sf_dir):
    """Sessions the watermark has closed; the last day's stay open until more events arrive."""
    return updated(spark, st.sessions(source(spark, sf_dir), "6 hours"), "sessions", ["user_id", "started_at"], "append")


@query("stream_lockouts", """WITH RECURSIVE e AS (SELECT user_id, event_type = 'error' AS failed, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL),
 r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0 AS failures, 0::BIGINT AS until, FALSE AS locked, 0::BIGINT AS us FROM e UNION ALL
  SELECT e.user_id, e.n, CASE WHEN e.us < r.until THEN r.failures WHEN e.failed AND r.failures < 4 THEN r.failures + 1 ELSE 0 END, CASE WHEN e.us >= r.until AND e.failed AND r.failures = 4 THEN e.us + 900000000 ELSE r.until END,
   e.us >= r.until AND e.failed AND r.failures = 4, e.us FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
 SELECT user_id, make_timestamp(us) AS locked_at, make_timestamp(until) AS locked_until FROM r WHERE locked""")
def stream_lockouts(spark, sf_dir):
    return updated(spark, st.lockouts(source(spark, sf_dir)), "lockouts", ["user_id", "locked_at"], "append")


@query("late_daily_counts", f"WITH l AS (SELECT * FROM ({_TIMELY}) WHERE NOT late) SELECT CAST(created_at + INTERVAL 180 MINUTE AS DATE) AS day, category, user_id, count(*) AS events FROM l GROUP BY ALL")
def late_daily_counts(spark, sf_dir):
    """Daily counts over four micro-batches; what comes behind the watermark changes no day that is closed."""
    return updated(spark, st.daily_counts(arriving(spark, sf_dir), -180), "daily", ["day", "category", "user_id"])


@query("late_views_once_per_day", f"WITH l AS (SELECT * FROM ({_TIMELY}) WHERE NOT late) SELECT DISTINCT user_id, company_id, CAST(day AS TIMESTAMP) AS day FROM l WHERE company_id IS NOT NULL")
def late_views_once_per_day(spark, sf_dir):
    return updated(spark, st.views_once_per_day(arriving(spark, sf_dir)), "views", ["user_id", "company_id", "day"], "append")


@query("late_daily_cap", f"WITH l AS (SELECT * FROM ({_TIMELY}) WHERE NOT late) SELECT user_id, day, count(*) AS downloads FROM l GROUP BY ALL HAVING count(*) > 5")
def late_daily_cap(spark, sf_dir):
    return updated(spark, st.over_daily_cap(arriving(spark, sf_dir)), "cap", ["user_id", "day"])


@query("late_rate_breaches", f"""WITH l AS (SELECT * FROM ({_TIMELY}) WHERE NOT late), w AS (SELECT user_id, unnest([time_bucket(INTERVAL 30 MINUTE, created_at), time_bucket(INTERVAL 30 MINUTE, created_at) - INTERVAL 30 MINUTE]) AS window_start FROM l)
 SELECT user_id, window_start, count(*) AS requests FROM w GROUP BY ALL HAVING count(*) > 2""")
def late_rate_breaches(spark, sf_dir):
    return updated(spark, st.rate_breaches(arriving(spark, sf_dir), 2, "1 hour", "30 minutes", "2 days"), "rate", ["user_id", "window_start"])


@query("late_sessions", f"""WITH l AS (SELECT * FROM ({_TIMELY}) WHERE NOT late), a AS (SELECT user_id, created_at AS ts, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM l),
 b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM a)
 SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS events FROM b GROUP BY user_id, no HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(created_at) FROM l) - INTERVAL 1 DAY""")
def late_sessions(spark, sf_dir):
    """Sessions over four micro-batches: those that cross a batch's end are one; late events open none again."""
    return updated(spark, st.sessions(arriving(spark, sf_dir), "6 hours"), "sessions", ["user_id", "started_at"], "append")


@query("late_rows_dropped", f"SELECT count(*) AS dropped, CAST(count(*) > 0 AS BOOLEAN) AS any_dropped FROM ({_TIMELY}) WHERE late AND company_id IS NOT NULL")
def late_rows_dropped(spark, sf_dir):
    """How many views came behind the watermark, from the progress reports of the stream."""
    out, check = (sinks.shared_folder(spark, n, shared_base(spark)) for n in ("views", "views-checkpoint"))
    q = sinks.run_available(st.views_once_per_day(arriving(spark, sf_dir)), sinks.batch_writer(out), check, "append")
    n = st.dropped_late_rows(q)
    return spark.range(1).select(F.lit(n).cast("long").alias("dropped"), F.lit(n > 0).alias("any_dropped"))


@query("late_lockouts", f"""WITH RECURSIVE e AS (SELECT user_id, action = 'error' AS failed, epoch_us(created_at) AS us, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS n FROM ({_TIMELY}) WHERE user_id IS NOT NULL AND NOT late),
 r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0 AS failures, 0::BIGINT AS until, FALSE AS locked, 0::BIGINT AS us FROM e UNION ALL
  SELECT e.user_id, e.n, CASE WHEN e.us < r.until THEN r.failures WHEN e.failed AND r.failures < 4 THEN r.failures + 1 ELSE 0 END, CASE WHEN e.us >= r.until AND e.failed AND r.failures = 4 THEN e.us + 900000000 ELSE r.until END,
   e.us >= r.until AND e.failed AND r.failures = 4, e.us FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
 SELECT user_id, make_timestamp(us) AS locked_at, make_timestamp(until) AS locked_until FROM r WHERE locked""")
def late_lockouts(spark, sf_dir):
    return updated(spark, st.lockouts(arriving(spark, sf_dir)), "lockouts", ["user_id", "locked_at"], "append")


@query("stream_payments_applied_once", views.oracle("""SELECT reference, p.invoice_id, amount, p.currency, paid_at, CASE WHEN i.status <> 'open' THEN 'received on a ' || i.status || ' invoice' END AS note
 FROM payment p JOIN invoice i ON i.invoice_id = p.invoice_id AND i.currency = p.currency"""))
def stream_payments_applied_once(spark, sf_dir):
    """Every payment arrives twice, in two separate runs of the stream; each reference is applied once."""
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    table = sinks.shared_folder(spark, "applied", shared_base(spark))
    invoices = views.view(spark, sf_dir, "invoice")
    for run in range(2):
        orders = spark.readStream.schema(schema).parquet(f"{sf_dir}/orders.parquet*")
        paid = orders.where(F.col("o_orderstatus").isin("F", "P")).select(
            F.col("o_orderkey").alias("invoice_id"), F.concat(F.lit("REF"), F.col("o_orderkey").cast("string")).alias("reference"),
            F.when(F.col("o_orderkey") % 2 == 0, "KES").otherwise("USD").alias("currency"),
            F.when(F.col("o_orderstatus") == "F", F.floor("o_totalprice")).otherwise(F.floor(F.col("o_totalprice") / 2)).alias("amount"),
            F.col("o_orderdate").cast("timestamp").alias("paid_at"))
        apply = ingest.payment_applier(invoices, table)
        sinks.run_available(paid, lambda b, i, apply=apply, run=run: apply(b, i + run * 1_000_000), sinks.shared_folder(spark, "applied-checkpoint", shared_base(spark)), "append")
    return spark.read.parquet(table).select("reference", "invoice_id", "amount", "currency", "paid_at", "note")


def dropped_files(spark, sf_dir):
    """Survey files that arrive in three drops: all of them; a third again with another board size; then some with a single figure.

    Gives the stream of what has arrived each time a drop is there; a drop is written by as many tasks as have rows of it.
    """
    from .reports import survey_files

    files = survey_files(spark, sf_dir)
    number = F.regexp_extract("file", r"s-(\d+)-", 1).cast("long")
    size = F.regexp_extract("content", r"BoardSize: (\d+)\n", 1).try_cast("int")
    second = files.where((number % 3 == 0) & size.isNotNull()).select("file", F.regexp_replace("content", r"BoardSize: \d+\n", F.concat(F.lit("BoardSize: "), (size + 1).cast("string"), F.lit("\n"))).alias("content"))
    head = F.regexp_extract("content", r"(?s)^(===COMPANY===.*?===PERFORMANCE===\n)", 1)
    third = files.where(number % 5 == 0).select(F.concat("file", F.lit("-late")).alias("file"), F.concat(head, F.lit("Turnover: 77\n===BOARD_COMPOSITION===\n")).alias("content"))
    folder = sinks.shared_folder(spark, "drops", shared_base(spark))
    for i, part in enumerate((files, second, third)):
        part.write.parquet(f"{folder}/drop={i}")
        yield spark.readStream.schema("file string, content string").parquet(f"{folder}/drop=*")


@query("imported_years", views.oracle("""WITH v AS (SELECT 'Company ' || CAST(company_id AS VARCHAR) AS company_name, * EXCLUDE (sector) FROM survey)
 SELECT company_name, fiscal_year, 'board_size' AS field, board_size + CASE WHEN company_id % 3 = 0 THEN 1 ELSE 0 END AS value FROM v WHERE board_size IS NOT NULL
 UNION ALL SELECT company_name, fiscal_year, 'turnover', CASE WHEN company_id % 5 = 0 THEN 77 ELSE turnover END FROM v WHERE turnover IS NOT NULL OR company_id % 5 = 0
 UNION ALL SELECT company_name, fiscal_year, 'net_profit', net_profit FROM v WHERE net_profit IS NOT NULL UNION ALL SELECT company_name, fiscal_year, 'independent_neds_count', independent_neds_count FROM v WHERE independent_neds_count IS NOT NULL
 UNION ALL SELECT company_name, fiscal_year, 'neds_kenyan_count', neds_kenyan_count FROM v WHERE neds_kenyan_count IS NOT NULL UNION ALL SELECT company_name, fiscal_year, 'ceo_monthly_salary', ceo_monthly_salary FROM v WHERE ceo_monthly_salary IS NOT NULL"""))
def imported_years(spark, sf_dir):
    """Files imported batch by batch: parsed, merged into the years they touch, published whole."""
    root = sinks.shared_folder(spark, "imported", shared_base(spark))
    for arrived in dropped_files(spark, sf_dir):  # each run takes what is new as one batch
        sinks.run_available(arrived, ledger.survey_importer(root), f"{root}-checkpoint", "append")
    return ledger.published(spark, root, ledger.VALUES).select("company_name", "fiscal_year", "field", "value")


@query("refreshed_years", views.oracle("SELECT fiscal_year, count(*) AS companies, CAST(sum(n_lines) AS BIGINT) AS lines FROM survey GROUP BY fiscal_year"))
def refreshed_years(spark, sf_dir):
    """Totals of a year, worked out anew whenever a change event names the year, and only then."""
    root = sinks.shared_folder(spark, "refreshed", shared_base(spark))
    facts = lambda: views.survey(spark, sf_dir)
    total = lambda rows: rows.groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("companies"), F.sum("n_lines").cast("long").alias("lines"))
    events = sinks.shared_folder(spark, "changes", shared_base(spark))
    years = facts().select("fiscal_year").distinct()
    for i in range(2):
        years.where(F.pmod(F.xxhash64("fiscal_year"), F.lit(2)) == i).coalesce(1).write.parquet(f"{events}/part={i}")
    changes = spark.readStream.schema("fiscal_year string").option("maxFilesPerTrigger", 1).parquet(f"{events}/part=*")
    sinks.run_available(changes, ingest.year_refresher(total, facts, f"{root}/totals"), f"{root}/checkpoint", "append")
    return spark.read.schema("companies long, lines long, fiscal_year string").parquet(f"{root}/totals")
