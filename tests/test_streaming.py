import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.sources.tables import SCHEMAS
from tallyspark.streaming import activity as st
from tallyspark.streaming import ingest, ledger, sinks


def put(spark, folder, name, rows):
    """One event file: (user, type, time)."""
    data = [(i, t, u, a, 0.0, "{}") for i, (u, a, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def t(minute):
    return dt.datetime(2026, 3, 1) + dt.timedelta(minutes=minute)


def run(stream, tmp_path, keys, mode="update", name="out"):
    q = sinks.run_available(stream, sinks.batch_writer(f"{tmp_path}/{name}"), f"{tmp_path}/{name}-check", mode)
    return q, sinks.latest_updates(stream.sparkSession, f"{tmp_path}/{name}", keys)


def stream(spark, tmp_path):
    e = st.event_stream(spark, f"{tmp_path}/in*/*/")
    view = F.col("action") == "view"
    return st.classified(e.withColumns({"company_id": F.when(view, F.col("id") % 50), "path": F.when(view, "/api/companies/1").otherwise("/api/other"), "http_method": F.lit("GET")}))


def test_schema_is_declared():
    assert "timestamp_ntz" in SCHEMAS["events"]


def test_lockout_rules(spark, tmp_path):
    fails = [(1, "error", t(i)) for i in range(5)] + [(1, "error", t(10)), (1, "error", t(19)), (1, "click", t(25))]
    reset = [(2, "error", t(i)) for i in range(4)] + [(2, "click", t(4))] + [(2, "error", t(5 + i)) for i in range(4)]
    put(spark, tmp_path, "in/a", fails + reset)
    _, out = run(st.lockouts(stream(spark, tmp_path)), tmp_path, ["user_id", "locked_at"], "append")
    assert [(r["user_id"], r["locked_at"], r["locked_until"]) for r in out.collect()] == [(1, t(4), t(19))]


def test_lockout_state_survives_a_restart(spark, tmp_path):
    put(spark, tmp_path, "in/a", [(1, "error", t(i)) for i in range(3)])
    run(st.lockouts(stream(spark, tmp_path)), tmp_path, ["user_id", "locked_at"], "append")
    put(spark, tmp_path, "in/b", [(1, "error", t(3 + i)) for i in range(2)])
    _, out = run(st.lockouts(stream(spark, tmp_path)), tmp_path, ["user_id", "locked_at"], "append")
    assert [r["locked_at"] for r in out.collect()] == [t(4)]


def test_lockout_state_is_gone_after_the_lock(spark, tmp_path):
    """Over four micro-batches: a lock, its end, failures that go on, and an account that succeeds again."""
    go = lambda: run(st.lockouts(stream(spark, tmp_path), late="0 minutes"), tmp_path, ["user_id", "locked_at"], "append")
    put(spark, tmp_path, "in/a", [(1, "error", t(i)) for i in range(5)] + [(2, "error", t(i)) for i in range(3)] + [(3, "click", t(1))])
    q, out = go()
    assert [(r["user_id"], r["locked_at"]) for r in out.collect()] == [(1, t(4))] and st.state_rows(q) > 0
    put(spark, tmp_path, "in/b", [(1, "error", t(10)), (2, "error", t(11)), (2, "click", t(12))])
    go()
    put(spark, tmp_path, "in/c", [(9, "click", t(60))])
    q, _ = go()
    assert st.state_rows(q) == 0  # nobody is locked, nobody has failed since
    put(spark, tmp_path, "in/d", [(1, "error", t(61 + i)) for i in range(4)] + [(1, "error", t(5))])
    q, out = go()
    assert len(out.collect()) == 1 and st.state_rows(q) > 0 and st.dropped_late_rows(q) == 1
    put(spark, tmp_path, "in/e", [(1, "error", t(70))])
    assert [r["locked_at"] for r in go()[1].orderBy("locked_at").collect()] == [t(4), t(70)]


def test_lockout_reads_an_account_in_order_whatever_its_pieces(spark, tmp_path):
    import random

    rows = [(1, "error" if i % 7 else "click", t(i * 4)) for i in range(300)]
    shuffled = random.Random(2).sample(rows, len(rows))
    put(spark, tmp_path, "in/a", shuffled)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        _, out = run(st.lockouts(stream(spark, tmp_path)), tmp_path, ["user_id", "locked_at"], "append")
        got = [r["locked_at"] for r in out.orderBy("locked_at").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    failures, until, want = 0, t(-1), []
    for _, action, at in rows:
        if at >= until:
            failures = failures + 1 if action == "error" else 0
            if failures == 5:
                want.append(at)
                failures, until = 0, at + dt.timedelta(minutes=15)
    assert got == want and len(want) > 20


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    put(spark, tmp_path, "in/a", [(1, "click", t(0)), (1, "click", t(60 * 24 * 10))])
    run(st.daily_counts(stream(spark, tmp_path), 0, "1 day"), tmp_path, ["day", "category", "user_id"])
    put(spark, tmp_path, "in/b", [(1, "click", t(5)), (1, "click", t(60 * 24 * 10 + 1))])
    q, out = run(st.daily_counts(stream(spark, tmp_path), 0, "1 day"), tmp_path, ["day", "category", "user_id"])
    assert {str(r["day"]): r["events"] for r in out.collect()} == {"2026-03-01": 1, "2026-03-11": 2}
    assert st.dropped_late_rows(q) == 1


def test_sessions_and_cap(spark, tmp_path):
    put(spark, tmp_path, "in/a", [(1, "click", t(m)) for m in range(0, 13 * 60, 2)] + [(1, "click", t(60 * 100))])
    put(spark, tmp_path, "in/b", [(2, "click", t(60 * 24 * 30))])
    _, out = run(st.sessions(stream(spark, tmp_path), "3 minutes", "1 day"), tmp_path, ["user_id", "started_at"], "append")
    first = out.where("user_id = 1").orderBy("started_at").first()
    assert (first["events"], first["ended_at"]) == (13 * 30, t(13 * 60 - 2))
    assert st.split_sessions(out.where(F.col("started_at") == F.lit(t(0)))).count() == 2


def test_payments_are_applied_once_across_batches_and_replays(spark, tmp_path):
    inv = spark.createDataFrame([(1, "KES", "open")], "invoice_id long, currency string, status string")
    pay = lambda *refs: spark.createDataFrame([(r, 1, 10, "KES", t(0)) for r in refs], "reference string, invoice_id long, amount long, currency string, paid_at timestamp")
    apply = ingest.payment_applier(inv, f"{tmp_path}/applied")
    apply(pay("A", "A", "B"), 0)
    apply(pay("B", "C"), 1)
    apply(pay("B", "C"), 1)  # a replay of the same batch
    assert sorted(r["reference"] for r in spark.read.parquet(f"{tmp_path}/applied").collect()) == ["A", "B", "C"]


def test_only_changed_years_are_refreshed(spark, tmp_path):
    facts = lambda: spark.createDataFrame([("FY2024", 1.0), ("FY2025", 2.0)], "fiscal_year string, v double")
    refresh = ingest.year_refresher(lambda df: df.groupBy("fiscal_year").agg(F.sum("v").alias("total")), facts, f"{tmp_path}/agg")
    change = lambda *ys: spark.createDataFrame([(y,) for y in ys], "fiscal_year string")
    refresh(change("FY2024", "FY2025"), 0)
    before = sorted((tmp_path / "agg" / "fiscal_year=FY2024").glob("*.parquet"))
    refresh(change("FY2025"), 1)
    assert sorted((tmp_path / "agg" / "fiscal_year=FY2024").glob("*.parquet")) == before
    assert {r["fiscal_year"]: r["total"] for r in spark.read.parquet(f"{tmp_path}/agg").collect()} == {"FY2024": 1.0, "FY2025": 2.0}


def test_files_are_imported_as_they_arrive(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()

    def body(size):
        return f"===COMPANY===\nName: Co\n===PERIOD===\nFiscalYear: FY2025\n===BOARD_COMPOSITION===\nBoardSize: {size}\n"

    (folder / "a.txt").write_text(body(7))
    go = lambda: sinks.run_available(ingest.file_stream(spark, str(folder)), ingest.importer(f"{tmp_path}/vals"), f"{tmp_path}/c", "append")
    go()
    (folder / "b.txt").write_text(body(9))
    (folder / "junk.txt").write_text("nothing")
    go()
    assert [(r["field"], r["value"]) for r in ingest.imported_values(spark, f"{tmp_path}/vals").collect()] == [("board_size", 9.0)]


@pytest.mark.parametrize("limit,want", [(2, 1), (3, 0)])
def test_rate_breach(spark, tmp_path, limit, want):
    put(spark, tmp_path, "in/a", [(1, "click", t(0)), (1, "click", t(0)), (1, "view", t(0)), (2, "click", t(0))])
    _, out = run(st.rate_breaches(stream(spark, tmp_path), limit), tmp_path, ["user_id", "window_start"])
    assert out.count() == want


class Ended(Exception):
    pass


def survey_file(name, year, **fields):
    return f"===COMPANY===\nName: {name}\n===PERIOD===\nFiscalYear: {year}\n===BOARD_COMPOSITION===\n" + "".join(f"{k}: {v}\n" for k, v in fields.items())


@pytest.mark.parametrize("at", ["written", "checked", "published"])
def test_a_batch_that_ends_between_its_steps_leaves_no_half_year(spark, tmp_path, at):
    files = lambda *rows: spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(rows)], "file string, content string")
    root = f"{tmp_path}/years"
    held = lambda: sorted((r.company_name, r.fiscal_year, r.field, r.value) for r in ledger.published(spark, root, ledger.VALUES).collect())
    assert held() == []
    ledger.survey_importer(root)(files(survey_file("A", "FY2024", BoardSize=9, Turnover=5), survey_file("B", "FY2025", BoardSize=7), "not a survey file"), 0)
    first = [("A", "FY2024", "board_size", 9.0), ("A", "FY2024", "turnover", 5.0), ("B", "FY2025", "board_size", 7.0)]
    assert held() == first

    def end(step):
        if step == at:
            raise Ended

    later = files(survey_file("A", "FY2024", BoardSize=11), survey_file("C", "FY2024", BoardSize=3), survey_file("C", "FY2024", BoardSize=4))
    second = [("A", "FY2024", "board_size", 11.0), ("A", "FY2024", "turnover", 5.0), ("B", "FY2025", "board_size", 7.0), ("C", "FY2024", "board_size", 4.0)]
    with pytest.raises(Ended):
        ledger.survey_importer(root, end)(later, 1)
    assert held() == (second if at == "published" else first)
    ledger.survey_importer(root)(later, 1)  # the stream starts again and replays the batch
    assert held() == second
    ledger.survey_importer(root)(files(survey_file("A", "FY2024", BoardSize=1)), 1)  # a batch that is published does nothing
    assert held() == second and sorted((r.batch, r.year, r.rows) for r in ledger.ledger(spark, root).collect()) == [(0, "FY2024", 2), (0, "FY2025", 1), (1, "FY2024", 3)]


def test_texts_of_a_batch_are_dealt_out_and_parsed_once(spark, tmp_path, monkeypatch):
    plans, kept = [], ledger.cut
    monkeypatch.setattr(ledger, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    root = f"{tmp_path}/years"
    ledger.survey_importer(root)(spark.createDataFrame([("f", survey_file("A", "FY2024", BoardSize=9))], "file string, content string").coalesce(1), 0)
    assert len(plans) == 1 and "REPARTITION_BY_NUM" in plans[0]
    assert [(r.company_name, r.value) for r in ledger.published(spark, root, ledger.VALUES).collect()] == [("A", 9.0)]


def test_a_version_that_lost_rows_is_not_published(spark, tmp_path):
    rows = spark.createDataFrame([("A", "x", 1.0, "f", "FY2024"), ("B", "x", 1.0, "f", "FY2024")], ledger.VALUES)

    def lose(step):
        if step == "written":
            rows.limit(1).write.mode("overwrite").partitionBy("fiscal_year").parquet(f"{tmp_path}/r/rows/version=0")

    with pytest.raises(ValueError, match="rows were written"):
        ledger.publish(rows, f"{tmp_path}/r", 0, step=lose)
    assert ledger.published(spark, f"{tmp_path}/r", ledger.VALUES).count() == 0


def test_registers_are_imported_and_reconciled_by_batch(spark, tmp_path):
    kind = "company_id long, fiscal_year string, director_name string, role string, gender string"
    pay = spark.createDataFrame([(1, "FY2024", "Louis Onyango Otieno", "executive", "Male"), (2, "FY2024", "Grace Njeri", "non_executive", "Female")], kind)
    root = f"{tmp_path}/reg"
    apply = ledger.register_importer(root, lambda s: pay)
    apply(spark.createDataFrame([(1, "FY2024", "Louis Otieno", "unknown", None), (2, "FY2024", "Grace Njery", "unknown", None)], kind), 0)
    apply(spark.createDataFrame([(2, "FY2024", "Someone Else", "executive", None), (2, "FY2025", "Grace Njeri", "unknown", None)], kind), 1)
    got = sorted((r.company_id, r.fiscal_year, r.director_name, r.role, r.gender) for r in ledger.published(spark, root, ledger.PEOPLE).collect())
    assert got == [(1, "FY2024", "Louis Otieno", "executive", "Male"), (2, "FY2024", "Someone Else", "executive", None), (2, "FY2025", "Grace Njeri", "unknown", None)]


def test_lockout_sorts_a_quiet_account_without_the_map():
    """An account's entries go through the state map only when there are more than may be held; the locks are the same."""
    import pandas as pd

    class State:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Map:
        def __init__(self):
            self.held, self.calls = {}, 0

        def containsKey(self, k):
            self.calls += 1
            return k in self.held

        def getValue(self, k):
            return self.held[k]

        def updateValue(self, k, v):
            self.calls += 1
            self.held[k] = v

        def removeKey(self, k):
            del self.held[k]

        def keys(self):
            return iter(self.held)

    class Handle:
        def getValueState(self, *_):
            return State()

        def getMapState(self, *_):
            return Map()

        def registerTimer(self, at):
            pass

    class Timers:
        def getCurrentWatermarkInMs(self):
            return 0

    minute = 60_000_000
    rows = [(m * minute, m, m % 9 != 8) for m in range(200)]
    pieces = [pd.DataFrame(rows[i::4], columns=["us", "id", "failed"]) for i in range(4)]
    found = []
    for held in (10**6, 3, 120):
        p = st.Lockout(held)
        p.init(Handle())
        [out] = p.handleInputRows((7,), iter(pieces), Timers())
        found.append(out.to_numpy().tolist())
        assert not p.waiting.held and (p.waiting.calls == 0) == (held > 200)
    assert found[0] == found[1] == found[2] and found[0][0] == [7, 4 * minute, 19 * minute]
