"""Activity-log streams: daily counts, caps, breaches, sessions, lockout, one view a day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import timefns
from ..operators import events as ev
from ..sources.tables import SCHEMAS

MAX_FAILURES, LOCK_MINUTES = 5, 15
SLOT_US = 15 * 60_000_000
# Entries of one account and micro-batch that are sorted in memory; those of a busier one go through the state, a slot at a time.
HELD_ENTRIES = 50_000


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The event files as a stream, their timestamps made usable for watermarks."""
    reader = spark.readStream.schema(SCHEMAS["events"])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), "value", F.col("ts").cast("timestamp").alias("created_at"))


def classified(stream: DataFrame) -> DataFrame:
    """Entries of an activity stream with their category, by the rules of the batch log (columns ``http_method`` and ``path``)."""
    out = ev.classify(stream, ev.route_table(stream.sparkSession))
    return out.withColumn("category", F.col("action_category")).drop("action_name", "action_category", "action_label")


def daily_counts(stream: DataFrame, offset: int = 0, late: str = "2 days") -> DataFrame:
    """Entries per viewer-local day, category and account."""
    local = stream.withColumn("local_at", timefns.to_local("created_at", offset)).withWatermark("local_at", late)
    g = local.groupBy(F.window("local_at", "1 day").alias("w"), "category", "user_id").agg(F.count(F.lit(1)).alias("events"))
    return g.select(F.to_date("w.start").alias("day"), "category", "user_id", "events")


def views_once_per_day(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """First view per user, company and UTC day; the day is the watermark column, so old state is dropped."""
    v = stream.where(F.col("company_id").isNotNull()).select("user_id", "company_id", F.date_trunc("day", "created_at").alias("day"))
    return v.withWatermark("day", late).dropDuplicates(["user_id", "company_id", "day"])


def over_daily_cap(stream: DataFrame, limit: int = 5, late: str = "2 days") -> DataFrame:
    g = stream.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("downloads"))
    return g.where(F.col("downloads") > limit).select("user_id", F.to_date("w.start").alias("day"), "downloads")


def rate_breaches(stream: DataFrame, limit: int, width: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    win = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    g = stream.withWatermark("created_at", late).groupBy(win.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("requests"))
    return g.where(F.col("requests") > limit).select("user_id", F.col("w.start").alias("window_start"), "requests")


def sessions(stream: DataFrame, gap: str = "3 minutes", late: str = "1 day") -> DataFrame:
    """Sessions by silence (append mode: emitted once the watermark has passed). ``split_sessions`` applies the cap."""
    g = stream.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap).alias("s"), "user_id").agg(
        F.count(F.lit(1)).alias("events"), F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"))
    return g.select("user_id", "started_at", "ended_at", "events")


def split_sessions(found: DataFrame, cap_hours: int = 12) -> DataFrame:
    """Sessions longer than the cap as pieces of at most ``cap_hours``."""
    span = F.unix_seconds("ended_at") - F.unix_seconds("started_at")
    n = F.floor(span / (cap_hours * 3600)).cast("int")
    piece = F.explode(F.sequence(F.lit(0), n)).alias("piece")
    p = found.select("*", piece)
    start = p["started_at"] + F.make_dt_interval(F.lit(0), F.col("piece") * cap_hours)
    return p.select("user_id", "piece", start.alias("started_at"), F.least("ended_at", start + F.make_dt_interval(F.lit(0), F.lit(cap_hours))).alias("ended_at"))


class Lockout(StatefulProcessor):
    """Failures in a row, and until when the account is locked; attempts while locked do not count.

    An account's entries of a micro-batch arrive in pieces. Up to ``held`` of them are sorted as they are; when there are more, they are put into a
    state map by quarter of an hour, then read back slot by slot, each sorted by itself, so no more than ``held`` entries or one slot of one account are
    in memory at once; the map is empty again when the batch ends. A timer at the end of the lock removes what is left of it, so the state holds only
    accounts that are locked or have failed since they last succeeded.
    """

    def __init__(self, held: int = HELD_ENTRIES) -> None:
        self.held = held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "failures int, until long")
        self.waiting = handle.getMapState("waiting", "slot long", "entries string")

    def _put(self, entries: list[tuple[int, int, int]]) -> None:
        slots: dict[int, list[str]] = {}
        for us, i, failed in entries:
            slots.setdefault(us // SLOT_US, []).append(f"{us},{i},{failed};")
        for slot, part in slots.items():
            before = self.waiting.getValue((slot,))[0] if self.waiting.containsKey((slot,)) else ""
            self.waiting.updateValue((slot,), (before + "".join(part),))

    def _in_order(self, rows) -> Iterator[tuple[int, int, int]]:
        held: list[tuple[int, int, int]] = []
        put = False
        for piece in rows:
            held += zip(piece["us"].tolist(), piece["id"].tolist(), piece["failed"].astype(int).tolist())
            if len(held) > self.held:
                self._put(held)
                held, put = [], True
        if not put:
            yield from sorted(held)
            return
        self._put(held)
        for (slot,) in sorted(list(self.waiting.keys())):
            entries = sorted(tuple(map(int, e.split(","))) for e in self.waiting.getValue((slot,))[0].split(";")[:-1])
            self.waiting.removeKey((slot,))
            yield from entries

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.now.exists()
        failures, until = self.now.get() if known else (0, 0)
        out, before = [], until
        for us, _, failed in self._in_order(rows):
            if us < until:
                continue
            failures = failures + 1 if failed else 0
            if failures >= MAX_FAILURES:
                until, failures = us + LOCK_MINUTES * 60_000_000, 0
                out.append((key[0], us, until))
        if failures or until > timerValues.getCurrentWatermarkInMs() * 1000:
            self.now.update((failures, until))
            if until != before:
                self.handle.registerTimer(-(-until // 1000))
        elif known:
            self.now.clear()
        yield pd.DataFrame(out, columns=["user_id", "locked_at_us", "locked_until_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, until = self.now.get() if self.now.exists() else (0, 0)
        if until <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            if failures:
                self.now.update((failures, 0))
            else:
                self.now.clear()
        yield pd.DataFrame([], columns=["user_id", "locked_at_us", "locked_until_us"])

    def close(self) -> None:
        pass


def lockouts(stream: DataFrame, failed: str = "error", late: str = "1 hour") -> DataFrame:
    """Accounts locked after five failures in a row, for fifteen minutes. Entries behind the watermark are dropped.

    Its state needs the RocksDB store, which this sets for streams that the session starts from now on.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    last = F.coalesce("id", F.lit(2**63 - 1))  # of entries at one moment those without an id come last; one without a time locks nothing
    s = stream.withWatermark("created_at", late).select("user_id", last.alias("id"), "created_at", F.unix_micros("created_at").alias("us"), F.coalesce(F.col("action") == failed, F.lit(False)).alias("failed"))
    locked = s.where(F.col("user_id").isNotNull() & F.col("us").isNotNull()).groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Lockout(), outputStructType="user_id long, locked_at_us long, locked_until_us long", outputMode="Append", timeMode="EventTime")
    return locked.select("user_id", F.timestamp_micros("locked_at_us").alias("locked_at"), F.timestamp_micros("locked_until_us").alias("locked_until"))


def state_rows(query) -> int:
    """Rows that the state of a finished query holds, by its last report."""
    return sum(op.get("numRowsTotal", 0) for op in query.lastProgress.get("stateOperators", []))


def dropped_late_rows(query) -> int:
    """Rows a finished query dropped for arriving behind the watermark, from its progress reports."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p.get("stateOperators", []))
