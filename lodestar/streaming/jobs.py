"""Structured Streaming jobs over the event log; each gives on the same events what its batch twin gives.

Events have the columns id, ts (timestamp), query, item, session, position, result_count, location. Watermarks bound the state, but
for ``stream_failed_queries``, whose state is its report: one row per failed query and place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.sources.bucketed import BucketedTable

LATE = "1 hour"
TZ = "America/Edmonton"


def read_events(spark, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def dedupe_events(events: DataFrame, late: str = LATE, key: str = "id") -> DataFrame:
    """Each event once, as far as its copies come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def stream_click_counts(events: DataFrame, late: str = LATE, window: str = "1 hour") -> DataFrame:
    """Clicks and last click per item and window."""
    clicks = events.where("item IS NOT NULL").withWatermark("ts", late)
    return clicks.groupBy(F.window("ts", window), "item").agg(F.count("*").alias("clicks"), F.max("ts").alias("last_click"))


def stream_failed_queries(events: DataFrame) -> DataFrame:
    """Count, first and last time per failed query and place, for the update output mode."""
    rows = events.where("result_count = 0").withColumn("location", F.coalesce("location", F.lit("")))
    return rows.groupBy("query", "location").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def stream_trends(events: DataFrame, late: str = LATE, tz: str = TZ) -> DataFrame:
    """Searches and clicks per local hour."""
    rows = events.withWatermark("ts", late)
    hours = rows.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("searches"), F.count("item").alias("clicks"))
    local = F.from_utc_timestamp("window.start", tz)
    return hours.select(F.to_date(local).alias("day"), F.hour(local).cast("long").alias("hour"), "searches", "clicks")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Number of events per session window."""
    rows = events.where("session IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "session").agg(F.count("*").alias("depth")).select("session", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "depth")


def stream_affinity(events: DataFrame, late: str = LATE, window: str = "1 day") -> DataFrame:
    """Clicks and impressions per query, item and day; decay is applied at reading."""
    rows = events.where("shown IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window), "query", F.col("shown").alias("item")).agg(F.count("*").alias("impressions"), F.count("item").alias("clicks"), F.max(F.when(F.col("item").isNotNull(), F.col("ts"))).alias("last_click"))


def affinity_at(windows: DataFrame, now, least: int = 5, half: float = 30.0) -> DataFrame:
    """Affinity from the windows of stream_affinity at a given time."""
    sums = windows.groupBy("query", "item").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.max("last_click").alias("last_click"))
    age = (F.unix_timestamp(now) - F.unix_timestamp("last_click")) / 86400.0
    score = F.when(F.col("impressions") > least, F.col("clicks") / F.col("impressions") * F.coalesce(F.exp(-age / half), F.lit(0.0)))
    return sums.withColumn("affinity", F.round(F.coalesce(score, F.lit(0.0)), 6))


ATTRIBUTED = "session string, id long, click_count long, first_click_position int"
STATE = "search long, clicks long, first int, last long, times array<long>, clicked array<boolean>, ids array<long>, positions array<int>"
DAY_MS = 86_400_000


def _attribute(idle_ms: int):
    def attribute(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        search, clicks, first, last, *waiting = state.get if state.exists else (None, 0, None, 0, [], [], [], [])
        events = list(zip(*waiting, strict=True))
        if not state.hasTimedOut:
            for pdf in frames:
                events += [(int(t), bool(c), int(i), None if pd.isna(p) else int(p)) for t, c, i, p in zip(pdf["at"], pdf["clicked"], pdf["id"], pdf["position"], strict=True)]
        events.sort(key=lambda e: e[:3])
        mark, out, ready = state.getCurrentWatermarkMs(), [], 0
        for at, is_click, event, position in events:
            if at > mark * 1000:
                break
            ready, last = ready + 1, at // 1000
            if not is_click:
                search, clicks, first = event, 0, None
            elif search is not None:
                clicks += 1
                first = position if first is None else first
                out.append((key[0], search, clicks, first))
        events = events[ready:]
        if not events and (search is None or last + idle_ms < mark):
            state.remove()
        else:
            state.update((search, clicks, first, last, *([e[k] for e in events] for k in range(4))))
            state.setTimeoutTimestamp(max(mark + 1, events[0][0] // 1000 + 1 if events else last + idle_ms))
        yield pd.DataFrame(out, columns=["session", "id", "click_count", "first_click_position"]).astype({"first_click_position": "Int32"})

    return attribute


def stream_attribution(events: DataFrame, late: str = LATE, idle_days: int = 90) -> DataFrame:
    """Each click updates its session's latest search (id): click count and first position so far, for the update output mode.

    Events of a session wait until the watermark has passed them and are then taken in order of time, so files may arrive in any
    order within ``late``. State is what waits and one small row per session, which goes after ``idle_days`` without events.
    """
    rows = events.withWatermark("ts", late).where("session IS NOT NULL")
    rows = rows.select(F.col("session").cast("string").alias("session"), "ts", "id", F.unix_micros("ts").alias("at"), F.col("item").isNotNull().alias("clicked"), F.col("position").cast("int").alias("position"))
    return rows.groupBy("session").applyInPandasWithState(_attribute(idle_days * DAY_MS), ATTRIBUTED, STATE, "update", GroupStateTimeout.EventTimeTimeout)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REFORMULATED = "session string, id long, ts timestamp, reformulated boolean"


WAITING = pa.schema([("session", pa.string()), ("at", pa.int64()), ("id", pa.int64())])


def _packed(searches: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, WAITING) as out:
        out.write_table(searches)
    return sink.getvalue().to_pybytes()


def _unpacked(searches: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(searches)).read_all()


class _Reformulations(StatefulProcessor):
    """Keeps the searches of a bucket of sessions until the watermark has passed the time in which another one would count.

    A batch's searches are one element of the state and are judged as columns, so calls between Spark and Python grow with the
    buckets and not with sessions or searches.
    """

    def __init__(self, seconds: int) -> None:
        self.gap = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "searches binary")

    def _wake(self, first: int) -> None:
        """One timer per bucket: when its earliest search can be judged."""
        due, timers = (first + self.gap) // 1000 + 1, list(self.handle.listTimers())
        if not timers or due < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues):
        new = pa.Table.from_pandas(pd.concat([pdf[["session", "at", "id"]] for pdf in rows]), WAITING, preserve_index=False)
        kept = new.filter(pc.is_valid(new["session"]))
        if kept.num_rows:
            self.waiting.appendValue((_packed(kept),))
            self._wake(pc.min(kept["at"]).as_py())
        if kept.num_rows < new.num_rows:
            rest = new.filter(pc.is_null(new["session"]))
            yield self._frame(rest, np.zeros(rest.num_rows, bool))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        events = pa.concat_tables(_unpacked(e[0]) for e in self.waiting.get()).sort_by([(c, "ascending") for c in WAITING.names])
        at = events["at"].to_numpy()
        again = pc.equal(events["session"][1:], events["session"][:-1]).to_numpy() & (at[1:] - at[:-1] <= self.gap)
        ready = at + self.gap < mark
        if ready.all():
            self.waiting.clear()
        else:
            rest = events.filter(pa.array(~ready))
            self.waiting.put([(_packed(rest),)])
            self._wake(pc.min(rest["at"]).as_py())
        yield self._frame(events.filter(pa.array(ready)), np.append(again, False)[ready])

    @staticmethod
    def _frame(searches: pa.Table, again: np.ndarray) -> pd.DataFrame:
        out = searches.to_pandas()
        ts = pd.to_datetime(out["at"], unit="us", utc=True)
        return pd.DataFrame({"session": out["session"].astype(object), "id": out["id"], "ts": ts, "reformulated": again})

    def close(self) -> None:
        pass


def stream_reformulations(events: DataFrame, seconds: int = 30, late: str = LATE, buckets: int = 256) -> DataFrame:
    """Each search once, with whether its session searched again within some seconds; for the append output mode.

    A search is judged when the watermark passes its time and those seconds, so files may come in any order within ``late``. State holds
    the searches of the last ``late`` and ``seconds`` only; a session that falls silent has none. Sessions are dealt to ``buckets`` by
    hash, and the waiting searches of one bucket are in memory at once. Searches without a session are judged at once, as not
    reformulated. Sets the RocksDB state store, which timers and lists need.
    """
    events.sparkSession.conf.set(STORE, ROCKSDB)
    rows = events.withWatermark("ts", late).select(F.col("session").cast("string").alias("session"), "ts", F.col("id").cast("long").alias("id"), F.unix_micros("ts").alias("at"))
    # Events without a session are spread by their ids instead of meeting in one bucket.
    spread = F.when(F.col("session").isNull(), F.xxhash64("id")).otherwise(F.xxhash64("session"))
    keyed = rows.withColumn("_k", F.pmod(spread, F.lit(buckets)))
    return keyed.groupBy("_k").transformWithStateInPandas(_Reformulations(seconds), REFORMULATED, "Append", "EventTime")


def failed_query_table(root: str, buckets: int = 64) -> BucketedTable:
    return BucketedTable(root, ("query", "location"), "query string, location string, n long, first_seen timestamp, last_seen timestamp", buckets)


def store_failed_queries(table: BucketedTable, keep_days: int | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds a batch's failed queries to a stored table, as often as the batch is replayed only once.

    Keys whose last failure lies ``keep_days`` before the batch's newest event go when their bucket is next written. State is the table:
    the stream itself keeps none, and a batch reads and writes its own buckets only.
    """
    how = {"n": F.coalesce("b.n", F.lit(0)) + F.col("d.n"), "first_seen": F.least("b.first_seen", "d.first_seen"), "last_seen": F.greatest("b.last_seen", "d.last_seen")}

    def run(df: DataFrame, batch_id: int) -> None:
        keep: Column | None = None
        if keep_days is not None:
            newest = df.agg(F.max("ts")).first()[0]
            keep = None if newest is None else F.col("last_seen") >= F.lit(newest) - F.make_dt_interval(F.lit(keep_days))
        table.merge(stream_failed_queries(df), batch_id, how, keep)

    return run


def read_failed_queries(table: BucketedTable, spark: SparkSession, since: Column | None = None) -> DataFrame:
    """The stored counts; ``since`` also hides old keys whose bucket was not written again."""
    rows = table.read(spark)
    return rows if since is None else rows.where(F.col("last_seen") >= since)


def upsert_batches(apply: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that skips empty batches."""

    def run(df: DataFrame, batch_id: int) -> None:
        if df.head(1):
            apply(df, batch_id)

    return run
