"""Deadlines in event time: bursts of changes with a cap on their age, and memories that expire.

Streams keep a key's state in transformWithState and act when the watermark passes a timer, so a
result does not depend on the order in which events come, nor on how they fall into batches; a
query that is started again from its checkpoint goes on with the same state and timers. State needs
the RocksDB provider (`with_state`). Events that come after the watermark has passed them are left
out, as for any watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skein.sources.tables import table

#: A burst is flushed after so long without a change, or so long after its first change.
QUIET_MS = 30_000
CAP_MS = 120_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BURST = "key string, started timestamp, flushed timestamp, n long"


def with_state(spark: SparkSession) -> None:
    """Set the state store that these streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Burst:
    """One key's open burst: its first and last change in milliseconds, and how many it has."""

    def __init__(self, first: int | None = None, last: int | None = None, n: int = 0):
        self.first, self.last, self.n = first, last, n

    def deadline(self, quiet: int, cap: int) -> int:
        return min(self.last + quiet, self.first + cap)

    def add(self, at: int, quiet: int, cap: int) -> tuple[int, int, int] | None:
        """Take a change in; the burst (first, flushed, n) that its deadline has ended before, if any."""
        ended = self.flush(at, quiet, cap) if self.n else None
        self.first, self.last, self.n = (at if not self.n else self.first), at, self.n + 1
        return ended

    def flush(self, at: int, quiet: int, cap: int) -> tuple[int, int, int] | None:
        """The burst, if its deadline is not after at; then none is open."""
        if not self.n or self.deadline(quiet, cap) > at:
            return None
        out = (self.first, self.deadline(quiet, cap), self.n)
        self.first, self.last, self.n = None, None, 0
        return out


def _frame(key: str, rows: list[tuple[int, int, int]]) -> pd.DataFrame:
    at = lambda i: pd.to_datetime([r[i] for r in rows], unit="ms")
    return pd.DataFrame({"key": [key] * len(rows), "started": at(0), "flushed": at(1), "n": [r[2] for r in rows]})


class Bursts(StatefulProcessor):
    """Two deadlines a key: changes wait until the watermark has passed them, are folded in order, and the open burst is flushed by a timer."""

    def __init__(self, quiet: int, cap: int):
        self.quiet, self.cap = quiet, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, n long")
        self.waiting = handle.getMapState("waiting", "at long", "n long")  # changes by their time: repeats add up

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at, n in frame.groupby("at")["n"].sum().items():
                at = int(at)
                had = self.waiting.getValue((at,))[0] if self.waiting.containsKey((at,)) else 0
                self.waiting.updateValue((at,), (had + int(n),))
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        burst = Burst(*self.open.get()) if self.open.exists() else Burst()
        out = []
        for at in sorted(k[0] for k in self.waiting.keys() if k[0] <= now):
            n = self.waiting.getValue((at,))[0]
            if (ended := burst.add(at, self.quiet, self.cap)) is not None:
                out.append(ended)
            burst.n += n - 1
            self.waiting.removeKey((at,))
        if (ended := burst.flush(now, self.quiet, self.cap)) is not None:
            out.append(ended)
        if burst.n:
            self.open.update((burst.first, burst.last, burst.n))
            self.handle.registerTimer(burst.deadline(self.quiet, self.cap))
        else:
            self.open.clear()
        return iter([_frame(key[0], out)] if out else [])

    def close(self) -> None:
        pass


def capped(changes: DataFrame, quiet_ms: int = QUIET_MS, cap_ms: int = CAP_MS, delay: str = "10 minutes") -> DataFrame:
    """key, started, flushed, n of bursts of changes (key, ts): one is flushed once it was quiet for quiet_ms, or cap_ms after its first change.

    A change at the very deadline begins the next burst. In a stream, bursts come out as the
    watermark passes their deadlines; the last of a key comes once later events move the watermark.
    In a table all come out. Changes without a key or time are left out.
    """
    rows = changes.filter("key is not null and ts is not null").select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    if rows.isStreaming:
        timed = rows.withWatermark("ts", delay).select("key", F.unix_millis("ts").alias("at"), F.lit(1).cast("long").alias("n"), "ts")
        return timed.groupBy("key").transformWithStateInPandas(Bursts(quiet_ms, cap_ms), _BURST, "append", "eventTime")
    at = F.unix_millis("ts")
    each = rows.groupBy("key", at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("key").orderBy("at")
    apart = F.coalesce(F.col("at") - F.lag("at").over(w) >= quiet_ms, F.lit(True))
    # Quiet times cut a key into sessions, which are dealt out by themselves; the cap is a fold within one, in order, that holds one burst.
    sessions = each.withColumn("session", F.sum(apart.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, burst = None, Burst()
        for b in batches:
            out: list[tuple] = []
            for key, session, at, n in zip(*(b[c].to_pylist() for c in ("key", "session", "at", "n"))):
                if now != (key, session):
                    if burst.n:
                        out.append((now[0], burst.first, burst.deadline(quiet_ms, cap_ms), burst.n))
                    now, burst = (key, session), Burst()
                if (ended := burst.add(at, quiet_ms, cap_ms)) is not None:
                    out.append((key, *ended))
                burst.n += n - 1
            yield _batch(out)
        if burst.n:
            yield _batch([(now[0], burst.first, burst.deadline(quiet_ms, cap_ms), burst.n)])

    folded = sessions.repartition("key", "session").sortWithinPartitions("key", "session", "at").mapInArrow(fold, "key string, started long, flushed long, n long")
    return folded.select("key", F.timestamp_millis("started").alias("started"), F.timestamp_millis("flushed").alias("flushed"), "n")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3))], names=["key", "started", "flushed", "n"])


class Expiry(StatefulProcessor):
    """The latest version of each memory, and a timer at its end: then it turns stale, once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "version long, expires long, live boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.latest.get()) if self.latest.exists() else None
        for frame in rows:
            for version, expires, live in zip(frame["version"], frame["expires"], frame["live"]):
                if best is None or int(version) >= best[0]:  # an older version that comes late changes nothing
                    best = (int(version), -1 if pd.isna(expires) else int(expires), bool(live))
        if best is not None:
            self.latest.update(best)
            if best[2] and best[1] >= 0:
                self.handle.registerTimer(best[1])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        out = []
        if self.latest.exists():
            version, expires, live = tuple(self.latest.get())
            if live and 0 <= expires <= now:  # a version with a later end, or one archived since, has outlived this timer
                out.append((version + 1, expires))
                self.latest.update((version + 1, -1, False))
        return iter([pd.DataFrame({"id": [key[0]], "version": [o[0] for o in out], "expired_at": pd.to_datetime([o[1] for o in out], unit="ms")})] if out else [])

    def close(self) -> None:
        pass


def expiring(items: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """id, version, expired_at of the transitions to stale of memories that expire, from a stream of their versions.

    items: id, version, kind, state, expires_at, updated_at (the event's time). Working memories that
    are active or candidates expire when the watermark reaches expires_at: version is one more. A
    version that comes later with another end or state replaces what was waiting; the greatest wins.
    """
    live = (F.col("kind") == "working") & F.col("state").isin("active", "candidate")
    rows = items.filter("id is not null and version is not null").withColumn("updated_at", F.col("updated_at").cast("timestamp")).withWatermark("updated_at", delay)
    timed = rows.select(F.col("id").cast("string").alias("id"), F.col("version").cast("long").alias("version"), F.unix_millis(F.col("expires_at").cast("timestamp")).alias("expires"), F.coalesce(live, F.lit(False)).alias("live"), "updated_at")
    return timed.groupBy("id").transformWithStateInPandas(Expiry(), "id string, version long, expired_at timestamp", "append", "eventTime")


_HOURS = 3_600_000


def e09_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' bursts: flushed after six quiet hours, or a day after their first event."""
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts")
    found = capped(changes, 6 * _HOURS, 24 * _HOURS)
    return found.select("key", F.col("started").cast("timestamp_ntz").alias("started"), F.col("flushed").cast("timestamp_ntz").alias("flushed"), "n")


QUERIES = {"e09_capped": e09_capped}
ORACLE_SQL = {
    "e09_capped": """with recursive o as (select user_id, date_trunc('millisecond', ts) as t, count(*) as n from events where user_id is not null and ts is not null group by all),
r as (select *, row_number() over (partition by user_id order by t) as i, lag(t) over (partition by user_id order by t) as before from o),
f as (select user_id, i, t as started, t, n from r where i = 1
  union all select r.user_id, r.i, case when r.t < r.before + interval 6 hours and r.t < f.started + interval 24 hours then f.started else r.t end, r.t, r.n from f join r on r.user_id = f.user_id and r.i = f.i + 1)
select user_id::varchar as key, started, least(max(t) + interval 6 hours, started + interval 24 hours) as flushed, sum(n)::bigint as n from f group by user_id, started"""
}
