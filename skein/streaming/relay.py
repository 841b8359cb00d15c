"""The outbox as a stream: reading, projecting, fanning out, windows, freshness, and the idempotent ledger.

Sinks get each batch once or again after a failure; they tell batches apart by an id and rows by
event_id, so that repeats change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.functions.lineage import shared_folder

# Event types that become memories, and the intents of others.
MEMORY_TYPES = ("signup", "purchase")
INTENTS = {"error": "investigate", "purchase": "fulfil", "signup": "welcome"}
DEPARTMENTS = {"investigate": ("ops", "support"), "fulfil": ("sales",), "welcome": ("sales", "support")}
ATTEMPTS = 3


def outbox(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").load(f"{sf_dir}/events.parquet*")


def once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event_id once: in a batch, or in a stream as long as it comes within delay."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def memories(events: DataFrame) -> DataFrame:
    """key, title, confidence, occurred_at of the events that are worth remembering."""
    return events.filter(F.col("event_type").isin(*MEMORY_TYPES)).select(F.concat(F.lit("outbox-memory:"), F.col("event_id").cast("string")).alias("key"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("title"), F.lit(0.7).alias("confidence"), F.col("ts").alias("occurred_at"))


def messages(events: DataFrame) -> DataFrame:
    """key, intent, department: a message for each department of an event's intent; events without one are passed over."""
    intents = F.create_map(*[F.lit(x) for kv in INTENTS.items() for x in kv])
    departments = F.create_map(*[x for k, v in DEPARTMENTS.items() for x in (F.lit(k), F.array(*[F.lit(d) for d in v]))])
    rows = events.withColumn("intent", F.try_element_at(intents, F.col("event_type"))).filter("intent is not null")
    return rows.select(F.concat(F.lit("outbox-broker:"), F.col("event_id").cast("string")).alias("key"), "intent", F.explode(F.try_element_at(departments, F.col("intent"))).alias("department"))


def attempted(deliveries: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """deliveries (and failures: how many attempts fail before one succeeds; null: all) with attempts and status, delivered or dead_letter."""
    fails = F.coalesce("failures", F.lit(attempts))
    return deliveries.withColumn("attempts", F.least(fails + 1, F.lit(attempts))).withColumn("status", F.when(fails < attempts, "delivered").otherwise("dead_letter"))


def bursts(events: DataFrame, gap: str = "30 seconds", delay: str = "10 minutes") -> DataFrame:
    """user_id, started, ended, n of bursts of events with no gap of that length: session windows, for streams and tables."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", delay) if rows.isStreaming else rows
    s = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("w.end").cast("timestamp_ntz").alias("ended"), "n")


def windows(events: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """An extension: started, event_type, n by fixed windows."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", delay) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("started"), "event_type", "n")


def freshness(events: DataFrame) -> DataFrame:
    """path, status of columns path, kind (edited or synced), ts: pending if an edit came after the last sync."""
    last = lambda k: F.max(F.when(F.col("kind") == k, F.col("ts")))
    s = events.groupBy("path").agg(last("edited").alias("e"), last("synced").alias("s"))
    return s.select("path", F.when(F.col("e").isNull(), "ok").when(F.col("s").isNull() | (F.col("e") > F.col("s")), "pending").otherwise("ok").alias("status"))


def ledger(commands: DataFrame) -> DataFrame:
    """command_id, outcome of columns command_id, key, fingerprint, ts: the first of a key is applied, the same again is a replay, another is a conflict."""
    first = commands.groupBy("key").agg(F.min(F.struct("ts", "command_id", "fingerprint")).alias("f"))
    rows = commands.join(first, "key")
    return rows.select("command_id", F.when(F.col("command_id") == F.col("f.command_id"), "applied").when(F.col("fingerprint").eqNullSafe(F.col("f.fingerprint")), "replayed").otherwise("conflict").alias("outcome"))


def drained(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs all that there is through sink, batch by batch, and ends."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def audits(events: DataFrame) -> DataFrame:
    """key, actor, action, occurred_at: a row for every event."""
    return events.select(F.concat(F.lit("outbox-audit:"), F.col("event_id").cast("string")).alias("key"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("action"), F.col("ts").alias("occurred_at"))


def relayed(spark: SparkSession, sf_dir: str, project: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What project makes of the outbox, through a stream; each event counts once, in whatever batches it comes.

    A batch is written under its number, so that a repeated batch overwrites itself, and the ids of
    its events beside it, by day; a later batch leaves out events whose ids earlier ones have on
    the days that it touches. No event is dropped for being late.
    """
    at = f"{shared_folder(spark)}/relay-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        own = batch.dropDuplicates(["event_id"]).withColumn("day", F.concat_ws("", F.lit("d"), F.to_date("ts").cast("string"))).persist()  # read as days, rows and ids
        fresh = own
        if number:
            days = [r["day"] for r in own.select("day").distinct().collect()]  # as many as a batch has days
            before = spark.read.parquet(f"{at}/ids").filter((F.col("batch") < number) & F.col("day").isin(*days)).select("event_id")
            fresh = own.join(before, "event_id", "left_anti")
        project(fresh.select(*batch.columns)).write.mode("overwrite").parquet(f"{at}/out/batch={number}")
        fresh.select("event_id", "day").write.mode("overwrite").partitionBy("day").parquet(f"{at}/ids/batch={number}")
        own.unpersist()

    drained(outbox(spark, sf_dir), sink, f"{at}/state")
    return spark.read.parquet(f"{at}/out").drop("batch")


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("command_id"), F.concat_ws("-", F.col("user_id").cast("string"), F.col("event_type")).alias("key"), F.floor("value").alias("fingerprint"), "ts")


QUERIES = {
    "e01_outbox": lambda spark, d: relayed(spark, d, lambda b: b.select("event_id", "event_type", "user_id")),
    "e02_memories": lambda spark, d: relayed(spark, d, memories),
    "e03_audit": lambda spark, d: relayed(spark, d, audits),
    "e04_messages": lambda spark, d: relayed(spark, d, messages),
    "e05_dead_letters": lambda spark, d: attempted(messages(spark.read.parquet(f"{d}/events.parquet")).withColumn("failures", F.when(F.col("department") == "ops", F.lit(None).cast("int")).otherwise(F.length("key") % 4))).select("key", "department", "attempts", "status"),
    "e07_ledger": lambda spark, d: ledger(_commands(spark, d)),
    "e08_freshness": lambda spark, d: freshness(spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("path"), F.when(F.col("event_type") == "error", "synced").when(F.col("event_type") == "click", "edited").alias("kind"), "ts")),
    "e09_bursts": lambda spark, d: bursts(spark.read.parquet(f"{d}/events.parquet"), "6 hours"),
    "ext_windows": lambda spark, d: windows(spark.read.parquet(f"{d}/events.parquet")),
}
_INTENT = "case event_type when 'error' then 'investigate' when 'purchase' then 'fulfil' when 'signup' then 'welcome' end"
_M = f"m as (select 'outbox-broker:' || event_id as key, {_INTENT} as intent, unnest(case event_type when 'error' then ['ops', 'support'] when 'purchase' then ['sales'] when 'signup' then ['sales', 'support'] end) as department from events where event_type in ('error', 'purchase', 'signup'))"
ORACLE_SQL = {
    "e01_outbox": "select event_id, event_type, user_id from events",
    "e02_memories": "select 'outbox-memory:' || event_id as key, event_type || ' ' || user_id as title, 0.7::double as confidence, ts as occurred_at from events where event_type in ('signup', 'purchase')",
    "e03_audit": "select 'outbox-audit:' || event_id as key, user_id::varchar as actor, event_type as action, ts as occurred_at from events",
    "e04_messages": f"with {_M} select * from m",
    "e05_dead_letters": f"with {_M} select key, department, case when department = 'ops' then 3 else least(length(key) % 4 + 1, 3) end::int as attempts, case when department <> 'ops' and length(key) % 4 < 3 then 'delivered' else 'dead_letter' end as status from m",
    "e07_ledger": "with c as (select event_id, user_id || '-' || event_type as key, floor(value) as f, ts from events), x as (select *, first_value(event_id) over w as e, first_value(f) over w as g from c window w as (partition by key order by ts, event_id)) select event_id as command_id, case when event_id = e then 'applied' when f is not distinct from g then 'replayed' else 'conflict' end as outcome from x",
    "e08_freshness": "with s as (select user_id as path, max(ts) filter (event_type = 'click') as e, max(ts) filter (event_type = 'error') as s from events group by 1) select path, case when e is null then 'ok' when s is null or e > s then 'pending' else 'ok' end as status from s",
    "e09_bursts": "with o as (select user_id, ts, case when ts < lag(ts) over w + interval 6 hours then 0 else 1 end as first from events window w as (partition by user_id order by ts)), g as (select user_id, ts, sum(first) over (partition by user_id order by ts rows unbounded preceding) as g from o) select user_id, min(ts) as started, max(ts) + interval 6 hours as ended, count(*) as n from g group by user_id, g",
    "ext_windows": "select date_trunc('day', ts)::timestamp as started, event_type, count(*) as n from events group by 1, 2",
}
