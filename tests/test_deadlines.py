import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.streaming import deadlines
from skein.streaming.relay import drained

START = datetime(2024, 1, 1)


def plain_bursts(changes, quiet, cap):
    """(key, first, flushed, n) by a fold over each key's changes in order; times in seconds."""
    out = []
    for key in {k for k, _ in changes}:
        first = last = n = None
        for at in sorted(t for k, t in changes if k == key):
            if first is None or at >= min(last + quiet, first + cap):
                if first is not None:
                    out.append((key, first, min(last + quiet, first + cap), n))
                first, n = at, 0
            last, n = at, n + 1
        out.append((key, first, min(last + quiet, first + cap), n))
    return sorted(out)


@pytest.fixture(scope="module")
def changes():
    rng, out = random.Random(6), []
    for key in "abc":
        t = 0
        for _ in range(120):
            t += rng.choice([0, 1, 5, 10, 20, 29, 30, 31, 90])
            out.append((key, t))
    return out


def rows_of(df):
    s = lambda x: (x - START).total_seconds()
    return sorted((r["key"], s(r["started"]), s(r["flushed"]), r["n"]) for r in df.collect())


def test_table_against_a_plain_fold(spark, changes):
    df = spark.createDataFrame([(k, START + timedelta(seconds=t)) for k, t in changes] + [(None, START), ("a", None)], "key string, ts timestamp")
    assert rows_of(deadlines.capped(df)) == plain_bursts(changes, 30, 120)
    assert deadlines.capped(df.limit(0)).count() == 0


def ran(spark, tmp_path, schema, batches, build):
    """What a stream over the batches' files puts out, started again from its checkpoint for each batch."""
    deadlines.with_state(spark)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = build(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        drained(stream, lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}")), str(tmp_path / "state"))
    return spark.read.parquet(str(tmp_path / "out"))


def test_stream_equals_the_fold_in_any_order_and_over_restarts(spark, tmp_path, changes):
    rng = random.Random(8)
    late = sorted(changes, key=lambda c: c[1] + rng.uniform(0, 200))  # within the delay
    parts = [late[i : i + 130] for i in range(0, len(late), 130)]
    end = [("end", 100_000)]
    batches = [[(k, START + timedelta(seconds=t)) for k, t in p] for p in [*parts, end, [("end", 200_000)], [("a", 5)]]]  # the last one is too late
    got = rows_of(ran(spark, tmp_path, "key string, ts timestamp", batches, lambda s: deadlines.capped(s, delay="10 minutes")))
    assert [r for r in got if r[0] != "end"] == plain_bursts(changes, 30, 120)


def test_memories_expire_once(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    row = lambda i, v, end, now, kind="working", state="active": (i, v, kind, state, None if end is None else at(end), at(now))
    batches = [
        [row("m1", 1, 100, 0), row("m2", 1, 100, 0), row("m3", 1, 100, 0), row("m4", 1, None, 0), row("m5", 1, 100, 0, kind="semantic"), row("m6", 1, 900, 0, state="archived")],
        [row("m2", 2, 5000, 50), row("m3", 2, 100, 60, state="archived"), row("m1", 0, 9000, 61)],  # m2 lives longer, m3 is archived, m1's old version comes late
        [row("clock", 1, None, 2000)],
        [row("clock", 2, None, 2100)],
        [row("clock", 3, None, 9000)],
        [row("clock", 4, None, 9100)],
    ]
    schema = "id string, version long, kind string, state string, expires_at timestamp, updated_at timestamp"
    got = ran(spark, tmp_path, schema, batches, lambda s: deadlines.expiring(s, "1 minute"))
    assert sorted((r["id"], r["version"], (r["expired_at"] - START).total_seconds()) for r in got.collect()) == [("m1", 2, 100), ("m2", 3, 5000)]
