"""Stateful jobs deal keys to a bounded number of buckets: results per key are as before, calls and state rows are bounded."""

from pyspark.sql import functions as F

from tallyglass.session import fresh_path
from tallyglass.streaming import jobs as J

BUCKETS = 4


def events_of(spark, rows):
    """A folder with one file per element of `rows`, each a list of (event_id, seconds, user_id, event_type)."""
    path = fresh_path(spark, "bucket-events")
    for part in rows:
        spark.createDataFrame(part, "event_id long, t long, user_id long, event_type string").select(
            "event_id", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("").alias("props")).coalesce(1).write.mode("append").parquet(path)
    return J.file_events(spark, path, glob="*.parquet", files_per_trigger=1)


def run(stream, path):
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-c").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])


def test_repeats_of_many_keys_in_few_buckets(spark, monkeypatch):
    """Null and empty keys are keys of their own; a large number next to a null keeps its digits; keys pause for a batch."""
    monkeypatch.setattr(J._keyed, "__defaults__", (None, BUCKETS))
    users = [None, 0, 2**60 + 1, *range(1, 300)]
    rows = [(2**60 + 1 + b * 10_000 + i, 1_700_000_000 + b * 1000 + i % 7, u, [None, "", "a"][i % 3]) for b in range(3) for i, u in enumerate(users) if b != 1 or i % 2]
    path = fresh_path(spark, "bucket-out")
    stream = events_of(spark, [rows[:len(rows) // 3], rows[len(rows) // 3:2 * len(rows) // 3], rows[2 * len(rows) // 3:]])
    assert run(J.repeated_events(stream, ["user_id", "event_type"], 1500, "3650 days"), path) <= BUCKETS
    want, seen = set(), {}
    for e, t, u, k in sorted(rows, key=lambda r: (r[1], r[0])):
        n, last = seen.get((u, k), (0, 0))
        n = n + 1 if n and t - last <= 1500 else 1
        seen[u, k] = n, t
        if n > 1:
            want.add((u, k, e, n))
    assert {(r["user_id"], r["event_type"], r["event_id"], r["n"]) for r in spark.read.parquet(path).collect()} == want and len(want) > 300


def test_timers_of_keys_that_share_a_bucket(spark, monkeypatch):
    """A key's timer goes off though others of its bucket have rows in that batch, and theirs does not."""
    monkeypatch.setattr(J._keyed, "__defaults__", (None, BUCKETS))
    base = 1_700_000_000
    first = [(i, base + i, i, "error") for i in range(50)]
    later = [(100 + i, base + 5000 + i, 1000 + i, "error") for i in range(50)]
    last = [(200 + i, base + 5100 + i, 1000 + i, "error") for i in range(50)]
    path = fresh_path(spark, "bucket-out")
    assert run(J.expiring_violations(events_of(spark, [first, later, last]), "user_id", 3600, "10 minutes"), path) <= BUCKETS
    got = sorted((r["violation"], r["state"], r["at"]) for r in spark.read.parquet(path).collect())
    assert got == sorted([(i, s, float(base + i + w)) for i in range(50) for s, w in (("active", 0), ("resolved", 3600))] + [(1000 + i, "active", float(base + 5000 + i)) for i in range(50)])
