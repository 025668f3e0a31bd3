"""Stateful jobs against plain walks, over several files."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from tallyglass.session import fresh_path
from tallyglass.streaming import jobs as J


@pytest.fixture(scope="module")
def stream_folder(spark, folder):
    """Events split by time into three files, one micro-batch each."""
    path = fresh_path(spark, "event-files")
    events = spark.read.parquet(f"{folder}/events.parquet")
    cuts = [F.lit("2023-01-01"), F.lit("2024-01-11"), F.lit("2024-01-21"), F.lit("2030-01-01")]
    for i in range(3):
        part = events.where((F.col("ts") >= cuts[i].cast("timestamp_ntz")) & (F.col("ts") < cuts[i + 1].cast("timestamp_ntz")))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return J.file_events(spark, path, glob="*.parquet", files_per_trigger=1)


def walk(spark, folder):
    rows = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["t"], r["event_id"])):
        out.setdefault(r["user_id"], []).append(r)
    return out


def test_sliding_limit(spark, folder, stream_folder):
    got = {r["event_id"]: (r["allowed"], r["wait_seconds"]) for r in spark.read.parquet(J.run_to_table(J.sliding_limit(stream(spark, stream_folder), "user_id", 2, 86400), "t")).collect()}
    want = {}
    for rows in walk(spark, folder).values():
        kept = deque()
        for r in rows:
            while kept and kept[0] < r["t"] - 86400:
                kept.popleft()
            if len(kept) < 2:
                kept.append(r["t"])
                want[r["event_id"]] = (True, 0.0)
            else:
                want[r["event_id"]] = (False, pytest.approx(86400 - (r["t"] - kept[0])))
    assert got == want and any(not a for a, _ in got.values())


def test_token_bucket(spark, folder, stream_folder):
    rows = spark.read.parquet(J.run_to_table(J.token_bucket(stream(spark, stream_folder), "user_id", 3, 1 / 43200), "t")).collect()
    got = {r["event_id"]: (r["allowed"], r["tokens"]) for r in rows}
    for client in walk(spark, folder).values():
        tokens, last = 3.0, client[0]["t"]
        for r in client:
            tokens = min(3.0, tokens + (r["t"] - last) / 43200)
            last = r["t"]
            ok = tokens >= 1
            tokens -= 1 if ok else 0
            assert got[r["event_id"]] == (ok, pytest.approx(tokens, abs=1e-9))


def test_deadlines_alert_once(spark, folder, stream_folder):
    started, finished = F.col("event_type") == "signup", F.col("event_type") == "purchase"
    rows = spark.read.parquet(J.run_to_table(J.deadline_alerts(stream(spark, stream_folder), "user_id", started, finished, 86400), "t")).collect()
    got = sorted((r["task"], round(r["started_at"], 3)) for r in rows)
    assert len(got) == len(set(got))
    last = max(r["t"] for c in walk(spark, folder).values() for r in c) - 600
    want = []
    for user, client in walk(spark, folder).items():
        begun = None
        for r in client:
            if begun is not None and r["t"] > begun + 86400:
                want.append((user, round(begun, 3)))
                begun = None
            if r["event_type"] == "signup" and begun is None:
                begun = r["t"]
            elif r["event_type"] == "purchase":
                begun = None
        if begun is not None and begun + 86400 < last - 1:
            want.append((user, round(begun, 3)))
    assert got == sorted(want)


def test_violations_expire(spark, stream_folder):
    errors = stream(spark, stream_folder).where(F.col("event_type") == "error")
    rows = spark.read.parquet(J.run_to_table(J.expiring_violations(errors, "user_id"), "t"))
    seen = {}
    for r in sorted(rows.collect(), key=lambda r: (r["violation"], r["at"], r["state"] == "active")):
        history = seen.setdefault(r["violation"], [])
        if r["state"] == "active":
            assert not history or history[-1][0] == "resolved"
        else:
            assert history[-1][0] == "active" and r["at"] == pytest.approx(history[-1][1] + 3600)
        history.append((r["state"], r["at"]))


def test_retries_come_out_when_due(spark, folder, stream_folder):
    retries = stream(spark, stream_folder).withColumn("due", F.unix_micros("ts") / 1e6 + 3600)
    got = sorted(r["due"] for r in spark.read.parquet(J.run_to_table(J.due_retries(retries, "user_id", "due"), "t")).collect())
    times = [r["t"] for c in walk(spark, folder).values() for r in c]
    assert got == pytest.approx(sorted(t + 3600 for t in times if t + 3600 <= max(times)))


def test_running_estimate_over_batches(spark, folder, stream_folder):
    path = J.run_estimates(stream(spark, stream_folder), "event_type", "value")
    got = {r["key"]: r["estimate"] for r in J.latest_rows(spark, path, ["key"]).collect()}
    rows = sorted((r for c in walk(spark, folder).values() for r in c), key=lambda r: (r["t"], r["event_id"]))
    want = {}
    for r in rows:
        k = r["event_type"]
        want[k] = r["value"] if k not in want else 0.7 * want[k] + 0.3 * r["value"]
    assert got == pytest.approx(want)


def test_estimate_of_a_hot_key_and_of_keys_that_pause(spark):
    """One key with nine tenths of the rows spread over hours; others that miss a batch or come late; nulls do not count."""
    path = fresh_path(spark, "hot-events")
    rows = [(i, i * 40, "hot" if i % 10 else ("first" if i < 300 else "late"), float(i % 7) if i % 13 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id long, t long, event_type string, value double").select(
        "event_id", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), "event_type", "value", F.lit("").alias("props"))
    for i in range(3):
        df.where(f"event_id div 300 = {i}").coalesce(1).write.mode("append").parquet(path)
    made = J.latest_rows(spark, J.run_estimates(stream(spark, path), "event_type", "value", chunk_seconds=600), ["key"]).collect()
    want = {}
    for _, _, k, v in rows:
        if v is not None:
            n, e = want.get(k, (0, v))
            want[k] = (n + 1, 0.7 * e + 0.3 * v if n else v)
    assert {r["key"]: r["n"] for r in made} == {k: n for k, (n, _) in want.items()}
    assert {r["key"]: r["estimate"] for r in made} == pytest.approx({k: e for k, (_, e) in want.items()})


def test_repeats_in_later_batches(spark, folder, stream_folder):
    """Events whose user was seen within ten days before, whichever file the earlier one was in."""
    keep = 10 * 86400
    got = {r["event_id"]: r["n"] for r in spark.read.parquet(J.run_to_table(J.repeated_events(stream(spark, stream_folder), ["user_id"], keep, "3650 days"), "t")).collect()}
    want = {}
    for rows in walk(spark, folder).values():
        n, last = 0, None
        for r in rows:
            n = n + 1 if last is not None and r["t"] - last <= keep else 1
            last = r["t"]
            if n > 1:
                want[r["event_id"]] = n
    assert got == want and want


def test_malformed_events_become_nulls(spark):
    raw = spark.createDataFrame([('{"task_id": "a", "runtime_s": 1.5}',), ("not json",)], "line string")
    rows = J.parse_events(raw, "line", "task_id string, runtime_s double").collect()
    assert sorted((r["task_id"] or "", r["runtime_s"] or 0.0) for r in rows) == [("", 0.0), ("a", 1.5)]
