"""Structured Streaming jobs over task events: alerts, rate limits, timers and running statistics.

Event tables carry ts as timestamp (cast from the zone-free type first: a
watermark needs it).  Sinks are tables in the shared folder; nothing is
gathered on the driver.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyglass.functions.expressions import one, union_all
from tallyglass.operators.quality import check_duplicates, check_missing
from tallyglass.operators.runlog import estimate_pieces
from tallyglass.operators.schema import enforce_contract
from tallyglass.session import fresh_path

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


# ---- sources and sinks ----

def file_events(spark: SparkSession, folder: str, glob: str = "events.parquet", schema: str = EVENT_SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, ts as timestamp; `files_per_trigger` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def parse_events(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON text (a Kafka value, a line) to typed event columns; text that is not an event becomes nulls."""
    return raw.select("*", F.from_json(F.col(column).cast("string"), schema).alias("_e")).select(*raw.columns, "_e.*")


def run_to_table(stream: DataFrame, label: str, path: str | None = None) -> str:
    """Run everything available into an append table; returns its path."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, label)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(
        availableNow=True).start(path)
    query.awaitTermination()
    return path


def run_batches(stream: DataFrame, label: str, each: Callable[[DataFrame], DataFrame] = lambda df: df, mode: str = "update") -> str:
    """Run everything available; each micro-batch result overwrites its own partition, so a repeated batch is not counted twice."""
    spark = stream.sparkSession
    path = fresh_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").foreachBatch(write).trigger(
        availableNow=True).start()
    query.awaitTermination()
    return path


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last emitted row of each key of an update-mode result."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in keys and c != "batch_id"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("_s")).select(*keys, "_s.*")


# ---- declarative jobs ----

def error_rate_alerts(events: DataFrame, failed: Column, window: str = "5 minutes", limit: float = 0.05, delay: str = "10 minutes") -> DataFrame:
    """window_start, n, errors, error_rate of windows above the limit."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w")) if events.isStreaming else events.groupBy(F.window("ts", window).alias("w"))
    rates = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(one(failed)).alias("errors"))
    return rates.select(F.col("w.start").alias("window_start"), "n", "errors", (F.col("errors") / F.col("n")).alias("error_rate")).where(
        F.col("error_rate") > limit)


def running_statistics(events: DataFrame, agent: str, succeeded: Column, runtime: str) -> DataFrame:
    """agent, total, succeeded, success_rate, avg_runtime; in update mode on a stream."""
    return events.groupBy(F.col(agent).alias("agent")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(one(succeeded)).alias("succeeded"), F.avg(one(succeeded)).alias("success_rate"),
        F.avg(runtime).alias("avg_runtime"))


def distinct_events(events: DataFrame, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """First event per id; repeats later than `delay` behind the watermark are out of reach."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def recent_counts(events: DataFrame, client: str, seconds: float = 60, sub_hour: int = 3600) -> DataFrame:
    """Batch twin of the plain sliding count: requests of the client in the last `seconds`, the request itself included.

    Each event is also laid into the following time chunk when it can still be
    counted there, so chunks of a busy client are windows of their own.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    width, reach = max(int(seconds), sub_hour) * 1_000_000, int(seconds * 1_000_000)
    rows = events.withColumn("_t", micros)
    own = F.floor(F.col("_t") / width)
    rows = rows.withColumn("_chunk", F.explode(F.array_distinct(F.array(own, F.floor((F.col("_t") + reach) / width)))))
    span = Window.partitionBy(client, "_chunk").orderBy("_t").rangeBetween(-reach, 0)
    counted = rows.withColumn("recent", F.count(F.lit(1)).over(span))
    return counted.where(F.col("_chunk") == F.floor(F.col("_t") / width)).drop("_t", "_chunk")


# ---- stateful jobs: state per key; a call of Python serves all keys of a bucket ----

KEY_BUCKETS = 4096
NO_TIMER = -1


def _times(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """Arrival order of a bucket's micro-batch: time, then id.

    These rules are sequential per client; files_per_trigger (or the source's
    offset limit) bounds how much of a busy client one micro-batch holds.
    """
    rows = pd.concat(list(pdfs), ignore_index=True)
    rows["_t"] = rows["ts"].to_numpy("datetime64[us]").astype("int64") / 1e6
    return rows.sort_values(["_t", "_no_id", "_id"], kind="stable")


def _keyed(rows: DataFrame, keys: Mapping[str, str], others: Sequence[str], walk: Callable[..., tuple], out: str, state: Sequence[str],
           expire: Callable[..., tuple] | None = None, buckets: int = KEY_BUCKETS) -> DataFrame:
    """A walk over the rows of each key in arrival order, micro-batch by micro-batch.

    `keys`: column -> type and name in the result; types of one value that text can stand for.
    `walk(kept, rows, mark)` and `expire(kept, mark)` return (rows of the result without the key,
    what to keep or None, time in ms of the key's timer or None); `kept` are the values of the
    types in `state`, rows are (event_id, seconds, *others), `mark` is the watermark in ms. A timer
    calls `expire` once the watermark has passed it, unless the key has new rows.

    Spark calls Python once per group, at several ms each, so groups are buckets of keys by hash:
    calls are bounded by `buckets`, and a bucket's state lists its keys.
    """
    names, fields = list(keys), [f"f{i}" for i in range(len(state))]
    texts = [f"k{i}" for i in range(len(names))]
    kinds = dict(rows.dtypes)
    dealt = rows.select(F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int").alias("_bucket"), *[F.col(n).cast("string").alias(t) for n, t in zip(names, texts)],
                        F.coalesce("event_id", F.lit("0").cast(kinds["event_id"])).alias("_id"), F.col("event_id").isNull().alias("_no_id"), "ts", *others)

    def run(_, pdfs: Iterator[pd.DataFrame], stored: GroupState) -> Iterator[pd.DataFrame]:
        held, met, made = {}, {}, []
        if stored.exists:
            for item in zip(*stored.get):
                held[item[:len(texts)]] = item[len(texts):]
        mark = stored.getCurrentWatermarkMs() if expire else None
        if not stored.hasTimedOut:
            got = _times(pdfs)
            ids = [None if no else i for i, no in zip(got["_id"].tolist(), got["_no_id"].tolist())]
            named = zip(*[[v if isinstance(v, str) else None for v in got[t].tolist()] for t in texts])
            for key, row in zip(named, zip(ids, got["_t"].tolist(), *[got[c].tolist() for c in others])):
                met.setdefault(key, []).append(row)

        def put(key: tuple, result: tuple) -> None:
            rows, kept, due = result
            made.extend((*key, *r) for r in rows)
            if kept is None:
                held.pop(key, None)
            else:
                held[key] = (*kept, NO_TIMER if due is None else due)
        for key in [k for k, v in held.items() if NO_TIMER != v[-1] < mark and k not in met] if expire else ():
            put(key, expire(held[key][:-1], mark))
        for key, some in met.items():
            put(key, walk(held[key][:-1] if key in held else None, some, mark))
        if held:
            stored.update(tuple(list(x) for x in zip(*[(*k, *v) for k, v in held.items()])))
            timers = [v[-1] for v in held.values() if v[-1] != NO_TIMER]
            if timers:
                stored.setTimeoutTimestamp(min(timers))
        elif stored.exists:
            stored.remove()
        yield pd.DataFrame(made, columns=[*texts, *columns])

    columns = [c.split()[0] for c in out.split(", ")]
    schema = ", ".join([*[f"{t} string" for t in texts], out])
    kept = ", ".join([*[f"{t} array<string>" for t in texts], *[f"{f} array<{k}>" for f, k in zip(fields, state)], "due array<bigint>"])
    found = dealt.groupBy("_bucket").applyInPandasWithState(run, schema, kept, "append", GroupStateTimeout.EventTimeTimeout if expire else GroupStateTimeout.NoTimeout)
    return found.select(*[F.col(t).cast(keys[n].split()[1]).alias(keys[n].split()[0]) for n, t in zip(names, texts)], *columns)


def sliding_limit(events: DataFrame, client: str, requests: int, seconds: float) -> DataFrame:
    """client, event_id, allowed, wait_seconds: at most `requests` accepted in any `seconds`; rejected ones do not count.

    State is the accepted times still inside the window: at most `requests` numbers of a client.
    """
    def limit(kept: tuple | None, rows: list[tuple], _) -> tuple:
        accepted = deque(kept[0]) if kept else deque()
        out = []
        for event_id, t in rows:
            while accepted and accepted[0] < t - seconds:
                accepted.popleft()
            if len(accepted) < requests:
                accepted.append(t)
                out.append((event_id, True, 0.0))
            else:
                out.append((event_id, False, seconds - (t - accepted[0])))
        return out, (list(accepted),), None

    return _keyed(events, {client: "client bigint"}, [], limit, "event_id bigint, allowed boolean, wait_seconds double", ["array<double>"])


def token_bucket(events: DataFrame, client: str, capacity: float, refill_per_second: float, cost: float = 1.0) -> DataFrame:
    """client, event_id, allowed, wait_seconds, tokens: a full bucket at first, refilled by elapsed time, drained by accepted requests."""
    def pour(kept: tuple | None, rows: list[tuple], _) -> tuple:
        tokens, last = kept or (capacity, None)
        out = []
        for event_id, t in rows:
            if last is not None:
                tokens = min(capacity, tokens + max(0.0, t - last) * refill_per_second)
            last = t if last is None else max(last, t)
            allowed = tokens >= cost
            wait = 0.0 if allowed else (cost - tokens) / refill_per_second
            tokens -= cost if allowed else 0.0
            out.append((event_id, allowed, wait, tokens))
        return out, (float(tokens), float(last)), None

    return _keyed(events, {client: "client bigint"}, [], pour, "event_id bigint, allowed boolean, wait_seconds double, tokens double", ["double", "double"])


def deadline_alerts(events: DataFrame, task: str, started: Column, finished: Column, limit_seconds: float, delay: str = "10 minutes") -> DataFrame:
    """task, started_at, deadline: one alert per start that is not finished in time.

    A later event of the task past the deadline raises the alert at once;
    otherwise an event-time timer does when the watermark passes it.
    """
    kinds = events.withWatermark("ts", delay).select(
        task, "event_id", "ts", F.when(started, "start").when(finished, "finish").otherwise("other").alias("_kind"))

    def watch(kept: tuple | None, rows: list[tuple], mark: int) -> tuple:
        begun = kept[0] if kept else None
        out = []
        for _, t, kind in rows:
            if begun is not None and t > begun + limit_seconds:
                out.append((begun, begun + limit_seconds))
                begun = None
            if kind == "start" and begun is None:
                begun = t
            elif kind == "finish":
                begun = None
        if begun is None:
            return out, None, None
        return out, (float(begun),), max(int((begun + limit_seconds) * 1000) + 1, mark + 1)

    return _keyed(kinds, {task: "task bigint"}, ["_kind"], watch, "started_at double, deadline double", ["double"],
                  lambda kept, _: ([(kept[0], kept[0] + limit_seconds)], None, None))


def expiring_violations(violations: DataFrame, key: str, keep_seconds: float = 3600, delay: str = "10 minutes") -> DataFrame:
    """violation, state, at: 'active' when first seen, repeats ignored while active, 'resolved' after `keep_seconds`."""
    rows = violations.withWatermark("ts", delay).select(key, "event_id", "ts")

    def track(kept: tuple | None, rows: list[tuple], mark: int) -> tuple:
        since = kept[0] if kept else None
        out = []
        for _, t in rows:
            if since is not None and t > since + keep_seconds:
                out.append(("resolved", since + keep_seconds))
                since = None
            if since is None:
                since = t
                out.append(("active", t))
        return out, (float(since),), max(int((since + keep_seconds) * 1000) + 1, mark + 1)

    return _keyed(rows, {key: "violation bigint"}, [], track, "state string, at double", ["double"],
                  lambda kept, _: ([("resolved", kept[0] + keep_seconds)], None, None))


def run_estimates(stream: DataFrame, by: str, runtime: str, keep: float = 0.7, chunk_seconds: int = 3600, label: str = "estimates") -> str:
    """key, n, estimate after each micro-batch: keep * old + (1 - keep) * new, started by the first value; returns the table's path.

    Every micro-batch is folded to one affine step per key, time chunk by time chunk, so a key
    with most of the stream uses all tasks; the step is then applied to the key's last state.
    A batch's table holds the state of all keys and is made from the one before it, so a
    repeated batch gives the same table.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        made = estimate_pieces(batch, [by], "ts", runtime, ["event_id"], keep, chunk_seconds).withColumnRenamed(by, "key").withColumnRenamed("n", "more")
        if batch_id == 0:
            old = made.select("key", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("estimate")).limit(0)
        else:
            old = spark.read.parquet(f"{path}/batch_id={batch_id - 1}")
        both = old.join(made, "key", "full")
        moved = F.pow(F.lit(keep), F.col("more")) * F.coalesce("estimate", "first") + F.col("moved")
        both.select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce(moved, "estimate").alias("estimate")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    stream.select(by, "event_id", "ts", runtime).writeStream.option("checkpointLocation", f"{path}-checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return path


def repeated_events(events: DataFrame, keys: Sequence[str], keep_seconds: float = 3600, delay: str = "10 minutes") -> DataFrame:
    """keys, event_id, n: each event whose keys were seen before, in the same or an earlier micro-batch, no longer than `keep_seconds` before; n is its number in that run.

    State is the count and the time of the last event of a key; it goes when the watermark
    has passed that time by `keep_seconds`.
    """
    kinds = dict(events.dtypes)
    rows = events.withWatermark("ts", delay).select(*keys, "event_id", "ts")

    def track(kept: tuple | None, rows: list[tuple], mark: int) -> tuple:
        n, last = kept or (0, 0.0)
        out = []
        for event_id, t in rows:
            n = n + 1 if n and t - last <= keep_seconds else 1
            last = max(last, t)
            if n > 1:
                out.append((event_id, n))
        return out, (int(n), float(last)), max(int((last + keep_seconds) * 1000) + 1, mark + 1)

    return _keyed(rows, {k: f"{k} {kinds[k]}" for k in keys}, [], track, f"event_id {kinds['event_id']}, n bigint", ["bigint", "double"],
                  lambda *_: ([], None, None))


def due_retries(retries: DataFrame, task: str, due: str, delay: str = "0 seconds") -> DataFrame:
    """task, due: each scheduled retry, emitted when event time has passed its due time (epoch seconds)."""
    rows = retries.withWatermark("ts", delay).select(task, "event_id", "ts", F.col(due).cast("double").alias("_due"))

    def hold(kept: tuple | None, rows: list[tuple], mark: int) -> tuple:
        waiting = sorted([*(kept[0] if kept else ()), *[r[-1] for r in rows]])
        ready, waiting = [d for d in waiting if d <= mark / 1000], [d for d in waiting if d > mark / 1000]
        return [(d,) for d in ready], (waiting,) if waiting else None, int(waiting[0] * 1000) + 1 if waiting else None

    return _keyed(rows, {task: "task bigint"}, ["_due"], hold, "due double", ["array<double>"], lambda kept, mark: hold(kept, [], mark))


# ---- quality per micro-batch ----

def batch_quality(rules: Mapping[str, Mapping[str, object]], keys: Sequence[str], missing_threshold: float = 0.5) -> Callable[[DataFrame], DataFrame]:
    """For run_batches: check, subject, value, failed over one micro-batch."""
    def checks(batch: DataFrame) -> DataFrame:
        kept = batch.persist()
        contract = enforce_contract(kept, rules).select(F.concat(F.lit("contract:"), "rule").alias("check"), F.col("column").alias("subject"),
                                                        F.col("violations").alias("value"), F.col("exceeded").alias("failed"))
        missing = check_missing(kept, missing_threshold).select(F.lit("missing").alias("check"), F.col("column").alias("subject"),
                                                                F.col("missing_share").alias("value"), F.col("exceeded").alias("failed"))
        repeats = check_duplicates(kept, keys).select(F.lit("duplicates").alias("check"), F.lit(",".join(keys)).alias("subject"),
                                                      F.col("duplicate_key_values").cast("double").alias("value"), (F.col("duplicate_key_values") > 0).alias("failed"))
        return union_all([contract, missing, repeats])
    return checks
