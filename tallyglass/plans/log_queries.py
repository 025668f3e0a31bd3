"""Queries over texts, run records and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.operators import governance as G, runlog as W
from tallyglass.plans.catalog import query, rounded, union_sql
from tallyglass.plans.inputs import AS_OF, AS_OF_SQL, EDGES, RUNS, TASKS, runs, table, tasks
from tallyglass.streaming import jobs as J

# ---- governance ----


def re2(pattern):
    return pattern.replace("'", "''")


def pii_sql(kind, source, key, text):
    p = re2(G.PII_PATTERNS[kind])
    return f"""SELECT {key}, '{kind}' AS pii_type, m[i] AS value,
      (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INTEGER AS start FROM (
        SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, regexp_extract_all({text}, '{p}') AS m, regexp_split_to_array({text}, '{p}') AS g FROM {source}) WHERE len(m) > 0)"""


def all_pii_sql(source, key, text):
    return f"SELECT {key}, pii_type, value, start, start + length(value)::INTEGER AS stop FROM ({union_sql([pii_sql(k, source, key, text) for k in G.PII_PATTERNS])})"


# customers with planted personal data of every kind
PII_TEXT = "concat('Mail user', CAST(c_custkey AS VARCHAR(20)), '@example.com or call 555-', lpad(CAST(c_custkey % 1000 AS VARCHAR(20)), 3, '0'), '-1234; ssn 123-45-', lpad(CAST(c_custkey % 10000 AS VARCHAR(20)), 4, '0'), ', card 4111 1111 1111 ', lpad(CAST(c_custkey % 10000 AS VARCHAR(20)), 4, '0'), ' from 10.0.0.', CAST(c_custkey % 256 AS VARCHAR(20)), ' / 00:1A:2B:3C:4D:', lpad(CAST(c_custkey % 100 AS VARCHAR(20)), 2, '0'))"
PII_TABLE = f"(SELECT c_custkey, {PII_TEXT} AS note FROM customer)"


def notes(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey", f"{PII_TEXT.replace('VARCHAR(20)', 'STRING')} AS note")


@query("g01_detect_pii", all_pii_sql("documents", "doc_id", "text"))
def g01(spark, d):
    return G.detect_pii(table(spark, d, "documents"), "doc_id", "text")


@query("g01_detect_every_kind", all_pii_sql(PII_TABLE, "c_custkey", "note"))
def g01b(spark, d):
    return G.detect_pii(notes(spark, d), "c_custkey", "note")


def mask_sql(text):
    for kind, p in G.PII_PATTERNS.items():
        text = f"regexp_replace({text}, '{re2(p)}', '[{kind.upper()}]', 'g')"
    return text


@query("g02_mask_pii", f"SELECT doc_id, {mask_sql('text')} AS masked FROM documents")
def g02(spark, d):
    return table(spark, d, "documents").select("doc_id", G.mask_pii(F.col("text")).alias("masked"))


@query("g02_mask_every_kind", f"SELECT c_custkey, {mask_sql('note')} AS masked FROM {PII_TABLE}")
def g02b(spark, d):
    return notes(spark, d).select("c_custkey", G.mask_pii(F.col("note")).alias("masked"))


def count_sql(text):
    return " + ".join(f"len(regexp_extract_all({text}, '{re2(p)}'))" for p in G.PII_PATTERNS.values())


@query("g03_compliance", f"SELECT doc_id, ({count_sql('text')})::BIGINT AS pii_count, {count_sql('text')} = 0 AS gdpr_compliant, CASE WHEN {count_sql('text')} > 0 THEN 'anonymise or encrypt' END AS advice FROM documents")
def g03(spark, d):
    return G.compliance(table(spark, d, "documents"), "doc_id", "text")


KINDS_FOUND = ", ".join(f"CASE WHEN sum(len(regexp_extract_all(text, '{re2(G.PII_PATTERNS[k])}'))) > 0 THEN '{k}' END" for k in sorted(G.PII_PATTERNS))


@query("g04_pii_summary", f"SELECT sum({count_sql('text')})::BIGINT AS pii_count, concat_ws(',', {KINDS_FOUND}) AS pii_types, count(*) FILTER ({count_sql('text')} > 0) AS rows_with_pii FROM documents")
def g04(spark, d):
    return G.pii_summary(table(spark, d, "documents"), "text")


def urls_sql(source, key, text):
    return f"SELECT {key}, url FROM (SELECT {key}, unnest(regexp_extract_all({text}, '{re2(G.URL_PATTERN)}')) AS url FROM {source}) WHERE regexp_matches(url, '{re2(G.URL_HOST)}')"


@query("g05_extract_urls", urls_sql("pages", "page_id", "html"))
def g05(spark, d):
    return G.extract_urls(table(spark, d, "pages"), "page_id", "html")


@query("g05_extract_urls_of_documents", urls_sql("documents", "doc_id", "text"))
def g05b(spark, d):
    return G.extract_urls(table(spark, d, "documents"), "doc_id", "text")


def clean_sql(text):
    dangerous = re2("(?is)" + "|".join(G.DANGEROUS_PATTERNS))
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '{dangerous}', '', 'g'), '{G.TAG_PATTERN}', '', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g')"


# links that stand in a text: the pattern ends at '#'
@query("g05_extract_urls_of_pages", "SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages WHERE url IS NOT NULL")
def g05c(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("see "), "url", F.lit(" or nothing")).alias("text"))
    return G.extract_urls(p, "page_id", "text")


@query("g06_clean_text", f"SELECT page_id, {clean_sql('html')} AS cleaned FROM pages")
def g06(spark, d):
    return table(spark, d, "pages").select("page_id", G.clean_text(F.col("html")).alias("cleaned"))


SCORE = " + ".join(f"len(regexp_extract_all(s, '{re2(p)}'))" for p in G.KEY_PATTERNS)


@query("g07_key_sentences", f"""WITH s AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS a FROM documents),
  e AS (SELECT doc_id, a[i] AS s, i FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM s WHERE len(a) > 2)), r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY {SCORE} DESC, i) AS k FROM e)
  SELECT doc_id, string_agg(s, '. ' ORDER BY k) || '.' AS summary FROM r WHERE k <= 2 GROUP BY 1 UNION ALL SELECT doc_id, text FROM s WHERE len(a) <= 2""")
def g07(spark, d):
    return table(spark, d, "documents").select("doc_id", G.key_sentences(F.col("text")).alias("summary"))


# ---- run log ----

AGE = "epoch({a} - {b})"
WAITING = "upper(status) IN ('PENDING', 'QUEUED')"


def since(column):
    return f"(epoch_us({AS_OF_SQL}) - epoch_us({column})) / 1e6"


@query("w01_deadlocked_runs", f"""SELECT r.run_id, count(*) AS task_count, count(*) FILTER (upper(t.status) IN ('PENDING', 'QUEUED')) AS waiting_count FROM {RUNS} r JOIN {TASKS} t ON t.run_id = r.run_id
  WHERE upper(r.status) = 'RUNNING' GROUP BY r.run_id HAVING bool_and(upper(t.status) IN ('PENDING', 'QUEUED')) AND {since('max(t.updated_at)')} > 900""")
def w01(spark, d):
    return W.deadlocked_runs(runs(spark, d), tasks(spark, d), AS_OF).drop("last_update")


@query("w02_stale_runs", f"SELECT run_id, {since('updated_at')} AS idle_seconds FROM {RUNS} WHERE upper(status) = 'RUNNING' AND {since('updated_at')} > 3600")
def w02(spark, d):
    return W.stale_runs(runs(spark, d), AS_OF)


@query("w03_stale_tasks", f"""SELECT run_id, task_id, {since('updated_at')} AS idle_seconds, count(*) OVER (PARTITION BY run_id) AS stale_in_run FROM {TASKS} WHERE {WAITING} AND {since('updated_at')} > 50000000""")
def w03(spark, d):
    return W.stale_tasks(tasks(spark, d), AS_OF, 50_000_000)


@query("w04_orphaned_tasks", f"""SELECT t.run_id, t.task_id, count(*) AS missing_dependencies FROM {TASKS} t JOIN {EDGES} e ON e.run_id = t.run_id AND e.task_id = t.task_id
  WHERE upper(t.status) IN ('PENDING', 'QUEUED') AND NOT EXISTS (SELECT 1 FROM {TASKS} n WHERE n.run_id = t.run_id AND n.task_id = e.needed)
    AND t.run_id IN (SELECT run_id FROM {RUNS} WHERE upper(status) IN ('RUNNING', 'PENDING')) GROUP BY 1, 2""")
def w04(spark, d):
    return W.orphaned_tasks(runs(spark, d), tasks(spark, d))


@query("w05_cycle_members", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT e.run_id, e.task_id, e.needed FROM {EDGES} e JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) k ON k.l_orderkey = e.run_id AND k.l_linenumber = e.needed),
  reach AS (SELECT run_id, task_id, needed FROM e UNION SELECT r.run_id, r.task_id, e.needed FROM reach r JOIN e ON e.run_id = r.run_id AND e.task_id = r.needed)
  SELECT DISTINCT run_id, task_id FROM reach WHERE task_id = needed""")
def w05(spark, d):
    return W.cycle_members(tasks(spark, d))


def sla_sql(source, kind, name, limit):
    a = since("created_at")
    return f"""SELECT '{kind}_' || {name} AS violation_id, '{kind}_timeout' AS violation_type, {name} AS resource_id, {a} AS age_seconds, {limit}::DOUBLE AS threshold_seconds,
      CASE WHEN {a} / {limit} >= 2 THEN 'critical' WHEN {a} / {limit} >= 1.5 THEN 'high' WHEN {a} / {limit} >= 1.2 THEN 'medium' ELSE 'warning' END AS severity
      FROM {source} WHERE upper(status) IN ('RUNNING', 'PENDING', 'QUEUED') AND {a} > {limit}"""


SLA = sla_sql(TASKS, "task", "concat_ws('/', run_id, task_id)", 90_000_000.0) + " UNION ALL " + sla_sql(RUNS, "workflow", "run_id::VARCHAR", 100_000_000.0)


def violations(spark, d):
    return W.sla_violations(tasks(spark, d), runs(spark, d), AS_OF, 90_000_000, 100_000_000)


@query("w06_sla_violations", SLA)
def w06(spark, d):
    return violations(spark, d)


@query("w07_violation_statistics", f"SELECT violation_type, severity, count(*) AS n FROM ({SLA}) GROUP BY 1, 2")
def w07(spark, d):
    return W.violation_statistics(violations(spark, d))


@query("w07_latest_violations", f"SELECT violation_id, age_seconds FROM ({SLA}) ORDER BY age_seconds, violation_id LIMIT 100")
def w07b(spark, d):
    return W.latest_violations(violations(spark, d)).select("violation_id", "age_seconds")


@query("w08_ready_tasks", f"""SELECT run_id, task_id FROM {TASKS} t WHERE upper(status) = 'PENDING' AND NOT EXISTS (SELECT 1 FROM {EDGES} e WHERE e.run_id = t.run_id AND e.task_id = t.task_id
  AND NOT EXISTS (SELECT 1 FROM {TASKS} n WHERE n.run_id = e.run_id AND n.task_id = e.needed AND upper(n.status) = 'COMPLETED'))""")
def w08(spark, d):
    return W.ready_tasks(tasks(spark, d))


@query("w09_run_outcomes", f"""SELECT *, CASE WHEN completed + failed >= total AND failed > 0 THEN 'FAILED' WHEN completed + failed >= total THEN 'COMPLETED' ELSE 'RUNNING' END AS outcome FROM (
  SELECT run_id, count(*) AS total, count(*) FILTER (upper(status) = 'COMPLETED') AS completed, count(*) FILTER (upper(status) = 'FAILED') AS failed,
    round(count(*) FILTER (upper(status) = 'COMPLETED') * 100.0 / count(*), 6) AS progress_pct FROM {TASKS} GROUP BY 1)""")
def w09(spark, d):
    return rounded(W.run_outcomes(tasks(spark, d)))


@query("w10_agent_statistics", """SELECT user_id AS agent, count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
  round(count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE, 6) AS success_rate, round(sum(value) / count(*), 4) AS avg_runtime, round(count(*) / greatest(sum(value) / 3600, 1 / 3600.0), 4) AS tasks_per_hour FROM events GROUP BY 1""")
def w10(spark, d):
    out = W.agent_statistics(table(spark, d, "events"), "user_id", F.col("event_type") != "error", "value")
    return out.withColumns({"success_rate": F.round("success_rate", 6), "avg_runtime": F.round("avg_runtime", 4), "tasks_per_hour": F.round("tasks_per_hour", 4)})


@query("w11_operation_telemetry", "SELECT event_type AS operation, count(*) AS calls, round(sum(value), 2) AS total_time, count(*) FILTER (value > 200) AS errors FROM events GROUP BY 1")
def w11(spark, d):
    return rounded(W.operation_telemetry(table(spark, d, "events"), "event_type", "value", F.col("value") > 200), 2)


PRIORITY = "-(1.0::DOUBLE / greatest(value, 1.0::DOUBLE) + 2.0::DOUBLE * (user_id % 10 / 10.0::DOUBLE) + 3.0::DOUBLE * (1.0::DOUBLE / greatest((event_id % 1000)::DOUBLE, 1.0::DOUBLE)))"


@query("w12_priority_ranking", f"SELECT event_id, round(s, 6) AS score, row_number() OVER (ORDER BY s, md5(concat_ws('|', CAST(event_id AS VARCHAR), '42')), event_id) AS position FROM (SELECT event_id, {PRIORITY} AS s FROM events)")
def w12(spark, d):
    score = W.priority_score(F.col("value"), F.col("user_id") % 10 / F.lit(10.0), (F.col("event_id") % 1000).cast("double"))
    return rounded(W.priority_ranking(table(spark, d, "events"), score, ["event_id"]).select("event_id", "score", "position"))


@query("w13_retry_schedule", f"SELECT run_id, task_id, CASE WHEN retries < 3 THEN least(30 * pow(2.0, retries), 100.0) END AS delay_seconds, retries >= 3 AS abandoned FROM {TASKS}")
def w13(spark, d):
    delay, gone = W.retry_schedule(F.col("retries"), most=100)
    return tasks(spark, d).select("run_id", "task_id", delay.alias("delay_seconds"), gone.alias("abandoned"))


EMA = """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT event_type, max(n) AS n, round(sum(CASE WHEN i = 1 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - i) END * value), 6) AS estimate FROM r GROUP BY 1"""


@query("w14_runtime_estimates", EMA)
def w14(spark, d):
    return rounded(W.runtime_estimates(table(spark, d, "events"), ["event_type"], "ts", "value", ["event_id"]))


@query("w15_status_counts", f"SELECT run_id, count(*) FILTER (upper(status) = 'PENDING') AS pending, count(*) FILTER (upper(status) = 'QUEUED') AS queued, count(*) FILTER (upper(status) = 'COMPLETED') AS completed, count(*) FILTER (upper(status) = 'FAILED') AS failed, count(*) FILTER (upper(status) = 'CANCELLED') AS cancelled FROM {TASKS} GROUP BY 1")
def w15(spark, d):
    return W.status_counts(tasks(spark, d), ["PENDING", "QUEUED", "COMPLETED", "FAILED", "CANCELLED"])


@query("w16_pending_retries", f"""SELECT event_id, greatest(0.0, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 02:00:00')) / 1e6) AS remaining_seconds, epoch_us(ts) <= epoch_us(TIMESTAMP '2024-01-01 02:00:00') AS is_due
  FROM events ORDER BY ts, event_id LIMIT 50""")
def w16(spark, d):
    from datetime import datetime
    return W.pending_retries(table(spark, d, "events"), "ts", "event_id", datetime(2024, 1, 1, 2), 50)


@query("w17_expire_requests", f"SELECT run_id, task_id, CASE WHEN upper(status) IN ('QUEUED', 'PROCESSING') AND {since('created_at')} > 90000000 THEN 'TIMEOUT' ELSE status END AS status, upper(status) IN ('QUEUED', 'PROCESSING') AND {since('created_at')} > 90000000 AS expired FROM {TASKS}")
def w17(spark, d):
    return W.expire_requests(tasks(spark, d), AS_OF, 90_000_000).select("run_id", "task_id", "status", "expired")


REASON = "CASE run_id % 4 WHEN 0 THEN 'Network_Timeout on host' WHEN 1 THEN 'validation_error: bad row' WHEN 2 THEN 'out of disk' ELSE 'Validation_Error after temporary_service_error' END"


@query("w18_should_retry", f"SELECT run_id, task_id, CASE WHEN action IN ('delete_data', 'drop_table', 'reset_model') THEN false WHEN lower(r) LIKE '%network_timeout%' OR lower(r) LIKE '%resource_unavailable%' OR lower(r) LIKE '%temporary_service_error%' THEN true WHEN lower(r) LIKE '%validation_error%' THEN false ELSE true END AS retry FROM (SELECT *, {REASON} AS r FROM {TASKS})")
def w18(spark, d):
    return tasks(spark, d).withColumn("r", F.expr(REASON)).select("run_id", "task_id", W.should_retry(F.col("action"), F.col("r")).alias("retry"))


@query("w19_run_priorities", f"""SELECT run_id, count(*) AS task_count, least(10, max(CASE WHEN agent = 'A' THEN 8 WHEN action = 'real_time_prediction' THEN 9 WHEN action = 'load_data' THEN 7 WHEN action = 'train_model' THEN 5 WHEN action = 'generate_report' THEN 3 ELSE 5 END)
  + CASE WHEN count(*) > 20 THEN 1 ELSE 0 END + CASE WHEN run_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 2 ELSE 0 END)::INTEGER AS priority FROM {TASKS} GROUP BY run_id""")
def w19(spark, d):
    urgent = table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("run_id"))
    return W.run_priorities(tasks(spark, d), urgent, ["A"])


# ---- streams: each reads the events file as a stream to its end ----

def failed():
    return F.col("event_type") == "error"


@query("t01_parse_events", "SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def t01(spark, d):
    raw = J.file_events(spark, d).select(F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props")).alias("value"))
    typed = J.parse_events(raw.withColumnRenamed("value", "message"), "message", "event_id bigint, user_id bigint, event_type string, value double, props string")
    out = J.parse_events(typed.drop("message"), "props", "k int").drop("props")
    return spark.read.parquet(J.run_to_table(out, "events-typed"))


WINDOW = "epoch_us(ts) // 300000000 * 300000000"


@query("t02_error_rate_alerts", f"SELECT strftime(make_timestamp({WINDOW}), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS error_rate FROM events GROUP BY {WINDOW} HAVING count(*) FILTER (event_type = 'error') / count(*)::DOUBLE > 0.05")
def t02(spark, d):
    path = J.run_batches(J.error_rate_alerts(J.file_events(spark, d), failed()), "error-rates")
    out = J.latest_rows(spark, path, ["window_start"])
    return rounded(out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm")))


@query("t03_recent_counts", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) AS recent FROM events")
def t03(spark, d):
    return J.recent_counts(table(spark, d, "events"), "user_id", 7200).select("event_id", "recent")


@query("t03_sliding_limit")
def t03b(spark, d):
    return spark.read.parquet(J.run_to_table(J.sliding_limit(J.file_events(spark, d), "user_id", 2, 86400), "limits"))


@query("t04_token_bucket")
def t04(spark, d):
    return spark.read.parquet(J.run_to_table(J.token_bucket(J.file_events(spark, d), "user_id", 3, 1 / 43200), "buckets"))


@query("t05_deadline_alerts")
def t05(spark, d):
    started, finished = F.col("event_type") == "signup", F.col("event_type") == "purchase"
    return spark.read.parquet(J.run_to_table(J.deadline_alerts(J.file_events(spark, d), "user_id", started, finished, 86400), "deadlines"))


@query("t06_expiring_violations")
def t06(spark, d):
    return spark.read.parquet(J.run_to_table(J.expiring_violations(J.file_events(spark, d).where(failed()), "user_id"), "violations"))


@query("t07_running_statistics", "SELECT event_type AS agent, count(*) AS total, count(*) FILTER (value < 100) AS succeeded, round(count(*) FILTER (value < 100) / count(*)::DOUBLE, 6) AS success_rate, round(avg(value), 6) AS avg_runtime FROM events GROUP BY 1")
def t07(spark, d):
    stats = J.running_statistics(J.file_events(spark, d), "event_type", F.col("value") < 100, "value")
    return rounded(J.latest_rows(spark, J.run_batches(stats, "statistics"), ["agent"]))


@query("t08_running_estimates", EMA)
def t08(spark, d):
    path = J.run_estimates(J.file_events(spark, d), "event_type", "value")
    return rounded(J.latest_rows(spark, path, ["key"]).withColumnRenamed("key", "event_type"))


@query("t09_due_retries", "SELECT user_id AS task, epoch_us(ts) / 1e6 + 30 AS due FROM events WHERE event_type = 'error' AND epoch_us(ts) / 1e6 + 30 <= (SELECT max(epoch_ms(ts)) / 1e3 FROM events WHERE event_type = 'error')")
def t09(spark, d):
    retries = J.file_events(spark, d).where(failed()).withColumn("due", F.unix_micros("ts") / 1e6 + 30)
    return spark.read.parquet(J.run_to_table(J.due_retries(retries, "user_id", "due"), "retries"))


@query("t10_distinct_events", "SELECT event_id, event_type FROM events")
def t10(spark, d):
    doubled = J.file_events(spark, d)
    doubled = doubled.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return spark.read.parquet(J.run_to_table(J.distinct_events(doubled, ["event_id"]), "distinct")).select("event_id", "event_type")


@query("q15_repeats_in_a_stream", """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 86400000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM g)
  SELECT user_id, event_type, event_id, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, run ORDER BY ts, event_id) AS n FROM r) WHERE n > 1""")
def q15r(spark, d):
    return spark.read.parquet(J.run_to_table(J.repeated_events(J.file_events(spark, d), ["user_id", "event_type"], 86400), "repeats"))


@query("q15_batch_quality", """SELECT 'contract:enum' AS "check", 'event_type' AS subject, count(*) FILTER (event_type NOT IN ('click', 'view', 'error', 'purchase'))::DOUBLE AS value, count(*) FILTER (event_type NOT IN ('click', 'view', 'error', 'purchase')) > 0 AS failed FROM events
  UNION ALL SELECT 'contract:unique', 'event_id', (count(event_id) - count(DISTINCT event_id))::DOUBLE, count(event_id) > count(DISTINCT event_id) FROM events
  UNION ALL SELECT 'duplicates', 'user_id,event_type', (SELECT count(*)::DOUBLE FROM (SELECT 1 FROM events GROUP BY user_id, event_type HAVING count(*) > 1)), true
  UNION ALL SELECT 'missing', unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']), 0.0::DOUBLE, false""")
def q15(spark, d):
    rules = {"event_id": {"unique": True}, "event_type": {"enum": ["click", "view", "error", "purchase"]}}
    path = J.run_batches(J.file_events(spark, d), "quality", J.batch_quality(rules, ["user_id", "event_type"]), "append")
    return spark.read.parquet(path).drop("batch_id")
