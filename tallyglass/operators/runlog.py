"""Questions asked of run and task records.

`runs`: run_id, status, created_at, updated_at.  `tasks`: run_id, task_id,
agent, action, status, created_at, updated_at, retries, depends_on array.
Statuses compare in upper case; `as_of` is always given.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyglass.functions.expressions import count_if, one
from tallyglass.functions.ranking import order_rank
from tallyglass.session import cut_lineage

WAITING = ("PENDING", "QUEUED")
# Priority per action, and what must or must not be retried.
URGENT_ACTIONS = ["emergency_analysis", "real_time_prediction"]
PREPARE_ACTIONS = ["load_data", "clean_data", "validate_data"]
ANALYSE_ACTIONS = ["analyze_data", "train_model", "evaluate_model"]
REPORT_ACTIONS = ["create_visualization", "generate_report"]
DESTRUCTIVE_ACTIONS = ["delete_data", "drop_table", "reset_model"]
TRANSIENT_FAILURES = ["network_timeout", "resource_unavailable", "temporary_service_error"]


def is_status(column: str, *wanted: str) -> Column:
    return F.upper(F.col(column)).isin(*wanted)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def deadlocked_runs(runs: DataFrame, tasks: DataFrame, as_of: datetime, stale_seconds: float = 900) -> DataFrame:
    """Running runs whose tasks all wait and were last touched before the cutoff; tasks are pre-aggregated per run."""
    per_run = tasks.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("task_count"), count_if(is_status("status", *WAITING)).alias("waiting_count"), F.max("updated_at").alias("last_update"))
    stuck = per_run.where((F.col("task_count") == F.col("waiting_count")) & (seconds_between(F.lit(as_of), F.col("last_update")) > stale_seconds))
    return runs.where(is_status("status", "RUNNING")).select("run_id").join(stuck, "run_id")


def stale_runs(runs: DataFrame, as_of: datetime, stale_seconds: float = 3600) -> DataFrame:
    """run_id, idle_seconds of running runs."""
    idle = seconds_between(F.lit(as_of), F.col("updated_at"))
    return runs.where(is_status("status", "RUNNING")).select("run_id", idle.alias("idle_seconds")).where(F.col("idle_seconds") > stale_seconds)


def stale_tasks(tasks: DataFrame, as_of: datetime, stale_seconds: float = 900) -> DataFrame:
    """run_id, task_id, idle_seconds of waiting tasks untouched since the cutoff, with the run's count of them."""
    idle = seconds_between(F.lit(as_of), F.col("updated_at"))
    stale = tasks.where(is_status("status", *WAITING)).select("run_id", "task_id", idle.alias("idle_seconds")).where(F.col("idle_seconds") > stale_seconds)
    counts = stale.groupBy("run_id").agg(F.count(F.lit(1)).alias("stale_in_run"))
    return stale.join(counts, "run_id")


def orphaned_tasks(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """run_id, task_id, missing_dependencies: waiting tasks of active runs that depend on a task the run does not have."""
    active = runs.where(is_status("status", "RUNNING", "PENDING")).select("run_id")
    needs = tasks.where(is_status("status", *WAITING)).select("run_id", "task_id", F.explode("depends_on").alias("needed"))
    have = tasks.select("run_id", F.col("task_id").alias("needed"))
    lost = needs.join(have, ["run_id", "needed"], "left_anti").join(active, "run_id", "left_semi")
    return lost.groupBy("run_id", "task_id").agg(F.count(F.lit(1)).alias("missing_dependencies"))


FEW_EDGES, PLAIN_ROUNDS = 32, 8


def _jumps(steps: DataFrame) -> list[DataFrame]:
    """Tables (run_id, node, to) of 1, 2, 4, … steps along (run_id, node, to), one way on per node; a way that ends stays at its end.

    Pointer doubling: the last table is as many steps as a run has nodes, so each node has its
    way's end there, or, where the way never ends, a node of the circle it leads to.
    """
    tables = [cut_lineage(steps)]
    nodes = tables[0].groupBy("run_id").count().agg(F.max("count")).first()[0] or 0          # of the largest run
    while 1 << (len(tables) - 1) < nodes:
        last = tables[-1]
        further = last.select("run_id", F.col("node").alias("to"), F.col("to").alias("_on"))
        tables.append(cut_lineage(last.join(further, ["run_id", "to"], "left").select("run_id", "node", F.coalesce("_on", "to").alias("to"), F.col("_on").isNotNull().alias("_moved"))))
        if tables[-1].where("_moved").isEmpty():                 # every way has ended
            break
    return [t.select("run_id", "node", "to") for t in tables]


def _without_ends(edges: DataFrame) -> DataFrame:
    """Edges (run_id, src, dst) without those that lead to an end, or come from a start, over nodes with one way on (or back)."""
    def pruned(e: DataFrame, here: str, there: str) -> DataFrame:
        ways = e.groupBy("run_id", F.col(here).alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min(there).alias("to"))
        single = ways.where("_n = 1").select("run_id", "node", "to")
        last = _jumps(single)[-1]
        open_ends = last.join(ways.select("run_id", F.col("node").alias("to")), ["run_id", "to"], "left_anti").select("run_id", F.col("node").alias(here))
        return cut_lineage(e.join(open_ends, ["run_id", here], "left_anti"))
    left, rounds = edges.count(), 0
    while left:
        # A few plain rounds finish shallow graphs; chains that are left after that go as a whole.
        starts, ends = edges.select("run_id", F.col("src").alias("dst")), edges.select("run_id", F.col("dst").alias("src"))
        edges = cut_lineage(edges.join(starts, ["run_id", "dst"], "left_semi").join(ends, ["run_id", "src"], "left_semi"))
        now = edges.count()
        if now == left:
            break
        rounds += 1
        if rounds % PLAIN_ROUNDS == 0:
            edges = pruned(pruned(edges, "src", "dst"), "dst", "src")
            now = edges.count()
        left = now
    return edges


def _components(edges: DataFrame, trimmed: bool = False) -> DataFrame | None:
    """(run_id, node, colour) of nodes on cycles; nodes of one cycle component share a colour. The largest id is spread along the edges; what its own id comes back to, and all it can reach with that id, is one component, which is taken out, and so on."""
    found = None
    edges = edges if trimmed else _without_ends(edges)
    while not edges.isEmpty():
        colour = edges.select("run_id", F.col("src").alias("node")).union(edges.select("run_id", F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node"))
        while True:
            pushed = edges.join(colour.withColumnRenamed("node", "src"), ["run_id", "src"]).select("run_id", F.col("dst").alias("node"), "colour")
            grown = colour.select("run_id", "node", "colour").union(pushed).groupBy("run_id", "node").agg(F.max("colour").alias("colour"))
            grown = cut_lineage(grown)
            changed = not grown.join(colour.withColumnRenamed("colour", "_old"), ["run_id", "node"]).where(F.col("colour") != F.col("_old")).isEmpty()
            colour = grown
            if not changed:
                break
        same = edges.join(colour.withColumnRenamed("node", "src"), ["run_id", "src"]).join(
            colour.select("run_id", F.col("node").alias("dst"), F.col("colour").alias("_dc")), ["run_id", "dst"]).where(F.col("colour") == F.col("_dc"))
        same = cut_lineage(same.select("run_id", "src", "dst", "colour"))
        members = colour.where(F.col("node") == F.col("colour")).select("run_id", "node", "colour")
        size = members.count()
        while True:                                               # backwards from each colour's own node
            back = same.join(members.withColumnRenamed("node", "dst"), ["run_id", "dst", "colour"]).select("run_id", F.col("src").alias("node"), "colour")
            members = cut_lineage(members.union(back).distinct())
            now = members.count()
            if now == size:
                break
            size = now
        # A component is a cycle when one of its edges stays inside it.
        inner = same.join(members.select("run_id", F.col("node").alias("src"), "colour"), ["run_id", "src", "colour"], "left_semi").join(
            members.select("run_id", F.col("node").alias("dst"), "colour"), ["run_id", "dst", "colour"], "left_semi")
        piece = inner.select("run_id", F.col("src").alias("node"), "colour").distinct()
        found = piece if found is None else found.union(piece)
        done_src, done_dst = members.select("run_id", F.col("node").alias("src")), members.select("run_id", F.col("node").alias("dst"))
        edges = _without_ends(cut_lineage(edges.join(done_src, ["run_id", "src"], "left_anti").join(done_dst, ["run_id", "dst"], "left_anti")))
    return found


def cycle_members(tasks: DataFrame) -> DataFrame:
    """run_id, task_id of tasks on a dependency cycle.

    Tasks with one dependency are followed by pointer doubling, so long chains and long
    circles take as many rounds as their length has binary digits: ways that end are
    taken off, circles that nothing leaves are found, and between tasks with several
    dependencies a chain counts as one edge. Only on that shorter graph ids are spread edge
    by edge, with rounds as long as its longest way. There is no limit of rounds.
    """
    known = tasks.select("run_id", F.col("task_id").alias("dst"))
    edges = tasks.select("run_id", F.col("task_id").alias("src"), F.explode("depends_on").alias("dst")).join(known, ["run_id", "dst"], "left_semi").distinct()
    edges = _without_ends(cut_lineage(edges))
    if edges.isEmpty():
        return tasks.select("run_id", "task_id").limit(0)
    if edges.groupBy("run_id").count().agg(F.max("count")).first()[0] <= FEW_EDGES:          # no way is longer: nothing to shorten
        return _components(edges, trimmed=True).select("run_id", F.col("node").alias("task_id")).distinct()
    ways = cut_lineage(edges.groupBy("run_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min("dst").alias("to")))
    single, several = ways.where("_n = 1").select("run_id", "node", "to"), ways.where("_n > 1").select("run_id", "node")
    steps = _jumps(single)
    circles = steps[-1].join(single.select("run_id", F.col("node").alias("to")), ["run_id", "to"], "left_semi").select("run_id", F.col("to").alias("task_id")).distinct()
    ends = steps[-1].join(several.select("run_id", F.col("node").alias("to")), ["run_id", "to"], "left_semi")          # chains that lead to a task with several ways
    whole = ends.union(several.select("run_id", "node", F.col("node").alias("to")))
    short = cut_lineage(edges.join(several.withColumnRenamed("node", "src"), ["run_id", "src"], "left_semi").withColumnRenamed("dst", "node").join(whole, ["run_id", "node"])
                        .select("run_id", "src", "node", F.col("to").alias("dst")))
    parts = _components(short.select("run_id", "src", "dst").distinct())
    if parts is None:
        return circles.select("run_id", "task_id")
    parts = cut_lineage(parts)
    inside = short.join(parts.select("run_id", F.col("node").alias("src"), "colour"), ["run_id", "src"]).join(parts.select("run_id", F.col("node").alias("dst"), "colour"), ["run_id", "dst", "colour"])
    on = inside.select("run_id", "node").union(parts.select("run_id", "node")).distinct()
    for table in reversed(steps):                                 # every place along the chains between tasks of one component
        on = cut_lineage(on.union(on.join(table, ["run_id", "node"]).select("run_id", F.col("to").alias("node"))).distinct())
    return circles.union(on.select("run_id", F.col("node").alias("task_id"))).distinct()


def sla_severity(age: Column, limit: Column) -> Column:
    r = age / limit
    return F.when(r >= 2.0, "critical").when(r >= 1.5, "high").when(r >= 1.2, "medium").otherwise("warning")


def sla_violations(tasks: DataFrame, runs: DataFrame, as_of: datetime, task_limit: float = 600, run_limit: float = 3600) -> DataFrame:
    """violation_id, violation_type, resource_id, age_seconds, threshold_seconds, severity of unfinished tasks and runs."""
    def side(df: DataFrame, name: Column, kind: str, limit: float) -> DataFrame:
        aged = df.where(is_status("status", "RUNNING", *WAITING)).select(
            name.cast("string").alias("resource_id"), seconds_between(F.lit(as_of), F.col("created_at")).alias("age_seconds"))
        return aged.where(F.col("age_seconds") > limit).select(
            F.concat(F.lit(f"{kind}_"), "resource_id").alias("violation_id"), F.lit(f"{kind}_timeout").alias("violation_type"), "resource_id",
            "age_seconds", F.lit(float(limit)).alias("threshold_seconds"), sla_severity(F.col("age_seconds"), F.lit(float(limit))).alias("severity"))
    return side(tasks, F.concat_ws("/", "run_id", "task_id"), "task", task_limit).unionAll(side(runs, F.col("run_id"), "workflow", run_limit))


def violation_statistics(violations: DataFrame) -> DataFrame:
    """violation_type, severity, n."""
    return violations.groupBy("violation_type", "severity").agg(F.count(F.lit(1)).alias("n"))


def latest_violations(violations: DataFrame, limit: int = 100) -> DataFrame:
    """The youngest violations first."""
    return violations.orderBy("age_seconds", "violation_id").limit(limit)


def ready_tasks(tasks: DataFrame) -> DataFrame:
    """run_id, task_id of pending tasks whose dependencies have all completed."""
    # A fixed number of partitions: sort, aggregation and join of a task hold their rows at once, so partitions united by their packed size are too large for it.
    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needs = tasks.where(is_status("status", "PENDING")).select("run_id", "task_id", F.explode_outer("depends_on").alias("needed")).repartition(parts, "run_id", "needed")
    state = tasks.select("run_id", F.col("task_id").alias("needed"), one(is_status("status", "COMPLETED")).alias("_done")).repartition(parts, "run_id", "needed")
    done = state.groupBy("run_id", "needed").agg(F.min("_done").alias("_done")).where("_done = 1")
    joined = needs.join(done, ["run_id", "needed"], "left")
    open_needs = count_if(F.col("needed").isNotNull() & F.col("_done").isNull())
    return joined.groupBy("run_id", "task_id").agg(open_needs.alias("_open")).where(F.col("_open") == 0).select("run_id", "task_id")


def run_outcomes(tasks: DataFrame) -> DataFrame:
    """run_id, total, completed, failed, progress_pct, outcome."""
    per_run = tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), count_if(is_status("status", "COMPLETED")).alias("completed"),
                                          count_if(is_status("status", "FAILED")).alias("failed"))
    done = F.col("completed") + F.col("failed") >= F.col("total")
    return per_run.select("*", (F.col("completed") * 100.0 / F.col("total")).alias("progress_pct"),
                          F.when(done & (F.col("failed") > 0), "FAILED").when(done, "COMPLETED").otherwise("RUNNING").alias("outcome"))


def agent_statistics(events: DataFrame, agent: str, succeeded: Column, runtime: str) -> DataFrame:
    """agent, total, succeeded, failed, success_rate, avg_runtime, tasks_per_hour."""
    total, seconds = F.col("total"), F.col("total_runtime")
    per = events.groupBy(F.col(agent).alias("agent")).agg(
        F.count(F.lit(1)).alias("total"), count_if(succeeded).alias("succeeded"), F.coalesce(F.sum(runtime), F.lit(0.0)).alias("total_runtime"))
    return per.select(
        "agent", "total", "succeeded", (total - F.col("succeeded")).alias("failed"), (F.col("succeeded") / F.greatest(total, F.lit(1))).alias("success_rate"),
        (seconds / F.greatest(total, F.lit(1))).alias("avg_runtime"),
        F.when(seconds > 0, total / F.greatest(seconds / 3600, F.lit(1 / 3600))).otherwise(0.0).alias("tasks_per_hour"))


def operation_telemetry(events: DataFrame, operation: str, runtime: str, failed: Column) -> DataFrame:
    """operation, calls, total_time, errors."""
    return events.groupBy(F.col(operation).alias("operation")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(runtime).alias("total_time"), count_if(failed).alias("errors"))


def priority_score(runtime: Column, priority: Column, seconds_left: Column, alpha: float = 1.0, beta: float = 2.0, gamma: float = 3.0) -> Column:
    """Lower is sooner; no deadline (null) adds no urgency."""
    urgency = F.coalesce(F.lit(gamma) * (F.lit(1.0) / F.greatest(seconds_left, F.lit(1.0))), F.lit(0.0))
    return -(F.lit(alpha) / F.greatest(runtime, F.lit(1.0)) + F.lit(beta) * priority + urgency)


def priority_ranking(tasks: DataFrame, score: Column, keys: Sequence[str]) -> DataFrame:
    """Adds score and position (1 = first); equal scores go by key hash."""
    return order_rank(tasks.withColumn("score", score), "score", keys, rank="position").drop("table_size")


def retry_schedule(retries: Column, base: float = 30, most: float = 300, max_retries: int = 3) -> tuple[Column, Column]:
    """(delay in seconds, abandoned); abandoned tasks have no delay."""
    gone = retries >= max_retries
    # The exponent is bounded so that 2^retries cannot overflow; the cap applies long before.
    delay = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(retries, F.lit(1000))), F.lit(float(most)))
    return F.when(~gone, delay), gone


def estimate_pieces(events: DataFrame, by: Sequence[str], order: str, runtime: str, keys: Sequence[str], keep: float = 0.7, chunk_seconds: int = 3600) -> DataFrame:
    """by, n, first, moved: what the rows of a group do to a moving average, which becomes keep^n * old + moved.

    The update is affine, so it composes: each time chunk of a group is reduced
    on its own, then chunks are weighted by the number of later rows.  A group
    with a third of all events is spread over its chunks.
    """
    chunk = F.floor(F.unix_micros(F.col(order).cast("timestamp")) / (chunk_seconds * 1_000_000))
    rows = events.where(F.col(runtime).isNotNull()).withColumn("_chunk", chunk)
    inside = Window.partitionBy(*by, "_chunk").orderBy(F.col(order).desc(), *[F.col(k).desc() for k in keys])
    rows = rows.withColumn("_later", F.row_number().over(inside) - 1)
    chunks = rows.groupBy(*by, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.lit(1.0 - keep) * F.pow(F.lit(keep), F.col("_later")) * F.col(runtime)).alias("_s"),
        F.max_by(F.col(runtime), F.col("_later")).alias("_first"))
    after = Window.partitionBy(*by).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    weighed = chunks.withColumn("_after", F.coalesce(F.sum("_n").over(after), F.lit(0)))
    return weighed.groupBy(*by).agg(F.sum("_n").alias("n"), F.min_by("_first", "_chunk").alias("first"), F.sum(F.pow(F.lit(keep), F.col("_after")) * F.col("_s")).alias("moved"))


def runtime_estimates(events: DataFrame, by: Sequence[str], order: str, runtime: str, keys: Sequence[str], keep: float = 0.7, chunk_seconds: int = 3600) -> DataFrame:
    """by, n, estimate: the moving average keep * old + (1 - keep) * new, started by the first value."""
    pieces = estimate_pieces(events, by, order, runtime, keys, keep, chunk_seconds)
    return pieces.select(*by, "n", (F.pow(F.lit(keep), F.col("n")) * F.col("first") + F.col("moved")).alias("estimate"))


def status_counts(tasks: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """run_id and one count column per status."""
    return tasks.groupBy("run_id").agg(*[count_if(is_status("status", s)).alias(s.lower()) for s in statuses])


def pending_retries(retries: DataFrame, due: str, key: str, as_of: datetime, limit: int = 10) -> DataFrame:
    """The soonest retries: key, remaining_seconds, is_due."""
    remaining = F.greatest(F.lit(0.0), seconds_between(F.col(due), F.lit(as_of)))
    return retries.orderBy(due, key).limit(limit).select(key, remaining.alias("remaining_seconds"), (remaining <= 0).alias("is_due"))


def expire_requests(requests: DataFrame, as_of: datetime, timeout_seconds: float = 300) -> DataFrame:
    """Status TIMEOUT for queued or processing requests older than the limit; others as they are."""
    old = is_status("status", "QUEUED", "PROCESSING") & (seconds_between(F.lit(as_of), F.col("created_at")) > timeout_seconds)
    return requests.withColumn("expired", old).withColumn("status", F.when(old, "TIMEOUT").otherwise(F.col("status")))


def should_retry(action: Column, reason: Column) -> Column:
    """Never for destructive actions; always for transient failures; not for validation errors; else yes."""
    text = F.lower(reason)
    transient = F.lit(False)
    for t in TRANSIENT_FAILURES:
        transient = transient | text.contains(t)
    return F.when(action.isin(DESTRUCTIVE_ACTIONS), False).when(transient, True).when(text.contains("validation_error"), False).otherwise(True)


def task_priority(agent: Column, action: Column, priority_agents: Sequence[str] = ()) -> Column:
    return (F.when(agent.isin(list(priority_agents)), 8).when(action.isin(URGENT_ACTIONS), 9).when(action.isin(PREPARE_ACTIONS), 7)
            .when(action.isin(ANALYSE_ACTIONS), 5).when(action.isin(REPORT_ACTIONS), 3).otherwise(5))


def run_priorities(tasks: DataFrame, urgent: DataFrame, priority_agents: Sequence[str] = ()) -> DataFrame:
    """run_id, task_count, priority: highest task priority, +1 over 20 tasks, +2 when urgent, at most 10.

    `urgent` holds the run_id values of urgent runs.
    """
    per_run = tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("task_count"), F.max(task_priority(F.col("agent"), F.col("action"), priority_agents)).alias("_top"))
    marked = per_run.join(urgent.select("run_id").distinct().withColumn("_urgent", F.lit(2)), "run_id", "left")
    return marked.select("run_id", "task_count", F.least(F.lit(10), F.col("_top") + F.when(F.col("task_count") > 20, 1).otherwise(0) + F.coalesce("_urgent", F.lit(0))).alias("priority"))
