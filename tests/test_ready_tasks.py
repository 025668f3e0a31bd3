"""Tasks whose dependencies are done, with rows that repeat or lack values."""

from tallyglass.operators.runlog import ready_tasks


def test_ready_tasks_on_repeated_and_missing_rows(spark):
    rows = [(1, 1, "completed", []), (1, 2, "pending", [1]), (1, 3, "Pending", [1, 2]), (1, 4, "pending", None), (1, 5, "pending", [9]),
            (2, 1, "completed", []), (2, 1, "failed", []), (2, 2, "pending", [1]), (3, 1, None, []), (3, 2, "pending", [1]), (None, 1, "completed", []), (None, 2, "pending", [1])]
    df = spark.createDataFrame(rows, "run_id long, task_id long, status string, depends_on array<long>")
    made = ready_tasks(df)
    assert sorted((r["run_id"] or 0, r["task_id"]) for r in made.collect()) == [(1, 2), (1, 4)]


def test_join_partitions_are_not_united_by_packed_size(spark):
    df = spark.range(20_000).selectExpr("id div 4 AS run_id", "id % 4 AS task_id", "IF(id % 4 < 2, 'completed', 'pending') AS status", "array(id % 4 - 1) AS depends_on")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = ready_tasks(df)
    assert made.count() == 5000 and f", {parts}), REPARTITION_BY_NUM" in made._jdf.queryExecution().toString()
