"""Inputs of the registered queries: the given tables, and columns derived from them alike in Spark and SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = datetime(2001, 12, 1)
AS_OF_SQL = "TIMESTAMP '2001-12-01 00:00:00'"
CUT = datetime(1998, 1, 1)
CUT_SQL = "TIMESTAMP '1998-01-01 00:00:00'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# lineitem with planted nulls
GAPS = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_discount END AS l_discount, l_tax,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus, l_shipdate FROM lineitem)"""


def gaps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumns({
        "l_quantity": F.when(F.col("l_linenumber") != 3, F.col("l_quantity")),
        "l_discount": F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount")),
        "l_returnflag": F.when(F.col("l_partkey") % 11 != 0, F.col("l_returnflag"))})


# orders with repeated rows
REPEATS = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 50 = 0)"


def repeats(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.unionAll(o.where(F.col("o_orderkey") % 50 == 0))


# reference and current orders
BEFORE = f"(SELECT * FROM orders WHERE o_orderdate < {CUT_SQL})"
AFTER = f"(SELECT * FROM orders WHERE o_orderdate >= {CUT_SQL})"


def before_after(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, folder, "orders")
    return o.where(F.col("o_orderdate") < F.lit(CUT)), o.where(F.col("o_orderdate") >= F.lit(CUT))


# run and task records: orders are runs, their lines are tasks
RUNS = """(SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'completed' ELSE 'PENDING' END AS status,
  o_custkey AS client_id, o_orderdate AS created_at, o_orderdate + INTERVAL 1 DAY AS updated_at FROM orders)"""
TASKS = """(SELECT run_id, task_id, min(agent) AS agent, min(action) AS action, min(status) AS status, min(created_at) AS created_at,
  max(created_at) AS updated_at, min(retries) AS retries, min(quantity) AS quantity FROM (
  SELECT l_orderkey AS run_id, l_linenumber AS task_id, l_returnflag AS agent,
    CASE l_suppkey % 5 WHEN 0 THEN 'load_data' WHEN 1 THEN 'train_model' WHEN 2 THEN 'generate_report' WHEN 3 THEN 'drop_table' ELSE 'real_time_prediction' END AS action,
    CASE WHEN l_orderkey % 3 = 0 THEN 'pending' WHEN l_linestatus = 'F' THEN 'COMPLETED' WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'QUEUED' END AS status,
    l_shipdate AS created_at, CAST(l_partkey % 5 AS INTEGER) AS retries, l_quantity AS quantity FROM lineitem) GROUP BY run_id, task_id)"""
# One edge to the task before; run_id % 40 = 0 names a task that does not exist; run_id % 25 = 0 closes a cycle 1 -> 2 -> 1.
EDGES = f"""(SELECT run_id, task_id, needed FROM (
  SELECT run_id, task_id, CASE WHEN task_id > 1 THEN task_id - 1 WHEN run_id % 25 = 0 THEN 2 END AS needed FROM {TASKS}
  UNION ALL SELECT run_id, task_id, 99 AS needed FROM {TASKS} WHERE run_id % 40 = 0 AND task_id = 2) WHERE needed IS NOT NULL)"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "F", "completed").otherwise("PENDING")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), status.alias("status"), F.col("o_custkey").alias("client_id"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("updated_at"))


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    actions = F.array(*[F.lit(a) for a in ("load_data", "train_model", "generate_report", "drop_table", "real_time_prediction")])
    status = (F.when(F.col("l_orderkey") % 3 == 0, "pending").when(F.col("l_linestatus") == "F", "COMPLETED")
              .when(F.col("l_returnflag") == "R", "FAILED").otherwise("QUEUED"))
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("task_id"), F.col("l_returnflag").alias("agent"),
        actions[(F.col("l_suppkey") % 5).cast("int")].alias("action"), status.alias("status"), F.col("l_shipdate").alias("created_at"),
        (F.col("l_partkey") % 5).cast("int").alias("retries"), F.col("l_quantity").alias("quantity"))
    folded = rows.groupBy("run_id", "task_id").agg(
        F.min("agent").alias("agent"), F.min("action").alias("action"), F.min("status").alias("status"), F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"), F.min("retries").alias("retries"), F.min("quantity").alias("quantity"))
    needs = F.array(F.when(F.col("task_id") > 1, F.col("task_id") - 1).when(F.col("run_id") % 25 == 0, 2),
                    F.when((F.col("run_id") % 40 == 0) & (F.col("task_id") == 2), 99))
    return folded.withColumn("depends_on", F.filter(needs, lambda x: x.isNotNull()))


# scored predictions on lineitem: label, probability and class, all from the row itself
SCORED = """(SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS label,
  CASE WHEN l_discount * 10 >= 0.5 THEN 1 ELSE 0 END AS prediction, (l_discount * 100 + l_tax * 100 + 1) / 21.0 AS score,
  l_extendedprice AS actual, l_quantity * 2000.0 AS predicted, CASE l_linestatus WHEN 'O' THEN 'A' ELSE 'R' END AS guess,
  CASE WHEN l_shipdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'first' ELSE 'second' END AS period FROM lineitem)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("label"),
        F.when(F.col("l_discount") * 10 >= 0.5, 1).otherwise(0).alias("prediction"),
        ((F.col("l_discount") * 100 + F.col("l_tax") * 100 + 1) / 21.0).alias("score"), F.col("l_extendedprice").alias("actual"),
        (F.col("l_quantity") * 2000.0).alias("predicted"), F.when(F.col("l_linestatus") == "O", "A").otherwise("R").alias("guess"),
        F.when(F.col("l_shipdate") < F.lit(CUT), "first").otherwise("second").alias("period"))


# part as small feature vectors with an imbalanced class
PART_FEATURES = ["p_size", "p_retailprice", "brand_no"]
PARTS = """(SELECT p_partkey, p_size, p_retailprice, CAST(substr(p_brand, 7) AS INTEGER) AS brand_no, p_type,
  CASE WHEN p_partkey % 7 < 2 THEN 'rare' ELSE 'common' END AS klass FROM part)"""


def parts(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select(
        "p_partkey", "p_size", "p_retailprice", F.substring("p_brand", 7, 10).cast("int").alias("brand_no"), "p_type",
        F.when(F.col("p_partkey") % 7 < 2, "rare").otherwise("common").alias("klass"))
    return p.withColumn("vec", F.array(*[F.col(c).cast("double") for c in PART_FEATURES]))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
