"""What training reads: narrow rows, permuted once, and parts of bounded size."""

from pyspark.sql import functions as F

from tallyglass.operators import kernels, models


def test_only_needed_columns_are_permuted(spark, monkeypatch):
    seen, plain = [], models.random_split
    monkeypatch.setattr(models, "random_split", lambda df, *more: seen.append(df.columns) or plain(df, *more))
    df = spark.range(400).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 2 AS INT) AS y", "repeat('x', 100) AS comment", "'k' AS part_of")
    row = models.shuffled_target_test(df, ["a"], "y", ["id"]).first()
    assert seen == [["id", "a", "y"]] and not row["leakage_detected"]


def test_expanded_rows_lie_in_parts_of_bounded_size(spark, monkeypatch):
    made, plain = [], kernels.cut_lineage
    monkeypatch.setattr(kernels, "PART_BYTES", 16 * 8 * 100)
    monkeypatch.setattr(kernels, "cut_lineage", lambda df: made.append(plain(df)) or made[-1])
    df = spark.range(1000).selectExpr("id", "CAST(id % 10 AS DOUBLE) AS x", "0.0D AS z", "CAST(id % 10 > 4 AS INT) AS k").coalesce(1)
    machine = kernels.kernel_machine(df, ["x", "z"], "k", ["id"], components=16, max_iter=5, folds=2)
    sizes = [r["count"] for r in made[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 130
    assert machine.score(df).where("prediction = k").count() > 800


def test_kept_rows_are_not_expanded(spark, monkeypatch):
    made, plain = [], kernels.cut_lineage
    monkeypatch.setattr(kernels, "cut_lineage", lambda df: made.append(plain(df)) or made[-1])
    df = spark.range(300).selectExpr("id", "CAST(id % 10 AS DECIMAL(5, 1)) AS label", "0 AS fold", "CAST(id % 10 > 4 AS INT) AS k")
    machine = kernels.kernel_machine(df, ["label", "fold"], "k", ["id"], components=16, max_iter=5, folds=2)
    assert made and all(t in ("double", "int", "bigint") for df in made for _, t in df.dtypes)
    assert machine.features.getInputCols() == ["label", "fold"] and machine.score(df).where("prediction = k").count() > 240
