"""Trees that learn counted cells instead of rows."""

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import models


def planted(spark, classes):
    """Two features of ten values each, so that bins and values are one; the class follows both, with some noise."""
    df = spark.range(0, 6000, 1, 3).select("id", (F.col("id") % 10).cast("double").alias("a"), F.pmod(F.xxhash64("id"), F.lit(10)).cast("double").alias("b"))
    noisy = F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)) == 0, 1).otherwise(0)
    return df.withColumn("k", F.concat(F.lit("c"), ((F.when(F.col("a") * F.col("b") > 20, 1).otherwise(0) + F.when(F.col("a") > 6, 1).otherwise(0) + noisy) % classes).cast("string")))


@pytest.mark.parametrize("name, classes", [("decision_tree", 2), ("gradient_boosting", 2), ("random_forest", 2), ("gradient_boosting", 3), ("random_forest", 3)])
def test_cells_give_the_model_of_the_rows(spark, monkeypatch, name, classes):
    df = planted(spark, classes).cache()
    options = {"decision_tree": {}, "gradient_boosting": {"maxIter": 3, "maxDepth": 3}, "random_forest": {"numTrees": 12}}[name]
    whole = models.predict(models.fit_classifier(df, ["a", "b"], "k", name, **options), df, "k").select("id", F.col("prediction").alias("whole"))
    monkeypatch.setattr(models, "FOLD_ROWS", 0)
    monkeypatch.setattr(models, "FOLD_SHARE", 0)
    seen = []
    cut = models.cut_lineage
    monkeypatch.setattr(models, "cut_lineage", lambda x: seen.append(cut(x)) or seen[-1])
    folded = models.predict(models.fit_classifier(df, ["a", "b"], "k", name, **options), df, "k")
    assert seen[0].agg(F.sum("weight")).first()[0] == 6000 and seen[0].count() <= 100 * classes          # every row counts, few are walked
    assert not [c for c in folded.columns if c.startswith("_bin_")]
    both = folded.select("id", "k", F.col("prediction").alias("folded")).join(whole, "id").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("whole") == F.col("folded")).cast("double")).alias("same"),
        F.avg((F.col("k") == F.col("whole")).cast("double")).alias("x"), F.avg((F.col("k") == F.col("folded")).cast("double")).alias("y")).first()
    assert both["n"] == 6000
    if name == "random_forest":          # other draws of the same number
        assert both["same"] > 0.95 and abs(both["x"] - both["y"]) < 0.02
    else:
        assert both["same"] == 1


def test_parameters_on_single_rows_keep_the_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "FOLD_ROWS", 0)
    monkeypatch.setattr(models, "FOLD_SHARE", 0)
    monkeypatch.setattr(models, "_fit_cells", None)
    models.fit_classifier(planted(spark, 2), ["a", "b"], "k", "decision_tree", minInstancesPerNode=50)


def test_missing_values_are_refused_as_before(spark, monkeypatch):
    df = planted(spark, 2).withColumn("a", F.when(F.col("id") != 5, F.col("a")))
    monkeypatch.setattr(models, "FOLD_ROWS", 0)
    monkeypatch.setattr(models, "FOLD_SHARE", 0)
    with pytest.raises(Exception):
        models.fit_classifier(df, ["a", "b"], "k", "decision_tree")
