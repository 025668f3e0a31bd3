"""Ranks, running totals and quantiles against plain sorts, hot values included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.functions import ranking as R
from tallyglass.functions.smallmath import chi2_quantile, chi2_sf


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; one value holds a third of them."""
    return spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 3001).cast("double")).alias("v"),
                                    F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 5).cast("string"))).alias("g")).repartition(7)


@pytest.mark.parametrize("limit", [20, 500])
def test_quantiles_by_narrowing(skewed, limit):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    values = np.array([r.v for r in skewed.select("v").collect()])
    got = R.exact_quantiles(skewed, ["v"], probs, builtin_rows=10, inside_limit=limit)["v"]
    assert got == pytest.approx(list(np.quantile(values, probs)))
    assert got == pytest.approx(R.exact_quantiles(skewed, ["v"], probs)["v"])


def test_quantiles_without_values(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert R.exact_quantiles(empty, ["v"], [0.5]) == {"v": [None]}
    assert R.exact_quantiles(empty, ["v"], [0.5], builtin_rows=0) == {"v": [None]}


def test_grouped_quantiles(skewed):
    rows = skewed.toPandas()
    got = {r["g"]: (r["q0"], r["q1"]) for r in R.grouped_quantiles(skewed, "v", [0.25, 0.5], ["g"]).collect()}
    for g, part in rows.groupby("g"):
        assert got[g] == pytest.approx(tuple(np.quantile(part.v, [0.25, 0.5])))


def test_hash_rank_is_a_permutation_in_any_partitioning(skewed):
    first = R.hash_rank(skewed, ["id"], by=["g"]).select("id", "g", "hash_rank", "group_size").toPandas()
    second = R.hash_rank(skewed.repartition(2), ["id"], by=["g"]).select("id", "g", "hash_rank", "group_size").toPandas()
    assert first.sort_values("id").values.tolist() == second.sort_values("id").values.tolist()
    for _, part in first.groupby("g"):
        assert sorted(part.hash_rank) == list(range(1, len(part) + 1)) and set(part.group_size) == {len(part)}


def test_order_rank_with_a_hot_value(skewed):
    got = R.order_rank(skewed, "v", ["id"]).select("v", "order_rank").toPandas().sort_values("order_rank")
    assert list(got.order_rank) == list(range(1, 3001)) and got.v.is_monotonic_increasing


@pytest.mark.parametrize("kind", ["double", "string"])
def test_running_totals(spark, kind):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), (F.col("id") % 4).alias("m")).withColumn("o", F.lpad(F.col("k").cast("string"), 4, "0") if kind == "string" else F.col("k").cast("double"))
    got = R.running_totals(df, "o", ["m"], following="nxt").toPandas().sort_values("k")
    assert list(got.before_m) == list(got.m.cumsum().shift(fill_value=0)) and set(got.total_m) == {got.m.sum()}
    assert list(got.nxt)[:-1] == list(got.o)[1:] and list(got.nxt.isna())[-1]


def test_chi_square():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert chi2_quantile(0.975, 2) == pytest.approx(-2 * np.log(0.025), abs=1e-9)
