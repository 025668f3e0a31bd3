"""Neighbour-based mutual information against plain loops and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.operators.features import mutual_information, prune
from tallyglass.operators.information import digamma, neighbour_information, range_counts

PATHS = {"broadcast": {}, "pivots": {"small_bytes": 0}}


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain(x, y, k=3):
    """The estimate by comparing every row with every other; y numbers or text."""
    n, total, inside = len(x), 0.0, 1 - 1e-9
    x = np.array(x) / (np.std(x) or 1)
    number = not isinstance(y[0], str)
    if number:
        y = np.array(y) / (np.std(y) or 1)
    else:
        keep = [i for i in range(n) if y.count(y[i]) > 1]
        x, y, n = x[keep], [y[i] for i in keep], len(keep)
    for i in range(n):
        others = [max(abs(x[j] - x[i]), abs(y[j] - y[i])) if number else abs(x[j] - x[i]) for j in range(n) if j != i and (number or y[j] == y[i])]
        kk = min(k, len(others))
        r = sorted(others)[kk - 1]
        if r == 0:
            kk = 1 + others.count(0)
        n_x = sum(abs(x[j] - x[i]) <= r * inside for j in range(n))
        second = psi(sum(abs(y[j] - y[i]) <= r * inside for j in range(n))) if number else psi(len(others) + 1)
        total += psi(kk) - psi(n_x) - second
    return max(0.0, psi(n) + total / n)


def result(df, target, cols, **options):
    return {r["column"]: r["mutual_information"] for r in neighbour_information(df, target, cols, **options).collect()}


@pytest.mark.parametrize("path", PATHS)
def test_against_plain_loops(spark, path):
    rng = np.random.default_rng(3)
    n = 160
    a = rng.normal(0, 1, n)
    data = {"y": a + rng.normal(0, 0.5, n), "smooth": a, "few": np.floor(a), "noise": rng.exponential(2, n), "flat": np.ones(n)}
    klass = ["one" if v > 0.3 else "two" if v > -1 else "three" for v in a]
    klass[0] = "alone"
    rows = [tuple(float(data[c][i]) for c in data) + (klass[i],) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data) + ", klass string").repartition(3)
    features = ["smooth", "few", "noise", "flat"]
    for target, y in (("y", data["y"]), ("klass", klass)):
        got = result(df, target, features, **PATHS[path])
        for c in features:
            assert got[c] == pytest.approx(plain(data[c], y), abs=1e-9), (target, c)


def test_closed_form_of_gaussians(spark):
    """-log(1 - rho^2) / 2 for dependent normal numbers, 0 for independent ones."""
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(0, 1, (3, 4000))
    rows = [(float(x), float(0.9 * x + math.sqrt(1 - 0.81) * y), float(0.5 * x + math.sqrt(0.75) * z), float(z)) for x, y, z in zip(a, b, c)]
    got = result(spark.createDataFrame(rows, "t double, strong double, weak double, apart double"), "t", ["strong", "weak", "apart"], small_bytes=0)
    assert got["strong"] == pytest.approx(-0.5 * math.log(1 - 0.81), abs=0.05)
    assert got["weak"] == pytest.approx(-0.5 * math.log(0.75), abs=0.05) and got["apart"] < 0.05


def test_classes_and_discrete_values(spark):
    """A number that tells the class has the class's entropy; few-valued columns come to the plain count estimate."""
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("klass"), (F.col("id") % 3 * 10 + F.rand(4)).alias("tells"), (F.col("id") % 3).cast("double").alias("code"), F.rand(7).alias("noise"))
    got = result(df, "klass", ["tells", "code", "noise"])
    assert got["tells"] == pytest.approx(math.log(3), abs=0.01) and got["code"] == pytest.approx(math.log(3), abs=0.01) and got["noise"] < 0.03


def test_nulls_and_nothing(spark):
    rows = [(1.0, 2.0, "a"), (None, 1.0, "b"), (2.0, None, "a"), (3.0, 3.0, None), (4.0, 4.0, "a"), (5.0, 1.0, "b")]
    df = spark.createDataFrame(rows, "x double, y double, k string")
    kept = [(x, y) for x, y, _ in rows if x is not None and y is not None]
    sx, sy = np.std([x for x, *_ in rows if x is not None]), np.std([y for _, y, _ in rows if y is not None])
    got = result(df, "y", ["x"])
    assert got["x"] >= 0 and len(kept) == 4 and sx and sy
    assert result(df.limit(0), "y", ["x"]) == {} and result(df.where("k = 'b'"), "k", ["x"]) == {}


def test_pruning_by_neighbours(spark):
    df = spark.range(600).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c")).withColumn("t", F.col("a") + 0.01 * F.col("b"))
    _, report = prune(df, "t", "mutual_info", k=1, estimator="neighbours")
    assert {r["column"] for r in report.collect()} == {"b", "c"}
    assert mutual_information(df, "t", k=1, method="neighbours").first()["column"] == "a"


def test_digamma_and_range_counts(spark):
    got = [r[0] for r in spark.range(1, 60).orderBy("id").select(digamma(F.col("id"))).collect()]
    assert got == pytest.approx([psi(n) for n in range(1, 60)], abs=1e-10)
    values = spark.createDataFrame([("g", 1.0, 2), ("g", 2.0, 1), ("g", 4.0, 5), ("h", 2.0, 7)], "grp string, v double, n long")
    asked = spark.createDataFrame([("g", 1.0, 2.0), ("g", 1.5, 1.7), ("g", 2.0, 9.0), ("h", 0.0, 2.0)], "grp string, lo double, hi double")
    assert {tuple(r) for r in range_counts(values, asked).collect()} == {("g", 1.0, 2.0, 3), ("g", 1.5, 1.7, 0), ("g", 2.0, 9.0, 6), ("h", 0.0, 2.0, 7)}
