"""Nearest neighbours, imputation, resampling and outliers on planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.operators import imputation as I, outliers as O, sampling as S
from tallyglass.operators.neighbors import BLOCK_ROWS, MAX_PIVOTS, PivotTree, evaluations, nearest

PATHS = {"broadcast": {}, "pivots": {"small_bytes": 0}, "small blocks": {"small_bytes": 0, "block_rows": 25, "max_pivots": 6}}


def cloud(spark, n=240):
    """Points in the plane; a third of them are copies of one point."""
    rng = np.random.default_rng(5)
    points = rng.normal(0, 10, (n, 2)).round(1)
    points[::3] = (1.0, 2.0)
    return points, spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vec array<double>")


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("itself", [True, False])
def test_nearest_is_exact(spark, path, itself):
    points, df = cloud(spark)
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    got = {}
    for r in nearest(df, df, "id", "vec", 4, exclude_self=itself, **PATHS[path]).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    for i in range(len(points)):
        order = [j for j in np.lexsort((np.arange(len(points)), dist[i])) if not (itself and j == i)][:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == order


def test_pivot_tree_against_brute_force(spark):
    """Clusters, copies and far points in five dimensions, with cells at both levels."""
    rng = np.random.default_rng(8)
    points = np.vstack([rng.normal(c, 1, (400, 5)) for c in (-20, 0, 3, 40)] + [np.zeros((60, 5)), rng.normal(0, 300, (40, 5))]).round(2)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vec array<double>").repartition(4)
    asked = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points[::7] + 0.25)], "id long, vec array<double>")
    for queries, places, itself in ((df, points, True), (asked, points[::7] + 0.25, False)):
        got = {}
        for r in nearest(queries, df, "id", "vec", 3, exclude_self=itself, small_bytes=0).collect():
            got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
        dist = np.sqrt(((places[:, None] - points[None]) ** 2).sum(-1))
        for i in range(len(places)):
            assert [got[i][k] for k in (1, 2, 3)] == [j for j in np.lexsort((np.arange(len(points)), dist[i])) if not (itself and j == i)][:3]


def test_distance_evaluations_grow_slower_than_the_table(spark):
    """Ten times the donors cost each query far less than ten times the distances."""
    cost = []
    for sf in ("0.01", "0.1"):
        rows = spark.read.parquet(f"/root/testdata/sf{sf}/lineitem.parquet").groupBy("l_orderkey").agg(
            F.avg("l_quantity").alias("a"), (F.avg("l_extendedprice") / 1000).alias("b")).select(
            F.lit("").alias("g"), F.col("l_orderkey").alias("qid"), F.array("a", "b").alias("vec"))
        donors = rows.groupBy("g", "vec").agg(F.sort_array(F.collect_list("qid")).alias("keys"))
        n = donors.count()
        tree = PivotTree(donors, {"": n}, "bigint", 6, BLOCK_ROWS, MAX_PIVOTS)
        lists, visits = tree.search(rows.where("qid % 100 = 0").groupBy("g", "vec").agg(F.min("qid").alias("qid")))
        cost.append((n, evaluations(tree, visits).agg(F.avg("evaluations")).first()[0]))
        assert lists.where("size(near) <> 6").isEmpty()
    (n, few), (more, many) = cost
    assert more > 8 * n and many < 5 * few and many < more / 20


def test_nearest_within_groups(spark):
    _, df = cloud(spark, 90)
    df = df.withColumn("g", F.col("id") % 2)
    for options in PATHS.values():
        rows = nearest(df, df, "id", "vec", 2, by="g", exclude_self=True, **options).collect()
        assert len(rows) == 180 and all(r["id"] % 2 == r["neighbour"] % 2 for r in rows)


def test_knn_imputation_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (60, 3)).round(3)
    gone = rng.random((60, 3)) < 0.25
    gone[0] = True
    data = np.where(gone, np.nan, x)
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(data)], "id long, a double, b double, c double")
    got = I.impute_knn(df, "id", ["a", "b", "c"], 5).toPandas().set_index("id").sort_index()[["a", "b", "c"]].to_numpy()
    means = np.nanmean(data, axis=0)
    for i in range(60):
        for c in range(3):
            if not gone[i, c]:
                assert got[i, c] == data[i, c]
                continue
            options = []
            for j in range(60):
                shared = ~gone[i] & ~gone[j]
                if not gone[j, c] and shared.any():
                    options.append((np.sqrt(3 / shared.sum() * ((data[i] - data[j])[shared] ** 2).sum()), j))
            want = np.mean([data[j, c] for _, j in sorted(options)[:5]]) if options else means[c]
            assert got[i, c] == pytest.approx(want)


def test_iterative_imputation_recovers_a_linear_column(spark):
    df = spark.range(2000).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 23).cast("double").alias("b"))
    df = df.withColumn("truth", 3 * F.col("a") - 2 * F.col("b") + 1).withColumn("c", F.when(F.col("id") % 4 != 0, F.col("truth")))
    out = I.impute_iterative(df, ["a", "b", "c"])
    assert out.agg(F.max(F.abs(F.col("c") - F.col("truth")))).first()[0] < 1e-3
    assert out.where("c is null").count() == 0


def test_imputer_choice():
    assert I.choose_imputer("MCAR") == ("simple", 0) and I.choose_imputer("MAR") == ("knn", 10)
    assert I.choose_imputer("MAR", "iterative")[0] == "iterative" and I.choose_imputer("MNAR") == ("iterative", 20)


def test_isolation_forest_finds_planted_points(spark):
    rng = np.random.default_rng(3)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (1000, 2)))] + [(5000 + i, 12.0 + i, -12.0) for i in range(10)]
    df = spark.createDataFrame(points, "id long, a double, b double")
    once = O.isolation_forest(df, ["id"], ["a", "b"], contamination=0.02, trees=50)
    flagged = {r.id for r in once.where("is_outlier").collect()}
    assert {5000 + i for i in range(10)} <= flagged and len(flagged) <= 21
    again = O.isolation_forest(df.repartition(5), ["id"], ["a", "b"], contamination=0.02, trees=50)
    assert {r.id for r in again.where("is_outlier").collect()} == flagged
    dealt = O.isolation_forest(df, ["id"], ["a", "b"], contamination=0.02, trees=20, sample=32)
    assert {5000 + i for i in range(10)} <= {r.id for r in dealt.where("is_outlier").collect()}


def test_local_outlier_factor_finds_the_far_point(spark):
    rng = np.random.default_rng(4)
    rows = [(i, p.tolist()) for i, p in enumerate(rng.normal(0, 1, (100, 2)))] + [(999, [30.0, 30.0])]
    scores = {r["id"]: r["lof"] for r in O.local_outlier_factor(spark.createDataFrame(rows, "id long, vec array<double>"), "id", "vec", 10).collect()}
    assert max(scores, key=scores.get) == 999 and scores[999] > 5


def imbalanced(spark):
    rng = np.random.default_rng(6)
    big = [(i, p.tolist(), "big") for i, p in enumerate(rng.normal(0, 2, (150, 2)))]
    small = [(1000 + i, p.tolist(), "small") for i, p in enumerate(rng.normal(2, 1, (31, 2)))]
    return big, small, spark.createDataFrame(big + small, "id long, vec array<double>, label string")


@pytest.mark.parametrize("method", [S.smote, S.borderline_smote, S.adasyn])
def test_synthetic_points_lie_on_segments(spark, method):
    big, small, df = imbalanced(spark)
    out = method(df, "id", "vec", "label")
    rows = out.collect()
    assert {v: sum(r["label"] == v for r in rows) for v in ("big", "small")} == {"big": 150, "small": 150}
    made = [r for r in rows if r["synthetic"]]
    assert len({r["id"] for r in rows}) == 300 and all(r["label"] == "small" for r in made)
    where = {str(i): np.array(p) for i, p, _ in small}
    points = np.array([p for _, p, _ in small])
    for r in made:
        a, x = where[r["id"].split("#")[0]], np.array(r["vec"])
        ends = points - a
        length = (ends ** 2).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((x - a) * ends).sum(1) / length
        off = np.abs(x - a - t[:, None] * ends).sum(1)
        assert np.nanmin(np.where((t >= -1e-9) & (t <= 1 + 1e-9), off, np.nan)) < 1e-9
    assert sorted(map(str, rows)) == sorted(map(str, method(df.repartition(3), "id", "vec", "label").collect()))


def test_mixed_resampling_keeps_only_agreeing_rows(spark):
    _, _, df = imbalanced(spark)
    assert 0 < S.smote_enn(df, "id", "vec", "label").count() < 300
    assert 0 < S.smote_tomek(df, "id", "vec", "label").count() <= 300
