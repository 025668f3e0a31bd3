"""The search inside one task, held against all distances, and how many distances it takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.operators import neighbors as N


def brute(queries, donors, keys, need, metric):
    return [x for _, dist in N._distances(queries, donors, metric) for x in N._closest(dist, keys, need)]


@pytest.mark.parametrize("metric", ["euclidean", "maximum"])
@pytest.mark.parametrize("make", ["even", "ties", "clusters", "huge", "line", "few"])
@pytest.mark.parametrize("width", [1, 3, 40])
def test_same_as_all_distances(make, width, metric):
    random = np.random.RandomState(5)
    n = 4 if make == "few" else 9000 if width == 40 else 3000
    donors = {"even": lambda: random.rand(n, width), "few": lambda: random.rand(n, width), "ties": lambda: random.randint(0, 3, (n, width)).astype(float),
              "clusters": lambda: random.randint(0, 9, (n, 1)) * 1e6 + random.rand(n, width) * 1e-3, "huge": lambda: random.randn(n, width) * 1e90 + 1e91,
              "line": lambda: np.repeat(np.linspace(0, 1, n)[:, None], width, axis=1)}[make]()
    donors = np.unique(donors, axis=0)
    keys = [[2 * i, 2 * i + 1][:1 + i % 2] for i in range(len(donors))]
    queries = np.vstack([donors[::17], donors[:60] + 0.25, donors[:5] * 100])
    assert N.Donors(donors, keys, metric).closest(queries, 6) == brute(queries, donors, keys, 6, metric)


def test_infinite_and_missing_numbers_are_as_before():
    donors = np.array([[0.0], [1.0], [np.inf], [5.0]])
    keys = [[i] for i in range(4)]
    assert N.Donors(donors, keys).closest(np.array([[0.5], [np.inf]]), 2) == brute(np.array([[0.5], [np.inf]]), donors, keys, 2, "euclidean")
    whole = np.array([[0.0], [1.0]])
    assert N.Donors(whole, keys[:2]).closest(np.array([[np.nan], [3.0]]), 1) == brute(np.array([[np.nan], [3.0]]), whole, keys[:2], 1, "euclidean")


def test_distances_grow_slower_than_the_donors(monkeypatch):
    taken, plain = [0], N._distances

    def counted(a, b, metric="euclidean"):
        taken[0] += len(a) * len(b)
        return plain(a, b, metric)
    monkeypatch.setattr(N, "_distances", counted)
    random, each = np.random.RandomState(1), []
    for n in (5_000, 50_000):
        taken[0] = 0
        donors = random.rand(n, 3)
        N.Donors(donors, [[i] for i in range(n)]).closest(random.rand(2_000, 3), 6)
        each.append(taken[0] / 2_000)
    assert each[1] < 0.1 * 50_000 and each[1] < 5 * each[0]


def test_wide_vectors_meet_block_by_block(spark):
    random = np.random.RandomState(2)
    rows = [(i, [float(x) for x in random.randint(0, 3, 20)], "ab"[i % 2]) for i in range(400)] + [(1000 + i, [1.0] * 20, "a") for i in range(9)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, g string").repartition(3)
    for by in (None, "g"):
        few, whole = ([tuple(r) for r in N.nearest(df, df, "id", "vec", 4, by=by, exclude_self=True, **more).orderBy("id", "rank").collect()]
                      for more in ({"small_bytes": 0, "block_rows": 20}, {}))
        assert few == whole and len(few) == 4 * len(rows)
