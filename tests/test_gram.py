"""Products of many columns in one scan, and what is built on them, against plain numpy."""

import numpy as np
import pytest

from tallyglass.functions.gram import pair_moments
from tallyglass.operators import imputation as I, outliers as O, profile as P


def wide(spark, n, p, missing, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 4)) @ rng.normal(0, 1, (4, p)) + 0.3 * rng.normal(0, 1, (n, p)) + 1000.0
    x[rng.random((n, p)) < missing] = np.nan
    rows = [[None if np.isnan(v) else float(v) for v in line] for line in x]
    names = [f"x{i}" for i in range(p)]
    return x, names, spark.createDataFrame([[i] + r for i, r in enumerate(rows)], "id long, " + ", ".join(f"{c} double" for c in names))


def plain_iterative(x, rounds, ridge=1e-6):
    seen = ~np.isnan(x)
    mean, scale = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    z = np.where(seen, (x - mean) / scale, 0.0)
    for _ in range(rounds):
        new = z.copy()
        for t in range(x.shape[1]):
            others = [i for i in range(x.shape[1]) if i != t]
            design = np.column_stack([np.ones(len(z)), z[:, others]])
            used = design[seen[:, t]]
            beta = np.linalg.solve(used.T @ used + ridge * len(used) * np.eye(used.shape[1]), used.T @ z[seen[:, t], t])
            new[~seen[:, t], t] = (design @ beta)[~seen[:, t]]
        z = new
    return np.where(seen, x, z * scale + mean)


def test_many_correlations_match_single_expressions(spark):
    x, names, df = wide(spark, 400, 24, 0.1)
    df = df.selectExpr("*", "7.0D AS flat", "IF(x0 IS NULL, 5.0D, 6.0D) AS step", "CAST(NULL AS DOUBLE) AS none", "x1 * 2 AS double_x1")
    names += ["flat", "step", "none", "double_x1"]
    got = {(r.column_a, r.column_b): r.correlation for r in P.correlation_pairs(df, names).collect()}
    assert len(got) == len(names) * (len(names) - 1) // 2
    for r in P.correlation_pairs(df, names[:6] + names[-4:]).collect():              # few enough for one expression each
        want = got[(r.column_a, r.column_b)]
        assert (want is None) == (r.correlation is None) and (want is None or want == pytest.approx(r.correlation, abs=1e-9)), r
    for i in range(24):
        for j in range(i + 1, 24):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert got[(names[i], names[j])] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert got[("x0", "step")] is None and got[("x1", "flat")] is None and got[("x1", "double_x1")] == pytest.approx(1)


def test_moments_of_an_empty_table(spark):
    _, names, df = wide(spark, 5, 3, 0.0)
    assert not pair_moments(df.where("id < 0"), names)["n"].any()


def test_wide_mahalanobis(spark):
    x, names, df = wide(spark, 500, 24, 0.0)
    got = np.array([r.d2 for r in O.mahalanobis(df, names).orderBy("id").collect()])
    c = x - x.mean(axis=0)
    assert np.allclose(got, np.einsum("ij,jk,ik->i", c, np.linalg.inv(np.cov(x.T)), c), rtol=1e-6)


def test_iterative_imputation_equals_plain_loops(spark):
    x, names, df = wide(spark, 300, 6, 0.15)
    for rounds in (1, 3):
        got = I.impute_iterative(df, names, max_iter=rounds, tolerance=0.0).orderBy("id").collect()
        assert np.allclose(np.array([list(r)[1:] for r in got]), plain_iterative(x, rounds), rtol=1e-8)


def test_iterative_imputation_of_a_hundred_columns(spark):
    x, names, df = wide(spark, 1500, 100, 0.05)
    out = I.impute_iterative(df.selectExpr("*", "'a' AS _fills"), names, max_iter=2)
    assert out.columns == ["id"] + names + ["_fills"]
    got = np.array([[r[c] for c in names] for r in out.orderBy("id").collect()])
    assert np.allclose(got, plain_iterative(x, 2), rtol=1e-6)


def test_iterative_imputation_of_odd_tables(spark):
    _, names, df = wide(spark, 20, 3, 0.2)
    assert I.impute_iterative(df.where("id < 0"), names).count() == 0
    odd = df.selectExpr("id", "x0", "IF(id = 3, DOUBLE('NaN'), x1) AS x1", "CAST(NULL AS DOUBLE) AS x2")
    rows = I.impute_iterative(odd, names).collect()
    assert all(np.isfinite(r.x0) and np.isfinite(r.x1) and r.x2 is None for r in rows)
