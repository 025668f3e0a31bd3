"""Outlier detection: IQR, isolation forest, local outlier factor, Mahalanobis."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tallyglass.functions.expressions import count_if, dbl, numeric_columns, one, per_column, ratio, sample_kurtosis, sample_skewness
from tallyglass.functions.gram import EXPRESSIONS, pair_moments
from tallyglass.functions.ranking import exact_quantiles
from tallyglass.functions.smallmath import chi2_quantile, inverse_or_none
from tallyglass.operators.neighbors import as_vector, nearest
from tallyglass.operators.profile import iqr_bounds
from tallyglass.session import cut_lineage
from tallyglass.sources.readers import seeded_sample

EULER = 0.5772156649015329


def iqr_outliers(df: DataFrame, cols: Sequence[str] | None = None, factor: float = 1.5) -> DataFrame:
    """column, q25, q75, lower, upper, outlier_count, outlier_pct."""
    bounds = iqr_bounds(df, list(cols or numeric_columns(df)), factor)
    return per_column(df, {c: {
        "q25": F.max(F.lit(q1)), "q75": F.max(F.lit(q3)), "lower": F.max(F.lit(lo)), "upper": F.max(F.lit(hi)),
        "outlier_count": count_if((F.col(c) < lo) | (F.col(c) > hi)),
        "outlier_pct": ratio(F.sum(one((F.col(c) < lo) | (F.col(c) > hi))) * 100.0, F.count(F.lit(1)))}
        for c, (q1, q3, lo, hi) in bounds.items()})


def flag_iqr(df: DataFrame, cols: Sequence[str] | None = None, factor: float = 1.5) -> DataFrame:
    """Adds {column}_outlier flags and is_outlier, their union."""
    bounds = iqr_bounds(df, list(cols or numeric_columns(df)), factor)
    flags = {f"{c}_outlier": F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False)) for c, (_, _, lo, hi) in bounds.items()}
    any_flag = F.lit(False)
    for f in flags.values():
        any_flag = any_flag | f
    return df.withColumns({**flags, "is_outlier": any_flag})


def outlier_row_share(flagged: DataFrame) -> DataFrame:
    """n_rows, outlier_rows, outlier_pct of a flagged table."""
    return flagged.agg(F.count(F.lit(1)).alias("n_rows"), count_if(F.col("is_outlier")).alias("outlier_rows"),
                       ratio(F.sum(one(F.col("is_outlier"))) * 100.0, F.count(F.lit(1)), 0.0).alias("outlier_pct"))


def outlier_impact(df: DataFrame, cols: Sequence[str] | None = None, factor: float = 1.5) -> DataFrame:
    """total_outliers, columns_with_outliers, impact_score (% of cells), impact class."""
    counted = iqr_outliers(df, cols, factor)
    n = df.agg(F.count(F.lit(1)).alias("n")).withColumn("_p", F.lit(1))
    total = counted.agg(F.sum("outlier_count").alias("total_outliers"), count_if(F.col("outlier_count") > 0).alias("columns_with_outliers"),
                        F.count(F.lit(1)).alias("_cols")).withColumn("_p", F.lit(1))
    score = ratio(F.col("total_outliers") * 100.0, F.col("n") * F.col("_cols"))
    return total.join(F.broadcast(n), "_p").select(
        "total_outliers", "columns_with_outliers", F.round(score, 3).alias("impact_score"),
        F.when(score > 5, "high").when(score > 2, "moderate").otherwise("low").alias("impact"))


def outlier_share_test(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 0.05) -> DataFrame:
    """column, outlier_share, passed."""
    share = F.col("outlier_pct") / 100
    return iqr_outliers(df, cols).select("column", share.alias("outlier_share"), (share < limit).alias("passed"))


def shape_warnings(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, skewness, kurtosis, skew_warning (|skew| > 2), kurtosis_warning (> 7)."""
    out = per_column(df, {c: {"skewness": sample_skewness(dbl(c)), "kurtosis": sample_kurtosis(dbl(c))} for c in cols or numeric_columns(df)})
    return out.withColumns({"skew_warning": F.coalesce(F.abs("skewness") > 2, F.lit(False)),
                            "kurtosis_warning": F.coalesce(F.col("kurtosis") > 7, F.lit(False))})


def mahalanobis(df: DataFrame, cols: Sequence[str], level: float = 0.975) -> DataFrame:
    """Rows complete in `cols`, with squared distance d2 and is_outlier (d2 over the chi-square quantile).

    Mean and covariance are one aggregation; the p x p inverse goes back into a column expression.
    """
    cols, p = list(cols), len(cols)
    complete = df.dropna(subset=cols)
    wide = p * (p + 1) // 2 > EXPRESSIONS
    if wide:
        moments = pair_moments(complete, cols)
        n = moments["n"][0, 0]
        means, cov = moments["mean"][:, 0], moments["cov"] * (n / (n - 1)) if n > 1 else np.zeros((p, p))
    else:
        row = complete.agg(*[F.avg(dbl(c)).alias(f"m{i}") for i, c in enumerate(cols)], *[
            F.covar_samp(dbl(cols[i]), dbl(cols[j])).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]).first()
        means = np.array([row[f"m{i}"] or 0.0 for i in range(p)])
        cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
    inverse = inverse_or_none(cov)
    if inverse is None:
        inverse = np.linalg.pinv(cov)
    if wide:                                                      # p² terms are too many for an expression
        @F.pandas_udf("double")
        def distance(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in parts:
                x = np.column_stack([c.to_numpy(float) for c in columns]) - means
                yield pd.Series(((x @ inverse) * x).sum(axis=1))
        d2 = distance(*[dbl(c) for c in cols])
    else:
        centred = [dbl(c) - F.lit(float(m)) for c, m in zip(cols, means)]
        d2 = sum([centred[i] * centred[j] * float(inverse[i, j]) for i in range(p) for j in range(p)], F.lit(0.0))
    return complete.withColumn("d2", d2).withColumn("is_outlier", F.col("d2") > chi2_quantile(level, p))


def _path_norm(n: int) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[list[float]]:
    """Nodes [feature, cut, left, right, depth value]; feature -1 marks a leaf."""
    nodes: list[list[float]] = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1.0, 0.0, -1.0, -1.0, depth + _path_norm(len(rows))])
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_features = np.nonzero(high > low)[0]
        if depth >= limit or len(rows) < 2 or not len(open_features):
            return at
        f = int(rng.choice(open_features))
        cut = rng.uniform(low[f], high[f])
        left = rows[:, f] < cut
        if not left.any():
            return at
        nodes[at][0], nodes[at][1] = float(f), float(cut)
        nodes[at][2] = float(build(rows[left], depth + 1))
        nodes[at][3] = float(build(rows[~left], depth + 1))
        return at

    build(x, 0)
    return nodes


def isolation_scores(df: DataFrame, keys: Sequence[str], cols: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Adds `score` = 2^(-mean depth / expected depth) for rows complete in `cols`.

    The trees x sample rows with the smallest hashes, at every table size, are numbered; each
    tree takes `sample` of these numbers by its own seed and grows in its own task. The
    trees (bounded by trees x 2 x sample nodes) are broadcast to score all rows.
    """
    cols = list(cols)
    complete = df.dropna(subset=cols)
    keyed = complete.select(*dict.fromkeys([*keys, *cols])).withColumn("_h", F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)))
    first = keyed.orderBy("_h", *keys).limit(trees * sample)          # trees x sample rows at most, from all rows
    numbered = cut_lineage(first.withColumn("_r", F.row_number().over(Window.orderBy("_h", *keys)) - 1))
    n = numbered.count()
    drawn = [(t, int(r)) for t in range(trees) for r in np.random.default_rng([seed, t, n]).choice(n, min(n, sample), replace=False)] if n else []
    chosen = df.sparkSession.createDataFrame(drawn, "tree int, _r int").join(numbered, "_r")
    depth = math.ceil(math.log2(max(2, sample)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iat[0])
        x = pdf.sort_values("_r")[cols].to_numpy(dtype=float)
        return pd.DataFrame({"tree": [tree], "size": [len(x)], "nodes": [_grow(x, np.random.default_rng([seed, tree]), depth)]})

    grown = chosen.select("tree", "_r", *[dbl(c).alias(c) for c in cols]).groupBy("tree").applyInPandas(
        grow, "tree int, size int, nodes array<array<double>>").collect()       # bounded by trees x sample
    forest = df.sparkSession.sparkContext.broadcast([np.array(r["nodes"], dtype=float) for r in sorted(grown, key=lambda r: r["tree"])])
    norm = _path_norm(max([r["size"] for r in grown], default=2)) or 1.0

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            x = np.array(vectors.tolist(), dtype=float).reshape(len(vectors), -1)
            total = np.zeros(len(x))
            for nodes in forest.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    feature = nodes[at, 0].astype(int)
                    moving = np.nonzero(feature >= 0)[0]
                    if not len(moving):
                        break
                    here = at[moving]
                    left = x[moving, feature[moving]] < nodes[here, 1]
                    at[moving] = np.where(left, nodes[here, 2], nodes[here, 3]).astype(int)
                total += nodes[at, 4]
            yield pd.Series(2.0 ** (-(total / max(1, len(forest.value))) / norm))

    return complete.withColumn("score", score(as_vector(*cols)))


def flag_top_share(scored: DataFrame, score: str, contamination: float) -> DataFrame:
    """is_outlier for the rows whose score lies above the 1 - contamination quantile."""
    cut = exact_quantiles(scored, [score], [1.0 - contamination])[score][0]
    return scored.withColumn("is_outlier", F.col(score) > F.lit(cut))


def isolation_forest(df: DataFrame, keys: Sequence[str], cols: Sequence[str], contamination: float = 0.05, trees: int = 100,
                     sample: int = 256, seed: int = 42) -> DataFrame:
    scored = cut_lineage(isolation_scores(df, keys, cols, trees, sample, seed))          # read by the quantile and by the flags: scored once
    return flag_top_share(scored, "score", contamination)


def local_outlier_factor(df: DataFrame, key: str, vec: str, k: int = 20) -> DataFrame:
    """key, lof: mean density of the neighbours over the own density, from one exact kNN table and two joins."""
    near = nearest(df, df, key, vec, k, exclude_self=True).select(key, "neighbour", "distance")
    near = cut_lineage(near)        # read three times: search once
    kth = near.groupBy(F.col(key).alias("neighbour")).agg(F.max("distance").alias("k_distance"))
    reach = near.join(kth, "neighbour").withColumn("reach", F.greatest("distance", "k_distance"))
    density = reach.groupBy(key).agg((1.0 / (F.avg("reach") + 1e-10)).alias("lrd"))
    other = density.select(F.col(key).alias("neighbour"), F.col("lrd").alias("other_lrd"))
    return near.join(other, "neighbour").groupBy(key).agg(F.avg("other_lrd").alias("_o")).join(density, key).select(
        key, (F.col("_o") / F.col("lrd")).alias("lof"))
