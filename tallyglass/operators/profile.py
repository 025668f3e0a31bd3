"""Profiling aggregations: one scan for all columns wherever the statistic allows it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.functions.expressions import (
    atomic_columns, count_if, dbl, distinct_counts, long_values, numeric_columns, one, per_column, ratio, safe_corr, sample_kurtosis,
    sample_skewness, text_columns, tidy, union_all)
from tallyglass.functions.gram import EXPRESSIONS, pair_moments
from tallyglass.functions.ranking import BUILTIN_ROWS, exact_quantiles, quantiles_of_counts, value_counts_of
from tallyglass.session import cut_lineage
from tallyglass.sources.readers import seeded_sample

HISTOGRAM_BINS = 30
KDE_POINTS = 100
SCATTER_POINTS = 5_000


def basic_info(df: DataFrame) -> DataFrame:
    """column, data_type, null_count, n_rows, n_columns."""
    types = dict(df.dtypes)
    n = F.count(F.lit(1)).cast("long")
    return per_column(df, {c: {"data_type": F.max(F.lit(types[c])), "null_count": count_if(F.col(c).isNull()), "n_rows": n,
                               "n_columns": F.max(F.lit(len(df.columns)).cast("long"))} for c in df.columns})


def null_counts(df: DataFrame, digits: int = 3, cols: Sequence[str] | None = None) -> DataFrame:
    """column, null_count, null_pct."""
    share = lambda c: ratio(F.sum(one(F.col(c).isNull())) * 100.0, F.count(F.lit(1)))
    return per_column(df, {c: {"null_count": count_if(F.col(c).isNull()), "null_pct": F.round(share(c), digits)}
                           for c in cols or df.columns})


def overall_missing(df: DataFrame) -> DataFrame:
    """total_missing, n_rows, n_columns, missing_rate_pct, columns_with_missing."""
    totals = [count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    p = len(df.columns)
    names = [F.col(f"m{i}") for i in range(p)]
    total = sum(names[1:], names[0])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *totals).select(
        total.alias("total_missing"), "n_rows", F.lit(p).cast("long").alias("n_columns"),
        F.round(ratio(total * 100.0, F.col("n_rows") * p), 3).alias("missing_rate_pct"),
        sum([one(m > 0) for m in names[1:]], one(names[0] > 0)).cast("long").alias("columns_with_missing"))


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, n, mean, std, min, q25, q50, q75, max; quantiles are exact."""
    cols = list(cols or numeric_columns(df))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    return per_column(df, {c: {
        "n": F.count(c).cast("long"), "mean": F.avg(dbl(c)), "std": F.stddev_samp(dbl(c)), "min": F.min(dbl(c)),
        **{f"q{p}": F.max(F.lit(v).cast("double")) for p, v in zip((25, 50, 75), q[c])}, "max": F.max(dbl(c))} for c in cols})


def iqr_bounds(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> dict[str, tuple[float, float, float, float]]:
    """column -> (q25, q75, lower, upper); columns without values are left out."""
    out = {}
    for c, (q1, q3) in exact_quantiles(df, cols, [0.25, 0.75]).items():
        if q1 is not None:
            out[c] = (q1, q3, q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return out


def distribution_report(df: DataFrame, cols: Sequence[str] | None = None, factor: float = 1.5) -> DataFrame:
    """column, mean, std, skewness, kurtosis, q25, q75, outlier_count, outlier_pct."""
    bounds = iqr_bounds(df, list(cols or numeric_columns(df)), factor)
    stats = {}
    for c, (q1, q3, low, high) in bounds.items():
        x, out = dbl(c), (F.col(c) < low) | (F.col(c) > high)
        stats[c] = {"mean": F.avg(x), "std": F.stddev_samp(x), "skewness": sample_skewness(x), "kurtosis": sample_kurtosis(x),
                    "q25": F.max(F.lit(q1)), "q75": F.max(F.lit(q3)), "outlier_count": count_if(out),
                    "outlier_pct": ratio(F.sum(one(out)) * 100.0, F.count(F.lit(1)))}
    return per_column(df, stats)


def skewness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return per_column(df, {c: {"skewness": sample_skewness(dbl(c))} for c in cols or numeric_columns(df)})


def kurtosis(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return per_column(df, {c: {"kurtosis": sample_kurtosis(dbl(c))} for c in cols or numeric_columns(df)})


def population_shape(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Population skewness (0 under 3 rows) and excess kurtosis (0 under 4 rows)."""
    n = F.count(F.lit(1))
    return per_column(df, {c: {"skewness": F.when(n < 3, 0.0).otherwise(F.skewness(dbl(c))),
                               "kurtosis": F.when(n < 4, 0.0).otherwise(F.kurtosis(dbl(c)))} for c in cols or numeric_columns(df)})


def quantiles(df: DataFrame, cols: Sequence[str] | None = None, probs: Sequence[float] = (0.25, 0.5, 0.75),
              approximate: bool = False) -> DataFrame:
    """column, probability, value; `approximate` trades exactness for a single scan."""
    cols = list(cols or numeric_columns(df))
    if approximate:
        lists = {c: F.percentile_approx(dbl(c), F.array(*[F.lit(p) for p in probs]), F.lit(10_000)) for c in cols}
    else:
        exact = exact_quantiles(df, cols, probs)
        lists = {c: F.max(F.array(*[F.lit(v).cast("double") for v in exact[c]])) for c in cols}
    wide = per_column(df, {c: {"values": lists[c]} for c in cols})
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("probability"), F.col("values").alias("value"))
    return wide.select("column", F.inline(pairs)).toDF("column", "probability", "value")


def interquartile_ranges(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    bounds = exact_quantiles(df, list(cols or numeric_columns(df)), [0.25, 0.75])
    return per_column(df, {c: {"q25": F.max(F.lit(q[0]).cast("double")), "q75": F.max(F.lit(q[1]).cast("double")),
                               "iqr": F.max((F.lit(q[1]) - F.lit(q[0])).cast("double"))} for c, q in bounds.items()})


def value_ranges(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return per_column(df, {c: {"min": F.min(dbl(c)), "max": F.max(dbl(c)), "range": F.max(dbl(c)) - F.min(dbl(c))}
                           for c in cols or numeric_columns(df)})


def uniqueness(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """column, distinct_count (nulls ignored), uniqueness_ratio."""
    cols = list(cols or atomic_columns(df))
    if approximate:
        return per_column(df, {c: {"distinct_count": F.approx_count_distinct(F.col(c), 0.01).cast("long"),
                                   "uniqueness_ratio": ratio(F.approx_count_distinct(F.col(c), 0.01), F.count(F.lit(1)))} for c in cols})
    n = df.agg(F.count(F.lit(1)).alias("_n")).withColumn("_p", F.lit(1))
    return distinct_counts(df, cols).withColumn("_p", F.lit(1)).join(F.broadcast(n), "_p").select(
        "column", "distinct_count", ratio(F.col("distinct_count"), F.col("_n")).alias("uniqueness_ratio"))


def value_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """value, n, share of non-null rows; largest first, ties by value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total")).withColumn("_p", F.lit(1))
    out = counts.withColumn("_p", F.lit(1)).join(F.broadcast(total), "_p").select(
        "value", "n", ratio(F.col("n"), F.col("_total")).alias("share"))
    return out.orderBy(F.col("n").desc(), "value").limit(k) if k else out


def _counts_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column, value, n over several string columns with one shuffle of partial counts."""
    return long_values(df, cols, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, distinct_count, top_value, top_count, cardinality class."""
    counts = _counts_long(df, list(cols or text_columns(df)))
    first = F.min(F.struct((-F.col("n")).alias("k"), F.col("value")))
    distinct = F.count(F.lit(1))
    return counts.groupBy("column").agg(
        distinct.alias("distinct_count"), first["value"].alias("top_value"), (-first["k"]).alias("top_count"),
        F.when(distinct > 50, "high").when(distinct > 10, "medium").otherwise("low").alias("cardinality"))


def modes(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, mode (smallest value among the most frequent, as text), n; numbers compare as numbers."""
    cols = list(cols or atomic_columns(df))
    numbers, others = [c for c in cols if c in numeric_columns(df)], [c for c in cols if c not in numeric_columns(df)]
    frames = []
    if numbers:
        counts = long_values(df, numbers).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        frames.append(counts)
    if others:
        frames.append(_counts_long(df, others))
    picked = []
    for frame in frames:
        best = F.min(F.struct((-F.col("n")).alias("k"), F.col("value")))
        picked.append(frame.groupBy("column").agg(best["value"].cast("string").alias("mode"), (-best["k"]).alias("n")))
    return union_all(picked)


def _many_correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """The same rows for many columns: two scans with matrix products instead of one expression per pair.

    Only pairs whose variance the products cannot tell from rounding are settled by an expression each.
    """
    m = pair_moments(df, cols)
    rows, doubtful = [], []
    for i, j in combinations(range(len(cols)), 2):
        va, vb, n = m["var"][i, j], m["var"][j, i], m["n"][i, j]
        if n and va != 0 and vb != 0 and not (va > 0 and vb > 0):
            doubtful.append((cols[i], cols[j]))
        else:
            rows.append((cols[i], cols[j], float(m["cov"][i, j] / math.sqrt(va * vb)) if n and va > 0 and vb > 0 else None))
    found = df.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double")
    for at in range(0, len(doubtful), EXPRESSIONS):
        part = doubtful[at:at + EXPRESSIONS]
        one = df.agg(*[safe_corr(F.col(a), F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(part)])
        found = found.unionAll(one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"p{i}").alias("correlation")) for i, (a, b) in enumerate(part)]))))
    return found


def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column_a, column_b, correlation for all a < b, over rows with both values."""
    cols = list(cols or numeric_columns(df))
    pairs = list(combinations(cols, 2))
    if len(pairs) > EXPRESSIONS:
        return _many_correlations(df, cols)
    stats = {f"{i}": {"correlation": safe_corr(F.col(a), F.col(b))} for i, (a, b) in enumerate(pairs)}
    names_a = F.array(*[F.lit(a) for a, _ in pairs])
    names_b = F.array(*[F.lit(b) for _, b in pairs])
    long = per_column(df, stats, "pair")
    return long.select(names_a[F.col("pair").cast("int")].alias("column_a"), names_b[F.col("pair").cast("int")].alias("column_b"), "correlation")


def target_correlation(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """column, abs_correlation with the target; undefined ones are left out."""
    cols = [c for c in (cols or numeric_columns(df)) if c != target]
    long = per_column(df, {c: {"abs_correlation": F.abs(safe_corr(F.col(c), F.col(target)))} for c in cols})
    return long.where(F.col("abs_correlation").isNotNull()).orderBy(F.col("abs_correlation").desc(), "column")


def covariance_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column_a, column_b, covariance (a <= b) and the mean of column_a, over complete rows."""
    cols = list(cols)
    complete = df.dropna(subset=cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    names_a, names_b = F.array(*[F.lit(a) for a, _ in pairs]), F.array(*[F.lit(b) for _, b in pairs])
    long = per_column(complete, {f"{i}": {"covariance": F.covar_samp(dbl(a), dbl(b)), "mean_a": F.avg(dbl(a))}
                                 for i, (a, b) in enumerate(pairs)}, "pair")
    return long.select(names_a[F.col("pair").cast("int")].alias("column_a"), names_b[F.col("pair").cast("int")].alias("column_b"),
                       "covariance", "mean_a")


def histogram(df: DataFrame, col: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """bin (0-based), low, high, n for equal-width bins, the last one closed; empty bins included."""
    row = df.agg(F.min(dbl(col)).alias("lo"), F.max(dbl(col)).alias("hi")).first()
    lo, hi = (row["lo"], row["hi"]) if row["lo"] is not None else (0.0, 1.0)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    placed = df.where(F.col(col).isNotNull()).select(
        F.least(F.floor((dbl(col) - lo) / width), F.lit(bins - 1)).cast("long").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.col("bin") * width + lo).alias("low"), ((F.col("bin") + 1) * width + lo).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"))


def box_stats(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Quartiles, whiskers at the extreme values within 1.5 IQR, and outlier count, per category."""
    group = by or "_whole"
    base = df.withColumn("_whole", F.lit("all")) if by is None else df
    if base.count() <= BUILTIN_ROWS:
        rows = base.where(F.col(col).isNotNull()).select(group, dbl(col).alias("_v"), F.lit(1).alias("_n"))
        q = rows.groupBy(group).agg(F.percentile("_v", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])).alias("_q"))
        counts, quarts = rows, q.select(group, *[F.col("_q")[i].alias(f"q{i}") for i in range(3)])
    else:
        counts = cut_lineage(value_counts_of(base, col, [group]))          # read by the quartiles and by the whiskers
        quarts = quantiles_of_counts(counts, [0.25, 0.5, 0.75], [group])
    reach = (F.col("q2") - F.col("q0")) * 1.5
    inside = (F.col("_v") >= F.col("q0") - reach) & (F.col("_v") <= F.col("q2") + reach)
    return counts.join(quarts, group).groupBy(F.col(group).alias("category")).agg(
        F.sum("_n").alias("n"), F.max("q0").alias("q25"), F.max("q1").alias("median"), F.max("q2").alias("q75"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"), F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("outliers"))


def scatter_points(df: DataFrame, x: str, y: str, keys: Sequence[str], points: int = SCATTER_POINTS, seed: int = 42) -> DataFrame:
    """At most `points` seeded sample points, for drawing."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return seeded_sample(pairs.select(*dict.fromkeys([*keys, x, y])), points, keys, seed).select(F.col(x).alias("x"), F.col(y).alias("y"))


def kernel_density(df: DataFrame, col: str, points: int = KDE_POINTS) -> DataFrame:
    """x, density: Gaussian kernel, Scott bandwidth, on an even grid; one aggregate per grid point."""
    x = dbl(col)
    row = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd")).first()
    if not row["n"] or not row["sd"]:
        return df.sparkSession.createDataFrame([], "x double, density double")
    h = row["sd"] * row["n"] ** -0.2
    grid = [row["lo"] + (row["hi"] - row["lo"]) * i / (points - 1) for i in range(points)]
    norm = h * math.sqrt(2 * math.pi)
    return per_column(df, {repr(g): {"density": F.avg(F.exp((x - g) * (x - g) * (-0.5 / (h * h)))) / norm} for g in grid}, "x").select(
        F.col("x").cast("double").alias("x"), "density")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n_rows, duplicate_rows (beyond the first of each full-row group), duplicate_pct."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    total, distinct = F.sum("_n"), F.count(F.lit(1))
    return groups.agg(F.coalesce(total, F.lit(0)).alias("n_rows"), F.coalesce(total - distinct, F.lit(0)).alias("duplicate_rows"),
                      F.coalesce(ratio((total - distinct) * 100.0, total), F.lit(0.0)).alias("duplicate_pct"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def row_null_share(df: DataFrame) -> Column:
    """Share of null columns in each row."""
    flags = [one(F.col(c).isNull()) for c in df.columns]
    return sum(flags[1:], flags[0]) / F.lit(float(len(flags)))


def row_null_density(df: DataFrame, limit: float = 0.3) -> DataFrame:
    """mean, std, max of the row null share, and rows above the limit."""
    share = df.select(row_null_share(df).alias("s"))
    return share.agg(F.avg("s").alias("mean_density"), F.stddev_samp("s").alias("std_density"), F.max("s").alias("max_density"),
                     count_if(F.col("s") > limit).alias("rows_over_limit"))


def row_missing_buckets(df: DataFrame) -> DataFrame:
    """bucket, n: rows with 0, up to 25, 50, 75 and over 75 % null columns."""
    s = F.col("s")
    bucket = (F.when(s == 0, "0%").when(s <= 0.25, "1-25%").when(s <= 0.5, "26-50%").when(s <= 0.75, "51-75%").otherwise("76-100%"))
    return df.select(row_null_share(df).alias("s")).groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), count_if(s > 0.5).alias("rows_over_half"))


def group_means(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(dbl(value)).alias("group_mean"), F.count(value).alias("n"))


def table_report(df: DataFrame) -> DataFrame:
    """(column, statistic, value) over all atomic columns: nulls, distinct values, and numeric moments and quantiles."""
    cols = [c for c in atomic_columns(df)]
    nulls = tidy(null_counts(df, cols=cols), ["column"], ["null_count", "null_pct"])
    distinct = tidy(uniqueness(df, cols), ["column"], ["distinct_count", "uniqueness_ratio"])
    numbers = [c for c in numeric_columns(df)]
    frames = [nulls, distinct]
    if numbers:
        frames.append(tidy(describe(df, numbers), ["column"], ["n", "mean", "std", "min", "q25", "q50", "q75", "max"]))
        frames.append(tidy(population_shape(df, numbers), ["column"], ["skewness", "kurtosis"]))
    return union_all(frames)
