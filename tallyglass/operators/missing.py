"""Where values are missing, why, and what to do about it."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F, types as T

from tallyglass.functions.expressions import (
    count_if, dbl, numeric_columns, one, per_column, ratio, safe_corr, sample_skewness, text_columns)
from tallyglass.functions.ranking import exact_quantiles
from tallyglass.functions.smallmath import chi2_sf
from tallyglass.operators.profile import modes, null_counts, overall_missing, row_null_share

SYSTEMATIC_CORRELATION = 0.7
DROP_PCT, IMPUTE_PCT = 50.0, 10.0
CRITICAL_PCT = 30.0


def missing_patterns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """pattern (1 = missing, in column order), n."""
    bits = F.concat(*[one(F.col(c).isNull()).cast("string") for c in cols or df.columns])
    return df.groupBy(bits.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def missing_correlation(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = SYSTEMATIC_CORRELATION) -> DataFrame:
    """column_a, column_b, correlation of the missing indicators, systematic flag; constant indicators are left out."""
    n, x, y, both = (F.col(c).cast("double") for c in ("n", "missing_a", "missing_b", "missing_both"))
    r = F.try_divide(n * both - x * y, F.sqrt(x * (n - x)) * F.sqrt(y * (n - y)))
    return _pair_counts(df, cols).select("column_a", "column_b", r.alias("correlation")).where(F.col("correlation").isNotNull()).withColumn(
        "systematic", F.abs("correlation") > threshold)


def _pair_counts(df: DataFrame, cols: Sequence[str] | None) -> DataFrame:
    """column_a, column_b, n, missing_a, missing_b, missing_both.

    The table is reduced to its null patterns first; pairs are counted on those few rows.
    """
    names = list(cols or df.columns)
    flags = [F.col(c).isNull().alias(f"f{i}") for i, c in enumerate(names)]
    patterns = df.select(*flags).groupBy(*[f"f{i}" for i in range(len(names))]).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(names[i]).alias("column_a"), F.lit(names[j]).alias("column_b"), F.col(f"f{i}").alias("a"), F.col(f"f{j}").alias("b"))
                      for i, j in combinations(range(len(names)), 2)])
    weigh = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return patterns.select("n", F.inline(pairs)).groupBy("column_a", "column_b").agg(
        F.sum("n").alias("n"), weigh(F.col("a")).alias("missing_a"), weigh(F.col("b")).alias("missing_b"), weigh(F.col("a") & F.col("b")).alias("missing_both"))


def missing_independence(df: DataFrame, cols: Sequence[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Pairwise chi-square test of missing indicators: column_a, column_b, chi2, p_value, mechanism."""
    out = []
    for row in _pair_counts(df, cols).collect():       # one row per pair of columns
        n, nx, ny, both = row["n"], row["missing_a"], row["missing_b"], row["missing_both"]
        cells = nx * ny * (n - nx) * (n - ny)
        if cells:
            chi2 = n * (both * n - nx * ny) ** 2 / cells
            p = chi2_sf(chi2, 1)
            out.append((row["column_a"], row["column_b"], float(chi2), float(p), "MCAR" if p > alpha else "not MCAR"))
    return df.sparkSession.createDataFrame(out, "column_a string, column_b string, chi2 double, p_value double, mechanism string")


def missing_mechanism(df: DataFrame) -> DataFrame:
    """One row: std of missing shares, mean |correlation| with the row mean of the other numbers, and the verdict."""
    cols, numbers = df.columns, numeric_columns(df)
    aggregates = [ratio(F.sum(one(F.col(c).isNull())), F.count(F.lit(1))).alias(f"s{i}") for i, c in enumerate(cols)]
    for i, c in enumerate(cols):
        others = [x for x in numbers if x != c]
        if len(numbers) > 1 and others:
            row_sum = sum([F.coalesce(dbl(x), F.lit(0.0)) for x in others], F.lit(0.0))
            filled = sum([one(F.col(x).isNotNull()) for x in others], F.lit(0))
            aggregates.append(F.abs(safe_corr(one(F.col(c).isNull()), F.try_divide(row_sum, filled.cast("double")))).alias(f"r{i}"))
        else:
            aggregates.append(F.max(F.lit(None).cast("double")).alias(f"r{i}"))
    shares = F.array(*[F.col(f"s{i}") for i in range(len(cols))])
    mean = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / len(cols)
    spread = F.sqrt(F.aggregate(shares, F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))) / max(1, len(cols) - 1))
    links = F.filter(F.array(*[F.when(F.col(f"s{i}") > 0, F.col(f"r{i}")) for i in range(len(cols))]), lambda x: x.isNotNull())
    row = df.agg(*aggregates).withColumn("_m", mean)
    out = row.select(
        F.aggregate(shares, F.lit(0.0), lambda a, x: a + x).alias("_any"), spread.alias("share_std"),
        F.try_divide(F.aggregate(links, F.lit(0.0), lambda a, x: a + x), F.size(links).cast("double")).alias("mean_abs_correlation"))
    verdict = (F.when(F.col("_any") == 0, "NO_MISSING").when(F.col("share_std") < 0.1, "MCAR")
               .when(F.col("mean_abs_correlation") > 0.1, "MAR").otherwise("MNAR"))
    return out.select("share_std", "mean_abs_correlation", verdict.alias("pattern"))


def missing_candidates(df: DataFrame) -> DataFrame:
    """Columns with over 50 % missing (drop) and 10 to 50 % (impute)."""
    pct = F.col("null_pct")
    return null_counts(df).where(pct > IMPUTE_PCT).select(
        "column", "null_pct", F.when(pct > DROP_PCT, "drop").otherwise("impute").alias("action"))


def imputation_plan(df: DataFrame) -> DataFrame:
    """column, method, value (as text) for columns with nulls: median when |skew| > 1, mean otherwise, mode for text."""
    present = df.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)], F.count(F.lit(1)).alias("n")).first()
    holed = [c for i, c in enumerate(df.columns) if present[f"c{i}"] < present["n"]]       # only these need statistics
    numbers, texts = [c for c in numeric_columns(df) if c in holed], [c for c in text_columns(df) if c in holed]
    medians = exact_quantiles(df, numbers, [0.5])
    cols = numbers + texts
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, method string, value string")
    stats = {}
    for c in cols:
        if c in numbers:
            skewed = F.abs(sample_skewness(dbl(c))) > 1
            median = F.lit(medians[c][0]).cast("double")
            stats[c] = {"method": F.when(skewed, "median").otherwise("mean"),
                        "value": F.round(F.when(skewed, F.max(median)).otherwise(F.avg(dbl(c))), 3)}
        else:
            stats[c] = {"method": F.max(F.lit("mode")), "value": F.max(F.lit(None).cast("double"))}
    plan = per_column(df, stats)
    if not texts:
        return plan.select("column", "method", F.col("value").cast("string").alias("value"))
    best = F.broadcast(modes(df, texts).select("column", "mode"))     # one row per text column
    return plan.join(best, "column", "left").select(
        "column", "method", F.coalesce(F.col("mode"), F.col("value").cast("string")).alias("value"))


def completeness_score(df: DataFrame) -> DataFrame:
    """quality_score = 100 - missing rate, its impact class, and how many of the limits 95, 80 and 60 the score misses."""
    rate, score = F.col("missing_rate_pct"), F.col("quality_score")
    return overall_missing(df).withColumn("quality_score", F.round(100 - rate, 2)).select(
        "quality_score", F.when(rate < 5, "low").when(rate < 20, "medium").otherwise("high").alias("impact"),
        sum([one(score < limit) for limit in (95, 80, 60)], F.lit(0)).alias("limits_missed"))


def critical_columns(df: DataFrame, limit: float = CRITICAL_PCT) -> DataFrame:
    return null_counts(df).where(F.col("null_pct") > limit)


def drop_sparse(df: DataFrame, column_limit: float = 0.5, row_limit: float = 0.5) -> DataFrame:
    """Without columns, then rows, whose missing share is above the limit."""
    row = df.agg(*[F.avg(one(F.col(c).isNull())).alias(f"s{i}") for i, c in enumerate(df.columns)]).first()
    kept = df.select(*[c for i, c in enumerate(df.columns) if (row[f"s{i}"] or 0.0) <= column_limit])
    return kept.where(row_null_share(kept) <= row_limit)


def imputation_check(df: DataFrame, target: str | None = None) -> DataFrame:
    """n_rows, nulls, null_pct, infinite values, nulls in the target."""
    cols = df.columns
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    nulls = sum([count_if(F.col(c).isNull()) for c in cols[1:]], count_if(F.col(cols[0]).isNull()))
    infinite = sum([count_if(F.abs(F.col(c)) == float("inf")) for c in floats], F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), nulls.cast("long").alias("nulls"),
        ratio(nulls * 100.0, F.count(F.lit(1)) * len(cols)).alias("null_pct"), infinite.cast("long").alias("infinite_values"),
        (count_if(F.col(target).isNull()) if target else F.max(F.lit(None).cast("long"))).alias("target_nulls"))
