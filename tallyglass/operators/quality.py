"""Data-quality checks, freshness, balance and drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyglass.functions.expressions import (
    count_if, dbl, long_values, numeric_columns, one, per_column, ratio, union_all)
from tallyglass.functions.ranking import exact_quantiles, running_totals
from tallyglass.functions.smallmath import chi2_sf
from tallyglass.operators.missing import null_counts
from tallyglass.operators.outliers import iqr_outliers
from tallyglass.operators.profile import duplicate_keys, duplicate_rows, overall_missing, table_report, target_correlation
from tallyglass.operators.schema import enforce_contract, schema_check

PSI_LIMIT, EFFECT_LIMIT, ALPHA = 0.25, 0.1, 0.05
RULES = ("effect", "p_value")
EPSILON = 1e-4
# Weights of the overall score.
WEIGHTS = {"completeness": 0.3, "consistency": 0.2, "validity": 0.3, "uniqueness": 0.2}


# ---- checks on one table ----

def check_missing(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """column, missing_share, threshold, exceeded."""
    share = F.col("null_pct") / 100
    return null_counts(df, 12).select("column", share.alias("missing_share"), F.lit(threshold).alias("threshold"), (share > threshold).alias("exceeded"))


def check_duplicates(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """n_rows, duplicate_rows, duplicate_pct, duplicate_key_values, advice."""
    whole = duplicate_rows(df).withColumn("_p", F.lit(1))
    if keys:
        repeated = duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("duplicate_key_values")).withColumn("_p", F.lit(1))
        whole = whole.join(F.broadcast(repeated), "_p")       # one row
    else:
        whole = whole.withColumn("duplicate_key_values", F.lit(0).cast("long"))
    return whole.drop("_p").withColumn("advice", F.when(F.col("duplicate_rows") > 0, "remove duplicate rows")
                                       .when(F.col("duplicate_key_values") > 0, "check the key").otherwise("none"))


def check_leakage(df: DataFrame, target: str, threshold: float = 0.95) -> DataFrame:
    """column, abs_correlation, suspicious."""
    return target_correlation(df, target).withColumn("suspicious", F.col("abs_correlation") > threshold)


def check_freshness(df: DataFrame, column: str, as_of: datetime, max_age_hours: float = 24.0) -> DataFrame:
    """earliest, latest, age_hours, span_hours, is_fresh, at a given moment."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    row = df.agg(F.min(column).alias("earliest"), F.max(column).alias("latest"))
    age = (seconds(F.lit(as_of)) - seconds(F.col("latest"))) / 3600
    span = (seconds(F.col("latest")) - seconds(F.col("earliest"))) / 3600
    return row.select("earliest", "latest", age.alias("age_hours"), span.alias("span_hours"), (age <= max_age_hours).alias("is_fresh"))


def check_balance(df: DataFrame, target: str, least_pct: float = 5.0) -> DataFrame:
    """class, n, pct, min_pct, max_pct, balanced."""
    counts = df.groupBy(F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("t"), F.min("n").alias("lo"), F.max("n").alias("hi")).withColumn("_p", F.lit(1))
    pct = lambda c: F.col(c) * 100.0 / F.col("t")
    return counts.withColumn("_p", F.lit(1)).join(F.broadcast(whole), "_p").select(      # one row
        "class", "n", pct("n").alias("pct"), pct("lo").alias("min_pct"), pct("hi").alias("max_pct"), (pct("lo") > least_pct).alias("balanced"))


def check_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """column, below, above, passed."""
    out = per_column(df, {c: {"below": count_if(F.col(c) < lo), "above": count_if(F.col(c) > hi)} for c, (lo, hi) in ranges.items()})
    return out.withColumn("passed", F.col("below") + F.col("above") == 0)


def check_quantiles(df: DataFrame, bounds: Mapping[str, tuple[float, float, float]]) -> DataFrame:
    """column, probability, value, passed: the quantile lies within [low, high]."""
    rows = []
    for p in sorted({b[0] for b in bounds.values()}):
        cols = [c for c, b in bounds.items() if b[0] == p]
        for c, (v,) in exact_quantiles(df, cols, [p]).items():
            rows.append((c, p, v, v is not None and bounds[c][1] <= v <= bounds[c][2]))
    return df.sparkSession.createDataFrame(rows, "column string, probability double, value double, passed boolean")


def rows_out_of_period(df: DataFrame, column: str, first: datetime, last: datetime) -> DataFrame:
    """n_rows, out_of_period, passed."""
    out = count_if((F.col(column) < F.lit(first)) | (F.col(column) > F.lit(last)))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), out.alias("out_of_period"), (out == 0).alias("passed"))


def quality_report(df: DataFrame, expected: Sequence[str], missing_threshold: float = 0.5, duplicate_limit: float = 0.0,
                   outlier_limit: float = 5.0, numeric: Sequence[str] | None = None) -> DataFrame:
    """check, passed, detail for schema, missing, duplicates, distributions, and the share of passed checks."""
    schema = schema_check(expected, df).select(F.lit("schema").alias("check"), (F.col("status") == "pass").alias("passed"),
                                               F.concat_ws(";", F.nullif("missing_columns", F.lit("")), F.nullif("extra_columns", F.lit(""))).alias("detail"))
    flagged = F.array_join(F.array_sort(F.collect_list(F.when(F.col("exceeded"), F.col("column")))), ",")
    missing = check_missing(df, missing_threshold).agg(flagged.alias("detail")).select(
        F.lit("missing").alias("check"), (F.col("detail") == "").alias("passed"), "detail")
    repeated = duplicate_rows(df).select(F.lit("duplicates").alias("check"), (F.col("duplicate_pct") <= duplicate_limit).alias("passed"),
                                         F.col("duplicate_rows").cast("string").alias("detail"))
    heavy = F.array_join(F.array_sort(F.collect_list(F.when(F.col("outlier_pct") > outlier_limit, F.col("column")))), ",")
    shape = iqr_outliers(df, numeric).agg(heavy.alias("detail")).select(
        F.lit("distributions").alias("check"), (F.col("detail") == "").alias("passed"), "detail")
    checks = union_all([schema, missing, repeated, shape])
    return checks.withColumn("score", F.avg(one(F.col("passed"))).over(Window.partitionBy(F.lit(1))) * 100)     # four rows


def summary_report(df: DataFrame) -> DataFrame:
    return table_report(df)


def weighted_score(df: DataFrame, rules: Mapping[str, Mapping[str, object]], keys: Sequence[str] | None = None) -> DataFrame:
    """completeness, consistency, validity, uniqueness (0 to 1) and the weighted score (0 to 100).

    Consistency: share of contract rules that hold.  Validity: share of values
    inside their range, enum or pattern.  Uniqueness: share of rows that do not
    repeat a row (or key).
    """
    complete = overall_missing(df).select((1 - F.col("missing_rate_pct") / 100).alias("completeness"), F.col("n_rows"), F.lit(1).alias("_p"))
    verdicts = enforce_contract(df, rules)
    row_rules = F.col("rule").isin("enum", "min", "max", "pattern")
    judged = verdicts.agg(F.avg(one(~F.col("exceeded"))).alias("consistency"), F.sum(F.when(row_rules, F.col("violations"))).alias("_bad"),
                          F.sum(one(row_rules)).alias("_rules")).withColumn("_p", F.lit(1))
    subject = df.select(*keys) if keys else df
    unique = duplicate_rows(subject).select((1 - F.col("duplicate_pct") / 100).alias("uniqueness"), F.lit(1).alias("_p"))
    out = complete.join(F.broadcast(judged), "_p").join(F.broadcast(unique), "_p")
    out = out.withColumn("validity", F.coalesce(1 - F.try_divide(F.col("_bad"), F.col("n_rows") * F.col("_rules")), F.lit(1.0)))
    score = sum([F.col(c) * w for c, w in WEIGHTS.items()], F.lit(0.0)) * 100
    return out.select(*WEIGHTS, score.alias("score"))


# ---- drift between a reference and a current table ----

def mean_shift(current: DataFrame, reference: DataFrame, cols: Sequence[str] | None = None, limit: float = 0.1) -> DataFrame:
    """column, reference_mean, current_mean, shift = |difference| / |reference mean| (0 when that is 0), drifted."""
    cols = list(cols or [c for c in numeric_columns(reference) if c in current.columns])
    a = per_column(reference, {c: {"reference_mean": F.avg(dbl(c))} for c in cols})
    b = per_column(current, {c: {"current_mean": F.avg(dbl(c))} for c in cols})
    r, c = F.col("reference_mean"), F.col("current_mean")
    shift = F.when(r == 0, 0.0).otherwise(F.try_divide(F.abs(c - r), F.abs(r)))
    return a.join(F.broadcast(b), "column").withColumn("shift", shift).withColumn("drifted", F.col("shift") > limit)     # one row per column


def _two_samples(current: DataFrame, reference: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    """column, value, r, c: counts per distinct value in both tables."""
    a = long_values(reference, cols, cast).select("column", "value", F.lit(1).alias("r"), F.lit(0).alias("c"))
    b = long_values(current, cols, cast).select("column", "value", F.lit(0).alias("r"), F.lit(1).alias("c"))
    return a.unionAll(b).groupBy("column", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def _kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    en = F.sqrt(n * m / (n + m))
    lam = (en + 0.12 + 0.11 / en) * d
    terms = sum([F.exp(-2.0 * k * k * lam * lam) * (2.0 if k % 2 else -2.0) for k in range(1, 41)], F.lit(0.0))
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms)))


def _checked(rule: str) -> str:
    if rule not in RULES:
        raise ValueError(f"unknown rule: {rule}")
    return rule


def numeric_drift(current: DataFrame, reference: DataFrame, cols: Sequence[str], alpha: float = ALPHA, effect: float = EFFECT_LIMIT,
                  rule: str = "effect") -> DataFrame:
    """column, ks, ks_p, wasserstein (in reference deviations), drifted.

    `rule` decides, at every number of rows: "effect" (Wasserstein at or above `effect`)
    or "p_value" (KS p-value below `alpha`; with many rows every difference is significant).  Both statistics come from one
    pair of cumulative counts over distinct values.
    """
    counts = _two_samples(current, reference, cols, "double")
    run = running_totals(counts, "value", ["r", "c"], by=["column"], following="next_value")
    f = ratio(F.col("before_r") + F.col("r"), F.col("total_r"), 0.0)
    g = ratio(F.col("before_c") + F.col("c"), F.col("total_c"), 0.0)
    gap = F.abs(f - g)
    n, v = F.col("r").cast("double"), F.col("value")
    out = run.groupBy("column").agg(
        F.max(gap).alias("ks"), F.sum(gap * F.coalesce(F.col("next_value") - v, F.lit(0.0))).alias("_area"),
        F.max("total_r").cast("double").alias("_n"), F.max("total_c").cast("double").alias("_m"))
    spread = per_column(reference, {c: {"_sd": F.stddev_samp(dbl(c))} for c in cols})
    out = out.join(F.broadcast(spread), "column")              # one row per column
    p = _kolmogorov_p(F.col("ks"), F.col("_n"), F.col("_m"))
    w = F.col("_area") / F.greatest(F.col("_sd"), F.lit(0.001))
    return out.select("column", "ks", p.alias("ks_p"), w.alias("wasserstein"),
                      (w >= effect if _checked(rule) == "effect" else p < alpha).alias("drifted"))


def categorical_drift(current: DataFrame, reference: DataFrame, cols: Sequence[str], psi_limit: float = PSI_LIMIT,
                      effect: float = EFFECT_LIMIT, alpha: float = ALPHA, rule: str = "effect") -> DataFrame:
    """column, psi, js_distance, chi2, dof, p_value, psi_drifted, drifted.

    Shares under 0.0001 count as that in PSI.  chi2 compares current counts with
    what the reference shares predict, over values the reference knows.
    """
    counts = _two_samples(current, reference, cols, "string")
    totals = counts.groupBy("column").agg(F.sum("r").alias("_nr"), F.sum("c").alias("_nc"))
    both = counts.join(F.broadcast(totals), "column")          # one row per column
    p, q = ratio(F.col("r"), F.col("_nr"), 0.0), ratio(F.col("c"), F.col("_nc"), 0.0)
    pe, qe = F.greatest(p, F.lit(EPSILON)), F.greatest(q, F.lit(EPSILON))
    mid = (p + q) / 2
    half = lambda x: F.when(x > 0, x * F.log2(x / mid)).otherwise(0.0)
    expected = p * F.col("_nc")
    out = both.groupBy("column").agg(
        F.sum((qe - pe) * F.log(qe / pe)).alias("psi"), F.sqrt(F.greatest(F.sum(half(p) + half(q)) / 2, F.lit(0.0))).alias("js_distance"),
        F.coalesce(F.sum(F.when(F.col("r") > 0, (F.col("c") - expected) * (F.col("c") - expected) / expected)), F.lit(0.0)).alias("chi2"),
        (count_if(F.col("r") > 0) - 1).alias("dof"), F.max("_nr").alias("_n"))
    rows = [(*r, float(chi2_sf(r["chi2"], r["dof"])) if r["dof"] > 0 else 1.0) for r in out.collect()]      # one row per column
    tested = current.sparkSession.createDataFrame(rows, "column string, psi double, js_distance double, chi2 double, dof bigint, n bigint, p_value double")
    return tested.select(
        "column", "psi", "js_distance", "chi2", "dof", "p_value", (F.col("psi") > psi_limit).alias("psi_drifted"),
        (F.col("js_distance") >= effect if _checked(rule) == "effect" else F.col("p_value") < alpha).alias("drifted"))


def drift_report(current: DataFrame, reference: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), rule: str = "effect") -> DataFrame:
    """column, kind, statistic (Wasserstein or Jensen-Shannon), p_value, drifted.

    `rule` says what decides, at every number of rows: "effect" (the statistic) or "p_value".
    """
    frames = []
    if numeric:
        frames.append(numeric_drift(current, reference, numeric, rule=rule).select(
            "column", F.lit("numeric").alias("kind"), F.col("wasserstein").alias("statistic"), F.col("ks_p").alias("p_value"), "drifted"))
    if categorical:
        frames.append(categorical_drift(current, reference, categorical, rule=rule).select(
            "column", F.lit("categorical").alias("kind"), F.col("js_distance").alias("statistic"), "p_value", "drifted"))
    return union_all(frames)


def dataset_drift(report: DataFrame, share_limit: float = 0.5) -> DataFrame:
    """n_columns, drifted_columns, drift_share, dataset_drift."""
    return report.agg(F.count(F.lit(1)).alias("n_columns"), count_if(F.col("drifted")).alias("drifted_columns"),
                      ratio(F.sum(one(F.col("drifted"))), F.count(F.lit(1)), 0.0).alias("drift_share")).withColumn(
        "dataset_drift", F.col("drift_share") >= share_limit)


def psi(current: DataFrame, reference: DataFrame, cols: Sequence[str], limit: float = PSI_LIMIT) -> DataFrame:
    return categorical_drift(current, reference, cols, limit).select("column", "psi", F.col("psi_drifted").alias("drifted"))


def target_drift(current: DataFrame, reference: DataFrame, target: str, rule: str = "effect") -> DataFrame:
    """The drift row of the target column alone."""
    number = target in numeric_columns(reference)
    return drift_report(current, reference, [target] if number else [], [] if number else [target], rule)


def failed_share(results: DataFrame, passed: str = "passed") -> DataFrame:
    """tests, failed, failure_rate of a table of test results."""
    return results.agg(F.count(F.lit(1)).alias("tests"), count_if(~F.col(passed)).alias("failed"),
                       ratio(F.sum(one(~F.col(passed))), F.count(F.lit(1)), 0.0).alias("failure_rate"))
