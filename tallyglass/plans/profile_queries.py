"""Queries over the profiling aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.operators import profile as P
from tallyglass.plans.catalog import query, rounded, union_sql
from tallyglass.plans.inputs import GAPS, REPEATS, gaps, repeats, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ALL_GAPS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
            "l_linestatus", "l_shipdate"]
TYPES = ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double", "string", "string", "timestamp_ntz"]


def per_column_sql(cols, body, source="lineitem"):
    """One SELECT per column; {c} stands for the column."""
    return union_sql([f"""SELECT '{c}' AS "column", {body.format(c=c)} FROM {source}""" for c in cols])


def pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


NULLS = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in ALL_GAPS)


@query("a01_basic_info", union_sql([f"""SELECT '{c}' AS "column", '{t}' AS data_type, count(*) FILTER ({c} IS NULL) AS null_count, count(*) AS n_rows,
  CAST(11 AS BIGINT) AS n_columns FROM {GAPS}""" for c, t in zip(ALL_GAPS, TYPES)]))
def a01(spark, d):
    return P.basic_info(gaps(spark, d))


@query("a02_null_counts", per_column_sql(ALL_GAPS, "count(*) FILTER ({c} IS NULL) AS null_count, round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 3) AS null_pct", GAPS))
def a02(spark, d):
    return P.null_counts(gaps(spark, d))


@query("a03_overall_missing", f"""SELECT {NULLS} AS total_missing, count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns,
  round(({NULLS}) * 100.0 / (count(*) * 11), 3) AS missing_rate_pct, CAST(3 AS BIGINT) AS columns_with_missing FROM {GAPS}""")
def a03(spark, d):
    return P.overall_missing(gaps(spark, d))


DESCRIBE = ("count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, "
            "round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max")


@query("a04_describe", per_column_sql(NUMBERS, DESCRIBE, GAPS))
def a04(spark, d):
    return rounded(P.describe(gaps(spark, d), NUMBERS))


def outlier_filter(c):
    lo = f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM lineitem)"
    hi = f"(SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM lineitem)"
    return f"{c} < {lo} OR {c} > {hi}"


@query("a05_distribution_report", union_sql([f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(skewness({c}), 4) AS skewness,
  round(kurtosis({c}), 4) AS kurtosis, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.75), 4) AS q75,
  count(*) FILTER ({outlier_filter(c)}) AS outlier_count, round(count(*) FILTER ({outlier_filter(c)}) * 100.0 / count(*), 4) AS outlier_pct FROM lineitem""" for c in NUMBERS]))
def a05(spark, d):
    return rounded(P.distribution_report(table(spark, d, "lineitem"), NUMBERS), 4)


@query("a06_skewness", per_column_sql(NUMBERS, "round(skewness({c}), 5) AS skewness"))
def a06(spark, d):
    return rounded(P.skewness(table(spark, d, "lineitem"), NUMBERS), 5)


@query("a07_kurtosis", per_column_sql(NUMBERS, "round(kurtosis({c}), 5) AS kurtosis"))
def a07(spark, d):
    return rounded(P.kurtosis(table(spark, d, "lineitem"), NUMBERS), 5)


@query("a08_population_shape", per_column_sql(NUMBERS, "round(skewness({c}) * (count(*) - 2) / sqrt(count(*)::DOUBLE * (count(*) - 1)), 5) AS skewness, round(kurtosis_pop({c}), 5) AS kurtosis"))
def a08(spark, d):
    return rounded(P.population_shape(table(spark, d, "lineitem"), NUMBERS), 5)


@query("a09_quantiles", union_sql([f"""SELECT '{c}' AS "column", {p}::DOUBLE AS probability, round(quantile_cont({c}, {p}), 4) AS value FROM lineitem"""
                                   for c in NUMBERS for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
def a09(spark, d):
    return rounded(P.quantiles(table(spark, d, "lineitem"), NUMBERS, (0.05, 0.25, 0.5, 0.75, 0.95)), 4)


@query("a09_interquartile_ranges", per_column_sql(NUMBERS, "round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.75), 4) AS q75, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr"))
def a09b(spark, d):
    return rounded(P.interquartile_ranges(table(spark, d, "lineitem"), NUMBERS), 4)


@query("a10_value_ranges", per_column_sql(NUMBERS, "min({c}) AS min, max({c}) AS max, round(max({c}) - min({c}), 6) AS range"))
def a10(spark, d):
    return rounded(P.value_ranges(table(spark, d, "lineitem"), NUMBERS))


@query("a11_uniqueness", per_column_sql(ALL_GAPS, "count(DISTINCT {c}) AS distinct_count, round(count(DISTINCT {c}) / count(*)::DOUBLE, 6) AS uniqueness_ratio", GAPS))
def a11(spark, d):
    return rounded(P.uniqueness(gaps(spark, d)))


@query("a12_value_counts", "SELECT p_brand AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 6) AS share FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def a12(spark, d):
    return rounded(P.value_counts(table(spark, d, "part"), "p_brand", 5))


@query("a12_value_counts_all", f"SELECT l_returnflag AS value, count(*) AS n, round(count(*) / (SELECT count(l_returnflag) FROM {GAPS})::DOUBLE, 6) AS share FROM {GAPS} WHERE l_returnflag IS NOT NULL GROUP BY 1")
def a12b(spark, d):
    return rounded(P.value_counts(gaps(spark, d), "l_returnflag"))


@query("a13_categorical_report", union_sql([f"""SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM part) AS distinct_count, {c} AS top_value, n AS top_count,
  CASE WHEN (SELECT count(DISTINCT {c}) FROM part) > 50 THEN 'high' WHEN (SELECT count(DISTINCT {c}) FROM part) > 10 THEN 'medium' ELSE 'low' END AS cardinality
  FROM (SELECT {c}, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, {c} LIMIT 1)""" for c in ("p_name", "p_brand", "p_type")]))
def a13(spark, d):
    return P.categorical_report(table(spark, d, "part"))


@query("a14_correlation_pairs", union_sql([f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM {GAPS}" for a, b in pairs(NUMBERS)]))
def a14(spark, d):
    return rounded(P.correlation_pairs(gaps(spark, d), NUMBERS))


@query("a15_target_correlation", per_column_sql(["l_quantity", "l_discount", "l_tax", "l_linenumber"], "round(abs(corr({c}, l_extendedprice)), 6) AS abs_correlation"))
def a15(spark, d):
    return rounded(P.target_correlation(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"]))


@query("a16_covariance_pairs", union_sql([f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(covar_samp({a}, {b}), 4) AS covariance, round(avg({a}), 4) AS mean_a FROM {GAPS} WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL"
                                          for a, b in [("l_quantity", "l_quantity"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_discount"), ("l_discount", "l_tax"), ("l_tax", "l_tax")]]))
def a16(spark, d):
    return rounded(P.covariance_pairs(gaps(spark, d), ["l_quantity", "l_discount", "l_tax"]), 4)


@query("a17_modes", union_sql([f"""SELECT '{c}' AS "column", m AS mode, n FROM (SELECT CAST({c} AS VARCHAR) AS m, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"""
                               for c in ("p_brand", "p_type", "p_retailprice")]))
def a17(spark, d):
    return P.modes(table(spark, d, "part"), ["p_brand", "p_type", "p_retailprice"])


@query("a18_histogram", """WITH b AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM orders),
  c AS (SELECT CAST(least(floor((o_totalprice - lo) / w), 29) AS BIGINT) AS bin, count(*) AS n FROM orders, b GROUP BY 1)
  SELECT g.i AS bin, round(lo + g.i * w, 4) AS low, round(lo + (g.i + 1) * w, 4) AS high, coalesce(c.n, 0) AS n FROM range(30) g(i) CROSS JOIN b LEFT JOIN c ON c.bin = g.i""")
def a18(spark, d):
    return rounded(P.histogram(table(spark, d, "orders"), "o_totalprice"), 4)


@query("a19_box_stats", """WITH q AS (SELECT l_returnflag AS category, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS median,
    quantile_cont(l_extendedprice, 0.75) AS q75 FROM lineitem GROUP BY 1)
  SELECT category, count(*) AS n, round(max(q25), 4) AS q25, round(max(median), 4) AS median, round(max(q75), 4) AS q75,
    min(l_extendedprice) FILTER (l_extendedprice >= q25 - 1.5 * (q75 - q25) AND l_extendedprice <= q75 + 1.5 * (q75 - q25)) AS whisker_low,
    max(l_extendedprice) FILTER (l_extendedprice >= q25 - 1.5 * (q75 - q25) AND l_extendedprice <= q75 + 1.5 * (q75 - q25)) AS whisker_high,
    count(*) FILTER (l_extendedprice < q25 - 1.5 * (q75 - q25) OR l_extendedprice > q75 + 1.5 * (q75 - q25)) AS outliers
  FROM lineitem JOIN q ON l_returnflag = category GROUP BY category""")
def a19(spark, d):
    return rounded(P.box_stats(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"), 4)


@query("a19_box_stats_whole", """WITH q AS (SELECT quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75 FROM events)
  SELECT 'all' AS category, count(*) AS n, round(max(q25), 4) AS q25, round(max(median), 4) AS median, round(max(q75), 4) AS q75,
    min(value) FILTER (value BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_low,
    max(value) FILTER (value BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_high,
    count(*) FILTER (value NOT BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS outliers FROM events, q""")
def a19b(spark, d):
    return rounded(P.box_stats(table(spark, d, "events"), "value"), 4)


@query("a20_scatter_points", "SELECT o_custkey AS x, o_totalprice AS y FROM orders ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey LIMIT 5000")
def a20(spark, d):
    return P.scatter_points(table(spark, d, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"])


@query("a21_kernel_density", """WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, stddev_samp(c_acctbal) * pow(count(*), -0.2) AS h FROM customer),
  g AS (SELECT lo + (hi - lo) * i / 99.0 AS x, h FROM range(100) t(i), s)
  SELECT round(x, 4) AS x, round(avg(exp(-0.5 * ((x - c_acctbal) / h) * ((x - c_acctbal) / h))) / (max(h) * sqrt(2 * pi())), 10) AS density FROM g, customer GROUP BY x""")
def a21(spark, d):
    out = P.kernel_density(table(spark, d, "customer"), "c_acctbal")
    return out.select(F.round("x", 4).alias("x"), F.round("density", 10).alias("density"))


@query("a22_duplicate_rows", f"""SELECT sum(n)::BIGINT AS n_rows, (sum(n) - count(*))::BIGINT AS duplicate_rows, round((sum(n) - count(*)) * 100.0 / sum(n), 6) AS duplicate_pct
  FROM (SELECT count(*) AS n FROM {REPEATS} GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)""")
def a22(spark, d):
    return rounded(P.duplicate_rows(repeats(spark, d)))


@query("a23_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def a23(spark, d):
    return P.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


ROW_SHARE = "(" + " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in ALL_GAPS) + ") / 11.0::DOUBLE"


@query("a24_row_null_density", f"""SELECT round(avg(s), 6) AS mean_density, round(stddev_samp(s), 6) AS std_density, round(max(s), 6) AS max_density,
  count(*) FILTER (s > 0.3) AS rows_over_limit FROM (SELECT {ROW_SHARE} AS s FROM {GAPS})""")
def a24(spark, d):
    return rounded(P.row_null_density(gaps(spark, d)))


NARROW = "(" + " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in ("l_quantity", "l_discount", "l_returnflag", "l_tax")) + ") / 4.0::DOUBLE"


@query("a25_row_missing_buckets", f"""SELECT CASE WHEN s = 0 THEN '0%' WHEN s <= 0.25 THEN '1-25%' WHEN s <= 0.5 THEN '26-50%' WHEN s <= 0.75 THEN '51-75%' ELSE '76-100%' END AS bucket,
  count(*) AS n, count(*) FILTER (s > 0.5) AS rows_over_half FROM (SELECT {NARROW} AS s FROM {GAPS}) GROUP BY 1""")
def a25(spark, d):
    return P.row_missing_buckets(gaps(spark, d).select("l_quantity", "l_discount", "l_returnflag", "l_tax"))


@query("a26_group_means", "SELECT c_mktsegment, round(avg(c_acctbal), 6) AS group_mean, count(c_acctbal) AS n FROM customer GROUP BY 1")
def a26(spark, d):
    return rounded(P.group_means(table(spark, d, "customer"), "c_mktsegment", "c_acctbal"))
