"""Queries over quality checks and drift."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallyglass.operators import quality as Q
from tallyglass.plans.catalog import query, rounded, union_sql
from tallyglass.plans.inputs import AFTER, AS_OF, AS_OF_SQL, BEFORE, GAPS, REPEATS, before_after, gaps, repeats, table
from tallyglass.plans.missing_queries import RULES
from tallyglass.plans.profile_queries import ALL_GAPS, per_column_sql, DESCRIBE


@query("q01_check_missing", per_column_sql(ALL_GAPS, "round(count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE, 6) AS missing_share, 0.15::DOUBLE AS threshold, count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE > 0.15 AS exceeded", GAPS))
def q01(spark, d):
    return rounded(Q.check_missing(gaps(spark, d), 0.15))


@query("q02_check_duplicates", f"""WITH r AS (SELECT * FROM {REPEATS}), g AS (SELECT count(*) AS n FROM r GROUP BY ALL), k AS (SELECT count(*) AS k FROM (SELECT o_custkey, o_orderdate FROM r GROUP BY 1, 2 HAVING count(*) > 1))
  SELECT sum(n)::BIGINT AS n_rows, (sum(n) - count(*))::BIGINT AS duplicate_rows, round((sum(n) - count(*)) * 100.0 / sum(n), 6) AS duplicate_pct, max(k) AS duplicate_key_values,
  'remove duplicate rows' AS advice FROM (SELECT count(*) AS n FROM r GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority), k""")
def q02(spark, d):
    return rounded(Q.check_duplicates(repeats(spark, d), ["o_custkey", "o_orderdate"]))


@query("q03_check_leakage", per_column_sql(["l_quantity", "leak"], "round(abs(corr({c}, l_extendedprice)), 6) AS abs_correlation, abs(corr({c}, l_extendedprice)) > 0.95 AS suspicious",
                                           "(SELECT *, l_extendedprice * 2 + l_quantity AS leak FROM lineitem)"))
def q03(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") * 2 + F.col("l_quantity")).alias("leak"))
    return rounded(Q.check_leakage(li, "l_extendedprice"))


def shift_sql(c):
    return f"""SELECT '{c}' AS "column", round(r, 4) AS reference_mean, round(x, 4) AS current_mean, round(CASE WHEN r = 0 THEN 0 ELSE abs(x - r) / abs(r) END, 6) AS shift,
      CASE WHEN r = 0 THEN 0 ELSE abs(x - r) / abs(r) END > 0.1 AS drifted FROM (SELECT avg({c}) AS r FROM {BEFORE}) CROSS JOIN (SELECT avg({c}) AS x FROM {AFTER})"""


@query("q04_mean_shift", union_sql([shift_sql("o_totalprice"), shift_sql("o_custkey")]))
def q04(spark, d):
    a, b = before_after(spark, d)
    out = Q.mean_shift(b, a, ["o_totalprice", "o_custkey"])
    return out.withColumns({"reference_mean": F.round("reference_mean", 4), "current_mean": F.round("current_mean", 4), "shift": F.round("shift", 6)})


def cdf_sql(c, a=BEFORE, b=AFTER, shift=""):
    return f"""SELECT '{c}' AS "column", round(max(abs(f - g)), 6) AS ks, round(sum(abs(f - g) * coalesce(nxt - v, 0)) / (SELECT stddev_samp({c}) FROM {a}), 6) AS wasserstein FROM (
      SELECT v, lead(v) OVER (ORDER BY v) AS nxt, sum(r) OVER (ORDER BY v) / (sum(r) OVER ())::DOUBLE AS f, sum(x) OVER (ORDER BY v) / (sum(x) OVER ())::DOUBLE AS g FROM (
        SELECT v, sum(r) AS r, sum(x) AS x FROM (SELECT {c}::DOUBLE AS v, 1 AS r, 0 AS x FROM {a} UNION ALL SELECT ({c}{shift})::DOUBLE, 0, 1 FROM {b}) GROUP BY v))"""


@query("q05_numeric_drift", union_sql([cdf_sql("o_totalprice", shift=" * 1.2"), cdf_sql("o_custkey")]))
def q05(spark, d):
    a, b = before_after(spark, d)
    b = b.withColumn("o_totalprice", F.col("o_totalprice") * 1.2)
    return rounded(Q.numeric_drift(b, a, ["o_totalprice", "o_custkey"]).select("column", "ks", "wasserstein"))


def shares_sql(c):
    return f"""SELECT coalesce(a.v, b.v) AS v, coalesce(a.n, 0) AS r, coalesce(b.n, 0) AS x, (SELECT count(*) FROM {BEFORE})::DOUBLE AS nr, (SELECT count(*) FROM {AFTER})::DOUBLE AS nx
      FROM (SELECT {c} AS v, count(*) AS n FROM {BEFORE} GROUP BY 1) a FULL JOIN (SELECT {c} AS v, count(*) AS n FROM {AFTER} GROUP BY 1) b ON a.v = b.v"""


PSI = "sum((greatest(x / nx, 1e-4) - greatest(r / nr, 1e-4)) * ln(greatest(x / nx, 1e-4) / greatest(r / nr, 1e-4)))"
HALF = "CASE WHEN {x} > 0 THEN {x} * log2({x} / ((r / nr + x / nx) / 2)) ELSE 0 END"
JS = f"sqrt(greatest(sum({HALF.format(x='(r / nr)')} + {HALF.format(x='(x / nx)')}) / 2, 0))"
CHI2 = "coalesce(sum((x - r / nr * nx) * (x - r / nr * nx) / (r / nr * nx)) FILTER (r > 0), 0)"


@query("q05_categorical_drift", union_sql([f"""SELECT '{c}' AS "column", round({PSI}, 6) AS psi, round({JS}, 6) AS js_distance, round({CHI2}, 6) AS chi2, count(*) FILTER (r > 0) - 1 AS dof FROM ({shares_sql(c)})"""
                                           for c in ("o_orderstatus", "o_orderpriority")]))
def q05b(spark, d):
    a, b = before_after(spark, d)
    return rounded(Q.categorical_drift(b, a, ["o_orderstatus", "o_orderpriority"]).select("column", "psi", "js_distance", "chi2", "dof"))


@query("q05_dataset_drift", f"""WITH n AS ({union_sql([cdf_sql("o_totalprice", shift=" * 1.2"), cdf_sql("o_custkey")])}), c AS (SELECT {JS} AS js FROM ({shares_sql("o_orderstatus")})),
  f AS (SELECT wasserstein >= 0.1 AS f FROM n UNION ALL SELECT js >= 0.1 FROM c)
  SELECT count(*) AS n_columns, count(*) FILTER (f) AS drifted_columns, round(count(*) FILTER (f) / count(*)::DOUBLE, 6) AS drift_share, count(*) FILTER (f) / count(*)::DOUBLE >= 0.5 AS dataset_drift FROM f""")
def q05c(spark, d):
    a, b = before_after(spark, d)
    b = b.withColumn("o_totalprice", F.col("o_totalprice") * 1.2)
    return rounded(Q.dataset_drift(Q.drift_report(b, a, ["o_totalprice", "o_custkey"], ["o_orderstatus"])))


REPORT_SQL = f"""WITH n AS ({union_sql([cdf_sql("o_totalprice"), cdf_sql("o_custkey")])}),
  c AS ({union_sql([f"""SELECT '{c}' AS "column", {JS} AS js FROM ({shares_sql(c)})""" for c in ("o_orderstatus", "o_orderpriority")])})
  SELECT "column", 'numeric' AS kind, wasserstein AS statistic, wasserstein >= 0.1 AS drifted FROM n UNION ALL SELECT "column", 'categorical', round(js, 6), js >= 0.1 FROM c"""


@query("q05_drift_report", REPORT_SQL)
def q05d(spark, d):
    a, b = before_after(spark, d)
    return rounded(Q.drift_report(b, a, ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"]).drop("p_value"))


# p-values as a rule, with clear differences: prices raised by a fifth, and every status turned to 'F'
@query("q05_drift_by_p_value", """SELECT unnest(['o_totalprice', 'o_custkey', 'o_orderstatus']) AS "column", unnest([true, false, true]) AS drifted WHERE (SELECT count(*) FROM orders) > 0""")
def q05e(spark, d):
    o = table(spark, d, "orders").select("o_totalprice", "o_custkey", "o_orderstatus")
    changed = o.withColumns({"o_totalprice": F.col("o_totalprice") * 1.5, "o_orderstatus": F.lit("F")})
    return Q.drift_report(changed, o, ["o_totalprice", "o_custkey"], ["o_orderstatus"], rule="p_value").select("column", "drifted")


@query("q06_psi", union_sql([f"""SELECT '{c}' AS "column", round({PSI}, 6) AS psi, {PSI} > 0.25 AS drifted FROM ({shares_sql(c)})""" for c in ("o_orderstatus", "o_orderpriority")]))
def q06(spark, d):
    a, b = before_after(spark, d)
    return rounded(Q.psi(b, a, ["o_orderstatus", "o_orderpriority"]))


@query("q07_target_drift", f"""SELECT 'o_orderstatus' AS "column", 'categorical' AS kind, round({JS}, 6) AS statistic, {JS} >= 0.1 AS drifted FROM ({shares_sql("o_orderstatus")})""")
def q07(spark, d):
    a, b = before_after(spark, d)
    return rounded(Q.target_drift(b, a, "o_orderstatus").drop("p_value"))


@query("q07_numeric_target_drift", f"""SELECT "column", 'numeric' AS kind, wasserstein AS statistic, wasserstein >= 0.1 AS drifted FROM ({cdf_sql("o_totalprice", shift=" * 1.2")})""")
def q07b(spark, d):
    a, b = before_after(spark, d)
    return rounded(Q.target_drift(b.withColumn("o_totalprice", F.col("o_totalprice") * 1.2), a, "o_totalprice").drop("p_value"))


@query("q08_failed_share", f"""WITH t AS ({per_column_sql(ALL_GAPS, "count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE <= 0.1 AS passed", GAPS)})
  SELECT count(*) AS tests, count(*) FILTER (NOT passed) AS failed, round(count(*) FILTER (NOT passed) / count(*)::DOUBLE, 6) AS failure_rate FROM t""")
def q08(spark, d):
    return rounded(Q.failed_share(Q.check_missing(gaps(spark, d), 0.1).withColumn("passed", ~F.col("exceeded"))))


@query("q09_check_freshness", f"""SELECT round(epoch({AS_OF_SQL} - max(l_shipdate)) / 3600.0, 6) AS age_hours, round(epoch(max(l_shipdate) - min(l_shipdate)) / 3600.0, 6) AS span_hours,
  epoch({AS_OF_SQL} - max(l_shipdate)) / 3600.0 <= 24 AS is_fresh FROM lineitem""")
def q09(spark, d):
    return rounded(Q.check_freshness(table(spark, d, "lineitem"), "l_shipdate", AS_OF).select("age_hours", "span_hours", "is_fresh"))


@query("q10_check_balance", """WITH c AS (SELECT CAST(toxic AS VARCHAR) AS class, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM labels) AS pct FROM labels GROUP BY 1)
  SELECT class, n, round(pct, 6) AS pct, round((SELECT min(pct) FROM c), 6) AS min_pct, round((SELECT max(pct) FROM c), 6) AS max_pct, (SELECT min(pct) FROM c) > 5 AS balanced FROM c""")
def q10(spark, d):
    return rounded(Q.check_balance(table(spark, d, "labels"), "toxic"))


EXPECTED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("q11_quality_report", f"""WITH r AS (SELECT * FROM {REPEATS}), g AS (SELECT count(*) - count(DISTINCT (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)) AS n FROM r),
  c AS (SELECT 'schema' AS "check", true AS passed, '' AS detail UNION ALL SELECT 'missing', true, '' UNION ALL SELECT 'duplicates', n = 0, n::VARCHAR FROM g
    UNION ALL SELECT 'distributions', true, '' FROM (SELECT count(*) FROM r))
  SELECT "check", passed, detail, (SELECT avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) * 100 FROM c) AS score FROM c""")
def q11(spark, d):
    return Q.quality_report(repeats(spark, d), EXPECTED, numeric=["o_custkey", "o_totalprice"])


def report_sql(c):
    wide = f"SELECT {DESCRIBE.format(c=c)}, round(skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1)), 6) AS skewness, round(kurtosis_pop({c}), 6) AS kurtosis FROM {GAPS}"
    names = ["n", "mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis"]
    return union_sql([f"""SELECT '{c}' AS "column", '{s}' AS statistic, {s}::DOUBLE AS value FROM ({wide})""" for s in names])


BASIC = {"null_count": "count(*) FILTER ({c} IS NULL)::DOUBLE", "null_pct": "round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 3)",
         "distinct_count": "count(DISTINCT {c})::DOUBLE", "uniqueness_ratio": "round(count(DISTINCT {c}) / count(*)::DOUBLE, 6)"}


@query("q12_summary_report", union_sql([f"""SELECT '{c}' AS "column", '{s}' AS statistic, {e.format(c=c)} AS value FROM {GAPS}""" for c in ("l_quantity", "l_tax", "l_returnflag") for s, e in BASIC.items()]
                                       + [report_sql("l_quantity"), report_sql("l_tax")]))
def q12(spark, d):
    return rounded(Q.summary_report(gaps(spark, d).select("l_quantity", "l_tax", "l_returnflag")))


@query("q13_check_ranges", """SELECT 'l_quantity' AS "column", count(*) FILTER (l_quantity < 2) AS below, count(*) FILTER (l_quantity > 49) AS above, count(*) FILTER (l_quantity < 2 OR l_quantity > 49) = 0 AS passed FROM lineitem
  UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax < 0), count(*) FILTER (l_tax > 1), count(*) FILTER (l_tax < 0 OR l_tax > 1) = 0 FROM lineitem""")
def q13(spark, d):
    return Q.check_ranges(table(spark, d, "lineitem"), {"l_quantity": (2.0, 49.0), "l_tax": (0.0, 1.0)})


@query("q13_check_quantiles", """SELECT 'o_totalprice' AS "column", 0.5::DOUBLE AS probability, round(median(o_totalprice), 4) AS value, median(o_totalprice) BETWEEN 100000 AND 200000 AS passed FROM orders
  UNION ALL SELECT 'o_custkey', 0.9::DOUBLE, round(quantile_cont(o_custkey, 0.9), 4), quantile_cont(o_custkey, 0.9) BETWEEN 1 AND 100000000 FROM orders""")
def q13b(spark, d):
    return rounded(Q.check_quantiles(table(spark, d, "orders"), {"o_totalprice": (0.5, 1e5, 2e5), "o_custkey": (0.9, 1.0, 1e8)}), 4)


@query("q14_rows_out_of_period", """SELECT count(*) AS n_rows, count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate > TIMESTAMP '2001-01-01') AS out_of_period,
  count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate > TIMESTAMP '2001-01-01') = 0 AS passed FROM orders""")
def q14(spark, d):
    return Q.rows_out_of_period(table(spark, d, "orders"), "o_orderdate", datetime(1996, 1, 1), datetime(2001, 1, 1))


COMPLETE = "1 - round((" + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in ALL_GAPS) + ") * 100.0 / (count(*) * 11), 3) / 100"
# of the seven rule checks: the enum and the range ends decide validity; counts of exceeded rules decide consistency
Q16 = f"""WITH s AS (SELECT {COMPLETE} AS completeness, count(*) AS n, count(l_orderkey) - count(DISTINCT l_orderkey) AS v1, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS v2,
    count(*) FILTER (l_returnflag IS NULL) / count(*)::DOUBLE AS v3, count(*) FILTER (l_quantity IS NULL) / count(*)::DOUBLE AS v4, count(*) FILTER (l_quantity < 5) AS v5, count(*) FILTER (l_quantity > 45) AS v6,
    count(DISTINCT (l_orderkey, l_linenumber)) / count(*)::DOUBLE AS uniqueness FROM {GAPS}),
  t AS (SELECT completeness, ((v1 <= 0)::INTEGER + (v2 <= 0)::INTEGER + (v3 <= 0.05)::INTEGER + (v4 <= 0.2)::INTEGER + (v5 <= 0)::INTEGER + (v6 <= 0)::INTEGER) / 7.0::DOUBLE AS consistency,
    1 - (v2 + v5 + v6) / (n * 3)::DOUBLE AS validity, uniqueness FROM s)
  SELECT round(completeness, 6) AS completeness, round(consistency, 6) AS consistency, round(validity, 6) AS validity, round(uniqueness, 6) AS uniqueness,
    round((0.3 * completeness + 0.2 * consistency + 0.3 * validity + 0.2 * uniqueness) * 100, 4) AS score FROM t"""


@query("q16_weighted_score", Q16)
def q16(spark, d):
    out = rounded(Q.weighted_score(gaps(spark, d), RULES, ["l_orderkey", "l_linenumber"]))
    return out.withColumn("score", F.round("score", 4))
