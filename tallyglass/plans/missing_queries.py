"""Queries over missing data, imputation, schema inference and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.operators import imputation as I, missing as M, schema as S
from tallyglass.plans.catalog import query, rounded, union_sql
from tallyglass.plans.inputs import GAPS, PARTS, gaps, parts, table
from tallyglass.plans.profile_queries import ALL_GAPS, per_column_sql

FOUR = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
BITS = " || ".join(f"(CASE WHEN {c} IS NULL THEN '1' ELSE '0' END)" for c in FOUR)
HOLES = ["l_quantity", "l_discount", "l_returnflag"]
HOLE_PAIRS = [("l_quantity", "l_discount"), ("l_quantity", "l_returnflag"), ("l_discount", "l_returnflag")]
M01 = lambda c: f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"


@query("m01_missing_patterns", f"SELECT {BITS} AS pattern, count(*) AS n FROM {GAPS} GROUP BY 1")
def m01(spark, d):
    return M.missing_patterns(gaps(spark, d), FOUR)


@query("m02_missing_correlation", union_sql([f"""SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({M01(a)}, {M01(b)}), 6) AS correlation,
  abs(corr({M01(a)}, {M01(b)})) > 0.7 AS systematic FROM {GAPS}""" for a, b in HOLE_PAIRS]))
def m02(spark, d):
    return rounded(M.missing_correlation(gaps(spark, d)))


def chi2_sql(a, b):
    n, x, y, both = "count(*)::DOUBLE", f"sum({M01(a)})::DOUBLE", f"sum({M01(b)})::DOUBLE", f"sum({M01(a)} * {M01(b)})::DOUBLE"
    return f"""SELECT '{a}' AS column_a, '{b}' AS column_b, round({n} * pow({both} * {n} - {x} * {y}, 2) / ({x} * {y} * ({n} - {x}) * ({n} - {y})), 6) AS chi2 FROM {GAPS}"""


@query("m03_missing_independence", union_sql([chi2_sql(a, b) for a, b in HOLE_PAIRS]))
def m03(spark, d):
    return rounded(M.missing_independence(gaps(spark, d), HOLES).select("column_a", "column_b", "chi2"))


@query("m03_missing_mechanism_p_values")
def m03b(spark, d):
    return M.missing_independence(gaps(spark, d), HOLES)


MEAN_OF = lambda cols: "(" + " + ".join(f"coalesce({c}, 0)" for c in cols) + ") / (" + " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in cols) + ")::DOUBLE"


@query("m04_missing_mechanism", f"""WITH t AS (SELECT * FROM {GAPS}), s AS (SELECT
    sum({M01('l_quantity')}) / count(*)::DOUBLE AS a, sum({M01('l_discount')}) / count(*)::DOUBLE AS b,
    abs(corr({M01('l_quantity')}, {MEAN_OF(['l_extendedprice', 'l_discount', 'l_tax'])})) AS ra,
    abs(corr({M01('l_discount')}, {MEAN_OF(['l_quantity', 'l_extendedprice', 'l_tax'])})) AS rb FROM t),
  u AS (SELECT stddev_samp(v) AS sd FROM (SELECT a AS v FROM s UNION ALL SELECT b FROM s UNION ALL SELECT 0 FROM range(2)))
  SELECT round(sd, 6) AS share_std, round((ra + rb) / 2, 6) AS mean_abs_correlation,
    CASE WHEN sd < 0.1 THEN 'MCAR' WHEN (ra + rb) / 2 > 0.1 THEN 'MAR' ELSE 'MNAR' END AS pattern FROM s, u""")
def m04(spark, d):
    return rounded(M.missing_mechanism(gaps(spark, d).select("l_quantity", "l_extendedprice", "l_discount", "l_tax")))


@query("m05_missing_candidates", f"""SELECT "column", null_pct, CASE WHEN null_pct > 50 THEN 'drop' ELSE 'impute' END AS action FROM (
  {per_column_sql(ALL_GAPS, "round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 3) AS null_pct", GAPS)}) WHERE null_pct > 10""")
def m05(spark, d):
    return M.missing_candidates(gaps(spark, d))


@query("m06_imputation_plan", f"""SELECT 'l_quantity' AS "column", CASE WHEN abs(skewness(l_quantity)) > 1 THEN 'median' ELSE 'mean' END AS method,
    round(CASE WHEN abs(skewness(l_quantity)) > 1 THEN median(l_quantity) ELSE avg(l_quantity) END, 3)::VARCHAR AS value FROM {GAPS}
  UNION ALL SELECT 'l_discount', CASE WHEN abs(skewness(l_discount)) > 1 THEN 'median' ELSE 'mean' END,
    round(CASE WHEN abs(skewness(l_discount)) > 1 THEN median(l_discount) ELSE avg(l_discount) END, 3)::VARCHAR FROM {GAPS}
  UNION ALL SELECT 'l_returnflag', 'mode', (SELECT l_returnflag FROM {GAPS} WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
def m06(spark, d):
    return M.imputation_plan(gaps(spark, d))


RATE = "round((" + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in ALL_GAPS) + ") * 100.0 / (count(*) * 11), 3)"


@query("m07_completeness_score", f"""SELECT round(100 - r, 2) AS quality_score, CASE WHEN r < 5 THEN 'low' WHEN r < 20 THEN 'medium' ELSE 'high' END AS impact,
  (100 - r < 95)::INTEGER + (100 - r < 80)::INTEGER + (100 - r < 60)::INTEGER AS limits_missed FROM (SELECT {RATE} AS r FROM {GAPS})""")
def m07(spark, d):
    return M.completeness_score(gaps(spark, d))


IMPUTED = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"]
MODE = f"(SELECT l_returnflag FROM {GAPS} WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("m08_impute_simple", f"""SELECT l_orderkey, l_partkey, l_linenumber, round(coalesce(l_quantity, (SELECT median(l_quantity) FROM {GAPS})), 6) AS l_quantity,
  round(coalesce(l_discount, (SELECT median(l_discount) FROM {GAPS})), 6) AS l_discount, coalesce(l_returnflag, {MODE}) AS l_returnflag FROM {GAPS}""")
def m08(spark, d):
    return rounded(I.impute_simple(gaps(spark, d).select(*IMPUTED)))


@query("m08_impute_mean", f"""SELECT l_orderkey, l_partkey, l_linenumber, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM {GAPS})), 5) AS l_quantity,
  round(coalesce(l_discount, (SELECT avg(l_discount) FROM {GAPS})), 5) AS l_discount FROM {GAPS}""")
def m08b(spark, d):
    return rounded(I.impute_simple(gaps(spark, d).select(*IMPUTED[:-1]), "mean", cols=["l_quantity", "l_discount"]), 5)


@query("m08_impute_constant", f"SELECT l_orderkey, l_partkey, l_linenumber, coalesce(l_returnflag, 'unknown') AS l_returnflag FROM {GAPS}")
def m08c(spark, d):
    return I.impute_simple(gaps(spark, d).select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"), "constant", "unknown")


@query("m08_impute_zero", f"SELECT l_orderkey, l_partkey, l_linenumber, coalesce(l_quantity, 0) AS l_quantity FROM {GAPS}")
def m08d(spark, d):
    return I.impute_simple(gaps(spark, d).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), "zero")


# part with planted nulls: size, price and brand number
PART_GAPS = f"""(SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END::DOUBLE AS p_size, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE brand_no END::DOUBLE AS brand_no FROM {PARTS})"""


def part_gaps(spark, d):
    p = parts(spark, d).select("p_partkey", *[F.col(c).cast("double").alias(c) for c in ("p_size", "p_retailprice", "brand_no")])
    return p.withColumns({"p_size": F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")),
                          "p_retailprice": F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice")),
                          "brand_no": F.when(F.col("p_partkey") % 13 != 0, F.col("brand_no"))})


def knn_fill_sql(c):
    shared = " + ".join(f"(CASE WHEN a.{x} IS NOT NULL AND b.{x} IS NOT NULL THEN 1 ELSE 0 END)" for x in ("p_size", "p_retailprice", "brand_no"))
    total = " + ".join(f"coalesce((a.{x} - b.{x}) * (a.{x} - b.{x}), 0)" for x in ("p_size", "p_retailprice", "brand_no"))
    return f"""SELECT p_partkey, avg(v) AS v FROM (SELECT a.p_partkey, b.{c} AS v, row_number() OVER (PARTITION BY a.p_partkey
      ORDER BY sqrt({total}) * sqrt(3.0::DOUBLE / ({shared})), b.p_partkey) AS r FROM g a JOIN g b ON a.{c} IS NULL AND b.{c} IS NOT NULL AND ({shared}) > 0) WHERE r <= 5 GROUP BY 1"""


@query("m09_impute_knn", f"""WITH g AS (SELECT * FROM {PART_GAPS}), s AS ({knn_fill_sql('p_size')}), p AS ({knn_fill_sql('p_retailprice')}), b AS ({knn_fill_sql('brand_no')})
  SELECT g.p_partkey, round(coalesce(g.p_size, s.v, (SELECT avg(p_size) FROM g)), 6) AS p_size, round(coalesce(g.p_retailprice, p.v, (SELECT avg(p_retailprice) FROM g)), 6) AS p_retailprice,
    round(coalesce(g.brand_no, b.v, (SELECT avg(brand_no) FROM g)), 6) AS brand_no
  FROM g LEFT JOIN s ON s.p_partkey = g.p_partkey LEFT JOIN p ON p.p_partkey = g.p_partkey LEFT JOIN b ON b.p_partkey = g.p_partkey""")
def m09(spark, d):
    return rounded(I.impute_knn(part_gaps(spark, d), "p_partkey", ["p_size", "p_retailprice", "brand_no"]))


def linear_gaps(spark, d):
    """orders-sized rows with a linear third column and planted nulls."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", F.col("l_tax").alias("tax"))
    rows = rows.withColumn("mixed", 2 * F.col("l_quantity") + 100 * F.col("tax") + 5)
    return rows.withColumns({"mixed": F.when(F.col("l_orderkey") % 5 != 0, F.col("mixed")), "tax": F.when(F.col("l_linenumber") != 3, F.col("tax"))})


@query("m10_impute_iterative")
def m10(spark, d):
    return I.impute_iterative(linear_gaps(spark, d), ["l_quantity", "tax", "mixed"])


# The shares of missing values differ little, so the mechanism is MCAR and the fill is the median.
@query("m11_impute_auto", f"""WITH g AS (SELECT * FROM {PART_GAPS}) SELECT p_partkey, round(coalesce(p_size, (SELECT median(p_size) FROM g)), 6) AS p_size,
  round(coalesce(p_retailprice, (SELECT median(p_retailprice) FROM g)), 6) AS p_retailprice, round(coalesce(brand_no, (SELECT median(brand_no) FROM g)), 6) AS brand_no FROM g""")
def m11(spark, d):
    return rounded(I.impute_auto(part_gaps(spark, d), "p_partkey", ["p_size", "p_retailprice", "brand_no"]))


@query("m12_imputation_check", f"""SELECT count(*) AS n_rows, count(*) FILTER (l_quantity IS NULL) + count(*) FILTER (l_returnflag IS NULL) AS nulls,
  round((count(*) FILTER (l_quantity IS NULL) + count(*) FILTER (l_returnflag IS NULL)) * 100.0 / (count(*) * 4), 6) AS null_pct,
  count(*) FILTER (l_tax > 0.075) AS infinite_values, count(*) FILTER (l_returnflag IS NULL) AS target_nulls FROM {GAPS}""")
def m12(spark, d):
    g = gaps(spark, d).select("l_orderkey", "l_quantity", "l_returnflag", F.when(F.col("l_tax") > 0.075, float("inf")).otherwise(F.col("l_tax")).alias("l_tax"))
    return rounded(M.imputation_check(g, "l_returnflag"))


@query("m13_critical_columns", f"""SELECT 'flag' AS "column", count(*) FILTER (l_linenumber < 4) AS null_count, round(count(*) FILTER (l_linenumber < 4) * 100.0 / count(*), 3) AS null_pct FROM {GAPS}""")
def m13(spark, d):
    return M.critical_columns(gaps(spark, d).withColumn("flag", F.when(F.col("l_linenumber") >= 4, F.col("l_linestatus"))))


@query("m14_drop_sparse", f"SELECT l_quantity, l_discount, l_returnflag FROM {GAPS} WHERE {M01('l_quantity')} + {M01('l_discount')} + {M01('l_returnflag')} <= 1")
def m14(spark, d):
    g = gaps(spark, d).select("l_quantity", "l_discount", "l_returnflag", F.when(F.col("l_linenumber") == 1, F.col("l_tax")).alias("mostly_null"))
    return M.drop_sparse(g)


# ---- schema inference and contracts ----

# Derived text columns; the same expressions run in both engines.
TEXTS = {
    "id_text": "concat('C', lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0'))",
    "email": "concat('user', CAST(c_custkey AS VARCHAR(20)), '@example.com')",
    "website": "concat('https://example.com/', CAST(c_custkey AS VARCHAR(20)))",
    "phone": "concat('+1-555-', lpad(CAST(c_custkey % 10000 AS VARCHAR(20)), 4, '0'))",
    "us_date": "concat(lpad(CAST(1 + c_custkey % 12 AS VARCHAR(20)), 2, '0'), '/', lpad(CAST(1 + c_custkey % 28 AS VARCHAR(20)), 2, '0'), '/', CAST(1950 + c_custkey % 70 AS VARCHAR(20)))",
    "iso_date": "concat(CAST(1000 + c_custkey AS VARCHAR(20)), '-', lpad(CAST(1 + c_custkey % 12 AS VARCHAR(20)), 2, '0'), '-', lpad(CAST(1 + c_custkey % 28 AS VARCHAR(20)), 2, '0'))",
    "uuid_text": "concat(substr(md5(c_name), 1, 8), '-', substr(md5(c_name), 9, 4), '-4', substr(md5(c_name), 13, 3), '-a', substr(md5(c_name), 16, 3), '-', substr(md5(c_name), 19, 12))",
    "number_text": "CAST(c_custkey * 10 AS VARCHAR(20))",
    "segment": "c_mktsegment",
}
TEXT_TABLE = "(SELECT c_custkey, " + ", ".join(f"{e} AS {n}" for n, e in TEXTS.items()) + " FROM customer)"


def texts(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey", *[f"{e} AS {n}".replace("VARCHAR(20)", "STRING") for n, e in TEXTS.items()])


AS_TIME = "coalesce(CASE WHEN regexp_matches({c}, '^\\s*\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_cast({c} AS TIMESTAMP) END, try_strptime({c}, '%m/%d/%Y'), try_strptime({c}, '%d-%m-%Y'))"


def infer_sql(c):
    t = AS_TIME.format(c=c)
    return f"""SELECT "column", kind AS inferred_type, CASE kind WHEN 'datetime' THEN 0.9 WHEN 'categorical' THEN 0.9 WHEN 'numeric' THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence,
      kind = 'string' AS needs_review, false AS nullable, distinct_count FROM (SELECT '{c}' AS "column", CASE WHEN count({t}) = count({c}) THEN 'datetime' WHEN count(try_cast({c} AS DOUBLE)) = count({c}) THEN 'numeric'
      WHEN count(DISTINCT {c}) / count({c})::DOUBLE < 0.1 THEN 'categorical' ELSE 'string' END AS kind, count(DISTINCT {c}) AS distinct_count FROM {TEXT_TABLE})"""


@query("i01_infer_types", union_sql([infer_sql(c) for c in TEXTS] + [
    f"""SELECT 'c_custkey', 'numeric', 1.0::DOUBLE, false, false, count(DISTINCT c_custkey) FROM customer"""]))
def i01(spark, d):
    return S.infer_types(texts(spark, d))


@query("i02_precision_scale", """SELECT 'l_orderkey' AS "column", max(length(l_orderkey::VARCHAR))::BIGINT AS precision, 0::BIGINT AS scale FROM lineitem
  UNION ALL SELECT 'l_extendedprice', max(length(replace(t, '.', '')))::BIGINT, max(length(regexp_extract(t, '\\.(\\d+)$', 1)))::BIGINT FROM (
    SELECT regexp_replace(CAST(l_extendedprice AS VARCHAR), '\\.0$', '') AS t FROM lineitem)
  UNION ALL SELECT 'l_discount', max(length(replace(t, '.', '')))::BIGINT, max(length(regexp_extract(t, '\\.(\\d+)$', 1)))::BIGINT FROM (
    SELECT regexp_replace(CAST(l_discount AS VARCHAR), '\\.0$', '') AS t FROM lineitem)""")
def i02(spark, d):
    return S.precision_scale(table(spark, d, "lineitem"), ["l_orderkey", "l_extendedprice", "l_discount"])


# numbers far outside of what a decimal holds
@query("i02_precision_scale_extremes", """SELECT unnest(['huge', 'tiny', 'none']) AS "column", unnest([31, 17, 1])::BIGINT AS precision, unnest([0, 16, 0])::BIGINT AS scale WHERE (SELECT count(*) FROM lineitem) > 0""")
def i02b(spark, d):
    li = table(spark, d, "lineitem").select(F.lit(1e30).alias("huge"), F.when(F.col("l_linenumber") == 1, 1.5e-15).otherwise(0.25).alias("tiny"), F.lit(0.0).alias("none"))
    return S.precision_scale(li, ["huge", "tiny", "none"])


def id_sql(c, hint):
    return f"""SELECT '{c}' AS "column", round(u, 6) AS uniqueness_ratio, u >= 0.9 AND ({hint} OR u >= 0.95) AS is_id FROM (
      SELECT count(DISTINCT {c}) / count(*)::DOUBLE AS u, count(*) AS n, min({c}) AS lo, max({c}) AS hi FROM orders)"""


@query("i03_id_columns", union_sql([id_sql("o_orderkey", "(lo = 1 AND hi = n)"), id_sql("o_custkey", "(lo = 1 AND hi = n)"), id_sql("o_totalprice", "(lo = 1 AND hi = n)"),
                                    id_sql("o_orderstatus", "false"), id_sql("o_orderpriority", "false")]))
def i03(spark, d):
    return rounded(S.id_columns(table(spark, d, "orders").drop("o_orderdate")))


@query("i03_id_columns_by_name", union_sql([id_sql(c, "true" if "key" in c else "false") for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")]))
def i03b(spark, d):
    return rounded(S.id_columns_by_name(table(spark, d, "orders").drop("o_orderdate")))


@query("i04_datetime_strings", union_sql([f"""SELECT '{c}' AS "column", round(count({AS_TIME.format(c=c)}) / count({c})::DOUBLE, 6) AS parse_share,
  round(count(DISTINCT {c}) / count(*)::DOUBLE, 6) AS unique_ratio, count(DISTINCT {c}) / count(*)::DOUBLE > 0.5 AND count({AS_TIME.format(c=c)}) / count({c})::DOUBLE > 0.8 AS is_datetime
  FROM {TEXT_TABLE}""" for c in ("us_date", "iso_date", "email", "segment")]))
def i04(spark, d):
    return rounded(S.datetime_strings(texts(spark, d), ["us_date", "iso_date", "email", "segment"]))


def pattern_sql(c, source):
    branches = []
    for name, alternatives in S.PATTERNS:
        shares = " OR ".join("avg(CASE WHEN regexp_matches({c}, '{p}') THEN 1 ELSE 0 END) > 0.8".format(c=c, p=p.replace("'", "''")) for p in alternatives)
        branches.append(f"WHEN {shares} THEN '{name}'")
    return f"""SELECT '{c}' AS "column", CASE {' '.join(branches)} END AS pattern FROM {source}"""


@query("i05_detect_patterns", union_sql([pattern_sql(c, TEXT_TABLE) for c in TEXTS] + [pattern_sql("url", "pages"), pattern_sql("html", "pages")]))
def i05(spark, d):
    return S.detect_patterns(texts(spark, d)).unionByName(S.detect_patterns(table(spark, d, "pages"), ["url", "html"]))


@query("i06_max_lengths", """SELECT 'text' AS "column", max(length(text))::BIGINT AS max_length FROM documents UNION ALL SELECT 'lang', max(length(lang))::BIGINT FROM documents
  UNION ALL SELECT 'source', max(length(source))::BIGINT FROM documents""")
def i06(spark, d):
    return S.max_lengths(table(spark, d, "documents"))


@query("i07_sample_values", """SELECT 'l_returnflag' AS "column", array_to_string(list(v ORDER BY n DESC, v)[1:5], ',') AS samples FROM (SELECT l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 1)
  UNION ALL SELECT 'l_linenumber', array_to_string(list(v ORDER BY n DESC, v)[1:5], ',') FROM (SELECT l_linenumber::VARCHAR AS v, count(*) AS n FROM lineitem GROUP BY 1)""")
def i07(spark, d):
    return S.sample_values(table(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linenumber"]).select("column", F.array_join("samples", ",").alias("samples"))


@query("i07_sample_values_of_ids", """SELECT 'o_orderkey' AS "column", 'Range: ' || min(o_orderkey) || ' to ' || max(o_orderkey) AS samples FROM orders
  UNION ALL SELECT 'o_custkey', array_to_string(list_sort(list(CAST(o_custkey AS VARCHAR))), ',') FROM (
    SELECT o_custkey FROM orders ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')) LIMIT 5)""")
def i07b(spark, d):
    return S.sample_values(table(spark, d, "orders"), ["o_orderkey"], ["o_orderkey", "o_custkey"]).select("column", F.array_join("samples", ",").alias("samples"))


@query("i08_column_quality", union_sql([f"""SELECT '{c}' AS "column", round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 2) AS missing_pct,
  round((count(*) - count(DISTINCT {c})) * 100.0 / count(*), 2) AS duplicate_pct, round(count(DISTINCT {c}) / count(*)::DOUBLE, 3) AS uniqueness_ratio,
  count(DISTINCT {c}) / count(*)::DOUBLE >= 0.95 AS is_id FROM {GAPS}""" for c in ALL_GAPS]))
def i08(spark, d):
    return S.column_quality(gaps(spark, d))


def contract_sql():
    out = []
    for c in ("c_custkey", "email", "us_date", "segment"):
        number = c == "c_custkey"
        pattern = {"c_custkey": "NULL", "email": "'email'", "us_date": "'date'", "segment": "NULL"}[c]
        kind = {"c_custkey": "'number'", "us_date": f"CASE WHEN count(DISTINCT {c}) / count(*)::DOUBLE > 0.5 THEN 'datetime' ELSE 'string' END"}.get(c, "'string'")
        out.append(f"""SELECT '{c}' AS "column", {kind} AS type, false AS nullable, {'min(c_custkey)::DOUBLE' if number else 'NULL::DOUBLE'} AS min_value,
          {'max(c_custkey)::DOUBLE' if number else 'NULL::DOUBLE'} AS max_value, {'max(length(c_custkey::VARCHAR))::BIGINT' if number else 'NULL::BIGINT'} AS precision,
          {'0::BIGINT' if number else 'NULL::BIGINT'} AS scale, {'NULL::BIGINT' if number else f'max(length({c}))::BIGINT'} AS max_length, {pattern} AS pattern,
          count(DISTINCT {c}) / count(*)::DOUBLE >= 0.95 AS "unique", 0.0::DOUBLE AS missing_pct, round((count(*) - count(DISTINCT {c})) * 100.0 / count(*), 2) AS duplicate_pct,
          round(count(DISTINCT {c}) / count(*)::DOUBLE, 3) AS uniqueness_ratio, count(*) AS n_rows FROM {TEXT_TABLE}""")
    return union_sql(out)


CONTRACT_COLUMNS = ["c_custkey", "email", "us_date", "segment"]


def contract(spark, d):
    return S.infer_contract(texts(spark, d), CONTRACT_COLUMNS)


@query("i09_contract", contract_sql())
def i09(spark, d):
    return contract(spark, d)


@query("i09_contract_documents")
def i09b(spark, d):
    return S.contract_documents(contract(spark, d))


@query("i10_contract_summary", f"""SELECT max(n_rows) AS n_rows, count(*) AS n_columns, array_to_string(list("column" ORDER BY "column") FILTER ("unique"), ',') AS id_columns,
  array_to_string(list("column" ORDER BY "column") FILTER (uniqueness_ratio > 0.8), ',') AS high_cardinality_columns, '' AS columns_with_missing,
  array_to_string(list("column" ORDER BY "column") FILTER (pattern IS NOT NULL), ',') AS pattern_columns, round(100 - avg(missing_pct), 2) AS quality_score FROM ({contract_sql()})""")
def i10(spark, d):
    return S.contract_summary(contract(spark, d))


@query("i11_column_rules", f"""WITH c AS ({contract_sql()}) SELECT "column", 'unique' AS rule, round(uniqueness_ratio, 4) AS measured, 0.95::DOUBLE AS threshold FROM c WHERE "unique"
  UNION ALL SELECT "column", 'missing_pct', round(missing_pct, 4), 20 FROM c WHERE missing_pct > 20
  UNION ALL SELECT "column", 'duplicate_pct', round(duplicate_pct, 4), 10 FROM c WHERE duplicate_pct > 10
  UNION ALL SELECT "column", 'pattern_' || pattern, NULL, 0.8 FROM c WHERE pattern IS NOT NULL""")
def i11(spark, d):
    return rounded(S.column_rules(contract(spark, d)), 4)


@query("i12_schema_differences", """SELECT name AS "column", issue FROM (SELECT name, 'missing' AS issue FROM (SELECT unnest(['o_orderkey', 'o_totalprice', 'o_comment']) AS name
    EXCEPT SELECT column_name FROM (DESCRIBE SELECT * FROM orders))
  UNION ALL SELECT name, 'extra' FROM (SELECT column_name AS name FROM (DESCRIBE SELECT * FROM orders) EXCEPT SELECT unnest(['o_orderkey', 'o_totalprice', 'o_comment'])))""")
def i12(spark, d):
    return S.schema_differences(["o_orderkey", "o_totalprice", "o_comment"], table(spark, d, "orders"))


@query("i12_schema_check", "SELECT 'fail' AS status, 'o_comment' AS missing_columns, 'o_custkey,o_orderdate,o_orderpriority,o_orderstatus' AS extra_columns FROM (SELECT count(*) FROM orders)")
def i12b(spark, d):
    return S.schema_check(["o_orderkey", "o_totalprice", "o_comment"], table(spark, d, "orders"))


@query("i13_type_differences", """SELECT * FROM (VALUES ('c_custkey', 'bigint', 'string', 'type_mismatch'), ('c_name', 'string', 'string', 'ok'), ('c_nationkey', 'int', NULL, 'missing'),
  ('c_acctbal', 'double', 'double', 'ok'), ('c_mktsegment', 'string', 'string', 'ok'), ('added', NULL, 'int', 'extra')) t("column", baseline_type, current_type, issue) WHERE EXISTS (SELECT * FROM customer)""")
def i13(spark, d):
    c = table(spark, d, "customer")
    return S.type_differences(c, c.withColumn("c_custkey", F.col("c_custkey").cast("string")).drop("c_nationkey").withColumn("added", F.lit(1)))


RULES = {"l_orderkey": {"unique": True}, "l_returnflag": {"enum": ["A", "N"], "max_missing": 0.05}, "l_quantity": {"min": 5.0, "max": 45.0, "max_missing": 0.2}, "l_comment": {}}


@query("i14_enforce_contract", f"""SELECT "column", rule, violations, "limit", violations > "limit" AS exceeded FROM (
  SELECT 'l_orderkey' AS "column", 'unique' AS rule, (count(l_orderkey) - count(DISTINCT l_orderkey))::DOUBLE AS violations, 0.0::DOUBLE AS "limit" FROM {GAPS}
  UNION ALL SELECT 'l_returnflag', 'enum', count(*) FILTER (l_returnflag NOT IN ('A', 'N'))::DOUBLE, 0.0::DOUBLE FROM {GAPS}
  UNION ALL SELECT 'l_returnflag', 'max_missing', round(count(*) FILTER (l_returnflag IS NULL) / count(*)::DOUBLE, 6), 0.05::DOUBLE FROM {GAPS}
  UNION ALL SELECT 'l_quantity', 'max_missing', round(count(*) FILTER (l_quantity IS NULL) / count(*)::DOUBLE, 6), 0.2::DOUBLE FROM {GAPS}
  UNION ALL SELECT 'l_quantity', 'min', count(*) FILTER (l_quantity < 5)::DOUBLE, 0.0::DOUBLE FROM {GAPS} UNION ALL SELECT 'l_quantity', 'max', count(*) FILTER (l_quantity > 45)::DOUBLE, 0.0::DOUBLE FROM {GAPS}
  UNION ALL SELECT 'l_comment', 'present', 1.0::DOUBLE, 0.0::DOUBLE)""")
def i14(spark, d):
    return rounded(S.enforce_contract(gaps(spark, d), RULES))


@query("i14_contract_violations", f"SELECT l_orderkey, l_linenumber, l_partkey FROM {GAPS} WHERE l_returnflag = 'R' OR l_quantity < 5 OR l_quantity > 45")
def i14b(spark, d):
    return S.contract_violations(gaps(spark, d), RULES).select("l_orderkey", "l_linenumber", "l_partkey")
