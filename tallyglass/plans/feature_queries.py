"""Queries over outliers, transformations, encodings and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.operators import features as T, outliers as O
from tallyglass.operators.fitted import FittedSteps, Step, fit_steps
from tallyglass.operators.information import neighbour_information
from tallyglass.plans.catalog import query, rounded, union_sql
from tallyglass.plans.inputs import AFTER, BEFORE, GAPS, before_after, gaps, table, vectors
from tallyglass.plans.profile_queries import NUMBERS, per_column_sql
from tallyglass.session import fresh_path

# ---- outliers ----

EVENT_IQR = "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"


@query("o01_iqr_outliers", f"""SELECT 'value' AS "column", round(max(q1), 6) AS q25, round(max(q3), 6) AS q75, round(max(q1 - 1.5 * (q3 - q1)), 6) AS lower, round(max(q3 + 1.5 * (q3 - q1)), 6) AS upper,
  count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outlier_count,
  round(count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*), 6) AS outlier_pct FROM events, {EVENT_IQR}""")
def o01(spark, d):
    return rounded(O.iqr_outliers(table(spark, d, "events"), ["value"]))


@query("o02_flag_iqr", f"SELECT event_id, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_outlier FROM events, {EVENT_IQR}")
def o02(spark, d):
    return O.flag_iqr(table(spark, d, "events"), ["user_id", "value"]).select("event_id", "is_outlier")


@query("o02_outlier_row_share", f"""SELECT count(*) AS n_rows, count(*) FILTER (f) AS outlier_rows, round(count(*) FILTER (f) * 100.0 / count(*), 6) AS outlier_pct
  FROM (SELECT value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS f FROM events, {EVENT_IQR})""")
def o02b(spark, d):
    return rounded(O.outlier_row_share(O.flag_iqr(table(spark, d, "events"), ["value"])))


@query("o03_isolation_forest")
def o03(spark, d):
    return O.isolation_forest(table(spark, d, "orders"), ["o_orderkey"], ["o_totalprice", "o_custkey"]).select("o_orderkey", "score", "is_outlier")


LOF_SQL = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.e, b.e) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id),
  n AS (SELECT a, b, dist FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS r FROM p) WHERE r <= 20),
  k AS (SELECT a, max(dist) AS kd FROM n GROUP BY a),
  l AS (SELECT n.a, 1.0::DOUBLE / (avg(greatest(n.dist, k.kd)) + 1e-10) AS lrd FROM n JOIN k ON k.a = n.b GROUP BY n.a)
  SELECT n.a AS vec_id, round(avg(o.lrd) / max(s.lrd), 6) AS lof FROM n JOIN l o ON o.a = n.b JOIN l s ON s.a = n.a GROUP BY n.a"""


@query("o04_local_outlier_factor", LOF_SQL)
def o04(spark, d):
    return rounded(O.local_outlier_factor(vectors(spark, d), "vec_id", "vec"))


@query("o05_mahalanobis", """WITH s AS (SELECT avg(o_totalprice) AS ma, avg(o_custkey) AS mb, var_samp(o_totalprice) AS va, var_samp(o_custkey) AS vb, covar_samp(o_totalprice, o_custkey) AS c FROM orders),
  d AS (SELECT o_orderkey, ((o_totalprice - ma) * (o_totalprice - ma) * vb - 2 * (o_totalprice - ma) * (o_custkey - mb) * c + (o_custkey - mb) * (o_custkey - mb) * va) / (va * vb - c * c) AS d2 FROM orders, s)
  SELECT o_orderkey, round(d2, 6) AS d2, d2 > -2 * ln(0.025) AS is_outlier FROM d""")
def o05(spark, d):
    return rounded(O.mahalanobis(table(spark, d, "orders"), ["o_totalprice", "o_custkey"]).select("o_orderkey", "d2", "is_outlier"))


@query("o06_outlier_impact", f"""WITH f AS (SELECT count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n, count(*) AS total FROM events, {EVENT_IQR})
  SELECT n AS total_outliers, 1::BIGINT AS columns_with_outliers, round(n * 100.0 / (total * 2), 3) AS impact_score,
  CASE WHEN n * 100.0 / (total * 2) > 5 THEN 'high' WHEN n * 100.0 / (total * 2) > 2 THEN 'moderate' ELSE 'low' END AS impact FROM f""")
def o06(spark, d):
    return O.outlier_impact(table(spark, d, "events"), ["user_id", "value"])


@query("o07_outlier_share_test", f"""SELECT 'value' AS "column", round(avg(CASE WHEN f THEN 1.0 ELSE 0.0 END), 6) AS outlier_share, avg(CASE WHEN f THEN 1.0 ELSE 0.0 END) < 0.05 AS passed
  FROM (SELECT value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS f FROM events, {EVENT_IQR})""")
def o07(spark, d):
    return rounded(O.outlier_share_test(table(spark, d, "events"), ["value"]))


@query("o08_shape_warnings", union_sql([f"""SELECT '{c}' AS "column", round(skewness({c}), 5) AS skewness, round(kurtosis({c}), 5) AS kurtosis, abs(skewness({c})) > 2 AS skew_warning,
  kurtosis({c}) > 7 AS kurtosis_warning FROM events""" for c in ("value", "user_id")]))
def o08(spark, d):
    return rounded(O.shape_warnings(table(spark, d, "events"), ["value", "user_id"]), 5)


# ---- transformations ----

@query("f01_boxcox_fixed", "SELECT event_id, round((pow(value, 0.25) - 1) / 0.25, 6) AS value_boxcox FROM events")
def f01(spark, d):
    return rounded(T.boxcox(table(spark, d, "events"), ["value"], lambdas={"value": 0.25}).select("event_id", "value_boxcox"))


@query("f01_boxcox_search")
def f01b(spark, d):
    return T.boxcox(table(spark, d, "events"), ["value"]).select("event_id", "value_boxcox")


@query("f02_log_transform", "SELECT event_id, round(ln(value), 6) AS value_log FROM events")
def f02(spark, d):
    return rounded(T.log_transform(table(spark, d, "events"), ["user_id", "value"]).select("event_id", "value_log"))


def quantile_case(c, source):
    q = [f"(SELECT quantile_cont({c}, {i / 5}) FROM {source})" for i in range(1, 5)]
    return f"CASE WHEN {c} <= {q[0]} THEN 'Q1' WHEN {c} <= {q[1]} THEN 'Q2' WHEN {c} <= {q[2]} THEN 'Q3' WHEN {c} <= {q[3]} THEN 'Q4' ELSE 'Q5' END"


@query("f03_quantile_bins", f"SELECT event_id, {quantile_case('value', 'events')} AS value_binned FROM events")
def f03(spark, d):
    return T.quantile_bins(table(spark, d, "events"), ["value"]).select("event_id", "value_binned")


@query("f03_bin_balance", f"""WITH b AS (SELECT {quantile_case('value', 'events')} AS bin, count(*) AS n FROM events GROUP BY 1)
  SELECT bin, n, round(n / (SELECT sum(n) FROM b)::DOUBLE, 6) AS share, round((SELECT min(n) / max(n)::DOUBLE FROM b), 6) AS balance_ratio FROM b""")
def f03b(spark, d):
    return rounded(T.bin_balance(T.quantile_bins(table(spark, d, "events"), ["value"]), "value_binned"))


@query("f04_equal_width_bins", """SELECT o_orderkey, 'B' || CAST(greatest(1, least(5, ceil((o_totalprice - lo) / w))) AS INTEGER) AS o_totalprice_binned
  FROM orders, (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 5 AS w FROM orders)""")
def f04(spark, d):
    return T.equal_width_bins(table(spark, d, "orders"), ["o_totalprice"]).select("o_orderkey", "o_totalprice_binned")


@query("f05_reduce_cardinality", """SELECT p_partkey, CASE WHEN n / (SELECT count(*) FROM part)::DOUBLE < 0.04 THEN 'Other' ELSE p_brand END AS p_brand_reduced
  FROM part JOIN (SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1) ON b = p_brand""")
def f05(spark, d):
    return T.reduce_cardinality(table(spark, d, "part"), ["p_brand"], 0.04).select("p_partkey", "p_brand_reduced")


@query("f06_rare_bucket", """SELECT p_partkey, CASE WHEN n / (SELECT count(*) FROM part)::DOUBLE < 0.015 THEN '__OTHER__' ELSE p_name END AS p_name
  FROM part JOIN (SELECT p_name AS b, count(*) AS n FROM part GROUP BY 1) ON b = p_name""")
def f06(spark, d):
    return T.rare_bucket(table(spark, d, "part"), ["p_name"], 0.015).select("p_partkey", "p_name")


HASH = "md5(coalesce(l_returnflag, '__MISSING__'))"


@query("f07_hash_encode", f"""SELECT l_orderkey, l_partkey, l_linenumber, {', '.join(f"CASE WHEN ('0x' || substr({HASH}, 1, 8))::BIGINT % 4 = {i} THEN CASE WHEN ('0x' || substr({HASH}, 9, 1))::INTEGER < 8 THEN 1.0 ELSE -1.0 END ELSE 0.0 END::DOUBLE AS l_returnflag_hash_{i}" for i in range(4))} FROM {GAPS}""")
def f07(spark, d):
    return T.hash_encode(gaps(spark, d), "l_returnflag", 4).select("l_orderkey", "l_partkey", "l_linenumber", *[f"l_returnflag_hash_{i}" for i in range(4)])


@query("f08_target_encode", f"""SELECT l_orderkey, l_partkey, l_linenumber, round(coalesce(m, (SELECT avg(l_extendedprice) FROM {GAPS})), 4) AS l_returnflag_target_encoded
  FROM {GAPS} g LEFT JOIN (SELECT l_returnflag AS f, avg(l_extendedprice) AS m FROM {GAPS} WHERE l_returnflag IS NOT NULL GROUP BY 1) ON f = l_returnflag""")
def f08(spark, d):
    return rounded(T.target_encode(gaps(spark, d), "l_returnflag", "l_extendedprice").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag_target_encoded"), 4)


@query("f09_target_encode_out_of_fold", """WITH f AS (SELECT *, ('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), 1, 8))::BIGINT % 5 AS fold FROM orders),
  t AS (SELECT o_orderpriority AS p, sum(o_totalprice) AS s, count(*) AS n FROM f GROUP BY 1), h AS (SELECT o_orderpriority AS p, fold, sum(o_totalprice) AS s, count(*) AS n FROM f GROUP BY 1, 2)
  SELECT o_orderkey, round((t.s - h.s) / (t.n - h.n), 4) AS o_orderpriority_target_encoded FROM f JOIN t ON t.p = o_orderpriority JOIN h ON h.p = o_orderpriority AND h.fold = f.fold""")
def f09(spark, d):
    return rounded(T.target_encode_out_of_fold(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", ["o_orderkey"]).select("o_orderkey", "o_orderpriority_target_encoded"), 4)


@query("f10_one_hot", """SELECT c_custkey, (c_mktsegment = 'BUILDING')::INTEGER AS "c_mktsegment_BUILDING", (c_mktsegment = 'FURNITURE')::INTEGER AS "c_mktsegment_FURNITURE",
  (c_mktsegment = 'HOUSEHOLD')::INTEGER AS "c_mktsegment_HOUSEHOLD", (c_mktsegment = 'MACHINERY')::INTEGER AS "c_mktsegment_MACHINERY" FROM customer""")
def f10(spark, d):
    return T.one_hot(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query("f11_label_encode", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_name) - 1)::INTEGER AS c_name_code FROM customer")
def f11(spark, d):
    return T.label_encode(table(spark, d, "customer"), "c_name").select("c_custkey", "c_name_code")


@query("f12_ordinal_evidence", """WITH t AS (SELECT *, CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 20 THEN 'b' WHEN p_size < 30 THEN 'c' WHEN p_size < 40 THEN 'd' ELSE 'e' END AS band,
    dense_rank() OVER (ORDER BY p_type) - 1 AS kind FROM part), u AS (SELECT *, ascii(band) - 97 AS code FROM t)
  SELECT 'band' AS "column", round(abs(corr(code, p_size)), 6) AS mean_abs_correlation, abs(corr(code, p_size)) > 0.7 AS is_ordinal FROM u
  UNION ALL SELECT 'p_type', round(abs(corr(kind, p_size)), 6), abs(corr(kind, p_size)) > 0.7 FROM u""")
def f12(spark, d):
    s = F.col("p_size")
    band = F.when(s < 10, "a").when(s < 20, "b").when(s < 30, "c").when(s < 40, "d").otherwise("e")
    return rounded(T.ordinal_evidence(table(spark, d, "part").select("p_size", "p_type", band.alias("band")), ["band", "p_type"]))


@query("f13_encoding_choice", """SELECT greatest(count(DISTINCT p_name), count(DISTINCT p_brand), count(DISTINCT p_type)) AS max_cardinality,
  CASE WHEN greatest(count(DISTINCT p_name), count(DISTINCT p_brand), count(DISTINCT p_type)) > 100 THEN 'hash' ELSE 'rare_bucket' END AS method FROM part""")
def f13(spark, d):
    return T.encoding_choice(table(spark, d, "part"))


@query("f13_encode_auto", """SELECT o_orderkey, round(m, 6) AS o_orderpriority_target_encoded FROM orders JOIN (SELECT o_orderpriority AS p, avg(o_totalprice) AS m FROM orders GROUP BY 1) ON p = o_orderpriority""")
def f13b(spark, d):
    return rounded(T.encode_auto(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice").select("o_orderkey", "o_orderpriority_target_encoded"))


def turn(f, part, name):
    top = f"(SELECT max({part}) + 1 FROM events)"
    return f"round({f}(2 * pi() * {part} / {top}), 6) AS ts_{name}_{f}"


WEEKDAY = "(isodow(ts) - 1)"


@query("f14_datetime_parts", f"""SELECT event_id, year(ts)::INTEGER AS ts_year, month(ts)::INTEGER AS ts_month, day(ts)::INTEGER AS ts_day, hour(ts)::INTEGER AS ts_hour, {WEEKDAY}::INTEGER AS ts_day_of_week,
  dayofyear(ts)::INTEGER AS ts_day_of_year, {', '.join(turn(f, p, n) for p, n in (('month(ts)', 'month'), ('hour(ts)', 'hour'), (WEEKDAY, 'day_of_week')) for f in ('sin', 'cos'))} FROM events""")
def f14(spark, d):
    out = T.datetime_parts(table(spark, d, "events").select("event_id", "ts"))
    return rounded(out.drop("ts"))


@query("f14_datetime_parts_of_text", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS day_year, month(o_orderdate)::INTEGER AS day_month, dayofyear(o_orderdate)::INTEGER AS day_day_of_year FROM orders")
def f14b(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"))
    return T.datetime_parts(o, ["day"], cyclical=False).select("o_orderkey", "day_year", "day_month", "day_day_of_year")


@query("f15_scale_standard", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS o_totalprice_scaled FROM orders")
def f15(spark, d):
    return rounded(T.scale(table(spark, d, "orders"), ["o_totalprice"]).select("o_orderkey", "o_totalprice_scaled"))


@query("f15_scale_minmax", "SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 6) AS o_totalprice_scaled FROM orders")
def f15b(spark, d):
    return rounded(T.scale(table(spark, d, "orders"), ["o_totalprice"], "minmax").select("o_orderkey", "o_totalprice_scaled"))


@query("f15_scale_robust", "SELECT o_orderkey, round((o_totalprice - (SELECT median(o_totalprice) FROM orders)) / (SELECT quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) FROM orders), 6) AS o_totalprice_scaled FROM orders")
def f15c(spark, d):
    return rounded(T.scale(table(spark, d, "orders"), ["o_totalprice"], "robust").select("o_orderkey", "o_totalprice_scaled"))


@query("f16_text_vectors", """WITH w AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM benchmark), c AS (SELECT item_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY 1, 2),
  v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1 ORDER BY total DESC, term LIMIT 200)
  SELECT item_id, term, tf, round(tf * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + df)) + 1.0), 6) AS tfidf FROM c JOIN v USING (term)""")
def f16(spark, d):
    return rounded(T.text_vectors(table(spark, d, "benchmark"), "item_id", "text", 200))


@query("f16_text_vectors_of_documents", """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY 1, 2),
  v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1 ORDER BY total DESC, term LIMIT 1000)
  SELECT term, count(*) AS docs, round(sum(tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0)), 4) AS weight FROM c JOIN v USING (term) GROUP BY 1""")
def f16b(spark, d):
    out = T.text_vectors(table(spark, d, "documents"), "doc_id", "text")
    return rounded(out.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tfidf").alias("weight")), 4)


@query("f17_basic_features", """SELECT c_custkey, (c_mktsegment = 'BUILDING')::INTEGER AS "c_mktsegment_BUILDING", (c_mktsegment = 'FURNITURE')::INTEGER AS "c_mktsegment_FURNITURE",
  (c_mktsegment = 'HOUSEHOLD')::INTEGER AS "c_mktsegment_HOUSEHOLD", (c_mktsegment = 'MACHINERY')::INTEGER AS "c_mktsegment_MACHINERY",
  round(coalesce(CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END, (SELECT median(c_acctbal) FROM customer WHERE c_custkey % 9 <> 0)), 6) AS c_acctbal,
  round(coalesce(CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END, (SELECT median(c_acctbal) FROM customer WHERE c_custkey % 9 <> 0)) * c_nationkey, 4) AS c_nationkey_x_c_acctbal FROM customer""")
def f17(spark, d):
    from tallyglass.operators.imputation import impute_simple
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    out = T.interactions(T.one_hot(impute_simple(c, cols=["c_acctbal", "c_mktsegment"]), ["c_mktsegment"]), ["c_nationkey", "c_acctbal"])
    return out.drop("c_nationkey").withColumns({"c_acctbal": F.round("c_acctbal", 6), "c_nationkey_x_c_acctbal": F.round("c_nationkey_x_c_acctbal", 4)})


@query("f18_interactions", """SELECT l_orderkey, l_partkey, l_linenumber, round(l_quantity * l_discount, 6) AS l_quantity_x_l_discount, round(l_quantity * l_tax, 6) AS l_quantity_x_l_tax,
  round(l_discount * l_tax, 6) AS l_discount_x_l_tax FROM lineitem""")
def f18(spark, d):
    names = ["l_quantity", "l_discount", "l_tax"]
    return rounded(T.interactions(table(spark, d, "lineitem"), names).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity_x_l_discount", "l_quantity_x_l_tax", "l_discount_x_l_tax"))


@query("f19_vif", """WITH r AS (SELECT corr(l_quantity, l_quantity * 2 + l_tax * 100) AS r FROM lineitem)
  SELECT unnest(['l_quantity', 'mixed']) AS "column", round(1 / (1 - r * r), 3) AS vif, CASE WHEN 1 / (1 - r * r) > 10 THEN 'severe' WHEN 1 / (1 - r * r) > 5 THEN 'high' ELSE 'ok' END AS level FROM r""")
def f19(spark, d):
    li = table(spark, d, "lineitem").withColumn("mixed", F.col("l_quantity") * 2 + F.col("l_tax") * 100)
    return rounded(T.vif(li, ["l_quantity", "mixed"]), 3)


def solved_vif_sql(cols: dict[str, str], relation: str) -> str:
    """(column, vif) for three columns: 1 / (1 - R²) of one on the two others, from correlations."""
    parts = []
    for c, x in cols.items():
        (_, y), (_, z) = [(n, e) for n, e in cols.items() if n != c]
        parts.append(f"""SELECT '{c}' AS "column", 1 / (1 - (a * a + b * b - 2 * a * b * e) / (1 - e * e)) AS vif FROM (SELECT corr({x}, {y}) AS a, corr({x}, {z}) AS b, corr({y}, {z}) AS e FROM {relation})""")
    return union_sql(parts)


MIXED = {"l_quantity": "l_quantity", "l_discount": "l_discount", "mixed": "l_discount * 2 + l_tax"}


@query("f19_vif_with_a_copy", f"""SELECT * FROM (SELECT unnest(['l_quantity', 'copy']) AS "column", 'Infinity'::DOUBLE AS vif, 'severe' AS level)
  UNION ALL SELECT "column", round(vif, 3), CASE WHEN vif > 10 THEN 'severe' WHEN vif > 5 THEN 'high' ELSE 'ok' END FROM ({solved_vif_sql(MIXED, "lineitem")}) WHERE "column" <> 'l_quantity'""")
def f19b(spark, d):
    """An exact copy makes two columns infinite and leaves the others as they are without it."""
    li = table(spark, d, "lineitem").withColumns({"copy": F.col("l_quantity") * 3, "mixed": F.col("l_discount") * 2 + F.col("l_tax")})
    return rounded(T.vif(li, ["l_quantity", "copy", "l_discount", "mixed"]), 3)


@query("f20_variances", per_column_sql(NUMBERS, "round(var_pop({c}), 4) AS variance, var_pop({c}) <= 0.01 AS removed"))
def f20(spark, d):
    return rounded(T.variances(table(spark, d, "lineitem"), NUMBERS), 4)


@query("f20_drop_low_variance", "SELECT l_quantity, l_extendedprice FROM lineitem")
def f20b(spark, d):
    return T.drop_low_variance(table(spark, d, "lineitem").select(*NUMBERS))


def ten(c):
    q = [f"(SELECT quantile_cont({c}, {i / 10}) FROM lineitem)" for i in range(1, 10)]
    return "(" + " + ".join(f"(CASE WHEN {c} > {x} THEN 1 ELSE 0 END)" for x in q) + ")"


def mi_sql(c):
    return f"""SELECT '{c}' AS "column", round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mutual_information FROM (
      SELECT n::DOUBLE AS n, sum(n) OVER ()::DOUBLE AS t, sum(n) OVER (PARTITION BY x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY y)::DOUBLE AS ny
      FROM (SELECT {ten(c)} AS x, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY 1, 2))"""


@query("f21_mutual_information", union_sql([mi_sql(c) for c in ("l_quantity", "l_extendedprice", "l_tax")]))
def f21(spark, d):
    return rounded(T.mutual_information(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_tax"]))


def neighbour_mi_sql(cols: list[str], target: str, number: bool) -> str:
    """Every row of part compared with every other: the same estimate by brute force."""
    spread = ", ".join(f"nullif(stddev_pop({c}), 0) AS s_{c}" for c in [*cols, *([target] if number else [])])
    y = f"{target} / coalesce(s_{target}, 1)" if number else target
    long = union_sql([f"""SELECT '{c}' AS "column", p_partkey AS id, {c} / coalesce(s_{c}, 1) AS x, {y} AS y FROM part, s""" for c in cols])
    gap = "greatest(abs(a.x - b.x), abs(a.y - b.y))" if number else "abs(a.x - b.x)"
    other = "CASE WHEN a.id <> b.id" + ("" if number else " AND a.y = b.y") + f" THEN {gap} END"
    second = "count(*) FILTER (abs(a.y - b.y) <= r.r * (1 - 1e-9))" if number else "any_value(r.size)"
    return f"""WITH s AS (SELECT {spread} FROM part), l AS ({long}), p AS (SELECT * FROM l WHERE {'true' if number else '("column", y) IN (SELECT ("column", y) FROM l GROUP BY "column", y HAVING count(*) > 1)'}),
  psi AS (SELECT n, -0.5772156649015329 + coalesce(sum(CASE WHEN n > 1 THEN 1.0 / (n - 1) END) OVER (ORDER BY n), 0) AS psi FROM (SELECT unnest(range(1, (SELECT count(*) FROM part) + 2)) AS n)),
  d AS (SELECT a."column", a.id, min({other}, 3) AS near, count(*) FILTER ({other} = 0) AS same, count(*) FILTER (a.y = b.y) AS size FROM p a JOIN p b ON a."column" = b."column" GROUP BY ALL),
  r AS (SELECT *, near[-1] AS r, CASE WHEN near[-1] = 0 THEN same + 1 ELSE len(near) END AS kk FROM d),
  c AS (SELECT a."column", a.id, any_value(r.kk) AS kk, count(*) FILTER (abs(a.x - b.x) <= r.r * (1 - 1e-9)) AS n_x, {second} AS n_y
    FROM p a JOIN p b ON a."column" = b."column" JOIN r ON r."column" = a."column" AND r.id = a.id GROUP BY ALL)
  SELECT c."column" AS "column", round(greatest(any_value(t.psi) + avg(k.psi - x.psi - y.psi), 0), 6) AS mutual_information FROM c JOIN psi k ON k.n = c.kk JOIN psi x ON x.n = c.n_x JOIN psi y ON y.n = c.n_y
  JOIN (SELECT "column", count(*) AS n FROM p GROUP BY 1) z ON z."column" = c."column" JOIN psi t ON t.n = z.n GROUP BY 1"""


@query("f21_neighbour_information", neighbour_mi_sql(["p_size", "p_partkey"], "p_retailprice", True))
def f21n(spark, d):
    return rounded(neighbour_information(table(spark, d, "part"), "p_retailprice", ["p_size", "p_partkey"]))


@query("f21_neighbour_information_of_classes", neighbour_mi_sql(["p_size", "p_retailprice"], "p_brand", False))
def f21c(spark, d):
    return rounded(neighbour_information(table(spark, d, "part"), "p_brand", ["p_size", "p_retailprice"]))


@query("f22_prune", """SELECT * FROM (VALUES ('l_quantity', 'vif'), ('mixed', 'vif'), ('l_discount', 'variance'), ('l_tax', 'variance')) t("column", reason) WHERE (SELECT count(*) FROM lineitem) > 0""")
def f22(spark, d):
    li = table(spark, d, "lineitem").select(*NUMBERS, (F.col("l_quantity") * 2 + F.col("l_linenumber")).alias("mixed"))
    return T.prune(li, "l_extendedprice")[1]


PRODUCTS = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_quantity_x_l_extendedprice": "l_quantity * l_extendedprice"}


@query("f23_interactions_pruned", f"""WITH v AS ({solved_vif_sql(PRODUCTS, "lineitem")})
  SELECT "column" FROM (SELECT unnest(['l_orderkey', 'l_quantity', 'l_extendedprice', 'l_quantity_x_l_extendedprice']) AS "column") WHERE "column" NOT IN (SELECT "column" FROM v WHERE vif > 5)""")
def f23(spark, d):
    kept = T.interactions_pruned(table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(c,) for c in kept.columns], "column string")


@query("f10_one_hot_vectors", """SELECT o_orderkey, (SELECT count(DISTINCT o_custkey) FROM orders)::INTEGER - 1 AS size, CASE WHEN code > 0 THEN code - 1 END AS place FROM (
  SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_custkey::VARCHAR) - 1)::INTEGER AS code FROM orders)""")
def f10b(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"))
    v = T.one_hot_vectors(o, ["o_custkey"])
    return v.select("o_orderkey", F.col("o_custkey_onehot.size").cast("int").alias("size"), F.try_element_at("o_custkey_onehot.indices", F.lit(1)).cast("int").alias("place"))


@query("f24_fit_before_apply_after", f"""WITH b AS (SELECT * FROM {BEFORE}), m AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s, median(o_totalprice) AS mid FROM b),
  t AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS mean, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS code FROM b GROUP BY 1)
  SELECT o_orderkey, round((price - a) / s, 6) AS price_scaled, code AS o_orderpriority_code, round(coalesce(t.mean, a), 4) AS o_orderpriority_target_encoded FROM (
    SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN mid ELSE o_totalprice END AS price, a, s FROM {AFTER}, m) LEFT JOIN t ON p = o_orderpriority""")
def f24b(spark, d):
    """Fitted on the orders before the cut, saved, loaded, applied to those after it, whose gaps are filled with the earlier median."""
    before, after = before_after(spark, d)
    before, after = before.withColumn("price", F.col("o_totalprice")), after.withColumn("price", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")))
    steps = [Step("impute", "price", {"strategy": "median"}), Step("scale", "price"), Step("label", "o_orderpriority"), Step("target", "o_orderpriority", {"target": "o_totalprice"})]
    path = fit_steps(before, steps).save(fresh_path(spark, "fitted-steps"))
    made = FittedSteps.load(spark, path).transform(after).select("o_orderkey", "price_scaled", "o_orderpriority_code", "o_orderpriority_target_encoded")
    return made.withColumns({"price_scaled": F.round("price_scaled", 6), "o_orderpriority_target_encoded": F.round("o_orderpriority_target_encoded", 4)})


@query("f24_features_reloaded", "SELECT c_custkey, c_mktsegment, round(c_acctbal / (SELECT stddev_samp(c_acctbal) FROM customer), 5) AS first_feature FROM customer")
def f24(spark, d):
    from pyspark.ml.functions import vector_to_array
    c = table(spark, d, "customer").drop("c_nationkey", "c_name")
    path = T.save_pipeline(T.feature_pipeline(c, numeric=["c_acctbal"], categorical=["c_mktsegment"]), fresh_path(spark, "features-model"))
    return rounded(T.run_pipeline(path, c).select("c_custkey", "c_mktsegment", vector_to_array("features")[0].alias("first_feature")), 5)


@query("f25_transformation_summary", """SELECT 'value' AS "column", 'value_log' AS new_column, round(skewness(value), 5) AS before, round(skewness(ln(value)), 5) AS after,
  round(abs(skewness(value)) - abs(skewness(ln(value))), 5) AS improvement, abs(skewness(value)) - abs(skewness(ln(value))) > 0.5 AS improved FROM events""")
def f25(spark, d):
    e = table(spark, d, "events")
    return rounded(T.transformation_summary(e, T.log_transform(e, ["value"]), [("value", "value_log")]), 5)
