"""Queries over sources, sinks, projections and listings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallyglass.operators import columns as C
from tallyglass.plans.catalog import query, rounded, union_sql
from tallyglass.plans.inputs import GAPS, gaps, table
from tallyglass.session import fresh_path
from tallyglass.sources import readers as R, tables as T
from tallyglass.streaming import jobs as J

ORDERS_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@query("s01_read_csv", "SELECT * FROM customer")
def s01(spark, d):
    path = T.write_table(table(spark, d, "customer"), fresh_path(spark, "customer.csv"), "csv")
    return R.read_csv(spark, path, table(spark, d, "customer").schema)


@query("s01_read_csv_inferred", "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders")
def s01b(spark, d):
    path = T.write_table(table(spark, d, "orders"), fresh_path(spark, "orders.csv"), "csv")
    got = R.read_csv(spark, path)
    return got.select("o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate")).withColumns(
        {"o_orderkey": F.col("o_orderkey").cast("long")})


@query("s02_read_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01 00:00:00'")
def s02(spark, d):
    return R.read_parquet(spark, f"{d}/orders.parquet").where(F.col("o_orderdate") >= F.lit(datetime(2000, 1, 1))).select("o_orderkey", "o_totalprice")


@query("s02_nan_is_missing", "SELECT unnest(['parquet', 'json']) AS kind, count(*) AS n_rows, count(*) FILTER (o_custkey % 3 = 0) AS missing FROM orders")
def s02b(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("price"))
    frames = []
    for kind in ("parquet", "json"):
        path = T.write_table(o, fresh_path(spark, "gaps") + f".{kind}", kind)
        frames.append(R.load_table(spark, path, schema=o.schema).agg(F.count("*").alias("n_rows"), (F.count("*") - F.count("price")).alias("missing")).select(F.lit(kind).alias("kind"), "n_rows", "missing"))
    return frames[0].unionByName(frames[1])


@query("s03_read_json", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def s03(spark, d):
    path = T.write_table(table(spark, d, "orders"), fresh_path(spark, "orders.json"), "json")
    return R.read_json(spark, path, ORDERS_SCHEMA).drop("o_orderdate")


@query("s04_load_by_suffix", "SELECT 'csv' AS kind, count(*) AS n, sum(p_size)::BIGINT AS total FROM part UNION ALL SELECT 'json', count(*), sum(p_size)::BIGINT FROM part UNION ALL SELECT 'parquet', count(*), sum(p_size)::BIGINT FROM part")
def s04(spark, d):
    part, frames = table(spark, d, "part"), []
    for kind in ("csv", "json", "parquet"):
        path = T.write_table(part, fresh_path(spark, "part") + f".{kind}", kind)
        frames.append(R.load_table(spark, path, schema=part.schema).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total")).select(
            F.lit(kind).alias("kind"), "n", "total"))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("s05_capped_load", """SELECT * FROM lineitem ORDER BY md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
  CAST(l_extendedprice AS VARCHAR), '42')), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 10000""")
def s05(spark, d):
    return R.capped_load(spark, f"{d}/lineitem.parquet", keys=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("s06_seeded_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey LIMIT 1000")
def s06(spark, d):
    return R.seeded_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 1000, ["o_orderkey"])


@query("s07_read_dump", "SELECT * FROM supplier")
def s07(spark, d):
    path = T.write_table(table(spark, d, "supplier"), fresh_path(spark, "supplier-dump"), "json")
    loaded = R.read_dump(spark, R.DumpSource("suppliers", path, "json"))
    return loaded.select("s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"), "s_acctbal")


@query("s08_read_stream", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def s08(spark, d):
    source = R.StreamSource("events", d, protocol="parquet", options={"pathGlobFilter": "events.parquet"})
    path = J.run_to_table(R.read_stream(spark, source, J.EVENT_SCHEMA), "stream-read")
    return rounded(spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 2)


@query("s09_list_sources", "SELECT DISTINCT source AS name, lang AS type FROM documents WHERE lang = 'en'")
def s09(spark, d):
    return R.list_sources(table(spark, d, "documents").select(F.col("source").alias("name"), F.col("lang").alias("type")).distinct(), "en")


LISTED = {"customer": 5, "lineitem": 11, "nation": 3, "orders": 6, "part": 6}


@query("s10_list_tables", union_sql([f"SELECT '{n}' AS name, count(*) AS n_rows, CAST({c} AS BIGINT) AS n_columns FROM {n}" for n, c in LISTED.items()]))
def s10(spark, d):
    for n in LISTED:
        T.register(table(spark, d, n), n)
    return T.list_tables(spark, list(LISTED))


@query("s11_drop_table")
def s11(spark, d):
    T.register(table(spark, d, "nation"), "forgotten_nation")
    gone = T.drop_table(spark, "forgotten_nation")
    return table(spark, d, "nation").agg(F.count(F.lit(1)).alias("n_rows")).withColumns(
        {"dropped": F.lit(gone), "still_there": F.lit(spark.catalog.tableExists("forgotten_nation"))})


@query("s12_write_table", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def s12(spark, d):
    path = T.write_table(table(spark, d, "orders"), fresh_path(spark, "features"), partition_by=["o_orderpriority"])
    return rounded(spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("s13_snapshot_texts", """SELECT sha256(text) AS sha256, max(strlen(text))::BIGINT AS size, min(doc_id::VARCHAR) AS name, count(*) AS copies,
  substr(sha256(text), 1, 12) || '-0' AS snapshot_id FROM documents GROUP BY 1""")
def s13(spark, d):
    docs = table(spark, d, "documents").withColumn("size", F.octet_length("text"))
    return T.content_manifest(docs, "text", "doc_id", "size").select("sha256", "size", "name", "copies", "snapshot_id")


@query("s13_snapshot_files")
def s13b(spark, d):
    path = T.append_snapshots(T.snapshot_files(spark, d, "driver", "generated", "*.parquet"), fresh_path(spark, "manifest"))
    return spark.read.parquet(path)


@query("s14_baseline_round_trip", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total, 'c_mktsegment' AS target, 3::INTEGER AS numeric_columns, 1::INTEGER AS listed FROM customer")
def s14(spark, d):
    root = fresh_path(spark, "baselines")
    first = T.save_baseline(table(spark, d, "customer"), root, "c_mktsegment")
    second = T.save_baseline(table(spark, d, "nation"), root)
    T.delete_baseline(spark, root, second)
    rows, roles = T.load_baseline(spark, root, first)
    kept = T.list_baselines(spark, root).count()
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("total")), 2).withColumns(
        {"target": F.lit(roles.target), "numeric_columns": F.lit(len(roles.numeric)), "listed": F.lit(kept)})


@query("s15_write_report", """SELECT 'l_quantity' AS "column", count(*) FILTER (l_quantity IS NULL) AS null_count FROM """ + GAPS + """
  UNION ALL SELECT 'l_discount', count(*) FILTER (l_discount IS NULL) FROM """ + GAPS)
def s15(spark, d):
    from tallyglass.operators.profile import null_counts
    path = T.write_report(null_counts(gaps(spark, d), cols=["l_quantity", "l_discount"]), fresh_path(spark, "report"))
    return spark.read.schema("column string, null_count bigint").json(path)


# ---- projections, filters, pages ----

@query("p01_select_numeric", "SELECT o_custkey, o_totalprice FROM orders")
def p01(spark, d):
    return C.select_numeric(table(spark, d, "orders"), ["o_orderkey"])


@query("p02_select_categorical", "SELECT o_orderstatus, o_orderpriority FROM orders")
def p02(spark, d):
    return C.select_categorical(table(spark, d, "orders"))


@query("p03_select_datetime", "SELECT CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders")
def p03(spark, d):
    return C.select_datetime(table(spark, d, "orders")).select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"))


@query("p04_feature_roles", """SELECT * FROM (VALUES ('o_orderdate', 'datetime'), ('o_orderstatus', 'target'), ('o_totalprice', 'numeric')) t("column", role)
  UNION ALL SELECT 'o_orderkey', CASE WHEN count(DISTINCT o_orderkey) >= 0.95 * count(*) THEN 'id' ELSE 'numeric' END FROM orders
  UNION ALL SELECT 'o_custkey', CASE WHEN count(DISTINCT o_custkey) >= 0.95 * count(*) THEN 'id' ELSE 'numeric' END FROM orders
  UNION ALL SELECT 'o_orderpriority', CASE WHEN count(DISTINCT o_orderpriority) >= 0.95 * count(*) THEN 'id'
    WHEN avg(len(string_split(o_orderpriority, ' '))) > 3 THEN 'text' ELSE 'categorical' END FROM orders""")
def p04(spark, d):
    return C.feature_roles(table(spark, d, "orders"), "o_orderstatus")


@query("p05_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def p05(spark, d):
    return C.preview(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("p06_drop_null_rows", f"SELECT l_orderkey, l_quantity, l_discount FROM {GAPS} WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL")
def p06(spark, d):
    return C.drop_null_rows(gaps(spark, d), ["l_quantity", "l_discount"]).select("l_orderkey", "l_quantity", "l_discount")


@query("p07_split_target", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def p07(spark, d):
    return C.split_target(table(spark, d, "orders").drop("o_orderdate"), "o_orderstatus")[0]


@query("p08_outside_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 5000 OR o_totalprice > 300000")
def p08(spark, d):
    return table(spark, d, "orders").where(C.outside("o_totalprice", 5000.0, 300000.0)).select("o_orderkey", "o_totalprice")


@query("p09_paged_listing", """WITH hits AS (SELECT event_id, user_id, value, ts FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) = 7
    AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-28 00:00:00')
  SELECT event_id, user_id, value, (SELECT count(*) FROM hits) AS total, CAST(ceil((SELECT count(*) FROM hits) / 10.0) AS BIGINT) AS pages
  FROM hits ORDER BY ts DESC, event_id LIMIT 10 OFFSET 10""")
def p09(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return C.paged_listing(e.select("event_id", "user_id", "value", "ts", "k"), "ts", "event_id", {"k": 7}, datetime(2024, 1, 3), datetime(2024, 1, 28), 2, 10).select(
        "event_id", "user_id", "value", "total", "pages")


@query("p10_member_listing", """WITH page AS (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25)
  SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS child_count FROM page""")
def p10(spark, d):
    got = C.member_listing(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", "o_orderstatus", ["F", "P"], "o_orderdate", 25, 25)
    return got.select("o_orderkey", "o_orderstatus", "child_count")


@query("p11_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def p11(spark, d):
    return C.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, ["o_orderkey"])


@query("p12_safe_divide", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount = 0 THEN -1 ELSE l_tax / l_discount END, 6) AS share FROM lineitem")
def p12(spark, d):
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.safe_divide(F.col("l_tax"), F.col("l_discount"), -1.0).alias("share")))
