"""Queries over imbalance, resampling, splits, models and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.operators import metrics as E, models as L, sampling as S
from tallyglass.operators.kernels import kernel_machine
from tallyglass.operators.neighbors import nearest
from tallyglass.plans.catalog import query, rounded, union_sql
from tallyglass.plans.inputs import PART_FEATURES, PARTS, SCORED, parts, scored, table, vectors


def order_hash(key, seed=42):
    return f"md5(concat_ws('|', CAST({key} AS VARCHAR), '{seed}'))"


# ---- imbalance ----

IMBALANCE = """WITH c AS (SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1), s AS (SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_classes, min(n) AS minority, max(n) AS majority FROM c)
  SELECT n_rows, n_classes, minority, majority, round(majority / minority::DOUBLE, 6) AS imbalance_ratio, round(minority * 100.0 / n_rows, 6) AS minority_pct,
    round(sqrt(minority / n_rows::DOUBLE * majority / n_rows), 6) AS g_mean, CASE WHEN majority / minority::DOUBLE > 100 THEN 'extreme' WHEN majority / minority::DOUBLE > 20 THEN 'severe'
    WHEN majority / minority::DOUBLE > 10 THEN 'moderate' WHEN majority / minority::DOUBLE > 3 THEN 'mild' ELSE 'balanced' END AS severity FROM s"""


@query("l01_imbalance", IMBALANCE)
def l01(spark, d):
    return rounded(S.imbalance(table(spark, d, "labels"), "toxic"))


@query("l02_imbalance_rules", f"""SELECT rule, round(imbalance_ratio, 6) AS measured, threshold FROM ({IMBALANCE}),
  (VALUES ('mild', 3::DOUBLE), ('moderate', 10), ('severe', 20), ('extreme', 100)) t(rule, threshold) WHERE imbalance_ratio > threshold""")
def l02(spark, d):
    return rounded(S.imbalance_rules(table(spark, d, "labels"), "toxic"))


@query("l03_undersample", f"""SELECT p_partkey, klass FROM (SELECT p_partkey, klass, row_number() OVER (PARTITION BY klass ORDER BY {order_hash('p_partkey')}, p_partkey) AS r FROM {PARTS})
  WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM {PARTS} GROUP BY klass))""")
def l03(spark, d):
    return S.undersample(parts(spark, d), "klass", ["p_partkey"]).select("p_partkey", "klass")


# Sizes after resampling are decided by the class counts; where the points lie is tested with planted data.
@query("l04_smote", f"SELECT klass, (SELECT max(n) FROM (SELECT count(*) AS n FROM {PARTS} GROUP BY klass)) AS n, (SELECT max(n) FROM (SELECT count(*) AS n FROM {PARTS} GROUP BY klass)) - count(*) AS synthetic FROM {PARTS} GROUP BY klass")
def l04(spark, d):
    out = S.smote(parts(spark, d), "p_partkey", "vec", "klass")
    return out.groupBy("klass").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("synthetic").cast("long")).alias("synthetic"))


@query("l04_smote_rows")
def l04b(spark, d):
    return S.smote(parts(spark, d), "p_partkey", "vec", "klass").where("synthetic")


@query("l05_borderline_smote_sizes", f"SELECT klass, (SELECT max(n) FROM (SELECT count(*) AS n FROM {PARTS} GROUP BY klass)) AS n FROM {PARTS} GROUP BY klass")
def l05b(spark, d):
    return S.borderline_smote(parts(spark, d), "p_partkey", "vec", "klass").groupBy("klass").agg(F.count(F.lit(1)).alias("n"))


@query("l05_borderline_smote")
def l05(spark, d):
    return S.borderline_smote(parts(spark, d), "p_partkey", "vec", "klass").where("synthetic")


@query("l06_adasyn", f"SELECT klass, (SELECT max(n) FROM (SELECT count(*) AS n FROM {PARTS} GROUP BY klass)) AS n FROM {PARTS} GROUP BY klass")
def l06(spark, d):
    return S.adasyn(parts(spark, d), "p_partkey", "vec", "klass").groupBy("klass").agg(F.count(F.lit(1)).alias("n"))


DIST = "(a.p_size - b.p_size) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice) + (a.brand_no - b.brand_no) * (a.brand_no - b.brand_no)"
LINKS = f"""p AS (SELECT * FROM {PARTS}), f AS (SELECT a.p_partkey AS a, a.klass AS ka, b.p_partkey AS b, b.klass AS kb,
  row_number() OVER (PARTITION BY a.p_partkey ORDER BY sqrt({DIST}), b.p_partkey) AS r FROM p a JOIN p b ON a.p_partkey <> b.p_partkey), n AS (SELECT * FROM f WHERE r = 1),
  l AS (SELECT x.a AS key_a, x.b AS key_b, x.ka AS label_a, x.kb AS label_b FROM n x JOIN n y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.ka <> x.kb)"""


@query("l07_tomek_links", f"WITH {LINKS} SELECT * FROM l")
def l07(spark, d):
    return S.tomek_links(parts(spark, d), "p_partkey", "vec", "klass")


@query("l07_remove_tomek", f"""WITH {LINKS} SELECT p_partkey, klass FROM p WHERE p_partkey NOT IN (SELECT CASE WHEN label_a = 'common' THEN key_a ELSE key_b END FROM l)""")
def l07b(spark, d):
    return S.remove_tomek(parts(spark, d), "p_partkey", "vec", "klass").select("p_partkey", "klass")


@query("l08_smote_enn")
def l08(spark, d):
    return S.smote_enn(parts(spark, d), "p_partkey", "vec", "klass").groupBy("klass").agg(F.count(F.lit(1)).alias("n"))


@query("l08_smote_tomek")
def l08b(spark, d):
    return S.smote_tomek(parts(spark, d), "p_partkey", "vec", "klass").groupBy("klass").agg(F.count(F.lit(1)).alias("n"))


@query("l08_edited_neighbours", f"""WITH p AS (SELECT * FROM {PARTS}), f AS (SELECT a.p_partkey, a.klass, b.klass AS kb, row_number() OVER (PARTITION BY a.p_partkey ORDER BY sqrt({DIST}), b.p_partkey) AS r
  FROM p a JOIN p b ON a.p_partkey <> b.p_partkey) SELECT p_partkey, klass FROM f WHERE r <= 3 GROUP BY 1, 2 HAVING bool_and(klass = kb)""")
def l08c(spark, d):
    return S.edited_neighbours(parts(spark, d), "p_partkey", "vec", "klass").select("p_partkey", "klass")


@query("l09_class_weights", f"SELECT klass, count(*) AS n, round((SELECT count(*) FROM part) / (2.0 * count(*)), 6) AS weight FROM {PARTS} GROUP BY klass")
def l09(spark, d):
    return rounded(S.class_weights(parts(spark, d), "klass"))


# ---- splits ----

@query("l10_random_split", f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {order_hash('o_orderkey')}, o_orderkey) <= ceil((SELECT count(*) FROM orders) * 0.2) THEN 'test' ELSE 'train' END AS part FROM orders""")
def l10(spark, d):
    return S.random_split(table(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "part")


@query("l11_stratified_split", f"""SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {order_hash('o_orderkey')}, o_orderkey)
  <= round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) THEN 'test' ELSE 'train' END AS part FROM orders""")
def l11(spark, d):
    return S.stratified_split(table(spark, d, "orders"), "o_orderstatus", ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "part")


TIME_RANK = f"row_number() OVER (ORDER BY o_orderdate, {order_hash('o_orderkey')}, o_orderkey)"


@query("l12_time_split", f"SELECT o_orderkey, CASE WHEN {TIME_RANK} > floor((SELECT count(*) FROM orders) * 0.8) THEN 'test' ELSE 'train' END AS part FROM orders")
def l12(spark, d):
    return S.time_split(table(spark, d, "orders"), "o_orderdate", ["o_orderkey"]).select("o_orderkey", "part")


@query("l13_group_split", f"SELECT o_orderkey, o_custkey, CASE WHEN ('0x' || substr({order_hash('o_custkey')}, 1, 8))::BIGINT / pow(16, 8) < 0.2 THEN 'test' ELSE 'train' END AS part FROM orders")
def l13(spark, d):
    return S.group_split(table(spark, d, "orders"), "o_custkey").select("o_orderkey", "o_custkey", "part")


@query("l14_stratified_folds", f"SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {order_hash('o_orderkey')}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def l14(spark, d):
    return S.stratified_folds(table(spark, d, "orders"), "o_orderstatus", ["o_orderkey"]).select("o_orderkey", "fold")


@query("l15_expanding_folds", f"""WITH r AS (SELECT o_orderkey, {TIME_RANK} AS k, (SELECT count(*) FROM orders) AS n FROM orders), b AS (SELECT *, n // 4 AS s FROM r)
  SELECT fold::INTEGER AS fold, part, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT o_orderkey, i AS fold, CASE WHEN k <= n - (3 - i) * s THEN 'train' WHEN k <= n - (3 - i) * s + s THEN 'test' END AS part
    FROM b, range(3) t(i)) WHERE part IS NOT NULL GROUP BY 1, 2""")
def l15(spark, d):
    return S.expanding_folds(table(spark, d, "orders"), "o_orderdate", ["o_orderkey"], 3).groupBy("fold", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


# ---- models ----

def labelled(spark, d):
    """A learnable class on lineitem: price per unit high or low."""
    li = table(spark, d, "lineitem")
    return li.withColumn("label", F.when(F.col("l_extendedprice") > 2000 * F.col("l_quantity"), "high").otherwise("low")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "label")


FEATURES = ["l_quantity", "l_extendedprice"]


def fitted(spark, d, *names, **params):
    data = S.group_split(labelled(spark, d), "l_orderkey").select(*FEATURES, "label", "part").cache()          # no more than the models read
    train, test = data.where(F.col("part") == "train"), data.where(F.col("part") == "test")
    out = None
    for n in names:
        scores = L.train_and_score(train, test, FEATURES, "label", n, **params.get(n, {}))
        out = scores if out is None else out.unionByName(scores)
    return out


@query("l16_tree_models")
def l16(spark, d):
    return fitted(spark, d, "decision_tree", "random_forest", "gradient_boosting")


@query("l17_logistic_and_bayes")
def l17(spark, d):
    return fitted(spark, d, "logistic_regression", "naive_bayes")


@query("l17_bayes_statistics", union_sql([f"""SELECT klass AS class, '{c}' AS "column", round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 6) AS prior, round(avg({c}), 4) AS mean, round(var_pop({c}), 4) AS variance
  FROM {PARTS} GROUP BY klass""" for c in PART_FEATURES]))
def l17b(spark, d):
    out = L.naive_bayes_statistics(parts(spark, d), PART_FEATURES, "klass")
    return out.select("class", "column", F.round("prior", 6).alias("prior"), F.round("mean", 4).alias("mean"), F.round("variance", 4).alias("variance"))


@query("l18_linear_svm")
def l18(spark, d):
    return fitted(spark, d, "svm")


@query("l19_knn_classify", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), n AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS r
  FROM v a JOIN v b ON b.vec_id % 4 <> 0 WHERE a.vec_id % 4 = 0), c AS (SELECT vec_id, label, count(*) AS n FROM n WHERE r <= 5 GROUP BY 1, 2)
  SELECT vec_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS k FROM c) WHERE k = 1""")
def l19(spark, d):
    v = vectors(spark, d)
    return L.knn_classify(v.where(F.col("vec_id") % 4 != 0), v.where(F.col("vec_id") % 4 == 0), "vec_id", "vec", "label")


@query("l18_kernel_svm")
def l18k(spark, d):
    data = S.group_split(labelled(spark, d).withColumns({c: F.col(c) / F.lit(by) for c, by in (("l_quantity", 10.0), ("l_extendedprice", 20000.0))}), "l_orderkey")
    machine = kernel_machine(data.where(F.col("part") == "train"), FEATURES, "label", ["l_orderkey", "l_linenumber"], components=64, max_iter=20)
    scored = machine.score(data.where(F.col("part") == "test"))
    return scored.agg(F.count(F.lit(1)).alias("n_test"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


PLACES = "(SELECT c_custkey, list_value(round(c_acctbal), c_nationkey * 40)::DOUBLE[] AS e FROM customer)"


@query("l19_nearest_by_pivots", f"""SELECT c_custkey, neighbour, rank::INTEGER AS rank, round(distance, 6) AS distance FROM (SELECT a.c_custkey, b.c_custkey AS neighbour, list_distance(a.e, b.e) AS distance,
  row_number() OVER (PARTITION BY a.c_custkey ORDER BY list_distance(a.e, b.e), b.c_custkey) AS rank FROM {PLACES} a JOIN {PLACES} b ON a.c_custkey <> b.c_custkey) WHERE rank <= 4""")
def l19p(spark, d):
    places = table(spark, d, "customer").select("c_custkey", F.array(F.round("c_acctbal"), (F.col("c_nationkey") * 40).cast("double")).alias("vec"))
    return rounded(nearest(places, places, "c_custkey", "vec", 4, exclude_self=True, small_bytes=0)).select("c_custkey", "neighbour", "rank", "distance")


@query("l20_majority_baseline", """SELECT o_orderkey, (SELECT o_orderpriority FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS prediction FROM orders WHERE o_custkey % 2 = 1""")
def l20(spark, d):
    o = table(spark, d, "orders")
    return E.majority_baseline(o.where(F.col("o_custkey") % 2 == 0), o.where(F.col("o_custkey") % 2 == 1), "o_orderpriority").select("o_orderkey", "prediction")


@query("l20_random_baseline", """SELECT o_orderkey, (SELECT list(p ORDER BY p) FROM (SELECT DISTINCT o_orderpriority AS p FROM orders))[('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), 1, 8))::BIGINT % 5 + 1] AS prediction FROM orders""")
def l20b(spark, d):
    o = table(spark, d, "orders")
    return E.random_baseline(o, o, "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "prediction")


# ---- metrics on label l_returnflag against guess (never 'N'), and on the binary label ----

CELLS = f"""cells AS (SELECT l.v AS label, p.v AS prediction, (SELECT count(*) FROM {SCORED} s WHERE s.l_returnflag = l.v AND s.guess = p.v) AS n
  FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem) l CROSS JOIN (SELECT DISTINCT l_returnflag AS v FROM lineitem) p)"""
REPORT = f"""{CELLS}, s AS (SELECT label AS class, sum(n)::DOUBLE AS support, sum(n) FILTER (label = prediction)::DOUBLE AS tp FROM cells GROUP BY 1), g AS (SELECT prediction AS class, sum(n)::DOUBLE AS predicted FROM cells GROUP BY 1),
  c AS (SELECT class, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, support FROM s JOIN g USING (class)),
  r AS (SELECT class, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support FROM c)"""


@query("l21_confusion_matrix", f"WITH {CELLS} SELECT * FROM cells")
def l21(spark, d):
    return E.confusion_matrix(scored(spark, d), "l_returnflag", "guess")


@query("l22_classification_scores", f"""WITH {REPORT} SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision,
  round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1_score FROM r""")
def l22(spark, d):
    return rounded(E.classification_scores(scored(spark, d), "l_returnflag", "guess"))


@query("l23_agreement_scores", f"""WITH {CELLS}, t AS (SELECT label AS k, sum(n)::DOUBLE AS t, sum(n) FILTER (label = prediction)::DOUBLE AS c FROM cells GROUP BY 1), p AS (SELECT prediction AS k, sum(n)::DOUBLE AS p FROM cells GROUP BY 1),
  x AS (SELECT sum(t) AS s, sum(c) AS c, sum(t * p) AS tp, sum(t * t) AS tt, sum(p * p) AS pp FROM t JOIN p USING (k))
  SELECT round((c / s - tp / (s * s)) / (1 - tp / (s * s)), 6) AS cohen_kappa, round((c * s - tp) / sqrt((s * s - pp) * (s * s - tt)), 6) AS matthews_corrcoef FROM x""")
def l23(spark, d):
    return rounded(E.agreement_scores(scored(spark, d), "l_returnflag", "guess"))


@query("l24_log_loss", f"SELECT round(avg(CASE WHEN label = 1 THEN -ln(greatest(score, 2.220446049250313e-16)) ELSE -ln(greatest(1 - score, 2.220446049250313e-16)) END), 6) AS log_loss FROM {SCORED}")
def l24(spark, d):
    return rounded(E.log_loss(scored(spark, d), "label", "score"))


@query("l25_roc_auc", f"""WITH r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM {SCORED}),
  s AS (SELECT sum(r) FILTER (label = 1)::DOUBLE AS sr, count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS n FROM r) SELECT round((sr - p * (p + 1) / 2) / (p * n), 6) AS roc_auc FROM s""")
def l25(spark, d):
    return rounded(E.roc_auc(scored(spark, d), "label", "score"))


@query("l25_roc_auc_multiclass", f"""WITH t AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, [score, l_tax2, 1 - score] AS p FROM (SELECT *, (predicted / 100000.0) AS l_tax2 FROM {SCORED})),
  u AS (SELECT c, CASE WHEN y = c THEN 1 ELSE 0 END AS hit, p[c + 1] AS s FROM t, range(3) g(c)),
  r AS (SELECT c, hit, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2.0 AS r FROM u),
  a AS (SELECT c, count(*) FILTER (hit = 1)::DOUBLE AS p, count(*) FILTER (hit = 0)::DOUBLE AS n, sum(r) FILTER (hit = 1)::DOUBLE AS sr FROM r GROUP BY c)
  SELECT round(sum((sr - p * (p + 1) / 2) / (p * n) * p) / sum(p), 6) AS roc_auc FROM a""")
def l25b(spark, d):
    s = scored(spark, d)
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return rounded(E.roc_auc_multiclass(s.select(y.alias("y"), F.array(F.col("score"), F.col("predicted") / 100000.0, 1 - F.col("score")).alias("p")), "y", "p"))


@query("l26_average_precision", f"""WITH g AS (SELECT score, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM {SCORED} GROUP BY 1), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k, sum(p) OVER () AS t FROM g)
  SELECT round(sum(p / t * tp / k), 6) AS average_precision FROM c""")
def l26(spark, d):
    return rounded(E.average_precision(scored(spark, d), "label", "score"))


@query("l27_class_report", f"""WITH {REPORT} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM r
  UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM r
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM r""")
def l27(spark, d):
    return rounded(E.class_report(scored(spark, d), "l_returnflag", "guess"))


@query("l28_geometric_mean", f"""SELECT round(sqrt(avg(CASE WHEN prediction = 1 THEN 1.0 ELSE 0.0 END) FILTER (label = 1) * avg(CASE WHEN prediction = 0 THEN 1.0 ELSE 0.0 END) FILTER (label = 0)), 6) AS g_mean FROM {SCORED}""")
def l28(spark, d):
    return rounded(E.geometric_mean_recall(scored(spark, d), "label", "prediction"))


@query("l29_regression_scores", f"SELECT round(sqrt(avg((predicted - actual) * (predicted - actual))), 4) AS rmse, round(avg(abs(predicted - actual)), 4) AS mae, round(1 - avg((predicted - actual) * (predicted - actual)) / var_pop(actual), 4) AS r2 FROM {SCORED}")
def l29(spark, d):
    return rounded(E.regression_scores(scored(spark, d), "actual", "predicted"), 4)


@query("l30_cross_validation")
def l30(spark, d):
    data = table(spark, d, "orders").withColumn("label", (F.col("o_totalprice") > 150 * F.col("o_custkey")).cast("int"))
    return L.cross_validate(data, ["o_totalprice", "o_custkey"], "label", ["o_orderkey"], "decision_tree", folds=5)


@query("l31_shuffled_target_test")
def l31(spark, d):
    data = table(spark, d, "orders").withColumn("label", (F.col("o_totalprice") > 150 * F.col("o_custkey")).cast("int"))
    return L.shuffled_target_test(data, ["o_totalprice", "o_custkey"], "label", ["o_orderkey"])


@query("l32_association", """SELECT "column", round(r, 6) AS abs_correlation, r > 0.5 AS high FROM (SELECT 'l_quantity' AS "column", abs(corr(l_quantity, t)) AS r FROM (SELECT *, l_quantity + l_linenumber AS t FROM lineitem)
  UNION ALL SELECT 'l_linenumber', abs(corr(l_linenumber, t)) FROM (SELECT *, l_quantity + l_linenumber AS t FROM lineitem)
  UNION ALL SELECT 'l_tax', abs(corr(l_tax, t)) FROM (SELECT *, l_quantity + l_linenumber AS t FROM lineitem)) ORDER BY r DESC LIMIT 2""")
def l32(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_linenumber", "l_tax", (F.col("l_quantity") + F.col("l_linenumber")).alias("t"))
    return rounded(L.association_analysis(li, "t", 2))


MODEL_RUNS = """(SELECT o_orderpriority AS experiment, 'model' || (o_custkey % 7)::VARCHAR AS model, avg(o_totalprice) / 500000 AS cv_mean, count(*)::DOUBLE AS seconds FROM orders GROUP BY 1, 2)"""


def model_runs(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("experiment"), F.concat(F.lit("model"), (F.col("o_custkey") % 7).cast("string")).alias("model")).agg(
        (F.avg("o_totalprice") / 500000).alias("cv_mean"), F.count(F.lit(1)).cast("double").alias("seconds"))


@query("l33_sanity_flags", f"""SELECT model, round(a, 6) AS accuracy, CASE WHEN a < 0.5 THEN 'low' WHEN a > 0.95 THEN 'suspicious' ELSE 'ok' END AS verdict FROM (SELECT experiment || '/' || model AS model, cv_mean * 1.9 AS a FROM {MODEL_RUNS})""")
def l33(spark, d):
    runs = model_runs(spark, d).select(F.concat_ws("/", "experiment", "model").alias("model"), (F.col("cv_mean") * 1.9).alias("accuracy"))
    return rounded(E.sanity_flags(runs, "model", "accuracy"))


@query("l34_experiment_summary", f"""SELECT experiment, array_to_string(list(model ORDER BY model), ',') AS models_trained, sum(seconds) AS total_training_time, arg_max(model, cv_mean) AS best_model, round(max(cv_mean), 6) AS best_score
  FROM {MODEL_RUNS} GROUP BY 1""")
def l34(spark, d):
    return rounded(E.experiment_summary(model_runs(spark, d), "experiment", "model", "cv_mean", "seconds"))


@query("l35_record_hash", "SELECT o_orderkey, md5(concat_ws('|', 'o_custkey=' || o_custkey, 'o_orderkey=' || o_orderkey, 'o_orderstatus=' || o_orderstatus)) AS record_hash FROM orders")
def l35(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", E.record_hash(o, ["o_orderstatus", "o_orderkey", "o_custkey"]).alias("record_hash"))


def period_metric(name, expr):
    v = lambda p: f"(SELECT {expr} FROM {SCORED} WHERE period = '{p}')"
    return f"SELECT '{name}' AS metric, round({v('first')}, 4) AS base_value, round({v('second')}, 4) AS other_value, round({v('second')} - {v('first')}, 4) AS delta"


@query("l36_compare_periods", union_sql([period_metric("rmse", "sqrt(avg((predicted - actual) * (predicted - actual)))"), period_metric("mae", "avg(abs(predicted - actual))"),
                                         period_metric("r2", "1 - avg((predicted - actual) * (predicted - actual)) / var_pop(actual)")]))
def l36(spark, d):
    return rounded(E.compare_periods(scored(spark, d), "actual", "predicted", "period", "first", "second"), 4)


@query("l36_compare_accuracy", f"SELECT period, count(*) AS n, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {SCORED} GROUP BY 1")
def l36b(spark, d):
    return rounded(E.compare_accuracy(scored(spark, d), "label", "prediction", "period"))
