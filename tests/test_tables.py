"""Fixtures with planted defects: contracts, drift, edge cases, round trips."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import features as T, governance as G, metrics as E, missing as M, models as L, profile as P, quality as Q, runlog as W, sampling as S, schema as C
from tallyglass.functions.expressions import null_free_floats
from tallyglass.session import fresh_path
from tallyglass.sources import readers as R, tables as B


@pytest.fixture(scope="module")
def contract_rows(spark):
    return spark.createDataFrame([(1, "a", 0.5, "A"), (2, "b", 0.1, "B"), (3, None, 0.2, "C"), (4, "d", 0.3, "D"), (1, "e", 0.4, "A"), (6, "f", 0.6, "B")],
                                 "id long, name string, unexpected_column double, category string")


RULES = {"id": {"unique": True}, "name": {"max_missing": 0.1}, "category": {"enum": ["A", "B", "C"]}, "value": {}}


def test_contract_defects_are_found(contract_rows):
    got = {(r["column"], r["rule"]): r["exceeded"] for r in C.enforce_contract(contract_rows, RULES).collect()}
    assert got == {("id", "unique"): True, ("name", "max_missing"): True, ("category", "enum"): True, ("value", "present"): True}
    check = C.schema_check(["id", "name", "value", "category"], contract_rows).first()
    assert (check["status"], check["missing_columns"], check["extra_columns"]) == ("fail", "value", "unexpected_column")
    assert C.schema_check(contract_rows.columns, contract_rows).first()["status"] == "pass"
    relaxed = C.enforce_contract(contract_rows, {"name": {"max_missing": 0.2}}).first()
    assert not relaxed["exceeded"]


def test_checks_are_idempotent(contract_rows):
    once, twice = (sorted(map(str, Q.quality_report(contract_rows, ["id"]).collect())) for _ in range(2))
    assert once == twice


def test_constant_columns(spark):
    df = spark.range(100).select(F.lit(0.1).alias("k"), (F.col("id") * 0.1).alias("v"), F.when(F.col("id") > 1000, 1.0).alias("empty")).repartition(8)
    assert P.correlation_pairs(df).where("correlation is not null").count() == 0
    assert {r["column"] for r in T.variances(df).where("removed").collect()} == {"k", "empty"}
    assert P.histogram(df, "k").agg(F.sum("n")).first()[0] == 100
    assert P.distribution_report(df).where("column = 'k'").first()["outlier_count"] == 0


def test_nan_counts_as_missing_after_loading(spark):
    df = null_free_floats(spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double"))
    assert P.null_counts(df).first()["null_count"] == 2


def test_no_drift_between_samples_of_one_law(spark):
    # two samples of different size from one hash-driven distribution
    draw = lambda n, s: spark.range(n).select((F.pmod(F.xxhash64("id", F.lit(s)), F.lit(100000)) / 1000.0).alias("u"), F.concat(F.lit("c"), F.pmod(F.xxhash64("id", F.lit(s + 1)), F.lit(4)).cast("string")).alias("k"))
    report = Q.drift_report(draw(500, 1), draw(1000, 9), ["u"], ["k"])
    assert not Q.dataset_drift(report).first()["dataset_drift"] and report.where("drifted").count() == 0
    shifted = Q.drift_report(draw(500, 1).withColumn("u", F.col("u") + 30), draw(1000, 9), ["u"], ["k"])
    assert [r["column"] for r in shifted.where("drifted").collect()] == ["u"]


def test_missing_mechanism_verdicts(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 10).cast("double").alias("b"))
    assert M.missing_mechanism(df).first()["pattern"] == "NO_MISSING"
    assert M.missing_mechanism(df.withColumn("b", F.when(F.col("a") > 20, F.col("b")))).first()["pattern"] == "MCAR"
    assert M.missing_mechanism(df.withColumn("b", F.when(F.col("a") > 400, F.col("b")))).first()["pattern"] == "MAR"


def test_datetime_text_with_offsets(spark):
    df = spark.createDataFrame([("2023-01-01T10:00:00+00:00",), ("2023-01-02 11:00:00",), ("2023-01-03T12:00:00Z",), ("2023-01-04T13:00:00+05:00",)], "t string")
    assert C.infer_types(df).first()["inferred_type"] == "datetime"
    hours = [r["t_hour"] for r in T.datetime_parts(df, ["t"], cyclical=False).orderBy("t").collect()]
    assert hours == [10, 11, 12, 8]


def test_pattern_order(spark):
    df = spark.createDataFrame([("10.0.0.1", "12345", "550e8400-e29b-41d4-a716-446655440000", "a@b.org", "01/02/2023")] * 3, "ip string, zip string, u string, mail string, day string")
    got = {r["column"]: r["pattern"] for r in C.detect_patterns(df).collect()}
    assert got == {"ip": "phone", "zip": "phone", "u": "uuid", "mail": "email", "day": "date"}


def test_text_edge_cases(spark):
    texts = ["", "   ", "naïve café", "漢字 data", "🙂 what", "<script>x</script>keep", "x" * 30000 + " tail@mail.org", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    clean = {r["id"]: r["c"] for r in df.select("id", G.clean_text(F.col("text")).alias("c")).collect()}
    assert clean[5] == "keep" and clean[7] == "" and clean[1] == "" and len(clean[6]) > 30000
    hit = G.detect_pii(df, "id", "text").collect()
    assert [(r["id"], r["value"], r["stop"]) for r in hit] == [(6, "tail@mail.org", 30014)]
    assert P.value_counts(df, "text").count() == 7


def test_key_sentences(spark):
    text = "Nothing here. Load the data and run the model! Also this? Why create a task."
    got = spark.createDataFrame([(text,), ("Short one. Two.",)], "t string").select(G.key_sentences(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in got] == ["Load the data and run the model. Why create a task.", "Short one. Two."]


def test_high_cardinality_goes_to_hashing(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("code"), (F.col("id") % 2).alias("y"))
    assert T.encoding_choice(df, ["code"], "y").first()["method"] == "hash"
    out = T.encode_auto(df, ["code"], "y")
    assert out.select(sum([F.abs(F.col(f"code_hash_{i}")) for i in range(10)]).alias("s")).distinct().collect()[0]["s"] == 1.0
    with pytest.raises(ValueError):
        T.categories(df, "code", 100)


def test_quantile_bins_with_repeated_edges(spark):
    df = spark.createDataFrame([(0.0,)] * 80 + [(float(i),) for i in range(1, 21)], "v double")
    got = {r["bin"]: r["n"] for r in T.bin_balance(T.quantile_bins(df, ["v"]), "v_binned").collect()}
    assert sum(got.values()) == 100 and all(b.startswith("Q") for b in got)


def test_boxcox_search_finds_the_best_power(spark):
    df = spark.range(1, 2000).select(F.pow(F.lit(10.0) + F.col("id") / 100.0, F.lit(2.0)).alias("v"))
    got = T.boxcox_lambda(df, "v")
    x = [r["v"] for r in df.collect()]
    import numpy as np
    x = np.array(x)
    fit = lambda g: (g - 1) * np.log(x).sum() - len(x) / 2 * np.log((np.log(x) if abs(g) < 1e-12 else (x ** g - 1) / g).var())
    grid = np.linspace(-2, 3, 501)
    assert got == pytest.approx(grid[np.argmax([fit(g) for g in grid])], abs=0.02)


def test_pipeline_gives_the_same_rows_after_reload(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None), (5.0, "it's")], "x double, k string")
    model = T.feature_pipeline(df)
    path = T.save_pipeline(model, fresh_path(spark, "model"))
    assert [str(r["features"]) for r in model.transform(df).collect()] == [str(r["features"]) for r in T.run_pipeline(path, df).collect()]


def test_vif_of_collinear_columns_is_infinite(spark):
    df = spark.range(50).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    assert all(r["vif"] == float("inf") and r["level"] == "severe" for r in T.vif(df).collect())


def test_baselines(spark, folder):
    root = fresh_path(spark, "b")
    assert B.list_baselines(spark, root).count() == 0
    df = spark.read.parquet(f"{folder}/customer.parquet")
    first = B.save_baseline(df, root, "c_acctbal")
    assert B.save_baseline(df.repartition(5), root, "c_acctbal") == first and B.save_baseline(df.limit(5), root) != first
    assert B.list_baselines(spark, root).count() == 2
    assert B.delete_baseline(spark, root, first) and B.list_baselines(spark, root).count() == 1


def test_snapshots_are_immutable(spark, folder):
    path = fresh_path(spark, "m")
    for _ in range(2):
        B.append_snapshots(B.snapshot_files(spark, folder, glob="*.parquet"), path)
    assert spark.read.parquet(path).count() == 14


def test_unknown_formats_are_refused(spark):
    for bad in (lambda: R.load_table(spark, "x.xlsx"), lambda: R.load_table(spark, "x", "xml"), lambda: R.read_stream(spark, R.StreamSource("s", "e", protocol="mqtt"))):
        with pytest.raises(ValueError):
            bad()


def test_sample_of_a_large_table_equals_the_plain_one(spark):
    df = spark.range(40000)
    got = {r["id"] for r in R.seeded_sample(df, 100, ["id"]).collect()}
    from tallyglass.functions.ranking import hash_order
    assert got == {r["id"] for r in df.orderBy(hash_order(["id"])).limit(100).collect()}


def test_splits_keep_groups_and_shares(spark):
    df = spark.range(1000).select("id", (F.col("id") % 50).alias("g"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("y"))
    both = S.group_split(df, "g").groupBy("g").agg(F.count_distinct("part").alias("n"))
    assert both.where("n > 1").count() == 0
    assert S.random_split(df, ["id"], 0.25).where("part = 'test'").count() == 250
    share = S.stratified_split(df, "y", ["id"], 0.2).where("part = 'test'").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in share} == {"hot": 67, "cold": 133}


def cycle_tasks(spark):
    edges = {"a": ["b"], "b": ["c"], "c": ["a"], "d": ["a"], "e": ["d", "zzz"], "f": ["f"], "g": ["e"], "h": [], "i": ["j", "h"], "j": ["i", "a"], "k": ["i"]}
    rows = [(run, t, needs) for run in ("r1", "r2") for t, needs in edges.items() if not (run == "r2" and t in ("c", "f"))]
    return spark.createDataFrame(rows, "run_id string, task_id string, depends_on array<string>")


def test_cycles(spark):
    got = {(r["run_id"], r["task_id"]) for r in W.cycle_members(cycle_tasks(spark)).collect()}
    assert got == {("r1", t) for t in "abcfij"} | {("r2", "i"), ("r2", "j")}


@pytest.mark.parametrize("few", [0, 32])
def test_cycles_of_random_graphs_against_plain_walks(spark, few, monkeypatch):
    import random

    monkeypatch.setattr(W, "FEW_EDGES", few)
    monkeypatch.setattr(W, "PLAIN_ROUNDS", 1 + few // 4)

    r, rows, want = random.Random(1), [], set()
    for run in range(25):
        n = r.randint(1, 14)
        needs = {t: {r.randrange(n + 2) for _ in range(r.choice([0, 1, 1, 1, 1, 2, 3]))} for t in range(n)}
        rows += [(run, t, sorted(d)) for t, d in needs.items()]
        for t in needs:
            seen, todo = set(), list(needs[t])
            while todo:
                x = todo.pop()
                if x in needs and x not in seen:
                    seen.add(x)
                    todo += needs[x]
            if t in seen:
                want.add((run, t))
    tasks = spark.createDataFrame(rows, "run_id long, task_id long, depends_on array<long>")
    assert {(x["run_id"], x["task_id"]) for x in W.cycle_members(tasks).collect()} == want and want


def test_long_chain_and_long_circle(spark):
    """A chain of 50,000 tasks and a circle of 5,000: rounds grow with the digits of their length, not with it."""
    chain = spark.range(50_000).select(F.lit(1).alias("run_id"), F.col("id").alias("task_id"), F.array(F.col("id") + 1).alias("depends_on"))
    circle = spark.range(5_000).select(F.lit(2).alias("run_id"), F.col("id").alias("task_id"), F.array((F.col("id") + 1) % 5_000).alias("depends_on"))
    found = W.cycle_members(chain.union(circle))
    assert found.count() == 5_000 and found.where("run_id = 1").isEmpty()


def test_planted_run_log(spark):
    now = datetime(2024, 1, 1, 12)
    at = lambda minutes: datetime(2024, 1, 1, 12 - (minutes // 60 + (minutes % 60 > 0)), (60 - minutes % 60) % 60)
    runs = spark.createDataFrame([("stuck", "running", at(90), at(90)), ("fine", "RUNNING", at(5), at(1))], "run_id string, status string, created_at timestamp, updated_at timestamp")
    tasks = spark.createDataFrame(
        [("stuck", "t1", "PENDING", at(90), at(60), []), ("stuck", "t2", "queued", at(90), at(61), ["t1"]), ("fine", "u1", "COMPLETED", at(5), at(4), []),
         ("fine", "u2", "PENDING", at(13), at(2), ["u1"]), ("fine", "u3", "PENDING", at(16), at(2), ["gone"]), ("fine", "u4", "RUNNING", at(25), at(1), [])],
        "run_id string, task_id string, status string, created_at timestamp, updated_at timestamp, depends_on array<string>")
    assert [r["run_id"] for r in W.deadlocked_runs(runs, tasks, now).collect()] == ["stuck"]
    assert [r["run_id"] for r in W.stale_runs(runs, now).collect()] == ["stuck"]
    assert [r["task_id"] for r in W.orphaned_tasks(runs, tasks).collect()] == ["u3"]
    assert {r["task_id"] for r in W.ready_tasks(tasks).collect()} == {"t1", "u2"}
    severity = {r["resource_id"]: r["severity"] for r in W.sla_violations(tasks, runs, now).collect()}
    assert (severity["fine/u2"], severity["fine/u3"], severity["fine/u4"], severity["stuck"]) == ("medium", "high", "critical", "high")


def test_metrics_of_extreme_predictions(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "y int, p double")
    assert E.roc_auc(df, "y", "p").first()[0] == 1.0 and E.average_precision(df, "y", "p").first()[0] == 1.0
    ties = df.withColumn("p", F.lit(0.5))
    assert E.roc_auc(ties, "y", "p").first()[0] == 0.5 and E.average_precision(ties, "y", "p").first()[0] == 0.5
    never = df.withColumn("c", F.lit(0))
    assert E.geometric_mean_recall(never, "y", "c").first()[0] == 0.0 and E.agreement_scores(never, "y", "c").first()["cohen_kappa"] == 0.0


def test_models_learn_an_easy_class(spark):
    df = spark.range(600).select("id", (F.col("id") % 30).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    df = df.withColumn("y", F.when(F.col("a") < 10, "low").when(F.col("a") < 20, "mid").otherwise("high"))
    parts = S.stratified_split(df, "y", ["id"])
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    for name, floor in (("decision_tree", 0.95), ("gradient_boosting", 0.95), ("naive_bayes", 0.85), ("svm", 0.6)):
        options = {"maxIter": 5} if name in ("gradient_boosting",) else {}
        assert L.train_and_score(train, test, ["a", "b"], "y", name, **options).first()["accuracy"] >= floor
    assert not L.shuffled_target_test(df, ["a", "b"], "y", ["id"]).first()["leakage_detected"]


def test_variance_inflation_of_dependent_columns_only():
    import numpy as np
    from tallyglass.functions.smallmath import variance_inflation

    r = np.random.default_rng(0)
    a, b, c, e = r.normal(size=(4, 500))
    d = c + 0.1 * e
    made = variance_inflation(np.corrcoef([a, 2 * a, b, c, d]))
    assert made[0] == made[1] == float("inf")
    assert np.allclose(made[2:], np.diag(np.linalg.inv(np.corrcoef([a, b, c, d])))[1:])


def test_drift_verdict_does_not_depend_on_the_number_of_rows(spark):
    from pyspark.sql import functions as F
    from tallyglass.operators import quality as Q

    for rule in ("effect", "p_value"):
        verdicts = []
        for n in (1000, 1001):
            base = spark.range(n).select((F.col("id") / n).alias("x"))
            moved = base.select((F.col("x") + 0.05).alias("x"))
            verdicts.append(Q.numeric_drift(moved, base, ["x"], rule=rule).first()["drifted"])
        assert verdicts[0] == verdicts[1]


def test_knn_imputation_of_forty_columns(spark):
    from pyspark.sql import functions as F
    from tallyglass.operators.imputation import impute_knn

    cols = [f"c{i}" for i in range(40)]
    rows = spark.range(30).select("id", *[F.when((F.col("id") != 3) | (F.lit(i) != 35), F.col("id") + i).cast("double").alias(c) for i, c in enumerate(cols)])
    assert impute_knn(rows, "id", cols, 2).where("id = 3").first()["c35"] == 38.0


def test_too_many_interactions_are_an_error(spark):
    from tallyglass.operators.features import interactions

    df = spark.createDataFrame([tuple(range(20))], [f"c{i}" for i in range(20)])
    assert len(interactions(df).columns) == 20 + 190
    with pytest.raises(ValueError):
        interactions(df, most=100)


def test_package_reaches_workers_from_any_folder(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from tallyglass import build_session
from tallyglass.operators.sampling import smote
spark = build_session("ship", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
rows = spark.range(60).selectExpr("id", "if(id < 10, 'a', 'b') AS k", "array(double(id), double(id % 7)) AS v")
print("MADE", smote(rows, "id", "v", "k").where("k = 'a'").count())
"""
    made = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300)
    assert "MADE 50" in made.stdout, made.stderr[-2000:]


def test_fitted_steps_apply_what_the_first_table_taught(spark):
    from tallyglass.operators.fitted import FittedSteps, Step, fit_steps

    train = spark.createDataFrame([(float(i), "ab"[i % 2], float(i % 2)) for i in range(200)] + [(5.0, "z", 1.0), (None, None, None)], "x double, k string, y double")
    steps = [Step("impute", "x"), Step("log", "x"), Step("boxcox", "x"), Step("scale", "x", {"method": "minmax"}), Step("bins", "x", {"bins": 4}), Step("target", "k", {"target": "y"}),
             Step("rare", "k", {"limit": 0.1}), Step("label", "k"), Step("hash", "k", {"width": 4})]
    fitted = FittedSteps.load(spark, fit_steps(train, steps).save(fresh_path(spark, "steps")))
    new = spark.createDataFrame([(None, "a"), (398.0, "z"), (-10.0, "new"), (0.0, None)], "x double, k string")
    a, z, unknown, empty = sorted(fitted.transform(new).collect(), key=lambda r: ["a", "__OTHER__", "__OTHER__", None].index(r["k"]) if r["x"] != -10.0 else 2)
    assert a["x"] == 99.0 and a["k_target_encoded"] == 0.0 and a["k"] == "a"
    assert z["x_scaled"] == 2.0 and z["x_binned"] == "Q4" and z["k"] == "__OTHER__" and z["k_target_encoded"] == 1.0
    assert unknown["x_log"] is None and unknown["x_boxcox"] is None and unknown["x_binned"] == "Q1" and abs(unknown["k_target_encoded"] - 101 / 201) < 1e-9
    assert empty["k"] is None and empty["k_code"] is None and sum(abs(empty[f"k_hash_{i}"]) for i in range(4)) == 1.0
    with pytest.raises(ValueError):
        Step("guess", "x")
