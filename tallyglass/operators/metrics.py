"""Evaluation metrics as aggregations; ranked metrics work on distinct scores, never on one global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.functions.expressions import dbl, one, ratio, union_all
from tallyglass.functions.ranking import hash_rank, running_totals


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """label, prediction, n for every pair of classes, zero cells included."""
    cells = df.groupBy(F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))
    # From here on: classes x classes rows.
    classes = F.array_sort(F.array_union(F.collect_set("label"), F.collect_set("prediction")))
    grid = cells.agg(classes.alias("c")).select(F.explode("c").alias("label"), "c").select("label", F.explode("c").alias("prediction"))
    return grid.join(cells, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """class, precision, recall, f1, support: one row per class, then 'macro avg' and 'weighted avg'."""
    cells = confusion_matrix(df, label, prediction)
    n = F.col("n")
    right = F.sum(F.when(F.col("label") == F.col("prediction"), n).otherwise(0))
    by_label = cells.groupBy(F.col("label").alias("class")).agg(right.alias("tp"), F.sum("n").alias("support"))
    by_prediction = cells.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"))
    p, r = ratio(F.col("tp"), F.col("predicted"), 0.0), ratio(F.col("tp"), F.col("support"), 0.0)
    rows = by_label.join(by_prediction, "class").select("class", p.alias("precision"), r.alias("recall"), "support").withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))
    rows = rows.select("class", "precision", "recall", "f1", "support")
    names = ["precision", "recall", "f1"]
    macro = rows.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *names, "support")
    weighted = rows.agg(*[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"), 0.0).alias(c) for c in names], F.sum("support").alias("support"))
    return union_all([rows, macro, weighted.select(F.lit("weighted avg").alias("class"), *names, "support")])


def classification_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """accuracy and weighted precision, recall, f1."""
    weighted = class_report(df, label, prediction).where(F.col("class") == "weighted avg")
    return weighted.select(F.col("recall").alias("accuracy"), "precision", "recall", F.col("f1").alias("f1_score"))


def agreement_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """cohen_kappa and matthews_corrcoef over any number of classes."""
    cells = confusion_matrix(df, label, prediction)
    n = F.col("n").cast("double")
    t = cells.groupBy(F.col("label").alias("class")).agg(F.sum(n).alias("t"), F.sum(F.when(F.col("label") == F.col("prediction"), n).otherwise(0.0)).alias("d"))
    p = cells.groupBy(F.col("prediction").alias("class")).agg(F.sum(n).alias("p"))
    row = t.join(p, "class").agg(F.sum("t").alias("s"), F.sum("d").alias("c"), F.sum(F.col("t") * F.col("p")).alias("tp"),
                                 F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    s, c, tp = F.col("s"), F.col("c"), F.col("tp")
    expected = tp / (s * s)
    kappa = F.try_divide(c / s - expected, 1 - expected)
    mcc = F.try_divide(c * s - tp, F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt"))))
    return row.select(kappa.alias("cohen_kappa"), F.coalesce(mcc, F.lit(0.0)).alias("matthews_corrcoef"))


def log_loss(df: DataFrame, label: str, probability: str, eps: float = 2.220446049250313e-16) -> DataFrame:
    """Binary log loss with probabilities clipped to [eps, 1 - eps]."""
    p = F.least(F.greatest(dbl(probability), F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.avg(F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"))


def multiclass_log_loss(df: DataFrame, label: str, probabilities: str, eps: float = 2.220446049250313e-16) -> DataFrame:
    """Log loss where `probabilities` is an array indexed by the class number."""
    p = F.least(F.greatest(F.element_at(probabilities, F.col(label).cast("int") + 1), F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.avg(-F.log(p)).alias("log_loss"))


def _by_score(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score, with running totals from the lowest score."""
    counts = df.groupBy(*by, dbl(score).alias("_score")).agg(
        F.sum(one(F.col(label) == 1)).alias("pos"), F.sum(one(F.col(label) != 1)).alias("neg"))
    return running_totals(counts, "_score", ["pos", "neg"], by=by)


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half."""
    run = _by_score(df, label, score, by)
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    pairs = F.max("total_pos").cast("double") * F.max("total_neg")
    out = run.groupBy(*by) if by else run
    return out.agg(F.try_divide(wins, pairs).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times recall gain over distinct thresholds, highest first."""
    run = _by_score(df, label, score, by)
    above_pos = F.col("total_pos") - F.col("before_pos")
    above_neg = F.col("total_neg") - F.col("before_neg")
    term = F.try_divide(F.col("pos").cast("double"), F.col("total_pos")) * (above_pos / (above_pos + above_neg))
    out = run.groupBy(*by) if by else run
    return out.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("average_precision"))


def roc_auc_multiclass(df: DataFrame, label: str, probabilities: str) -> DataFrame:
    """Class-frequency weighted mean of the one-vs-rest areas."""
    long = df.select(F.col(label).cast("int").alias("_l"), F.posexplode(probabilities).alias("class", "_p"))
    long = long.withColumn("_hit", one(F.col("_l") == F.col("class")))
    areas = roc_auc(long, "_hit", "_p", by=["class"])
    support = long.groupBy("class").agg(F.sum("_hit").alias("_n"))
    return areas.join(support, "class").agg(F.try_divide(F.sum(F.col("roc_auc") * F.col("_n")), F.sum("_n").cast("double")).alias("roc_auc"))


def geometric_mean_recall(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Geometric mean of the class recalls; 0 when a class is never found."""
    rows = class_report(df, label, prediction).where(~F.col("class").isin("macro avg", "weighted avg") & (F.col("support") > 0))
    return rows.agg(F.when(F.min("recall") == 0, 0.0).otherwise(F.exp(F.avg(F.log(F.when(F.col("recall") > 0, F.col("recall")))))).alias("g_mean"))


def regression_scores(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """rmse, mae, r2."""
    e, y = dbl(prediction) - dbl(label), dbl(label)
    out = df.groupBy(*by) if by else df
    return out.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                   (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"))


def compare_periods(df: DataFrame, label: str, prediction: str, period: str, base: object, other: object) -> DataFrame:
    """metric, base_value, other_value, delta of the regression scores in two periods."""
    scores = regression_scores(df.where(F.col(period).isin(base, other)), label, prediction, [period])
    long = scores.unpivot([period], ["rmse", "mae", "r2"], "metric", "value")
    pick = lambda v: F.max(F.when(F.col(period) == F.lit(v), F.col("value")))
    return long.groupBy("metric").agg(pick(base).alias("base_value"), pick(other).alias("other_value"), (pick(other) - pick(base)).alias("delta"))


def compare_accuracy(df: DataFrame, label: str, prediction: str, period: str) -> DataFrame:
    """period, n, accuracy."""
    return df.groupBy(period).agg(F.count(F.lit(1)).alias("n"), F.avg(one(F.col(label) == F.col(prediction))).alias("accuracy"))


# ---- baselines ----

def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Adds prediction: the most frequent training class, smallest on ties."""
    counts = train.groupBy(F.col(label).alias("prediction")).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.orderBy(F.col("_n").desc(), "prediction").limit(1).select("prediction", F.lit(1).alias("_p"))
    return test.withColumn("_p", F.lit(1)).join(F.broadcast(best), "_p").drop("_p")        # one row


def random_baseline(train: DataFrame, test: DataFrame, label: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Adds prediction: a training class chosen by the key hash, all classes alike."""
    classes = train.where(F.col(label).isNotNull()).select(label).distinct().agg(F.array_sort(F.collect_list(label)).alias("_c")).withColumn("_p", F.lit(1))
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return test.withColumn("_p", F.lit(1)).join(F.broadcast(classes), "_p").withColumn(
        "prediction", F.element_at("_c", F.pmod(place, F.size("_c")).cast("int") + 1)).drop("_p", "_c")


def shuffled_label(df: DataFrame, label: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """The label column permuted over the rows: two hash orders joined rank to rank."""
    a = hash_rank(df, keys, seed).drop(label, "group_size")
    b = hash_rank(df, keys, seed + 1).select("hash_rank", label)
    return a.join(b, "hash_rank").drop("hash_rank")


# ---- experiment records ----

def sanity_flags(scores: DataFrame, name: str, accuracy: str) -> DataFrame:
    """Adds verdict: low below 0.5, suspicious above 0.95, otherwise ok."""
    a = F.col(accuracy)
    return scores.select(name, accuracy, F.when(a < 0.5, "low").when(a > 0.95, "suspicious").otherwise("ok").alias("verdict"))


def experiment_summary(models: DataFrame, experiment: str, model: str, score: str, seconds: str) -> DataFrame:
    """One row per experiment: models trained, total time, best model (smallest name on ties) and its score."""
    best = F.min(F.struct((-F.col(score)).alias("k"), F.col(model).alias("m")))
    return models.groupBy(experiment).agg(
        F.array_join(F.array_sort(F.collect_set(model)), ",").alias("models_trained"), F.sum(seconds).alias("total_training_time"),
        best["m"].alias("best_model"), (-best["k"]).alias("best_score"))


def record_hash(df: DataFrame, cols: Sequence[str]) -> Column:
    """md5 over the columns in name order."""
    return F.md5(F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(cols)]))
