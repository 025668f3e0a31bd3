"""Classifiers from Spark ML, nearest neighbours by exact join, cross-validation and leakage tests."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tallyglass.functions.expressions import dbl, numeric_columns, one
from tallyglass.operators.metrics import shuffled_label
from tallyglass.operators.neighbors import nearest
from tallyglass.operators.profile import target_correlation
from tallyglass.operators.sampling import random_split, stratified_folds
from tallyglass.session import cut_lineage

MODELS = ("decision_tree", "random_forest", "gradient_boosting", "logistic_regression", "naive_bayes", "svm")
FOLD_ROWS, FOLD_SHARE, FOLD_CELLS = 100_000, 8, 2 ** 17          # trees learn by cells from so many rows, with so many rows a cell and at most so many cells
FOLDABLE = {"maxBins", "maxDepth", "maxIter", "numTrees", "stepSize", "impurity", "minInfoGain"}          # parameters that do not ask for single rows
FIT_THREADS = 8


def make_classifier(name: str, classes: int = 2, seed: int = 42, **params):
    """Estimator on `features` and `label_index`; boosting and the linear SVM go one-vs-rest for more than two classes."""
    common = {"featuresCol": "features", "labelCol": "label_index"}
    if name == "decision_tree":
        return DecisionTreeClassifier(seed=seed, **common, **params)
    if name == "random_forest":
        return RandomForestClassifier(seed=seed, **{"numTrees": 100, **params}, **common)
    if name == "logistic_regression":
        return LogisticRegression(**{"maxIter": 100, **params}, **common)
    if name == "naive_bayes":
        return NaiveBayes(modelType="gaussian", **common, **params)
    if name == "gradient_boosting":
        base = GBTClassifier(seed=seed, **common, **params)
    elif name == "svm":
        base = LinearSVC(**common, **params)
    else:
        raise ValueError(f"unknown model: {name}")
    weight = {"weightCol": params["weightCol"]} if "weightCol" in params else {}
    return base if classes == 2 else OneVsRest(classifier=base, featuresCol="features", labelCol="label_index", **weight)


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, name: str, seed: int = 42, **params) -> PipelineModel:
    """Label index, feature vector and classifier as one fitted pipeline; trees learn large tables of few features by cells (`_fit_cells`)."""
    classes = train.select(label).distinct().count()
    bins = params.get("maxBins", 32)
    cells = bins ** len(features) * classes
    if name in ("decision_tree", "random_forest", "gradient_boosting") and set(params) <= FOLDABLE and cells <= FOLD_CELLS and set(features) <= set(numeric_columns(train)):
        if train.count() >= max(FOLD_ROWS, FOLD_SHARE * cells):
            return _fit_cells(train, features, label, name, classes, bins, seed, **params)
    indexer = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[indexer, assembler, make_classifier(name, classes, seed, **params)]).fit(train)


def _fit_cells(train: DataFrame, features: Sequence[str], label: str, name: str, classes: int, bins: int, seed: int, **params) -> PipelineModel:
    """Trees on counted cells of `bins` quantile bins a feature: only the count walks the rows, depths, trees and rounds walk the cells.

    Trees split between bins alone, so rows of one cell and class always stay together and
    their number as weight gives the sums of all rows.  Quantiles come from sketches of all rows.
    """
    indexer = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc").fit(train)
    names = [f"_bin_{c}" for c in features]
    quantiles = train.approxQuantile(list(features), [i / bins for i in range(bins)], 1 / (32 * bins))
    splits = []
    for found in quantiles:
        known = sorted({q for q in found if math.isfinite(q)})
        splits.append([-math.inf, *(known[1:] or known or [0.0]), math.inf])          # nothing lies below the least
    binned = Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=names, handleInvalid="error")
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    counted = binned.transform(indexer.transform(train)).groupBy(*names, "label_index").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    ordered = [F.col(c).alias(c, metadata={"ml_attr": {"type": "numeric"}}) for c in names]          # bins are no categories: trees cut them in order
    cells = assembler.transform(counted.select(*ordered, "label_index", "weight"))
    cells = cut_lineage(cells.repartition(math.ceil(bins ** len(features) * classes / 20_000), *names).sortWithinPartitions(*names, "label_index"))
    if name == "random_forest":
        model = _fit_forest(cells, names, [len(s) - 1 for s in splits], assembler, classes, seed, **params)
    else:
        model = make_classifier(name, classes, seed, weightCol="weight", **params).fit(cells)
    return PipelineModel(stages=[indexer, binned, assembler, model])


class CellPredictions(Transformer):
    """The prediction of every combination of bins, joined to rows by their bins."""

    def __init__(self, table: DataFrame, names: list[str]):
        super().__init__()
        self.table, self.names = table, names

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.table), self.names)          # at most FOLD_CELLS rows


def _fit_forest(cells: DataFrame, names: list[str], sizes: list[int], assembler: VectorAssembler, classes: int, seed: int, numTrees: int = 100, **params) -> CellPredictions:
    """Random forest on counted cells. Each row counts Poisson(1) times for each tree, so a cell of n rows counts Poisson(n) times."""
    weights = [f"_w{t}" for t in range(numTrees)]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = pdf[[*names, "label_index"]].astype(int).to_numpy()
            drawn = [np.random.default_rng([seed, *key]).poisson(n, numTrees).astype(float) for key, n in zip(keys, pdf["weight"])]
            yield pd.concat([pdf, pd.DataFrame(drawn, columns=weights, index=pdf.index)], axis=1)
    plain = cells.select(*names, "label_index", "weight")
    drawn = assembler.transform(plain.mapInPandas(draw, ", ".join(f"`{c}` double" for c in [*plain.columns, *weights]))).cache()
    one_tree = RandomForestClassifier(featuresCol="features", labelCol="label_index", numTrees=1, bootstrap=False,
                                      featureSubsetStrategy="sqrt" if numTrees > 1 else "all", **params)
    fits = one_tree.fitMultiple(drawn, [{one_tree.weightCol: w, one_tree.seed: seed + t} for t, w in enumerate(weights)])
    with ThreadPool(FIT_THREADS) as pool:
        trees = [m for _, m in sorted(pool.map(inheritable_thread_target(cells.sparkSession)(lambda _: next(fits)), weights, chunksize=1), key=lambda f: f[0])]
    drawn.unpersist()
    grid, step = [], 1
    for c, n in zip(names, sizes):
        grid.append((F.floor(F.col("id") / step) % n).cast("double").alias(c))
        step *= n
    every = assembler.transform(cells.sparkSession.range(0, step, 1, 1).select(*grid))
    votes = None
    for tree in trees:
        piece = tree.transform(every).select(*names, vector_to_array("probability").alias("_p"))
        votes = piece if votes is None else votes.unionAll(piece)
    shares = votes.groupBy(*names).agg(F.array(*[F.sum(F.element_at("_p", i + 1)) for i in range(classes)]).alias("_p"))
    return CellPredictions(cut_lineage(shares.select(*names, (F.array_position("_p", F.array_max("_p")) - 1).cast("double").alias("prediction"))), names)


def predict(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """Adds prediction as a class value of the training data; labels unseen in training need no index here."""
    names = F.array(*[F.lit(v) for v in model.stages[0].labels])
    scored = PipelineModel(stages=model.stages[1:]).transform(df).drop(*[c for s in model.stages if isinstance(s, Bucketizer) for c in s.getOutputCols()])
    value = F.element_at(names, F.col("prediction").cast("int") + 1)
    return scored.withColumn("prediction", value.cast(dict(df.dtypes)[label]))


def train_and_score(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, name: str, **params) -> DataFrame:
    """model, n_test, accuracy."""
    got = predict(fit_classifier(train, features, label, name, **params), test, label)
    return got.agg(F.count(F.lit(1)).alias("n_test"), F.avg(one(F.col("prediction") == F.col(label))).alias("accuracy")).select(
        F.lit(name).alias("model"), "n_test", "accuracy")


def naive_bayes_statistics(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """class, column, prior, mean, variance (population): what the Gaussian model is made of."""
    n = df.count()
    long = df.select(F.col(label).cast("string").alias("class"), *[dbl(c).alias(c) for c in features]).unpivot(["class"], list(features), "column", "v")
    return long.groupBy("class", "column").agg((F.count(F.lit(1)) / F.lit(float(n))).alias("prior"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))


def knn_classify(train: DataFrame, test: DataFrame, key: str, vec: str, label: str, k: int = 5, exclude_self: bool = False) -> DataFrame:
    """key, prediction: majority class of the k nearest training rows, smallest class on ties."""
    near = nearest(test, train, key, vec, k, exclude_self=exclude_self)
    labels = train.select(F.col(key).alias("neighbour"), F.col(label).alias("_l"))
    votes = near.join(labels, "neighbour").groupBy(key, "_l").agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("k"), F.col("_l").alias("l")))["l"].alias("prediction"))


def cross_validate(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], name: str, folds: int = 5, seed: int = 42, **params) -> DataFrame:
    """fold, accuracy, and the mean, deviation (population) and stability over the folds."""
    dealt = stratified_folds(df, label, keys, folds, seed).select(*dict.fromkeys([*keys, *features, label]), "fold").cache()
    scores = []
    for i in range(folds):
        row = train_and_score(dealt.where(F.col("fold") != i), dealt.where(F.col("fold") == i), features, label, name, **params).first()
        scores.append((i, row["accuracy"]))
    dealt.unpersist()
    mean = sum(s for _, s in scores) / folds
    std = (sum((s - mean) ** 2 for _, s in scores) / folds) ** 0.5
    return df.sparkSession.createDataFrame([(i, s, mean, std, std > 0.05) for i, s in scores],
                                           "fold int, accuracy double, cv_mean double, cv_std double, unstable boolean")


def shuffled_target_test(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], limit: float = 0.7, seed: int = 42) -> DataFrame:
    """Accuracy of a depth-3 tree trained on permuted labels; above the limit something leaks."""
    parts = random_split(df.select(*dict.fromkeys([*keys, *features, label])), keys, 0.2, seed)          # the ranks shuffle what the tree needs, no more
    parts = cut_lineage(parts)                                                                              # read by the permutation twice and by the test
    train = cut_lineage(shuffled_label(parts.where(F.col("part") == "train").drop("part"), label, keys, seed))          # training reads it many times: permute once
    row = train_and_score(train, parts.where(F.col("part") == "test"), features, label, "decision_tree", maxDepth=3)
    return row.select(F.col("accuracy").alias("shuffled_accuracy"), (F.col("accuracy") > limit).alias("leakage_detected"))


def association_analysis(df: DataFrame, target: str, k: int = 10, flag: float = 0.5) -> DataFrame:
    """The k columns most correlated with the target, and whether they are high."""
    cols = [c for c in numeric_columns(df) if c != target]
    return target_correlation(df, target, cols).limit(k).withColumn("high", F.col("abs_correlation") > flag)
