"""Filling missing values: simple, nearest-neighbour and iterative."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tallyglass.functions.expressions import count_if, dbl, numeric_columns, one, text_columns
from tallyglass.functions.gram import gram_of_holes, summed
from tallyglass.functions.ranking import exact_quantiles
from tallyglass.operators.missing import missing_mechanism
from tallyglass.operators.neighbors import nearest
from tallyglass.operators.profile import modes

STRATEGIES = ("auto", "median", "mean", "mode", "zero", "constant")


def fill_values(df: DataFrame, strategy: str = "auto", constant: object = None, cols: Sequence[str] | None = None) -> dict[str, object]:
    """column -> fill value; `auto` is median for numbers and mode for text ("unknown" without any value)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    chosen = list(cols or df.columns)
    numbers, texts = [c for c in numeric_columns(df) if c in chosen], [c for c in text_columns(df) if c in chosen]
    if strategy == "constant":
        fits = numbers if isinstance(constant, (int, float)) else texts
        return {c: constant for c in fits}
    if strategy == "zero":
        return {c: 0 for c in numbers}
    values: dict[str, object] = {}
    if strategy in ("auto", "median"):
        values.update({c: q[0] for c, q in exact_quantiles(df, numbers, [0.5]).items()})
    if strategy == "mean" and numbers:
        values.update(df.agg(*[F.avg(dbl(c)).alias(c) for c in numbers]).first().asDict())
    by_mode = texts + (numbers if strategy == "mode" else [])
    if by_mode:
        found = {r["column"]: r["mode"] for r in modes(df, by_mode).collect()}      # one row per column
        values.update({c: found.get(c, "unknown" if c in texts else None) for c in by_mode})
    return {c: v for c, v in values.items() if v is not None}


def impute_simple(df: DataFrame, strategy: str = "auto", constant: object = None, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls replaced by one value per column; numbers become double when the value is fractional."""
    types = dict(df.dtypes)
    filled = {}
    for c, v in fill_values(df, strategy, constant, cols).items():
        if c in numeric_columns(df):
            whole = types[c] in ("int", "bigint", "smallint", "tinyint") and float(v).is_integer()
            value = F.lit(float(v)).cast(types[c] if whole else "double")
            filled[c] = F.coalesce(F.col(c).cast(types[c] if whole else "double"), value)
        else:
            filled[c] = F.coalesce(F.col(c), F.lit(v))
    return df.withColumns(filled) if filled else df


def impute_knn(df: DataFrame, key: str, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Nulls become the mean of the k nearest rows that have the value.

    Distance is Euclidean over coordinates both rows have, scaled by
    sqrt(p / shared).  Rows are grouped by which coordinates they have; inside a
    (donor pattern, shared coordinates) group the distance is an ordinary one,
    so the exact pivot join applies.  Without any usable donor: column mean.
    """
    cols, p = list(cols), len(cols)
    bits = F.concat(*[F.when(F.col(c).isNotNull(), "1").otherwise("0") for c in cols])          # one digit per column, for any number of columns
    rows = df.select(F.col(key), *[dbl(c).alias(c) for c in cols], bits.alias("_has"))
    full, text = (1 << p) - 1, lambda mask: format(mask, f"0{p}b")
    patterns = [int(r["_has"], 2) for r in rows.select("_has").distinct().collect()]      # at most 2^p
    pairs = [(q, d, q & d) for q in patterns if q != full for d in patterns if q & d and d & ~q]
    means = df.agg(*[F.avg(dbl(c)).alias(c) for c in cols]).first()
    result = df
    if pairs:
        spark = df.sparkSession
        ask = F.broadcast(spark.createDataFrame([tuple(map(text, pair)) for pair in pairs], "_has string, _donor string, _shared string"))
        give = F.broadcast(spark.createDataFrame(sorted({(text(d), text(d), text(s)) for _, d, s in pairs}), "_has string, _donor string, _shared string"))
        bit = lambda mask, i: F.substring(mask, i + 1, 1) == "1"
        masked = F.array(*[F.when(bit("_shared", i), F.col(c)).otherwise(F.lit(0.0)) for i, c in enumerate(cols)])
        group = F.concat_ws("_", "_donor", "_shared")
        shaped = lambda table: rows.join(table, "_has").select(key, group.alias("_g"), masked.alias("_vec"))
        near = nearest(shaped(ask), shaped(give), key, "_vec", k, by="_g")
        donor, shared = F.split("_g", "_")[0], F.split("_g", "_")[1]
        near = near.select(key, "neighbour", donor.alias("_donor"), (F.col("distance") * F.sqrt(F.lit(float(p)) / F.length(F.replace(shared, F.lit("0"), F.lit(""))))).alias("_d"))
        near = near.join(rows.select(key, "_has"), key)
        usable = F.array(*[F.when(bit("_donor", i) & ~bit("_has", i), F.lit(c))
                           for i, c in enumerate(cols)])
        near = near.select(key, "neighbour", "_d", F.explode(F.filter(usable, lambda x: x.isNotNull())).alias("_column"))
        best = Window.partitionBy(key, "_column").orderBy("_d", "neighbour")
        near = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
        values = rows.select(F.col(key).alias("neighbour"), *cols)
        value = F.coalesce(*[F.when(F.col("_column") == c, F.col(c)) for c in cols])
        got = near.join(values, "neighbour").select(key, "_column", value.alias("_value"))
        wide = got.groupBy(key).agg(*[F.avg(F.when(F.col("_column") == c, F.col("_value"))).alias(f"_i_{c}") for c in cols])
        result = df.join(wide, key, "left")
    else:
        result = df.withColumns({f"_i_{c}": F.lit(None).cast("double") for c in cols})
    filled = {c: F.coalesce(dbl(c), F.col(f"_i_{c}"), F.lit(means[c])) for c in cols}
    return result.withColumns(filled).drop(*[f"_i_{c}" for c in cols])


def _replayed(x: np.ndarray, centre: np.ndarray, scale: np.ndarray, holes: Sequence[int], rounds: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(standardised values with fills after the given rounds, which were there) of rows x columns with NaN for null."""
    seen = ~np.isnan(x)
    z = np.where(seen, (x - centre) / scale, 0.0)
    for betas in rounds:                                          # (p + 1) x holes, the intercept first
        guess = betas[0] + z @ betas[1:]
        z[:, holes] = np.where(seen[:, holes], z[:, holes], guess)
    return z, seen


def impute_iterative(df: DataFrame, cols: Sequence[str], max_iter: int = 10, ridge: float = 1e-6, tolerance: float = 1e-6) -> DataFrame:
    """Each incomplete column is regressed on the others until the fills settle.

    A row's fills follow from its own values and the coefficients of the rounds so far, so a
    round is one scan that replays them and sums the products of all holes; nothing is
    written between rounds and a lost executor costs its tasks only. The solves are
    columns x columns. NaN counts as missing; a column without any value stays null.
    """
    cols = list(cols)
    p = len(cols)
    clean = lambda c: F.when(~F.isnan(dbl(c)), dbl(c))
    row = df.agg(*[F.avg(clean(c)).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(clean(c)).alias(f"s{i}") for i, c in enumerate(cols)],
                 *[count_if(clean(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    centre = np.array([row[f"m{i}"] or 0.0 for i in range(p)])
    scale = np.array([row[f"s{i}"] or 1.0 for i in range(p)])
    holes = [i for i in range(p) if row[f"n{i}"] and row[f"m{i}"] is not None]
    if not holes:
        return df
    rounds: list[np.ndarray] = []
    for _ in range(max_iter):
        done = list(rounds)

        def products(x: np.ndarray, done: list[np.ndarray] = done) -> np.ndarray:
            z, seen = _replayed(x, centre, scale, holes, done)
            return gram_of_holes(z, seen, holes)
        sums = summed(df, cols, len(holes), products, p + 1)
        betas = np.zeros((p + 1, len(holes)))
        for at, t in enumerate(holes):
            others = [0] + [i + 1 for i in range(p) if i != t]
            n = sums[at, 0, 0]
            gram = sums[at][np.ix_(others, others)]
            betas[others, at] = np.linalg.solve(gram + ridge * max(1.0, n) * np.eye(p), sums[at][others, t + 1])
        settled = bool(rounds) and float(np.max(np.abs(betas - rounds[-1]))) < tolerance
        rounds.append(betas)
        if settled:
            break

    @F.pandas_udf("array<double>")
    def fills(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            z, _ = _replayed(np.column_stack([c.to_numpy(float) for c in columns]), centre, scale, holes, rounds)
            yield pd.Series(list(z[:, holes] * scale[holes] + centre[holes]))
    held = "_fills"
    while held in df.columns:
        held += "_"
    out = df.withColumn(held, fills(*[dbl(c) for c in cols]))
    return out.withColumns({cols[t]: F.coalesce(clean(cols[t]), F.col(held)[at]) for at, t in enumerate(holes)}).drop(held)


def choose_imputer(pattern: str, mar: str = "knn") -> tuple[str, int]:
    """(method, rounds): MCAR simple, MAR nearest neighbours or iterative, MNAR iterative with 20 rounds."""
    if pattern == "MAR":
        return (mar, 10)
    return ("iterative", 20) if pattern == "MNAR" else ("simple", 0)


def impute_auto(df: DataFrame, key: str, cols: Sequence[str], mar: str = "knn") -> DataFrame:
    """Impute with the method the missing-data mechanism of these columns calls for."""
    method, rounds = choose_imputer(missing_mechanism(df.select(*cols)).first()["pattern"], mar)
    if method == "simple":
        return impute_simple(df, cols=cols)
    return impute_knn(df, key, cols) if method == "knn" else impute_iterative(df, cols, rounds)
