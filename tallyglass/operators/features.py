"""Feature transformations, encodings and selection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyglass.functions.expressions import dbl, distinct_counts, numeric_columns, per_column, ratio, safe_corr, sample_skewness, text_columns, time_columns
from tallyglass.functions.ranking import exact_quantiles, running_totals
from tallyglass.functions.smallmath import variance_inflation
from tallyglass.operators.imputation import fill_values
from tallyglass.operators.information import neighbour_information
from tallyglass.operators.schema import parse_time

WIDE_LIMIT = 1_000


# ---- power and log transformations ----

def _boxcox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(float(lam))) - 1) / F.lit(float(lam))


def boxcox_shift(low: float) -> float:
    return abs(low) + 1e-6 if low <= 0 else 0.0


def boxcox_lambda(df: DataFrame, col: str, shift: float = 0.0, rounds: int = 4, points: int = 21) -> float:
    """Lambda of largest log-likelihood; each round tries a finer grid as aggregates of one scan."""
    x = dbl(col) + shift
    low, high = -5.0, 5.0
    best = 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        row = df.agg(F.count(x).alias("n"), F.sum(F.log(x)).alias("s"),
                     *[F.var_pop(_boxcox(x, g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
        fit = [(g - 1) * row["s"] - row["n"] / 2 * math.log(row[f"v{i}"]) if row[f"v{i}"] and row[f"v{i}"] > 0 and math.isfinite(row[f"v{i}"])
               else -math.inf for i, g in enumerate(grid)]
        best = grid[int(np.argmax(fit))]
        step = (high - low) / (points - 1)
        low, high = best - step, best + step
    return best


def boxcox(df: DataFrame, cols: Sequence[str] | None = None, skew_limit: float = 1.0, lambdas: dict[str, float] | None = None) -> DataFrame:
    """Adds {column}_boxcox for columns with |skew| above the limit; nulls stay null."""
    cols = list(cols or numeric_columns(df))
    row = df.agg(*[sample_skewness(dbl(c)).alias(f"s{i}") for i, c in enumerate(cols)], *[F.min(dbl(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        if row[f"s{i}"] is not None and abs(row[f"s{i}"]) > skew_limit:
            shift = boxcox_shift(row[f"m{i}"])
            lam = (lambdas or {}).get(c)
            out[f"{c}_boxcox"] = _boxcox(dbl(c) + shift, boxcox_lambda(df, c, shift) if lam is None else lam)
    return df.withColumns(out) if out else df


def log_transform(df: DataFrame, cols: Sequence[str] | None = None, skew_limit: float = 1.0) -> DataFrame:
    """Adds {column}_log for right-skewed columns, shifted by 1 - min when min <= 0."""
    cols = list(cols or numeric_columns(df))
    row = df.agg(*[sample_skewness(dbl(c)).alias(f"s{i}") for i, c in enumerate(cols)], *[F.min(dbl(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        if row[f"s{i}"] is not None and row[f"s{i}"] > skew_limit:
            low = row[f"m{i}"]
            out[f"{c}_log"] = F.log(dbl(c) + (1 - low if low <= 0 else 0.0))
    return df.withColumns(out) if out else df


# ---- bins ----

def bin_code(c: Column, edges: Sequence[float]) -> Column:
    """1-based number of the right-closed bin between repeat-free edges; the first also takes the minimum."""
    distinct = sorted(set(edges))
    code = F.lit(None).cast("int")
    for i in range(max(1, len(distinct) - 1), 0, -1):
        code = F.when(c <= distinct[min(i, len(distinct) - 1)], i).otherwise(code)
    return code


def bin_by_edges(c: Column, edges: Sequence[float], prefix: str) -> Column:
    return F.concat(F.lit(prefix), bin_code(c, edges).cast("string"))


def quantile_bins(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 5, suffix: str = "_binned") -> DataFrame:
    """Adds {column}_binned with Q1..Qn by exact quantiles."""
    cols = list(cols or numeric_columns(df))
    edges = exact_quantiles(df, cols, [i / bins for i in range(bins + 1)])
    return df.withColumns({f"{c}{suffix}": bin_by_edges(dbl(c), e, "Q") for c, e in edges.items() if e[0] is not None})


def bin_balance(binned: DataFrame, column: str) -> DataFrame:
    """bin, n, share, and the balance ratio (smallest over largest bin)."""
    counts = binned.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("t"), ratio(F.min("n"), F.max("n")).alias("balance_ratio")).withColumn("_p", F.lit(1))
    return counts.withColumn("_p", F.lit(1)).join(F.broadcast(whole), "_p").select("bin", "n", ratio(F.col("n"), F.col("t")).alias("share"), "balance_ratio")


def equal_width_bins(df: DataFrame, cols: Sequence[str], bins: int = 5, suffix: str = "_binned") -> DataFrame:
    """Adds {column}_binned with B1..Bn of equal width, right-closed."""
    row = df.agg(*[F.min(dbl(c)).alias(f"l{i}") for i, c in enumerate(cols)], *[F.max(dbl(c)).alias(f"h{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        low, high = row[f"l{i}"], row[f"h{i}"]
        if low is not None:
            width = (high - low) / bins or 1.0
            place = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((dbl(c) - low) / width).cast("int")))
            out[f"{c}{suffix}"] = F.when(F.col(c).isNotNull(), F.concat(F.lit("B"), place.cast("string")))
    return df.withColumns(out) if out else df


# ---- categories ----

def _category_shares(df: DataFrame, col: str) -> DataFrame:
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).withColumn("_p", F.lit(1))
    return counts.withColumn("_p", F.lit(1)).join(F.broadcast(total), "_p").select("_value", ratio(F.col("_n"), F.col("_total")).alias("_share"))


def _frequent(df: DataFrame, col: str, limit: float) -> list[str]:
    """Categories with at least `limit` of the rows: no more than 1 / limit of them."""
    return [r["_value"] for r in _category_shares(df, col).where(F.col("_share") >= limit).select("_value").collect()]


def _fold_rare(df: DataFrame, cols: Sequence[str], limit: float, other: str, suffix: str) -> DataFrame:
    out = {}
    for c in cols:
        out[f"{c}{suffix}"] = F.when(F.col(c).isNull() | F.col(c).isin(_frequent(df, c, limit)), F.col(c)).otherwise(other)
    return df.withColumns(out)


def reduce_cardinality(df: DataFrame, cols: Sequence[str], limit: float = 0.005) -> DataFrame:
    """Adds {column}_reduced with categories under 0.5 % of the rows as 'Other'."""
    return _fold_rare(df, cols, limit, "Other", "_reduced")


def rare_bucket(df: DataFrame, cols: Sequence[str], limit: float = 0.01) -> DataFrame:
    """Categories under 1 % of the rows become __OTHER__, in place."""
    return _fold_rare(df, cols, limit, "__OTHER__", "")


def hash_encode(df: DataFrame, col: str, width: int = 10) -> DataFrame:
    """Adds {column}_hash_0.. : +1 or -1 in one of `width` places, from the md5 of the value; nulls hash as __MISSING__."""
    digest = F.md5(F.coalesce(F.col(col).cast("string"), F.lit("__MISSING__")))
    place = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(width))
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)
    return df.withColumns({f"{col}_hash_{i}": F.when(place == i, sign).otherwise(0.0) for i in range(width)})


def target_encode(df: DataFrame, col: str, target: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Adds {column}_target_encoded: mean target of the category, global mean for unseen ones and nulls."""
    fit = df if fit_on is None else fit_on
    means = fit.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_value")).agg(F.avg(dbl(target)).alias("_mean"))
    overall = fit.agg(F.avg(dbl(target)).alias("m")).first()["m"]
    return df.join(means, F.col(col) == F.col("_value"), "left").withColumn(
        f"{col}_target_encoded", F.coalesce("_mean", F.lit(overall).cast("double"))).drop("_value", "_mean")


def target_encode_out_of_fold(df: DataFrame, col: str, target: str, keys: Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """As target_encode, but each row sees only the other folds; folds come from the key hash."""
    fold = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), F.lit(folds))
    base = df.withColumn("_fold", fold)
    cells = base.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_value"), F.col("_fold").alias("_f")).agg(
        F.sum(dbl(target)).alias("_s"), F.count(target).alias("_n"))
    whole = Window.partitionBy("_value")      # at most `folds` rows per category
    held_out = cells.select("_value", "_f", F.try_divide(F.sum("_s").over(whole) - F.col("_s"), (F.sum("_n").over(whole) - F.col("_n")).cast("double")).alias("_mean"))
    overall = df.agg(F.avg(dbl(target)).alias("m")).first()["m"]
    return base.join(held_out, (F.col(col) == F.col("_value")) & (F.col("_fold") == F.col("_f")), "left").withColumn(
        f"{col}_target_encoded", F.coalesce("_mean", F.lit(overall).cast("double"))).drop("_value", "_f", "_fold", "_mean")


def categories(df: DataFrame, col: str, limit: int = WIDE_LIMIT) -> list:
    """Sorted distinct values; an error above `limit`, where a wide encoding is the wrong tool."""
    found = df.where(F.col(col).isNotNull()).select(col).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{col} has over {limit} categories: use one_hot_vectors, hash or target encoding")
    return sorted(r[0] for r in found)


def one_hot_vectors(df: DataFrame, cols: Sequence[str], drop_first: bool = True) -> DataFrame:
    """One sparse 0/1 vector {column}_onehot (size, indices, values) in place of each column, for any number of categories.

    Positions are the sorted distinct values; nulls are the empty vector. The code table
    is computed range by range and joined, so no category list reaches the driver.
    """
    for c in cols:
        codes = label_codes(df, c)
        size = codes.count() - int(drop_first)
        at = F.col("code") - int(drop_first)
        place = F.when(at >= 0, F.array(at)).otherwise(F.array().cast("array<int>"))
        vector = F.struct(F.lit(size).alias("size"), place.alias("indices"), F.transform(place, lambda _: F.lit(1.0)).alias("values"))
        df = df.join(codes, F.col(c) == F.col("value"), "left").withColumn(f"{c}_onehot", vector).drop(c, "value", "code")
    return df


def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = True) -> DataFrame:
    """0/1 columns {column}_{value} in place of the column, without the first category."""
    for c in cols:
        kept = categories(df, c)[1 if drop_first else 0:]
        df = df.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for v in kept}).drop(c)
    return df


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """value, code: position among the sorted distinct values, counted range by range."""
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct().withColumn("_n", F.lit(1))
    return running_totals(values, "value", ["_n"]).select("value", F.col("before__n").cast("int").alias("code"))


def label_encode(df: DataFrame, col: str) -> DataFrame:
    """Adds {column}_code; the code table is joined, small or not, as AQE measures it."""
    codes = label_codes(df, col)
    return df.join(codes, F.col(col) == F.col("value"), "left").withColumnRenamed("code", f"{col}_code").drop("value")


def ordinal_evidence(df: DataFrame, cols: Sequence[str], limit: float = 0.7) -> DataFrame:
    """column, mean_abs_correlation of its codes with the numbers, is_ordinal."""
    numbers = numeric_columns(df)
    work = df
    for c in cols:
        work = label_encode(work, c)
    stats = {}
    for c in cols:
        links = F.filter(F.array(*[F.abs(safe_corr(F.col(f"{c}_code"), F.col(n))) for n in numbers]), lambda x: x.isNotNull())
        stats[c] = {"links": links}
    total = F.aggregate("links", F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, F.size("links").cast("double"))
    return per_column(work, stats).select("column", mean.alias("mean_abs_correlation"), F.coalesce(mean > limit, F.lit(False)).alias("is_ordinal"))


def encoding_choice(df: DataFrame, cols: Sequence[str] | None = None, target: str | None = None, high: int = 100) -> DataFrame:
    """max_cardinality and method: hash above `high`, target when there is one, else rare bucket."""
    cols = [c for c in (cols or text_columns(df)) if c != target]
    return distinct_counts(df, cols).agg(F.max("distinct_count").alias("max_cardinality")).withColumn(
        "method", F.when(F.col("max_cardinality") > high, "hash").otherwise("target" if target else "rare_bucket"))


def encode_auto(df: DataFrame, cols: Sequence[str], target: str | None = None) -> DataFrame:
    """Apply the chosen encoding to the columns."""
    method = encoding_choice(df, cols, target).first()["method"]
    if method == "rare_bucket":
        return rare_bucket(df, cols)
    for c in cols:
        df = hash_encode(df, c) if method == "hash" else target_encode(df, c, target)
    return df


# ---- time ----

def datetime_parts(df: DataFrame, cols: Sequence[str] | None = None, cyclical: bool = True, periods: dict[str, int] | None = None) -> DataFrame:
    """Adds year, month, day, hour, day_of_week (Monday 0), day_of_year per column, and sin/cos of month, hour, day_of_week.

    The period is the largest observed value + 1 unless `periods` fixes it.
    """
    text = text_columns(df)
    for c in cols or time_columns(df):
        t = parse_time(F.col(c)) if c in text else F.col(c)
        parts = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t) if dict(df.dtypes)[c] != "date" else F.lit(0),
                 "day_of_week": F.weekday(t), "day_of_year": F.dayofyear(t)}
        df = df.withColumns({f"{c}_{n}": e for n, e in parts.items()})
        if cyclical:
            names = ["month", "hour", "day_of_week"]
            row = df.agg(*[F.max(f"{c}_{n}").alias(n) for n in names]).first()
            turns = {}
            for n in names:
                angle = F.col(f"{c}_{n}") * (2 * math.pi / ((periods or {}).get(n) or (row[n] or 0) + 1))
                turns[f"{c}_{n}_sin"], turns[f"{c}_{n}_cos"] = F.sin(angle), F.cos(angle)
            df = df.withColumns(turns)
    return df


# ---- scaling, text ----

def scale(df: DataFrame, cols: Sequence[str] | None = None, method: str = "standard") -> DataFrame:
    """Adds {column}_scaled: standard (population deviation), minmax, or robust (median and IQR)."""
    cols = list(cols or numeric_columns(df))
    if method == "robust":
        place = {c: (q[1], q[2] - q[0]) for c, q in exact_quantiles(df, cols, [0.25, 0.5, 0.75]).items()}
    else:
        first, second = (F.avg, F.stddev_pop) if method == "standard" else (F.min, lambda x: F.max(x) - F.min(x))
        row = df.agg(*[first(dbl(c)).alias(f"a{i}") for i, c in enumerate(cols)], *[second(dbl(c)).alias(f"b{i}") for i, c in enumerate(cols)]).first()
        place = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(cols)}
    return df.withColumns({f"{c}_scaled": (dbl(c) - F.lit(a)) / F.lit(float(b or 1.0)) for c, (a, b) in place.items() if a is not None})


def text_vectors(df: DataFrame, key: str, text: str, max_features: int = 1000) -> DataFrame:
    """key, term, tf, tfidf rows for the `max_features` most frequent terms; idf = ln((1 + N) / (1 + df)) + 1."""
    words = df.select(F.col(key), F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")).alias("term")).where(F.col("term") != "")
    counts = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = counts.groupBy("term").agg(F.count(F.lit(1)).alias("_df"), F.sum("tf").alias("_total")).orderBy(
        F.col("_total").desc(), "term").limit(max_features)
    n = df.agg(F.count(F.lit(1)).alias("_n")).withColumn("_p", F.lit(1))
    weights = vocabulary.withColumn("_p", F.lit(1)).join(F.broadcast(n), "_p").select(
        "term", (F.log((1.0 + F.col("_n")) / (1.0 + F.col("_df"))) + 1.0).alias("_idf"))
    return counts.join(F.broadcast(weights), "term").select(key, "term", "tf", (F.col("tf") * F.col("_idf")).alias("tfidf"))   # max_features rows


# ---- interactions and selection ----

def interactions(df: DataFrame, cols: Sequence[str] | None = None, degree: int = 2, most: int | None = None) -> DataFrame:
    """Adds products a_x_b (and a_x_b_x_c for degree 3) in column order: all, or an error when there are more than `most`."""
    cols = list(cols or numeric_columns(df))
    sets = [s for d in range(2, degree + 1) for s in combinations(cols, d)]
    if most is not None and len(sets) > most:
        raise ValueError(f"{len(sets)} products of {len(cols)} columns; at most {most} were asked for")
    out = {}
    for s in sets:
        product = dbl(s[0])
        for c in s[1:]:
            product = product * dbl(c)
        out["_x_".join(s)] = product
    return df.withColumns(out) if out else df


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """p x p correlations over complete rows, from one pass that sums partial Gram matrices; the result is on the driver."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    cols = list(cols)
    complete = df.select(*[dbl(c).alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    if len(cols) < 2 or len(complete.take(2)) < 2:
        return np.eye(len(cols))
    vectors = VectorAssembler(inputCols=complete.columns, outputCol="v").transform(complete).select("v")
    matrix = np.nan_to_num(Correlation.corr(vectors, "v").first()[0].toArray(), nan=0.0)      # constant columns correlate with nothing
    np.fill_diagonal(matrix, 1.0)
    return matrix


def vif_values(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    cols = list(cols)
    if len(cols) < 2:
        return {c: 1.0 for c in cols}
    return dict(zip(cols, variance_inflation(correlation_matrix(df, cols))))


def vif(df: DataFrame, cols: Sequence[str] | None = None, flag: float = 5.0, severe: float = 10.0) -> DataFrame:
    """column, vif, level (ok, high, severe): 1 / (1 - R²) against the other columns; infinite for the columns of an exact dependence only."""
    rows = list(vif_values(df, list(cols or numeric_columns(df))).items())
    v = F.col("vif")
    return df.sparkSession.createDataFrame(rows, "column string, vif double").withColumn(
        "level", F.when(v > severe, "severe").when(v > flag, "high").otherwise("ok"))


def variances(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 0.01) -> DataFrame:
    """column, variance (population), removed when at or below the limit."""
    return per_column(df, {c: {"variance": F.var_pop(dbl(c))} for c in cols or numeric_columns(df)}).withColumn(
        "removed", F.coalesce(F.col("variance") <= limit, F.lit(True)))


def drop_low_variance(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 0.01) -> DataFrame:
    gone = [r["column"] for r in variances(df, cols, limit).where("removed").collect()]
    return df.drop(*gone)


def mutual_information(df: DataFrame, target: str, cols: Sequence[str] | None = None, k: int | None = None, bins: int = 10, method: str = "histogram") -> DataFrame:
    """column, mutual_information in nats, best first; `k` keeps the best.

    `histogram`: from quantile-binned joint counts, also for text features, one pass.
    `neighbours`: from neighbour distances (`information.neighbour_information`), for numeric
    features; the order of clearly different features is the same.
    """
    if method == "neighbours":
        out = neighbour_information(df, target, cols)
        return out.orderBy(F.col("mutual_information").desc(), "column").limit(k) if k else out
    cols = [c for c in (cols or numeric_columns(df)) if c != target]
    numbers = numeric_columns(df)
    binned_cols = cols + ([target] if target in numbers else [])
    edges = exact_quantiles(df, binned_cols, [i / bins for i in range(bins + 1)])
    plain = any(c not in numbers for c in cols)          # text features: compare all codes as text
    label = lambda c: bin_code(dbl(c), edges[c]) if c in edges and edges[c][0] is not None else F.col(c).cast("string")
    wide = df.select(label(target).alias("_y"), *[(label(c).cast("string") if plain else label(c)).alias(c) for c in cols if c not in edges or edges[c][0] is not None])
    cols = [c for c in cols if c in wide.columns]
    joint = wide.unpivot(["_y"], cols, "column", "_x").dropna().groupBy("column", "_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")                                   # bins x bins rows per column from here on
    whole, left, right = Window.partitionBy("column"), Window.partitionBy("column", "_x"), Window.partitionBy("column", "_y")
    p = n / F.sum(n).over(whole)
    gain = p * F.log(n * F.sum(n).over(whole) / (F.sum(n).over(left) * F.sum(n).over(right)))
    out = joint.withColumn("_g", gain).groupBy("column").agg(F.greatest(F.sum("_g"), F.lit(0.0)).alias("mutual_information"))
    return out.orderBy(F.col("mutual_information").desc(), "column").limit(k) if k else out


def prune(df: DataFrame, target: str | None = None, method: str = "all", vif_limit: float = 5.0, variance_limit: float = 0.01,
          k: int = 10, estimator: str = "histogram") -> tuple[DataFrame, DataFrame]:
    """The table without pruned numeric columns, and (column, reason) of the removed ones; the target stays."""
    cols = [c for c in numeric_columns(df) if c != target]
    removed: list[tuple[str, str]] = []
    if method in ("vif", "all"):
        removed += [(c, "vif") for c, v in vif_values(df, cols).items() if v > vif_limit]
    left = [c for c in cols if c not in dict(removed)]
    if method in ("variance", "all") and left:
        removed += [(r["column"], "variance") for r in variances(df, left, variance_limit).where("removed").collect()]
    left = [c for c in cols if c not in dict(removed)]
    if method in ("mutual_info", "all") and target and left:
        best = {r["column"] for r in mutual_information(df, target, left, k, method=estimator).collect()}
        removed += [(c, "mutual_info") for c in left if c not in best]
    report = df.sparkSession.createDataFrame(sorted(removed), "column string, reason string")
    return df.drop(*[c for c, _ in removed]), report


def interactions_pruned(df: DataFrame, cols: Sequence[str], degree: int = 2, most: int | None = None, vif_limit: float = 5.0) -> DataFrame:
    """Interactions, then without any of the columns and products whose VIF is above the limit."""
    wide = interactions(df, cols, degree, most)
    made = [c for c in wide.columns if c not in df.columns]
    values = vif_values(wide, [*cols, *made])
    return wide.drop(*[c for c in values if values[c] > vif_limit])


def transformation_summary(before: DataFrame, after: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """column, new_column, skew before and after, improvement, improved (> 0.5)."""
    stats = {new: {"before": sample_skewness(dbl(old)), "after": sample_skewness(dbl(new))} for old, new in pairs}
    source = F.create_map(*[x for old, new in pairs for x in (F.lit(new), F.lit(old))])
    gain = F.abs("before") - F.abs("after")
    return per_column(after, stats, "new_column").select(
        source[F.col("new_column")].alias("column"), "new_column", "before", "after", gain.alias("improvement"), (gain > 0.5).alias("improved"))


# ---- pipelines ----

def feature_pipeline(df: DataFrame, target: str | None = None, numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None) -> PipelineModel:
    """Fitted Spark ML pipeline: fill, index, one-hot, assemble, scale into `features`."""
    skip = [target] if target else []
    numbers, texts = list(numeric or numeric_columns(df, skip)), list(categorical or text_columns(df, skip))
    fills = fill_values(df, "auto", cols=numbers + texts)
    quoted = lambda v: "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    columns = []
    for c in df.columns:
        if c in numbers:
            columns.append(f"coalesce(cast(`{c}` as double), {float(fills.get(c, 0.0))!r}D) as `{c}`")
        elif c in texts:
            columns.append(f"coalesce(`{c}`, {quoted(fills.get(c, 'unknown'))}) as `{c}`")
        else:
            columns.append(f"`{c}`")
    indexed, coded = [f"{c}_index" for c in texts], [f"{c}_coded" for c in texts]
    stages = [SQLTransformer(statement=f"SELECT {', '.join(columns)} FROM __THIS__")]
    if texts:
        stages += [StringIndexer(inputCols=texts, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=indexed, outputCols=coded)]
    stages += [VectorAssembler(inputCols=numbers + coded, outputCol="assembled"),
               StandardScaler(inputCol="assembled", outputCol="features", withMean=False)]
    return Pipeline(stages=stages).fit(df)


def save_pipeline(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def run_pipeline(path: str, df: DataFrame) -> DataFrame:
    return PipelineModel.load(path).transform(df)
