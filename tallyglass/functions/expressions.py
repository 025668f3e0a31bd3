"""Column expressions and one-pass aggregation helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

MAX_EXPRESSIONS_PER_PASS = 200


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def time_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in exclude]


def atomic_columns(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return [f.name for f in df.schema if not isinstance(f.dataType, nested)]


def logical_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "string"


def one(condition: Column) -> Column:
    """1 where the condition holds, else 0 (nulls count as 0)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(one(condition)), F.lit(0)).cast("long")


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b without an error on b = 0."""
    value = F.try_divide(a.cast("double"), b.cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def dbl(name: str) -> Column:
    return F.col(name).cast("double")


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness; null under three values."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null under four values."""
    n = F.count(x).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows with both values; null when either side is constant there.

    Not the built-in, which raises on a constant column under ANSI rules.  Least and
    greatest value tell a constant: merging partial means can leave its deviation above 0.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def null_free_floats(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in float columns, so that one notion of missing remains."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def per_column(df: DataFrame, stats: Mapping[str, Mapping[str, Column]], label: str = "column") -> DataFrame:
    """One row per column from a single scan.

    `stats[column][statistic]` is an aggregate; all columns share the statistic
    names and types.  Above MAX_EXPRESSIONS_PER_PASS aggregates the columns are
    split over several scans so that generated code stays compilable.
    """
    names = list(stats)
    width = max(1, len(next(iter(stats.values()))))
    step = max(1, MAX_EXPRESSIONS_PER_PASS // width)
    frames = []
    for start in range(0, len(names), step):
        chunk = names[start:start + step]
        aggregates, structs = [], []
        for i, name in enumerate(chunk):
            fields = [F.lit(name).alias(label)]
            for j, (stat, expr) in enumerate(stats[name].items()):
                aggregates.append(expr.alias(f"a{i}_{j}"))
                fields.append(F.col(f"a{i}_{j}").alias(stat))
            structs.append(F.struct(*fields))
        frames.append(df.agg(*aggregates).select(F.inline(F.array(*structs))))
    return union_all(frames)


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column, distinct_count without nulls.

    One narrow scan per column: several distinct counts in one aggregation
    would copy every row, all columns wide, once per column into the shuffle.
    """
    one_each = [df.where(F.col(c).isNotNull()).groupBy(c).agg(F.lit(1).alias("_x")).agg(F.count(F.lit(1)).alias("distinct_count")).select(
        F.lit(c).alias("column"), "distinct_count") for c in cols]
    return union_all(one_each)


def tidy(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "statistic", value: str = "value") -> DataFrame:
    """Wide statistics to (ids, statistic, value) rows, values as double."""
    wide = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return wide.unpivot(list(ids), list(values), name, value)


def long_values(df: DataFrame, cols: Sequence[str], cast: str = "double", keep: Sequence[str] = ()) -> DataFrame:
    """(keep, column, value) rows for the given columns, nulls left out."""
    wide = df.select(*keep, *[F.col(c).cast(cast).alias(c) for c in cols])
    return wide.unpivot(list(keep), list(cols), "column", "value").where(F.col("value").isNotNull())
