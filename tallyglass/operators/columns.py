"""Projections, predicates, listings and small column helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.functions.expressions import numeric_columns, ratio, text_columns, time_columns

TEXT_MEAN_TOKENS = 3.0


def select_numeric(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    return df.select(*numeric_columns(df, exclude))


def select_categorical(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    return df.select(*text_columns(df, exclude))


def select_datetime(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    return df.select(*time_columns(df, exclude))


def feature_roles(df: DataFrame, target: str | None = None, id_uniqueness: float = 0.95) -> DataFrame:
    """(column, role): target, datetime, id, text, categorical or numeric.

    Ids are integer or string columns that are (nearly) unique; text columns
    average more than three blank-separated tokens.
    """
    text, numbers, times = set(text_columns(df)), set(numeric_columns(df)), set(time_columns(df))
    cols = [c for c in df.columns if c in text | numbers | times]
    may_be_id = {c for c in cols if c in text or dict(df.dtypes)[c] in ("int", "bigint", "smallint", "tinyint")}
    stats = []
    for i, c in enumerate(cols):
        if c in may_be_id and c != target:
            stats.append(F.count_distinct(F.col(c)).alias(f"d{i}"))
        if c in text:
            stats.append(F.avg(F.size(F.split(F.trim(F.col(c)), r"\s+"))).alias(f"t{i}"))
    stats.append(F.count(F.lit(1)).alias("n"))
    rows = []
    for i, c in enumerate(cols):
        base = F.lit("datetime" if c in times else "numeric" if c in numbers else "categorical")
        role = base
        if c in text:
            role = F.when(F.col(f"t{i}") > TEXT_MEAN_TOKENS, "text").otherwise(role)
        if c in may_be_id and c != target:
            role = F.when(F.col(f"d{i}") >= F.col("n") * id_uniqueness, "id").otherwise(role)
        rows.append(F.struct(F.lit(c).alias("column"), (F.lit("target") if c == target else role).alias("role")))
    return df.agg(*stats).select(F.inline(F.array(*rows)))


def preview(df: DataFrame, keys: Sequence[str], rows: int = 5) -> DataFrame:
    return df.orderBy(*keys).limit(rows)


def drop_null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Features without the target, and the target alone."""
    return df.drop(target), df.select(target)


def outside(column: Column | str, low: float, high: float) -> Column:
    """True for values strictly outside [low, high]."""
    c = F.col(column) if isinstance(column, str) else column
    return (c < F.lit(low)) | (c > F.lit(high))


def paged_listing(df: DataFrame, order: str, key: str, filters: Mapping[str, object] | None = None,
                  since: datetime | None = None, until: datetime | None = None, page: int = 1, size: int = 10) -> DataFrame:
    """Newest-first page of the matching rows, with the total and page count on each row."""
    hits = df
    for column, wanted in (filters or {}).items():
        hits = hits.where(F.col(column) == F.lit(wanted))
    if since is not None:
        hits = hits.where(F.col(order) >= F.lit(since))
    if until is not None:
        hits = hits.where(F.col(order) <= F.lit(until))
    total = hits.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))
    rows = hits.orderBy(F.col(order).desc(), F.col(key)).offset((page - 1) * size).limit(size)
    return rows.withColumn("_p", F.lit(1)).join(F.broadcast(total.withColumn("_p", F.lit(1))), "_p").drop("_p")


def member_listing(parents: DataFrame, children: DataFrame, key: str, child_key: str, column: str, wanted: Sequence[object],
                   order: str, offset: int = 0, limit: int = 50, owner: tuple[str, object] | None = None) -> DataFrame:
    """Parents whose `column` is in `wanted`, newest first, one page, with their child counts.

    The page is cut first, so the child table is only filtered by a broadcast
    of at most `limit` keys before counting.
    """
    hits = parents.where(F.col(column).isin(list(wanted)))
    if owner:
        hits = hits.where(F.col(owner[0]) == F.lit(owner[1]))
    page = hits.orderBy(F.col(order).desc(), F.col(key)).offset(offset).limit(limit)
    own = children.withColumnRenamed(child_key, "_ck").join(F.broadcast(page.select(F.col(key).alias("_ck"))), "_ck", "left_semi")
    counts = own.groupBy("_ck").agg(F.count(F.lit(1)).alias("child_count"))
    return page.join(counts, page[key] == counts["_ck"], "left").drop("_ck").fillna(0, ["child_count"])


def top_k(df: DataFrame, score: str, k: int, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), *ties).limit(k)


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return ratio(a, b, default)
