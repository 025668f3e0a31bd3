"""Exact ranks, running totals and quantiles that never sort a whole table in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

HASH_PREFIX = 4          # 65,536 hash ranges per group
BUILTIN_ROWS = 2_000_000  # below this the built-in exact percentile is cheap
FEWEST_SPLITS, MOST_SPLITS = 32, 1024
MOST_RANKED = 900         # stay below the limit up to which ranks are trimmed in each task before the shuffle


def _splits(df: DataFrame) -> int:
    """Ranges of an order axis: four per shuffle partition, so that ranges outnumber tasks."""
    return max(FEWEST_SPLITS, min(MOST_SPLITS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def hash_order(keys: Sequence[str], seed: int = 42) -> Column:
    """Seeded pseudo-random order of rows; the same in any partitioning."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int = 42, by: Sequence[str] = (),
              rank: str = "hash_rank", size: str = "group_size") -> DataFrame:
    """Exact 1-based rank in seeded hash order inside each group, and the group size.

    Rows are first split by hash range, so that a group with most of the table
    is still ranked by many tasks; only range counts are summed in order.
    """
    groups = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    base = base.withColumn("_hash", hash_order(keys, seed)).withColumn("_range", F.substring("_hash", 1, HASH_PREFIX))
    counts = base.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy(*groups).orderBy("_range")
    offsets = counts.select(
        *groups, "_range",
        F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias(size))
    inside = Window.partitionBy(*groups, "_range").orderBy("_hash", *keys)
    ranked = _null_safe_join(base, offsets, [*groups, "_range"])
    return ranked.withColumn(rank, F.col("_before") + F.row_number().over(inside)).drop("_hash", "_range", "_before", "_all")


def running_totals(df: DataFrame, order: str, measures: Sequence[str], by: Sequence[str] = (),
                   few_groups: bool = True, following: str | None = None) -> DataFrame:
    """Adds before_<m> (sum over smaller `order`) and total_<m> per group, and optionally the following order value.

    `df` holds one row per (group, order value): aggregate first.  The order
    axis is cut at approximate quantiles into up to 1,025 ranges; range totals
    are summed in order and each range is then finished by its own task.
    `few_groups` states that groups are columns or classes, whose cut points
    (8 kB each) may be broadcast.
    """
    groups = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    splits = _splits(df)
    if isinstance(base.schema[order].dataType, T.StringType):     # no approximate quantiles for text: cut at hash-chosen values
        splits = min(splits, MOST_RANKED)
        chosen = Window.partitionBy(*groups).orderBy(F.xxhash64(order), order)
        cuts = (base.select(*groups, order).withColumn("_r", F.row_number().over(chosen)).where(F.col("_r") < splits)
                .groupBy(*groups).agg(F.array_sort(F.collect_list(order)).alias("_cuts")))
    else:
        probs = F.array(*[F.lit(i / splits) for i in range(1, splits)])
        cuts = base.groupBy(*groups).agg(
            F.array_sort(F.array_distinct(F.percentile_approx(order, probs, F.lit(20_000)))).alias("_cuts"))
    if few_groups:
        cuts = F.broadcast(cuts)
    value = F.col(order)
    placed = base.join(cuts, groups)
    # Cuts below the value, by halving steps; never null, so no null test is pushed in front of it.
    steps = F.array(*[F.lit(1 << i) for i in range(MOST_SPLITS.bit_length() - 1, -1, -1)])
    below = F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get("_cuts", n + step - 1) < value, step).otherwise(F.lit(0)))
    placed = placed.withColumn("_bucket", F.coalesce(below, F.lit(0))).drop("_cuts")
    sums = placed.groupBy(*groups, "_bucket").agg(F.min(order).alias("_first"), *[F.sum(m).alias(f"_s_{m}") for m in measures])
    ordered = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = sums.select(
        *groups, "_bucket", F.lead("_first").over(Window.partitionBy(*groups).orderBy("_bucket")).alias("_next"),
        *[F.coalesce(F.sum(f"_s_{m}").over(ordered), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(whole).alias(f"total_{m}") for m in measures])
    inside = Window.partitionBy(*groups, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(offsets, [*groups, "_bucket"])
    out = out.withColumns({f"before_{m}": F.col(f"_o_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures})
    if following:
        out = out.withColumn(following, F.coalesce(F.lead(order).over(Window.partitionBy(*groups, "_bucket").orderBy(order)), F.col("_next")))
    return out.drop("_bucket", "_all", "_next", *[f"_o_{m}" for m in measures])


def order_rank(df: DataFrame, order: str, keys: Sequence[str], seed: int = 42, rank: str = "order_rank",
               size: str = "table_size") -> DataFrame:
    """Exact 1-based rank by (order, hash of key), for splits by time.

    A single order value may hold a large part of the rows, so rows are spread
    over (order value, hash range) cells and only the cells are accumulated.
    """
    base = df.withColumn("_hash", hash_order(keys, seed)).withColumn("_range", F.substring("_hash", 1, HASH_PREFIX))
    cells = base.groupBy(order, "_range").agg(F.count(F.lit(1)).alias("_n"))
    values = running_totals(cells.groupBy(order).agg(F.sum("_n").alias("_n")), order, ["_n"])
    values = values.select(F.col(order).alias("_v"), F.col("before__n").alias("_vb"), F.col("total__n").alias(size))
    inner = Window.partitionBy(order).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_cb", F.coalesce(F.sum("_n").over(inner), F.lit(0))).drop("_n")
    cells = cells.join(values, cells[order] == values["_v"]).select(
        F.col(order).alias("_co"), F.col("_range").alias("_cr"), (F.col("_cb") + F.col("_vb")).alias("_before"), size)
    inside = Window.partitionBy(order, "_range").orderBy("_hash", *keys)
    out = base.join(cells, (F.col(order) == F.col("_co")) & (F.col("_range") == F.col("_cr")))
    return out.withColumn(rank, F.col("_before") + F.row_number().over(inside)).drop("_hash", "_range", "_co", "_cr", "_before")


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    builtin_rows: int = BUILTIN_ROWS, inside_limit: int = 4_000_000) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of whole columns as driver-side numbers.

    Large tables are narrowed by scans: an approximate grid brackets each
    quantile, exact counts confirm the bracket, and only distinct values inside
    it are shuffled.  Nothing the size of the column reaches one task.
    """
    cols = list(cols)
    if not cols:
        return {}
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    if data.count() <= builtin_rows:
        row = data.agg(*[F.percentile(c, F.array(*[F.lit(float(p)) for p in probs])).alias(c) for c in cols]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in cols}
    counts = data.agg(*[F.count(c).alias(c) for c in cols]).first()
    targets = {}
    for c in cols:
        for k, p in enumerate(probs):
            if counts[c]:
                h = (counts[c] - 1) * p
                targets[c, k] = (math.floor(h), math.ceil(h))
    brackets = {t: (None, None) for t in targets}
    below = {t: 0 for t in targets}
    inside = {t: counts[t[0]] for t in targets}
    tried_whole: set = set()
    while True:
        wide = [t for t in targets if inside[t] > inside_limit and t not in tried_whole]
        if not wide:
            break
        grid = F.array(*[F.lit(i / 1000) for i in range(1001)])
        sketches = list(dict.fromkeys((t[0], brackets[t]) for t in wide))       # quantiles of a column share its first sketch
        row = data.agg(*[F.percentile_approx(F.when(_within(c, bracket), F.col(c)), grid, F.lit(20_000)).alias(f"g{i}")
                         for i, (c, bracket) in enumerate(sketches)]).first()
        proposal = {}
        for t in wide:
            g, (lo, hi) = row[f"g{sketches.index((t[0], brackets[t]))}"], targets[t]
            start = math.floor((lo - below[t]) / inside[t] * 1000) - 1
            stop = math.ceil((hi + 1 - below[t]) / inside[t] * 1000) + 1
            old = brackets[t]
            proposal[t] = (g[start] if start > 0 else old[0], g[stop] if stop < 1000 else old[1])
        row = data.agg(*[
            F.sum(F.when(F.col(t[0]) < F.lit(proposal[t][0]), 1).otherwise(0) if proposal[t][0] is not None
                  else F.lit(0)).alias(f"b{i}") for i, t in enumerate(wide)], *[
            F.count(F.when(_within(t[0], proposal[t]), 1)).alias(f"n{i}") for i, t in enumerate(wide)]).first()
        for i, t in enumerate(wide):
            b, n = row[f"b{i}"], row[f"n{i}"]
            lo, hi = targets[t]
            confirmed = b <= lo and hi < b + n
            single = confirmed and proposal[t][0] is not None and proposal[t][0] == proposal[t][1]
            if not confirmed or single or n >= inside[t]:
                tried_whole.add(t)      # one heavy value, or no further gain: settle on the bracket at hand
            if confirmed:
                brackets[t], below[t], inside[t] = proposal[t], b, n
    answers = {c: [None] * len(probs) for c in cols}
    if not targets:
        return answers
    # Column values that fall in a bracket, as (target, value, count) with partial aggregation.
    listed = F.array(*[
        F.when(_within(t[0], brackets[t]), F.struct(F.lit(i).alias("t"), F.col(t[0]).alias("v")))
        for i, t in enumerate(targets)])
    values = data.select(F.inline(F.filter(listed, lambda s: s.isNotNull()))).groupBy("t", "v").agg(F.count(F.lit(1)).alias("n"))
    cumulative = running_totals(values, "v", ["n"], by=["t"])
    low, high = F.lit(None).cast("long"), F.lit(None).cast("long")
    for i, t in enumerate(targets):
        low = F.when(F.col("t") == i, F.lit(targets[t][0] - below[t])).otherwise(low)
        high = F.when(F.col("t") == i, F.lit(targets[t][1] - below[t])).otherwise(high)
    first, last = F.col("before_n"), F.col("before_n") + F.col("n")
    picked = cumulative.groupBy("t").agg(
        F.max(F.when((first <= low) & (low < last), F.col("v"))).alias("lo"),
        F.max(F.when((first <= high) & (high < last), F.col("v"))).alias("hi"))
    keys = list(targets)
    for row in picked.collect():     # one row per column and probability
        c, k = keys[row["t"]]
        h = (counts[c] - 1) * probs[k]
        answers[c][k] = row["lo"] + (row["hi"] - row["lo"]) * (h - math.floor(h))
    return answers


def _within(column: str, bracket: tuple) -> Column:
    test = F.col(column).isNotNull()
    if bracket[0] is not None:
        test = test & (F.col(column) >= F.lit(bracket[0]))
    if bracket[1] is not None:
        test = test & (F.col(column) <= F.lit(bracket[1]))
    return test


def grouped_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Exact quantiles per group as columns q0, q1, …; hot groups are split by value range."""
    return quantiles_of_counts(value_counts_of(df, value, by), probs, by)


def value_counts_of(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by…, _v, _n): how often each value stands in each group, nulls left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """grouped_quantiles from the table of value_counts_of, which is read several times: materialise it first."""
    run = running_totals(counts, "_v", ["_n"], by=by, few_groups=False)
    first, last, total = F.col("before__n"), F.col("before__n") + F.col("_n"), F.col("total__n")
    picks, out = [], []
    for i, p in enumerate(probs):
        h = (total - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        picks += [F.max(F.when((first <= lo) & (lo < last), F.col("_v"))).alias(f"_l{i}"),
                  F.max(F.when((first <= hi) & (hi < last), F.col("_v"))).alias(f"_h{i}")]
        out.append((F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) *
                    ((F.col("_total") - 1) * float(p) - F.floor((F.col("_total") - 1) * float(p)))).alias(f"q{i}"))
    return run.groupBy(*by).agg(F.max(total).alias("_total"), *picks).select(*by, *out)
