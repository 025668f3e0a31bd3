"""Mutual information from nearest neighbours, for numbers without binning.

Two numbers: the distance r from a point to its k-th neighbour in the plane of both (largest
difference, both columns divided by their deviation) gives the counts n_x and n_y of rows
that are closer than r in one column alone; the estimate is
psi(N) + mean(psi(k) - psi(n_x) - psi(n_y)), every count with the row itself (k without).
A number and a class: r is the distance to the k-th neighbour of the same class, and the
estimate psi(N) + mean(psi(k) - psi(rows of the class) - psi(n_x)).
Where more than k rows are equal, r is 0 and k becomes the number of equal rows, so columns
with few values are right too.

Rows are folded to distinct points with counts; neighbours come from the exact
nearest-neighbour join and counts from running totals over ranges of the value axis, so
nothing is compared with everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyglass.functions.expressions import dbl, numeric_columns
from tallyglass.functions.ranking import running_totals
from tallyglass.operators.neighbors import SMALL_DONOR_BYTES, nearest
from tallyglass.session import cut_lineage

INSIDE = 1 - 1e-9          # closer than r: at most this part of it


def digamma(n: Column) -> Column:
    """psi of whole numbers from 1, by its series at n + 6."""
    x = n.cast("double")
    y = x + 6
    head = F.log(y) - 1 / (2 * y) - 1 / (12 * y ** 2) + 1 / (120 * y ** 4) - 1 / (252 * y ** 6) + 1 / (240 * y ** 8)
    return head - sum((1 / (x + i) for i in range(1, 6)), 1 / x)


def range_counts(values: DataFrame, asked: DataFrame) -> DataFrame:
    """(grp, lo, hi, inside): rows of `values` (grp, v, n) with lo <= v <= hi, for the distinct (grp, lo, hi) of `asked`."""
    asked = asked.select("grp", "lo", "hi").distinct()
    ends = asked.select("grp", F.col("lo").alias("v")).unionAll(asked.select("grp", "hi")).select("grp", "v", F.lit(0).cast("long").alias("n"))
    axis = values.select("grp", "v", "n").unionAll(ends).groupBy("grp", "v").agg(F.sum("n").alias("n"))
    totals = cut_lineage(running_totals(axis, "v", ["n"], by=["grp"]).select("grp", "v", F.col("before_n").alias("below"), (F.col("before_n") + F.col("n")).alias("upto")))
    low, high = totals.select("grp", F.col("v").alias("lo"), "below"), totals.select("grp", F.col("v").alias("hi"), "upto")
    return asked.join(low, ["grp", "lo"]).join(high, ["grp", "hi"]).select("grp", "lo", "hi", (F.col("upto") - F.col("below")).alias("inside"))


def _reach(points: DataFrame, k: int, by: str, axes: Sequence[str], small_bytes: int) -> DataFrame:
    """points with r, the distance to the k-th other row of the same `by`, and kk, the neighbours it stands for; points: one row per place with its count c."""
    places = points.select(by, F.concat_ws("|", *[F.col(a).cast("string") for a in axes]).alias("place"), F.array(*axes).alias("vec"), "c")
    near = nearest(places, places, "place", "vec", k, by=by, exclude_self=True, small_bytes=small_bytes, metric="maximum")
    met = near.join(places.select(by, F.col("place").alias("neighbour"), F.col("c").alias("more")), [by, "neighbour"])
    upto = met.withColumn("upto", F.sum("more").over(Window.partitionBy(by, "place").orderBy("distance", "neighbour")))
    steps = upto.groupBy(by, "place").agg(F.sort_array(F.collect_list(F.struct("distance", "upto"))).alias("steps"))          # at most k of them
    held = points.withColumn("place", F.concat_ws("|", *[F.col(a).cast("string") for a in axes])).join(steps, [by, "place"], "left")
    enough = F.filter("steps", lambda s: s["upto"] + F.col("c") - 1 >= k)
    last = F.element_at("steps", -1)          # fewer than k others: the farthest
    found = F.when(F.col("c") - 1 >= k, F.lit(0.0)).when(F.size(enough) > 0, F.get(enough, F.lit(0))["distance"]).otherwise(F.coalesce(last["distance"], F.lit(0.0)))
    reached = F.when(F.size(enough) > 0, F.lit(k)).otherwise(F.coalesce(last["upto"], F.lit(0)) + F.col("c") - 1)
    return held.withColumn("r", found).withColumn("kk", F.when(F.col("r") == 0, F.col("c")).otherwise(reached).cast("long")).drop("steps", "place")


def _counted(reached: DataFrame, values: DataFrame, axis: str, name: str) -> DataFrame:
    """reached with `name`: rows of the column (grp) closer than r along one axis, the row itself included."""
    bounded = reached.withColumn("lo", F.col(axis) - F.col("r") * INSIDE).withColumn("hi", F.col(axis) + F.col("r") * INSIDE)
    found = range_counts(values, bounded).withColumnRenamed("inside", name)
    return bounded.join(found, ["grp", "lo", "hi"]).drop("lo", "hi")


def neighbour_information(df: DataFrame, target: str, cols: Sequence[str] | None = None, neighbours: int = 3, small_bytes: int = SMALL_DONOR_BYTES) -> DataFrame:
    """column, mutual_information in nats with the target, a number or (text, boolean) a class.

    Rows with a null in the column or the target do not count; a class of one row does not
    count. Columns without spread have no information. Never below 0.
    """
    numbers = numeric_columns(df)
    cols = [c for c in (cols or numbers) if c != target]
    number = target in numbers
    spread = df.agg(*[F.stddev_pop(dbl(c)).alias(f"s{i}") for i, c in enumerate([*cols, *([target] if number else [])])]).first()
    scaled = {c: dbl(c) / F.lit(float(spread[f"s{i}"] or 1.0)) for i, c in enumerate(cols)}
    y = dbl(target) / F.lit(float(spread[f"s{len(cols)}"] or 1.0)) if number else F.col(target).cast("string")
    stacked = df.select(y.alias("y"), *[x.alias(f"x{i}") for i, x in enumerate(scaled.values())])
    long = stacked.unpivot(["y"], [f"x{i}" for i in range(len(cols))], "grp", "x").where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x)")
    points = cut_lineage(long.groupBy("grp", "x", "y").agg(F.count(F.lit(1)).alias("c")))
    if number:
        reached = cut_lineage(_reach(points, neighbours, "grp", ["x", "y"], small_bytes))
        both = reached
        for axis in ("x", "y"):
            both = _counted(both, points.groupBy("grp", F.col(axis).alias("v")).agg(F.sum("c").alias("n")), axis, f"n_{axis}")
        gain = digamma(F.greatest("kk", F.lit(1))) - digamma(F.col("n_x")) - digamma(F.col("n_y"))
    else:
        sizes = points.groupBy("grp", "y").agg(F.sum("c").alias("size")).where("size > 1")
        known = cut_lineage(points.join(sizes, ["grp", "y"]).withColumn("klass", F.concat_ws("|", "grp", "y")))
        reached = cut_lineage(_reach(known, neighbours, "klass", ["x"], small_bytes))
        both = _counted(reached, known.groupBy("grp", F.col("x").alias("v")).agg(F.sum("c").alias("n")), "x", "n_x")
        gain = digamma(F.greatest("kk", F.lit(1))) - digamma(F.col("size")) - digamma(F.col("n_x"))
    totals = both.groupBy("grp").agg(F.sum("c").alias("n"), F.sum(F.col("c") * gain).alias("g"))
    names = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(f"x{i}"), F.lit(c))])
    return totals.select(names[F.col("grp")].alias("column"), F.greatest(digamma(F.col("n")) + F.col("g") / F.col("n"), F.lit(0.0)).alias("mutual_information"))
