"""Feature steps that are fitted on one table, saved, and applied to any other.

What a step learns is either a few numbers (fill value, mean, edges, lambda) or a table
by value (codes, target means). Numbers are saved as JSON rows, tables as Parquet, so
applying to new rows is a projection or one join.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyglass.functions.expressions import dbl
from tallyglass.functions.ranking import exact_quantiles
from tallyglass.operators.features import _boxcox, _category_shares, bin_by_edges, boxcox_lambda, boxcox_shift, hash_encode, label_codes
from tallyglass.operators.imputation import fill_values
from tallyglass.session import cut_lineage

KINDS = ("impute", "log", "boxcox", "scale", "bins", "rare", "label", "target", "hash")


@dataclass(frozen=True)
class Step:
    """One step on one column; options depend on the kind.

    impute(strategy), log(), boxcox(), scale(method: standard, minmax or robust), bins(bins),
    rare(limit), label(), target(target), hash(width).
    """

    kind: str
    column: str
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown step: {self.kind}")


def fit_steps(df: DataFrame, steps: Sequence[Step]) -> FittedSteps:
    """Fit the steps in order, each on what the ones before made of `df`."""
    fitted = FittedSteps(df.sparkSession, [], {})
    for step in steps:
        learned, table = _learn(df, step)
        fitted.steps.append((step, learned))
        if table is not None:
            fitted.tables[len(fitted.steps) - 1] = cut_lineage(table)
        df = fitted._apply(df, len(fitted.steps) - 1)
    return fitted


def _learn(df: DataFrame, step: Step) -> tuple[dict, DataFrame | None]:
    """(numbers, table by value) of one step."""
    c, o = step.column, step.options
    if step.kind == "impute":
        return {"fill": fill_values(df, o.get("strategy", "auto"), cols=[c]).get(c)}, None
    if step.kind in ("log", "boxcox"):
        low = df.agg(F.min(dbl(c))).first()[0]
        low = 1.0 if low is None else low
        if step.kind == "log":
            return {"shift": 1 - low if low <= 0 else 0.0}, None
        shift = boxcox_shift(low)
        return {"shift": shift, "lambda": boxcox_lambda(df, c, shift)}, None
    if step.kind == "scale":
        method = o.get("method", "standard")
        if method == "robust":
            low, middle, high = exact_quantiles(df, [c], [0.25, 0.5, 0.75])[c]
            center, spread = middle, None if low is None else high - low
        else:
            row = df.agg(F.avg(dbl(c)).alias("a"), F.stddev_pop(dbl(c)).alias("s"), F.min(dbl(c)).alias("l"), F.max(dbl(c)).alias("h")).first()
            center, spread = (row["a"], row["s"]) if method == "standard" else (row["l"], None if row["l"] is None else row["h"] - row["l"])
        return {"center": center, "spread": spread}, None
    if step.kind == "bins":
        n = o.get("bins", 5)
        return {"edges": exact_quantiles(df, [c], [i / n for i in range(n + 1)])[c]}, None
    if step.kind == "rare":
        return {}, _category_shares(df, c).where(F.col("_share") >= o.get("limit", 0.01)).select(F.col("_value").alias("value"), F.lit(True).alias("learned"))
    if step.kind == "label":
        return {}, label_codes(df, c).select("value", F.col("code").alias("learned"))
    if step.kind == "target":
        y = dbl(o["target"])
        return {"mean": df.agg(F.avg(y)).first()[0]}, df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.avg(y).alias("learned"))
    return {}, None


class FittedSteps:
    """Fitted steps: `transform` applies them, `save` and `load` keep them."""

    def __init__(self, spark: SparkSession, steps: list[tuple[Step, dict]], tables: dict[int, DataFrame]):
        self.spark, self.steps, self.tables = spark, steps, tables

    def transform(self, df: DataFrame) -> DataFrame:
        """All steps on new rows. Unknown values: rare becomes __OTHER__, label is null, target is the overall mean."""
        for i in range(len(self.steps)):
            df = self._apply(df, i)
        return df

    def _apply(self, df: DataFrame, i: int) -> DataFrame:
        step, learned = self.steps[i]
        c, x = step.column, dbl(step.column)
        if step.kind == "impute":
            return df if learned["fill"] is None else df.withColumn(c, F.coalesce(F.col(c), F.lit(learned["fill"])))
        if step.kind == "log":
            return df.withColumn(f"{c}_log", F.when(x + learned["shift"] > 0, F.log(x + learned["shift"])))
        if step.kind == "boxcox":
            return df.withColumn(f"{c}_boxcox", F.when(x + learned["shift"] > 0, _boxcox(x + learned["shift"], learned["lambda"])))
        if step.kind == "scale":
            center, spread = learned["center"], learned["spread"]
            scaled = F.lit(None).cast("double") if center is None else (x - F.lit(float(center))) / F.lit(float(spread) if spread and math.isfinite(spread) else 1.0)
            return df.withColumn(f"{c}_scaled", scaled)
        if step.kind == "bins":
            return df if learned["edges"][0] is None else df.withColumn(f"{c}_binned", bin_by_edges(F.least(x, F.lit(float(learned["edges"][-1]))), learned["edges"], "Q"))
        if step.kind == "hash":
            return hash_encode(df, c, step.options.get("width", 10))
        table = self.tables[i].select(F.col("value").alias("_value"), F.col("learned").alias("_learned"))
        joined = df.join(table, F.col(c) == F.col("_value"), "left")
        if step.kind == "rare":
            out = {c: F.when(F.col(c).isNull() | F.col("_learned"), F.col(c)).otherwise("__OTHER__")}
        elif step.kind == "label":
            out = {f"{c}_code": F.col("_learned")}
        else:
            out = {f"{c}_target_encoded": F.coalesce("_learned", F.lit(learned["mean"]).cast("double"))}
        return joined.withColumns(out).drop("_value", "_learned")

    def save(self, path: str) -> str:
        rows = [(i, s.kind, s.column, json.dumps(s.options), json.dumps(learned)) for i, (s, learned) in enumerate(self.steps)]
        self.spark.createDataFrame(rows, "step int, kind string, column string, options string, learned string").coalesce(1).write.mode("overwrite").parquet(f"{path}/steps")
        for i, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/table-{i}")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedSteps:
        rows = spark.read.parquet(f"{path}/steps").orderBy("step").collect()           # one row per step
        steps = [(Step(r["kind"], r["column"], json.loads(r["options"])), json.loads(r["learned"])) for r in rows]
        return cls(spark, steps, {i: spark.read.parquet(f"{path}/table-{i}") for i, (s, _) in enumerate(steps) if s.kind in ("rare", "label", "target")})
