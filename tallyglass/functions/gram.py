"""Sums of products of many columns in one scan.

A task adds up matrix products of its batches and gives one row per matrix row when it
ends; rows of equal number are summed by a shuffle of (tasks x matrix rows) rows. Only the
sums, as large as the matrices and independent of the number of rows, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyglass.functions.expressions import dbl

#: Sums that still fit one aggregation of column expressions.
EXPRESSIONS = 100
#: Below this share of the second moment a variance is rounding noise of its own sums.
NOISE = 1e-9


def values_of(batch: pa.RecordBatch) -> np.ndarray:
    """rows x columns of a batch of doubles, NaN for null."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]) if batch.num_columns else np.empty((batch.num_rows, 0))


def summed(df: DataFrame, cols: Sequence[str], blocks: int, products: Callable[[np.ndarray], np.ndarray], size: int | None = None) -> np.ndarray:
    """`products(rows x columns, NaN for null)`, of shape (blocks, size, size), summed over all rows; zeros for an empty table."""
    fields = "block int, line int, total array<double>"
    schema = pa.schema([("block", pa.int32()), ("line", pa.int32()), ("total", pa.list_(pa.float64()))])
    p = size or len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = products(values_of(batch))
                total = part if total is None else total + part
        if total is not None:
            for block in range(len(total)):
                yield pa.RecordBatch.from_pydict({"block": [block] * p, "line": list(range(p)), "total": list(total[block])}, schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            values = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else ()
            for key, line in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), values):
                sums[key] = sums[key] + line if key in sums else line
        if sums:
            yield pa.RecordBatch.from_pydict({"block": [k[0] for k in sums], "line": [k[1] for k in sums], "total": list(sums.values())}, schema=schema)
    numbers = df.select(*[dbl(c).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = numbers.mapInArrow(run, fields).repartition("block", "line").mapInArrow(add, fields).collect()      # blocks x size rows
    out = np.zeros((blocks, p, p))
    for r in rows:
        out[r["block"], r["line"]] += r["total"]
    return out


def pair_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, np.ndarray]:
    """p x p matrices over the rows that have both values: `n`, `mean` (of the row's column), `cov` (population) and `var` (of the row's column).

    Values are centred by their column's mean first, so sums stay small. A variance that is
    noise next to the second moment is NaN in `var`, 0 where the whole column is constant.
    """
    cols = list(cols)
    first = df.agg(*[f(dbl(c)).alias(f"{name}{i}") for i, c in enumerate(cols) for name, f in (("m", F.avg), ("lo", F.min), ("hi", F.max))]).first()
    centre = np.array([first[f"lo{i}"] if first[f"lo{i}"] == first[f"hi{i}"] else first[f"m{i}"] for i in range(len(cols))], dtype=float)
    constant = np.array([first[f"lo{i}"] is None or first[f"lo{i}"] == first[f"hi{i}"] for i in range(len(cols))])
    centre = np.nan_to_num(centre)

    def products(x: np.ndarray) -> np.ndarray:
        seen = (~np.isnan(x)).astype(float)
        x = np.nan_to_num(x - centre, nan=0.0)
        return np.stack([seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x])
    n, s, q, xy = summed(df, cols, 4, products)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean, second = s / n, q / n
        var = second - mean * mean
        var = np.where(constant[:, None] | (n == 1), 0.0, np.where(var > NOISE * second, var, np.nan))
        return {"n": n, "mean": mean + centre[:, None], "cov": xy / n - mean * mean.T, "var": var}


def gram_of_holes(x: np.ndarray, seen: np.ndarray, holes: Sequence[int]) -> np.ndarray:
    """Per hole column t the (p + 1) x (p + 1) sums of products, a one first, over the rows that have t.

    All rows' sums less those of the rows without t: the work grows with the missing cells,
    not with holes x rows, and no null pattern is listed.
    """
    x = np.column_stack([np.ones(len(x)), x])
    every = x.T @ x
    return np.stack([every - x[~seen[:, t]].T @ x[~seen[:, t]] for t in holes])
