"""Exact k-nearest-neighbour join by a two-level pivot tree (Euclidean distance, or the largest difference of a component).

Vectors go to the nearest of a few coarse pivots, and within that coarse cell to the
nearest of its fine pivots.  Coarse pivots are few and known to every task; fine pivots and
the radii of their cells are a table.  A cell holds about 2 sqrt(n) vectors, at most about
`block_rows`, so the number of cells grows with sqrt(n), and beyond with n / block_rows.  A
query first meets the donors of its own cell; its k-th distance there then rules out, by
the triangle inequality, coarse cells that cannot hold a closer donor, and in the others
fine cells.  Only the remaining cells are visited.  Equal vectors are folded first (of n
copies only the k+1 smallest keys can ever be neighbours), and large cells are split into
bounded blocks, each solved by its own task with numpy.  Ties go to the smallest key.
Nothing is capped or skipped that could change the result.

Donors measured to fit SMALL_DONOR_BYTES are broadcast instead: then every
query task finds its neighbours alone, without a shuffle of the queries.

Vectors of more than WIDE components leave next to no cell out, so their queries and donors
are cut into blocks and every two blocks meet in one task (`_near_blocks`): the cost is
queries x donors, memory that of two blocks.

Inside a task (`Donors`) short vectors lie in leaves with bounding boxes and a few close
queries look only into leaves whose box may hold a closer donor; long ones are first
compared by matrix products, with the rounding error added to every limit. The distances
that count are always plain differences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyglass.session import cut_lineage

MAX_PIVOTS = 256            # coarse pivots of all groups together
LEAST_CELL = 32
BLOCK_ROWS = 20_000
CHUNK_DOUBLES = 4_000_000
SMALL_DONOR_BYTES = 32_000_000
SMALL_QUERY_ROWS = 10_000_000
WIDE = 16                   # components from which boxes and cells rule out next to nothing
WIDE_BLOCK_BYTES = 32_000_000
DONOR_LEAF, QUERY_LEAF, FIRST_LEAVES = 64, 128, 16        # a group of queries spans about two leaves of donors


def as_vector(*columns: str) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances of a chunk of `a` to all of `b`), by plain differences to keep equal distances equal."""
    step = max(1, CHUNK_DOUBLES // max(1, b.shape[0] * b.shape[1]))
    for start in range(0, len(a), step):
        diff = a[start:start + step, None, :] - b[None, :, :]
        yield start, np.abs(diff).max(axis=2) if metric == "maximum" else np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))


def _all_distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    return np.vstack([d for _, d in _distances(a, b, metric)])


def _closest(dist: np.ndarray, keys: list, need: int) -> list[list[tuple[float, object]]]:
    """Per row of distances, the `need` smallest (distance, key) pairs over folded copies."""
    width = min(need, dist.shape[1])
    limit = np.partition(dist, width - 1, axis=1)[:, width - 1]
    return [sorted((float(row[j]), key) for j in np.nonzero(row <= top)[0] for key in keys[j])[:need] for row, top in zip(dist, limit)]


def _leaves(matrix: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): the rows in runs of at most `size` close ones (more only if equal), by halves along the longest side."""
    order, starts, todo = np.arange(len(matrix)), [], [(0, len(matrix))]
    while todo:
        lo, hi = todo.pop()
        rows = order[lo:hi]
        x = matrix[rows]
        sides = x.max(axis=0) - x.min(axis=0) if hi - lo > size else np.zeros(1)
        if not sides.max() > 0:
            starts.append(lo)
            continue
        half = (hi - lo) // 2
        order[lo:hi] = rows[np.argpartition(x[:, sides.argmax()], half)]
        todo += [(lo + half, hi), (lo, lo + half)]
    return order, np.array(starts)


class Donors:
    """Distinct donor vectors of one task with the keys that stand for each, searched without a look at most of them."""

    def __init__(self, matrix: np.ndarray, keys: list, metric: str = "euclidean"):
        self.matrix, self.keys, self.metric, self.kind = matrix, keys, metric, "plain"
        if not len(matrix) or not np.isfinite(matrix).all():
            return
        if matrix.shape[1] <= WIDE:
            self.kind = "boxes"
            order, self.starts = _leaves(matrix, DONOR_LEAF)
            self.matrix, self.keys = matrix[order], [keys[i] for i in order]
            self.sizes = np.diff(np.append(self.starts, len(matrix)))
            self.lows, self.highs = (f.reduceat(self.matrix, self.starts, axis=0) for f in (np.minimum, np.maximum))
        elif metric == "euclidean" and 1e-100 < np.abs(matrix).max() < 1e100:
            self.kind = "products"
            self.center = matrix.mean(axis=0)
            self.scale = 2.0 ** -np.ceil(np.log2(max(np.abs(matrix - self.center).max(), 1e-100) * math.sqrt(matrix.shape[1])))
            self.small = ((matrix - self.center) * self.scale).astype(np.float32)
            self.squares = np.einsum("ij,ij->i", self.small, self.small)

    def closest(self, queries: np.ndarray, need: int) -> list[list[tuple[float, object]]]:
        """Per query the `need` smallest (distance, key) pairs."""
        finite = np.isfinite(queries).all()
        if self.kind == "boxes" and finite:
            return self._by_boxes(queries, need)
        if self.kind == "products" and finite and np.abs((queries - self.center) * self.scale).max(initial=0) < 1e6:
            return [x for start in range(0, len(queries), 512) for x in self._by_products(queries[start:start + 512], need)]
        return [x for _, dist in _distances(queries, self.matrix, self.metric) for x in _closest(dist, self.keys, need)]

    def _rows(self, leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(s, s + n) for s, n in zip(self.starts[leaves], self.sizes[leaves])])

    def _by_boxes(self, queries: np.ndarray, need: int) -> list:
        found: list = [None] * len(queries)
        order, starts = _leaves(queries, max(4, min(QUERY_LEAF, 2 * DONOR_LEAF * len(queries) // len(self.matrix))))
        for rows in np.split(order, starts[1:]):
            part = queries[rows]
            apart = np.maximum(0, np.maximum(self.lows - part.max(axis=0), part.min(axis=0) - self.highs))
            gap = apart.max(axis=1) if self.metric == "maximum" else np.sqrt(np.einsum("ij,ij->i", apart, apart))
            most = min(len(gap), max(need, FIRST_LEAVES))
            near = np.argpartition(gap, most - 1)[:most]
            near = near[np.argsort(gap[near])]
            held = np.cumsum(self.sizes[near])
            bound = np.inf
            if held[-1] >= need:
                some = max(int(np.searchsorted(held, need)) + 1, min(FIRST_LEAVES, int((gap == 0).sum())))
                first = self.matrix[self._rows(near[:some])]
                bound = max(np.partition(dist, need - 1, axis=1)[:, need - 1].max() for _, dist in _distances(part, first, self.metric))
            at = self._rows(np.flatnonzero(gap <= bound * (1 + 1e-9)))
            keys = [self.keys[j] for j in at]
            for start, dist in _distances(part, self.matrix[at], self.metric):
                for i, best in zip(rows[start:start + len(dist)], _closest(dist, keys, need)):
                    found[i] = best
        return found

    def _by_products(self, queries: np.ndarray, need: int) -> list:
        small = ((queries - self.center) * self.scale).astype(np.float32)
        squares = np.einsum("ij,ij->i", small, small)
        slack = 2 * (queries.shape[1] + 16) * 6e-8 * (squares.astype(float) + float(self.squares.max()))       # of rounding, inputs included
        limit, n, width = np.full(len(queries), np.inf), len(self.matrix), max(8192, need)
        row, at, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for lo in range(0, n, width):
            about = squares[:, None] + self.squares[None, lo:lo + width] - 2 * (small @ self.small[lo:lo + width].T)
            if not lo and about.shape[1] >= need:
                limit = np.partition(about, need - 1, axis=1)[:, need - 1] + 2 * slack
            r, c = np.nonzero(about <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None])
            c += lo
            exact = [np.empty(0)]
            for start in range(0, len(r), 50_000):
                diff = queries[r[start:start + 50_000]] - self.matrix[c[start:start + 50_000]]
                exact.append(np.sqrt(np.einsum("ik,ik->i", diff, diff)))
            row, at, dist = np.append(row, r), np.append(at, c), np.append(dist, np.concatenate(exact))
            order = np.lexsort((dist, row))
            row, at, dist = row[order], at[order], dist[order]
            begin, end = np.searchsorted(row, np.arange(len(queries))), np.searchsorted(row, np.arange(len(queries)), "right")
            kth = np.where(end - begin >= need, dist[np.minimum(begin + need, end) - 1] if len(dist) else np.inf, np.inf)
            limit = np.minimum(limit, (kth * self.scale) ** 2 + slack)
            kept = dist <= kth[row]
            row, at, dist = row[kept], at[kept], dist[kept]
        cuts = np.searchsorted(row, np.arange(len(queries) + 1))
        pairs = list(zip(dist.tolist(), at.tolist()))
        return [sorted((x, key) for x, j in pairs[a:b] for key in self.keys[j])[:need] for a, b in zip(cuts[:-1], cuts[1:])]


def _near_broadcast(rows: DataFrame, donors: DataFrame, key_type: str, need: int, metric: str) -> DataFrame:
    """(g, key, near) with the donors, whose size the caller has measured, sent to every task."""
    groups: dict[str, tuple[list, list]] = {}
    for r in donors.collect():
        vectors, keys = groups.setdefault(r["g"], ([], []))
        vectors.append(r["vec"])
        keys.append(r["keys"])
    spark = rows.sparkSession
    n = rows.count()
    if n <= SMALL_QUERY_ROWS:      # few rows come in few partitions: spread the distance work over the cores
        work = n * sum(len(v) * len(v[0]) for v, _ in groups.values()) / 20_000_000
        rows = rows.repartition(max(1, min(4 * spark.sparkContext.defaultParallelism, math.ceil(work))))
    shared = spark.sparkContext.broadcast({g: Donors(np.array(v, dtype=float), k, metric) for g, (v, k) in groups.items()})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, part in pdf.groupby("g"):
                if g not in shared.value:
                    continue
                near = [[{"distance": x, "neighbour": n} for x, n in found] for found in shared.value[g].closest(_matrix(part["vec"]), need)]
                yield pd.DataFrame({"g": part["g"], "key": part["key"], "near": pd.Series(near, index=part.index)})

    return rows.mapInPandas(search, f"g string, key {key_type}, near array<struct<distance: double, neighbour: {key_type}>>")


def _near_blocks(queries: DataFrame, donors: DataFrame, sizes: dict[str, int], key_type: str, need: int, block_rows: int, metric: str) -> DataFrame:
    """(g, qid, near) of queries (g, qid, vec): blocks of queries and donors of bounded size, every two in one task, which gives its `need` closest."""
    asked = {r["g"]: r["n"] for r in queries.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
    plan = []
    for g in asked.keys() & sizes.keys():
        parts = math.ceil(sizes[g] / block_rows)
        plan.append((g, max(math.ceil(asked[g] / block_rows), min(math.ceil(asked[g] / 500), math.ceil(tasks / parts))), parts))
    load = F.broadcast(queries.sparkSession.createDataFrame(plan or [("", 1, 1)], "g string, q_parts long, d_parts long"))          # one row per group
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = queries.join(load, "g").withColumn("q_block", F.pmod(F.xxhash64("qid"), F.col("q_parts"))).withColumn("d_block", every("d_parts"))
    right = donors.join(load, "g").withColumn("d_block", F.pmod(F.xxhash64("vec", F.lit(7)), F.col("d_parts"))).withColumn("q_block", every("q_parts"))

    def solve(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(ds):
            return pd.DataFrame({"g": [], "qid": [], "near": []})
        found = Donors(_matrix(ds["vec"]), ds["keys"].tolist(), metric).closest(_matrix(qs["vec"]), need)
        return pd.DataFrame({"g": qs["g"], "qid": qs["qid"], "near": pd.Series([[{"distance": x, "neighbour": n} for x, n in f] for f in found], index=qs.index)})
    keys = ["g", "q_block", "d_block"]
    met = _renewed(left.select(*keys, "qid", "vec")).groupBy(*keys).cogroup(_renewed(right.select(*keys, "vec", "keys")).groupBy(*keys)).applyInPandas(
        solve, f"g string, qid {key_type}, near array<struct<distance: double, neighbour: {key_type}>>")
    return met.groupBy("g", "qid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, need).alias("near"))          # `need` of each block of donors


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that a table can meet one that was made from it."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


class PivotTree:
    """Donors (g, vec, keys) dealt to the cells of two levels of pivots; `sizes`: number of donors of each group.

    `coarse`: group -> matrix of pivots, `tables`: group -> rows (cell, keys, least and
    largest distance to the pivot), both bounded by MAX_PIVOTS rows or one per group.
    `cells`: (g, coarse, cell, pivot, lo, hi, n, vectors), one row per fine cell.
    `placed`: (g, coarse, cell, vec, keys).
    """

    def __init__(self, donors: DataFrame, sizes: dict[str, int], key_type: str, need: int, block_rows: int, max_pivots: int, metric: str = "euclidean"):
        self.key_type, self.need, self.block_rows, self.metric = key_type, need, block_rows, metric
        # a cell's share of a large group, and how many coarse cells: the square root of the number of cells
        self.leaf = {g: min(block_rows, max(LEAST_CELL, 2 * math.isqrt(n))) for g, n in sizes.items()}
        budget = max(1, max_pivots // max(1, len(sizes)))
        wanted = {g: max(1, min(budget, math.isqrt(math.ceil(n / self.leaf[g])))) for g, n in sizes.items()}
        order = Window.partitionBy("g").orderBy(F.xxhash64("vec"), "vec")
        picked = donors.select("g", "vec").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(wanted.values(), default=1))
        found: dict[str, list] = {}
        for row in picked.orderBy("g", "_r").collect():                    # at most max_pivots rows, or one per group
            if row["_r"] <= wanted[row["g"]]:
                found.setdefault(row["g"], []).append(row["vec"])
        self.coarse = {g: np.array(v, dtype=float) for g, v in found.items()}
        placed = cut_lineage(donors.mapInPandas(self._to_coarse(), f"g string, vec array<double>, keys array<{key_type}>, coarse int, radius double"))
        rows = placed.groupBy("g", "coarse").agg(F.sum(F.size("keys")).alias("n"), F.count(F.lit(1)).alias("vectors"), F.min("radius").alias("lo"), F.max("radius").alias("hi")).collect()
        self.tables: dict[str, np.ndarray] = {}
        for g in {r["g"] for r in rows}:
            self.tables[g] = np.array(sorted((r["coarse"], r["n"], r["lo"], r["hi"]) for r in rows if r["g"] == g), dtype=float)
        fine = [(r["g"], r["coarse"], max(1, math.ceil(r["vectors"] / self.leaf[r["g"]]))) for r in rows]
        asked = donors.sparkSession.createDataFrame(fine or [("", -1, 1)], "g string, coarse int, fine int")
        within = Window.partitionBy("g", "coarse").orderBy(F.xxhash64("vec", F.lit(3)), "vec")
        most = max([f for *_, f in fine], default=1)
        self.pivots = cut_lineage(placed.select("g", "coarse", "vec").withColumn("cell", F.row_number().over(within)).where(F.col("cell") <= most)
                                  .join(F.broadcast(asked), ["g", "coarse"]).where(F.col("cell") <= F.col("fine")).select("g", "coarse", "cell", F.col("vec").alias("pivot")))
        self.placed = cut_lineage(self._meet_pivots(placed.select("g", "coarse", "vec", "keys"), self.pivots, self._to_fine(), f"g string, coarse int, vec array<double>, keys array<{key_type}>, cell int, radius double"))
        shape = self.placed.groupBy("g", "coarse", "cell").agg(F.sum(F.size("keys")).alias("n"), F.count(F.lit(1)).alias("vectors"), F.min("radius").alias("lo"), F.max("radius").alias("hi"))
        self.cells = cut_lineage(self.pivots.join(shape, ["g", "coarse", "cell"]))

    def _to_coarse(self):
        coarse, metric = self.coarse, self.metric

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for g, part in pdf.groupby("g"):
                    if g in coarse:
                        dist = _all_distances(_matrix(part["vec"]), coarse[g], metric)
                        home = dist.argmin(axis=1)
                        yield part.assign(coarse=home.astype("int32"), radius=dist[np.arange(len(part)), home])
        return place

    def _meet_pivots(self, rows: DataFrame, pivots: DataFrame, solve, schema: str) -> DataFrame:
        """Rows of a coarse cell, in blocks of about block_rows, with the pivots of that cell."""
        load = rows.groupBy("g", "coarse").agg(F.ceil(F.count(F.lit(1)) / self.block_rows).cast("long").alias("parts"))          # one row per coarse cell
        left = rows.join(F.broadcast(load), ["g", "coarse"]).withColumn("block", F.pmod(F.xxhash64("vec", F.lit(5)), F.col("parts"))).drop("parts")
        right = pivots.join(F.broadcast(load), ["g", "coarse"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        keys = ["g", "coarse", "block"]
        return _renewed(left).groupBy(*keys).cogroup(_renewed(right).groupBy(*keys)).applyInPandas(solve, schema)

    def _to_fine(self):
        metric = self.metric

        def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return left.assign(cell=pd.Series(dtype="int32"), radius=pd.Series(dtype="float64")).drop(columns="block").iloc[:0]
            right = right.sort_values("cell")
            ids, pivots = right["cell"].to_numpy(), _matrix(right["pivot"])
            home, radius = np.empty(len(left), np.int64), np.empty(len(left))
            for start, dist in _distances(_matrix(left["vec"]), pivots, metric):
                at = dist.argmin(axis=1)
                home[start:start + len(dist)], radius[start:start + len(dist)] = at, dist[np.arange(len(dist)), at]
            return left.drop(columns="block").assign(cell=ids[home].astype("int32"), radius=radius)
        return solve

    def homes(self, queries: DataFrame) -> DataFrame:
        """(g, qid, vec, coarse, cell) of each query's own cell."""
        key_type, coarse = self.key_type, self._to_coarse()

        def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in coarse(batches):
                yield part[["g", "qid", "vec", "coarse"]]
        near = queries.mapInPandas(first, f"g string, qid {key_type}, vec array<double>, coarse int")
        made = self._meet_pivots(near, self.pivots, self._to_fine(), f"g string, qid {key_type}, vec array<double>, coarse int, cell int, radius double")
        return made.drop("radius")

    def away(self, bounded: DataFrame) -> DataFrame:
        """(g, qid, vec, coarse, cell) of the other cells that may hold a closer donor than `kth` (null: unknown) of (g, qid, vec, coarse, cell, kth)."""
        coarse, tables, need, key_type, metric = self.coarse, self.tables, self.need, self.key_type, self.metric

        def open_coarse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for g, part in pdf.groupby("g"):
                    if g not in tables:
                        continue
                    ids, count, low, high = tables[g][:, 0].astype(int), tables[g][:, 1], tables[g][:, 2], tables[g][:, 3]
                    dist = _all_distances(_matrix(part["vec"]), coarse[g], metric)[:, ids]
                    reach = dist + high
                    ranked = np.argsort(reach, axis=1)
                    enough = np.cumsum(count[ranked], axis=1) >= need
                    rows = np.arange(len(part))
                    bound = np.where(enough.any(axis=1), reach[rows, ranked[rows, enough.argmax(axis=1)]], np.inf)
                    bound = np.minimum(bound, part["kth"].fillna(np.inf).to_numpy()) * (1 + 1e-9)
                    at, cell = np.nonzero((dist - high <= bound[:, None]) & (low - dist <= bound[:, None]))
                    some = part.iloc[at]
                    yield some[["g", "qid", "vec"]].assign(coarse=ids[cell].astype("int32"), home=np.where(some["coarse"].to_numpy() == ids[cell], some["cell"].to_numpy(), -1).astype("int32"), bound=bound[at])

        def open_fine(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return left.assign(cell=pd.Series(dtype="int32"))[["g", "qid", "vec", "coarse", "cell"]].iloc[:0]
            ids, low, high = right["cell"].to_numpy(), right["lo"].to_numpy(), right["hi"].to_numpy()
            bound, home, rows, cells = left["bound"].to_numpy(), left["home"].to_numpy(), [], []
            for start, dist in _distances(_matrix(left["vec"]), _matrix(right["pivot"]), metric):
                part = slice(start, start + len(dist))
                at, cell = np.nonzero((dist - high <= bound[part, None]) & (low - dist <= bound[part, None]) & (ids[None, :] != home[part, None]))
                rows.append(at + start)
                cells.append(ids[cell])
            return left.iloc[np.concatenate(rows)][["g", "qid", "vec", "coarse"]].assign(cell=np.concatenate(cells).astype("int32"))
        routed = cut_lineage(bounded.mapInPandas(open_coarse, f"g string, qid {key_type}, vec array<double>, coarse int, home int, bound double"))
        return self._meet_pivots(routed, self.cells.select("g", "coarse", "cell", "pivot", "lo", "hi"), open_fine, f"g string, qid {key_type}, vec array<double>, coarse int, cell int")

    def meet(self, visits: DataFrame) -> DataFrame:
        """(g, qid, neighbour, distance): the `need` closest donors of every visited block; both sides of a block are bounded by block_rows."""
        need, block_rows, metric = self.need, self.block_rows, self.metric

        def solve(_, qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
            if not len(qs) or not len(ds):
                return pd.DataFrame({"g": [], "qid": [], "neighbour": [], "distance": []})
            found = Donors(_matrix(ds["vec"]), ds["keys"].tolist(), metric).closest(_matrix(qs["vec"]), need)
            rows = [(g, q, n, x) for g, q, best in zip(qs["g"].tolist(), qs["qid"].tolist(), found) for x, n in best]
            return pd.DataFrame(rows, columns=["g", "qid", "neighbour", "distance"])
        cell = ["g", "coarse", "cell"]
        load = visits.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("q_parts"))
        plan = self.cells.select(*cell, F.ceil(F.col("vectors") / block_rows).cast("long").alias("parts")).join(load, cell)        # one row per visited cell
        left = visits.join(plan, cell).withColumn("q_block", F.pmod(F.xxhash64("qid"), F.col("q_parts"))).withColumn("d_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        right = self.placed.join(plan, cell).withColumn("d_block", F.pmod(F.xxhash64("vec", F.lit(7)), F.col("parts"))).withColumn(
            "q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_parts") - 1)))
        keys = [*cell, "d_block", "q_block"]
        return _renewed(left.select(*keys, "qid", "vec")).groupBy(*keys).cogroup(
            _renewed(right.select(*keys, "vec", "keys")).groupBy(*keys)).applyInPandas(solve, f"g string, qid {self.key_type}, neighbour {self.key_type}, distance double")

    def search(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(lists, visits): (g, qid, near) with the `need` closest (distance, neighbour) of each query (g, qid, vec), and the cells that were looked into."""
        best = Window.partitionBy("g", "qid").orderBy("distance", "neighbour")
        limit_rank = lambda df: df.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= self.need).drop("_r")
        homes = cut_lineage(self.homes(queries))
        at_home = cut_lineage(limit_rank(self.meet(homes)))
        kth = at_home.groupBy("g", "qid").agg(F.when(F.count(F.lit(1)) >= self.need, F.max("distance")).alias("kth"))
        away = cut_lineage(self.away(homes.join(kth, ["g", "qid"], "left")))
        merged = limit_rank(at_home.unionByName(self.meet(away)))
        lists = merged.groupBy("g", "qid").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))
        return lists, homes.unionByName(away)


def evaluations(tree: PivotTree, visits: DataFrame) -> DataFrame:
    """(g, qid, evaluations): distances that a search computes for each query: to the coarse pivots twice, to the fine pivots of the coarse cells looked into, to the donors visited."""
    fixed = F.create_map(*[x for g, m in tree.coarse.items() for x in (F.lit(g), F.lit(2 * len(m)))])
    fine = tree.cells.groupBy("g", "coarse").agg(F.count(F.lit(1)).alias("fine"))
    donors = visits.join(tree.cells.select("g", "coarse", "cell", "vectors"), ["g", "coarse", "cell"]).groupBy("g", "qid").agg(F.sum("vectors").alias("met"))
    pivots = visits.select("g", "qid", "coarse").distinct().join(fine, ["g", "coarse"]).groupBy("g", "qid").agg(F.sum("fine").alias("fine"))
    return donors.join(pivots, ["g", "qid"]).select("g", "qid", (fixed[F.col("g")] + F.col("fine") + F.col("met")).alias("evaluations"))


def nearest(queries: DataFrame, donors: DataFrame, key: str, vec: str, k: int, by: str | None = None,
            exclude_self: bool = False, block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS,
            small_bytes: int = SMALL_DONOR_BYTES, metric: str = "euclidean") -> DataFrame:
    """(key, neighbour, distance, rank 1..k) for every query row; `by` keeps searches inside one group value.

    `metric`: euclidean, or maximum (the largest difference of a component).
    Keys are unique per group on each side; vectors are array<double> without nulls.
    """
    key_type = "bigint" if isinstance(donors.schema[key].dataType, T.IntegralType) else "string"
    need = k + 1 if exclude_self else k
    group = F.col(by).cast("string") if by else F.lit("")
    shape = lambda df: df.select(group.alias("g"), F.col(key).cast(key_type).alias("key"), F.col(vec).cast("array<double>").alias("vec"))
    q_rows, d_rows = shape(queries), shape(donors)

    # Window group limit trims copies to `need` per task before the shuffle.
    copies = Window.partitionBy("g", "vec").orderBy("key")
    d = (d_rows.withColumn("_r", F.row_number().over(copies)).where(F.col("_r") <= need)
         .groupBy("g", "vec").agg(F.sort_array(F.collect_list("key")).alias("keys")))
    d = d.persist(StorageLevel.MEMORY_AND_DISK)
    measured = d.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vec") * 8 + F.size("keys") * 24).alias("bytes"), F.max(F.size("vec")).alias("width")).collect()
    named = [F.col("g").alias(by)] if by else []
    if sum(r["bytes"] for r in measured) <= small_bytes:
        listed = _near_broadcast(q_rows, d, key_type, need, metric)
        d.unpersist()
        kept = F.filter("near", lambda s: s["neighbour"] != F.col("key")) if exclude_self else F.col("near")
        out = listed.select("g", "key", F.posexplode(F.slice(kept, 1, k)).alias("_p", "_s"))
        return out.select(*named, F.col("key").alias(key), "_s.neighbour", "_s.distance", (F.col("_p") + 1).alias("rank"))

    q = cut_lineage(q_rows.groupBy("g", "vec").agg(F.min("key").alias("qid")))
    sizes, width = {r["g"]: r["n"] for r in measured}, max(r["width"] for r in measured)
    if width > WIDE:
        kept = cut_lineage(d)
        d.unpersist()
        lists = _near_blocks(q, kept, sizes, key_type, need, max(1, min(WIDE_BLOCK_BYTES // (8 * width), block_rows * 4)), metric)
    else:
        lists, _ = PivotTree(d, sizes, key_type, need, block_rows, max_pivots, metric).search(q)
        d.unpersist()
    by_vector = q.join(lists, ["g", "qid"]).select("g", "vec", "near")
    rows = q_rows.join(by_vector, ["g", "vec"])
    kept = F.col("near")
    if exclude_self:
        kept = F.filter("near", lambda s: s["neighbour"] != F.col("key"))
    out = rows.select("g", "key", F.posexplode(F.slice(kept, 1, k)).alias("_p", "_s"))
    return out.select(*named, F.col("key").alias(key), F.col("_s.neighbour").alias("neighbour"), F.col("_s.distance").alias("distance"),
                      (F.col("_p") + 1).alias("rank"))
