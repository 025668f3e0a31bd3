"""Exact top-k inner-product search, term at a time.

Candidates stay where they are: each task takes its rows in blocks and turns a block
into postings (component -> rows and weights). A query is a sparse row; each of its
non-zero components scatters weight x posting into the query's dense score array over
the block. Partition selection takes the best k of the block, the task merges blocks,
and a window merges tasks. All arithmetic is on 64-bit integers.

Queries go to the tasks in waves of at most `wave` rows, so what is broadcast has a
stated bound however many queries there are; each wave scans the candidates once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyglass.llm.common import keep_table, only


def integer_vectors(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, terms): floor(scale * x) of each component. Null vectors, and those with a null or non-finite component, are left out."""
    v = only(vectors, vec_id=id_col, x=vector_col).withColumn("x", F.col("x").cast("array<double>"))
    good = F.col("x").isNotNull() & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("bigint")).alias("terms"))


def _postings(rows: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per component, the rows where it is not zero and its weights there; shorter vectors have zeros at the end."""
    width = max(map(len, rows), default=0)
    table = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        table[i, :len(r)] = r
    held = []
    for column in table.T:
        at = np.flatnonzero(column)
        held.append((at, column[at].copy()))
    return held


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids, best first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        tied = np.flatnonzero(scores == least)
        need = k - len(above)
        if len(tied) > need:
            tied = tied[np.argpartition(ids[tied], need - 1)[:need]]
        at = np.concatenate([above, tied])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, block: int = 8192, wave: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) from two tables (vec_id, terms); a query's own id is no candidate of it.

    Queries that share an id count once, with the smallest vector; candidates that share an id
    are ranked one by one. Fewer than k candidates: all of them.
    """
    spark = candidates.sparkSession
    asked = keep_table(queries.groupBy("vec_id").agg(F.min("terms").alias("terms")), "queries")
    waves = max(1, -(-asked.count() * 2 // wave))           # half full on average: hashing spreads unevenly
    found = None
    for number in range(waves):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == number).collect()
        for at in range(0, len(rows), wave):
            part = rows[at:at + wave]
            sent = spark.sparkContext.broadcast(([r["vec_id"] for r in part], [np.array(r["terms"], np.int64) for r in part]))
            made = _wave(candidates, sent, k, block)
            if waves > 1:
                made = keep_table(made, "wave")
            found = made if found is None else found.unionAll(made)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _wave(candidates: DataFrame, sent, k: int, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = sent.value
        queries = [(q, [(int(t), int(v[t])) for t in np.flatnonzero(v)]) for q, v in zip(names, vectors)]
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for ids, rows in _blocks(batches, block):
            postings = _postings(rows)
            scores = np.empty(len(ids), np.int64)
            for q, terms in queries:
                scores[:] = 0
                for t, w in terms:
                    if t < len(postings):
                        at, weights = postings[t]
                        if len(at) == len(scores):
                            scores += w * weights
                        else:
                            scores[at] += w * weights
                other = ids != q
                s, i = (scores, ids) if other.all() else (scores[other], ids[other])
                if q in best:
                    chosen = _best(s, i, k)
                    s, i = np.concatenate([best[q][0], s[chosen]]), np.concatenate([best[q][1], i[chosen]])
                chosen = _best(s, i, k)
                best[q] = (s[chosen], i[chosen])
        if best:
            lengths = [len(i) for _, i in best.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(best), np.int64), lengths)), pa.array(np.concatenate([i for _, i in best.values()])),
                                              pa.array(np.concatenate([s for s, _ in best.values()]))], names=["query_id", "vec_id", "score"])
    return candidates.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        flat, offsets = batch.column(1).flatten().to_numpy(), np.asarray(batch.column(1).offsets)
        offsets = offsets - offsets[0]
        ids = np.asarray(batch.column(0))
        for at in range(0, len(ids), block):
            n = min(block, len(ids) - at)
            yield ids[at:at + n], [flat[offsets[i]:offsets[i + 1]] for i in range(at, at + n)]


def search(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """Top k of every row whose id is divisible by `every`, against all rows."""
    v = integer_vectors(vectors, id_col=id_col, vector_col=vector_col)
    v = v.withColumn("vec_id", F.col("vec_id").cast("bigint"))
    return top_k(v, v.where(F.col("vec_id") % every == 0), k, **options)
