"""Packing of token sequences, shortest pack first over the histogram of lengths.

1. Documents are tokenised where they lie and cut at `length` tokens; each piece takes its
   rank among the task's pieces of its length (one counter per length and task).
2. The histogram, at most `length` rows, goes to the driver. Lengths are placed longest
   first; each goes to the shortest packs with room, all packs of a pattern at once, and
   the pattern counts are updated. Cost and size of the plan depend on the number of
   lengths only, not on the corpus.
3. A pattern's slot for a length is a range of ranks, so a piece finds its sequence by its
   global rank: task rank plus what earlier tasks have of that length. That join's keys are
   (task, length): no key is hot, whatever the lengths are.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyglass.llm.common import give_back, keep_table, only, slices
from tallyglass.llm.vocab import chunks, word_ids

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, task_rank bigint"


def cut_pieces(docs: DataFrame, name: str, end_id: int, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most `length` ids; ids of a document: those of its text and `end_id`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in slices(batches):
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for at, some in chunks(texts):
                for doc_id, found in zip(doc_ids[at:], word_ids(some, name)):
                    ids = np.append(found, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), length):
                        part = ids[start:start + length]
                        rows.append((doc_id, start, len(part), zlib.crc32(part), len(ids), task, int(seen[len(part)])))
                        seen[len(part)] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        give_back()
    types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
    names = [c.split()[0] for c in PIECE.split(", ")]
    return only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, PIECE)


def plan_packs(histogram: dict[int, int], length: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(piece length, how often), ...] with the number of packs that follow each.

    Longest first, into the shortest pack with room. When no pack has room, new ones are
    opened, each filled with as many pieces of this length as it holds.
    """
    rooms: list[tuple[int, int]] = []           # heap of (-room, number of the group)
    groups: dict[int, tuple[tuple, int, int]] = {}          # number -> (pattern, packs, room)
    made = 0

    def put(pattern: tuple, packs: int, room: int) -> None:
        nonlocal made
        if packs:
            groups[made] = (pattern, packs, room)
            heapq.heappush(rooms, (-room, made))
            made += 1

    def longer(pattern: tuple, size: int, times: int) -> tuple:
        return (*pattern[:-1], (size, pattern[-1][1] + times)) if pattern and pattern[-1][0] == size else (*pattern, (size, times))
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if rooms and -rooms[0][0] >= size:
                number = heapq.heappop(rooms)[1]
                pattern, packs, room = groups.pop(number)
                each = max(1, min(room // size, left // packs) if len(rooms) == 0 else 1)
                filled = min(packs, left // each)
                put(pattern, packs - filled, room)
                put(longer(pattern, size, each), filled, room - each * size)
                left -= filled * each
            else:
                each = length // size
                put(((size, each),), left // each, length - each * size)
                put(((size, left % each),), 1 if left % each else 0, length - left % each * size)
                left = 0
    return [(list(pattern), packs) for pattern, packs, _ in groups.values()]


def slots_of(plan: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (piece length, first rank, times per pack, first sequence, offset in the sequence), sorted by length and rank."""
    rows, used, sequence = [], {}, 0
    for pattern, packs in plan:
        offset = 0
        for size, times in pattern:
            first = used.get(size, 0)
            rows.append((size, first, times, sequence, offset))
            used[size] = first + packs * times
            offset += size * times
        sequence += packs
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(length: np.ndarray, rank: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and global rank."""
    shift = np.int64(1) << np.int64(47)
    at = np.searchsorted(slots[:, 0] * shift + slots[:, 1], length * shift + rank, side="right") - 1
    size, first, times, sequence, offset = slots[at].T
    inner = rank - first
    return sequence + inner // times, offset + size * (inner % times)


def pack(docs: DataFrame, name: str = "word_bpe_49k.json", end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    Null and empty texts are the single id `end_id`. Documents longer than a sequence are cut
    at its length; others stay whole. Rows with equal or null ids are separate documents.
    Sequence ids count from 0 without gaps. Empty table: no rows.
    """
    spark = docs.sparkSession
    pieces = keep_table(cut_pieces(docs, name, end_id, length, id_col, text_col), "pieces")
    by_task = keep_table(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(slots_of(plan_packs(histogram, length)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(earlier, ["task", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("earlier") + F.col("task_rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = place(np.asarray(batch.column(2)), np.asarray(batch.column(5)), slots.value)
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return ranked.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
