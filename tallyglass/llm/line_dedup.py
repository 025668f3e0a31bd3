"""Line dedup through a sharded minimal perfect hash.

Key of a line: blanks and controls 9-13 stripped at both ends, A-Z lower-cased. Keys
of at least `min_chars` code points in at least `min_docs` documents lose all their
lines except in the document with the largest id that holds the key.

1. Every document gives its distinct long keys as 128-bit hashes; an aggregate with
   map-side combine counts documents and takes the largest id, so a line in a third of
   all documents is one row per task before the shuffle.
2. The distinct hashes that reach `min_docs` are dealt to shards of about
   `shard_keys`. One task per shard builds a minimal perfect hash over its hashes
   (levels of bitmaps, ranks by running popcounts) and three dense arrays in its
   order: fingerprint (the other 64 bits of the hash), document count, keeper id. The
   shard is one file in the shared folder; the manifest of a written table names the
   file of the task that won, so retried tasks leave at most an unused file.
3. Documents probe the arrays, a slice of a batch at a time, shard by shard; no line is joined
   with anything. A worker keeps at most `cache_bytes` of shards.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyglass.llm.common import give_back, keep_table, only, slices, store
from tallyglass.session import fresh_path


def _chars(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def line_hashes(text: str | None, min_chars: int) -> tuple[list[bytes], np.ndarray]:
    """Lines of a text as bytes, and rows (line number, high, low) of the 128-bit hashes of its long keys."""
    from xxhash import xxh3_128_digest

    lines = (text or "").encode().split(b"\n")
    numbers, digests = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip()
            if len(key) >= min_chars and _chars(key) >= min_chars:
                numbers.append(i)
                digests.append(xxh3_128_digest(key.lower()))
    rows = np.zeros((len(numbers), 3), np.uint64)
    if numbers:
        rows[:, 0] = numbers
        rows[:, 1:] = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return lines, rows


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: level bitmaps, slot = rank of the key's bit over all levels."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 1.5) -> "PerfectHash":
        sizes, bits = [], []
        while len(keys):
            size = (int(len(keys) * room) // 64 + 1) * 64
            place = _mix(keys, len(sizes)) % np.uint64(size)
            alone = np.bincount(place.astype(np.int64), minlength=size)
            bits.append(alone == 1)
            sizes.append(size)
            keys = keys[alone[place.astype(np.int64)] > 1]
        packed = np.packbits(np.concatenate(bits), bitorder="little").view(np.uint64) if bits else np.empty(0, np.uint64)
        return cls(np.array(sizes, np.int64), packed)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has its bit. Keys that were not built in may get any slot."""
        slots, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            bit = self.starts[level] + (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, shift = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> shift) & np.uint64(1) == 1
            before = word[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1))
            slots[open_[hit]] = self.ranks[bit[hit] >> 6] + np.bitwise_count(before)
            open_ = open_[~hit]
        return slots


class Shard:
    """A perfect hash with its fingerprint, count and keeper arrays."""

    def __init__(self, sizes, words, fingerprints, counts, keepers):
        self.hash = PerfectHash(sizes, words)
        self.fingerprints, self.counts, self.keepers = fingerprints, counts, keepers
        self.nbytes = words.nbytes * 2 + fingerprints.nbytes + counts.nbytes + keepers.nbytes

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> "Shard":
        made = PerfectHash.build(high)
        slots = made.slots(high)
        put = lambda values: values[np.argsort(slots)]
        return cls(made.sizes, made.words, put(low), put(counts), put(keepers))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=self.hash.sizes, words=self.hash.words, fingerprints=self.fingerprints, counts=self.counts, keepers=self.keepers)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> "Shard":
        with np.load(io.BytesIO(data)) as z:
            return cls(*(z[n] for n in ("sizes", "words", "fingerprints", "counts", "keepers")))

    def keepers_of(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, keeper id) per hash."""
        slots = self.hash.slots(high)
        known = slots >= 0
        known[known] = self.fingerprints[slots[known]] == low[known]
        return known, np.where(known, self.keepers[slots], 0)


def count_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(high, low, n_docs, keeper) of the keys in at least `min_docs` documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, hashes = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = line_hashes(text, min_chars)[1]
                if len(rows):
                    rows = np.unique(rows[:, 1:], axis=0) if len(rows) > 1 else rows[:, 1:]
                    hashes.append(rows)
                    ids += [doc_id] * len(rows)
            if ids:
                rows = np.vstack(hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(ids, pa.int64())], names=["high", "low", "doc_id"])
        give_back()
    held = docs.mapInArrow(run, "high bigint, low bigint, doc_id bigint")
    return held.groupBy("high", "low").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)


def build_index(counted: DataFrame, shard_keys: int = 200_000) -> tuple[dict[int, str], int]:
    """Write one file per shard to the shared folder; ({shard: file}, number of shards)."""
    spark = counted.sparkSession
    counted = keep_table(counted, "line-counts")
    shards = max(1, -(-counted.count() // shard_keys))
    folder = fresh_path(spark, "line-index")
    spark.createDataFrame([], "x int").write.parquet(folder)        # makes the folder in whatever store it is

    def build(key, rows):
        made = Shard.build(rows["high"].to_numpy().view(np.uint64), rows["low"].to_numpy().view(np.uint64),
                           np.minimum(rows["n_docs"].to_numpy(), 2**32 - 1).astype(np.uint32), rows["keeper"].to_numpy())
        path = f"{folder}/shard-{key[0]}-{uuid.uuid4().hex}.npz"
        files, inner = store(path)
        with files.open_output_stream(inner, compression=None) as out:
            out.write(made.dumps())
        del made
        give_back()
        return pd.DataFrame({"shard": [key[0]], "path": [path]})
    dealt = counted.where("keeper IS NOT NULL").withColumn("shard", F.expr(f"CAST(pmod(low, {shards}) AS INT)"))
    manifest = keep_table(dealt.groupBy("shard").applyInPandas(build, "shard int, path string"), "line-manifest")
    return {r["shard"]: r["path"] for r in manifest.collect()}, shards


class _Shards:
    """Shards read from the shared folder, at most `limit` bytes of them kept."""

    def __init__(self, paths: dict[int, str], limit: int):
        self.paths, self.limit, self.held = paths, limit, OrderedDict()

    def get(self, number: int) -> Shard | None:
        if number not in self.paths:
            return None
        if number not in self.held:
            files, inner = store(self.paths[number])
            with files.open_input_file(inner) as f:
                self.held[number] = Shard.loads(f.read())
            while len(self.held) > 1 and sum(s.nbytes for s in self.held.values()) > self.limit:
                self.held.popitem(last=False)
        self.held.move_to_end(number)
        return self.held[number]


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 200_000, cache_bytes: int = 128 << 20,
                id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) and the columns named in `carry`, one row per document.

    Lines are what stands between `\\n`; a null or empty text is one empty line and
    comes back as an empty text. A text that loses all lines is empty too. Of rows with
    equal ids each counts as a document, and all rows with the largest id keep a line.
    Rows with a null id count as documents but never are the keeper; if no row that
    holds a key has an id, the key stays everywhere. Empty table: no rows.
    """
    spark = docs.sparkSession
    source = only(docs, doc_id=id_col, text=text_col)
    source = source.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    paths, shards = build_index(count_lines(source, min_chars, min_docs), shard_keys)
    carried = only(docs, **{"doc_id": id_col, "text": text_col} | {f"x{i}": c for i, c in enumerate(carry)}).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    schema = T.StructType([*carried.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    arrow = to_arrow_schema(schema)
    size = 4 << 20 if shards * shard_keys * 24 <= cache_bytes else 32 << 20          # of a slice: shards that are not kept are read for each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Shards(paths, cache_bytes)
        for batch in slices(batches, size):
            ids = batch.column(0).to_pylist()
            split, held = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                lines, rows = line_hashes(text, min_chars)
                split.append(lines)
                held.append(np.column_stack([np.full(len(rows), i, np.uint64), rows]))
            rows = np.vstack(held) if held else np.zeros((0, 4), np.uint64)
            gone: list[set] = [set() for _ in ids]
            number = rows[:, 3].view(np.int64) % shards
            order = np.argsort(number, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
                shard = index.get(int(number[part[0]])) if len(part) else None
                if shard is not None:
                    known, keeper = shard.keepers_of(rows[part, 2], rows[part, 3])
                    for at, k in zip(part[known], keeper[known]):
                        if ids[int(rows[at, 0])] != k:
                            gone[int(rows[at, 0])].add(int(rows[at, 1]))
            texts = [b"\n".join(l for j, l in enumerate(lines) if j not in drop) if drop else b"\n".join(lines) for lines, drop in zip(split, gone)]
            made = [batch.column(0), pa.array(texts, pa.binary()).cast(arrow.field(1).type), *batch.columns[2:],
                    pa.array([len(x) for x in split], pa.int64()), pa.array([len(x) for x in gone], pa.int64())]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)
            del batch, split, held, rows, texts, made
        del index
        give_back()
    out = carried.mapInArrow(run, schema)
    return out.toDF("doc_id", "text", *carry, "n_lines", "n_dropped")
