"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 bits, by majority over the XXH64 hashes of word shingles. Two
fingerprints link when at most `radius` bits differ. Bit i gets a vector m(i) of
radius + 1 bits; mask v (1 .. 2^(radius+1) - 1) keeps the bits with odd parity of
m(i) & v. For any set of at most `radius` differing bits there is a v orthogonal to
all their vectors, so every linked pair agrees under some mask: no pair is missed.

Scale. Equal fingerprints are folded first. A table bucket of two is settled by an
aggregate (smallest and largest member). Larger buckets are cut into blocks of about
`block` members by a hash, and every two blocks meet in one task as a sorted run, so no
task holds more than two blocks. A bucket of more than SPREAD blocks would copy each
member too often: its members are dealt again under a second, independent family of
masks on top of the first. That leaves about 16 free bits, so the second buckets hold
some 65,000 fingerprints at most, whatever the corpus is, and are always cut into blocks.
Tasks emit a spanning forest of what they saw, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.common import keep_table, map_rows, only
from tallyglass.llm.graph import connected_components

SEED = 42
BITS = 64
SPREAD = 32          # blocks of a bucket above which its members are dealt again: about the number of masks


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit fingerprint of one text; zero without words.

    Words: runs other than blanks and controls 9-13, A-Z lower-cased. Fewer words
    than `width`: one shingle of all words.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths) + np.arange(n)
    starts = (ends - lengths)[:n - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n - width + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at:at + 65536].byteswap().view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document; fp is the fingerprint as a signed long. A null text has no words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def per_batch(doc_id, text):
        made = np.fromiter((fingerprint(t, width) for t in text), np.uint64, len(text))
        return {"doc_id": doc_id, "fp": made.view(np.int64)}
    return map_rows(only(docs, doc_id=id_col, text=text_col), per_batch, f"doc_id {kind}, fp bigint")


def covering_masks(radius: int, level: int = 0) -> list[int]:
    """2^(radius+1) - 1 masks (signed longs); `level` picks an independent family."""
    size = (1 << (radius + 1)) - 1
    vectors = np.random.RandomState(level).permutation(BITS) % size + 1
    masks = [sum(1 << i for i in range(BITS) if bin(int(vectors[i]) & v).count("1") % 2) for v in range(1, size + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join what links of at most `radius` bits join among the members of one bucket."""
    near = np.bitwise_count((members[:, None] ^ members[None, :]).view(np.uint64)) <= radius          # of a signed number it would count the absolute value
    left, found = np.ones(len(members), bool), []
    for root in range(len(members)):
        if left[root]:
            reached = np.zeros(len(members), bool)
            reached[root] = True
            edge = reached
            while edge.any():
                edge = near[edge].any(axis=0) & ~reached
                reached = reached | edge
            left &= ~reached
            found += [(int(members[root]), int(m)) for m in members[reached] if m != members[root]]
    return found


def _link_buckets(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 4), np.int64)
        for batch in batches:
            rows = np.vstack([rest, np.column_stack([np.asarray(c) for c in batch.columns]).astype(np.int64)])
            cuts = np.flatnonzero((np.diff(rows[:, :3], axis=0) != 0).any(axis=1)) + 1
            last = cuts[-1] if len(cuts) else 0
            yield from pack(rows[:last], cuts[:-1])
            rest = rows[last:]
        yield from pack(rest, [])

    def pack(rows, cuts):
        found = [e for group in np.split(rows[:, 3], cuts) if len(group) > 1 for e in _forest(group, radius)]
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _dealt(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """Rows (fp, t, mask, key), one per table of a level: t numbers the tables over both levels, key is fp under all masks so far."""
    masks = covering_masks(radius, level)
    choice = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(m).cast("bigint").alias("m")) for i, m in enumerate(masks)])
    return (rows.withColumn("x", F.explode(choice))
            .select("fp", (F.col("t") * len(masks) + F.col("x.i")).alias("t"), F.col("mask").bitwiseOR(F.col("x.m")).alias("mask"))
            .withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))))


def _buckets(rows: DataFrame) -> DataFrame:
    """(t, key, n, a, b) of the buckets with more than one member; a and b are the smallest and the largest."""
    return keep_table(rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")


def _bucket_links(rows: DataFrame, buckets: DataFrame, radius: int, block: int) -> list[DataFrame]:
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    parts = buckets.where("n > 2").select("t", "key", F.ceil(F.col("n") / block).cast("bigint").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda j: F.least(own, j) * F.col("parts") + F.greatest(own, j))
    runs = rows.join(parts, ["t", "key"]).select("t", "key", F.explode(pairs).alias("pair"), "fp").repartition("t", "key", "pair").sortWithinPartitions("t", "key", "pair")
    return [buckets.where((F.col("n") == 2) & near).select("a", "b"), runs.mapInArrow(_link_buckets(radius), "a bigint, b bigint")]


def near_links(fps: DataFrame, radius: int = 4, block: int = 512) -> DataFrame:
    """(a, b): edges over distinct fingerprints `fp`, joining exactly what links of at most `radius` differing bits join."""
    rows = _dealt(fps.select("fp", F.lit(0).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("mask")), radius, 0)
    buckets = _buckets(rows)
    found = _bucket_links(rows, buckets.where(F.col("n") <= SPREAD * block), radius, block)
    large = buckets.where(F.col("n") > SPREAD * block).select("t", "key")
    if not large.isEmpty():
        again = _dealt(keep_table(rows.join(large, ["t", "key"]).select("fp", "t", "mask"), "large-buckets"), radius, 1)
        found += _bucket_links(again, _buckets(again), radius, block)
    links = found[0]
    for more in found[1:]:
        links = links.unionAll(more)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per document; component_id is the smallest id reachable over links.

    Null and blank texts have fingerprint zero and are linked like any other. Rows
    with equal ids stay apart and share no component by that alone. A null id never
    becomes a component id unless the component has no other. Empty table: no rows.
    """
    own = keep_table(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = keep_table(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = keep_table(near_links(nodes.select("fp"), radius, block), "links")
    roots = connected_components(links)
    member = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    component = member.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = keep_table(member.join(component, "root").where(~F.col("component_id").eqNullSafe(F.col("least"))).select("fp", "component_id"), "moved")
    folded = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return own.join(folded, "fp").select("doc_id", "fp", "component_id")
