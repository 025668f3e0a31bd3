"""Named tables, sinks, content-addressed snapshots and saved baselines."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyglass.functions.carried_hash import CarriedSha256, can_carry
from tallyglass.functions.expressions import numeric_columns, text_columns, time_columns, union_all

LARGE_FILE = 128 << 20        # a file beyond this is hashed split by split
LONGEST_LINE = 32 << 20       # a file with a longer stretch without line feed is hashed whole
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def register(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def list_tables(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """name, n_rows, n_columns of the registered tables; one count per table, in one job."""
    found = names or sorted(t.name for t in spark.catalog.listTables())
    return union_all([
        spark.table(n).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(n).alias("name"), "n_rows", F.lit(len(spark.table(n).columns)).cast("long").alias("n_columns"))
        for n in found])


def drop_table(spark: SparkSession, name: str) -> bool:
    """Forget a named table and its cached blocks."""
    if not spark.catalog.tableExists(name):
        return False
    spark.table(name).unpersist()
    return spark.catalog.dropTempView(name)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    """Write a feature-ready table; returns the path."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_report(df: DataFrame, path: str) -> str:
    """Profile and contract rows as JSON lines."""
    return write_table(df, path, "json")


def content_manifest(items: DataFrame, content: str, name: str, size: str, modified: str | None = None,
                     uploader: str = "unknown", license_name: str = "unknown", pii: str | None = None) -> DataFrame:
    """One row per distinct content: sha256, size, first name, copies, id, uploader, license, pii flag.

    Copies are folded by partial aggregation on the hash; contents are not shuffled.
    """
    stamp = F.unix_timestamp(F.col(modified).cast("timestamp")) if modified else F.lit(0).cast("long")
    hashed = items.select(
        F.sha2(F.col(content), 256).alias("sha256"), F.col(size).cast("long").alias("size"), F.col(name).cast("string").alias("name"),
        stamp.alias("stamp"), (F.col(pii) if pii else F.lit(False)).alias("pii"))
    return _folded_manifest(hashed, uploader, license_name)


def _folded_manifest(hashed: DataFrame, uploader: str, license_name: str) -> DataFrame:
    folded = hashed.groupBy("sha256").agg(
        F.max("size").alias("size"), F.min("name").alias("name"), F.count(F.lit(1)).alias("copies"),
        F.min("stamp").alias("stamp"), F.max("pii").alias("has_pii"))
    return folded.select(
        F.concat(F.substring("sha256", 1, 12), F.lit("-"), F.col("stamp").cast("string")).alias("snapshot_id"),
        "sha256", "size", "name", "copies", F.lit(uploader).alias("uploader"), F.lit(license_name).alias("license"), "has_pii")


def snapshot_files(spark: SparkSession, path: str, uploader: str = "unknown", license_name: str = "unknown", glob: str | None = None) -> DataFrame:
    """Manifest of the files below a path, read and hashed by the executors.

    Files of more than LARGE_FILE bytes are hashed when this is called, split by
    split: see `_carried_hashes`.
    """
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    files = reader.format("binaryFile").load(path).withColumn("url", F.col("_metadata.file_path"))
    stamp = F.unix_timestamp("modificationTime")
    listed = files.where(F.col("length") > LARGE_FILE).select("url", "path", "length", stamp.alias("stamp")).collect()
    digests = _carried_hashes(spark, path, glob, {r["url"]: (r["path"], r["length"]) for r in listed})
    hashed = files.where(~F.col("url").isin(*digests)) if digests else files
    hashed = hashed.select(F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("path").alias("name"), stamp.alias("stamp"), F.lit(False).alias("pii"))
    if digests:
        rows = [(digests[r["url"]], r["length"], r["path"], r["stamp"], False) for r in listed if r["url"] in digests]
        hashed = hashed.unionByName(spark.createDataFrame(rows, "sha256 string, size long, name string, stamp long, pii boolean"))
    return _folded_manifest(hashed, uploader, license_name)


def _carried_hashes(spark: SparkSession, path: str, glob: str | None, files: dict[str, tuple[str, int]]) -> dict[str, str]:
    """SHA-256 by url of files that are read split by split; `files` gives path and length by url.

    A digest is one sequence, so one task after another reads a split of a file
    and goes on from the state of the split before; different files go on side by
    side.  Only states pass through the driver.  The splits are those of
    the text reader, cut at line feeds: it gives a line's bytes as they are, and
    takes off a leading byte order mark; no column comes from a folder's name.  A first pass counts the bytes of each
    split.  Left out, to be hashed whole: files the text reader would decompress,
    files whose bytes do not add up (a line too long), and all files where no
    state can be carried.
    """
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    plain = [u for u, (name, _) in files.items() if codecs.getCodec(spark._jvm.org.apache.hadoop.fs.Path(name)) is None] if can_carry() else []
    if not plain:
        return {}
    reader = spark.read.options(**{"lineSep": "\n", "recursiveFileLookup": True, "mapreduce.input.linerecordreader.line.maxlength": LONGEST_LINE})
    text = (reader.option("pathGlobFilter", glob) if glob else reader).text(path).where(F.col("_metadata.file_path").isin(plain))
    lines = text.select(F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    splits = {}
    counted = lines.withColumn("part", F.spark_partition_id()).groupBy("url", "start", "part").agg(F.sum(F.octet_length("line") + F.lit(1)).alias("n"))
    for r in counted.orderBy("url", "start").collect():
        splits.setdefault(r["url"], []).append((r["start"], r["part"], r["n"]))

    begun, ends = {}, {}
    for url, found in splits.items():
        missing = files[url][1] - sum(n for *_, n in found)       # 3 more with a mark, 1 less without a last line feed
        if missing in (-1, 0, 2, 3):
            begun[url] = CarriedSha256()
            begun[url].update(BYTE_ORDER_MARK if missing >= 2 else b"")
            ends[url] = b"\n" if missing in (0, 3) else b""
    states = {url: h.state() for url, h in begun.items()}
    for turn in range(max((len(splits[u]) for u in states), default=0)):
        now = [(k, u, *splits[u][turn]) for k, u in enumerate(states) if turn < len(splits[u])]
        wanted = spark.createDataFrame([(k, u, start) for k, u, start, *_ in now], "file int, url string, start long")
        step = lines.join(F.broadcast(wanted), ["url", "start"]).select("file", "line").mapInArrow(
            _carry({k: states[u] for k, u, *_ in now}, turn == 0), "file int, state binary, n long")
        done = {r["file"]: r for r in spark.sparkContext.runJob(step.rdd, list, sorted({part for *_, part, _ in now}))}
        for k, url, _, _, n in now:
            if k not in done or done[k]["n"] != n:
                raise RuntimeError(f"{url} changed while it was read")
            states[url] = bytes(done[k]["state"])
    digests = {}
    for url, state in states.items():
        last = CarriedSha256(state)
        last.update(ends[url])
        digests[url] = last.hexdigest()
    return digests


def _carry(states: dict[int, bytes], first: bool):
    """Takes the lines of one split of each file, in order, on from the state of the split before."""

    def run(batches):
        held, counts = {}, {}
        for batch in batches:
            for k in pc.unique(batch.column("file")).to_pylist():
                lines = batch.filter(pc.equal(batch.column("file"), k)).column("line").to_pylist()
                if k not in held:
                    held[k], counts[k] = CarriedSha256(states[k]), 0
                data = b"\n".join(lines if first and not counts[k] else [b"", *lines])
                held[k].update(data)
                counts[k] += sum(map(len, lines)) + len(lines)
        schema = pa.schema([("file", pa.int32()), ("state", pa.binary()), ("n", pa.int64())])
        yield pa.RecordBatch.from_pydict({"file": list(held), "state": [h.state() for h in held.values()], "n": [counts[k] for k in held]}, schema)

    return run


def append_snapshots(manifest: DataFrame, path: str) -> str:
    """Add only contents the stored manifest does not hold yet: stored rows never change."""
    try:
        known = manifest.sparkSession.read.parquet(path).select("sha256")
        manifest = manifest.join(known, "sha256", "left_anti")
    except AnalysisException:
        pass
    manifest.write.mode("append").parquet(path)
    return path


@dataclass(frozen=True)
class ColumnRoles:
    """Roles of the columns, from the schema alone."""

    target: str | None
    numeric: list[str]
    categorical: list[str]
    datetime: list[str]


def column_roles(df: DataFrame, target: str | None = None) -> ColumnRoles:
    skip = [target] if target else []
    return ColumnRoles(target, numeric_columns(df, skip), text_columns(df, skip), time_columns(df, skip))


def fingerprint(df: DataFrame) -> str:
    """Id that depends on schema and rows only: not on time, order or partitioning."""
    hashed = F.xxhash64(*[F.col(c) for c in df.columns])
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(hashed).alias("x"), F.sum(hashed.cast("decimal(38,0)")).alias("s")).first()
    text = json.dumps([df.schema.jsonValue(), row["n"], str(row["x"]), str(row["s"])], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


ROLE_SCHEMA = "baseline_id string, target string, numeric array<string>, categorical array<string>, datetime array<string>"


def save_baseline(df: DataFrame, root: str, target: str | None = None) -> str:
    """Store a reference table with its column roles; saving equal data again gives the same id."""
    baseline_id = fingerprint(df)
    roles = asdict(column_roles(df, target))
    df.write.mode("overwrite").parquet(f"{root}/{baseline_id}/rows")
    spark = df.sparkSession
    line = spark.createDataFrame([(baseline_id, roles["target"], roles["numeric"], roles["categorical"], roles["datetime"])], ROLE_SCHEMA)
    line.coalesce(1).write.mode("overwrite").parquet(f"{root}/{baseline_id}/roles")
    return baseline_id


def load_baseline(spark: SparkSession, root: str, baseline_id: str) -> tuple[DataFrame, ColumnRoles]:
    row = spark.read.parquet(f"{root}/{baseline_id}/roles").first()
    roles = ColumnRoles(row["target"], row["numeric"], row["categorical"], row["datetime"])
    return spark.read.parquet(f"{root}/{baseline_id}/rows"), roles


def list_baselines(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(ROLE_SCHEMA).parquet(f"{root}/*/roles")
    except AnalysisException:
        return spark.createDataFrame([], T.StructType.fromDDL(ROLE_SCHEMA))


def delete_baseline(spark: SparkSession, root: str, baseline_id: str) -> bool:
    """Remove one baseline through the file system of its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{baseline_id}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
