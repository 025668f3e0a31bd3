"""Readers: files by format, dumps, streams, capped loads and seeded samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyglass.functions.expressions import null_free_floats
from tallyglass.functions.ranking import hash_order

SUFFIX_FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet"}
DEFAULT_SAMPLE_ROWS = 10_000


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; give a schema to save the inference pass over the files."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return null_free_floats(reader.csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return null_free_floats(spark.read.parquet(path))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, records_array: bool = False) -> DataFrame:
    """JSON lines (splittable), or one array of records per file."""
    reader = spark.read.option("multiLine", records_array)
    return null_free_floats((reader.schema(schema) if schema else reader).json(path))


def format_of(path: str, fmt: str | None = None) -> str:
    if fmt:
        if fmt not in SUFFIX_FORMATS.values():
            raise ValueError(f"unsupported format: {fmt}")
        return fmt
    for suffix, known in SUFFIX_FORMATS.items():
        if path.lower().endswith(suffix):
            return known
    raise ValueError(f"unsupported file type: {path}")


def load_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Dispatch on the suffix or an explicit format."""
    chosen = format_of(path, fmt)
    if chosen == "csv":
        return read_csv(spark, path, schema)
    if chosen == "json":
        return read_json(spark, path, schema)
    return read_parquet(spark, path)


def capped_load(spark: SparkSession, path: str, rows: int = DEFAULT_SAMPLE_ROWS, seed: int = 42, keys: Sequence[str] = (), mode: str | None = None) -> DataFrame:
    """At most `rows` rows: mode "first" (the rows read first; default for CSV) or "sample" (seeded; default for other formats). Both are lazy."""
    df = load_table(spark, path)
    mode = mode or ("first" if format_of(path) == "csv" else "sample")
    if mode not in ("first", "sample"):
        raise ValueError(f"unknown mode: {mode}")
    return df.limit(rows) if mode == "first" else seeded_sample(df, rows, keys or df.columns, seed)


def seeded_sample(df: DataFrame, rows: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """`rows` rows (all rows when fewer) by hash order of the keys.

    On a large table only rows below a hash threshold, about twice as many as
    wanted, reach the final top-n: otherwise every task would send `rows` rows
    to it.  Too few below the threshold (repeated keys) means no threshold.
    """
    hashed = df.withColumn("_h", hash_order(keys, seed))
    total = df.count()
    if total > 8 * (rows + 1000):
        top = format(int((2 * rows + 1000) / total * 16 ** 12), "012x")
        near = hashed.where(F.col("_h") < top)
        if near.count() >= rows:
            hashed = near
    return hashed.orderBy("_h", *keys).limit(rows).drop("_h")


@dataclass(frozen=True)
class DumpSource:
    """A dump left by a database: a location and its format."""

    name: str
    location: str
    format: str = "parquet"
    kind: str = "db_dump"


@dataclass(frozen=True)
class StreamSource:
    """A stream: Kafka when the connector is on the class path, files otherwise."""

    name: str
    endpoint: str
    topic: str = ""
    protocol: str = "kafka"
    kind: str = "stream"
    options: Mapping[str, str] = field(default_factory=dict)


def read_dump(spark: SparkSession, source: DumpSource) -> DataFrame:
    return load_table(spark, source.location, source.format)


def read_stream(spark: SparkSession, source: StreamSource, schema: T.StructType | str | None = None) -> DataFrame:
    """Unbounded table of the source; file sources need a schema."""
    if source.protocol == "kafka":
        reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", source.endpoint)
        return reader.option("subscribe", source.topic).options(**source.options).load()
    if source.protocol in ("parquet", "json", "csv"):
        return spark.readStream.format(source.protocol).schema(schema).options(**source.options).load(source.endpoint)
    raise ValueError(f"unsupported stream protocol: {source.protocol}")


def list_sources(sources: DataFrame, type_filter: str | None = None) -> DataFrame:
    """Registered sources (name, type, …), optionally of one type."""
    listed = sources.where(F.col("type") == type_filter) if type_filter else sources
    return listed.select("name", "type")
