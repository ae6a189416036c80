"""Artifacts on disk: JSON envelopes {metadata, items}, Parquet tables, markdown pages, and what is there of a data set."""

from __future__ import annotations

import hashlib
import tempfile
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType


def _envelope(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    items = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType().add("metadata", MapType(StringType(), StringType())).add("items", ArrayType(items))
    return spark.read.schema(whole).option("multiLine", True).json(path)


def read_items(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The items of an envelope by their schema; a file without metadata or items raises when it is read."""
    whole = _envelope(spark, path, schema)
    # The fault is part of what is unfolded, so no filter on the items can come before it.
    items = F.when(F.col("metadata").isNull() | F.col("items").isNull(), F.raise_error(F.lit("not an envelope of metadata and items"))).otherwise(F.col("items"))
    return whole.select(F.inline(items))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("metadata map<string,string>").option("multiLine", True).json(path)


@dataclass
class Available:
    """The tables that were found by name, and the names that were not."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    missing: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return not self.missing


def read_available(spark: SparkSession, base: str, schemas: dict[str, str]) -> Available:
    """Envelopes base/name.json, each by its schema; missing and unreadable ones are named, not raised."""
    out = Available()
    for name, schema in schemas.items():
        path = f"{base}/{name}.json"
        try:
            whole = _envelope(spark, path, schema)
            row = whole.select((F.col("metadata").isNull() | F.col("items").isNull()).alias("bad")).first()
        except AnalysisException:
            row = None
        if row is None or row["bad"]:
            out.missing.append(name)
        else:
            out.tables[name] = whole.select(F.inline("items"))
    return out


def write_envelope(items: DataFrame, path: str, artifact: str, version: str, **more: str) -> None:
    """An envelope of any size as a folder: items as JSON lines, and beside them one line of metadata with their number and the time."""
    items.write.mode("overwrite").json(f"{path}/items")
    told = items.agg(F.count("*").alias("record_count")).select(F.lit(artifact).alias("artifact_type"), F.lit(version).alias("schema_version"), F.current_timestamp().cast("string").alias("build_timestamp"), "record_count", *(F.lit(v).alias(k) for k, v in more.items()))
    told.write.mode("overwrite").json(f"{path}/metadata")


def read_written(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The items of an envelope that `write_envelope` has written; a number of rows that is not the metadata's raises."""
    items = spark.read.schema(schema).json(f"{path}/items")
    told = spark.read.json(f"{path}/metadata").select(F.col("record_count").alias("_told"))
    counted = items.agg(F.count("*").alias("_there")).join(told).select(F.when(F.col("_told") != F.col("_there"), F.raise_error(F.lit("not as many items as the metadata says"))).otherwise(F.lit(True)).alias("_whole"))
    return items.join(F.broadcast(counted), F.col("_whole")).drop("_whole")


def write_file(items: DataFrame, path: str, artifact: str, version: str, most: int = 100_000, **more: str) -> None:
    """A small envelope {metadata, items} as the one JSON document that `read_items` takes; more than `most` items raise."""
    n = items.count()
    if n > most:
        raise ValueError(f"{n} items are too many for one document; write_envelope takes them")
    told = [F.lit(artifact).alias("artifact_type"), F.lit(version).alias("schema_version"), F.current_timestamp().cast("string").alias("build_timestamp"), F.lit(str(n)).alias("record_count"), *(F.lit(v).alias(k) for k, v in more.items())]
    items.agg(F.collect_list(F.struct("*")).alias("items")).select(F.struct(*told).alias("metadata"), "items").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


class Cache:
    """Tables by path, read once: asked for again, a table is the same frame until its files change or it is dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, {}

    def items(self, path: str, schema: StructType | str) -> DataFrame:
        stamp = tuple(sorted((r["path"], str(r["modificationTime"]), r["length"]) for r in self.spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length").collect()))
        if path not in self.known or self.known[path][0] != stamp:
            self.drop(path)
            self.known[path] = (stamp, read_items(self.spark, path, schema).cache())
        return self.known[path][1]

    def drop(self, path: str) -> None:
        if path in self.known:
            self.known.pop(path)[1].unpersist()


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir; in local mode, where it may be unset, one of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return f"{path}/envelopes"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="plotweave-")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of files as they are."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def fingerprint_or(spark: SparkSession, path: str, text: str) -> str:
    """The SHA-256 of a file, or of a text that stands for it where it cannot be read."""
    try:
        row = fingerprints(spark, path).select("sha256").first()
    except AnalysisException:
        row = None
    return row["sha256"] if row else hashlib.sha256(text.encode()).hexdigest()


def markdown(lines: DataFrame, title: str) -> DataFrame:
    """doc_id, text: a document's lines under a title in a text fence."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("doc_id").agg(F.concat(F.lit(f"# {title}\n\n```text\n"), body, F.lit("\n```\n")).alias("text"))


def preview(items: DataFrame, most: int = 420) -> DataFrame:
    """n, first: how many items there are, and the first as JSON, cut."""
    first = items.limit(1).select(F.substring(F.to_json(F.struct("*")), 1, most).alias("first"))
    return items.agg(F.count("*").alias("n")).join(first, how="left")


def status(counts: dict[str, int | None]) -> str:
    """How far a data set is, from the numbers of its scenes, entities, events and questions; None: not there."""
    if all(v is None for v in counts.values()):
        return "pending_phase_1_parser"
    if counts.get("scenes") is None:
        return "partial_artifacts"
    whole = all(counts.get(k) for k in ("entities", "events", "query_examples"))
    return "ready_for_queries" if whole else "phase_1_parser_ready"
