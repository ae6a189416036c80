"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it may be unset, a folder of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "checkpoints", "plotweave")
        os.makedirs(path, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns a frame that reads it: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the sieve below: at most 512 bitmaps of 4 KB, whatever the number of ids.
SIEVE_BITS = 1 << 24


def sifted(docs: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose key may be one of the ids (one column), and those whose key is none of them.

    The sieve is a bitmap of hashed ids, of fixed size and so safe to broadcast; with very many ids
    it lets more rows through, never fewer. Rows that it holds back need not be moved to meet the ids.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(SIEVE_BITS))
    number, bitmap = (fresh(docs.columns, x) for x in ("sieve_number", "sieve_bits"))
    known = place(F.col(ids.columns[0]))
    sieve = settle(ids.groupBy(F.bitmap_bucket_number(known).alias(number)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(known)).alias(bitmap)), "sieve")
    asked = place(F.col(f"`{key}`"))
    bit = F.bitmap_bit_position(asked)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    met = docs.join(F.broadcast(sieve), F.bitmap_bucket_number(asked) == F.col(number), "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    return met.where(hit).select(*own), met.where(~hit).select(*own)


def among(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of docs whose key is one of the ids (one column)."""
    other = fresh(docs.columns, "asked_id")
    return sifted(docs, key, ids)[0].join(ids.toDF(other).hint("merge"), F.col(f"`{key}`") == F.col(other), "left_semi")


def without(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of docs whose key is none of the ids (one column); a null key is none."""
    other = fresh(docs.columns, "asked_id")
    maybe, surely = sifted(docs, key, ids)
    return surely.unionByName(maybe.join(ids.toDF(other).hint("merge"), F.col(f"`{key}`") == F.col(other), "left_anti"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_bytes(column: pa.Array) -> pa.Array:
    """Text as UTF-8 bytes with nulls made empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary()) if not pa.types.is_large_string(column.type) else column
        column = column.cast(pa.large_binary())
    return column.fill_null(b"")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_binary array in one uint8 vector, and where each value starts (one more than values)."""
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `most` bytes of text, or one longer text: numpy temporaries stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(flat(as_bytes(batch.column(column)))[1]))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def extended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with more columns."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


@contextmanager
def without_collector():
    """For loops that keep very many small objects and make no cycles: the collector would look through all of them again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def fresh(taken: list[str], name: str) -> str:
    """A column name that is not taken, compared as Spark does: without case."""
    have = {x.lower() for x in taken}
    while name.lower() in have:
        name = f"_{name}"
    return name
