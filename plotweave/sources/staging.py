"""Tables that a plan reads more than once, written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from plotweave.sources.envelope import scratch


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a written table; its lineage ends here, and every later reader starts from the files."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str, buckets: int | None = None) -> DataFrame:
    """df as a table whose rows lie in buckets of the keys, sorted by them within each: joins and groups by the keys need no shuffle.

    Tables with as many buckets of keys of the same types meet bucket by bucket. The files are in the
    folder that driver and executors share; the table's name is in the session's catalogue.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", f"{scratch(spark)}/{table}").saveAsTable(table)
    return spark.table(table)
