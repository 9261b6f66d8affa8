"""Helpers that several operators share."""

from __future__ import annotations

import json
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast table may have this many bytes at most; larger ones are shuffled.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir). Where that is unset, a temporary one if Spark runs in one process, as in tests; otherwise an error, as executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/strandspark-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, and its lineage ends there, so that a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote and that nothing reads any more."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table of driver-side rows as one literal. ddl: columns as "a long, b string"."""
    names = [x.split()[0] for x in ddl.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{', '.join(':'.join(x.split()) for x in ddl.split(','))}>>")).alias("r")).select("r.*")


def bounded(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows stay within limit; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like names that df does not have."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def slices(batches, rows: int = 256):
    """Arrow batches in pieces of a few rows, so that a batch of long texts is never held twice as Python objects."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def by_bytes(batches, column: str, size: int):
    """Arrow batches in pieces with about size bytes in a text column; a longer text is a piece of its own."""
    for b in batches:
        n = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        k = 0
        while k < b.num_rows:
            to = max(k + 1, int(np.searchsorted(n, (n[k - 1] if k else 0) + size)))
            yield b.slice(k, to - k)
            k = to
