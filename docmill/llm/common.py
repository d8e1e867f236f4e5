"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of every word and line rule here: space, \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = 2**63 - 1
#: Tables of at most so many short rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def on_workers(spark: SparkSession) -> None:
    """Let Python workers that see this file system import this package.  Clusters
    that do not share it ship the package with ``--py-files``."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session without that setting (a local test) gets a folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="docmill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/docmill-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: its lineage ends
    there, so a lost executor costs no recomputation and branches share the work.
    Nothing else reads the shuffle files of that write; Spark removes them after it."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_to = at
    return out


def discard(table: DataFrame) -> None:
    """Remove a table of :func:`materialize` once all that read it has been written."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a count proves that ``df`` stays below ``rows``;
    otherwise leave Spark to shuffle (and split skewed partitions)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII takes the fast built-in path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def texts(batch: pa.RecordBatch, column: str = "text", most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch cut into slices of about ``most`` bytes of text, each with its
    texts as UTF-8 (null: empty).  A single longer text is a slice of its own."""
    values = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(column).to_pylist()]
    start = size = 0
    for i, value in enumerate(values):
        if i > start and size + len(value) > most:
            yield batch.slice(start, i - start), values[start:i]
            start, size = i, 0
        size += len(value)
    if values:
        yield batch.slice(start), values[start:]


def row_count(df: DataFrame) -> int:
    """Rows of ``df``; over bare Parquet this reads footers only."""
    return df.select(F.lit(1)).count()
