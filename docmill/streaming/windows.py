"""Event-time aggregation with watermarks: tumbling, sliding and session windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.accumulators import accumulate
from docmill.functions.expr import compile_expr
from docmill.functions.paths import Scope


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need timestamps with a zone; zone-less ones are read as session time."""
    return df.withColumn(column, F.col(column).cast("timestamp")) if isinstance(df.schema[column].dataType, T.TimestampNTZType) else df


def windowed(df: DataFrame, time: str, duration: str, output: dict, keys: dict | None = None, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Accumulators per window (and key): tumbling, or sliding with ``slide``.
    ``late`` bounds how late events may come, and so the state that is kept."""
    return _grouped(df, time, lambda c: F.window(c, duration, slide) if slide else F.window(c, duration), output, keys, late)


def sessions(df: DataFrame, time: str, gap: str, output: dict, keys: dict | None = None, late: str | None = None) -> DataFrame:
    """Accumulators per session: events of a key at most ``gap`` apart."""
    return _grouped(df, time, lambda c: F.session_window(c, gap), output, keys, late)


def _grouped(df: DataFrame, time: str, window: Callable[[Column], Column], output: dict, keys: dict | None, late: str | None) -> DataFrame:
    df = event_time(df, time)
    if late:
        df = df.withWatermark(time, late)
    scope = Scope(df)
    by = [compile_expr(v, scope).alias(k) for k, v in (keys or {}).items()]
    out = df.groupBy(window(F.col(time)).alias("w"), *by).agg(*[accumulate(v, scope, []).alias(k) for k, v in output.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(keys or {}), *output)


def latest_state(df: DataFrame, key: str, time: str, path: str, checkpoint: str):
    """Keep the newest row per key as a Parquet table, one batch at a time: batch n
    writes version n from version n - 1, so a batch that is run again after a failure
    gives the same table."""
    from pyspark.sql import Window as W

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = spark.read.parquet(f"{path}/v{number - 1}").unionByName(batch)
        first = F.row_number().over(W.partitionBy(key).orderBy(F.desc(time)))
        rows.withColumn("__n", first).where("__n = 1").drop("__n").write.mode("overwrite").parquet(f"{path}/v{number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
