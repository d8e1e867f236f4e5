"""Reading and writing collections, sequences and write-time columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None, aliases: dict[str, list[str]] | None = None, rest: str | None = None, **options) -> DataFrame:
    """A collection.  ``aliases`` names former field names; ``rest`` gathers the fields
    outside ``schema`` (JSON lines only) into one map column."""
    if rest and format == "json" and schema is not None:
        known = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        raw = spark.read.text(path).select(F.from_json("value", known).alias("d"), F.from_json("value", "map<string,string>").alias("m"))
        return raw.select("d.*", F.map_filter("m", lambda k, v: ~k.isin(known.fieldNames())).alias(rest))
    reader = spark.read.format(format).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    for name, old in (aliases or {}).items():
        there = [c for c in (name, *old) if c in df.columns]
        if there:
            df = df.withColumn(name, F.coalesce(*[F.col(c) for c in there])).drop(*[c for c in there if c != name])
    return df


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def stamped(df: DataFrame, created: str | None = None, changed: str | None = None, version: str | None = None) -> DataFrame:
    """Creation and change times, and a version that starts at 1 and counts up."""
    out: dict[str, Column] = {}
    if created:
        out[created] = F.coalesce(created, F.current_timestamp()) if created in df.columns else F.current_timestamp()
    if changed:
        out[changed] = F.current_timestamp()
    if version:
        out[version] = F.coalesce(F.col(version), F.lit(0)) + 1 if version in df.columns else F.lit(1)
    return df.withColumns(out)


def sequenced(df: DataFrame, field: str, order: list[str], start: int = 1, step: int = 1) -> DataFrame:
    """Consecutive numbers in an order, without a global window: rows are range-sorted,
    the partitions' counts give offsets, and numbers run inside each partition."""
    from docmill.storage import materialize

    ranged = materialize(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "sequence")
    before = F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, 0)) - F.col("__c")
    offsets = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__c")).select("__p", before.alias("__before"))
    n = F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1 + F.col("__before")
    return ranged.join(F.broadcast(offsets), "__p").withColumn(field, (n * step + start).cast("bigint")).drop("__p", "__before")


def capped(df: DataFrame, order: str, most: int) -> DataFrame:
    """A capped collection: the newest ``most`` rows."""
    return df.orderBy(F.desc(order)).limit(most)
