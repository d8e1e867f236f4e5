"""Change streams: events, filtering by pipelines, and applying them to collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.paths import UnsupportedOperator
from docmill.operators import Context, run_pipeline
from docmill.operators.sinks import merged

#: Stages that keep no state between rows, as change streams allow.
STATELESS = {"$match", "$project", "$addFields", "$set", "$unset", "$replaceRoot", "$replaceWith", "$redact"}


def event_schema(document: T.StructType, key: str = "_id") -> T.StructType:
    """The schema of change events over documents of the given schema."""
    ns = T.StructType([T.StructField("db", T.StringType()), T.StructField("coll", T.StringType())])
    update = T.StructType([T.StructField("updatedFields", document), T.StructField("removedFields", T.ArrayType(T.StringType()))])
    return T.StructType(
        [
            T.StructField("_id", T.StringType()),
            T.StructField("operationType", T.StringType()),
            T.StructField("fullDocument", document),
            T.StructField("fullDocumentBeforeChange", document),
            T.StructField("ns", ns),
            T.StructField("documentKey", T.StructType([T.StructField(key, document[key].dataType)])),
            T.StructField("updateDescription", update),
            T.StructField("clusterTime", T.TimestampType()),
            T.StructField("txnNumber", T.LongType()),
            T.StructField("lsid", T.StringType()),
        ]
    )


def watch(spark: SparkSession, path: str, document: T.StructType, pipeline: list[dict] | None = None, key: str = "_id", collection: str | None = None, files_per_batch: int = 16) -> DataFrame:
    """A stream of change events from Parquet files, filtered by a stateless pipeline.
    Without ``collection`` it watches the whole database; a query's checkpoint
    location is its resume token."""
    events = spark.readStream.schema(event_schema(document, key)).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    if collection:
        events = events.where(F.col("ns.coll") == collection)
    return filtered(events, pipeline or [])


def filtered(events: DataFrame, pipeline: list[dict]) -> DataFrame:
    for spec in pipeline:
        if next(iter(spec)) not in STATELESS:
            raise UnsupportedOperator(f"{next(iter(spec))} is not allowed on a change stream")
    return run_pipeline(events, pipeline, Context())


def diff(before: DataFrame, after: DataFrame, key: str = "_id", db: str = "db", coll: str = "coll") -> DataFrame:
    """The change events that lead from one state of a collection to another."""
    document = lambda df: F.struct(*[F.col(f"`{c}`") for c in before.columns])
    b = before.select(F.col(key).alias("__b"), document(before).alias("old"))
    a = after.select(F.col(key).alias("__a"), document(after).alias("new"))
    both = b.join(a, F.col("__a") == F.col("__b"), "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("replace")
    schema = event_schema(before.schema, key)
    columns = {
        "_id": F.sha2(F.to_json(F.struct(F.coalesce("__a", "__b").alias("k"), "old", "new")), 256), "operationType": kind, "fullDocument": F.col("new"), "fullDocumentBeforeChange": F.col("old"),
        "ns": F.struct(F.lit(db).alias("db"), F.lit(coll).alias("coll")), "documentKey": F.struct(F.coalesce("__a", "__b").alias(key)), "clusterTime": F.current_timestamp(),
    }
    return both.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def apply_changes(target: DataFrame, events: DataFrame, key: str = "_id") -> DataFrame:
    """A collection after a batch of events; the last event of a key decides."""
    last = events.groupBy(F.col(f"documentKey.{key}").alias("__key")).agg(F.max_by(F.struct("operationType", "fullDocument"), F.struct("clusterTime", "_id")).alias("e"))
    gone = last.where("e.operationType in ('delete', 'invalidate')").select("__key")
    written = last.where("e.operationType not in ('delete', 'invalidate')").select("e.fullDocument.*")
    kept = target.join(gone, F.col(key) == F.col("__key"), "left_anti")
    return merged(written, kept, [key], "replace", "insert", {}, Context())
