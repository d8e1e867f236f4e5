"""Messages as streams: topics, recipients, expiry, deduplication and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("recipients", T.ArrayType(T.StringType())),
        T.StructField("in_answer_to", T.StringType()),
        T.StructField("msg", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("ttl", T.LongType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("exclusive", T.BooleanType()),
    ]
)


def inbox(messages: DataFrame, receiver: str, topics: list[str] | None = None, late: str = "1 hour") -> DataFrame:
    """What a receiver gets, each message once: of its topics, to it or to all, not its
    own.  On a stream the watermark bounds the memory of seen ids."""
    out = messages.where((F.col("recipients").isNull()) | F.coalesce(F.array_contains("recipients", receiver), F.lit(False))).where(~F.col("sender").eqNullSafe(F.lit(receiver)))
    if topics:
        out = out.where(F.col("topic").isin(topics))
    return out.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["_id"]) if out.isStreaming else out.dropDuplicates(["_id"])


def alive(messages: DataFrame, now=None) -> DataFrame:
    """Messages whose time to live (in milliseconds) has not run out."""
    now = F.current_timestamp() if now is None else now
    return messages.where(F.coalesce(F.col("ttl") <= 0, F.lit(True)) | (F.unix_millis("timestamp") + F.col("ttl") > F.unix_millis(now)))


def by_priority(messages: DataFrame) -> DataFrame:
    """The order of processing: smaller numbers first, then the older."""
    return messages.orderBy(F.asc_nulls_last("priority"), "timestamp", "_id")


def answers(requests: DataFrame, replies: DataFrame, within: str = "1 minute") -> DataFrame:
    """Requests with the answers that came in time; both sides may be streams."""
    q = requests.select(F.col("_id").alias("request_id"), F.col("msg").alias("request"), F.col("timestamp").alias("asked_at"))
    r = replies.select(F.col("in_answer_to"), F.col("_id").alias("answer_id"), F.col("msg").alias("answer"), F.col("sender").alias("answered_by"), F.col("timestamp").alias("answered_at"))
    if requests.isStreaming:
        q, r = q.withWatermark("asked_at", within), r.withWatermark("answered_at", within)
    return q.join(r, F.expr(f"request_id = in_answer_to and answered_at >= asked_at and answered_at <= asked_at + interval {within}"))
