"""Sharding along a Hilbert curve through several metadata dimensions.

Size, language and source are quantised to ``2**BITS`` levels each and mapped to
their place on a three-dimensional Hilbert curve.  Documents are ordered by that
place and the order is cut into runs of equal row counts, so that each shard covers
a compact box of the metadata space and file statistics prune in every dimension.

Ranks are exact without a global sort: counts per curve cell (at most 2**15) and
per salt inside the cell give offsets, and row numbers run inside (cell, salt), so
a cell that holds a third of all rows spreads over many tasks.

Defined cases: null text has no bytes; null language or source sorts first; an
empty table gives no rows; repeated rows get slots of their own; ties in the order
are broken by salt, doc_id and text hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.common import broadcast_if_small, materialize, row_count

BITS = 5


def hilbert_index(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points, one row per point.

    Each level rotates and reflects the remaining bits so that the curve enters and
    leaves sub-cubes through neighbouring faces; the Gray code of the resulting
    bits, interleaved by dimension, is the place.
    """
    x = coords.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            high = (x[d] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(high, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            place = (place << 1) | ((x[d] >> level) & 1)
    return place


@F.pandas_udf(T.IntegerType())
def _place(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a.to_numpy(), b.to_numpy(), c.to_numpy()], axis=1)).astype(np.int32))


def _levels(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """Each value of ``column`` with its level: levels hold about equal row counts
    and follow the order of the values."""
    counts = df.groupBy(column).count()
    upto = F.sum("count").over(W.orderBy(F.asc_nulls_first(column)).rowsBetween(W.unboundedPreceding, 0)) - F.col("count")
    level = F.least(F.lit(2**bits - 1), F.floor(upto * 2**bits / F.sum("count").over(W.partitionBy()))).cast("int")
    return counts.select(F.col(column).alias("__value"), level.alias(f"__{column}_level"))


def hilbert_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, place, shard, slot`` for every document."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("bigint") + 1
    rows = docs.select("doc_id", "lang", "source", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("__u"))
    rows = materialize(rows, "shard-metadata")
    n = row_count(rows)
    rows = rows.withColumn("__size_level", F.least(F.lit(2**BITS - 1), F.floor(F.log2(F.col("size").cast("double")) * 1.5)).cast("int"))
    for c in ("lang", "source"):
        rows = rows.alias("r").join(broadcast_if_small(_levels(rows, c)).alias("l"), F.expr(f"r.{c} <=> l.__value")).select("r.*", f"l.__{c}_level")
    salts = max(1, int(math.sqrt(n) / 8))
    rows = rows.withColumn("place", _place("__source_level", "__lang_level", "__size_level")).withColumn("__salt", F.pmod("__u", F.lit(salts)).cast("int"))
    rows = materialize(rows.drop("__source_level", "__lang_level", "__size_level", "lang", "source"), "shard-places")

    counts = rows.groupBy("place", "__salt").count()
    running = lambda w, c: F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col(c)
    cells = counts.groupBy("place").agg(F.sum("count").alias("n")).select("place", running(W.orderBy("place"), "n").alias("cell_before"))
    offsets = counts.withColumn("in_cell", running(W.partitionBy("place").orderBy("__salt"), "count")).join(broadcast_if_small(cells), "place")
    offsets = offsets.select("place", "__salt", (F.col("cell_before") + F.col("in_cell")).alias("__before"))
    within = F.row_number().over(W.partitionBy("place", "__salt").orderBy("doc_id", "__u", "size", "text_crc32"))
    ranked = rows.join(offsets, ["place", "__salt"]).withColumn("__rank", F.col("__before") + within - 1)
    shard, start = _cuts(n, shards, F.col("__rank"))
    return ranked.select("doc_id", "size", "text_crc32", "place", shard.cast("int").alias("shard"), (F.col("__rank") - start).cast("bigint").alias("slot"))


def _cuts(n: int, shards: int, rank: Column) -> tuple[Column, Column]:
    """Shard of a rank and the shard's first rank; counts differ by one at most."""
    small, larger = divmod(n, shards)
    edge = larger * (small + 1)
    late = larger + F.floor((rank - edge) / max(1, small))
    shard = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(late).cast("bigint")
    start = shard * small + F.least(shard, F.lit(larger).cast("bigint"))
    return shard, start


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write ``docs`` as one folder per shard, each sorted by slot.  Rows of one doc_id
    whose texts have equal sizes and checksums share out their slots in a fixed order.
    Columns of ``docs`` named shard or slot are written as ``shard_`` and ``slot_``."""
    of = ["__id", "__crc", "__size"]
    where = hilbert_shards(docs, shards).toDF("__id", "__size", "__crc", "__place", "__shard", "__slot")
    where = where.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("__shard", "__slot"))).alias("__slots"))
    text = F.coalesce("text", F.lit(""))
    mine = docs.withColumns({"__own_id": F.col("doc_id"), "__own_crc": F.crc32(text), "__own_size": F.octet_length(text).cast("bigint") + 1})
    rest = F.to_json(F.struct(*[c for c in docs.columns if c.lower() != "text"]))
    turn = F.row_number().over(W.partitionBy("__own_id", "__own_crc", "__own_size").orderBy("text", rest))
    joined = mine.withColumn("__turn", turn).join(where, F.expr("__own_id <=> __id and __own_crc = __crc and __own_size = __size"))
    at = F.get("__slots", F.col("__turn") - 1)
    kept = [F.col(c).alias(f"{c}_" if c.lower() in ("shard", "slot") else c) for c in docs.columns]
    out = joined.select(*kept, at["__shard"].alias("shard"), at["__slot"].alias("slot"))
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
