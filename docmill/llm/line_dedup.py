"""Exact line deduplication across documents, with compressed keep bitmaps.

Lines are keyed by a 128-bit hash.  The hashes are range-partitioned (with a salt
of the document, so that a line held by a third of all documents spreads over many
tasks) and sorted by document and position; a running window streams each hash's
first occurrence.  A line after the first document of its salt group is a
duplicate at once.  Only the first documents of the salt groups, at most one a salt
for a hash, meet in a second range-partitioned pass; there are ``SALTS`` salts and one
more for every ``SALT_ROWS`` documents.  No text moves until the verdicts, packed as
bitmaps, are joined to their documents, which are rebuilt in time linear in their lines.

Defined cases: a null or empty text is one empty line and is kept; a null
``doc_id`` counts as one document after all others; repeated rows get the same
verdict; ties inside a document keep all its lines; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.llm.common import LAST_ID, SPACES, ascii_lower, materialize, row_count

SALTS, SALT_ROWS = 16, 1_000_000
MIN_CHARS = 10


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("__id"), F.xxhash64("text").alias("__row"), "doc_id", "text")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(__id, __row, pos) of every line that an earlier document already holds."""
    key = ascii_lower(F.btrim("line", F.lit(SPACES)))
    salts = SALTS + row_count(docs) // SALT_ROWS
    lines = (
        _identified(docs)
        .select("__id", "__row", F.posexplode(_lines()).alias("pos", "line"))
        .select("__id", "__row", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("int").alias("salt"), "__id", "__row", "pos")
    )
    lines = materialize(lines, "line-hashes")
    order = ("__id", "pos")
    first = F.first("__id").over(W.partitionBy("h1", "h2", "salt").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    ranged = lines.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", *order).withColumn("first", first)
    late = ranged.where(F.col("__id") > F.col("first"))
    leaders = ranged.where(F.col("__id") == F.col("first")).drop("first", "salt")
    first = F.first("__id").over(W.partitionBy("h1", "h2").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    leaders = leaders.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", *order).withColumn("first", first)
    cols = ["__id", "__row", "pos"]
    return late.select(cols).unionAll(leaders.where(F.col("__id") > F.col("first")).select(cols))


def line_keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document with a dropped line: ``bitmap``, an array of (word, dropped) in
    word order.  ``dropped`` marks lines 64*word ... 64*word+63; words without a
    dropped line are left out, which is the compression."""
    bit = F.expr("shiftleft(1L, pmod(pos, 64))")
    words = dropped_lines(docs, min_chars).groupBy("__id", "__row", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("dropped"))
    return words.groupBy("__id", "__row").agg(F.array_sort(F.collect_list(F.struct("word", "dropped"))).alias("bitmap"))


def _kept_lines(lines: Column, bitmap: Column) -> Column:
    """The lines that ``bitmap`` leaves.  The words left out of it are filled in, so that
    a line finds its bit by place; both arrays are bound once, as an element of an array
    of one, since what a lambda names is otherwise computed anew for every element."""
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(bitmap, i - 1)["word"])
    dense = F.flatten(F.transform(bitmap, lambda w, i: F.concat(F.array_repeat(F.lit(0).cast("bigint"), w["word"] - before(i) - 1), F.array(w["dropped"]))))
    gone = lambda words, i: F.call_function("getbit", F.coalesce(F.get(words, F.shiftright(i, 6)), F.lit(0).cast("bigint")), F.pmod(i, F.lit(64)))
    both = F.array(F.struct(lines.alias("lines"), dense.alias("words")))
    return F.get(F.transform(both, lambda x: F.filter(x["lines"], lambda line, i: gone(x["words"], i) == 0)), F.lit(0))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Each document with its text after line dedup.

    Returns ``doc_id, text, n_lines, n_dropped, bitmap`` and any further columns of
    ``docs`` unchanged; ``text`` is null only where it was null before.
    """
    # The new columns carry names of their own until the end: a further column of
    # docs may be called n_lines or bitmap, and then gives way to ours.
    extra = [c for c in docs.columns if c.lower() not in {"doc_id", "text", "n_lines", "n_dropped", "bitmap"}]
    marked = docs.select("doc_id", "text", *[F.col(f"`{c}`") for c in extra]).withColumns({"__id": F.coalesce("doc_id", F.lit(LAST_ID)), "__row": F.xxhash64("text")})
    joined = marked.join(line_keep_bitmaps(docs.select("doc_id", "text"), min_chars), ["__id", "__row"], "left")
    lines = _lines()
    text = F.when(F.col("bitmap").isNull(), F.col("text")).otherwise(F.array_join(_kept_lines(lines, F.col("bitmap")), "\n"))
    n_dropped = F.coalesce(F.aggregate("bitmap", F.lit(0).cast("bigint"), lambda a, w: a + F.bit_count(w["dropped"])), F.lit(0).cast("bigint"))
    return joined.select("doc_id", text.alias("text"), *[F.col(f"`{c}`") for c in extra], F.size(lines).cast("bigint").alias("n_lines"), n_dropped.alias("n_dropped"), "bitmap")
