"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded shuffle, offered twice (two
epochs).  A document's virtual finish time is the tokens its source has sent up to
and with it, divided by the source's target; documents of all sources are then
range-sorted by that time and the mix is cut where the total budget is used up.

Prefix sums never run over a whole source in one task: documents fall into
about sqrt(n) shuffle buckets, bucket sums give offsets, and windows run inside
(source, bucket).  The global cut likewise uses the sums of the range partitions
and orders rows only inside the one partition that the budget ends in.

Equal rows are counted per task before anything is sorted, and each copy has a finish
time of its own, so a cut may fall among copies and no group of them meets in a task.

Defined cases: null text has size 0 and is never counted; a null source is a
source of its own, last in order; an empty table gives an empty mix; of repeated rows
as many are taken as fit, whichever; targets are 0 where all sizes are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.llm.common import WORD, broadcast_if_small, materialize, row_count

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
REPEATS = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): the budget is divided by
    weight, capped at ``most`` times a source's size, and the excess reshared.

    In order of cap/weight a source is capped exactly if what is left, dealt by
    weight from it on, would exceed its cap; so one ordered pass over the sources
    reaches the fixed point of repeated resharing.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    filled = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, 0)
    left = share * F.sum("source_size").over(W.partitionBy()) - F.sum("cap").over(filled) + F.col("cap")
    open_weight = F.sum("weight").over(W.partitionBy()) - F.sum("weight").over(filled) + F.col("weight")
    per = per.withColumn("level", left / open_weight).withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
    at = F.row_number().over(W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source"))
    per = per.withColumn("at", at)
    level = F.min(F.when(~F.col("capped"), F.struct("at", "level"))).over(W.partitionBy())["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def _upto(order: list[str], cut: tuple, epoch: int) -> Column:
    """Whether (time, epoch, *rest) sorts at or before the cut."""
    here = [F.col(order[0]), F.lit(epoch), *[F.col(c) for c in order[1:]]]
    at_or_before: Column = F.lit(True)
    for c, value in reversed(list(zip(here, cut, strict=True))):
        less = F.coalesce(c < F.lit(value), c.isNull() & F.lit(value is not None))
        at_or_before = less | (c.eqNullSafe(F.lit(value)) & at_or_before)
    return at_or_before


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per document, with ``source``;
    ``taken`` is 0, 1 or 2 times ``size``.  ``keep`` names further columns to carry."""
    keep = keep or []
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = docs.select("doc_id", "source", size.alias("size"), shuffled(seed).alias("u"), *[c for c in keep if c != "u"])
    sized = materialize(sized, "mix-sizes")
    n = row_count(sized)
    buckets = 2 ** max(0, min(20, math.ceil(math.log2(max(1.0, n / max(1024.0, math.sqrt(n)))))))
    targets = materialize(source_targets(sized, weights, share, most), "mix-targets")
    bucket = F.floor(F.conv(F.substring("u", 1, 5), 16, 10).cast("bigint") * buckets / 2**20).cast("int")
    names = list(dict.fromkeys(["doc_id", "source", "size", "u", *keep]))
    copies = sized.withColumn("task", F.spark_partition_id()).groupBy(*names, "task").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(copies.withColumn("bucket", bucket), "mix-copies")
    before = F.sum("sum").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("sum")
    offsets = rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("sum")).select("source", "bucket", before.alias("before"))
    rows = rows.alias("r").join(offsets.alias("o"), F.expr("r.source <=> o.source and r.bucket = o.bucket")).select("r.*", "o.before")
    rows = rows.alias("r").join(broadcast_if_small(targets).alias("t"), F.expr("r.source <=> t.source")).select("r.*", "t.source_size", "t.target")
    order = list(dict.fromkeys(["u", "doc_id", "size", *keep, "task"]))
    all_copies = F.col("size") * F.col("copies")
    inside = F.sum(all_copies).over(W.partitionBy("source", "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - all_copies
    rows = rows.withColumn("done", F.col("before") + inside).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    done = F.col("done") + F.col("copy") * F.col("size")
    rows = rows.withColumn("t1", F.try_divide(done.cast("double"), "target")).withColumn("t2", F.try_divide(F.col("source_size") + done.cast("double"), "target"))
    rows = materialize(rows.drop("before", "bucket", "task", "copies", "copy", "done"), "mix-times")
    cut = _cut(rows, share)
    taken = sum((F.when(_upto([t, "u", "doc_id"], cut, e), F.col("size")).otherwise(0) for e, t in ((0, "t1"), (1, "t2"))), F.lit(0)) if cut else F.lit(0)
    return rows.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce(taken, F.lit(0)).cast("bigint").alias("taken"), *keep)


def shuffled(seed: int) -> Column:
    """A document's place in its source's seeded shuffle, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def _cut(rows: DataFrame, share: float) -> tuple | None:
    """The last (time, epoch, u, doc_id) of the global order within the budget."""
    order = ["time", "epoch", "u", "doc_id"]
    turns = F.explode(F.array(F.struct(F.col("t1").alias("time"), F.lit(0).alias("epoch")), F.struct(F.col("t2").alias("time"), F.lit(1).alias("epoch"))))
    entries = rows.where("size > 0").select("u", "doc_id", "size", turns.alias("e")).select("e.time", "e.epoch", "u", "doc_id", "size")
    ranged = materialize(entries.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-order")
    budget = share * (rows.agg(F.sum("size")).first()[0] or 0)
    before = F.sum("sum").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("sum")
    sums = ranged.groupBy("part").agg(F.sum("size").alias("sum")).withColumn("before", before)
    last = sums.where(F.col("before") <= budget).orderBy(F.desc("part")).first()
    if last is None:
        return None
    # An empty head means that the cut lies at the end of the partition before it.
    for part in (last["part"], last["part"] - 1):
        start = sums.where(F.col("part") == part).first()
        if start is None:
            continue
        total = F.sum("size").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) + F.lit(start["before"])
        head = ranged.where(F.col("part") == part).withColumn("total", total).where(F.col("total") <= budget)
        if found := head.orderBy(*[F.desc(c) for c in order]).first():
            return tuple(found[c] for c in order)
    return None


def mixed_documents(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    Rows equal in every column are brought together first, by partial aggregation, and
    then repeated as often as their copies are taken; texts move once.
    """
    # Several columns may have one name; by place they are told apart.
    plain = docs.toDF(*[f"__{i}" for i in range(len(docs.columns))])
    names = {c.lower(): f"__{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    seen = plain.withColumns({c: F.col(names[c]) for c in ("doc_id", "text", "source")})
    marked = seen.withColumns({"u": shuffled(seed), "mark": F.xxhash64(*plain.columns)})
    verdict = fair_mix(marked, seed=seed, keep=["u", "mark"], **options).where("taken > 0")
    verdict = verdict.groupBy("doc_id", "u", "mark").agg(F.sum(F.expr("taken div size")).alias("__times")).alias("v")
    one = marked.groupBy("u", "mark").agg(F.first(F.struct(*plain.columns)).alias("row"), F.first("doc_id").alias("doc_id")).alias("d")
    joined = one.join(verdict, F.expr("d.u = v.u and d.mark = v.mark")).select("d.row", "v.__times")
    # A bounded array at a time, however many copies there are.
    part = joined.withColumn("__at", F.explode(F.expr(f"sequence(0L, (__times - 1) div {REPEATS})")))
    each = part.withColumn("__n", F.explode(F.expr(f"sequence(1L, least({REPEATS}L, __times - __at * {REPEATS}))")))
    return each.select("row.*").toDF(*docs.columns)
