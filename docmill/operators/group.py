"""Grouping: $group, $count, $sortByCount, $bucket, $bucketAuto and $facet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.functions.accumulators import accumulate
from docmill.functions.expr import compile_expr
from docmill.functions.paths import UnsupportedOperator, literal
from docmill.operators.base import Context, run_pipeline, stage


def _aggregates(df: DataFrame, output: dict, ctx: Context) -> list[Column]:
    scope, ordering = ctx.scope(df), ctx.ordering_columns(df)
    return [accumulate(v, scope, ordering).alias(k) for k, v in output.items()]


@stage("group")
def group(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """Partial aggregation runs before the shuffle; null and missing keys are one."""
    output = {k: v for k, v in spec.items() if k != "_id"}
    aggregates = _aggregates(df, output, ctx)
    key = spec.get("_id")
    if key is None:
        # No rows, no group: an ungrouped aggregate would give one.
        out = df.agg(F.count(F.lit(1)).alias("__n"), *aggregates).where("__n > 0")
        return out.select(F.lit(None).cast("string").alias("_id"), *output)
    column = compile_expr(key, ctx.scope(df))
    if not aggregates:
        return df.select(column.alias("_id")).distinct()
    return df.groupBy(column.alias("_id")).agg(*aggregates)


@stage("count")
def count(df: DataFrame, spec: str, ctx: Context) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(spec)).where(F.col(spec) > 0)


@stage("sortByCount")
def sort_by_count(df: DataFrame, spec, ctx: Context) -> DataFrame:
    counted = df.groupBy(compile_expr(spec, ctx.scope(df)).alias("_id")).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"))


@stage("bucket")
def bucket(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """Boundaries are half-open; a row outside all needs a default."""
    x, bounds = compile_expr(spec["groupBy"], ctx.scope(df)), spec["boundaries"]
    which = None
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        which = (F if which is None else which).when((x >= literal(lo)) & (x < literal(hi)), literal(lo))
    if "default" in spec:
        default = literal(spec["default"])
        mixed = isinstance(spec["default"], str) != isinstance(bounds[0], str)
        which = _with_default(which, default, mixed)
    else:
        which = which.otherwise(F.raise_error(F.lit("$bucket: a value lies outside all boundaries and there is no default")))
    return df.groupBy(which.alias("_id")).agg(*_aggregates(df, spec.get("output", {"count": {"$sum": 1}}), ctx))


def _with_default(which: Column, default: Column, mixed: bool) -> Column:
    """A default of another type than the boundaries turns the keys into strings."""
    return F.coalesce(which.cast("string"), default) if mixed else F.coalesce(which, default)


# The steps of each preferred-number series within one decade.
_SERIES = {
    "R5": (10, 16, 25, 40, 63), "R10": (100, 125, 160, 200, 250, 315, 400, 500, 630, 800), "1-2-5": (10, 20, 50), "E6": (10, 15, 22, 33, 47, 68), "E12": (10, 12, 15, 18, 22, 27, 33, 39, 47, 56, 68, 82),
    "E24": (10, 11, 12, 13, 15, 16, 18, 20, 22, 24, 27, 30, 33, 36, 39, 43, 47, 51, 56, 62, 68, 75, 82, 91),
    "R20": (100, 112, 125, 140, 160, 180, 200, 224, 250, 280, 315, 355, 400, 450, 500, 560, 630, 710, 800, 900),
}
#: Finer series follow their rule: steps of equal ratio, rounded to three digits.
_RULED = {"R40": 40, "R80": 80, "E48": 48, "E96": 96, "E192": 192}


def series_steps(name: str) -> list[float]:
    """Steps of a series in [1, 10)."""
    if name in _SERIES:
        first = _SERIES[name][0]
        return [x / first for x in _SERIES[name]]
    if name in _RULED:
        return [round(10 ** (i / _RULED[name]), 2) for i in range(_RULED[name])]
    raise UnsupportedOperator(f"granularity {name}")


def rounded(x: Column, name: str, up: bool) -> Column:
    """The next series number above x, or the largest not above it."""
    if name == "POWERSOF2":
        e = F.floor(F.log2(x))
        return F.when(x <= 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), e + 1) if up else F.pow(F.lit(2.0), e))
    steps = series_steps(name)
    decade = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    table = F.array(*[F.lit(s) for s in (*steps, 10.0)])
    if up:
        step = F.array_min(F.filter(table, lambda s: s * decade > x))
    else:
        step = F.array_max(F.filter(table, lambda s: s * decade <= x * (1 + 1e-12)))
    return F.when(x <= 0, F.lit(0.0)).otherwise(step * decade)


@stage("bucketAuto")
def bucket_auto(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """Buckets of about equal counts; equal values stay together, and a bucket's max
    is the next one's min (the last one's own largest value).

    Values are counted first, so ranks come from one row per distinct value: the
    ordered window sees the distinct values only, not the rows.
    """
    n = int(spec["buckets"])
    scope = ctx.scope(df)
    rows = df.withColumn("__x", compile_expr(spec["groupBy"], scope)).where("__x is not null")
    granularity = spec.get("granularity")
    counts = rows.groupBy("__x").agg(F.count(F.lit(1)).alias("__n"))
    ordered = W.orderBy("__x").rowsBetween(W.unboundedPreceding, 0)
    upto, total = F.sum("__n").over(ordered), F.sum("__n").over(W.partitionBy())
    start = upto - F.col("__n")
    # Rows are dealt as evenly as they go, the first buckets getting one more.
    small, extra = F.floor(total / n), total % n
    edge = extra * (small + 1)
    which = F.when(start < edge, F.floor(start / (small + 1))).otherwise(extra + F.floor((start - edge) / F.greatest(small, F.lit(1))))
    dealt = counts.withColumn("__b", F.least(which, F.lit(n - 1)))
    if granularity:
        tops = dealt.groupBy("__b").agg(F.max("__x").alias("__top"))
        dealt = dealt.join(tops, "__b").withColumn("__b", rounded(F.col("__top").cast("double"), granularity, True))
    edges = dealt.groupBy("__b").agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    nxt = F.lead("__lo").over(W.orderBy("__b"))
    if granularity:
        lo = F.coalesce(F.lag("__b").over(W.orderBy("__b")), rounded(F.col("__lo").cast("double"), granularity, False))
        edges = edges.withColumn("_id", F.struct(lo.alias("min"), F.col("__b").alias("max")))
    else:
        edges = edges.withColumn("_id", F.struct(F.col("__lo").alias("min"), F.coalesce(nxt, F.col("__hi")).alias("max")))
    keyed = rows.join(dealt.select("__x", "__b"), "__x").join(F.broadcast(edges.select("__b", "_id")), "__b")
    out = spec.get("output", {"count": {"$sum": 1}})
    return keyed.groupBy("_id").agg(*_aggregates(keyed, out, ctx)).orderBy("_id.min")


@stage("facet")
def facet(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """Several pipelines over the same input as one row of arrays.  A facet's result
    is one array by definition; branches should end in a group, top-k or limit."""
    out = None
    for name, pipeline in spec.items():
        branch = run_pipeline(df, pipeline, ctx)
        one = branch.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in branch.columns])).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out

