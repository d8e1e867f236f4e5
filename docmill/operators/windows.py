"""$setWindowFields: ranks, shifts, framed accumulators and series functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.accumulators import order_of
from docmill.functions.expr import compile_expr, nearest_rank
from docmill.functions.paths import UnsupportedOperator, set_path
from docmill.operators.base import Context, sort_columns, stage
from docmill.storage import on_workers

# Seconds of the fixed-length time units.
SECONDS = {"week": 604800, "day": 86400, "hour": 3600, "minute": 60, "second": 1, "millisecond": 0.001}
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _bound(x, whole: bool):
    if x == "unbounded":
        return None
    return 0 if x == "current" else x


def _rows(w: WindowSpec, frame: list) -> WindowSpec:
    lo, hi = (_bound(x, True) for x in frame)
    return w.rowsBetween(W.unboundedPreceding if lo is None else lo, W.unboundedFollowing if hi is None else hi)


class _Frame:
    """One output's partition, order and frame."""

    def __init__(self, df: DataFrame, spec: dict, window: dict | None, ctx: Context):
        self.scope, self.sort = ctx.scope(df), spec.get("sortBy") or {}
        by = spec.get("partitionBy")
        self.keys = [compile_expr(by, self.scope)] if by is not None else []
        base = W.partitionBy(*self.keys)
        self.ordered = base.orderBy(*sort_columns(self.sort, self.scope)) if self.sort else base
        self.reversed = base.orderBy(*sort_columns({k: -way for k, way in self.sort.items()}, self.scope)) if self.sort else base
        self.key = order_of(self.sort, self.scope)[0][0] if self.sort else None
        self.time = self.key is not None and isinstance(self.scope.type_of(self.key), _TIMES)
        self.window = window
        if window is None:
            self.frame = self.ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing) if self.sort else base
        elif "documents" in window:
            self.frame = _rows(self.ordered, window["documents"])
        else:
            if len(self.sort) != 1 or next(iter(self.sort.values())) != 1:
                raise UnsupportedOperator("a range frame needs one ascending sort key")
            lo, hi = (_bound(x, False) for x in window["range"])
            key = self.key
            if window.get("unit"):
                # Times become microseconds, so that any unit is exact.
                scale = round(SECONDS[window["unit"]] * 1_000_000)
                key = F.unix_micros(key.cast("timestamp"))
                lo, hi = (None if x is None else int(x * scale) for x in (lo, hi))
            ordered = base.orderBy(F.asc_nulls_first(key if window.get("unit") else (key.cast("double") if any(isinstance(x, float) for x in (lo, hi)) else key)))
            self.frame = ordered.rangeBetween(W.unboundedPreceding if lo is None else lo, W.unboundedFollowing if hi is None else hi)

    def number(self) -> Column:
        """The sort key as a number: seconds for times."""
        return F.unix_micros(self.key.cast("timestamp")) / 1_000_000 if self.time else self.key.cast("double")

    def values(self, x: Column) -> Column:
        """The frame's values in order, nulls kept."""
        return F.transform(F.collect_list(F.struct(x.alias("v"))).over(self.frame), lambda e: e["v"])


def _sorted_frame(f: _Frame, arg: dict, bottom: bool, many: bool) -> Column:
    by = arg["sortBy"]
    out = F.array(*[compile_expr(o, f.scope) for o in arg["output"]]) if isinstance(arg["output"], list) else compile_expr(arg["output"], f.scope)
    keys = order_of(by, f.scope)
    rows = F.collect_list(F.struct(*[k.alias(f"k{i}") for i, (k, _) in enumerate(keys)], out.alias("v"))).over(f.frame)

    def before(a: Column, b: Column) -> Column:
        found = F.lit(0)
        for i, (_, up) in reversed(list(enumerate(keys))):
            p, q = a[f"k{i}"], b[f"k{i}"]
            less, more = (-1, 1) if up else (1, -1)
            found = F.when(p.eqNullSafe(q), found).when(p.isNull(), less).when(q.isNull(), more).when(p < q, less).otherwise(more)
        return found

    values = F.transform(F.array_sort(rows, before), lambda e: e["v"])
    if not many:
        return F.try_element_at(values, F.lit(-1 if bottom else 1))
    n = compile_expr(arg["n"], f.scope)
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n) if bottom else F.slice(values, F.lit(1), n)


def _unit(arg: dict) -> float:
    return SECONDS[arg["unit"]] if arg.get("unit") else 1.0


def _derivative(f: _Frame, arg: dict) -> Column:
    x, k = compile_expr(arg["input"], f.scope).cast("double"), f.number()
    ends = lambda c: F.last(c).over(f.frame) - F.first(c).over(f.frame)
    return F.try_divide(ends(x), ends(k) / _unit(arg))


def _integral(f: _Frame, arg: dict) -> Column:
    """Trapezoids over the frame's rows."""
    x, k = compile_expr(arg["input"], f.scope).cast("double"), f.number()
    pairs = F.collect_list(F.struct(k.alias("k"), x.alias("x"))).over(f.frame)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("k"), F.lit(None).cast("double").alias("x"))
    step = lambda a, e: F.struct((a["s"] + F.coalesce((e["k"] - a["k"]) * (e["x"] + a["x"]) / 2, F.lit(0.0))).alias("s"), e["k"].alias("k"), e["x"].alias("x"))
    return F.aggregate(pairs, start, step, lambda a: a["s"]) / _unit(arg)


def moving_average(df: DataFrame, field: str, x: Column, w: WindowSpec, alpha: float) -> DataFrame:
    """``field``: exponential moving average of ``x`` along ``w``, in one pass over the
    sorted rows; a null gives null and leaves the state alone."""
    on_workers(df.sparkSession)
    kept = [c for c in df.columns if c != field]
    marked = df.select(*[F.col(f"`{c}`") for c in kept], x.alias("__x"), (F.row_number().over(w) == 1).alias("__new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            out = []
            for value, new in zip(batch.column("__x").to_pylist(), batch.column("__new").to_pylist(), strict=True):
                if new:
                    state = None
                if value is not None:
                    state = value if state is None else value * alpha + state * (1 - alpha)
                out.append(None if value is None else state)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(out, pa.float64())], [*kept, field])

    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(field, T.DoubleType())])
    return marked.mapInArrow(run, schema)


def linear_fill(x: Column, k: Column, w: WindowSpec, back: WindowSpec) -> Column:
    """Linear interpolation of nulls between their neighbours; ends stay null.  ``back``
    is ``w`` in reverse, so that both neighbours come from running frames."""
    known = F.when(x.isNotNull(), k)
    last = lambda c, v: F.last(c, ignorenulls=True).over(v.rowsBetween(W.unboundedPreceding, 0))
    x0, x1, k0, k1 = last(x.cast("double"), w), last(x.cast("double"), back), last(known, w), last(known, back)
    between = F.when(k1 == k0, x0).otherwise(x0 + (x1 - x0) * (k - k0) / (k1 - k0))
    return F.coalesce(x.cast("double"), between)


def _output(f: _Frame, name: str, arg) -> Column:
    rank = {"$documentNumber": F.row_number, "$rank": F.rank, "$denseRank": F.dense_rank}
    if name in rank:
        return rank[name]().over(f.ordered).cast("bigint")
    if name == "$shift":
        by, x = arg["by"], compile_expr(arg["output"], f.scope)
        moved = (F.lead(F.struct(x.alias("v")), by) if by >= 0 else F.lag(F.struct(x.alias("v")), -by)).over(f.ordered)
        return F.when(moved.isNotNull(), moved["v"]).otherwise(compile_expr(arg.get("default"), f.scope)) if arg.get("default") is not None else moved["v"]
    if name == "$count":
        return F.count(F.lit(1)).over(f.frame)
    if name in ("$top", "$bottom", "$topN", "$bottomN"):
        return _sorted_frame(f, arg, "bottom" in name, name.endswith("N"))
    if name in ("$firstN", "$lastN", "$minN", "$maxN"):
        values, n = f.values(compile_expr(arg["input"], f.scope)), compile_expr(arg["n"], f.scope)
        if name in ("$minN", "$maxN"):
            return F.slice(F.sort_array(F.array_compact(values), asc=name == "$minN"), F.lit(1), n)
        return F.slice(values, F.lit(1), n) if name == "$firstN" else F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)
    if name in ("$covariancePop", "$covarianceSamp"):
        return (F.covar_pop if name.endswith("Pop") else F.covar_samp)(*[compile_expr(a, f.scope).cast("double") for a in arg]).over(f.frame)
    if name in ("$derivative", "$integral"):
        return (_derivative if name == "$derivative" else _integral)(f, arg)
    if name in ("$median", "$percentile"):
        values = f.values(compile_expr(arg["input"], f.scope))
        return nearest_rank(values, F.lit(0.5)) if name == "$median" else F.transform(F.array(*[F.lit(float(p)) for p in arg["p"]]), lambda p: nearest_rank(values, p))
    x = compile_expr(arg, f.scope)
    if name == "$locf":
        return F.last(x, ignorenulls=True).over(f.ordered.rowsBetween(W.unboundedPreceding, 0))
    if name == "$linearFill":
        return linear_fill(x, f.number(), f.ordered, f.reversed)
    if name == "$push":
        return f.values(x)
    if name == "$addToSet":
        return F.array_sort(F.collect_set(x).over(f.frame))
    if name == "$sum":
        return F.coalesce(F.sum(x).over(f.frame).cast("double"), F.lit(0.0))
    simple = {"$avg": F.avg, "$min": F.min, "$max": F.max, "$first": F.first, "$last": F.last, "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp}
    if name not in simple:
        raise UnsupportedOperator(f"unknown window function {name}")
    return simple[name](x).over(f.frame)


@stage("setWindowFields")
def set_window_fields(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """Outputs of one frame share a window; all share one shuffle by the partition."""
    out, averages = {}, {}
    for field, how in spec["output"].items():
        (name, arg), *more = [(k, v) for k, v in how.items() if k != "window"]
        if more:
            raise UnsupportedOperator("an output has one window function")
        if name == "$expMovingAvg":
            averages[field] = arg
            continue
        out[field] = _output(_Frame(df, spec, how.get("window"), ctx), name, arg)
    flat = {k: v for k, v in out.items() if "." not in k}
    for field, arg in averages.items():
        f = _Frame(df, spec, None, ctx)
        alpha = arg["alpha"] if "alpha" in arg else 2.0 / (arg["N"] + 1)
        df = moving_average(df, field, compile_expr(arg["input"], f.scope).cast("double"), f.ordered, alpha)
    result = df.withColumns(flat)
    for k, v in out.items():
        if "." in k:
            result = set_path(result, k, v)
    return result
