"""Gap filling: $densify and $fill."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.expr import compile_expr
from docmill.functions.paths import UnsupportedOperator, literal
from docmill.operators.base import Context, sort_columns, stage
from docmill.operators.windows import linear_fill

_MONTHS = {"month": 1, "quarter": 3, "year": 12}


@stage("densify")
def densify(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """Rows for the missing steps of a grid.  The grid is generated per partition from
    its bounds, so it is distributed as the partitions are."""
    field, how, keys = spec["field"], spec["range"], spec.get("partitionByFields", [])
    step, unit, bounds = how["step"], how.get("unit"), how["bounds"]
    x, dtype = F.col(field), df.schema[field].dataType
    if unit is not None and not isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise UnsupportedOperator("$densify: a unit needs a date field")
    known = df.where(x.isNotNull())
    if bounds == "partition":
        span = known.groupBy(*keys).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    else:
        groups = df.select(*keys).distinct() if keys else None
        if bounds == "full":
            one = known.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
        else:
            cast = lambda v: literal(v).cast(dtype) if isinstance(v, (dt.datetime, dt.date)) else F.lit(v).cast(dtype)
            one = df.sparkSession.range(1).select(cast(bounds[0]).alias("__lo"), cast(bounds[1]).alias("__hi"))
        span = groups.crossJoin(F.broadcast(one)) if groups is not None else one  # one row
    lo, hi = F.col("__lo"), F.col("__hi")
    if unit is None:
        n = F.floor((hi - lo) / step)
        values = F.transform(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint")), lambda i: (lo + i * step).cast(dtype))
    else:
        months = _MONTHS.get(unit)
        interval = f"interval {step * months} month" if months else f"interval {step} {unit}"
        values = F.sequence(lo, hi, F.expr(interval))
    grid = span.where("__lo is not null and __lo <= __hi").select(*keys, hi.alias("__hi"), F.explode(values).alias(field))
    if isinstance(bounds, (list, tuple)):
        grid = grid.where(x < hi)
    grid = grid.drop("__hi").alias("g")
    on = F.expr(" and ".join(f"g.`{k}` <=> d.`{k}`" for k in [*keys, field]))
    missing = grid.join(known.select(*keys, field).distinct().alias("d"), on, "left_anti")
    return df.unionByName(missing, allowMissingColumns=True)


@stage("fill")
def fill(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    scope, sort = ctx.scope(df), spec.get("sortBy") or {}
    by = [compile_expr(spec["partitionBy"], scope)] if spec.get("partitionBy") is not None else [F.col(f) for f in spec.get("partitionByFields", [])]
    along = lambda keys: W.partitionBy(*by).orderBy(*sort_columns(keys, scope)) if sort else None
    w, back = along(sort), along({k: -way for k, way in sort.items()})
    out = {}
    for field, how in spec["output"].items():
        x = F.col(field)
        if "value" in how:
            out[field] = F.coalesce(x, compile_expr(how["value"], scope))
        elif w is None:
            raise UnsupportedOperator("$fill: locf and linear need sortBy")
        elif how["method"] == "locf":
            out[field] = F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
        elif how["method"] == "linear":
            if len(sort) != 1:
                raise UnsupportedOperator("$fill: linear needs one sort key")
            key = next(iter(sort))
            time = isinstance(df.schema[key].dataType, (T.TimestampType, T.TimestampNTZType))
            k = F.unix_micros(F.col(key).cast("timestamp")) / 1_000_000 if time else F.col(key).cast("double")
            out[field] = linear_fill(x, k, w, back)
        else:
            raise UnsupportedOperator(f"$fill method {how['method']}")
    return df.withColumns(out)
