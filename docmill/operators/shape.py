"""Filtering, projection, reshaping, ordering and limiting of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.expr import compile_expr
from docmill.functions.paths import UnsupportedOperator, drop_path, resolve, set_path
from docmill.functions.predicates import collated, compile_filter, haversine_km, point_of
from docmill.operators.base import Context, sort_columns, stage


@stage("match")
def match(df: DataFrame, spec, ctx: Context) -> DataFrame:
    if ctx.collation:
        names, seen = df.columns, collated(df, ctx.collation)
        kept = seen.where(compile_filter(spec, ctx.scope(seen)))
        return kept.select(*[F.collate(F.col(f"`{n}`"), "UTF8_BINARY").alias(n) if isinstance(df.schema[n].dataType, T.StringType) else F.col(f"`{n}`") for n in names])
    return df.where(compile_filter(spec, ctx.scope(df)))


def _plain(v) -> bool:
    return isinstance(v, (bool, int, float)) and v in (0, 1)


@stage("project")
def project(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    scope = ctx.scope(df)
    rest = {k: v for k, v in spec.items() if k != "_id"}
    if rest and all(_plain(v) and not v for v in rest.values()):
        for path in spec if spec.get("_id", 1) == 0 else rest:
            df = drop_path(df, path)
        return df
    if not rest and spec.get("_id") in (0, False):
        return df.drop("_id")
    out, nested = [], {}
    if "_id" in df.columns and "_id" not in spec:
        out.append(F.col("_id"))
    for key, value in spec.items():
        if _plain(value) and not value:
            continue
        column = resolve(key, scope)[0] if _plain(value) else compile_expr(value, scope)
        if "." in key:  # sibling paths of one document are gathered into one struct
            head = key.split(".")[0]
            if head not in nested:
                nested[head] = {}
                out.append(head)
            nested[head][key.split(".", 1)[1]] = column
        else:
            out.append(column.alias(key))
    return df.select(*[_struct(nested[c]).alias(c) if isinstance(c, str) else c for c in out])


def _struct(fields: dict):
    groups: dict = {}
    for path, column in fields.items():
        head, *rest = path.split(".", 1)
        if rest:
            groups.setdefault(head, {})[rest[0]] = column
        else:
            groups[head] = column
    return F.struct(*[(_struct(v) if isinstance(v, dict) else v).alias(k) for k, v in groups.items()])


@stage("addFields", "set")
def add_fields(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    scope = ctx.scope(df)  # every value sees the input row
    plain = {k: compile_expr(v, scope) for k, v in spec.items() if "." not in k}
    dotted = {k: compile_expr(v, scope) for k, v in spec.items() if "." in k}
    out = df.withColumns(plain) if plain else df
    for path, value in dotted.items():
        out = set_path(out, path, value)
    return out


@stage("unset")
def unset(df: DataFrame, spec, ctx: Context) -> DataFrame:
    for path in [spec] if isinstance(spec, str) else spec:
        df = drop_path(df, path)
    return df


@stage("replaceRoot", "replaceWith")
def replace_root(df: DataFrame, spec, ctx: Context) -> DataFrame:
    root = spec["newRoot"] if isinstance(spec, dict) and "newRoot" in spec else spec
    return df.select(compile_expr(root, ctx.scope(df)).alias("__root")).select("__root.*")


@stage("redact")
def redact(df: DataFrame, spec, ctx: Context) -> DataFrame:
    """Rows and sub-documents are kept, pruned or descended into; an expression that
    names $$DESCEND is applied again in every embedded document."""
    keep, prune, descend = "__keep", "__prune", "__descend"

    def verdict(scope):
        for name, value in (("KEEP", keep), ("PRUNE", prune), ("DESCEND", descend)):
            scope = scope.with_variable(name, F.lit(value), T.StringType())
        return scope

    def inner(x, dtype):
        """An embedded document after redaction, null where it is pruned."""
        if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
            return F.filter(F.transform(x, lambda e: inner(e, dtype.elementType)), lambda e: e.isNotNull())
        if not isinstance(dtype, T.StructType):
            return x
        v = compile_expr(_relative(spec), verdict(ctx.scope(df)).with_variable("__here", x, dtype))
        down = F.struct(*[inner(x.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(x.isNull() | (v == prune), None).when(v == keep, x).otherwise(down)

    v = compile_expr(spec, verdict(ctx.scope(df)))
    kept = df.withColumn("__v", v).where(F.col("__v") != prune)
    nested = {f.name: F.when(F.col("__v") == keep, F.col(f"`{f.name}`")).otherwise(inner(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType))}
    return (kept.withColumns(nested) if nested else kept).drop("__v")


def _relative(spec):
    """Field references of an expression, taken from the embedded document."""
    if isinstance(spec, str) and spec.startswith("$") and not spec.startswith("$$"):
        return f"$$__here.{spec[1:]}"
    if isinstance(spec, dict):
        return {k: _relative(v) for k, v in spec.items()}
    return [_relative(x) for x in spec] if isinstance(spec, list) else spec


@stage("unwind")
def unwind(df: DataFrame, spec, ctx: Context) -> DataFrame:
    spec = {"path": spec} if isinstance(spec, str) else spec
    path, keep, index = spec["path"].lstrip("$"), spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    column, dtype = resolve(path, ctx.scope(df))
    array = column if isinstance(dtype, T.ArrayType) else F.when(column.isNotNull(), F.array(column))
    if index:
        explode = (F.posexplode_outer if keep else F.posexplode)(array).alias("__at", "__value")
        out = df.select("*", explode)
        at = F.col("__at").cast("bigint") if isinstance(dtype, T.ArrayType) else F.lit(None).cast("bigint")
        return set_path(out.withColumn(index, at), path, F.col("__value")).drop("__at", "__value")
    out = df.select("*", (F.explode_outer if keep else F.explode)(array).alias("__value"))
    return set_path(out, path, F.col("__value")).drop("__value")


@stage("sort")
def sort(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    return df.orderBy(*sort_columns(spec, ctx.scope(df)))


@stage("limit")
def limit(df: DataFrame, spec, ctx: Context) -> DataFrame:
    return df.limit(int(spec))


@stage("skip")
def skip(df: DataFrame, spec, ctx: Context) -> DataFrame:
    return df.offset(int(spec))


@stage("sample")
def sample(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """``size`` random rows: a top-k by a random key, so only k rows a task move."""
    return df.orderBy(F.rand(spec.get("seed"))).limit(int(spec["size"]))


@stage("geoNear")
def geo_near(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """Distance in kilometres to a point, within bounds, nearest first."""
    near = spec["near"]
    lon, lat = near["coordinates"] if isinstance(near, dict) else near
    key = spec.get("key") or next(f.name for f in df.schema if isinstance(f.dataType, T.StructType) and "coordinates" in f.dataType.fieldNames())
    column, dtype = resolve(key, ctx.scope(df))
    distance = haversine_km(*point_of(column, dtype), float(lon), float(lat))
    field = spec.get("distanceField", "distance")
    out = df.where(compile_filter(spec.get("query", {}), ctx.scope(df))) if spec.get("query") else df
    out = out.withColumn("__d", distance).where(F.col("__d").isNotNull())
    for name, keep in (("maxDistance", F.col("__d") <= spec.get("maxDistance", 0)), ("minDistance", F.col("__d") >= spec.get("minDistance", 0))):
        if spec.get(name) is not None:
            out = out.where(keep)
    out = set_path(out, field, F.col("__d") * spec.get("distanceMultiplier", 1.0))
    if spec.get("includeLocs"):
        out = set_path(out, spec["includeLocs"], resolve(key, ctx.scope(out))[0])
    return out.orderBy("__d").drop("__d")


def _unsupported(*names: str) -> None:
    for name in names:

        @stage(name)
        def refuse(df, spec, ctx, name=name):
            raise UnsupportedOperator(f"${name} has no meaning without the server it reports on")


_unsupported("indexStats", "planCacheStats", "search")
