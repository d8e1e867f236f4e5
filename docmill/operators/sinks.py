"""Sources and sinks inside pipelines: $documents, $collStats, $out, $merge and the
stages that report on a server and are empty here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.paths import Scope, UnsupportedOperator
from docmill.operators.base import Context, run_pipeline, stage


def documents_frame(spark, rows: list[dict]) -> DataFrame:
    """Literal documents; a field that some rows lack is null there."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    if not names:
        return spark.createDataFrame([], "_id string")
    from pyspark.sql import Row

    return spark.createDataFrame([Row(**{n: _value(r.get(n)) for n in names}) for r in rows], samplingRatio=1.0)


def _value(v):
    from pyspark.sql import Row

    if isinstance(v, dict):
        return Row(**{k: _value(x) for k, x in v.items()})
    return [_value(x) for x in v] if isinstance(v, (list, tuple)) else v


@stage("documents")
def documents(df: DataFrame, spec: list[dict], ctx: Context) -> DataFrame:
    return documents_frame(df.sparkSession, spec)


@stage("collStats")
def coll_stats(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    zero = F.struct(F.lit(0).cast("bigint").alias("ops"), F.lit(0.0).alias("latency"))
    count = F.count(F.lit(1))
    out = [F.lit(ctx.collection or "").alias("ns")]
    if "count" in spec:
        out.append(count.alias("count"))
    if "storageStats" in spec:
        out.append(F.struct(count.alias("count"), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).alias("size")).alias("storageStats"))
    if "latencyStats" in spec:
        out.append(F.struct(zero.alias("reads"), zero.alias("writes"), zero.alias("commands")).alias("latencyStats"))
    return df.agg(count.alias("__n"), *out[1:]).select(out[0], *[F.col(c) for c in ("count", "storageStats", "latencyStats") if c in spec])


def _empty(*names: str) -> None:
    for name in names:

        @stage(name)
        def nothing(df, spec, ctx):
            return df.sparkSession.createDataFrame([], "_id string")


_empty("currentOp", "listSessions", "listLocalSessions")


def _target(spec, ctx: Context) -> str:
    if isinstance(spec, dict):
        return f"{spec['db']}.{spec['coll']}" if spec.get("db") else spec["coll"]
    return spec


@stage("out")
def out(df: DataFrame, spec, ctx: Context) -> DataFrame:
    """Replace the target collection; the pipeline itself then has no rows."""
    ctx.catalog[_target(spec, ctx)] = df
    return df.limit(0)


@stage("merge")
def merge(df: DataFrame, spec, ctx: Context) -> DataFrame:
    """Upsert into the target on key fields: one full outer join."""
    spec = {"into": spec} if isinstance(spec, str) else spec
    name, on = _target(spec["into"], ctx), spec.get("on", "_id")
    on = [on] if isinstance(on, str) else list(on)
    matched, unmatched = spec.get("whenMatched", "merge"), spec.get("whenNotMatched", "insert")
    source = df
    if name not in ctx.catalog:
        target = source.limit(0)
    else:
        target = ctx.catalog[name]
    ctx.catalog[name] = merged(source, target, on, matched, unmatched, spec.get("let", {}), ctx)
    return df.limit(0)


def merged(source: DataFrame, target: DataFrame, on: list[str], matched, unmatched: str, let: dict, ctx: Context) -> DataFrame:
    names = list(dict.fromkeys([*target.columns, *source.columns]))
    s = source.select(F.struct(*[F.col(f"`{c}`") for c in source.columns]).alias("__s"), *[F.col(f"`{k}`").alias(f"__sk{i}") for i, k in enumerate(on)])
    t = target.select(F.struct(*[F.col(f"`{c}`") for c in target.columns]).alias("__t"), *[F.col(f"`{k}`").alias(f"__tk{i}") for i, k in enumerate(on)])
    condition = F.lit(True)
    for i in range(len(on)):
        condition = condition & (F.col(f"__sk{i}") == F.col(f"__tk{i}"))
    both = t.join(s, condition, "full_outer")
    new, old = F.col("__s"), F.col("__t")
    fail = lambda text, f: F.raise_error(F.lit(text)).cast(f)
    if isinstance(matched, list):
        updated = _by_pipeline(both.where("__s is not null and __t is not null"), matched, let, ctx)
        rest = both.where("__s is null or __t is null")
        out = rest.select(*[_pick(c, source, target, "replace").alias(c) for c in names], old.isNull().alias("__fresh"))
        out = out.unionByName(updated.withColumn("__fresh", F.lit(False)), allowMissingColumns=True)
    else:
        if matched not in ("replace", "keepExisting", "merge", "fail"):
            raise UnsupportedOperator(f"$merge whenMatched {matched}")
        out = both.select(*[_pick(c, source, target, matched).alias(c) for c in names], old.isNull().alias("__fresh"))
        if matched == "fail":
            out = both.select(*[F.when(new.isNotNull() & old.isNotNull(), fail("$merge: a document with this key exists", (target.schema if c in target.columns else source.schema)[c].dataType)).otherwise(_pick(c, source, target, "merge")).alias(c) for c in names], old.isNull().alias("__fresh"))
    if unmatched == "discard":
        return out.where("not __fresh").drop("__fresh")
    if unmatched == "fail":
        first = out.columns[0]
        out = out.withColumn(first, F.when(F.col("__fresh"), fail("$merge: no document with this key", out.schema[first].dataType)).otherwise(F.col(first)))
    elif unmatched != "insert":
        raise UnsupportedOperator(f"$merge whenNotMatched {unmatched}")
    return out.drop("__fresh")


def _pick(c: str, source: DataFrame, target: DataFrame, matched: str):
    new = F.col("__s").getField(c) if c in source.columns else F.lit(None)
    old = F.col("__t").getField(c) if c in target.columns else F.lit(None)
    fresh, gone = F.col("__t").isNull(), F.col("__s").isNull()
    if matched == "keepExisting":
        return F.when(fresh, new).otherwise(old)
    if matched == "replace":
        return F.when(gone, old).otherwise(new)
    # Fields the new document lacks stay; columns it has win.
    return F.when(gone, old).otherwise(new if c in source.columns else old)


def _by_pipeline(both: DataFrame, pipeline: list[dict], let: dict, ctx: Context) -> DataFrame:
    """The stored document after a pipeline that sees the new one as $$new."""
    from dataclasses import replace

    from docmill.functions.expr import compile_expr

    lets = {"new": F.col("__s")}
    for k, v in let.items():
        spec = f"$__s.{v[1:]}" if isinstance(v, str) and v.startswith("$") and not v.startswith("$$") else v
        lets[k] = compile_expr(spec, Scope(both))
    flat = both.select("__t.*", *[v.alias(f"__let_{k}") for k, v in lets.items()])
    variables = {k: (F.col(f"__let_{k}"), flat.schema[f"__let_{k}"].dataType) for k in lets}
    out = run_pipeline(flat, pipeline, replace(ctx, variables={**ctx.variables, **variables}))
    return out.drop(*[f"__let_{k}" for k in lets])
