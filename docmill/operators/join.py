"""Joins: $lookup, $graphLookup and $unionWith."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.expr import compile_expr
from docmill.functions.paths import resolve, set_path
from docmill.functions.predicates import compile_filter
from docmill.operators.base import Context, run_pipeline, stage
from docmill.storage import materialize


def _document(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def _from(spec, ctx: Context) -> tuple[str, DataFrame]:
    name = spec["from"]
    name = f"{name['db']}.{name['coll']}" if isinstance(name, dict) else name
    return name, ctx.catalog[name]


@stage("lookup")
def lookup(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """Left-outer group join.  The foreign side is grouped by its key before the join,
    so each local row meets one row at most and Catalyst picks the join's kind."""
    name, foreign = _from(spec, ctx)
    if "pipeline" in spec and ("let" in spec or "localField" not in spec):
        return _lookup_pipeline(df, foreign, name, spec, ctx)
    if "pipeline" in spec:
        foreign_key = resolve(spec["foreignField"], ctx.scope(foreign))[0]
        foreign = run_pipeline(foreign.withColumn("__fk", foreign_key), spec["pipeline"], replace(ctx, collection=name))
        grouped = foreign.groupBy("__fk").agg(F.collect_list(_document(foreign.drop("__fk"))).alias("__as"))
    else:
        key, kind = resolve(spec["foreignField"], ctx.scope(foreign))
        keyed = foreign.select(key.alias("__fk"), _document(foreign).alias("__doc"))
        if isinstance(kind, T.ArrayType):
            keyed = keyed.select(F.explode_outer(F.array_distinct("__fk")).alias("__fk"), "__doc")
        grouped = keyed.groupBy("__fk").agg(F.collect_list("__doc").alias("__as"))
    local, kind = resolve(spec["localField"], ctx.scope(df))
    empty = F.array().cast(grouped.schema["__as"].dataType)
    if isinstance(kind, T.ArrayType):  # any element may match
        rows = df.withColumn("__row", F.monotonically_increasing_id())
        keys = rows.select("__row", F.explode(F.array_distinct(local)).alias("__lk"))
        found = keys.join(grouped, F.col("__lk").eqNullSafe(F.col("__fk"))).groupBy("__row").agg(F.array_distinct(F.flatten(F.collect_list("__as"))).alias("__as"))
        joined = rows.join(found, "__row", "left").drop("__row")
    else:
        joined = df.withColumn("__lk", local).join(grouped, F.col("__lk").eqNullSafe(F.col("__fk")), "left").drop("__lk", "__fk")
    return set_path(joined, spec["as"], F.coalesce("__as", empty)).drop("__as")


def _conjuncts(pipeline: list[dict]) -> list[dict]:
    """The leading $match's terms, split at its conjunctions."""
    if not pipeline or "$match" not in pipeline[0]:
        return []
    out = []
    for key, value in pipeline[0]["$match"].items():
        if key == "$expr" and isinstance(value, dict) and "$and" in value:
            out += [{"$expr": v} for v in value["$and"]]
        elif key == "$and":
            for v in value:
                out += _conjuncts([{"$match": v}])
        else:
            out.append({key: value})
    return out


def _mentions(spec, names: set[str]) -> bool:
    if isinstance(spec, str):
        return spec.startswith("$$") and spec[2:].split(".")[0] in names
    if isinstance(spec, dict):
        return any(_mentions(v, names) for v in spec.values())
    return any(_mentions(v, names) for v in spec) if isinstance(spec, (list, tuple)) else False


def _equality(term: dict, names: set[str]) -> tuple[str, object] | None:
    """(variable, foreign expression) of an equality between the two sides."""
    eq = term.get("$expr", {}).get("$eq") if isinstance(term.get("$expr"), dict) else None
    for mine, other in ((eq[0], eq[1]), (eq[1], eq[0])) if eq else ():
        if isinstance(mine, str) and _mentions(mine, names) and not _mentions(other, names):
            return mine, other
    return None


def _lookup_pipeline(df: DataFrame, foreign: DataFrame, name: str, spec: dict, ctx: Context) -> DataFrame:
    """Correlated sub-pipeline.  Equalities with $let variables become join keys; the
    other correlated terms of the leading $match a join condition; what follows must
    not need the outer row and runs per outer row where it orders or limits."""
    let = {k: compile_expr(v, ctx.scope(df)) for k, v in spec.get("let", {}).items()}
    names = set(let)
    inner = replace(ctx, collection=name, ordering=())
    pipeline = spec["pipeline"]
    if not names:
        found = run_pipeline(foreign, pipeline, inner)
        one = found.agg(F.collect_list(_document(found)).alias("__as"))
        return set_path(df.crossJoin(F.broadcast(one)), spec["as"], F.col("__as")).drop("__as")  # one row
    terms = _conjuncts(pipeline)
    free = [t for t in terms if not _mentions(t, names)]
    tied = [t for t in terms if _mentions(t, names)]
    for t in free:
        foreign = foreign.where(compile_filter(t, inner.scope(foreign)))
    rows = df.withColumn("__row", F.monotonically_increasing_id()).withColumns({f"__let_{k}": v for k, v in let.items()})
    outer = rows.select("__row", *[f"__let_{k}" for k in let]).alias("o")
    inside = foreign.select(*[F.col(f"`{c}`") for c in foreign.columns])
    scope = inner.scope(inside)
    for k in let:
        scope = scope.with_variable(k, F.col(f"__let_{k}"), rows.schema[f"__let_{k}"].dataType)
    keys = [(t, e) for t in tied if (e := _equality(t, names))]
    condition = F.lit(True)
    for _, (mine, other) in keys:
        condition = condition & compile_expr(mine, scope).eqNullSafe(compile_expr(other, scope))
    for t in tied:
        if not any(t is k for k, _ in keys):
            condition = condition & compile_filter(t, scope)
    joined = outer.join(inside, condition)
    rest = pipeline[1:] if pipeline and "$match" in pipeline[0] else pipeline
    joined = _per_row(joined, rest, list(foreign.columns), names, inner, rows)
    docs = [c for c in joined.columns if c != "__row" and not c.startswith("__let_")]
    grouped = joined.groupBy("__row").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in docs])).alias("__as"))
    out = rows.join(grouped, "__row", "left").drop("__row", *[f"__let_{k}" for k in let])
    return set_path(out, spec["as"], F.coalesce("__as", F.array().cast(grouped.schema["__as"].dataType))).drop("__as")


def _per_row(joined: DataFrame, pipeline: list[dict], columns: list[str], names: set[str], ctx: Context, rows: DataFrame) -> DataFrame:
    """The rest of a correlated pipeline: order, limit and grouping run within each
    outer row, everything else row by row."""
    from pyspark.sql import Window as W

    from docmill.operators.base import sort_columns
    from docmill.operators.group import _aggregates

    variables = {k: (F.col(f"__let_{k}"), rows.schema[f"__let_{k}"].dataType) for k in names}
    ctx = replace(ctx, variables={**ctx.variables, **variables})
    order: list[Column] = []
    for i, spec in enumerate(pipeline):
        (name, arg), = spec.items()
        lets = [c for c in joined.columns if c.startswith("__let_")]
        if name == "$sort":
            order = sort_columns(arg, ctx.scope(joined))
            ctx = replace(ctx, ordering=tuple(arg.items()))
        elif name in ("$limit", "$skip"):
            n = F.row_number().over(W.partitionBy("__row").orderBy(*(order or [F.lit(0)])))
            joined = joined.withColumn("__n", n).where(F.col("__n") <= arg if name == "$limit" else F.col("__n") > arg).drop("__n")
        elif name in ("$group", "$count"):
            key = [] if name == "$count" or arg["_id"] is None else [compile_expr(arg["_id"], ctx.scope(joined)).alias("_id")]
            output = {arg: {"$sum": 1}} if name == "$count" else {k: v for k, v in arg.items() if k != "_id"}
            joined = joined.groupBy("__row", *lets, *key).agg(*_aggregates(joined, output, ctx))
        elif name == "$project":
            from docmill.operators.base import STAGES

            keep = {c: 1 for c in ["__row", *lets]}
            excluding = all(v in (0, False) for v in arg.values() if not isinstance(v, (dict, str)))
            joined = STAGES[name](joined, arg if excluding and arg else {**arg, **keep}, ctx)
        elif name in ("$replaceRoot", "$replaceWith"):
            root = arg["newRoot"] if isinstance(arg, dict) and "newRoot" in arg else arg
            joined = joined.select("__row", *lets, compile_expr(root, ctx.scope(joined)).alias("__r")).select("__row", *lets, "__r.*")
        else:
            joined = run_pipeline(joined, [spec], ctx)
    return joined


@stage("unionWith")
def union_with(df: DataFrame, spec, ctx: Context) -> DataFrame:
    spec = {"coll": spec} if isinstance(spec, str) else spec
    other = ctx.catalog[spec["coll"]] if "coll" in spec else df.limit(0)
    if spec.get("pipeline"):
        other = run_pipeline(other, spec["pipeline"], replace(ctx, collection=spec.get("coll"), ordering=()))
    return df.unionByName(other, allowMissingColumns=True)


@stage("graphLookup")
def graph_lookup(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """Reachable documents by breadth-first search.

    Starts are distinct values, not rows, so a start that a third of the rows share is
    searched once.  Each hop joins the frontier with the edges and drops what was
    visited; the frontier is written to shared storage between hops.
    """
    _, foreign = _from(spec, ctx)
    if spec.get("restrictSearchWithMatch"):
        foreign = foreign.where(compile_filter(spec["restrictSearchWithMatch"], ctx.scope(foreign)))
    fscope = ctx.scope(foreign)
    to, (follow, kind) = resolve(spec["connectToField"], fscope)[0], resolve(spec["connectFromField"], fscope)
    follow = follow if isinstance(kind, T.ArrayType) else F.array(follow)
    nodes = foreign.select(to.alias("__to"), follow.alias("__next"), _document(foreign).alias("__doc")).withColumn("__id", F.xxhash64(F.to_json("__doc")))
    start, start_type = compile_expr(spec["startWith"], ctx.scope(df)), ctx.scope(df).type_of(compile_expr(spec["startWith"], ctx.scope(df)))
    starts = start if isinstance(start_type, T.ArrayType) else F.array(start)
    rows = df.withColumn("__start", starts)
    seeds = rows.select(F.explode("__start").alias("__root")).where("__root is not null").distinct()
    frontier = seeds.select("__root", F.col("__root").alias("__value"))
    most, depth = spec.get("maxDepth"), 0
    visited = None
    while most is None or depth <= most:
        hop = frontier.join(nodes, F.col("__value") == F.col("__to")).select("__root", "__id", "__next", "__doc").dropDuplicates(["__root", "__id"])
        if visited is not None:
            hop = hop.join(visited.select("__root", "__id"), ["__root", "__id"], "left_anti")
        hop = materialize(hop.withColumn("__depth", F.lit(depth).cast("bigint")), f"graph-{uuid.uuid4().hex[:8]}")
        if hop.isEmpty():
            break
        visited = hop if visited is None else visited.unionByName(hop)
        frontier = hop.select("__root", F.explode("__next").alias("__value")).where("__value is not null").distinct()
        depth += 1
    visited = hop if visited is None else visited
    document = F.col("__doc")
    if spec.get("depthField"):
        document = F.struct(*[F.col(f"__doc.`{c}`").alias(c) for c in foreign.columns], F.col("__depth").alias(spec["depthField"]))
    if isinstance(start_type, T.ArrayType):
        keyed = rows.withColumn("__row", F.monotonically_increasing_id())
        each = keyed.select("__row", F.explode("__start").alias("__root")).join(visited, "__root")
        best = each.groupBy("__row", "__id").agg(F.min_by(F.struct("__doc", "__depth"), "__depth").alias("b")).select("__row", "b.*")
        found = best.groupBy("__row").agg(F.collect_list(document).alias("__as"))
        joined = keyed.join(found, "__row", "left").drop("__row", "__start")
    else:
        found = visited.groupBy("__root").agg(F.collect_list(document).alias("__as"))
        joined = rows.withColumn("__root", F.get("__start", F.lit(0))).join(found, "__root", "left").drop("__root", "__start")
    return set_path(joined, spec["as"], F.coalesce("__as", F.array().cast(found.schema["__as"].dataType))).drop("__as")
