"""Accumulators of $group, $bucket and $setWindowFields.

Order-dependent accumulators take the order of the preceding $sort as explicit keys,
so that their results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.expr import compile_expr, nearest_rank
from docmill.functions.paths import Scope, UnsupportedOperator

#: Ordering of encounter: a list of (column, ascending).
Ordering = list[tuple[Column, bool]]
#: Grouped-aggregate pandas UDFs for ``$accumulator``, by name.
ACCUMULATORS: dict[str, Callable] = {}


def sorted_values(x: Column, ordering: Ordering) -> Column:
    """All values of a group, nulls kept, in encounter order."""
    if not ordering:
        return F.transform(F.collect_list(F.struct(x.alias("v"))), lambda e: e["v"])
    keys = [k.alias(f"k{i}") for i, (k, _) in enumerate(ordering)]
    rows = F.collect_list(F.struct(*keys, x.alias("v")))

    def before(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i, (_, up) in reversed(list(enumerate(ordering))):
            p, q = a[f"k{i}"], b[f"k{i}"]
            less, more = (-1, 1) if up else (1, -1)
            out = F.when(p.eqNullSafe(q), out).when(p.isNull(), less).when(q.isNull(), more).when(p < q, less).otherwise(more)
        return out

    return F.transform(F.array_sort(rows, before), lambda e: e["v"])


def _ends(x: Column, ordering: Ordering, last: bool) -> Column:
    if not ordering:
        return F.last(x) if last else F.first(x)
    if len({up for _, up in ordering}) == 1:
        key = F.struct(*[k.alias(f"k{i}") for i, (k, _) in enumerate(ordering)])
        pick = F.max_by if last == ordering[0][1] else F.min_by
        return pick(F.struct(x.alias("v")), key)["v"]
    values = sorted_values(F.struct(x.alias("v")), ordering)
    return (F.try_element_at(values, F.lit(-1)) if last else F.get(values, F.lit(0)))["v"]


def _numeric(x: Column, scope: Scope) -> Column:
    dtype = scope.type_of(x)
    return x if dtype is None or isinstance(dtype, T.NumericType) else x.try_cast("double")


def order_of(spec: dict, scope: Scope) -> Ordering:
    return [(compile_expr(f"${k}", scope), way == 1) for k, way in spec.items()]


def _top(arg: dict, scope: Scope, bottom: bool, many: bool) -> Column:
    out = arg["output"]
    value = F.array(*[compile_expr(o, scope) for o in out]) if isinstance(out, list) else compile_expr(out, scope)
    ordering = order_of(arg["sortBy"], scope)
    if not many:
        return _ends(value, ordering, bottom)
    values, n = sorted_values(value, ordering), compile_expr(arg["n"], scope)
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n) if bottom else F.slice(values, F.lit(1), n)


def _n(arg: dict, scope: Scope, name: str, ordering: Ordering) -> Column:
    x, n = compile_expr(arg["input"], scope), compile_expr(arg["n"], scope)
    if name in ("$minN", "$maxN"):
        return F.slice(F.sort_array(F.collect_list(x), asc=name == "$minN"), F.lit(1), n)
    values = sorted_values(x, ordering)
    return F.slice(values, F.lit(1), n) if name == "$firstN" else F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def _merge(x: Column, scope: Scope, ordering: Ordering) -> Column:
    dtype = scope.type_of(x)
    if isinstance(dtype, T.StructType):  # a later document's fields win where it has them
        last = lambda v: _ends_not_null(v, ordering)
        return F.struct(*[last(x.getField(n)).alias(n) for n in dtype.fieldNames()])
    entries = F.flatten(F.transform(sorted_values(x, ordering), lambda m: F.coalesce(F.map_entries(m), F.array().cast(T.ArrayType(T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)]))))))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.try_element_at(F.filter(entries, lambda e: e["key"] == k), F.lit(-1))))


def _ends_not_null(v: Column, ordering: Ordering) -> Column:
    values = F.array_compact(sorted_values(v, ordering))
    return F.try_element_at(values, F.lit(-1))


def accumulate(spec: dict, scope: Scope, ordering: Ordering) -> Column:
    """One accumulator document, ``{"$sum": "$x"}``, as an aggregate column."""
    (name, arg), *rest = spec.items()
    if rest:
        raise UnsupportedOperator("an accumulator document has one operator")
    if name == "$count":
        return F.count(F.lit(1))
    if name in ("$top", "$bottom", "$topN", "$bottomN"):
        return _top(arg, scope, "bottom" in name, name.endswith("N"))
    if name in ("$firstN", "$lastN", "$minN", "$maxN"):
        return _n(arg, scope, name, ordering)
    if name in ("$median", "$percentile"):
        x = compile_expr(arg["input"], scope)
        values = F.collect_list(x)
        if name == "$median":
            return nearest_rank(values, F.lit(0.5))
        return F.transform(F.array(*[F.lit(float(p)) for p in arg["p"]]), lambda p: nearest_rank(values, p))
    if name == "$accumulator":
        f = arg["function"] if callable(arg["function"]) else ACCUMULATORS[arg["function"]]
        return f(*[compile_expr(a, scope) for a in arg.get("args", [])])
    if isinstance(arg, int) and name == "$sum" and not isinstance(arg, bool):
        return F.count(F.lit(1)) * arg if arg != 1 else F.count(F.lit(1))
    x = compile_expr(arg, scope)
    if name == "$sum":
        return F.coalesce(F.sum(_numeric(x, scope)), F.lit(0))
    if name == "$avg":
        return F.avg(_numeric(x, scope))
    simple = {"$min": F.min, "$max": F.max, "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp}
    if name in simple:
        return simple[name](x)
    if name in ("$first", "$last"):
        return _ends(x, ordering, name == "$last")
    if name == "$push":
        return sorted_values(x, ordering)
    if name == "$addToSet":
        return F.array_sort(F.collect_set(x))
    if name == "$mergeObjects":
        return _merge(x, scope, ordering)
    raise UnsupportedOperator(f"unknown accumulator {name}")
