"""Compiler from filter documents to boolean columns.

A predicate on a missing field is false.  Below ``and`` and ``or`` a null does as well
as false, so comparisons stay plain there and reach the scan; only what is negated, and
what :func:`compile_match` gives to others, is made two-valued.  Predicates on arrays
match if any element matches.
"""

from __future__ import annotations

import datetime as dt
import math
import operator
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.expr import _flags, compile_expr, truthy, type_name
from docmill.functions.paths import Scope, UnsupportedOperator, literal, resolve

EARTH_KM = 6371.0


def compile_match(spec: dict, scope: Scope) -> Column:
    """A filter document as a column without nulls."""
    return _sure(compile_filter(spec, scope))


def compile_filter(spec: dict, scope: Scope) -> Column:
    """A filter document as a column for ``where``: null where it is not true."""
    out: Column | None = None
    for key, value in spec.items():
        term = _top(key, value, scope)
        out = term if out is None else out & term
    return F.lit(True) if out is None else out


def _top(key: str, value, scope: Scope) -> Column:
    if key in ("$and", "$or", "$nor"):
        terms = [compile_filter(v, scope) for v in value]
        out = terms[0]
        for t in terms[1:]:
            out = out & t if key == "$and" else out | t
        return ~_sure(out) if key == "$nor" else out
    if key == "$not":
        return ~compile_match(value, scope)
    if key == "$expr":
        return _expr(value, scope)
    if key == "$jsonSchema":
        from docmill.functions.json_schema import compile_schema

        return compile_schema(value, scope)
    if key in ("$text", "$textSearch"):
        fields = [f.name for f in scope.df.schema if isinstance(f.dataType, T.StringType)]
        spec = value if isinstance(value, dict) else {"$search": value}
        return text_search(F.concat_ws(" ", *[F.col(f"`{f}`") for f in spec.get("fields", fields)]), spec)
    if key == "$where":
        if not callable(value):
            raise UnsupportedOperator("$where takes a Python function on the scope's columns")
        return _sure(value(*[F.col(f"`{c}`") for c in scope.df.columns]))
    if key in ("$comment", "$natural"):
        return F.lit(True)
    if key.startswith("$"):
        raise UnsupportedOperator(f"unknown query operator {key}")
    column, dtype = resolve(key, scope)
    return _field(column, dtype, value, scope)


def _constant(spec) -> bool:
    return isinstance(spec, (bool, int, float, dt.date)) or (isinstance(spec, str) and not spec.startswith("$"))


def _expr(spec, scope: Scope) -> Column:
    """An expression as a filter.  Comparisons with a constant, in which null sorts
    before every value, reduce to plain ones that the scan can use."""
    if isinstance(spec, dict) and len(spec) == 1:
        (name, arg), = spec.items()
        if name == "$and" and isinstance(arg, (list, tuple)) and arg:
            return _fold_all([_expr(a, scope) for a in arg])
        if name in _PLAIN and isinstance(arg, (list, tuple)) and len(arg) == 2 and _constant(arg[0]) != _constant(arg[1]):
            if _constant(arg[0]):
                name, arg = _TURNED[name], (arg[1], arg[0])
            column = compile_expr(arg[0], scope)
            dtype = scope.type_of(column)
            if dtype is not None and _comparable(dtype, arg[1]):
                plain = _PLAIN[name](column, _as(dtype, arg[1]))
                return plain | column.isNull() if name in ("$lt", "$lte") else plain
    column = compile_expr(spec, scope)
    return truthy(column, scope.type_of(column))


_PLAIN = {"$eq": operator.eq, "$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}
_TURNED = {"$eq": "$eq", "$gt": "$lt", "$gte": "$lte", "$lt": "$gt", "$lte": "$gte"}


def field_predicate(column: Column, dtype: T.DataType | None, value, scope: Scope) -> Column:
    """All operators on one field, or equality with a value, without nulls."""
    return _sure(_field(column, dtype, value, scope))


def _field(column: Column, dtype: T.DataType | None, value, scope: Scope) -> Column:
    if not (isinstance(value, dict) and value and all(k.startswith("$") for k in value)):
        if isinstance(value, re.Pattern):
            value = {"$regex": value}
        else:
            return _equal(column, dtype, value)
    out: Column | None = None
    for name, arg in value.items():
        if name in IGNORED:
            continue
        if name not in PREDICATES:
            raise UnsupportedOperator(f"unknown query operator {name}")
        term = PREDICATES[name](column, dtype, arg, value, scope)
        out = term if out is None else out & term
    return F.lit(True) if out is None else out


def _sure(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def _any(column: Column, dtype: T.DataType | None, leaf: Callable[[Column, T.DataType | None], Column]) -> Column:
    """``leaf`` on a scalar, or on any element of an array (of arrays)."""
    if isinstance(dtype, T.ArrayType):
        return F.exists(column, lambda x: _any(x, dtype.elementType, leaf))
    return leaf(column, dtype)


def _as(dtype: T.DataType | None, value) -> Column:
    out = literal(value)
    return out.cast("timestamp_ntz") if isinstance(dtype, T.TimestampNTZType) and not isinstance(value, str) else out


def _comparable(dtype: T.DataType | None, value) -> bool:
    """Whether Spark can compare the types without a failing cast."""
    if dtype is None or isinstance(dtype, (T.NullType, T.VariantType)):
        return not isinstance(dtype, T.VariantType)
    if isinstance(value, bool):
        return isinstance(dtype, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(dtype, T.NumericType)
    if isinstance(value, str):
        return isinstance(dtype, T.StringType)
    return True


def _equal(column: Column, dtype: T.DataType | None, value) -> Column:
    if value is None:
        whole = column.isNull()
        return whole | _sure(F.exists(column, lambda x: x.isNull())) if isinstance(dtype, T.ArrayType) else whole
    if isinstance(dtype, T.VariantType):
        kind = {bool: "boolean", int: "bigint", float: "double", str: "string"}.get(type(value))
        return _sure(F.try_variant_get(column, "$", kind) == F.lit(value)) if kind else F.lit(False)
    if isinstance(dtype, T.ArrayType) and isinstance(value, (list, tuple)):
        return _sure(column == literal(value)) | _sure(F.exists(column, lambda x: _equal(x, dtype.elementType, value))) if isinstance(dtype.elementType, T.ArrayType) else _sure(column == literal(value))
    if isinstance(dtype, T.StructType) and isinstance(value, dict):
        same = F.lit(set(value) == set(dtype.fieldNames()))
        for k, v in value.items():
            same = same & (_equal(column.getField(k), dtype[k].dataType, v) if k in dtype.fieldNames() else F.lit(False))
        return _sure(same)
    leaf = lambda x, t: x == _as(t, value) if _comparable(t, value) else F.lit(False)
    return _any(column, dtype, leaf)


def _comparison(compare: Callable[[Column, Column], Column]) -> Callable:
    def run(column, dtype, arg, whole, scope):
        if arg is None:
            return F.lit(False)
        return _any(column, dtype, lambda x, t: compare(x, _as(t, arg)) if _comparable(t, arg) else F.lit(False))

    return run


def _in(column, dtype, arg, whole, scope) -> Column:
    if not isinstance(dtype, (T.ArrayType, T.StructType, T.VariantType)) and not any(isinstance(v, (re.Pattern, dict, list)) for v in arg):
        some = [v for v in arg if v is not None and _comparable(dtype, v)]
        found = column.isin(*[_as(dtype, v) for v in some]) if some else F.lit(False)
        return found | column.isNull() if None in arg else found
    out = F.lit(False)
    for v in arg:
        out = out | (PREDICATES["$regex"](column, dtype, v, {}, scope) if isinstance(v, re.Pattern) else _equal(column, dtype, v))
    return out


def _regex(column, dtype, arg, whole, scope) -> Column:
    if isinstance(arg, re.Pattern):
        flags = "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if arg.flags & bit)
        arg = _flags(flags) + arg.pattern
    pattern = _flags(whole.get("$options")) + arg
    return _any(column, dtype, lambda x, t: x.rlike(pattern) if isinstance(t, T.StringType) or t is None else F.lit(False))


# Numeric ids of the document type names.
TYPE_IDS = {1: "double", 2: "string", 3: "object", 4: "array", 5: "binData", 8: "bool", 9: "date", 10: "null", 16: "int", 18: "long", 19: "decimal"}


def _type(column, dtype, arg, whole, scope) -> Column:
    names = {TYPE_IDS.get(x, x) for x in (arg if isinstance(arg, (list, tuple)) else [arg])}
    if "number" in names:
        names |= {"int", "long", "double", "decimal"}
    here = type_name(dtype) in names
    if isinstance(dtype, T.ArrayType):
        return _sure(F.when(column.isNull(), "null" in names).otherwise(here) | F.exists(column, lambda x: _type(x, dtype.elementType, list(names), whole, scope)))
    return F.when(column.isNull(), F.lit("null" in names)).otherwise(F.lit(here))


def _all(column, dtype, arg, whole, scope) -> Column:
    out = F.lit(bool(arg))
    for v in arg:
        out = out & (field_predicate(column, dtype, v, scope) if isinstance(v, dict) and "$elemMatch" in v else _equal(column, dtype, v))
    return out


def _elem_match(column, dtype, arg, whole, scope) -> Column:
    if not isinstance(dtype, T.ArrayType):
        return F.lit(False)
    element = dtype.elementType

    def matches(x: Column) -> Column:
        if all(k.startswith("$") and k not in ("$and", "$or", "$nor") for k in arg):
            return field_predicate(x, element, arg, scope)
        return _match_document(x, element, arg, scope)

    return _sure(F.exists(column, matches))


def _match_document(x: Column, dtype: T.DataType, spec: dict, scope: Scope) -> Column:
    from docmill.functions.paths import _child

    out = F.lit(True)
    for key, value in spec.items():
        if key in ("$and", "$or", "$nor"):
            terms = [_match_document(x, dtype, v, scope) for v in value]
            term = terms[0]
            for t in terms[1:]:
                term = term & t if key == "$and" else term | t
            out = out & (~_sure(term) if key == "$nor" else term)
        else:
            column, kind = x, dtype
            for name in key.split("."):
                column, kind = _child(column, kind, name)
            out = out & field_predicate(column, kind, value, scope)
    return _sure(out)


def _mask(arg) -> int:
    if isinstance(arg, (list, tuple)):
        return sum(1 << b for b in arg)
    return int.from_bytes(arg, "little") if isinstance(arg, (bytes, bytearray)) else int(arg)


def _bits(test: Callable[[Column, int], Column]) -> Callable:
    return lambda column, dtype, arg, whole, scope: _any(column, dtype, lambda x, t: _sure(test(x.cast("bigint").bitwiseAND(F.lit(_mask(arg)).cast("bigint")), _mask(arg))) if isinstance(t, T.NumericType) else F.lit(False))


# -- geometry -----------------------------------------------------------------------
def point_of(column: Column, dtype: T.DataType | None) -> tuple[Column, Column]:
    """Longitude and latitude of a point document or of a coordinate pair."""
    at = column.getField("coordinates") if isinstance(dtype, T.StructType) else column
    return F.get(at, F.lit(0)).cast("double"), F.get(at, F.lit(1)).cast("double")


def haversine_km(x: Column, y: Column, lon: float, lat: float) -> Column:
    dx, dy = F.radians(F.lit(lon) - x), F.radians(F.lit(lat) - y)
    h = F.pow(F.sin(dy / 2), 2) + F.cos(F.radians(y)) * math.cos(math.radians(lat)) * F.pow(F.sin(dx / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _near(column, dtype, arg, whole, scope) -> Column:
    spec = arg if isinstance(arg, dict) else {"$geometry": {"coordinates": arg}}
    centre = spec.get("$geometry", spec).get("coordinates") if isinstance(spec.get("$geometry", spec), dict) else spec["$geometry"]
    distance = haversine_km(*point_of(column, dtype), *map(float, centre))
    out = distance.isNotNull()
    for key, keep in (("$maxDistance", lambda d, m: d <= m), ("$minDistance", lambda d, m: d >= m)):
        limit = spec.get(key, whole.get(key))
        if limit is not None:
            out = out & keep(distance, F.lit(float(limit)))
    return _sure(out)


def in_polygon(x: Column, y: Column, ring: list) -> Column:
    """Even-odd rule over the ring's edges, borders by the half-open rule."""
    ring = [tuple(map(float, p)) for p in ring]
    edges = zip(ring, ring[1:] + ring[:1], strict=True)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in edges:
        if y1 != y2:
            side = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + F.when(side, 1).otherwise(0)
    return crossings % 2 == 1


def _geo_within(column, dtype, arg, whole, scope) -> Column:
    x, y = point_of(column, dtype)
    if "$box" in arg:
        (x1, y1), (x2, y2) = arg["$box"]
        return _sure(x.between(float(min(x1, x2)), float(max(x1, x2))) & y.between(float(min(y1, y2)), float(max(y1, y2))))
    if "$center" in arg:
        (cx, cy), r = arg["$center"]
        return _sure(F.pow(x - cx, 2) + F.pow(y - cy, 2) <= float(r) ** 2)
    if "$centerSphere" in arg:
        (cx, cy), r = arg["$centerSphere"]
        return _sure(haversine_km(x, y, float(cx), float(cy)) <= float(r) * EARTH_KM)
    if "$polygon" in arg:
        return _sure(in_polygon(x, y, arg["$polygon"]))
    geometry = arg["$geometry"]
    polygons = [geometry["coordinates"]] if geometry["type"] == "Polygon" else geometry["coordinates"]
    out = F.lit(False)
    for outer, *holes in polygons:
        inside = in_polygon(x, y, outer)
        for hole in holes:
            inside = inside & ~in_polygon(x, y, hole)
        out = out | inside
    return _sure(out)


def _geo_intersects(column, dtype, arg, whole, scope) -> Column:
    from docmill.functions.geometry import intersects

    return _sure(intersects(arg["$geometry"])(F.to_json(column)))


# -- text -----------------------------------------------------------------------------
def text_search(column: Column, spec: dict) -> Column:
    """Every word and quoted phrase occurs, no word after a minus does."""
    search, sensitive = spec["$search"], spec.get("$caseSensitive", False)
    text = column if sensitive else F.lower(column)
    out = F.lit(True)
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', search if sensitive else search.lower()):
        found = F.contains(text, F.lit(phrase or word))
        out = out & (~found if minus else found)
    return _sure(out)


def _not(column, dtype, arg, whole, scope) -> Column:
    return ~field_predicate(column, dtype, {"$regex": arg} if isinstance(arg, re.Pattern) else arg, scope)


IGNORED = {"$comment", "$options", "$meta", "$slice", "$natural", "$maxDistance", "$minDistance"}
PREDICATES: dict[str, Callable[..., Column]] = {
    "$eq": lambda c, t, a, w, s: _equal(c, t, a),
    "$ne": lambda c, t, a, w, s: ~_sure(_equal(c, t, a)),
    "$gt": _comparison(lambda x, y: x > y),
    "$gte": _comparison(lambda x, y: x >= y),
    "$lt": _comparison(lambda x, y: x < y),
    "$lte": _comparison(lambda x, y: x <= y),
    "$in": _in,
    "$nin": lambda c, t, a, w, s: ~_sure(_in(c, t, a, w, s)),
    "$not": _not,
    "$and": lambda c, t, a, w, s: _fold_all([_field(c, t, x, s) for x in a]),
    "$exists": lambda c, t, a, w, s: c.isNotNull() if a else c.isNull(),
    "$type": _type,
    "$mod": lambda c, t, a, w, s: _any(c, t, lambda x, k: _sure(x.cast("bigint") % int(a[0]) == int(a[1])) if isinstance(k, T.NumericType) else F.lit(False)),
    "$regex": _regex,
    "$text": lambda c, t, a, w, s: text_search(c, a if isinstance(a, dict) else {"$search": a}),
    "$expr": lambda c, t, a, w, s: _top("$expr", a, s),
    "$all": _all,
    "$size": lambda c, t, a, w, s: _sure(F.size(c) == a) if isinstance(t, T.ArrayType) else F.lit(False),
    "$elemMatch": _elem_match,
    "$bitsAllSet": _bits(lambda v, m: v == m),
    "$bitsAnySet": _bits(lambda v, m: v != 0),
    "$bitsAllClear": _bits(lambda v, m: v == 0),
    "$bitsAnyClear": _bits(lambda v, m: v != m),
    "$near": _near,
    "$nearSphere": _near,
    "$geoWithin": _geo_within,
    "$within": _geo_within,
    "$geoIntersects": _geo_intersects,
}


def _fold_all(terms: list[Column]) -> Column:
    out = terms[0] if terms else F.lit(True)
    for t in terms[1:]:
        out = out & t
    return out


#: Collation strengths: 1 ignores case and accents, 2 ignores case.
COLLATIONS = {1: "UNICODE_CI_AI", 2: "UNICODE_CI", 3: "UNICODE", 4: "UNICODE", 5: "UNICODE"}


def collation_name(spec: dict) -> str:
    """Spark's collation for {locale, strength}; other settings are refused."""
    extra = {k for k, v in spec.items() if k in ("caseLevel", "numericOrdering", "backwards", "normalization", "maxVariable") and v} | ({"caseFirst"} if spec.get("caseFirst", "off") != "off" else set())
    if extra:
        raise UnsupportedOperator(f"collation settings {sorted(extra)}")
    name, locale = COLLATIONS[spec.get("strength", 3)], spec.get("locale", "")
    return name.replace("UNICODE", locale) if locale and locale not in ("simple", "en", "root") else name


def collated(df, spec: dict | None):
    """``df`` with its string columns under the collation, for matching and sorting."""
    if not spec:
        return df
    name = collation_name(spec)
    return df.withColumns({f.name: F.collate(F.col(f"`{f.name}`"), name) for f in df.schema if isinstance(f.dataType, T.StringType)})


