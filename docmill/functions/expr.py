"""Compiler from expression documents to Spark columns.

``{"$add": ["$a", 1]}`` becomes ``a + 1``: every operator is one entry of ``OPS``,
a function of its argument and a :class:`Compiler`.  Only built-in functions are
used, so expressions stay inside generated code; registered Python functions
(``$function``) are the one exception.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.paths import Scope, UnsupportedOperator, literal, resolve, resolve_variable

OPS: dict[str, Callable] = {}
#: Python functions for ``$function``, by name: (function on columns or a UDF).
FUNCTIONS: dict[str, Callable] = {}


def op(*names: str):
    def register(f: Callable) -> Callable:
        for name in names:
            OPS[f"${name}"] = f
        return f

    return register


class Compiler:
    """Compiles expressions within one scope."""

    def __init__(self, scope: Scope):
        self.scope = scope

    def __call__(self, spec) -> Column:
        return self.typed(spec)[0]

    def typed(self, spec) -> tuple[Column, T.DataType | None]:
        if isinstance(spec, Column):
            return spec, self.scope.type_of(spec)
        if isinstance(spec, str) and spec.startswith("$$"):
            return resolve_variable(spec[2:], self.scope)
        if isinstance(spec, str) and spec.startswith("$"):
            return resolve(spec[1:], self.scope)
        if isinstance(spec, (list, tuple)):
            column = F.array(*[self(x) for x in spec])
            return column, self.scope.type_of(column)
        if isinstance(spec, dict):
            if len(spec) == 1 and next(iter(spec)).startswith("$"):
                name, arg = next(iter(spec.items()))
                if name not in OPS:
                    raise UnsupportedOperator(f"unknown expression {name}")
                column = OPS[name](arg, self)
            else:
                column = F.struct(*[self(v).alias(k) for k, v in spec.items()])
            return column, self.scope.type_of(column)
        column = literal(spec)
        return column, self.scope.type_of(column)

    def type_of(self, spec) -> T.DataType | None:
        return self.typed(spec)[1]

    def args(self, arg) -> list[Column]:
        return [self(x) for x in (arg if isinstance(arg, (list, tuple)) else [arg])]

    def one(self, arg) -> Column:
        return self(arg[0] if isinstance(arg, (list, tuple)) and len(arg) == 1 else arg)

    def inside(self, **variables) -> Compiler:
        scope = self.scope
        for name, (column, dtype) in variables.items():
            scope = scope.with_variable(name, column, dtype)
        return Compiler(scope)

    def element(self, spec) -> T.DataType | None:
        dtype = self.type_of(spec)
        return dtype.elementType if isinstance(dtype, T.ArrayType) else None


def compile_expr(spec, scope: Scope) -> Column:
    return Compiler(scope)(spec)


def truthy(c: Column, dtype: T.DataType | None) -> Column:
    """null, false and 0 are false; everything else is true."""
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull() if dtype is not None else F.coalesce(c.cast("boolean"), F.lit(False))


def _truth(spec, c: Compiler) -> Column:
    return truthy(*c.typed(spec))


# -- literals and control ---------------------------------------------------------
@op("literal")
def _(a, c):
    return literal(a)


for _name in ("intExpr", "doubleExpr", "string", "bool", "date"):
    OPS[f"${_name}"] = lambda a, c: literal(a)
OPS["$nullExpr"] = lambda a, c: F.lit(None)
OPS["$now"] = lambda a, c: F.current_timestamp()
OPS["$arrayExpr"] = lambda a, c: F.array(*c.args(a))
OPS["$mapExpr"] = lambda a, c: F.struct(*[c(v).alias(k) for k, v in a.items()])
OPS["$doc"] = lambda a, c: literal(a)
OPS["$field"] = lambda a, c: c("$" + a.lstrip("$"))
OPS["$parse"] = lambda a, c: c(a)
OPS["$expr"] = lambda a, c: c(a)
OPS["$rand"] = lambda a, c: F.rand()
OPS["$sampleRate"] = lambda a, c: F.rand() < c(a)


@op("match")
def _(a, c):
    from docmill.functions.predicates import compile_match

    return compile_match(a, c.scope)


@op("project")
def _(a, c):
    return F.struct(*[c(f"${k}" if v in (1, True) else v).alias(k) for k, v in a.items()])


@op("let")
def _(a, c):
    return c.inside(**{k: c.typed(v) for k, v in a["vars"].items()})(a["in"])


@op("cond")
def _(a, c):
    test, yes, no = (a["if"], a["then"], a["else"]) if isinstance(a, dict) else a
    return F.when(_truth(test, c), c(yes)).otherwise(c(no))


@op("ifNull")
def _(a, c):
    return F.coalesce(*c.args(a))


@op("switch")
def _(a, c):
    out = None
    for b in a["branches"]:
        out = (F if out is None else out).when(_truth(b["case"], c), c(b["then"]))
    return out.otherwise(c(a["default"])) if "default" in a else out


@op("function")
def _(a, c):
    body = a["body"]
    f = body if callable(body) else FUNCTIONS.get(body)
    if f is None:
        raise UnsupportedOperator(f"$function: {body!r} is not a registered Python function")
    return f(*c.args(a.get("args", [])))


@op("meta", "accumulator", "addToSet", "push")
def _(a, c):
    raise UnsupportedOperator("this operator has no value outside $group, $setWindowFields or text search")


# -- boolean and comparison -------------------------------------------------------
@op("and")
def _(a, c):
    out = F.lit(True)
    for x in a if isinstance(a, (list, tuple)) else [a]:
        out = out & _truth(x, c)
    return out


@op("or")
def _(a, c):
    out = F.lit(False)
    for x in a if isinstance(a, (list, tuple)) else [a]:
        out = out | _truth(x, c)
    return out


@op("not")
def _(a, c):
    return ~_truth(a[0] if isinstance(a, (list, tuple)) else a, c)


def _order(a: Column, b: Column, least: Column, equal: Column, more: Column) -> Column:
    """Comparison in which null sorts before every value."""
    return F.when(a.eqNullSafe(b), equal).when(a.isNull(), least).when(b.isNull(), more).when(a < b, least).otherwise(more)


def _compare(name: str, least: bool, equal: bool, more: bool) -> None:
    @op(name)
    def _(a, c):
        x, y = c.args(a)
        return _order(x, y, F.lit(least), F.lit(equal), F.lit(more))


for _spec in (("gt", False, False, True), ("gte", False, True, True), ("lt", True, False, False), ("lte", True, True, False)):
    _compare(*_spec)
OPS["$cmp"] = lambda a, c: _order(*c.args(a), F.lit(-1), F.lit(0), F.lit(1))
OPS["$eq"] = lambda a, c: (lambda x, y: x.eqNullSafe(y))(*c.args(a))
OPS["$ne"] = lambda a, c: ~(lambda x, y: x.eqNullSafe(y))(*c.args(a))
OPS["$in"] = lambda a, c: (lambda x, y: F.exists(y, lambda e: e.eqNullSafe(x)))(*c.args(a))

# -- arithmetic -------------------------------------------------------------------
_DATES = (T.TimestampType, T.TimestampNTZType, T.DateType)


@op("add")
def _(a, c):
    typed = [c.typed(x) for x in (a if isinstance(a, (list, tuple)) else [a])]
    dates = [x for x, t in typed if isinstance(t, _DATES)]
    numbers = [x for x, t in typed if not isinstance(t, _DATES)]
    total = numbers[0] if numbers else F.lit(0)
    for x in numbers[1:]:
        total = total + x
    return dates[0] + F.make_dt_interval(secs=(total / 1000).cast("decimal(18,6)")) if dates else total


@op("subtract")
def _(a, c):
    (x, tx), (y, ty) = (c.typed(v) for v in a)
    if isinstance(tx, _DATES) and isinstance(ty, _DATES):
        return (F.unix_micros(x.cast("timestamp")) - F.unix_micros(y.cast("timestamp"))) / 1000
    if isinstance(tx, _DATES):
        return x - F.make_dt_interval(secs=(y / 1000).cast("decimal(18,6)"))
    return x - y


@op("multiply")
def _(a, c):
    first, *rest = c.args(a)
    for x in rest:
        first = first * x
    return first


def _trunc(x: Column, place: Column) -> Column:
    scale = F.pow(F.lit(10.0), place)
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)) / scale


def _round(a, c):
    x, place = (a[0], a[1] if len(a) > 1 else 0) if isinstance(a, (list, tuple)) else (a, 0)
    if not isinstance(place, int):
        raise UnsupportedOperator("$round takes a constant place")
    return F.bround(c(x), place)


OPS["$divide"] = lambda a, c: (lambda x, y: F.try_divide(x.cast("double"), y.cast("double")))(*c.args(a))
OPS["$mod"] = lambda a, c: (lambda x, y: F.try_mod(x, y))(*c.args(a))
OPS["$pow"] = lambda a, c: F.pow(*c.args(a))
OPS["$log"] = lambda a, c: (lambda x, b: F.ln(x) / F.ln(b))(*c.args(a))
OPS["$round"] = _round
OPS["$trunc"] = lambda a, c: _trunc(c(a[0]), c(a[1] if len(a) > 1 else 0)) if isinstance(a, (list, tuple)) else _trunc(c(a), F.lit(0))
OPS["$atan2"] = lambda a, c: F.atan2(*c.args(a))
OPS["$ln"] = lambda a, c: F.ln(c.one(a))
for _name in "abs exp log10 sqrt ceil floor sin cos tan asin acos atan sinh cosh tanh asinh acosh atanh".split():
    OPS[f"${_name}"] = lambda a, c, f=getattr(F, _name): f(c.one(a))
OPS["$degreesToRadians"] = OPS["$degreesToRadian"] = lambda a, c: F.radians(c.one(a))
OPS["$radiansToDegrees"] = lambda a, c: F.degrees(c.one(a))


# -- arrays -----------------------------------------------------------------------
def _at(arr: Column, i: Column) -> Column:
    return F.get(arr, F.when(i < 0, F.size(arr) + i).otherwise(i).cast("int"))


def _rename(a, c, default: str = "this") -> tuple:
    """(array, its element type, name of the element) of $map and $filter."""
    array = a["input"]
    return c(array), c.element(array), a.get("as", default)


@op("filter")
def _(a, c):
    array, dtype, name = _rename(a, c)
    kept = F.filter(array, lambda x: _truth(a["cond"], c.inside(**{name: (x, dtype)})))
    return F.slice(kept, F.lit(1), c(a["limit"])) if a.get("limit") is not None else kept


@op("map")
def _(a, c):
    array, dtype, name = _rename(a, c)
    return F.transform(array, lambda x: c.inside(**{name: (x, dtype)})(a["in"]))


@op("reduce")
def _(a, c):
    dtype, start = c.element(a["input"]), c.typed(a["initialValue"])
    step = lambda acc, x: c.inside(value=(acc, start[1]), this=(x, dtype))(a["in"])
    init, kind = start
    if isinstance(kind, T.IntegralType) and isinstance(dtype, (T.DoubleType, T.FloatType)):
        init = init.cast("double")
    elif isinstance(kind, T.IntegerType) and isinstance(dtype, T.LongType):
        init = init.cast("bigint")
    return F.aggregate(c(a["input"]), init, step)


@op("slice")
def _(a, c):
    arr, *rest = c.args(a)
    if len(rest) == 1:
        n = rest[0]
        return F.when(n >= 0, F.slice(arr, F.lit(1), F.greatest(n, F.lit(0)))).otherwise(F.slice(arr, F.greatest(F.size(arr) + n + 1, F.lit(1)), F.abs(n)))
    pos, n = rest
    start = F.when(pos < 0, F.greatest(F.size(arr) + pos, F.lit(0))).otherwise(pos) + 1
    return F.slice(arr, start, n)


@op("sortArray")
def _(a, c):
    arr, by = c(a["input"]), a["sortBy"]
    if by in (1, -1):
        return F.sort_array(arr, asc=by == 1)
    dtype = c.element(a["input"])

    def before(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for path, way in reversed(by.items()):
            p, q = (c.inside(e=(v, dtype))(f"$$e.{path}") for v in (x, y))
            less, more = (-1, 1) if way == 1 else (1, -1)
            out = F.when(p.eqNullSafe(q), out).when(p.isNull(), less).when(q.isNull(), more).when(p < q, less).otherwise(more)
        return out

    return F.array_sort(arr, before)


@op("indexOfArray")
def _(a, c):
    arr, value, *bounds = c.args(a)
    start = bounds[0] if bounds else F.lit(0)
    part = F.slice(arr, start + 1, (bounds[1] - start) if len(bounds) > 1 else F.greatest(F.size(arr) - start, F.lit(0)))
    at = F.array_position(part, value)
    return F.when(arr.isNull(), None).when(at > 0, at - 1 + start).otherwise(F.lit(-1)).cast("int")


@op("range")
def _(a, c):
    start, end, *step = c.args(a)
    step = step[0] if step else F.lit(1)
    some = ((step > 0) & (start < end)) | ((step < 0) & (start > end))
    last = end - F.signum(step).cast("int")
    return F.when(some, F.sequence(start, F.when(some, last).otherwise(start), F.when(some, step).otherwise(1))).otherwise(F.array().cast("array<int>"))


@op("zip")
def _(a, c):
    arrays = [c(x) for x in a["inputs"]]
    sizes = [F.size(x) for x in arrays]
    longest = a.get("useLongestLength", False)
    n = sizes[0] if len(sizes) == 1 else (F.greatest if longest else F.least)(*sizes)
    fill = [c(x) for x in a.get("defaults", [None] * len(arrays))]
    row = lambda i: F.array(*[F.when(i < s, F.get(x, i)).otherwise(d) for x, s, d in zip(arrays, sizes, fill, strict=True)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), row)).otherwise(F.slice(F.array(F.array(*fill)), 1, 0))


@op("arrayToObject")
def _(a, c):
    if isinstance(a, (list, tuple)) and len(a) == 1 and isinstance(c.element(a), T.ArrayType) and isinstance(c.element(a).elementType, (T.ArrayType, T.StructType)):
        a = a[0]  # an argument list of one literal array
    dtype = c.element(a)
    if isinstance(dtype, T.ArrayType):
        return F.map_from_arrays(F.transform(c(a), lambda e: F.get(e, F.lit(0)).cast("string")), F.transform(c(a), lambda e: F.get(e, F.lit(1))))
    return F.map_from_entries(c(a))


@op("objectToArray")
def _(a, c):
    column, dtype = c.typed(a)
    if isinstance(dtype, T.MapType):
        return F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    return F.array(*[F.struct(F.lit(f.name).alias("k"), column.getField(f.name).alias("v")) for f in dtype.fields])


def _n_of(pick: Callable) -> Callable:
    return lambda a, c: pick(c(a["input"]), c(a["n"]))


OPS["$arrayElemAt"] = lambda a, c: _at(*c.args(a))
OPS["$concatArrays"] = lambda a, c: F.concat(*c.args(a))
OPS["$first"] = lambda a, c: F.get(c.one(a), F.lit(0))
OPS["$last"] = lambda a, c: F.try_element_at(c.one(a), F.lit(-1))
OPS["$isArray"] = lambda a, c: F.lit(isinstance(c.type_of(a[0] if isinstance(a, list) else a), T.ArrayType))
OPS["$reverseArray"] = lambda a, c: F.reverse(c.one(a))
OPS["$size"] = lambda a, c: F.size(c.one(a))
OPS["$firstN"] = _n_of(lambda x, n: F.slice(x, F.lit(1), n))
OPS["$lastN"] = _n_of(lambda x, n: F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), n))
OPS["$maxN"] = _n_of(lambda x, n: F.slice(F.sort_array(F.array_compact(x), asc=False), F.lit(1), n))
OPS["$minN"] = _n_of(lambda x, n: F.slice(F.sort_array(F.array_compact(x)), F.lit(1), n))


# -- sets -------------------------------------------------------------------------
def _fold(f: Callable) -> Callable:
    def run(a, c):
        first, *rest = c.args(a)
        for x in rest:
            first = f(first, x)
        return first

    return run


def _set_equals(a, c):
    first, *rest = c.args(a)
    out = F.lit(True)
    for x in rest:
        out = out & (F.size(F.array_except(first, x)) == 0) & (F.size(F.array_except(x, first)) == 0)
    return out


def _elements(a, c) -> tuple[Column, T.DataType | None]:
    spec = a[0] if isinstance(a, list) and len(a) == 1 else a
    return c(spec), c.element(spec)


OPS["$setUnion"], OPS["$setIntersection"] = _fold(F.array_union), _fold(F.array_intersect)
OPS["$setDifference"] = _fold(F.array_except)
OPS["$setEquals"] = _set_equals
OPS["$setIsSubset"] = lambda a, c: (lambda x, y: F.size(F.array_except(x, y)) == 0)(*c.args(a))
OPS["$allElementsTrue"] = lambda a, c: (lambda x, t: F.forall(x, lambda e: truthy(e, t)))(*_elements(a, c))
OPS["$anyElementTrue"] = lambda a, c: (lambda x, t: F.exists(x, lambda e: truthy(e, t)))(*_elements(a, c))


# -- strings ----------------------------------------------------------------------
def _index(unit: Callable) -> Callable:
    """Index of a substring, counted by ``unit`` (characters or bytes)."""

    def run(a, c):
        s, sub, *bounds = c.args(a)
        start = bounds[0] if bounds else F.lit(0)
        # A byte start lies behind the characters that end before it.
        first = start if unit is F.char_length else F.char_length(F.decode(F.substring(F.encode(s, "UTF-8"), F.lit(1), start), "UTF-8"))
        found = F.call_function("locate", sub, s, (first + 1).cast("int"))
        pos = unit(F.substring(s, F.lit(1), found - 1)).cast("int")
        inside = found > 0
        if len(bounds) > 1:
            inside = inside & (pos + unit(sub) <= bounds[1])
        return F.when(s.isNull(), None).when(inside, pos).otherwise(F.lit(-1))

    return run


def _flags(options: str | None) -> str:
    return f"(?{''.join(x for x in options or '' if x in 'imsx')})" if options else ""


def regex_of(a) -> str:
    pattern = a["regex"]
    return _flags(a.get("options")) + (pattern.pattern if isinstance(pattern, re.Pattern) else pattern)


def _groups(pattern: str) -> int:
    return re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern)).groups


def _regex_find(a, c):
    s, pattern = c(a["input"]), regex_of(a)
    p = F.lit(pattern)
    captures = F.array(*[F.nullif(F.regexp_extract(s, pattern, i), F.lit("")) for i in range(1, _groups(pattern) + 1)]) if _groups(pattern) else F.array().cast("array<string>")
    return F.when(F.rlike(s, p), F.struct(F.regexp_extract(s, pattern, 0).alias("match"), (F.regexp_instr(s, p) - 1).alias("idx"), captures.alias("captures")))


def _trim(f: Callable) -> Callable:
    def run(a, c):
        a = a if isinstance(a, dict) else {"input": a}
        return f(c(a["input"]), c(a["chars"])) if a.get("chars") is not None else f(c(a["input"]), F.lit(" \t\n\x0b\x0c\r\0"))

    return run


def _replace_one(a, c):
    s, find, new = c(a["input"]), c(a["find"]), c(a["replacement"])
    at = F.instr(s, find)
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), new, F.substring(s, at + F.char_length(find), F.char_length(s)))).otherwise(s)


def _strcasecmp(a, c):
    x, y = (F.lower(v) for v in c.args(a))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


OPS["$concat"] = lambda a, c: F.concat(*c.args(a))
OPS["$indexOfBytes"], OPS["$indexOfCP"] = _index(F.octet_length), _index(F.char_length)
OPS["$ltrim"], OPS["$rtrim"], OPS["$trim"] = _trim(F.ltrim), _trim(F.rtrim), _trim(F.btrim)
OPS["$regex"] = lambda a, c: literal(regex_of(a) if isinstance(a, dict) else a)
OPS["$regexFind"] = _regex_find
OPS["$regexFindAll"] = lambda a, c: F.regexp_extract_all(c(a["input"]), F.lit(regex_of(a)), F.lit(0))
OPS["$regexMatch"] = lambda a, c: F.coalesce(F.rlike(c(a["input"]), F.lit(regex_of(a))), F.lit(False))
OPS["$replaceOne"] = _replace_one
OPS["$replaceAll"] = lambda a, c: F.replace(c(a["input"]), c(a["find"]), c(a["replacement"]))
OPS["$split"] = lambda a, c: (lambda s, d: F.split(s, F.concat(F.lit(r"\Q"), d, F.lit(r"\E")), -1))(*c.args(a))
OPS["$strLenBytes"] = lambda a, c: F.octet_length(c.one(a))
OPS["$strLenCP"] = lambda a, c: F.char_length(c.one(a))
OPS["$strcasecmp"] = _strcasecmp
OPS["$substr"] = OPS["$substrCP"] = lambda a, c: (lambda s, i, n: F.substring(s, i + 1, F.when(n < 0, F.char_length(s)).otherwise(n).cast("int")))(*c.args(a))
OPS["$substrBytes"] = lambda a, c: (lambda s, i, n: F.decode(F.substring(F.encode(s, "UTF-8"), i + 1, n), "UTF-8"))(*c.args(a))
OPS["$toLower"], OPS["$toUpper"] = lambda a, c: F.lower(c.one(a)), lambda a, c: F.upper(c.one(a))


# -- dates ------------------------------------------------------------------------
_UNITS = {"year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond"}
_WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def _unit(name: str) -> str:
    name = name.lower().removesuffix("s")
    if name not in _UNITS:
        raise UnsupportedOperator(f"unknown time unit {name}")
    return name


def _local(column: Column, timezone: str | None) -> Column:
    """A timestamp as wall-clock time; without a zone it is UTC wall-clock already."""
    return F.convert_timezone(F.lit("UTC"), F.lit(timezone), column.cast("timestamp_ntz")) if timezone else column


def _dateadd(column: Column, unit: str, n: Column) -> Column:
    return F.timestamp_add(_unit(unit).upper(), n.cast("int"), column)


def _truncated(column: Column, unit: str, start: str = "sunday") -> Column:
    """``column`` cut to the start of its unit, as wall-clock time."""
    unit = _unit(unit)
    if unit == "millisecond":
        return F.date_trunc("millisecond", column).cast("timestamp_ntz")
    if unit == "week":  # Spark's weeks start on Monday
        shift = _WEEKDAYS.index(start.lower() if len(start) > 3 else next(d for d in _WEEKDAYS if d.startswith(start.lower())))
        moved = F.timestamp_add("DAY", F.lit(-shift), column)
        return F.timestamp_add("DAY", F.lit(shift), F.date_trunc("week", moved).cast("timestamp_ntz"))
    return F.date_trunc(unit, column).cast("timestamp_ntz")


@op("dateTrunc")
def _(a, c):
    column, unit, size = _local(c(a["date"]), a.get("timezone")), _unit(a["unit"]), a.get("binSize", 1)
    start = a.get("startOfWeek", "sunday")
    if size == 1:
        return _truncated(column, unit, start)
    # Bins are counted from 2000-01-01, or from its first week's start.
    origin = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    if unit == "week":
        origin = _truncated(F.timestamp_add("DAY", F.lit(6), origin), "week", start)
    span = F.timestamp_diff(unit.upper(), origin, _truncated(column, unit, start))
    return _dateadd(origin, unit, F.floor(span / size) * size)


@op("dateDiff")
def _(a, c):
    start, end = (_truncated(_local(c(a[k]), a.get("timezone")), a["unit"], a.get("startOfWeek", "sunday")) for k in ("startDate", "endDate"))
    return F.timestamp_diff(_unit(a["unit"]).upper(), start, end)


OPS["$dateAdd"] = lambda a, c: _dateadd(c(a["startDate"]), a["unit"], c(a["amount"]))
OPS["$dateSubtract"] = lambda a, c: _dateadd(c(a["startDate"]), a["unit"], -c(a["amount"]))


@op("dateFromParts")
def _(a, c):
    if "isoWeekYear" in a:
        return OPS["$isoDateFromParts"](a, c)
    part = lambda k, d: c(a.get(k, d)).cast("int")
    out = F.make_timestamp_ntz(part("year", 1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    for k, unit, d in (("month", "MONTH", 1), ("day", "DAY", 1), ("hour", "HOUR", 0), ("minute", "MINUTE", 0), ("second", "SECOND", 0), ("millisecond", "MILLISECOND", 0)):
        out = F.timestamp_add(unit, part(k, d) - d, out)
    return out


@op("isoDateFromParts")
def _(a, c):
    part = lambda k, d: c(a.get(k, d)).cast("int")
    fourth = F.make_timestamp_ntz(part("isoWeekYear", 1970), F.lit(1), F.lit(4), F.lit(0), F.lit(0), F.lit(0))
    out = F.timestamp_add("DAY", (part("isoWeek", 1) - 1) * 7 + part("isoDayOfWeek", 1) - 1, F.date_trunc("week", fourth).cast("timestamp_ntz"))
    for k, unit in (("hour", "HOUR"), ("minute", "MINUTE"), ("second", "SECOND"), ("millisecond", "MILLISECOND")):
        out = F.timestamp_add(unit, part(k, 0), out)
    return out


# Strftime-like specifiers and their pattern letters.
_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%L": "SSS", "%j": "DDD", "%z": "xx", "%b": "MMM", "%B": "MMMM", "%%": "'%'"}


def _pattern(fmt: str) -> str:
    pieces = re.split(r"(%.)", fmt)
    for p in pieces:
        if re.fullmatch("%.", p) and p not in _FORMATS:
            raise UnsupportedOperator(f"date format {p}")
    return "".join(_FORMATS[p] if p in _FORMATS else re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", p) for p in pieces)


@op("dateToString")
def _(a, c):
    text = F.date_format(_local(c(a["date"]), a.get("timezone")), _pattern(a.get("format", "%Y-%m-%dT%H:%M:%S.%LZ")))
    return F.coalesce(text, c(a["onNull"])) if "onNull" in a else text


@op("dateFromString")
def _(a, c):
    s = c(a["dateString"])
    parsed = F.try_to_timestamp(s, F.lit(_pattern(a["format"]))) if "format" in a else F.try_to_timestamp(s)
    if a.get("timezone"):
        parsed = F.to_utc_timestamp(parsed, a["timezone"])
    parsed = parsed.cast("timestamp_ntz")
    if "onError" in a:
        parsed = F.when(s.isNotNull(), F.coalesce(parsed, c(a["onError"])))
    return F.coalesce(parsed, c(a["onNull"])) if "onNull" in a else parsed


def _date(f: Callable) -> Callable:
    def run(a, c):
        if isinstance(a, dict) and "date" in a:
            return f(_local(c(a["date"]), a.get("timezone")))
        return f(c.one(a))

    return run


def _millis(d: Column) -> Column:
    return (F.date_part(F.lit("SECOND"), d) * 1000 % 1000).cast("int")


_DATE_PARTS = {
    "year": F.year, "month": F.month, "dayOfMonth": F.dayofmonth, "dayOfWeek": F.dayofweek, "dayOfYear": F.dayofyear, "hour": F.hour, "minute": F.minute, "second": F.second,
    "millisecond": _millis, "isoDayOfWeek": lambda d: F.weekday(d) + 1, "isoWeek": F.weekofyear, "isoWeekYear": lambda d: F.date_part(F.lit("YEAROFWEEK"), d).cast("int"),
    "week": lambda d: F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int"),
}
for _name, _f in _DATE_PARTS.items():
    OPS[f"${_name}"] = _date(_f)


@op("dateToParts")
def _(a, c):
    d = _local(c(a["date"]), a.get("timezone"))
    days = (("isoWeekYear", "isoWeekYear"), ("isoWeek", "isoWeek"), ("isoDayOfWeek", "isoDayOfWeek")) if a.get("iso8601") else (("year", "year"), ("month", "month"), ("day", "dayOfMonth"))
    return F.struct(*[_DATE_PARTS[p](d).alias(n) for n, p in (*days, ("hour", "hour"), ("minute", "minute"), ("second", "second"), ("millisecond", "millisecond"))])


@op("toDate")
def _(a, c):
    column, dtype = c.typed(a)
    if isinstance(dtype, T.NumericType):
        return F.timestamp_millis(column.cast("bigint")).cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):  # an object id starts with its creation second
        oid = F.timestamp_seconds(F.conv(F.substring(column, 1, 8), 16, 10).cast("bigint")).cast("timestamp_ntz")
        return F.when(column.rlike("^[0-9a-f]{24}$"), oid).otherwise(F.try_to_timestamp(column).cast("timestamp_ntz"))
    return column.cast("timestamp_ntz")


# -- objects and types ------------------------------------------------------------
@op("mergeObjects")
def _(a, c):
    typed = [c.typed(x) for x in (a if isinstance(a, (list, tuple)) else [a])]
    typed = [(x, t) for x, t in typed if not isinstance(t, T.NullType)]
    if all(isinstance(t, T.MapType) for _, t in typed):
        out = typed[0][0]
        for x, _ in typed[1:]:  # later entries win
            out = _map_merge(out, x)
        return out
    fields: dict[str, Column] = {}
    for x, t in typed:
        for f in t.fields:
            here = x.getField(f.name)
            fields[f.name] = F.when(x.isNotNull(), here).otherwise(fields[f.name]) if f.name in fields else here
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _map_merge(x: Column, y: Column) -> Column:
    """Entries of y, and those of x whose keys y lacks; null counts as empty."""
    keys = F.coalesce(F.map_keys(y), F.array().cast("array<string>"))
    old = F.filter(F.map_entries(x), lambda e: ~F.array_contains(keys, e["key"]))
    return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.map_from_entries(F.concat(old, F.map_entries(y))))


# Type names of documents and their Spark casts.
CASTS = {"double": "double", "string": "string", "bool": "boolean", "date": "timestamp_ntz", "int": "int", "long": "bigint", "decimal": "decimal(38,18)", "objectId": "string", 1: "double", 2: "string", 7: "string", 8: "boolean", 9: "timestamp_ntz", 16: "int", 18: "bigint", 19: "decimal(38,18)"}


def _cast(column: Column, dtype: T.DataType | None, to: str) -> Column:
    if to in ("int", "bigint") and isinstance(dtype, T.FractionalType):
        return F.when(column < 0, F.ceil(column)).otherwise(F.floor(column)).try_cast(to)
    if to == "boolean" and isinstance(dtype, T.StringType):
        return F.when(column.isNotNull(), F.lit(True))
    if to == "bigint" and isinstance(dtype, _DATES):
        return F.unix_millis(column.cast("timestamp"))
    return column.try_cast(to)


def _convert(to: str) -> Callable:
    return lambda a, c: _cast(*c.typed(a[0] if isinstance(a, (list, tuple)) else a), to)


@op("convert")
def _(a, c):
    to = a["to"]["type"] if isinstance(a["to"], dict) else a["to"]
    column, dtype = c.typed(a["input"])
    out = _cast(column, dtype, CASTS[to])
    if "onError" in a:
        out = F.when(column.isNotNull(), F.coalesce(out, c(a["onError"])))
    return F.when(column.isNull(), c(a["onNull"])).otherwise(out) if "onNull" in a else out


for _name, _to in (("toBool", "boolean"), ("toDecimal", "decimal(38,18)"), ("toDouble", "double"), ("toInt", "int"), ("toLong", "bigint"), ("toString", "string"), ("toObjectId", "string")):
    OPS[f"${_name}"] = _convert(_to)


def type_name(dtype: T.DataType | None) -> str:
    for kinds, name in (
        ((T.DoubleType, T.FloatType), "double"), ((T.StringType,), "string"), ((T.StructType, T.MapType, T.VariantType), "object"), ((T.ArrayType,), "array"), ((T.BinaryType,), "binData"),
        ((T.BooleanType,), "bool"), (_DATES, "date"), ((T.NullType,), "null"), ((T.IntegerType, T.ShortType, T.ByteType), "int"), ((T.LongType,), "long"), ((T.DecimalType,), "decimal"),
    ):
        if isinstance(dtype, kinds):
            return name
    return "undefined"


@op("type")
def _(a, c):
    column, dtype = c.typed(a)
    return F.when(column.isNull(), "null").otherwise(type_name(dtype))


@op("isNumber")
def _(a, c):
    column, dtype = c.typed(a)
    return column.isNotNull() & F.lit(isinstance(dtype, T.NumericType))


OPS["$binarySize"] = lambda a, c: F.octet_length(c.one(a))
#: An estimate: the length of the value's JSON form.
OPS["$bsonSize"] = lambda a, c: F.octet_length(F.to_json(c.one(a)))


# -- accumulators over an array or over arguments -----------------------------------
def _array_of(a, c) -> Column:
    if isinstance(a, (list, tuple)) and len(a) != 1:
        return F.array(*c.args(a))
    spec = a[0] if isinstance(a, (list, tuple)) else a
    column, dtype = c.typed(spec)
    return column if isinstance(dtype, T.ArrayType) else F.array(column)


def _sum(x: Column) -> Column:
    return F.aggregate(F.array_compact(x), F.lit(0.0), lambda s, v: s + v)


def _deviation(minus: int) -> Callable:
    def run(a, c):
        x = F.array_compact(_array_of(a, c))
        n, mean = F.size(x), F.try_divide(_sum(x), F.size(x))
        return F.when(n > minus, F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / (n - minus)))

    return run


def nearest_rank(x: Column, p: Column) -> Column:
    ordered = F.sort_array(F.array_compact(x))
    return F.get(ordered, F.greatest(F.lit(0), F.ceil(p * F.size(ordered)).cast("int") - 1))


OPS["$sum"] = lambda a, c: _sum(_array_of(a, c))
OPS["$avg"] = lambda a, c: (lambda x: F.try_divide(_sum(x), F.size(F.array_compact(x))))(_array_of(a, c))
OPS["$max"] = lambda a, c: F.array_max(_array_of(a, c))
OPS["$min"] = lambda a, c: F.array_min(_array_of(a, c))
OPS["$stdDevPop"], OPS["$stdDevSamp"] = _deviation(0), _deviation(1)
OPS["$median"] = lambda a, c: nearest_rank(c(a["input"] if isinstance(a, dict) else a), F.lit(0.5))
OPS["$percentile"] = lambda a, c: F.transform(F.array(*[F.lit(float(p)) for p in a["p"]]), lambda p: nearest_rank(c(a["input"]), p))
