"""Queries spelled as method names: ``findByStatusAndAgeGreaterThanOrderByNameDesc``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.paths import Scope, resolve
from docmill.functions.predicates import field_predicate
from docmill.operators.base import sort_columns

# Name endings, the operators they mean and how many arguments those take.
OPERATORS = {
    "GreaterThanEqual": ("$gte", 1), "GreaterThan": ("$gt", 1), "LessThanEqual": ("$lte", 1), "LessThan": ("$lt", 1), "NotBetween": ("not_between", 2), "Between": ("between", 2), "NotIn": ("$nin", 1),
    "In": ("$in", 1), "NotLike": ("not_like", 1), "Like": ("like", 1), "StartsWith": ("starts", 1), "StartingWith": ("starts", 1), "EndsWith": ("ends", 1), "EndingWith": ("ends", 1),
    "NotContains": ("not_contains", 1), "NotContaining": ("not_contains", 1), "Contains": ("contains", 1), "Containing": ("contains", 1), "IsNotNull": ("not_null", 0), "NotNull": ("not_null", 0),
    "IsNull": ("null", 0), "Null": ("null", 0), "IsTrue": ("true", 0), "True": ("true", 0), "IsFalse": ("false", 0), "False": ("false", 0), "IsNotEmpty": ("not_empty", 0), "NotEmpty": ("not_empty", 0),
    "IsEmpty": ("empty", 0), "Empty": ("empty", 0), "Size": ("$size", 1), "Matches": ("$regex", 1), "Regex": ("$regex", 1), "NotEquals": ("$ne", 1), "IsNot": ("$ne", 1), "Not": ("$ne", 1),
    "Equals": ("$eq", 1), "Is": ("$eq", 1),
}
PREFIXES = ("find", "get", "query", "search", "read", "count", "exists", "delete", "remove")


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    arguments: int
    ignore_case: bool


@dataclass(frozen=True)
class MethodQuery:
    action: str
    alternatives: tuple[tuple[Condition, ...], ...]
    order: tuple[tuple[str, int], ...]
    limit: int | None
    distinct: bool


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def _field(name: str, fields: list[str]) -> str:
    """The column meant: as written, or in snake case."""
    for candidate in (name, name[:1].lower() + name[1:], snake(name)):
        if candidate in fields:
            return candidate
    return snake(name)


def _condition(text: str, fields: list[str]) -> Condition:
    ignore = text.endswith("IgnoreCase")
    text = text.removesuffix("IgnoreCase")
    if _field(text, fields) not in fields:  # a field may itself end in an operator's name
        for ending in sorted(OPERATORS, key=len, reverse=True):
            if text.endswith(ending) and len(text) > len(ending):
                op, n = OPERATORS[ending]
                return Condition(_field(text[: -len(ending)], fields), op, n, ignore)
    return Condition(_field(text, fields), "$eq", 1, ignore)


def parse_method(name: str, fields: list[str]) -> MethodQuery:
    action = next((p for p in PREFIXES if name.startswith(p)), None)
    if action is None:
        raise ValueError(f"{name} begins with none of {PREFIXES}")
    head, by, rest = name[len(action) :].partition("By")
    body, _, order = rest.partition("OrderBy")
    first = re.search(r"(?:First|Top)(\d*)", head)
    alternatives = tuple(tuple(_condition(c, fields) for c in re.split(r"And(?=[A-Z])", alt)) for alt in re.split(r"Or(?=[A-Z])", body)) if by and body else ()
    keys = []
    for key, way in re.findall(r"([A-Z]\w*?)(Asc|Desc|$)(?=[A-Z]|$)", order):
        keys.append((_field(key, fields), -1 if way == "Desc" else 1))
    action = {"get": "find", "query": "find", "search": "find", "read": "find", "remove": "delete"}.get(action, action)
    return MethodQuery(action, alternatives, tuple(keys), int(first[1] or 1) if first else None, "Distinct" in head)


def _predicate(c: Condition, args: list, scope: Scope):
    column, dtype = resolve(c.field, scope)
    if c.ignore_case:
        column, args = F.lower(column), [a.lower() if isinstance(a, str) else a for a in args]
    sure = lambda p: F.coalesce(p, F.lit(False))
    if c.operator.startswith("$"):
        return field_predicate(column, dtype, {c.operator: args[0]}, scope)
    op = c.operator.removeprefix("not_")
    if op == "like":
        from docmill.frontends.jdql import like_regex

        out = sure(column.rlike(like_regex(args[0])))
    else:
        out = {
            "between": lambda: field_predicate(column, dtype, {"$gte": args[0], "$lte": args[1]}, scope),
            "starts": lambda: sure(column.startswith(args[0])),
            "ends": lambda: sure(column.endswith(args[0])),
            "contains": lambda: sure(F.contains(column, F.lit(args[0]))),
            "null": lambda: column.isNull(),
            "true": lambda: sure(column),
            "false": lambda: sure(~column),
            "empty": lambda: column.isNull() | sure((F.size(column) if "array" in (dtype.typeName() if dtype else "") else F.length(column)) == 0),
        }[op]()
    return ~out if c.operator.startswith("not_") else out


def run_method(df: DataFrame, name: str, *args):
    """A find gives a DataFrame, a count a number, exists a truth, a delete what is
    left of the collection."""
    q = parse_method(name, df.columns)
    scope, values = Scope(df), list(args)
    test = None
    for alternative in q.alternatives:
        both = None
        for c in alternative:
            p = _predicate(c, values[: c.arguments], scope)
            del values[: c.arguments]
            both = p if both is None else both & p
        test = both if test is None else test | both
    test = F.lit(True) if test is None else test
    if q.action == "delete":
        return df.where(~test)
    out = df.where(test)
    if q.action == "count":
        return out.count()
    if q.action == "exists":
        return not out.isEmpty()
    if q.distinct:
        out = out.distinct()
    if q.order:
        out = out.orderBy(*sort_columns(dict(q.order), scope))
    return out.limit(q.limit) if q.limit else out
