"""JSON-Schema keywords compiled to boolean columns over typed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.expr import type_name
from docmill.functions.paths import Scope, UnsupportedOperator, literal

# JSON type names and the document type names they cover.
JSON_TYPES = {"integer": {"int", "long"}, "number": {"int", "long", "double", "decimal"}, "boolean": {"bool"}, "object": {"object"}, "array": {"array"}, "string": {"string"}, "null": {"null"}}
_NOTES = {"title", "description", "additionalProperties", "patternProperties", "additionalItems", "uniqueItems", "then", "else", "$comment"}


def compile_schema(schema: dict, scope: Scope) -> Column:
    row = F.struct(*[F.col(f"`{c}`") for c in scope.df.columns])
    return F.coalesce(_node(schema, row, scope.df.schema), F.lit(False))


def _every(terms: list[Column]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & t
    return out


def _count(terms: list[Column]) -> Column:
    out = F.lit(0)
    for t in terms:
        out = out + F.when(t, 1).otherwise(0)
    return out


def _node(schema: dict, x: Column, dtype: T.DataType) -> Column:
    """Whether ``x`` is valid; a null is judged by type, const and enum alone."""
    terms = []
    kinds: tuple[tuple[set[str], type | tuple, dict[str, Callable]], ...] = (
        ({"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"}, T.NumericType, _NUMBERS),
        ({"minLength", "maxLength", "pattern"}, T.StringType, _STRINGS),
        ({"minItems", "maxItems", "items", "contains"}, T.ArrayType, _ARRAYS),
        ({"minProperties", "maxProperties", "required", "properties"}, (T.StructType, T.MapType), _OBJECTS),
    )
    for key, arg in schema.items():
        if key in ("type", "bsonType"):
            wanted = set().union(*[JSON_TYPES.get(t, {t}) for t in (arg if isinstance(arg, list) else [arg])])
            terms.append(F.when(x.isNull(), F.lit("null" in wanted)).otherwise(F.lit(type_name(dtype) in wanted)))
        elif key == "enum":
            terms.append(F.coalesce(x.isin([v for v in arg if v is not None]), F.lit(False)) | (x.isNull() if None in arg else F.lit(False)))
        elif key == "const":
            terms.append(x.eqNullSafe(literal(arg)))
        elif key in ("allOf", "anyOf", "oneOf"):
            found = _count([_node(s, x, dtype) for s in arg])
            terms.append(found == len(arg) if key == "allOf" else found >= 1 if key == "anyOf" else found == 1)
        elif key == "not":
            terms.append(~_node(arg, x, dtype))
        elif key == "if":
            test = _node(arg, x, dtype)
            terms.append(F.when(test, _node(schema.get("then", {}), x, dtype)).otherwise(_node(schema.get("else", {}), x, dtype)))
        else:
            found = next((k for names, k in ((n, (c, t)) for n, c, t in kinds) if key in names), None)
            if found is not None:
                if isinstance(dtype, found[0]):
                    terms.append(x.isNull() | F.coalesce(found[1][key](x, dtype, arg, schema), F.lit(False)))
            elif key not in _NOTES:
                raise UnsupportedOperator(f"schema keyword {key}")
    if schema.get("uniqueItems") and isinstance(dtype, T.ArrayType):
        terms.append(x.isNull() | (F.size(F.array_distinct(x)) == F.size(x)))
    if isinstance(dtype, T.StructType):
        import re

        for pattern, sub in schema.get("patternProperties", {}).items():
            terms += [_present(sub, x.getField(f.name), f.dataType) for f in dtype.fields if re.search(pattern, f.name)]
        if schema.get("additionalProperties") is False:
            known, patterns = set(schema.get("properties", {})), list(schema.get("patternProperties", {}))
            terms += [x.getField(f.name).isNull() for f in dtype.fields if f.name not in known and not any(re.search(p, f.name) for p in patterns)]
    return _every(terms)


def _present(schema: dict, x: Column, dtype: T.DataType) -> Column:
    return x.isNull() | _node(schema, x, dtype)


def _properties(x, dtype, arg, schema):
    if isinstance(dtype, T.MapType):
        return _every([_present(s, F.try_element_at(x, F.lit(k)), dtype.valueType) for k, s in arg.items()])
    return _every([_present(s, x.getField(k), dtype[k].dataType) for k, s in arg.items() if k in dtype.fieldNames()])


def _fields(x, dtype) -> Column:
    return F.size(F.map_keys(x)) if isinstance(dtype, T.MapType) else _count([x.getField(n).isNotNull() for n in dtype.fieldNames()])


def _required(x, dtype, arg, schema):
    if isinstance(dtype, T.MapType):
        return _every([F.map_contains_key(x, k) for k in arg])
    return _every([x.getField(k).isNotNull() if k in dtype.fieldNames() else F.lit(False) for k in arg])


def _exclusive(upper: bool):
    def test(x, dtype, arg, schema):
        bound = schema["maximum" if upper else "minimum"] if arg is True else arg
        return F.lit(True) if arg is False else (x < bound if upper else x > bound)

    return test


_NUMBERS = {
    "minimum": lambda x, t, a, s: x >= a, "maximum": lambda x, t, a, s: x <= a, "exclusiveMinimum": _exclusive(False), "exclusiveMaximum": _exclusive(True),
    "multipleOf": lambda x, t, a, s: x % F.lit(a) == 0,
}
_STRINGS = {"minLength": lambda x, t, a, s: F.char_length(x) >= a, "maxLength": lambda x, t, a, s: F.char_length(x) <= a, "pattern": lambda x, t, a, s: x.rlike(a)}


def _items(x, t, a, s):
    if isinstance(a, list):
        return _every([_present(sub, F.get(x, F.lit(i)), t.elementType) for i, sub in enumerate(a)] + ([F.size(x) <= len(a)] if s.get("additionalItems") is False else []))
    return F.forall(x, lambda e: _node(a, e, t.elementType))


_ARRAYS = {"minItems": lambda x, t, a, s: F.size(x) >= a, "maxItems": lambda x, t, a, s: F.size(x) <= a, "items": _items, "contains": lambda x, t, a, s: F.exists(x, lambda e: _node(a, e, t.elementType))}
_OBJECTS = {"minProperties": lambda x, t, a, s: _fields(x, t) >= a, "maxProperties": lambda x, t, a, s: _fields(x, t) <= a, "required": _required, "properties": _properties}
