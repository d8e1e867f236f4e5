"""Field paths against Spark schemas, literals, and the scope they are compiled in."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UnsupportedOperator(ValueError):
    """An operator or stage that has no meaning here; never silently ignored."""


@dataclass(frozen=True)
class Scope:
    """What a compiled expression can see: the row's schema and variables.

    variables: name -> (column, type or None if it is not known before analysis).
    """

    df: DataFrame
    variables: dict = field(default_factory=dict)
    aliases: dict = field(default_factory=dict)

    def with_variable(self, name: str, column: Column, dtype: T.DataType | None = None) -> Scope:
        return replace(self, variables={**self.variables, name: (column, dtype)})

    def type_of(self, column: Column) -> T.DataType | None:
        """The column's type, or None for columns that hang on a lambda variable."""
        try:
            return self.df.select(column).schema[0].dataType
        except Exception as e:
            if type(e).__name__ in ("AnalysisException", "IllegalArgumentException", "Py4JJavaError"):
                return None
            raise


def literal(value) -> Column:
    """A Python value as a constant column; lists become arrays, dicts structs."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v) for v in value])
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
        return F.lit(value)
    if isinstance(value, (bytes, bytearray, dt.date, Decimal)) or value is None:
        return F.lit(value)
    return F.lit(value)


def _child(column: Column, dtype: T.DataType | None, name: str) -> tuple[Column, T.DataType | None]:
    if isinstance(dtype, T.StructType):
        if name in dtype.fieldNames():
            return column.getField(name), dtype[name].dataType
        return F.lit(None), T.NullType()
    if isinstance(dtype, T.MapType):
        return F.try_element_at(column, F.lit(name)), dtype.valueType
    if isinstance(dtype, T.ArrayType):
        if name.isdigit():
            return F.get(column, F.lit(int(name))), dtype.elementType
        sample = _child(F.lit(None), dtype.elementType, name)[1]
        return F.transform(column, lambda x: _child(x, dtype.elementType, name)[0]), T.ArrayType(sample or T.NullType())
    if isinstance(dtype, T.VariantType):
        return F.try_variant_get(column, f"$.{name}", "variant"), T.VariantType()
    if dtype is None:
        return column.getField(name), None
    return F.lit(None), T.NullType()


def resolve(path: str, scope: Scope) -> tuple[Column, T.DataType | None]:
    """Column and type of a dotted path.  Arrays of documents fan out, a number
    indexes an array, a missing field is null."""
    head, *rest = path.split(".")
    head = scope.aliases.get(head, head)
    if head not in scope.df.columns:
        return F.lit(None), T.NullType()
    column, dtype = F.col(f"`{head}`"), scope.df.schema[head].dataType
    for name in rest:
        column, dtype = _child(column, dtype, name)
    return column, dtype


def resolve_variable(path: str, scope: Scope) -> tuple[Column, T.DataType | None]:
    """``$$name.path``, with the system variables ROOT, CURRENT, NOW and REMOVE."""
    head, *rest = path.split(".")
    if head in scope.variables:
        column, dtype = scope.variables[head]
    elif head in ("ROOT", "CURRENT"):
        column, dtype = F.struct(*[F.col(f"`{c}`") for c in scope.df.columns]), scope.df.schema
    elif head == "NOW":
        return F.current_timestamp(), T.TimestampType()
    elif head == "REMOVE":
        return F.lit(None), T.NullType()
    else:
        raise UnsupportedOperator(f"unknown variable $${head}")
    for name in rest:
        column, dtype = _child(column, dtype, name)
    return column, dtype


def set_path(df: DataFrame, path: str, value: Column) -> DataFrame:
    """``df`` with a dotted path set; missing parent documents are created."""
    head, *rest = path.split(".")
    if not rest:
        return df.withColumn(head, value)
    return df.withColumn(head, _set_in(F.col(f"`{head}`"), df.schema[head].dataType if head in df.columns else None, rest, value))


def _set_in(column: Column, dtype: T.DataType | None, names: list[str], value: Column) -> Column:
    head, *rest = names
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: _set_in(x, dtype.elementType, names, value))
    if not isinstance(dtype, T.StructType):
        return F.struct((_set_in(F.lit(None), None, rest, value) if rest else value).alias(head))
    there = head in dtype.fieldNames()
    new = _set_in(column.getField(head) if there else F.lit(None), dtype[head].dataType if there else None, rest, value) if rest else value
    fields = [(new if f.name == head else column.getField(f.name)).alias(f.name) for f in dtype.fields]
    return F.struct(*fields, *([] if there else [new.alias(head)]))


def drop_path(df: DataFrame, path: str) -> DataFrame:
    head, *rest = path.split(".")
    if head not in df.columns:
        return df
    if not rest:
        return df.drop(head)
    return df.withColumn(head, _drop_in(F.col(f"`{head}`"), df.schema[head].dataType, rest))


def _drop_in(column: Column, dtype: T.DataType, names: list[str]) -> Column:
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: _drop_in(x, dtype.elementType, names))
    if not isinstance(dtype, T.StructType):
        return column
    return column.dropFields(".".join(names)) if names[0] in dtype.fieldNames() else column
