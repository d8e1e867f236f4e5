"""The find API: fluent filters, paging and row mutation as DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.catalog import Catalog
from docmill.functions.paths import Scope, UnsupportedOperator, literal, resolve, set_path
from docmill.functions.predicates import collated, compile_match, field_predicate
from docmill.operators.base import Context, sort_columns
from docmill.operators.shape import match, project

# Fluent operator names and the predicates they add.
_OPERATORS = {
    "eq": "$eq", "ne": "$ne", "gt": "$gt", "gte": "$gte", "lt": "$lt", "lte": "$lte", "in_": "$in", "nin": "$nin", "mod": "$mod", "all": "$all", "size": "$size", "type": "$type", "elem_match": "$elemMatch",
    "regex": "$regex", "matches": "$regex", "bits_all_set": "$bitsAllSet", "bits_any_set": "$bitsAnySet", "bits_all_clear": "$bitsAllClear", "bits_any_clear": "$bitsAnyClear", "near": "$near",
    "near_sphere": "$nearSphere", "geo_within": "$geoWithin", "geo_intersects": "$geoIntersects", "text": "$text",
}


class Field:
    def __init__(self, query: Find, name: str, negate: bool = False):
        self._query, self._name, self._negate = query, name, negate

    def not_(self) -> Field:
        return Field(self._query, self._name, not self._negate)

    def apply(self, op: str, value) -> Find:
        return self._query.where({self._name: {"$not": {op: value}} if self._negate else {op: value}})

    def exists(self) -> Find:
        return self.apply("$exists", True)

    def not_exists(self) -> Find:
        return self.apply("$exists", False)


for _python, _op in _OPERATORS.items():
    setattr(Field, _python, (lambda op: lambda self, value: self.apply(op, value))(_op))


class Find:
    """``Find(df).f("a").gte(5).sort("-b").limit(10).df()``."""

    def __init__(self, source: DataFrame | str, catalog: Catalog | None = None):
        self.source, self.catalog = source, catalog
        self._and: list[dict] = []
        self._or: list[dict] = []
        self._nor: list[dict] = []
        self._sort: dict[str, int] = {}
        self._projection: dict | None = None
        self._skip = self._limit = 0
        self._collation: dict | None = None

    def _copy(self, **changes) -> Find:
        out = Find(self.source, self.catalog)
        out.__dict__.update({**self.__dict__, **changes})
        return out

    def f(self, name: str) -> Field:
        return Field(self, name)

    def where(self, spec: dict) -> Find:
        return self._copy(_and=[*self._and, spec])

    raw = where

    def expr(self, spec) -> Find:
        return self.where({"$expr": spec})

    def json_schema(self, spec: dict) -> Find:
        return self.where({"$jsonSchema": spec})

    def text(self, search: str, case_sensitive: bool = False) -> Find:
        return self.where({"$text": {"$search": search, "$caseSensitive": case_sensitive}})

    def or_(self, *others: Find) -> Find:
        return self._copy(_or=[*self._or, *[o.filter() for o in others]])

    def nor(self, *others: Find) -> Find:
        return self._copy(_nor=[*self._nor, *[o.filter() for o in others]])

    def sort(self, *keys) -> Find:
        """Field names, with a minus for descending order, or one {field: 1/-1}."""
        spec = keys[0] if len(keys) == 1 and isinstance(keys[0], dict) else {k.lstrip("-+"): -1 if k.startswith("-") else 1 for k in keys}
        return self._copy(_sort={**self._sort, **spec})

    def skip(self, n: int) -> Find:
        return self._copy(_skip=n)

    def limit(self, n: int) -> Find:
        return self._copy(_limit=n)

    def project(self, *fields) -> Find:
        spec = fields[0] if len(fields) == 1 and isinstance(fields[0], dict) else {f.lstrip("-"): 0 if f.startswith("-") else 1 for f in fields}
        return self._copy(_projection=spec)

    def collation(self, spec: dict) -> Find:
        return self._copy(_collation=spec)

    def filter(self) -> dict:
        """The whole filter as one document."""
        out = [*self._and, *([{"$or": self._or}] if self._or else []), *([{"$nor": self._nor}] if self._nor else [])]
        return out[0] if len(out) == 1 else {"$and": out} if out else {}

    def _base(self) -> DataFrame:
        return self.catalog[self.source] if isinstance(self.source, str) else self.source

    def _matched(self) -> DataFrame:
        df = self._base()
        return match(df, self.filter(), Context(self.catalog, collation=self._collation)) if self.filter() else df

    def df(self) -> DataFrame:
        out = self._matched()
        if self._sort:
            seen = collated(out, self._collation) if self._collation else out
            out = seen.orderBy(*sort_columns(self._sort, Scope(seen)))
        if self._skip:
            out = out.offset(self._skip)
        if self._limit:
            out = out.limit(self._limit)
        return self._projected(out)

    def _projected(self, df: DataFrame) -> DataFrame:
        if not self._projection:
            return df
        sliced = {k: v["$slice"] for k, v in self._projection.items() if isinstance(v, dict) and "$slice" in v}
        for k, n in sliced.items():
            at, size = (n if isinstance(n, (list, tuple)) else (0, n)) if not isinstance(n, int) or n >= 0 else (n, -n)
            x = F.col(k)
            df = df.withColumn(k, F.slice(x, F.greatest(F.size(x) + at + 1, F.lit(1)) if at < 0 else F.lit(at + 1), F.lit(size)))
        rest = {k: 1 if k in sliced else v for k, v in self._projection.items()}
        return df if all(k in sliced for k in rest) else project(df, rest, Context(self.catalog))

    # -- terminal calls ---------------------------------------------------------------
    def to_list(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.df().collect()]

    def iterate(self):
        return (r.asDict(recursive=True) for r in self.df().toLocalIterator())

    def first(self) -> dict | None:
        row = self.df().first()
        return row.asDict(recursive=True) if row else None

    def count(self) -> int:
        return self._matched().count()

    def distinct(self, path: str) -> DataFrame:
        """Distinct values of a field as column ``value``; array elements one by one."""
        df = self._matched()
        column, dtype = resolve(path, Scope(df))
        value = F.explode(column) if isinstance(dtype, T.ArrayType) else column
        return df.select(value.alias("value")).where("value is not null").distinct()

    def page(self, number: int, size: int) -> DataFrame:
        """Page by offset, the first being 1."""
        return self.skip((number - 1) * size).limit(size).df()

    def after(self, key: dict, size: int) -> DataFrame:
        """Page by key: the rows that sort after ``key``; no offset is counted off."""
        later: Column = F.lit(False)
        for name, way in reversed(self._sort.items()):
            x, v = F.col(name), literal(key[name])
            beyond = (x > v) if way == 1 else (x < v) | x.isNull()
            later = F.coalesce(beyond, F.lit(False)) | (x.eqNullSafe(v) & later)
        rows = replace_source(self, self._matched().where(later))
        return rows.limit(size).df()

    # -- mutation ---------------------------------------------------------------------
    def update(self, spec: dict, array_filters: list[dict] | None = None, multi: bool = True, upsert: bool = False) -> DataFrame:
        return update(self._base(), self.filter(), spec, array_filters, multi, upsert, self._sort)

    def delete(self) -> DataFrame:
        """What is left after the matching rows are deleted."""
        df = self._base()
        return df.where(~compile_match(self.filter(), Scope(df)))

    def find_one_and_update(self, spec: dict) -> tuple[dict | None, DataFrame]:
        return self.first(), self.update(spec, multi=False)

    def find_one_and_delete(self) -> tuple[dict | None, DataFrame]:
        row = self.first()
        df = self._base()
        if row is None:
            return None, df
        marked = _numbered(df, self.filter(), self._sort)
        return row, marked.where("__n is null or __n > 1").drop("__n")


for _name, _operator in (("set_", "$set"), ("unset", "$unset"), ("inc", "$inc"), ("mul", "$mul"), ("min_", "$min"), ("max_", "$max"), ("push", "$push"), ("pull", "$pull"), ("add_to_set", "$addToSet"), ("pop", "$pop"), ("rename", "$rename"), ("bit", "$bit")):
    setattr(Find, _name, (lambda op: lambda self, spec, **kw: self.update({op: spec}, **kw))(_operator))


def replace_source(query: Find, df: DataFrame) -> Find:
    return query._copy(source=df, _and=[], _or=[], _nor=[])


def _numbered(df: DataFrame, filter_: dict, sort: dict) -> DataFrame:
    """``__n``: the place of a matching row among the matching ones, else null."""
    hit = compile_match(filter_, Scope(df))
    marked = df.withColumn("__hit", hit).withColumn("__id", F.monotonically_increasing_id())
    first = marked.where("__hit").orderBy(*(sort_columns(sort, Scope(df)) if sort else []), "__id").limit(1).select("__id").withColumn("__n", F.lit(1))
    return marked.join(F.broadcast(first), "__id", "left").withColumn("__n", F.when(F.col("__hit"), F.coalesce("__n", F.lit(2)))).drop("__hit", "__id")


# -- update operators ---------------------------------------------------------------------
def _element_update(array: Column, dtype: T.ArrayType, hit, change, first_only: bool) -> Column:
    """``change`` on the elements that ``hit``; on the first one only for ``$``."""
    if not first_only:
        return F.transform(array, lambda x: F.when(hit(x), change(x)).otherwise(x))
    at = F.array_position(F.transform(array, lambda x: hit(x)), True) - 1
    return F.transform(array, lambda x, i: F.when(i == at, change(x)).otherwise(x))


def _new_value(op: str, old: Column, dtype: T.DataType | None, arg, scope: Scope) -> Column:
    keep = dtype if dtype is not None and not isinstance(dtype, T.NullType) else None
    cast = lambda x: x.cast(keep) if keep is not None else x
    if op in ("$set", "$setOnInsert"):
        return cast(literal(arg))
    if op == "$unset":
        return cast(F.lit(None))
    if op in ("$inc", "$dec"):
        return F.coalesce(old, F.lit(0)) + (arg if op == "$inc" else -arg)
    if op == "$mul":
        return F.coalesce(old, F.lit(0)) * arg
    if op in ("$min", "$max"):
        return (F.least if op == "$min" else F.greatest)(old, cast(literal(arg)))
    if op == "$currentDate":
        return cast(F.current_timestamp())
    if op == "$bit":
        (how, n), = arg.items()
        return {"and": old.bitwiseAND, "or": old.bitwiseOR, "xor": old.bitwiseXOR}[how](F.lit(n).cast(dtype))
    if not isinstance(dtype, T.ArrayType):
        raise UnsupportedOperator(f"{op} needs an array field")
    base = F.coalesce(old, F.array().cast(dtype))
    many = lambda v: v["$each"] if isinstance(v, dict) and "$each" in v else [v]
    if op in ("$push", "$pushAll"):
        values = arg if op == "$pushAll" else many(arg)
        added = literal(values).cast(dtype)
        spec = arg if isinstance(arg, dict) and "$each" in arg else {}
        at = spec.get("$position")
        out = F.concat(base, added) if at is None else F.concat(F.slice(base, 1, at), added, F.slice(base, F.lit(at + 1), F.size(base)))
        if spec.get("$sort") in (1, -1):
            out = F.sort_array(out, asc=spec["$sort"] == 1)
        n = spec.get("$slice")
        return out if n is None else F.slice(out, F.lit(1), F.lit(n)) if n >= 0 else F.slice(out, F.greatest(F.size(out) + n + 1, F.lit(1)), F.lit(-n))
    if op in ("$addToSet", "$addAllToSet"):
        out = base
        for v in arg if op == "$addAllToSet" else many(arg):
            e = literal(v).cast(dtype.elementType)
            out = _added(out, e)
        return out
    if op == "$pull":
        test = (lambda x: field_predicate(x, dtype.elementType, arg, scope)) if not isinstance(arg, dict) or all(k.startswith("$") for k in arg) else (lambda x: _element_match(x, dtype.elementType, arg, scope))
        return F.filter(old, lambda x: ~test(x))
    if op == "$pullAll":
        values = literal(arg).cast(dtype)
        return F.filter(old, lambda x: ~F.coalesce(F.array_contains(values, x), F.lit(False)))
    if op == "$pop":
        rest = F.greatest(F.size(old) - 1, F.lit(0))
        return F.slice(old, F.lit(1), rest) if arg == 1 else F.slice(old, F.lit(2), rest)
    raise UnsupportedOperator(f"unknown update operator {op}")


def _added(array: Column, e: Column) -> Column:
    return F.when(F.exists(array, lambda x: x.eqNullSafe(e)), array).otherwise(F.array_append(array, e))


def _element_match(x: Column, dtype: T.DataType, spec: dict, scope: Scope) -> Column:
    from docmill.functions.predicates import _match_document

    return _match_document(x, dtype, spec, scope)


def _positional(df: DataFrame, path: str, op: str, arg, filter_: dict, filters: dict[str, dict], scope: Scope) -> tuple[str, Column]:
    """Array updates through ``$`` (first match of the filter), ``$[]`` (all) and
    ``$[id]`` (those an array filter names)."""
    names = path.split(".")
    k = next(i for i, n in enumerate(names) if n.startswith("$"))
    base, mark, rest = ".".join(names[:k]), names[k], names[k + 1 :]
    array, dtype = resolve(base, scope)
    element = dtype.elementType

    def hit(x: Column) -> Column:
        if mark == "$[]":
            return F.lit(True)
        if mark == "$":
            spec = {p[len(base) + 1 :]: v for p, v in filter_.items() if p.startswith(base + ".")}
            value = filter_.get(base, {})
            if isinstance(value, dict) and "$elemMatch" in value:
                value = value["$elemMatch"]
                return _element_match(x, element, value, scope) if not all(q.startswith("$") for q in value) else field_predicate(x, element, value, scope)
            return _element_match(x, element, spec, scope) if spec else field_predicate(x, element, value, scope)
        spec = filters[mark[2:-1]]
        return field_predicate(x, element, spec[""], scope) if "" in spec else _element_match(x, element, spec, scope)

    def change(x: Column) -> Column:
        if not rest:
            return _new_value(op, x, element, arg, scope)
        from docmill.functions.paths import _child, _set_in

        inner, kind = x, element
        for n in rest:
            inner, kind = _child(inner, kind, n)
        return _set_in(x, element, rest, _new_value(op, inner, kind, arg, scope))

    return base, _element_update(array, dtype, hit, change, mark == "$")


def update(df: DataFrame, filter_: dict, spec: dict, array_filters: list[dict] | None = None, multi: bool = True, upsert: bool = False, sort: dict | None = None) -> DataFrame:
    """``df`` with the matching rows changed: all, or the first one."""
    if spec and not all(k.startswith("$") for k in spec):
        spec = {"$set": spec}
    filters: dict[str, dict] = {}
    for f in array_filters or []:
        for path, value in f.items():
            name, _, rest = path.partition(".")
            filters.setdefault(name, {})[rest] = value
    if multi:
        marked = df.withColumn("__hit", compile_match(filter_, Scope(df)))
    else:
        marked = _numbered(df, filter_, sort or {}).withColumn("__hit", F.coalesce(F.col("__n") == 1, F.lit(False))).drop("__n")
    inserted = None
    if upsert and marked.where("__hit").isEmpty():
        row = _equalities(filter_)
        for op in ("$set", "$setOnInsert", "$inc"):
            row.update(spec.get(op, {}))
        inserted = df.sparkSession.range(1).select(*[literal(v).cast(df.schema[k].dataType).alias(k) if k in df.columns else literal(v).alias(k) for k, v in row.items()])
    out = marked
    for op, changes in spec.items():
        if op == "$setOnInsert":
            continue
        for path, arg in changes.items():
            scope = Scope(out)
            if op == "$rename":
                value = resolve(path, scope)[0]
                out = set_path(out, arg, F.when(F.col("__hit"), value).otherwise(resolve(arg, scope)[0]))
                out = set_path(out, path, F.when(~F.col("__hit"), resolve(path, Scope(out))[0]))
                continue
            if any(n.startswith("$") for n in path.split(".")):
                path, new = _positional(out, path, op, arg, filter_, filters, scope)
                old = resolve(path, scope)[0]
            else:
                old, dtype = resolve(path, scope)
                new = _new_value(op, old, dtype, arg, scope)
            out = set_path(out, path, F.when(F.col("__hit"), new).otherwise(old))
    out = out.drop("__hit")
    return out.unionByName(inserted, allowMissingColumns=True) if inserted is not None else out


def _equalities(filter_: dict) -> dict:
    """The fields that a filter fixes to one value."""
    out: dict = {}
    for k, v in filter_.items():
        if k == "$and":
            for part in v:
                out.update(_equalities(part))
        elif not k.startswith("$"):
            if not isinstance(v, dict):
                out[k] = v
            elif set(v) == {"$eq"}:
                out[k] = v["$eq"]
    return out


def bulk_write(df: DataFrame, operations: list[tuple], ordered: bool = True) -> DataFrame:
    """Operations in order: ("insert", DataFrame), ("update" or "update_many", filter, spec),
    ("update_one", filter, spec), ("replace_one", filter, document), ("delete" or
    "delete_many", filter), ("delete_one", filter).  A last {"upsert": True, "sort": {..},
    "array_filters": [..]} may follow.  An ordered write stops at an operation that is
    refused; an unordered one runs the others first and then raises the first refusal."""
    refused: Exception | None = None
    for kind, *args in operations:
        try:
            df = _write(df, kind, args)
        except (UnsupportedOperator, ValueError) as e:
            if ordered:
                raise
            refused = refused or e
    if refused is not None:
        refused.collection = df
        raise refused
    return df


def _write(df: DataFrame, kind: str, args: list) -> DataFrame:
    if kind == "insert":
        return df.unionByName(args[0], allowMissingColumns=True)
    if kind in ("delete", "delete_many"):
        return df.where(~compile_match(args[0], Scope(df)))
    options = args[-1] if len(args) > (1 if kind == "delete_one" else 2) else {}
    if kind == "delete_one":
        return _numbered(df, args[0], options.get("sort", {})).where("__n is null or __n > 1").drop("__n")
    if kind in ("update", "update_many", "update_one"):
        return update(df, args[0], args[1], options.get("array_filters"), kind != "update_one", options.get("upsert", False), options.get("sort"))
    if kind == "replace_one":
        keep = _equalities(args[0])
        document = {**{c: None for c in df.columns if c != "_id" and c not in keep}, **args[1]}
        return update(df, args[0], {"$set": document}, multi=False, upsert=options.get("upsert", False), sort=options.get("sort"))
    raise UnsupportedOperator(f"bulk operation {kind}")


def dereference(df: DataFrame, field: str, target: DataFrame, key: str = "_id", alias: str | None = None) -> DataFrame:
    """Follow a reference: the referred document under ``alias`` (default the field)."""
    doc = target.select(F.col(key).alias("__key"), F.struct(*[F.col(f"`{c}`") for c in target.columns]).alias("__doc"))
    column, dtype = resolve(field, Scope(df))
    if isinstance(dtype, T.ArrayType):
        rows = df.withColumn("__row", F.monotonically_increasing_id())
        each = rows.select("__row", F.posexplode(column).alias("__at", "__key")).join(doc, "__key")
        found = each.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__doc"))), lambda e: e["__doc"]).alias("__docs"))
        return set_path(rows.join(found, "__row", "left"), alias or field, F.coalesce("__docs", F.array().cast(found.schema["__docs"].dataType))).drop("__row", "__docs")
    return set_path(df.withColumn("__ref", column).join(doc, F.col("__ref") == F.col("__key"), "left"), alias or field, F.col("__doc")).drop("__ref", "__key", "__doc")
