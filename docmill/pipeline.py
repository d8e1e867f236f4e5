"""Aggregation pipelines: run a list of stages, or build one fluently."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from docmill.catalog import Catalog
from docmill.operators import Context, run_pipeline
from docmill.operators.sinks import documents_frame

# Fluent method names and the stages they append.
_METHODS = {
    "match": "$match", "project": "$project", "add_fields": "$addFields", "set": "$set", "unset": "$unset", "sort": "$sort", "limit": "$limit", "skip": "$skip", "sample": "$sample", "unwind": "$unwind",
    "lookup": "$lookup", "graph_lookup": "$graphLookup", "union_with": "$unionWith", "facet": "$facet", "bucket": "$bucket", "bucket_auto": "$bucketAuto", "sort_by_count": "$sortByCount",
    "replace_root": "$replaceRoot", "replace_with": "$replaceWith", "redact": "$redact", "geo_near": "$geoNear", "set_window_fields": "$setWindowFields", "densify": "$densify", "fill": "$fill",
    "merge": "$merge", "out": "$out", "documents": "$documents", "coll_stats": "$collStats", "count_stage": "$count", "index_stats": "$indexStats", "plan_cache_stats": "$planCacheStats",
    "current_op": "$currentOp", "list_sessions": "$listSessions", "list_local_sessions": "$listLocalSessions",
}


def aggregate(source: DataFrame | str, pipeline: list[dict], catalog: Catalog | None = None, **options) -> DataFrame:
    """The lazy result of a pipeline over a DataFrame or a named collection."""
    name = source if isinstance(source, str) else None
    df = catalog[source] if isinstance(source, str) else source
    return run_pipeline(df, pipeline, Context(catalog=catalog, collection=name, **options))


class GroupBuilder:
    """``agg.group("$k").sum("n", "$x").end()``."""

    def __init__(self, parent: Aggregation, key):
        self._parent, self._spec = parent, {"_id": key}

    def accumulate(self, field: str, name: str, arg) -> GroupBuilder:
        self._spec[field] = {name: arg}
        return self

    def end(self) -> Aggregation:
        return self._parent.stage("$group", self._spec)


def _accumulator(name: str):
    return lambda self, field, arg=1: self.accumulate(field, f"${name}", arg)


for _python, _name in (("sum", "sum"), ("avg", "avg"), ("min", "min"), ("max", "max"), ("first", "first"), ("last", "last"), ("push", "push"), ("add_to_set", "addToSet"), ("std_dev_pop", "stdDevPop"), ("std_dev_samp", "stdDevSamp"), ("merge_objects", "mergeObjects"), ("count", "count")):
    setattr(GroupBuilder, _python, _accumulator(_name))


class Aggregation:
    """A pipeline under construction.  Terminal calls run it; ``df()`` stays lazy."""

    def __init__(self, source: DataFrame | str, catalog: Catalog | None = None, aliases: dict | None = None):
        self.source, self.catalog, self.aliases = source, catalog, aliases or {}
        self.pipeline: list[dict] = []
        self._collation: dict | None = None

    def stage(self, name: str, spec) -> Aggregation:
        """Any stage by name."""
        self.pipeline.append({name if name.startswith("$") else f"${name}": spec})
        return self

    def group(self, key) -> GroupBuilder:
        return GroupBuilder(self, key)

    def collation(self, spec: dict) -> Aggregation:
        self._collation = spec
        return self

    def df(self) -> DataFrame:
        return aggregate(self.source, self.pipeline, self.catalog, collation=self._collation, aliases=self.aliases)

    def to_list(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.df().collect()]

    def iterate(self) -> Iterator[dict]:
        """Rows partition by partition; the driver never holds them all."""
        return (r.asDict(recursive=True) for r in self.df().toLocalIterator())

    def count(self) -> int:
        return self.df().count()

    def explain(self, mode: str = "formatted") -> None:
        self.df().explain(mode)


def _method(name: str):
    return lambda self, spec=None: self.stage(name, {} if spec is None else spec)


for _python, _name in _METHODS.items():
    setattr(Aggregation, _python, _method(_name))


def from_documents(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return documents_frame(spark, rows)
