"""The stage registry and the fold that runs a pipeline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.catalog import Catalog
from docmill.functions.paths import Scope, UnsupportedOperator

STAGES: dict[str, Callable] = {}


@dataclass(frozen=True)
class Context:
    """What stages know beside their rows: the collections, $let variables, the keys
    of the last $sort (the encounter order), the source's name, and collation."""

    catalog: Catalog | None = None
    variables: dict = field(default_factory=dict)
    ordering: tuple[tuple[str, int], ...] = ()
    collection: str | None = None
    collation: dict | None = None
    aliases: dict = field(default_factory=dict)

    def scope(self, df: DataFrame) -> Scope:
        return Scope(df, self.variables, self.aliases)

    def ordering_columns(self, df: DataFrame) -> list[tuple[Column, bool]]:
        from docmill.functions.paths import resolve

        return [(resolve(k, self.scope(df))[0], way == 1) for k, way in self.ordering if k.split(".")[0] in df.columns]


def stage(*names: str):
    def register(f: Callable) -> Callable:
        for n in names:
            STAGES[f"${n}"] = f
        return f

    return register


#: Stages after which the rows' former order means nothing.
_REORDER = {"$group", "$bucket", "$bucketAuto", "$sortByCount", "$count", "$facet", "$sample", "$documents", "$collStats"}


def run_pipeline(df: DataFrame, pipeline: list[dict], context: Context) -> DataFrame:
    """One lazy DataFrame for the whole pipeline; Catalyst plans it as a whole."""
    for spec in pipeline:
        (name, arg), *rest = spec.items()
        if rest:
            raise ValueError(f"a stage has one operator, not {list(spec)}")
        if name not in STAGES:
            raise UnsupportedOperator(f"unrecognised pipeline stage {name} (40324)")
        df = STAGES[name](df, arg, context)
        if name == "$sort":
            context = replace(context, ordering=tuple(arg.items()))
        elif name in _REORDER:
            context = replace(context, ordering=())
    return df


def sort_columns(spec: dict, scope: Scope) -> list[Column]:
    """Null sorts before every value."""
    from docmill.functions.paths import resolve

    out = []
    for key, way in spec.items():
        column = resolve(key, scope)[0]
        out.append(F.asc_nulls_first(column) if way in (1, True, "asc") else F.desc_nulls_last(column))
    return out
