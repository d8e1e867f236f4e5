"""User functions: ``$function``, ``$accumulator`` and map-reduce."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.accumulators import ACCUMULATORS
from docmill.functions.expr import FUNCTIONS
from docmill.storage import on_workers

#: Values of a key that map-reduce holds before it folds them.
FOLD = 10_000


def register_function(name: str, function: Callable, returns: T.DataType) -> None:
    """A Python function of plain values for ``$function``, run on Arrow batches."""

    @F.pandas_udf(returns)
    def vectorised(*columns: pd.Series) -> pd.Series:
        return pd.Series([function(*row) for row in zip(*columns, strict=True)], dtype=object)

    FUNCTIONS[name] = vectorised


def register_accumulator(name: str, accumulate: Callable, initial: Callable, finalize: Callable = lambda s: s, returns: T.DataType = T.DoubleType()) -> None:  # noqa: B008
    """``accumulate(state, *values)`` from ``initial()`` over a group, for
    ``$accumulator``.  It has no merge step, so a group is folded in one task."""

    @F.pandas_udf(returns)
    def folded(*columns: pd.Series) -> float:
        state = initial()
        for row in zip(*columns, strict=True):
            state = accumulate(state, *row)
        return finalize(state)

    ACCUMULATORS[name] = folded


def map_reduce(df: DataFrame, mapper: Callable[[dict], Iterable[tuple]], reducer: Callable, schema: str, finalize: Callable | None = None) -> DataFrame:
    """``mapper(row)`` emits (key, value) pairs; ``reducer(key, values)`` folds them.

    ``schema`` names the key and value columns.  Pairs are reduced inside every map
    task first, as the reducer must be associative, so a hot key sends one pair a task.
    """
    fields = T._parse_datatype_string(schema)
    key, value = fields.fieldNames()
    on_workers(df.sparkSession)

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups: dict = {}
            columns = [c.tolist() for _, c in batch.items()]
            for row in zip(*columns, strict=True):
                for k, v in mapper(dict(zip(batch.columns, row, strict=True))):
                    groups.setdefault(k, []).append(v)
            yield pd.DataFrame([(k, vs[0] if len(vs) == 1 else reducer(k, vs)) for k, vs in groups.items()], columns=[key, value])

    def one(k, values: list):
        return values[0] if len(values) == 1 else reducer(k, values)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, values = None, []
        close = lambda: (last, finalize(last, one(last, values)) if finalize else one(last, values))
        for batch in batches:
            out = []
            for k, v in zip(batch[key].tolist(), batch[value].tolist(), strict=True):
                if values and not (k == last or (pd.isna(k) and pd.isna(last))):
                    out.append(close())
                    values = []
                elif len(values) >= FOLD:
                    values = [one(last, values)]
                last = k
                values.append(v)
            yield pd.DataFrame(out, columns=[key, value])
        if values:
            yield pd.DataFrame([close()], columns=[key, value])

    # Keys arrive sorted, so one pass folds runs of equal keys, many to a batch.
    return df.mapInPandas(mapped, fields).repartition(F.col(f"`{key}`")).sortWithinPartitions(F.col(f"`{key}`")).mapInPandas(reduced, fields)
