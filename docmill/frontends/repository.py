"""A thin repository over one collection: CRUD, paging and queries by name or text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.catalog import Catalog
from docmill.find import Find
from docmill.frontends import jdql
from docmill.frontends.methods import PREFIXES, run_method


class Repository:
    def __init__(self, catalog: Catalog, collection: str, key: str = "_id"):
        self.catalog, self.collection, self.key = catalog, collection, key

    def __getattr__(self, name: str):
        if name.startswith(PREFIXES):
            return lambda *args: self._named(name, *args)
        raise AttributeError(name)

    def _named(self, name: str, *args):
        out = run_method(self.catalog[self.collection], name, *args)
        if name.startswith(("delete", "remove")):
            self.catalog[self.collection] = out
        return out

    def find(self) -> Find:
        return Find(self.collection, self.catalog)

    def all(self) -> DataFrame:
        return self.catalog[self.collection]

    def by_id(self, value) -> dict | None:
        return self.find().f(self.key).eq(value).first()

    def save(self, rows: DataFrame) -> None:
        self.catalog.store(self.collection, rows, self.key)

    def insert(self, rows: DataFrame) -> None:
        self.catalog.insert(self.collection, rows)

    def delete(self, rows: DataFrame) -> None:
        keys = rows.select(F.col(self.key).alias("__k")).distinct()
        self.catalog[self.collection] = self.all().join(keys, F.col(self.key) == F.col("__k"), "left_anti")

    def query(self, text: str, params: dict | list | None = None) -> DataFrame:
        return jdql.run(text, self.all(), params)
