"""Named collections: the tables a pipeline can read, join and write."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.storage import on_workers

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Catalog:
    """name -> DataFrame.  ``db.name`` and ``name`` are separate collections."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        on_workers(spark)
        self.tables = dict(tables or {})

    @classmethod
    def from_directory(cls, spark: SparkSession, directory: str, names: tuple[str, ...] = TABLES) -> Catalog:
        """Parquet tables of a folder, opened when they are first asked for."""
        out = cls(spark)
        out.directory, out.names = directory, set(names)
        return out

    directory: str | None = None
    names: set[str] = set()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            if name in self.names:
                self.tables[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
            elif self.spark.catalog.tableExists(name):
                return self.spark.table(name)
            else:
                raise KeyError(f"no collection {name!r}")
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables or name in self.names

    def __setitem__(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def drop(self, name: str) -> None:
        self.tables.pop(name, None)

    def register_views(self) -> None:
        for name in {*self.tables, *self.names}:
            self[name].createOrReplaceTempView(name.replace(".", "_"))

    # -- dump and restore, insert -------------------------------------------------
    def dump(self, directory: str) -> None:
        for name in {*self.tables, *self.names}:
            self[name].write.mode("overwrite").parquet(str(PurePosixPath(directory) / f"{name}.parquet"))

    @classmethod
    def restore(cls, spark: SparkSession, directory: str, names: list[str]) -> Catalog:
        return cls(spark, {n: spark.read.parquet(f"{directory}/{n}.parquet") for n in names})

    def insert(self, name: str, rows: DataFrame) -> None:
        """Append documents; fields that either side lacks become null."""
        self[name] = self[name].unionByName(rows, allowMissingColumns=True) if name in self else rows

    def store(self, name: str, rows: DataFrame, key: str = "_id") -> None:
        """Upsert by key: stored rows replace those of equal key."""
        if name not in self:
            self[name] = rows
            return
        kept = self[name].join(rows.select(F.col(key).alias("__k")).distinct(), F.col(key).eqNullSafe(F.col("__k")), "left_anti")
        self[name] = kept.unionByName(rows, allowMissingColumns=True)

    def ensure_unique(self, name: str, *keys: str) -> None:
        """Raise if a unique index on ``keys`` would be violated."""
        if found := self[name].groupBy(*keys).count().where("count > 1").first():
            raise ValueError(f"duplicate key in {name}: {found.asDict()}")

    def expire(self, name: str, field: str, seconds: int) -> DataFrame:
        """A time-to-live index: the rows that have not expired."""
        return self[name].where(F.coalesce(F.col(field).cast("timestamp") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(seconds)), F.lit(True)))
