"""Where a registry's rows are: parquet, CSV, JDBC, catalog tables, or frames given by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarack.errors import ModelError
from tamarack.model import Model, Registry
from tamarack.operators.query import Query


class Source:
    """Base of sources: how a model's rows are read."""

    def __init__(self, spark: SparkSession, registry: Registry):
        self.spark, self.registry = spark, registry

    def load(self, model: Model) -> DataFrame:
        raise NotImplementedError

    def query(self, model: Model | str) -> Query:
        return Query(self.registry.model(model) if isinstance(model, str) else model, self)

    def table(self, model: Model) -> str:
        prefix = self.registry.settings.table_prefix
        return f"{prefix}_{model.name}" if prefix else model.name


class ParquetSource(Source):
    """``<folder>/<table>.parquet``, files or folders."""

    def __init__(self, spark: SparkSession, registry: Registry, folder: str):
        super().__init__(spark, registry)
        self.folder = folder

    def load(self, model: Model) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.table(model)}.parquet")


class CsvSource(ParquetSource):
    """``<folder>/<table>.csv`` with a header; \\N stands for null; read with the model's schema, never inferred."""

    null = "\\N"

    def load(self, model: Model) -> DataFrame:
        return read_csv(self.spark, f"{self.folder}/{self.table(model)}.csv", model, self.null)


class CatalogSource(Source):
    def load(self, model: Model) -> DataFrame:
        return self.spark.table(self.table(model))


class JdbcSource(Source):
    """PostgreSQL or SQLite by JDBC; the driver's jar must be on the class path.

    ``partitions`` maps a table to (column, lower, upper, number), for parallel reads.
    """

    def __init__(self, spark: SparkSession, registry: Registry, partitions: dict | None = None):
        super().__init__(spark, registry)
        self.partitions = partitions or {}

    def url(self) -> str:
        s = self.registry.settings
        if s.adapter.lower() == "sqlite":
            return f"jdbc:sqlite:{s.database or ':memory:'}"
        if s.adapter.lower() not in ("postgresql", "postgres"):
            raise ModelError(f"no JDBC address for the adapter {s.adapter}")
        return f"jdbc:postgresql://{s.host or s.options.get('hostaddr', 'localhost')}:{s.port or 5432}/{s.database}"

    def options(self, model: Model) -> dict[str, str]:
        s = self.registry.settings
        found = {"url": self.url(), "dbtable": self.table(model)}
        found |= {k: v for k, v in (("user", s.username), ("password", s.password)) if v}
        if model.name in self.partitions:
            found |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, self.partitions[model.name]), strict=True))
        return found

    def load(self, model: Model) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options(model)).load()


class FrameSource(Source):
    """Frames by table name: views of other data, or streams."""

    def __init__(self, spark: SparkSession, registry: Registry, frames: dict[str, DataFrame]):
        super().__init__(spark, registry)
        self.frames = frames

    def load(self, model: Model) -> DataFrame:
        return self.frames[model.name]


def read_csv(spark: SparkSession, path: str, model: Model, null: str = "\\N") -> DataFrame:
    """A CSV file with a header; columns are matched by name in any case, and must all be the model's."""
    header = spark.read.csv(path, header=True, inferSchema=False).columns
    text = spark.read.csv(path, header=True, nullValue=null, schema=", ".join(f"`{c}` string" for c in header), quote='"', escape='"', multiLine=True)
    return text.select(*[text[f"`{c}`"].cast(model.field(c.lower()).spark_type).alias(c.lower()) for c in header])
