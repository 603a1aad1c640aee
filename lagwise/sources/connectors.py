"""Series from connectors: a Python data source with one input partition per series, and the repository they are loaded into."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators import series as S
from ..session import written

FETCHED = "variable_id string, ts date, value double, error string"
HYPOTHESES = "id int, run_date date, x_id string, y_id string, direction string, lag int, mi double, direction_pvalue double, oos_r2 double, score double, confidence string"


class Connector(ABC):
    """Where series come from. It is sent to executors, so it must pickle; fetch runs there, one series at a time."""

    name: str

    @abstractmethod
    def series(self) -> list[dict]:
        """What there is, in order: series_id and any of name, frequency, unit, geo, domain."""

    @abstractmethod
    def fetch(self, series_id: str) -> Iterator[tuple[date, float]]:
        """Dates and values of one series."""


class _OneSeries(InputPartition):
    def __init__(self, series_id: str):
        super().__init__(series_id)
        self.series_id = series_id


def source_of(connector: Connector, limit: int | None = None) -> type[DataSource]:
    """A data source class that reads the connector's first `limit` series, a partition each.

    A series that fails gives the rows fetched so far and one row with the error; the others go on.
    """

    class Reader(DataSourceReader):
        def partitions(self):
            return [_OneSeries(s["series_id"]) for s in connector.series()[:limit]]

        def read(self, partition):
            key = f"{connector.name}:{partition.series_id}"
            try:
                for ts, value in connector.fetch(partition.series_id):
                    if value is not None and value == value:
                        yield key, ts, float(value), None
            except Exception as e:  # noqa: BLE001 - what a connector may raise isn't known here; it is kept as a row
                yield key, None, None, f"{type(e).__name__}: {e}"

    class Source(DataSource):
        @classmethod
        def name(cls):
            return f"lagwise_{connector.name}"

        def schema(self):
            return FETCHED

        def reader(self, schema: StructType):
            return Reader()

    return Source


def fetched(spark: SparkSession, connector: Connector, limit: int | None = None) -> DataFrame:
    """variable_id, ts, value, error of the connector's series."""
    source = source_of(connector, limit)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()


class Repository:
    """Tables series, observations and hypotheses under a root folder, made when first needed. Usable in a with statement.

    A load is appended under its number; reads take the latest row of each key, so a load that
    is run again under its number changes nothing.
    """

    TABLES = {"series": (S.CATALOG, ["variable_id"]), "observations": (S.OBSERVATIONS, ["variable_id", "ts"]), "hypotheses": (HYPOTHESES, ["id"])}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        for name, (schema, _) in self.TABLES.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.root}/{name}/load_seq=0")

    def __enter__(self) -> Repository:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open."""

    def load(self, table: str, rows: DataFrame, number: int) -> None:
        """Adds rows as load `number` (1 or more); a key's row of the greatest number counts; within a load any of equal keys'."""
        if number < 1:
            raise ValueError("loads are numbered from 1")
        schema = StructType.fromDDL(self.TABLES[table][0])
        if missing := {f.name for f in schema} - set(rows.columns):
            raise ValueError(f"columns are missing: {sorted(missing)}")
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.mode("overwrite").parquet(f"{self.root}/{table}/load_seq={number}")

    def table(self, name: str) -> DataFrame:
        schema, keys = self.TABLES[name]
        rows = self.spark.read.schema(schema + ", load_seq long").option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        return S.latest(rows, keys)

    def ingest(self, connector: Connector, number: int, limit: int | None = None) -> DataFrame:
        """Loads a connector's series with their catalog rows; variable_id, observations, error of each. Empty series are left out of the tables.

        Counts are those of distinct dates, so a date fetched twice counts once.
        """
        got = written(fetched(self.spark, connector, limit), "fetched")
        rows = got.where("ts is not null").groupBy("variable_id", "ts").agg(F.max("value").alias("value"))
        self.load("observations", rows, number)
        about = self.spark.createDataFrame([(f"{connector.name}:{s['series_id']}", connector.name, s.get("name", s["series_id"]), s.get("frequency", "monthly"), s.get("unit"), s.get("geo", ""), s.get("domain", "economics")) for s in connector.series()[:limit]], "variable_id string, source string, name string, frequency string, unit string, geo string, domain string")
        self.load("series", about.join(S.catalog_of(rows), "variable_id"), number)
        errors = got.groupBy("variable_id").agg(F.max("error").alias("error"))
        return errors.join(S.catalog_of(rows).select("variable_id", "observations"), "variable_id", "left").select("variable_id", F.coalesce("observations", F.lit(0)).alias("observations"), "error")
