"""Where bars come from: adapters by name, each giving a table key, ts, open, high, low, close, volume."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.errors import InputError, RegistryError

COLUMNS = ("key", "ts", "open", "high", "low", "close", "volume")
NUMBERS = COLUMNS[2:]


class DataAdapter(ABC):
    """Knows how to read one kind of source; `fetch` declares the read, Spark does it."""

    @abstractmethod
    def fetch(self, spark: SparkSession, **options) -> DataFrame: ...


def as_bars(df: DataFrame, rename: Mapping[str, str] | None = None, key: str | None = None) -> DataFrame:
    """The columns of bars, renamed and cast; `key` names a series where the source holds one only. Missing volume is null."""
    out = df.withColumnsRenamed({k: v for k, v in (rename or {}).items() if k in df.columns})
    lower = {c: c.lower() for c in out.columns if c != c.lower() and c.lower() in COLUMNS and c.lower() not in out.columns}
    out = out.withColumnsRenamed(lower)
    if "key" not in out.columns:
        if key is None:
            raise InputError("the source has no key column", "name the series with key=")
        out = out.withColumn("key", F.lit(key))
    if "volume" not in out.columns:
        out = out.withColumn("volume", F.lit(None))
    missing = [c for c in COLUMNS if c not in out.columns]
    if missing:
        raise InputError(f"missing columns: {', '.join(missing)}", "rename= maps the source's names")
    return out.select(F.col("key").cast("string"), F.col("ts").cast("timestamp"), *[F.col(c).cast("double") for c in NUMBERS])


class CsvAdapter(DataAdapter):
    """CSV files with a header: any path that Spark reads, the columns of bars in any order and letter case, or renamed."""

    def __init__(self, path: str | list[str], rename: Mapping[str, str] | None = None, key: str | None = None, **options):
        self.path, self.rename, self.key, self.options = path, rename, key, {"header": True} | options

    def fetch(self, spark: SparkSession, **options) -> DataFrame:
        # No schema is inferred: that would read the files twice.
        return as_bars(spark.read.options(**self.options, **options).csv(self.path), self.rename, self.key)


class ParquetAdapter(DataAdapter):
    def __init__(self, path: str | list[str], rename: Mapping[str, str] | None = None, key: str | None = None):
        self.path, self.rename, self.key = path, rename, key

    def fetch(self, spark: SparkSession, **options) -> DataFrame:
        return as_bars(spark.read.options(**options).parquet(*([self.path] if isinstance(self.path, str) else self.path)), self.rename, self.key)


class InMemoryAdapter(DataAdapter):
    """A dict of columns, a pandas frame or a DataFrame."""

    def __init__(self, data, rename: Mapping[str, str] | None = None, key: str | None = None):
        self.data, self.rename, self.key = data, rename, key

    def fetch(self, spark: SparkSession, **options) -> DataFrame:
        import pandas as pd

        data = pd.DataFrame(self.data) if isinstance(self.data, Mapping) else self.data
        return as_bars(data if isinstance(data, DataFrame) else spark.createDataFrame(data), self.rename, self.key)


_ADAPTERS: dict[str, type[DataAdapter]] = {"csv": CsvAdapter, "parquet": ParquetAdapter, "memory": InMemoryAdapter}


def register_adapter(name: str, adapter: type[DataAdapter]) -> None:
    if not (isinstance(adapter, type) and issubclass(adapter, DataAdapter)):
        raise TypeError("an adapter is a subclass of DataAdapter")
    _ADAPTERS[name.lower()] = adapter


def get_adapter(name: str) -> type[DataAdapter]:
    if name.lower() not in _ADAPTERS:
        raise RegistryError(f"unknown adapter {name!r}", f"known: {', '.join(sorted(_ADAPTERS))}")
    return _ADAPTERS[name.lower()]


def write_bars(bars: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Bars as Parquet by key, so that a read of some keys opens their files only."""
    bars.repartition("key").sortWithinPartitions("key", "ts").write.mode(mode).partitionBy("key").parquet(path)
