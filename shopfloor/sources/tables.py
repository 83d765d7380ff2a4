"""Table loading.  Reads are plain ``spark.read.parquet`` (or catalog tables)
so Catalyst prunes columns and pushes predicates into the scan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# The driver's test tables (one parquet file each).
TEST_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class LazyTables(Mapping):
    """Name -> DataFrame mapping that opens each Parquet file on first use."""

    def __init__(self, spark: SparkSession, root: str, names: Iterable[str] = TEST_TABLES):
        self._spark = spark
        self._root = root.rstrip("/")
        self._names = list(names)
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._cache:
            self._cache[name] = self._spark.read.parquet(f"{self._root}/{name}.parquet")
        return self._cache[name]

    def __iter__(self):
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def catalog_tables(spark: SparkSession, names: Mapping[str, str]) -> dict[str, DataFrame]:
    """Contract name -> ``catalog.schema.table`` (S8: cross-database names)."""
    return {contract: spark.table(qualified) for contract, qualified in names.items()}
