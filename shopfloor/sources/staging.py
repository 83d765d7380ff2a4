"""Staged relations (K1, K3): a frame that several parts of a report use,
written once to the folder that all executors share.

The reports stage keys and rows in session tables; here a staged frame is a
set of Parquet files under ``spark.checkpoint.dir``, so a lost executor costs
nothing and later readers get its real size.  Without that setting staging is
an error rather than files on one machine's disk.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FOLDER_SETTING = "spark.checkpoint.dir"


class Stage:
    """Staged frames of one report run; leaving the ``with`` block deletes
    them, so write or collect the report inside it."""

    def __init__(self, spark: SparkSession):
        folder = spark.conf.get(FOLDER_SETTING, None)
        if not folder:
            raise ValueError(f"staging needs {FOLDER_SETTING}, a folder that all executors share")
        self.spark, self.folder, self.number = spark, f"{folder.rstrip('/')}/staged-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, written and read back."""
        self.number += 1
        path = f"{self.folder}/{self.number}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *failure) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Steps:
    """Frames of a report that runs in steps, each written once to the shared
    folder: a step's shuffle files go when its frame is written.  ``keep`` is
    for frames that later steps read, ``last`` for the one that the result is
    read from; with it the kept ones go."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, []

    def keep(self, df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
        """``df``, written and read back; a kept frame that only ``df`` was
        made from may go."""
        from shopfloor.llm.tables import materialise, scratch

        folder = scratch(self.spark)
        done = materialise(df, folder)
        self._drop(lambda frame: frame is instead_of)
        self.kept.append((done, folder))
        return done

    def last(self, df: DataFrame) -> DataFrame:
        """``df``, written and read back, without what it was made from."""
        from shopfloor.llm.tables import materialise

        done = materialise(df)
        self._drop(lambda frame: True)
        return done

    def _drop(self, chosen: Callable[[DataFrame], bool]) -> None:
        from shopfloor.llm.tables import discard

        for _, folder in [x for x in self.kept if chosen(x[0])]:
            discard(self.spark, folder)
        self.kept = [x for x in self.kept if not chosen(x[0])]
