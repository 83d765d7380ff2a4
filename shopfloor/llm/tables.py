"""Reading, materialising and naming helpers shared by the operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The white space of the contracts, ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
WORD_RE = "[^\\x20\\x09-\\x0D]+"
GAP_RE = "[\\x20\\x09-\\x0D]+"
#: Whether Spark deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` does that, and faster, on
    texts that are all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where a local
    session names none (tests), a temporary one is made and set.  On a cluster
    that would be another folder on every machine, so it is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def cleanup(spark: SparkSession) -> Iterator[None]:
    """Writes begun herein leave no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder (or in a ``scratch``
    folder there) and read it back: cuts the lineage and lets several readers
    share one computation.  A lost executor costs nothing, since the files are
    in the shared folder; the shuffle files of the write are deleted."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    with cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A folder under the shared one for tables that an operator is done with
    when it returns; it then calls ``discard``."""
    return f"{shared_dir(spark)}/llm-scratch-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a ``scratch`` folder with the tables in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any
    more, such as those a table has just been written from: its cleaner acts on
    the driver's garbage collections, which may otherwise be long in coming
    (every half hour by default) while the executors' disks fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def only(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The named columns and no others, so that extra columns of the input
    cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name built on ``stem`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix + "x_"
