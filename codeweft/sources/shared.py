"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session has none, one on this machine, if all its executors are here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codeweft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: With it a query's shuffle files go when it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder, parted by a column if asked, and read back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.  The
    files go when the driver's JVM ends, or before by ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` gave and that nothing reads any more."""
    for df in tables:
        place, system = _place(df.sparkSession, df.written_to)
        system.delete(place, True)
        system.cancelDeleteOnExit(place)


def stored(spark: SparkSession, files: dict[str, str], name: str) -> str:
    """A few small files, by path and text, in a new folder of the shared one; the folder's path."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for path, text in files.items():
        place, system = _place(spark, f"{root}/{path}")
        out = system.create(place)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
    place, system = _place(spark, root)
    system.deleteOnExit(place)
    return root
