"""Files as a stream: analyses of single files run on it unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import language_of


def stream_files(spark: SparkSession, directory: str, max_files: int = 1000) -> DataFrame:
    """New files of a directory, ``max_files`` at most in a batch; feed it to the functions of ``operators.parse``."""
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    read = spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(directory)
    path = F.regexp_replace("path", "^file:/*", "/")
    return read.select(path.alias("path"), language_of(path).alias("language"), F.decode("content", "UTF-8").alias("content"))
