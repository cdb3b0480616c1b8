"""Files of any store that Spark reads, as rows of bytes; each with its format, size and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.operators.blocks import blocks, file_status
from bytestrata.operators.recognise import identify


def scan(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, modified, size, content) of the files at a path, folder or glob. Spark lists and reads them; a file beyond what
    one value can hold (2 GB) stops the job when its content is asked for, its size does not. Spark's reader leaves out empty
    files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def watch(spark: SparkSession, path: str, glob: str | None = None, files_a_batch: int = 1000) -> DataFrame:
    """The same of files as they arrive, as a stream; identify() and blocks() go over it unchanged."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_a_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def summary(files: DataFrame) -> DataFrame:
    """(path, size, file_type, status) of scanned files."""
    named = files.select("path", "size", identify(F.col("content")).alias("file_type"))
    return named.withColumn("status", file_status(F.col("size"), F.col("file_type")))


def dissected(files: DataFrame) -> DataFrame:
    """Scanned files' blocks, with size: a row per labelled range."""
    return blocks(files).join(files.select("path", "size"), "path")
