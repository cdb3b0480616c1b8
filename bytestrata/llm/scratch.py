"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset on a local master (tests), a temporary one that this sets.
    Elsewhere it has to be set: a machine's own folder is not shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="bytestrata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets the session send Python workers at most BATCH bytes at once: the default of 64 MB, held twice by the JVM and
    once by each worker, is a fifth of a small executor's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if found and int(found[1]) > BATCH:
        spark.conf.set(name, f"{BATCH}b")


class Scratch:
    """Tables of one run of one operator. ``save`` cuts the lineage: an executor that is lost takes nothing with it."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Frees tables that no later step reads."""
        for df in dfs:
            path = getattr(df, "_scratch_path", None)
            if path:
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """df, to be broadcast if it has at most ``limit`` rows. df: a saved table, which is counted without being made again."""
    return F.broadcast(df) if df.count() <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_broadcast_rows(df: DataFrame, limit: int) -> bool:
    """Whether df has at most ``limit`` rows; reads no more than limit + 1 of them."""
    return df.limit(limit + 1).count() <= limit
