"""Reading the corpus tables and keeping intermediate tables where all executors see them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no further column can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a session whose executors are threads of the driver, as in tests, gets one of its own
    where none is named; on a cluster a folder of the driver's machine would be of no use.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[\d*,]+\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/keyfold-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored_bytes(df: DataFrame) -> int | None:
    """What Spark's statistics say of a table's size: of files, their length; None of a table that they do not know."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else None


class Scratch:
    """Intermediate Parquet tables of one run under the shared folder.

    A written table cuts the lineage: a lost executor costs no recomputation of what is
    before it.  Tables that a lazy result still reads stay until the driver ends; operators drop
    the others before they return.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.at))

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(self.path(name)), True)

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        for found in self._fs.listStatus(self._path(self.at)):
            if found.getPath().getName() not in names:
                self._fs.delete(found.getPath(), True)
