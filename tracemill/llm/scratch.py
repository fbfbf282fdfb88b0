"""Intermediate tables of one operator call, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.session import shared_folder


class Scratch:
    """Tables below one new folder of the shared checkpoint folder.

    A kept table survives the loss of executors and ends the lineage. ``drop`` removes a table that
    nothing reads any more; what the returned result still reads stays.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = shared_folder(spark, label)
        self._tables = 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows, written once and read back."""
        self._tables += 1
        path = self.path(f"{name}-{self._tables}")
        df.write.option("compression", "zstd").parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        read._scratch_path = path
        return read

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
