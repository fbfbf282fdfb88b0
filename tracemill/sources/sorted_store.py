"""Rows stored in one global order, so that a page costs as much far behind as at the front.

Rows are written once in ranges of bounded size, each sorted and numbered. An index with one row per
range holds its first and last key and the number of rows before it. A page by offset reads the one or
two ranges that hold it; a page behind a key finds its range by the key. Only the page is returned,
and only index rows of the ranges in question reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracemill.operators.serving import check_page
from tracemill.sources.commits import VersionedTable

ROWS_PER_PART = 1 << 20
# Rows that one task sorts and cuts into parts, where parts are smaller.
TASK_ROWS = 1 << 17
# Parts of one task have consecutive numbers below this distance.
_STRIDE = 1 << 20


@dataclass(frozen=True)
class SortedStore:
    """A table below ``root``, ordered by ``order``: pairs of a column and whether it falls.

    The columns together tell rows apart; none is null. A later ``write`` replaces what readers see.
    """

    root: str
    order: tuple[tuple[str, bool], ...]
    rows_per_part: int = ROWS_PER_PART

    def _sorting(self) -> list[Column]:
        return [F.desc(name) if falls else F.asc(name) for name, falls in self.order]

    @property
    def _keys(self) -> list[str]:
        return [name for name, _ in self.order]

    def write(self, rows: DataFrame) -> None:
        """Sort, number and index the rows; readers see all of it at once, or what was there before."""
        spark = rows.sparkSession

        def fill(folder: str) -> None:
            rows.write.parquet(f"{folder}/unsorted")
            stored = spark.read.schema(rows.schema).parquet(f"{folder}/unsorted")
            # The driver keeps a record of every task, so a task writes as many parts as it can sort.
            tasks = max(1, -(-stored.count() // max(self.rows_per_part, TASK_ROWS)))
            sorted_ = stored.repartitionByRange(tasks, *self._sorting()).sortWithinPartitions(*self._sorting())
            numbered = sorted_.withColumns({
                "part": F.spark_partition_id(), "at": F.expr("monotonically_increasing_id() & 8589934591")})
            placed = numbered.withColumns({
                "part": F.col("part").cast("bigint") * _STRIDE + F.expr(f"at div {self.rows_per_part}"),
                "at": F.expr(f"at % {self.rows_per_part}")}).sortWithinPartitions("part", "at")
            placed.write.partitionBy("part").parquet(f"{folder}/rows")
            key = F.struct(*self._keys)
            counted = spark.read.parquet(f"{folder}/rows").groupBy("part").agg(
                F.count(F.lit(1)).alias("n"), F.min_by(key, "at").alias("low"), F.max_by(key, "at").alias("high"))
            # One row per range of rows.
            earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
            counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).coalesce(1).write.parquet(f"{folder}/index")

        VersionedTable(self.root).replace(spark, fill, leftover="unsorted")

    def _folder(self, spark: SparkSession) -> str:
        return VersionedTable(self.root).published(spark)

    def index(self, spark: SparkSession) -> DataFrame:
        """``(part, n, low, high, before)`` per range."""
        return spark.read.parquet(f"{self._folder(spark)}/index")

    def rows(self, spark: SparkSession) -> int:
        return self.index(spark).agg(F.sum("n")).first()[0] or 0

    def _behind(self, column, key: dict) -> Column:
        """Whether a row comes after ``key``. ``column`` gives the row's value of a name."""
        behind = F.lit(False)
        for name, falls in reversed(self.order):
            value = F.lit(key[name])
            behind = (column(name) < value if falls else column(name) > value) | ((column(name) == value) & behind)
        return behind

    def _between(self, spark: SparkSession, low: int, high: int) -> DataFrame:
        """The rows at positions from ``low`` to below ``high``, with ``position``, in order."""
        parts = self.index(spark).filter((F.col("before") < high) & (F.col("before") + F.col("n") > low)).select(
            "part", "before").collect()  # as many as a page spans
        folder = self._folder(spark)
        if not parts:
            return spark.read.parquet(f"{folder}/rows").limit(0).drop("part", "at").withColumn("position", F.lit(0).cast("bigint"))
        # Only the folders of these ranges are listed and opened.
        stored = spark.read.option("basePath", f"{folder}/rows").parquet(*[f"{folder}/rows/part={r.part}" for r in parts])
        before = F.coalesce(*[F.when(F.col("part") == r.part, F.lit(r.before)) for r in parts])
        reach = F.lit(False)
        for r in parts:  # the smallest and largest position of a row group tell whether it is read
            reach |= (F.col("part") == r.part) & (F.col("at") >= low - r.before) & (F.col("at") < high - r.before)
        return stored.filter(reach).withColumn("position", F.col("at") + before).drop("part", "at").orderBy("position")

    def page(self, spark: SparkSession, limit: int = 50, offset: int = 0) -> DataFrame:
        """``limit`` rows from ``offset`` on."""
        check_page(limit, offset)
        return self._between(spark, offset, offset + limit)

    def after(self, spark: SparkSession, key: dict, limit: int = 50) -> DataFrame:
        """``limit`` rows behind ``key``, which need not be stored."""
        check_page(limit, 0)
        if set(key) != set(self._keys):
            raise ValueError(f"a key needs {', '.join(self._keys)}")
        first = self.index(spark).filter(self._behind(lambda n: F.col(f"high.{n}"), key)).orderBy("part").select(
            "part", "before").first()
        if first is None:
            return self._between(spark, 0, 0)
        inside = spark.read.parquet(f"{self._folder(spark)}/rows/part={first.part}")
        begin = inside.filter(self._behind(F.col, key)).agg(F.min("at")).first()[0]
        return self._between(spark, first.before + begin, first.before + begin + limit)
