"""Rows of CSV files whose quoted cells may hold line breaks, read over many tasks.

Whether a line starts inside quotes depends on all lines before it. So each line becomes a table from the
state in which it is entered to the state in which it is left (outside or inside quotes). Such tables
compose: the state after a line is that of the last line that ends alike from both entries, turned over
by each line since then that swaps them. Both are running values over consecutive ranges of lines, so
a file of any size is spread over tasks, and only rows of several lines are put together.
"""

from __future__ import annotations

import csv
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tracemill.functions.ordered import BUCKET_ROWS, order_bucket, previous, running
from tracemill.session import written
from tracemill.sources.recordings import read_lines

# The longest cell that is read, in characters. A row of several lines that is longer than a whole
# table of such cells is reported and not put together.
LONGEST_CELL = 131_072
LONGEST_ROW = 64 * LONGEST_CELL
QUOTING = "malformed quoting"
ENCODING = "invalid UTF-8"
TOO_LONG = "cell is longer than 131072 characters"

# Whole cells with their commas, entered outside quotes. Signs behind a closing quote belong to the cell.
_CELLS = re.compile(r'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|),)*+')
_OPEN = re.compile(r'"[^"]*+(?:""[^"]*+)*+\Z')
_CLOSING = re.compile(r'[^"]*+(?:""[^"]*+)*+')


def ends_inside(text: str, inside: bool) -> bool:
    """Whether a line, entered inside or outside quotes, is left inside quotes."""
    begin = 0
    if inside:
        begin = _CLOSING.match(text).end()
        if begin == len(text):
            return True
        begin = text.find(",", begin + 1) + 1
        if not begin:
            return False
    return _OPEN.match(text, _CELLS.match(text, begin).end()) is not None


@F.pandas_udf(T.IntegerType())
def _exits(text: pd.Series) -> pd.Series:
    """Bit 0: left inside if entered outside. Bit 1: left inside if entered inside."""
    return text.map(lambda t: ends_inside(t, False) + 2 * ends_inside(t, True)).astype("int32")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cells(text: pd.Series) -> pd.Series:
    """The cells of one row; null if its quotes are wrong."""
    def parsed(row: str) -> list[str] | None:
        try:
            (found,) = csv.reader([row], strict=True)
        except (csv.Error, ValueError):
            return None
        return found

    return text.map(parsed)


def _units(lines: DataFrame) -> DataFrame:
    """Lines, cut once more behind carriage returns that stand alone: these end rows, too."""
    lone = F.col("value").rlike(r"\r(?!\z)")
    parts = F.when(lone, F.split("value", r"(?<=\r)(?!\z)")).otherwise(F.array("value"))
    cut = lines.select("recording", "pos", F.posexplode(parts).alias("sub", "text"), F.size(parts).alias("_n"))
    return cut.withColumn("broken", F.col("sub") + 1 == F.col("_n")).drop("_n").withColumn(
        "exits", F.when(F.col("text").contains('"'), _exits("text")).otherwise(F.lit(2)))


def _joined_rows(units: DataFrame, range_rows: int) -> DataFrame:
    """Rows of files in which a cell holds line breaks: ``(recording, pos, sub, text)``; long ones have no text."""
    order, ranges = [F.col("pos"), F.col("sub")], ["_range"]
    out, in_ = F.col("exits") % 2, F.floor(F.col("exits") / 2)
    ranged = units.withColumn("_range", order_bucket("pos", range_rows))
    turned = running(ranged, ["recording"], order, ranges, {"_swaps": ("sum", F.when((out == 1) & (in_ == 0), 1))})
    # A line that ends alike from both entries fixes the state; later swaps turn it over.
    fixed = F.when(out == in_, F.struct("pos", "sub", ((out + F.col("_swaps")) % 2).alias("state")))
    # Each running value reads its input twice, so what several are built on is written once.
    known = written(running(turned, ["recording"], order, ranges, {"_fixed": ("max", fixed)}).withColumn(
        "inside", (F.coalesce(F.col("_fixed.state"), F.lit(0)) + F.col("_swaps")) % 2 == 1).drop("_swaps", "_fixed"), "csv-states")
    entered = previous(known, ["recording"], order, ranges, {"within": F.col("inside")})
    begins = F.when(~F.coalesce("within", F.lit(False)), F.struct("pos", "sub"))
    placed = running(entered, ["recording"], order, ranges, {"_row": ("max", begins)})
    slim = written(placed.select("recording", "_row", "pos", "sub", "broken", "text",
                                 (F.coalesce("within", F.lit(False)) | F.col("inside")).alias("several")), "csv-rows")
    single = slim.filter(~F.col("several")).select("recording", "pos", "sub", "text")
    several = slim.filter("several").withColumn("text", F.when(F.col("broken"), F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    sizes = several.groupBy("recording", "_row").agg(F.sum(F.length("text")).alias("_size"))
    long = sizes.filter(F.col("_size") > LONGEST_ROW)
    parts = F.array_sort(F.collect_list(F.struct("pos", "sub", "text")))
    # The last line break ends the row and does not belong to it.
    whole = F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["text"]), ""), r"\n\z", "")
    joined = several.join(long, ["recording", "_row"], "left_anti").groupBy("recording", "_row").agg(whole.alias("text"))
    return single.unionByName(joined.select("recording", "_row.pos", "_row.sub", "text")).unionByName(
        long.select("recording", "_row.pos", "_row.sub", F.lit(None).cast("string").alias("text")))


def csv_rows(lines: DataFrame, range_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(path, pos, sub, cells, problem)`` per row of the files that ``lines`` come from.

    ``lines``: (recording, pos, value) with line breaks taken off; ``pos`` 0 is a file's first line.
    (pos, sub) orders the rows and names the line where a row begins. A blank line is a row without
    cells. ``cells`` is null and ``problem`` tells why where a row cannot be read.
    """
    units = written(_units(lines), "csv-lines")
    # Only a line that leaves its cell open can begin a row of several lines.
    spanning = units.filter("exits % 2 = 1").select("recording").distinct()
    plain = units.join(spanning, "recording", "left_anti").select("recording", "pos", "sub", "text")
    rows = plain.unionByName(_joined_rows(units.join(spanning, "recording", "left_semi"), range_rows))
    bare = F.regexp_replace("text", r"\r\z", "")
    valid = F.is_valid_utf8("text")
    cells = (F.when(F.col("text").isNull() | ~valid, None)
             .when(F.col("text").contains('"'), _cells(F.when(F.col("text").contains('"') & valid, bare).otherwise("")))
             .when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, ",", -1)))
    read = rows.select(F.col("recording").alias("path"), "pos", "sub", "text", cells.alias("cells"))
    longest = F.coalesce(F.array_max(F.transform("cells", lambda c: F.length(c))), F.lit(0))
    return read.select("path", "pos", "sub", F.when(longest <= LONGEST_CELL, F.col("cells")).alias("cells"), F.when(
        F.col("text").isNull() | (longest > LONGEST_CELL), TOO_LONG).when(~valid, ENCODING).when(
        F.col("cells").isNull(), QUOTING).alias("problem"))


def _from_zero(lines: DataFrame) -> DataFrame:
    """Lines whose positions begin with 0 in each file; small files may share a partition of the scan."""
    first = lines.groupBy("recording").agg(F.min("pos").alias("_first"))
    return lines.join(first, "recording").select("recording", (F.col("pos") - F.col("_first")).alias("pos"), "value")


def read_csv_rows(spark: SparkSession, path: str | list[str], range_rows: int = BUCKET_ROWS, **options: str) -> DataFrame:
    """Rows of the given files. A file without any byte has no row."""
    return csv_rows(_from_zero(read_lines(spark, path, **options)), range_rows)


def read_csv_tree(spark: SparkSession, root: str, pattern: str = "*.csv", range_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows of all files below a folder whose names fit a pattern, in one scan."""
    return read_csv_rows(spark, root, range_rows, recursiveFileLookup="true", pathGlobFilter=pattern)


def empty_files(paths: DataFrame) -> DataFrame:
    """A row without cells, the empty header, for each path of a file without any byte."""
    return paths.selectExpr("path", "0L AS pos", "0 AS sub", "CAST(array() AS ARRAY<STRING>) AS cells",
                            "CAST(NULL AS STRING) AS problem")
