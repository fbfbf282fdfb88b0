"""CSV captures, feature tables and labels, JSON documents and file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tracemill.schemas import FILE_MANIFEST, PLAN_RUN, RUN_MANIFEST
from tracemill.sources import byte_ranges
from tracemill.sources.split_csv import read_csv_rows

# Fixed values of the published files.
CAPTURE_COLUMNS = (
    "TS", "PID", "TYPE", "FLAG", "PATTERN", "OPEN", "CREATE", "DELETE", "ENCRYPT", "FILENAME",
)
KIND_CODES = "OCDE"
FEATURE_NAME = r"^([OCDE]_(max|sum)|P_(max|sum)|[OCDE]{3})\z"


def whole_number(text: str) -> str:
    """SQL for a cell holding a non-negative 64-bit integer, ``1.0`` included; null if it does not."""
    value = f"TRY_CAST(trim({text}) AS DECIMAL(38,18))"
    # The cast rounds to 18 places, so a longer fraction is told by its digits.
    plain = f"({text} RLIKE '[eE]' OR NOT {text} RLIKE '[.][0-9]*[1-9]')"
    return (
        f"CASE WHEN {plain} AND {value} = floor({value}) AND {value} BETWEEN 0 AND 18446744073709551615BD"
        f" THEN CAST({value} AS DECIMAL(20,0)) END"
    )


HEADER = "empty schema or duplicate columns"
WIDTH = "malformed row width"
NUMBER = "expected a nonnegative 64-bit integer"
KIND = "unknown event type"
REPEATED = "duplicate identifier"
SCHEMAS = {kind: f"unexpected {kind} schema" for kind in ("capture", "feature", "label")}


def _with_header(rows: DataFrame) -> DataFrame:
    """Every row beside its file's header; one header per file is joined."""
    header = rows.filter("pos = 0 AND sub = 0").select("path", F.col("cells").alias("header"))
    return rows.join(header, "path", "left")


def _header_problem(kind: str) -> str:
    """SQL for what is wrong with ``header``, else null."""
    fits = {
        "capture": f"header = array({', '.join(map(repr, CAPTURE_COLUMNS))})",
        "feature": f"get(header, 0) = 'PID' AND size(header) > 1 AND forall(slice(header, 2, size(header)), n -> n RLIKE r'{FEATURE_NAME}')",
        "label": "header = array('PID')",
    }[kind]
    return (f"CASE WHEN size(header) < 1 OR size(array_distinct(header)) < size(header) THEN '{HEADER}'"
            f" WHEN header IS NOT NULL AND NOT ({fits}) THEN '{SCHEMAS[kind]}' END")


def _checked(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with ``violations``: of the file's schema at its first row, else of the row itself."""
    numbers = "slice(cells, 1, size(cells) - 1)" if kind == "capture" else "cells"
    rules = [
        ("problem IS NOT NULL", "problem"), (f"problem IS NULL AND pos = 0 AND sub = 0 AND {_header_problem(kind)} IS NOT NULL", _header_problem(kind)),
        ("size(cells) <> size(header)", f"'{WIDTH}'"),
        (f"NOT _first AND size(cells) = size(header) AND exists({numbers}, c -> {whole_number('c')} IS NULL)", f"'{NUMBER}'"),
    ]
    if kind == "capture":
        rules.append((f"NOT _first AND {whole_number('get(cells, 2)')} > 3", f"'{KIND}'"))
    listed = ", ".join(f"IF({test}, {message}, NULL)" for test, message in rules)
    return _with_header(rows).withColumn("_first", F.expr("pos = 0 AND sub = 0")).selectExpr(
        "path", "pos", "sub", "cells", "header", "_first", f"array_compact(array({listed})) AS violations")


def capture_events(rows: DataFrame) -> DataFrame:
    """Capture events in row order with ``violations``, from rows of ``split_csv``.

    A good header is left out; one that is not exactly the published one is a row with that violation.
    """
    number = {name: whole_number(f"get(cells, {at})") for at, name in enumerate(CAPTURE_COLUMNS)}
    return _checked(rows, "capture").filter("NOT _first OR size(violations) > 0").selectExpr(
        "path", "pos AS row", "sub AS part", f"{number['TS']} AS ts", f"{number['PID']} AS pid",
        f"CASE WHEN {number['TYPE']} <= 3 THEN substring('{KIND_CODES}', int({number['TYPE']}) + 1, 1) ELSE '' END AS kind",
        f"{number['PATTERN']} AS pattern", "violations")


def read_captures(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Capture events of CSV files; quoted names may hold line breaks, and a file is read by many tasks."""
    return capture_events(read_csv_rows(spark, path))


def feature_cells(rows: DataFrame) -> DataFrame:
    """Wide feature files in long form: ``path``, ``pid``, ``position``, ``feature``, ``value``.

    Rows with violations are left out; ``file_violations`` lists them.
    """
    good = _checked(rows, "feature").filter("size(violations) = 0")
    cells = good.filter("NOT _first").selectExpr(
        "path", f"{whole_number('get(cells, 0)')} AS pid", "posexplode(slice(arrays_zip(header, cells), 2, size(header))) AS (at, c)")
    return cells.selectExpr("path", "pid", "at + 1 AS position", "c.header AS feature", f"{whole_number('c.cells')} AS value")


def label_ids(rows: DataFrame) -> DataFrame:
    """``path`` and ``pid`` of the label files' good rows."""
    return _checked(rows, "label").filter("size(violations) = 0 AND NOT _first").selectExpr(
        "path", f"{whole_number('get(cells, 0)')} AS pid")


def file_violations(rows: DataFrame, kind: str) -> DataFrame:
    """``(path, row, part, violation)`` of capture, feature or label files.

    ``row`` and ``part`` name the line where the row begins. A repeated identifier is reported at each
    of its rows; a file whose header is missing altogether at row 0.
    """
    checked = _checked(rows, kind)
    found = checked.selectExpr("path", "pos AS row", "sub AS part", "explode(violations) AS violation")
    if kind == "capture":
        return found
    ids = checked.filter("size(violations) = 0 AND NOT _first").selectExpr(
        "path", "pos AS row", "sub AS part", f"{whole_number('get(cells, 0)')} AS pid")
    # A count per identifier is combined before the shuffle; only repeated ones are joined back.
    twice = ids.groupBy("path", "pid").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1").drop("uses")
    return found.unionByName(ids.join(twice, ["path", "pid"], "left_semi").select(
        "path", "row", "part", F.lit(REPEATED).alias("violation")))


def duplicate_ids(ids: DataFrame, *keys: str) -> DataFrame:
    return ids.groupBy(*keys).agg(F.count("*").alias("uses")).filter("uses > 1")


def read_file_manifest(spark: SparkSession, path: str) -> DataFrame:
    shape = T.StructType([
        T.StructField("schema_version", T.LongType()),
        T.StructField("repository", T.StringType()),
        T.StructField("commit", T.StringType()),
        T.StructField("files", T.ArrayType(FILE_MANIFEST)),
    ])
    return spark.read.json(path, schema=shape, multiLine=True).select(
        "schema_version", "repository", "commit", F.explode("files").alias("f")
    ).select("schema_version", "repository", "commit", "f.*")


def file_manifest_violations(manifest: DataFrame) -> DataFrame:
    """``(subject, violation)`` of file manifests as ``read_file_manifest`` gives them.

    A manifest is named by its repository, a file by its path. Rules of a manifest: the known schema version,
    a repository at an https address, a full commit. Of a file: a path inside the checkout, a SHA-256, a size.
    """
    def listed(rows: DataFrame, subject: str, rules: list[tuple[str, str]]) -> DataFrame:
        tests = ", ".join(f"IF(coalesce({good}, false), NULL, '{message}')" for message, good in rules)
        return rows.selectExpr(f"{subject} AS subject", f"explode(array_compact(array({tests}))) AS violation")

    whole = manifest.select("schema_version", "repository", "commit").distinct()
    return listed(whole, "repository", [
        ("schema_version is not the known one", "schema_version = 1"),
        ("repository is no https address", "repository RLIKE '^https://[^/?#]+'"),
        ("commit is not 40 hex digits", "lower(trim(commit)) RLIKE '^[0-9a-f]{40}$'"),
    ]).unionByName(listed(manifest, "path", [
        ("path leaves the checkout", "NOT (startswith(path, '/') OR array_contains(split(path, '/'), '..'))"),
        ("sha256 is not 64 hex digits", "lower(sha256) RLIKE '^[0-9a-f]{64}$'"),
        ("size is no number from 0 up", "size >= 0"),
    ]))


def read_run_manifests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One JSON document per run."""
    return spark.read.json(path, schema=RUN_MANIFEST, multiLine=True)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    shape = T.StructType([
        T.StructField("schema_version", T.LongType()),
        T.StructField("experiment", T.StringType()),
        T.StructField("runs", T.ArrayType(PLAN_RUN)),
    ])
    return spark.read.json(path, schema=shape, multiLine=True).select(
        "experiment", F.explode("runs").alias("r")).select("experiment", "r.*")


def plan_differences(plan: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows found in only one of two plans; empty when they are equal."""
    return plan.exceptAll(expected).withColumn("found_in", F.lit("plan")).unionByName(
        expected.exceptAll(plan).withColumn("found_in", F.lit("expected")))


def file_inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Relative path, size and SHA-256 of every file below ``root``.

    Files of any size are read in bounded chunks. In a store that only Spark opens, each file is one row of
    its binary source: files must be below 2 GiB there, and empty ones are not listed.
    """
    if byte_ranges.readable(root):
        found = byte_ranges.whole_files(spark, root, pattern)
    else:
        found = _binary_files(spark, root, pattern).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return found.select("path", F.col("size").alias("actual_size"), F.col("sha256").alias("actual_sha256"))


def _binary_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    base = root.rstrip("/") + "/"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", pattern).load(root).withColumn("path", F.substring_index("path", base, -1))


def file_listing(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """Relative paths and sizes only; file contents are not read."""
    return _binary_files(spark, root, pattern).select("path", F.col("length").alias("size"))


def unlisted_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    return listing.join(manifest.select("path"), "path", "left_anti")
