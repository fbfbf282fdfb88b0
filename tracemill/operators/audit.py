"""Rebuild of the older per-process feature table and its comparison with a published one.

Capture events carry ``split``, ``capture_id``, ``capture_index``, ``row``, ``ts``, ``pid``,
``kind`` and ``pattern``. Captures of a split are numbered by path; a capture without events keeps
its number, because numbers come from the manifest.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window, functions as F

from tracemill.functions.ordered import BUCKET_ROWS, order_bucket, previous, trigram_profile
from tracemill.operators.serving import side_by_side

# Fixed values of the published feature table.
PERIOD_NS = 1_000_000_000
PID_OFFSET = 10_000
KINDS = ("O", "C", "D", "E")
GRAMS = tuple("".join(letters) for letters in product(sorted(KINDS), repeat=3))
STATISTICS = tuple(f"{kind}_{stat}" for kind in sorted(KINDS) for stat in ("max", "sum"))
PATTERNS = ("P_max", "P_sum")
COLUMNS = STATISTICS + PATTERNS + GRAMS


def number_captures(manifest: DataFrame) -> DataFrame:
    """``capture_index`` per split in path order: one small row per file, never per event."""
    return manifest.withColumn(
        "capture_index", F.row_number().over(Window.partitionBy("split").orderBy("path")) - 1)


def adjust_ids(events: DataFrame) -> DataFrame:
    """Shift process ids by capture number; ids of different captures may collide."""
    return events.withColumn("adjusted_id", F.expr(f"pid + {PID_OFFSET} * capture_index"))


def with_periods(events: DataFrame, period_ns: int = PERIOD_NS) -> DataFrame:
    """Add ``period``: distance to the first event of the split, truncated toward zero."""
    origin = events.groupBy("split").agg(
        F.min_by("ts", F.struct("capture_index", "row")).alias("_origin"))
    return events.join(origin, "split").withColumn(
        "period", F.expr(f"(ts - _origin) div {period_ns}")).drop("_origin")


def period_statistics(periods: DataFrame) -> DataFrame:
    """Peak and total per kind, ``P_max`` and ``P_sum`` per adjusted id.

    Absent kinds of a period add nothing to its pattern sum, so the zero they stand for is one of
    the values the maximum is taken over.
    """
    ordered = sorted(KINDS)
    per_period = periods.groupBy("split", "adjusted_id", "period").agg(
        *[F.expr(f"count_if(kind = '{k}') AS _n{k}") for k in ordered],
        *[F.expr(f"coalesce(sum(IF(kind = '{k}', pattern, NULL)), 0) AS _p{k}") for k in ordered],
    )
    peaks = " + ".join(f"max(_p{k})" for k in ordered)
    totals = " + ".join(f"sum(_p{k})" for k in ordered)
    return per_period.groupBy("split", "adjusted_id").agg(
        *[F.expr(f"{function}(_n{k}) AS {k}_{name}") for k in ordered
          for function, name in (("max", "max"), ("sum", "sum"))],
        F.expr(f"{peaks} AS P_max"), F.expr(f"{totals} AS P_sum"),
    )


def row_trigrams(events: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Trigrams in row order, across the captures an adjusted id collides in."""
    ranged = events.select(
        "split", "adjusted_id", "capture_index", "row", "kind",
        order_bucket("row", bucket_rows).alias("_range"))
    profile = trigram_profile(
        ranged, ["split", "adjusted_id"], [F.col("capture_index"), F.col("row")],
        ["capture_index", "_range"], "kind", sorted(KINDS))
    return profile.select("split", "adjusted_id", *GRAMS)


def rebuild_features(
    events: DataFrame, period_ns: int = PERIOD_NS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Every possible feature column per split and adjusted id."""
    adjusted = adjust_ids(events)
    return period_statistics(with_periods(adjusted, period_ns)).join(
        row_trigrams(adjusted, bucket_rows), ["split", "adjusted_id"])


def observed_features(wide: DataFrame) -> DataFrame:
    """Feature names that occur in a split: one row per split and name, in column order."""
    kept = [F.expr(f"IF(max({k}_sum) > 0, array('{k}_max', '{k}_sum'), array())") for k in sorted(KINDS)]
    grams = [F.expr(f"IF(max({gram}) > 0, array('{gram}'), array())") for gram in GRAMS]
    names = F.concat(*kept, F.array(*[F.lit(name) for name in PATTERNS]), *grams)
    return wide.groupBy("split").agg(names.alias("_names")).select(
        "split", F.posexplode("_names").alias("position", "feature"))


def long_features(wide: DataFrame) -> DataFrame:
    """Canonical long form: one row per id and occurring feature, zeros included."""
    cells = wide.unpivot(["split", "adjusted_id"], list(COLUMNS), "feature", "value")
    return cells.join(observed_features(wide), ["split", "feature"]).select(
        "split", F.col("adjusted_id").alias("pid"), "position", "feature", "value")


def wide_features(wide: DataFrame, split: str) -> DataFrame:
    """The published shape of one split: absent kinds and trigrams have no column."""
    part = wide.filter(F.col("split") == split)
    # At most one name per possible column comes to the driver.
    names = [row["feature"] for row in observed_features(part).orderBy("position").collect()]
    return part.select(F.col("adjusted_id").alias("PID"), *(names or PATTERNS))


def capture_summary(
    captures: DataFrame, events: DataFrame, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Events, distinct ids, encryption events and timestamp regressions per capture."""
    keys = ["split", "capture_id"]
    ranged = events.withColumn("_range", order_bucket("row", bucket_rows))
    stepped = previous(ranged, keys, [F.col("row")], ["_range"], {"_earlier": F.col("ts")})
    counted = stepped.groupBy(*keys).agg(
        F.count("*").alias("events"),
        F.count_if(F.col("kind") == "E").alias("encryption_events"),
        F.count_if(F.col("ts") < F.col("_earlier")).alias("timestamp_regressions"),
    )
    ids = recorded_ids(events).groupBy(*keys).agg(
        F.count("*").alias("recorded_ids"), F.min("pid").alias("lowest_id"), F.max("pid").alias("highest_id"))
    return (
        captures.select(*keys, F.expr(f"{PID_OFFSET} * capture_index").alias("offset"))
        .join(counted, keys, "left").join(ids, keys, "left")
        .fillna(0, ["events", "encryption_events", "timestamp_regressions", "recorded_ids"])
    )


def recorded_ids(events: DataFrame) -> DataFrame:
    """Ids of each capture with their adjusted form, one row each."""
    return adjust_ids(events).select("split", "capture_id", "pid", "adjusted_id").distinct()


def id_collisions(events: DataFrame) -> DataFrame:
    """Capture identities that share an adjusted id."""
    identities = recorded_ids(events)
    shared = identities.groupBy("split", "adjusted_id").agg(F.count("*").alias("identities")).filter(
        "identities > 1")
    return identities.join(shared, ["split", "adjusted_id"])


def label_join(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Exact id join of feature ids and labels; one row per id with its status.

    An id without a label is unknown. It is never treated as benign.
    """
    known = features.select("split", "pid").distinct().withColumn("_feature", F.lit(True))
    listed = labels.select("split", "pid").distinct().withColumn("_label", F.lit(True))
    return known.join(listed, ["split", "pid"], "full_outer").select(
        "split", "pid",
        F.when(F.col("_feature") & F.col("_label"), "matched")
        .when(F.col("_label"), "unmatched_label").otherwise("unknown_feature_id").alias("status"))


def label_regression(joined: DataFrame, labels: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare matched and listed label counts with an expected pair per split."""
    matched = joined.groupBy("split").agg(F.count_if(F.col("status") == "matched").alias("matched"))
    listed = labels.groupBy("split").agg(F.count("*").alias("total"))
    return expected.join(matched, "split", "left").join(listed, "split", "left").fillna(
        0, ["matched", "total"]).select(
        "*", ((F.col("matched") == F.col("expected_matches"))
              & (F.col("total") == F.col("expected_labels"))).alias("match"))


def feature_differences(supplied: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Every difference of two long tables (``split``, ``pid``, ``position``, ``feature``, ``value``).

    Rows: differing cells, ids or columns on one side only, and a differing column order.
    """
    key = ["split", "pid", "feature"]
    left = supplied.select(*key, F.col("value").alias("supplied"))
    right = rebuilt.select(*key, F.col("value").alias("reconstructed"))
    cells = left.join(right, key).filter(~F.col("supplied").eqNullSafe(F.col("reconstructed"))).select(
        "split", F.lit("cell").alias("kind"), "pid", "feature", "supplied", "reconstructed")

    def one_sided(first: DataFrame, second: DataFrame, column: str, kind: str) -> DataFrame:
        only = first.select("split", column).distinct().join(
            second.select("split", column).distinct(), ["split", column], "left_anti")
        return only.select("split", F.lit(kind).alias("kind"), column)

    def layout(table: DataFrame, name: str) -> DataFrame:
        columns = table.select("split", "position", "feature").distinct()
        return columns.groupBy("split").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("position", "feature"))), lambda c: c["feature"]), ",").alias(name))

    moved = layout(supplied, "_a").join(layout(rebuilt, "_b"), "split").filter("_a <> _b").select(
        "split", F.lit("column_order_differs").alias("kind"))
    parts = [
        cells,
        one_sided(supplied, rebuilt, "pid", "missing_reconstructed_ids"),
        one_sided(rebuilt, supplied, "pid", "extra_reconstructed_ids"),
        one_sided(supplied, rebuilt, "feature", "missing_reconstructed_columns"),
        one_sided(rebuilt, supplied, "feature", "extra_reconstructed_columns"),
        moved,
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def inventory_status(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Manifest rows against found files: either recorded (hash, size) pair is a match."""
    frozen = (F.col("actual_sha256") == F.col("sha256")) & (F.col("actual_size") == F.col("size"))
    blob = (F.col("actual_sha256") == F.col("git_blob_sha256")) & (F.col("actual_size") == F.col("git_blob_size"))
    return manifest.join(inventory, "path", "left").select(
        "*",
        F.when(F.col("actual_sha256").isNull(), "unavailable")
        .when(F.coalesce(frozen | blob, F.lit(False)), "match").otherwise("mismatch").alias("status"),
        F.when(frozen, "frozen_checkout").when(blob, "git_blob").alias("byte_representation"),
    )


def verification_status(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """``missing``, ``mismatch`` or ``match``; a wrong size hides the found hash."""
    same_size = F.col("actual_size") == F.col("size")
    return manifest.select("path", F.lower("sha256").alias("expected_sha256"), "size").join(
        inventory, "path", "left").select(
        "path",
        F.when(F.col("actual_size").isNull(), "missing").when(~same_size, "mismatch")
        .when(F.col("actual_sha256") == F.col("expected_sha256"), "match").otherwise("mismatch").alias("status"),
        "expected_sha256", F.when(same_size, F.col("actual_sha256")).alias("actual_sha256"),
    )


def content_overlap(inventory: DataFrame) -> DataFrame:
    """Captures whose exact content occurs in the training and the testing split.

    One row per file with the number of partners on the other side, so that many copies of one
    content stay linear in the number of files.
    """
    captures = inventory.filter((F.col("kind") == "capture") & F.col("actual_sha256").isNotNull())
    shared = captures.groupBy("actual_sha256").agg(
        F.count_if(F.col("split") == "training").alias("_train"),
        F.count_if(F.col("split") == "testing").alias("_test"),
    ).filter("_train > 0 AND _test > 0")
    return captures.join(shared, "actual_sha256").filter(F.col("split").isin("training", "testing")).select(
        F.col("actual_sha256").alias("sha256"), "split", "path",
        F.when(F.col("split") == "training", F.col("_test")).otherwise(F.col("_train")).alias("partners"))


def audit_verdict(
    inventory: DataFrame, unlisted: DataFrame, regressions: DataFrame,
    differences: DataFrame, overlap: DataFrame, collisions: DataFrame, splits: DataFrame | None = None,
) -> DataFrame:
    """One row: each check of the audit and whether all of them hold. ``splits`` may tell invalid ones."""
    def count(df: DataFrame, name: str, condition: str = "true") -> DataFrame:
        return df.agg(F.count_if(F.expr(condition)).alias(name))

    checks = [
        count(inventory, "input_mismatches", "status <> 'match'"),
        count(unlisted, "unmanifested_files"),
        count(regressions, "label_regressions", "NOT match"),
        count(differences, "feature_differences"),
        count(overlap, "overlapping_captures"),
        count(collisions, "colliding_identities"),
        *([count(splits, "invalid_splits", "status <> 'audited'")] if splits is not None else []),
    ]
    names = [item.columns[0] for item in checks]
    return side_by_side(checks).select(*names, F.expr(" + ".join(names) + " = 0").alias("ok"))
