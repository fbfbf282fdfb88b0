"""Labelled training rows: construction, leakage rules, summaries and content digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracemill.functions.json_text import (
    is_digest, json_array, json_boolean, json_double, json_string,
)
from tracemill.schemas import FEATURE_VERSION, FEATURES, PROCESS
from tracemill.session import written

# Fixed values of the controlled experiment.
SCENARIOS = {
    "copying": "benign",
    "archiving": "benign",
    "compression": "benign",
    "small-build": "benign",
    "bulk-editing": "benign",
    "rapid-generated-file-replacement": "suspicious",
    "create-delete-churn": "suspicious",
    "paced-replacement": "suspicious",
}
SPLIT_BY_SEED = {11: "training", 23: "training", 37: "training", 41: "validation", 53: "test"}
LABELS = {"benign": 0, "suspicious": 1}
SPLITS = ("training", "validation", "test")
CAPTURE_SECONDS = 60.0
HOLD_SECONDS = 50.0
LIMITS = {"max_seconds": 15.0, "max_files": 256, "max_bytes": 16 * 1024 * 1024}
ROLES = ("all", "selection", "test")

# Prefix lengths the row digests are combined along; the last one must be zero.
DIGEST_LEVELS = (6, 3, 0)


def _lookup(mapping: dict, key: Column) -> Column:
    pairs = [part for item in mapping.items() for part in (F.lit(item[0]), F.lit(item[1]))]
    return F.element_at(F.create_map(*pairs), key)


def split_for_seed(seed: str | Column) -> Column:
    """Split of a seed; null for a seed outside the plan."""
    seed = F.col(seed) if isinstance(seed, str) else seed
    return _lookup(SPLIT_BY_SEED, seed.cast("int"))


def experiment_plan(spark: SparkSession) -> DataFrame:
    """The forty planned runs, in plan order."""
    scenarios = spark.createDataFrame(
        [(index, name, label) for index, (name, label) in enumerate(SCENARIOS.items())],
        "scenario_order int, scenario string, behavior_label string")
    seeds = F.explode(F.array(*[F.lit(seed) for seed in SPLIT_BY_SEED]))
    return scenarios.select("*", seeds.alias("seed")).select(
        (F.col("scenario_order") * len(SPLIT_BY_SEED)
         + F.array_position(F.array(*[F.lit(s) for s in SPLIT_BY_SEED]), F.col("seed")) - 1)
        .cast("int").alias("plan_order"),
        F.format_string("controlled-%s-seed-%d", "scenario", "seed").alias("run_id"),
        F.lit("controlled_workload").alias("source"),
        "scenario",
        F.format_string("%s:seed=%d", "scenario", "seed").alias("workload_identity"),
        "seed", split_for_seed("seed").alias("split"), "behavior_label",
        F.lit("controlled_workload").alias("label_provenance"),
        F.lit(CAPTURE_SECONDS).alias("capture_duration_seconds"),
        F.lit(HOLD_SECONDS).alias("workload_hold_seconds"),
    )


def manifest_violations(manifests: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """Every broken rule of each run manifest; the plan adds the digest rule."""
    expected_split = split_for_seed("seed")
    behaviour = _lookup(SCENARIOS, F.col("scenario"))
    tracked = F.col("tracked_processes")
    identity_ok = F.forall(tracked, lambda p: (
        F.coalesce(p["boot_id"].rlike(r"\S"), F.lit(False))
        & F.coalesce(p["tgid"].between(1, 2**32 - 1), F.lit(False))
        & F.coalesce(p["start_time_ns"] >= 0, F.lit(False))))
    limits = F.lit(True)
    for name, value in LIMITS.items():
        limits = limits & (F.col(f"limits.{name}") == value)
    rules = [
        ("manifest has another schema version than 1", F.col("schema_version") == 1),
        ("run_id is empty", F.length("run_id") > 0),
        ("scenario is not one of the planned ones", behaviour.isNotNull()),
        ("seed is no integer", F.col("seed").isNotNull()),
        ("run_id is not made of scenario and seed",
         F.col("run_id") == F.format_string("controlled-%s-seed-%d", "scenario", "seed")),
        ("seed is not one of the planned ones", expected_split.isNotNull()),
        ("split is none of training, validation, test", F.col("split").isin(*SPLITS)),
        ("seed belongs to another split", F.col("split") == expected_split),
        ("behavior_label is neither benign nor suspicious", F.col("behavior_label").isin(*LABELS)),
        ("scenario has another behavior_label", F.col("behavior_label") == behaviour),
        ("label_provenance is not controlled_workload", F.col("label_provenance") == "controlled_workload"),
        ("status is not completed", F.col("status") == "completed"),
        ("workload_hold_seconds is not 50", F.col("workload_hold_seconds") == HOLD_SECONDS),
        ("background_activity is not unlabeled", F.col("background_activity") == "unlabeled"),
        ("process_scope_policy is not root_process_only",
         F.col("process_scope_policy") == "root_process_only"),
        ("limits differ from the planned ones", limits),
        ("number of tracked processes is not one", F.size(tracked) == 1),
        ("tracked process is not fully identified", identity_ok),
    ]
    if plan is not None:
        digests = plan.select("run_id", F.col("plan_sha256").alias("_planned"))
        manifests = manifests.join(digests, "run_id", "left")
        rules.append(("plan_sha256 is not that of the planned workload",
                      F.col("plan_sha256") == F.col("_planned")))
    return manifests.withColumn("violations", F.array_compact(F.array(*[
        F.when(~F.coalesce(good, F.lit(False)), F.lit(message)) for message, good in rules
    ]))).drop("_planned")


def foreign_windows(windows: DataFrame, manifests: DataFrame) -> DataFrame:
    """Windows of runs without a manifest; must be empty before rows are built."""
    return windows.join(manifests.select("run_id"), "run_id", "left_anti")


def tracked_processes(manifests: DataFrame) -> DataFrame:
    return manifests.select("run_id", F.explode("tracked_processes").alias("p")).select(
        "run_id", *[F.col(f"p.{name}").alias(name) for name in PROCESS])


def build_labelled_rows(windows: DataFrame, manifests: DataFrame, captures: DataFrame) -> DataFrame:
    """Classifiable windows of tracked processes as training rows.

    ``captures`` gives ``run_id`` and ``capture_hash``. Windows of other processes stay out: they
    are unlabelled, never benign.
    """
    meta = manifests.select("run_id", "split", _lookup(LABELS, F.col("behavior_label")).alias("label"))
    kept = windows.filter("classifiable").join(
        tracked_processes(manifests), ["run_id", *PROCESS], "left_semi")
    return kept.join(meta, "run_id").join(captures.select("run_id", "capture_hash"), "run_id").select(
        "window_id", F.col("run_id").alias("capture_id"), "capture_hash", "split", "label",
        "feature_version",
        F.expr(f"array({', '.join(map(repr, FEATURES))})").alias("feature_names"),
        F.array(*FEATURES).cast("array<double>").alias("features"),
        F.lit(True).alias("complete"), F.lit("good").alias("quality"),
    )


def recomputation_differences(supplied: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Windows that differ from a recomputation out of raw telemetry; empty when equal."""
    columns = [name for name in recomputed.columns if name in supplied.columns]
    left, right = supplied.select(*columns), recomputed.select(*columns)
    return left.exceptAll(right).withColumn("found_in", F.lit("supplied")).unionByName(
        right.exceptAll(left).withColumn("found_in", F.lit("recomputed")))


def set_completeness(planned: DataFrame, actual: DataFrame, key: str = "run_id") -> DataFrame:
    """Planned inputs that are missing and present inputs nobody planned."""
    left = planned.select(key).distinct().withColumn("_planned", F.lit(True))
    right = actual.select(key).distinct().withColumn("_actual", F.lit(True))
    return left.join(right, key, "full_outer").filter("_planned IS NULL OR _actual IS NULL").select(
        key, F.when(F.col("_planned"), "missing").otherwise("unexpected").alias("status"))


def capture_totals(rows: DataFrame) -> DataFrame:
    """Counts and value ranges per capture; equal ends of a range mean one value."""
    return rows.groupBy("capture_id").agg(
        F.count("*").alias("row_count"),
        *[function(name).alias(f"{prefix}_{name}")
          for name in ("split", "label", "capture_hash")
          for prefix, function in (("low", F.min), ("high", F.max))],
    )


def capture_consistency(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Planned runs whose rows break a rule, one row per broken rule."""
    totals = capture_totals(rows)
    planned = plan.select(
        F.col("run_id").alias("capture_id"), F.col("split").alias("_split"),
        _lookup(LABELS, F.col("behavior_label")).alias("_label"))
    shared = rows.groupBy("capture_hash").agg(
        F.min("capture_id").alias("_low"), F.max("capture_id").alias("_high")).filter("_low <> _high")
    reused = rows.join(shared, "capture_hash", "left_semi").select("capture_id").distinct()
    joined = planned.join(totals, "capture_id", "left")
    rules = [
        ("planned capture has no rows", F.col("row_count").isNull()),
        ("rows have another label or split than planned",
         (F.col("low_split") != F.col("_split")) | (F.col("high_split") != F.col("_split"))
         | (F.col("low_label") != F.col("_label")) | (F.col("high_label") != F.col("_label"))),
        ("rows of one capture have several hashes", F.col("low_capture_hash") != F.col("high_capture_hash")),
    ]
    broken = joined.select("capture_id", F.explode(F.array_compact(F.array(*[
        F.when(bad, F.lit(message)) for message, bad in rules]))).alias("violation"))
    return broken.unionByName(reused.select(
        "capture_id", F.lit("planned runs share one capture hash").alias("violation")))


def duplicate_windows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("window_id").agg(F.count("*").alias("uses")).filter("uses > 1")


def row_violations(rows: DataFrame) -> DataFrame:
    """Rules a single labelled row can break, one output row per broken rule."""
    finite = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    names = F.expr(f"array({', '.join(map(repr, FEATURES))})")
    rules = [
        ("features have another version, names or order",
         (F.col("feature_version") == FEATURE_VERSION) & (F.col("feature_names") == names)),
        ("feature values are missing or not finite", (F.size("features") == F.size("feature_names")) & finite),
        ("unknown split", F.col("split").isin(*SPLITS)),
        ("label is neither 0 nor 1", F.col("label").isin(0, 1)),
        ("window is incomplete or of poor quality", F.col("complete") & (F.col("quality") == "good")),
        ("window_id or capture_id is empty",
         (F.length("window_id") > 0) & (F.length("capture_id") > 0)),
        ("capture_hash is not 64 lower-case hex digits", is_digest(F.col("capture_hash"))),
    ]
    return rows.select("capture_id", "window_id", F.explode(F.array_remove(F.array(*[
        F.when(F.coalesce(good, F.lit(False)), F.lit("")).otherwise(F.lit(message)) for message, good in rules
    ]), "")).alias("violation"))


def leakage_violations(rows: DataFrame) -> DataFrame:
    """Functional dependencies that must hold across the whole dataset.

    ``subject`` is the capture, hash or window that breaks the rule named by ``violation``. All
    checks are minima and maxima per group, so hot captures combine before the shuffle.
    """
    totals = capture_totals(rows)
    across = [
        ("split", "capture lies in several splits"),
        ("capture_hash", "capture has several hashes"),
        ("label", "capture has several labels"),
    ]
    per_capture = totals.select(F.col("capture_id").alias("subject"), F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"low_{name}") != F.col(f"high_{name}"), F.lit(message)) for name, message in across
    ]))).alias("violation"))
    per_hash = rows.groupBy("capture_hash").agg(
        F.min("capture_id").alias("_low"), F.max("capture_id").alias("_high")
    ).filter("_low <> _high").select(
        F.col("capture_hash").alias("subject"),
        F.lit("several captures have this hash").alias("violation"))
    repeated = duplicate_windows(rows).select(
        F.col("window_id").alias("subject"), F.lit("window_id used twice").alias("violation"))
    return per_capture.unionByName(per_hash).unionByName(repeated)


def capture_summary(rows: DataFrame) -> DataFrame:
    return capture_totals(rows).select(
        F.col("capture_id").alias("run_id"), "row_count", F.col("low_capture_hash").alias("capture_sha256"),
        F.col("low_label").alias("label"), F.col("low_split").alias("split"))


def role_projection(rows: DataFrame) -> DataFrame:
    """Every row once per role it belongs to; one pass, no copy of the input."""
    roles = F.when(F.col("split") == "test", F.array(F.lit("all"), F.lit("test"))).otherwise(
        F.array(F.lit("all"), F.lit("selection")))
    return rows.select("*", F.explode(roles).alias("role"))


def role_rows(rows: DataFrame, role: str) -> DataFrame:
    if role not in ROLES:
        raise ValueError("role is none of all, selection, test")
    return {"all": rows, "selection": rows.filter("split <> 'test'"), "test": rows.filter("split = 'test'")}[role]


def row_json() -> Column:
    """A labelled row as compact ASCII JSON with sorted keys."""
    fields = {
        "capture_hash": json_string("capture_hash"),
        "capture_id": json_string("capture_id"),
        "complete": json_boolean("complete"),
        "feature_names": json_array("feature_names", json_string),
        "feature_version": "CAST(feature_version AS STRING)",
        "features": json_array("features", json_double),
        "label": "CAST(label AS STRING)",
        "quality": json_string("quality"),
        "split": json_string("split"),
        "window_id": json_string("window_id"),
    }
    parts = ", ',', ".join(f"'\"{name}\":', {text}" for name, text in fields.items())
    return F.expr(f"concat('{{', {parts}, '}}')")


def digest_tree(rows: DataFrame, keys: list[str], levels: tuple[int, ...] = DIGEST_LEVELS) -> DataFrame:
    """``(keys, length, prefix, row_count, digest)``: all nodes of an order-independent digest of row contents.

    Rows are hashed alone and equal rows become one digest with a count. The digests are combined
    along shrinking prefixes: first all with the same six hex digits, then three, then the rest.
    Copies, hot keys and large groups therefore never meet in one task.
    """
    pieces = rows.select(*keys, F.sha2(row_json(), 256).alias("_digest")).groupBy(*keys, "_digest").agg(
        F.count("*").alias("_n")).select(
        *keys, "_n", F.col("_digest").alias("_path"), F.concat("_digest", F.lit(":"), "_n").alias("_digest"))
    nodes = None
    for length in levels:
        joined = F.transform(F.array_sort(F.collect_list(F.struct("_path", "_digest"))), lambda c: c["_digest"])
        pieces = pieces.groupBy(*keys, F.substring("_path", 1, length).alias("_prefix")).agg(
            F.sum("_n").alias("_n"), F.sha2(F.array_join(joined, ""), 256).alias("_digest"),
        ).select(*keys, "_n", F.col("_prefix").alias("_path"), "_digest")
        level = pieces.select(*keys, F.lit(length).alias("length"), F.col("_path").alias("prefix"),
                              F.col("_n").alias("row_count"), F.col("_digest").alias("digest"))
        nodes = level if nodes is None else nodes.unionByName(level)
    return nodes


def content_digest(rows: DataFrame, keys: list[str], levels: tuple[int, ...] = DIGEST_LEVELS) -> DataFrame:
    """Order-independent digest of row contents per key, for groups of any size: the roots of ``digest_tree``."""
    root = digest_tree(rows, keys, levels).filter(F.col("length") == levels[-1])
    return root.select(*keys, "row_count", F.col("digest").alias("content_digest"))


def tree_differences(before: DataFrame, after: DataFrame, keys: list[str],
                     levels: tuple[int, ...] = DIGEST_LEVELS) -> DataFrame:
    """Smallest parts that differ between two digest trees: ``(keys, prefix, rows_before, rows_after)``.

    Only children of nodes that differ are compared, and no row is read: a changed row costs the nodes
    on its path. A prefix names the rows whose digest begins with it.
    """
    parents = None
    for length in reversed(levels):
        sides = []
        for tree, name in ((before, "before"), (after, "after")):
            level = tree.filter(F.col("length") == length)
            if parents is not None:
                above = F.substring("prefix", 1, parents[1]).alias("_above")
                level = level.withColumn("_above", above).join(
                    parents[0].withColumnRenamed("prefix", "_above"), [*keys, "_above"], "left_semi").drop("_above")
            sides.append(level.select(*keys, "prefix", F.col("row_count").alias(f"rows_{name}"), F.col("digest").alias(f"_{name}")))
        found = written(sides[0].join(sides[1], [*keys, "prefix"], "full_outer").filter(
            ~F.col("_before").eqNullSafe(F.col("_after"))).drop("_before", "_after"), "differing")
        parents = (found.select(*keys, "prefix"), length)
    return found


def dataset_contract(rows: DataFrame, captures: DataFrame, roles: DataFrame, plan: DataFrame, bound: DataFrame) -> DataFrame:
    """Every rule a stored dataset breaks against its manifest: ``(subject, violation)``.

    ``captures`` and ``roles`` are the manifest's tables; ``bound`` is its one row with ``plan_digest``,
    ``feature_version``, ``feature_names`` and ``n_captures``.
    """
    listed = manifest_differences(rows, captures).select(F.col("run_id").alias("subject"), F.col("difference").alias("violation"))
    totals = role_totals(rows).select("role", *[F.col(c).alias(f"_{c}") for c in ("row_count", "splits", "content_digest")])
    wrong = F.array_compact(F.array(*[
        F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in ("row_count", "splits", "content_digest")]))
    by_role = roles.join(totals, "role", "full_outer").filter(F.size(wrong) > 0).select(
        F.col("role").alias("subject"), F.concat(F.lit("role differs in "), F.array_join(wrong, ",")).alias("violation"))
    features = rows.filter(
        (F.col("feature_version") != FEATURE_VERSION) | (F.col("feature_names") != F.array(*map(F.lit, FEATURES)))
    ).groupBy("capture_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("capture_id").alias("subject"), F.lit("features have another version, names or order").alias("violation"))
    # One row each: what the manifest is bound to, the plan's digest and its number of runs.
    told = bound.crossJoin(plan_digest(plan).withColumnRenamed("plan_digest", "_digest")).crossJoin(
        plan.agg(F.count(F.lit(1)).alias("_planned"))).crossJoin(captures.agg(F.count(F.lit(1)).alias("_listed")))
    manifest = told.select(F.lit("manifest").alias("subject"), F.explode(F.array_compact(F.array(
        F.when(~F.col("plan_digest").eqNullSafe(F.col("_digest")), F.lit("plan digest differs")),
        F.when(~F.col("feature_version").eqNullSafe(F.lit(FEATURE_VERSION)), F.lit("feature_version is not the known one")),
        F.when(~F.coalesce(F.col("feature_names") == F.array(*map(F.lit, FEATURES)), F.lit(False)),
               F.lit("feature names or their order differ")),
        F.when((F.col("n_captures") != F.col("_listed")) | (F.col("n_captures") != F.col("_planned")),
               F.lit("number of captures differs from entries or plan")),
    ))).alias("violation"))
    return listed.unionByName(by_role).unionByName(features).unionByName(manifest)


def sequential_digest(rows: DataFrame) -> DataFrame:
    """SHA-256 of the JSON array of each capture's rows in window order.

    This is the digest a dataset manifest of the original format holds. A SHA-256 over one text
    cannot be split, so each capture is one sorted stream through one task; the sort spills and
    only one Arrow batch is held. Use ``content_digest`` wherever the format leaves a choice.
    """
    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, count = None, None, 0
        for batch in batches:
            done = []
            for capture, text in zip(batch["capture_id"], batch["text"]):
                if capture != current:
                    if state is not None:
                        state.update(b"]")
                        done.append((current, count, state.hexdigest()))
                    current, state, count = capture, hashlib.sha256(b"["), 0
                state.update((b"," if count else b"") + text.encode("ascii"))
                count += 1
            yield pd.DataFrame(done, columns=["capture_id", "row_count", "row_content_sha256"])
        if state is not None:
            state.update(b"]")
            yield pd.DataFrame([(current, count, state.hexdigest())],
                               columns=["capture_id", "row_count", "row_content_sha256"])

    ordered = (
        rows.select("capture_id", "window_id", row_json().alias("text"))
        .repartition("capture_id").sortWithinPartitions("capture_id", "window_id")
    )
    return ordered.mapInPandas(digests, "capture_id string, row_count bigint, row_content_sha256 string")


def manifest_differences(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Captures whose recomputed summary or digest differs from the manifest.

    ``manifest`` has one row per capture: ``run_id``, ``row_count``, ``capture_sha256``,
    ``label``, ``split``, ``content_digest``.
    """
    digests = content_digest(rows, ["capture_id"]).select(F.col("capture_id").alias("run_id"), "content_digest")
    actual = capture_summary(rows).join(digests, "run_id")
    names = ["row_count", "capture_sha256", "label", "split", "content_digest"]
    left = manifest.select("run_id", *[F.col(name).alias(f"_want_{name}") for name in names], F.lit(True).alias("_m"))
    joined = left.join(actual.withColumn("_a", F.lit(True)), "run_id", "full_outer")
    wrong = F.array_compact(F.array(*[
        F.when(~F.col(name).eqNullSafe(F.col(f"_want_{name}")), F.lit(name)) for name in names]))
    return joined.select(
        "run_id",
        F.when(F.col("_a").isNull(), F.lit("capture missing from dataset"))
        .when(F.col("_m").isNull(), F.lit("capture missing from manifest"))
        .when(F.size(wrong) > 0, F.concat(F.lit("differs in "), F.array_join(wrong, ","))).alias("difference"),
    ).filter("difference IS NOT NULL")


def role_totals(rows: DataFrame) -> DataFrame:
    """Row count, splits and content digest per role."""
    projected = role_projection(rows)
    totals = projected.groupBy("role").agg(
        F.count("*").alias("_rows"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"))
    return totals.join(content_digest(projected, ["role"]), "role").select(
        "role", "row_count", "splits", "content_digest")


def manifest_consistency(captures: DataFrame, roles: DataFrame, plan: DataFrame) -> DataFrame:
    """Rules a dataset manifest must keep on its own, one row per broken rule."""
    planned = plan.select("run_id", F.col("split").alias("_split"),
                          _lookup(LABELS, F.col("behavior_label")).alias("_label"))
    entries = captures.join(planned, "run_id", "full_outer").select(
        F.col("run_id").alias("subject"), F.explode(F.array_compact(F.array(
            F.when(F.col("row_count").isNull(), F.lit("planned capture is not in the manifest")),
            F.when(F.col("_split").isNull() | (F.col("split") != F.col("_split")) | (F.col("label") != F.col("_label")),
                   F.lit("entry has another label or split than planned")),
            F.when(F.col("row_count") < 1, F.lit("row_count is below 1")),
            F.when(~is_digest(F.col("capture_sha256")) & F.col("row_count").isNotNull(), F.lit("capture_sha256 is not 64 lower-case hex digits")),
        ))).alias("violation"))
    repeated = captures.groupBy("capture_sha256").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.col("capture_sha256").alias("subject"), F.lit("several entries have this capture hash").alias("violation"))
    expected = role_projection(captures).groupBy("role").agg(F.sum("row_count").alias("_expected"))
    counts = roles.join(expected, "role", "full_outer").filter(
        ~F.col("row_count").eqNullSafe(F.col("_expected"))).select(
        F.col("role").alias("subject"), F.lit("row_count differs from the sum of the entries").alias("violation"))
    return entries.unionByName(repeated).unionByName(counts)


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """A row as canonical JSON: sorted keys, no spaces, ASCII with escapes; flat columns only."""
    def value(name: str) -> str:
        kind = df.schema[name].dataType.simpleString()
        texts = {"string": json_string(name), "double": json_double(name), "boolean": json_boolean(name)}
        if kind not in texts and kind not in ("tinyint", "smallint", "int", "bigint"):
            raise ValueError(f"{name} has no canonical JSON: {kind}")
        return f"IF({name} IS NULL, 'null', {texts.get(kind, f'CAST({name} AS STRING)')})"

    pairs = [f"concat('\"{name}\":', {value(name)})" for name in sorted(columns)]
    return F.expr(f"concat('{{', concat_ws(',', {', '.join(pairs)}), '}}')")


def plan_digest(plan: DataFrame) -> DataFrame:
    """Digest of a plan document: runs as canonical JSON, in run order; a plan has tens of runs."""
    text = canonical_json(plan, [name for name in plan.columns if name != "plan_order"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("run_id", text.alias("_t")))), lambda r: r["_t"])
    return plan.agg(F.sha2(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")), 256).alias("plan_digest"))
