"""Threshold choice, confusion metrics and model comparison on scored rows."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from tracemill.functions.ordered import BUCKET_ROWS, ranks, running
from tracemill.session import written

# Fixed values of the selection rule.
COMPLEXITY = {"rule": 0, "rbf_svm": 1, "random_forest": 2}
EPSILON = 2.220446049250313e-16
FOLDS = 3
TOLERANCE = 1e-12

SCORE_RANGES = 64
RANGE_SCORES = 1 << 20


def selection_guard(rows: DataFrame) -> DataFrame:
    """Reasons against training on these rows; empty when training may start."""
    counted = rows.agg(
        F.count_if(F.col("split") == "test").alias("_test"),
        F.count_if(F.col("split") == "training").alias("_training"),
        F.count_if(F.col("split") == "validation").alias("_validation"),
    )
    captures = rows.filter("split = 'training'").select("capture_id", "label").distinct().groupBy().agg(
        F.count_if(F.col("label") == 0).alias("_negative"), F.count_if(F.col("label") == 1).alias("_positive"))
    first = counted.select(F.explode(F.array_compact(F.array(
        F.when(F.col("_test") > 0, F.lit("rows of the test split are present")),
        F.when((F.col("_training") == 0) | (F.col("_validation") == 0),
               F.lit("training or validation split is empty")),
    ))).alias("violation"))
    second = captures.filter("_negative < 3 OR _positive < 3").select(
        F.lit("a label has fewer than 3 training captures").alias("violation"))
    return first.unionByName(second)


def assign_folds(rows: DataFrame, seed: int = 37, folds: int = FOLDS, range_rows: int = BUCKET_ROWS) -> DataFrame:
    """Stratified grouped folds: each capture in one fold, captures dealt by size per label.

    Captures of a label are ranked by size and then by a seeded digest, over ranges of captures. No
    task gets all captures of a label, and each range adds one summary row per label.
    """
    captures = rows.groupBy("capture_id").agg(F.max("label").alias("label"), F.count("*").alias("n"))
    keyed = written(captures.select(
        "*", F.md5(F.concat("capture_id", F.lit(f":{seed}"))).alias("_mark"), (-F.col("n")).alias("_size")), "captures")
    ranked = ranks(keyed, ["label"], ["_size", "_mark", "capture_id"], "_rank", range_rows)
    return ranked.select("capture_id", "label", "n", F.pmod(F.col("_rank"), F.lit(folds)).cast("int").alias("fold"))


def confusion(scored: DataFrame, keys: list[str], predicted: Column) -> DataFrame:
    label = F.col("label") == 1
    return scored.groupBy(*keys).agg(
        F.count_if(~label & ~predicted).alias("true_negatives"),
        F.count_if(~label & predicted).alias("false_positives"),
        F.count_if(label & ~predicted).alias("false_negatives"),
        F.count_if(label & predicted).alias("true_positives"),
    )


def f1() -> Column:
    return F.expr(
        "CASE WHEN 2 * true_positives + false_positives + false_negatives = 0 THEN 0D"
        " ELSE 2D * true_positives / (2 * true_positives + false_positives + false_negatives) END")


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 (zero when undefined) and the correlation coefficient."""
    tp, tn = "CAST(true_positives AS DOUBLE)", "CAST(true_negatives AS DOUBLE)"
    fp, fn = "CAST(false_positives AS DOUBLE)", "CAST(false_negatives AS DOUBLE)"
    root = f"sqrt(({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))"
    return counts.select(
        "*",
        F.expr(f"CASE WHEN {tp} + {fp} = 0 THEN 0D ELSE {tp} / ({tp} + {fp}) END").alias("precision"),
        F.expr(f"CASE WHEN {tp} + {fn} = 0 THEN 0D ELSE {tp} / ({tp} + {fn}) END").alias("recall"),
        f1().alias("f1"),
        F.expr(f"CASE WHEN {root} = 0 THEN 0D ELSE ({tp} * {tn} - {fp} * {fn}) / {root} END").alias("mcc"),
    )


def score_ranges(distinct_scores: DataFrame, ranges: int) -> list[float]:
    """Increasing cut points that spread the distinct scores evenly; at most ``ranges`` floats."""
    ranges = max(ranges, 2)
    steps = [index / ranges for index in range(1, ranges)]
    cuts = distinct_scores.approxQuantile("score", steps, 0.25 / ranges) or [0.0]
    return [float("-inf"), *sorted(set(cuts)), float("inf")]


def threshold_sweep(scored: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """Confusion counts at every candidate threshold per key.

    Candidates are the distinct scores and one just above the greatest. Counts accumulate from the
    highest score down over score ranges, so no task holds all candidates. Unless ``ranges`` is
    given, their number follows the data: about ``RANGE_SCORES`` scores each, at least
    ``SCORE_RANGES`` ranges. Distinct scores are written once, since several steps read them.
    """
    by_score = written(scored.groupBy(*keys, "score").agg(
        F.count_if(F.col("label") == 1).alias("_positive"),
        F.count_if(F.col("label") == 0).alias("_negative")), "scores")
    if ranges is None:
        ranges = max(SCORE_RANGES, by_score.count() // RANGE_SCORES)
    cuts = score_ranges(by_score, ranges)
    ranged = Bucketizer(splits=cuts, inputCol="score", outputCol="_cut").transform(by_score).withColumn(
        "_range", -F.col("_cut"))
    swept = running(
        ranged, keys, [F.desc("score")], ["_range"],
        {"_tp": ("sum", F.col("_positive")), "_fp": ("sum", F.col("_negative"))})
    totals = by_score.groupBy(*keys).agg(
        F.sum("_positive").alias("_all_positive"), F.sum("_negative").alias("_all_negative"),
        F.max("score").alias("_top"))
    at_scores = swept.join(totals, keys).select(
        *keys, F.col("score").alias("threshold"),
        (F.col("_all_negative") - F.col("_fp")).alias("true_negatives"),
        F.col("_fp").alias("false_positives"),
        (F.col("_all_positive") - F.col("_tp")).alias("false_negatives"),
        F.col("_tp").alias("true_positives"))
    # Above a score of two the step vanishes and this candidate equals the greatest score.
    above = totals.filter(F.col("_top") + EPSILON > F.col("_top")).select(
        *keys, (F.col("_top") + EPSILON).alias("threshold"),
        F.col("_all_negative").alias("true_negatives"), F.lit(0).cast("bigint").alias("false_positives"),
        F.col("_all_positive").alias("false_negatives"), F.lit(0).cast("bigint").alias("true_positives"))
    return at_scores.unionByName(above).withColumn("f1", f1())


def best_threshold(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """Highest F1, then fewest false positives, then the highest threshold."""
    rest = [name for name in sweep.columns if name not in (*keys, "threshold", "f1", "false_positives")]
    order = F.struct("f1", (-F.col("false_positives")).alias("_fp"), "threshold", *rest)
    return sweep.groupBy(*keys).agg(F.max(order).alias("_best")).select(
        *keys, "_best.threshold", "_best.f1", (-F.col("_best._fp")).alias("false_positives"),
        *[f"_best.{name}" for name in rest])


def finalist(evaluations: DataFrame, model: str = "model") -> DataFrame:
    """The selected model: F1 down, false positives up, complexity up. One row per model comes in."""
    pairs = [part for item in COMPLEXITY.items() for part in (F.lit(item[0]), F.lit(item[1]))]
    return evaluations.withColumn("complexity", F.element_at(F.create_map(*pairs), F.col(model))).orderBy(
        F.desc("f1"), "false_positives", "complexity").limit(1)


COUNTS = ("true_negatives", "false_positives", "false_negatives", "true_positives")


def unequal_totals(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, fewest, most)`` where models were not measured on equally many rows, or a count is missing or negative."""
    total = sum((F.col(name) for name in COUNTS[1:]), F.col(COUNTS[0]))
    sound = F.lit(True)
    for name in COUNTS:
        sound = sound & F.coalesce(F.col(name) >= 0, F.lit(False))
    return metrics.groupBy(*keys).agg(
        F.min(total).alias("fewest"), F.max(total).alias("most"), F.count_if(~sound).alias("_unsound")).filter(
        (F.col("fewest") != F.col("most")) | (F.col("_unsound") > 0)).drop("_unsound")


def metric_disagreements(metrics: DataFrame) -> DataFrame:
    """Stored metrics that do not follow from their own confusion counts."""
    names = ("precision", "recall", "f1", "mcc")
    stored = metrics.select(
        "*", *[F.col(name).alias(f"_stored_{name}") for name in names]).drop(*names)
    checked = rates(stored)
    wrong = F.array_compact(F.array(*[
        F.when(~F.coalesce(
            F.abs(F.col(name) - F.col(f"_stored_{name}"))
            <= F.greatest(F.lit(TOLERANCE), TOLERANCE * F.greatest(F.abs(name), F.abs(f"_stored_{name}"))),
            F.lit(False)), F.lit(name))
        for name in names]))
    return checked.withColumn("disagrees", wrong).filter(F.size("disagrees") > 0).drop(
        *[f"_stored_{name}" for name in names])
