"""The rate rule and its alerts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tracemill.schemas import DEFAULT_THRESHOLD, FEATURES, RULE_VERSION


def check_threshold(threshold: float) -> float:
    if isinstance(threshold, bool) or not math.isfinite(threshold) or threshold < 0:
        raise ValueError("threshold must be a number from 0 up")
    return float(threshold)


def check_feature_order(windows: DataFrame) -> None:
    present = tuple(name for name in windows.columns if name in FEATURES)
    if present != FEATURES:
        raise ValueError("feature columns are missing or in another order")


def rule_score() -> Column:
    return (F.col("C_sum") + F.col("D_sum")) / F.lit(10.0)


def score_windows(windows: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One prediction per window; windows that cannot be classified get no score."""
    check_feature_order(windows)
    return score_counts(windows, threshold)


def score_counts(windows: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """The same from windows that hold sums and quality only."""
    threshold = check_threshold(threshold)
    score = F.when(F.col("classifiable"), rule_score())
    return windows.select(
        "window_id", "run_id",
        F.lit(RULE_VERSION).alias("model_version"),
        score.alias("score"),
        F.lit(threshold).alias("threshold"),
        (score >= threshold).alias("suspicious"),
        F.array_join("quality", ",").alias("quality"),
        F.array(*[
            F.struct(F.lit(name).alias("feature"), F.col(name).alias("value"))
            for name in ("C_sum", "D_sum")
        ]).alias("supporting_features"),
    )


def supporting_text(column: str = "supporting_features") -> Column:
    """Supporting features as ``[["C_sum",1],["D_sum",2]]``."""
    pairs = F.transform(column, lambda pair: F.concat(
        F.lit('["'), pair["feature"], F.lit('",'), pair["value"].cast("string"), F.lit("]")
    ))
    return F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]"))


def alerts(predictions: DataFrame) -> DataFrame:
    return predictions.filter(F.col("suspicious"))
