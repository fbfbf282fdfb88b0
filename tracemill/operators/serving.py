"""Read queries over stored results, and how stored rows change over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracemill.schemas import FEATURES, PROCESS
from tracemill.session import written

MAX_PAGE = 100


def check_page(limit: int, offset: int) -> None:
    if type(limit) is not int or not 1 <= limit <= MAX_PAGE:
        raise ValueError("limit must be between 1 and 100")
    if type(offset) is not int or offset < 0:
        raise ValueError("offset must not be negative")


def _page(df: DataFrame, limit: int, offset: int) -> DataFrame:
    check_page(limit, offset)
    return df.offset(offset).limit(limit)


def list_runs(runs: DataFrame, *, limit: int = 50, offset: int = 0) -> DataFrame:
    """Runs, newest first."""
    return _page(runs.select("run_id", "source", "started_ns", "status")
                 .orderBy(F.desc("started_ns"), "run_id"), limit, offset)


def processes(windows: DataFrame) -> DataFrame:
    return windows.groupBy("run_id", *PROCESS).agg(
        F.count("*").alias("window_count"), F.max("start_ns").alias("latest_window_ns"))


def list_processes(windows: DataFrame, *, limit: int = 50, offset: int = 0) -> DataFrame:
    ordered = processes(windows).orderBy(
        F.desc("latest_window_ns"), "tgid", "run_id", "boot_id", "start_time_ns")
    return _page(ordered, limit, offset)


def list_windows(windows: DataFrame, predictions: DataFrame, *, limit: int = 50, offset: int = 0) -> DataFrame:
    """Windows with their prediction, newest first. The page is cut before predictions join."""
    page = _page(windows.orderBy(F.desc("start_ns"), "window_id"), limit, offset)
    verdicts = predictions.select("window_id", "model_version", "score", "threshold", "suspicious")
    pairs = ", ".join(f"'{name}', {name}" for name in FEATURES)
    return page.join(verdicts, "window_id", "left").select(
        "window_id", "run_id", "tgid", "start_time_ns", "start_ns", "end_ns",
        F.array_join("quality", ",").alias("quality"), "classifiable",
        "model_version", "score", "threshold", "suspicious",
        F.expr(f"map({pairs})").alias("features"),
    ).orderBy(F.desc("start_ns"), "window_id")


def list_alerts(alerts: DataFrame, *, limit: int = 50, offset: int = 0) -> DataFrame:
    columns = ["alert_id", "window_id", "run_id", "tgid", "start_time_ns", "score", "supporting_features", "valid"]
    return _page(alerts.select(*columns).orderBy(F.desc("alert_id")), limit, offset)


def metrics(windows: DataFrame, predictions: DataFrame, alerts: DataFrame) -> DataFrame:
    return side_by_side([
        windows.agg(F.count("*").alias("windows")),
        predictions.agg(F.count_if("suspicious").alias("suspicious_windows")),
        alerts.agg(F.count_if("valid").alias("active_alerts")),
    ])


def side_by_side(rows: list[DataFrame]) -> DataFrame:
    """One-row tables of different columns as one row."""
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def latest(changes: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The newest version of each key. A struct maximum combines on the map side."""
    rest = [name for name in changes.columns if name not in (*keys, version)]
    return changes.groupBy(*keys).agg(
        F.max(version).alias(version), F.max_by(F.struct(*rest), version).alias("_row")
    ).select(*keys, version, "_row.*")


def alert_lifecycle(changes: DataFrame) -> DataFrame:
    """Alerts from the change log of predictions (``window_id``, ``version``, ``score``, ``suspicious``).

    A positive creates or reactivates an alert and sets its score. A negative or an unscored
    replacement invalidates it and leaves the score alone.
    """
    return changes.groupBy("window_id").agg(
        F.bool_or(F.coalesce("suspicious", F.lit(False))).alias("_raised"),
        F.max_by(F.coalesce("suspicious", F.lit(False)), "version").alias("valid"),
        F.max_by(F.when(F.col("suspicious"), F.col("score")),
                 F.when(F.col("suspicious"), F.col("version"))).alias("score"),
        F.min(F.when(F.col("suspicious"), F.col("version"))).alias("raised_version"),
    ).filter("_raised").drop("_raised")


def current_predictions(windows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Newest predictions; a window replaced by one that cannot be classified loses its verdict."""
    state = windows.select("window_id", "classifiable", F.array_join("quality", ",").alias("_quality"))
    keep = F.col("classifiable")
    return predictions.join(state, "window_id").select(
        "window_id", "model_version", F.when(keep, F.col("score")).alias("score"), "threshold",
        F.when(keep, F.col("suspicious")).alias("suspicious"),
        F.when(keep, F.col("quality")).otherwise(F.col("_quality")).alias("quality"),
        "supporting_features")


def integrity_violations(runs: DataFrame, windows: DataFrame, predictions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Windows without run, windows not predicted exactly once, alerts or predictions without window."""
    def reason(df: DataFrame, text: str, key: str) -> DataFrame:
        return df.select(F.lit(text).alias("violation"), F.col(key).alias("key"))

    repeated = predictions.groupBy("window_id").agg(F.count("*").alias("n")).filter("n > 1")
    # Their real size decides the join: where it is not known, all windows are shuffled to one task per run.
    listed = written(runs.select("run_id"), "runs")
    return (
        reason(windows.join(listed, "run_id", "left_anti"), "window without run", "window_id")
        .unionByName(reason(predictions.join(windows.select("window_id"), "window_id", "left_anti"),
                            "prediction does not match its window", "window_id"))
        .unionByName(reason(windows.join(predictions.select("window_id"), "window_id", "left_anti"),
                            "window without prediction", "window_id"))
        .unionByName(reason(repeated, "window predicted more than once", "window_id"))
        .unionByName(reason(alerts.join(windows.select("window_id"), "window_id", "left_anti"),
                            "alert without window", "window_id"))
    )


def health(states: DataFrame) -> DataFrame:
    """The last health state per run."""
    return latest(states, ["run_id"], "pos").select(
        "run_id", F.col("connected").alias("collector_connected"), "event_rate", "lost_events", "recording")
