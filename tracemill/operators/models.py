"""Model candidates on labelled rows with Spark ML: fit, select, store and evaluate once.

The kernel machine of the original has no Spark ML estimator. Up to ``EXACT_ROWS`` training rows its dual is
solved exactly; beyond, where rows times support vectors are too many, it is approximated by random
Fourier features in front of a linear machine. Forests follow Spark's split finding. Fold assignment,
threshold choice and the choice between models are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tracemill.operators import kernel_machine, labelled, selection
from tracemill.operators.kernel_machine import KernelMachine
from tracemill.schemas import FEATURE_VERSION, FEATURES
from tracemill.session import written
from tracemill.sources.commits import VersionedTable
from tracemill.sources.tables import file_inventory

FOURIER_FEATURES = 200
EXACT_ROWS = 50_000
# The candidates, simplest first: a later one has to be better to win.
SVM_GRID = ((0.5, "scale"), (0.5, "0.1"), (1.0, "scale"), (1.0, "0.1"))
# Spark's deepest tree stands for "no depth limit".
FOREST_GRID = ((40, 4), (40, 30), (80, 4), (80, 30))


def with_vector(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "vector": array_to_vector("features"),
        "target": F.col("label").cast("double"),
    })


def fourier_features(gamma: str, seed: int) -> Callable:
    """A column function: scaled features to random Fourier features of a Gaussian kernel.

    On scaled features the "scale" width is one over their number. The projection follows from
    ``gamma`` and ``seed`` alone, so a stored model needs only these two.
    """
    size = len(FEATURES)
    width = 1.0 / size if gamma == "scale" else float(gamma)
    random = np.random.default_rng(seed)
    weights = random.normal(0.0, math.sqrt(2.0 * width), (size, FOURIER_FEATURES))
    offsets = random.uniform(0.0, 2.0 * math.pi, FOURIER_FEATURES)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(values: pd.Series) -> pd.Series:
        if values.empty:
            return pd.Series([], dtype=object)
        waves = np.cos(np.stack(values.to_list()) @ weights + offsets)
        return pd.Series(list(math.sqrt(2.0 / FOURIER_FEATURES) * waves))

    return project


@dataclass(frozen=True)
class Candidate:
    """One model family with fixed parameters."""

    name: str
    parameters: tuple
    seed: int
    exact_rows: int = EXACT_ROWS

    def fit(self, rows: DataFrame) -> list[PipelineModel | KernelMachine]:
        if self.name == "random_forest":
            trees, depth = self.parameters
            forest = RandomForestClassifier(
                featuresCol="vector", labelCol="target", numTrees=trees, maxDepth=depth, seed=self.seed)
            return [Pipeline(stages=[forest]).fit(with_vector(rows))]
        penalty, gamma = self.parameters
        if rows.count() <= self.exact_rows:
            return [kernel_machine.fit(rows, penalty, gamma)]
        vectors = with_vector(rows)
        scaler = Pipeline(stages=[StandardScaler(
            inputCol="vector", outputCol="scaled", withMean=True, withStd=True)]).fit(vectors)
        count = rows.count()
        machine = LinearSVC(featuresCol="waves", labelCol="target", regParam=1.0 / (penalty * count), maxIter=50)
        return [scaler, Pipeline(stages=[machine]).fit(self._waves(scaler.transform(vectors)))]

    def _waves(self, scaled: DataFrame) -> DataFrame:
        project = fourier_features(self.parameters[1], self.seed)
        return scaled.withColumn("waves", array_to_vector(project(vector_to_array("scaled"))))

    def score(self, stages: list[PipelineModel | KernelMachine], rows: DataFrame) -> DataFrame:
        """Add ``score``: probability of the positive class, or the signed distance."""
        if isinstance(stages[0], KernelMachine):
            return stages[0].score(rows)
        vectors = with_vector(rows)
        if self.name == "random_forest":
            scored = stages[0].transform(vectors).withColumn("score", vector_to_array("probability")[1])
        else:
            scored = stages[1].transform(self._waves(stages[0].transform(vectors))).withColumn(
                "score", vector_to_array("rawPrediction")[1])
        return scored.select(*rows.columns, "score")

    @property
    def cut(self) -> float:
        """Score above which the model itself predicts the positive class."""
        return 0.5 if self.name == "random_forest" else 0.0


def rule_scores(rows: DataFrame) -> DataFrame:
    creates, deletes = FEATURES.index("C_sum"), FEATURES.index("D_sum")
    return rows.withColumn("score", (F.col("features")[creates] + F.col("features")[deletes]) / F.lit(10.0))


def _f1(scored: DataFrame, cut: float) -> float:
    row = selection.rates(selection.confusion(scored, [], F.col("score") > cut)).first()
    return float(row["f1"])


def best_candidate(rows: DataFrame, candidates: list[Candidate]) -> Candidate:
    """Highest mean F1 over the grouped folds; the earlier candidate wins a tie."""
    if len(candidates) == 1:
        return candidates[0]
    folds = selection.assign_folds(rows, candidates[0].seed).select("capture_id", "fold")
    folded = written(rows.join(folds, "capture_id"), "folds")
    means = []
    for candidate in candidates:
        values = []
        for fold in range(selection.FOLDS):
            stages = candidate.fit(folded.filter(F.col("fold") != fold))
            values.append(_f1(candidate.score(stages, folded.filter(F.col("fold") == fold)), candidate.cut))
        means.append(sum(values) / len(values))
    return candidates[means.index(max(means))]


@dataclass(frozen=True)
class Selected:
    """The winning model, its threshold and what every finalist reached on validation rows."""

    name: str
    threshold: float
    candidate: Candidate | None
    stages: list[PipelineModel]
    evaluations: DataFrame
    seed: int

    def score(self, rows: DataFrame) -> DataFrame:
        return rule_scores(rows) if self.candidate is None else self.candidate.score(self.stages, rows)


def train_and_select(
    rows: DataFrame, *, seed: int = 37, svm_grid=SVM_GRID, forest_grid=FOREST_GRID
) -> Selected:
    """Tune on training captures, choose thresholds and the model on validation rows."""
    for check in (labelled.row_violations(rows), labelled.leakage_violations(rows), selection.selection_guard(rows)):
        problem = check.first()
        if problem is not None:
            raise ValueError(f"rows cannot be used for training: {problem.asDict()}")
    training, validation = rows.filter("split = 'training'"), rows.filter("split = 'validation'")
    fitted: dict[str, tuple[Candidate, list[PipelineModel]]] = {}
    for name, grid in (("rbf_svm", svm_grid), ("random_forest", forest_grid)):
        best = best_candidate(training, [Candidate(name, parameters, seed) for parameters in grid])
        fitted[name] = best, best.fit(training)
    scored = rule_scores(validation).withColumn("model", F.lit("rule"))
    for name, (candidate, stages) in fitted.items():
        scored = scored.unionByName(candidate.score(stages, validation).withColumn("model", F.lit(name)))
    scored = written(scored.select("model", "label", "score"), "scores")
    evaluations = written(selection.best_threshold(selection.threshold_sweep(scored, ["model"]), ["model"]), "finalists")
    winner = selection.finalist(evaluations).first()
    candidate, stages = fitted.get(winner["model"], (None, []))
    return Selected(winner["model"], float(winner["threshold"]), candidate, stages, evaluations, seed)


def evaluate(selected: Selected, rows: DataFrame) -> DataFrame:
    """One row of confusion counts and rates over test rows; scores must be finite, one per row.

    No row at all is an error, and so is a row of another split than the test split, a label other than 0 or 1, or
    features of another version or order.
    """
    wrong = (F.coalesce(F.col("split") != "test", F.lit(True)) | ~F.coalesce(F.col("label").isin(0, 1), F.lit(False))
             | ~F.coalesce((F.col("feature_version") == FEATURE_VERSION)
                           & (F.col("feature_names") == F.array(*map(F.lit, FEATURES))), F.lit(False)))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong")).first()
    if not found.n:
        raise ValueError("there are no test rows")
    if found.wrong:
        raise ValueError(f"{found.wrong} rows are no valid test rows")
    scored = written(selected.score(rows).select("label", "score"), "evaluation")
    if not scored.filter("score IS NULL OR isnan(score) OR abs(score) = double('inf')").isEmpty():
        raise ValueError("scores must be finite and complete")
    return selection.rates(selection.confusion(scored, [], F.col("score") >= selected.threshold))


_METADATA = (
    "model_name string, threshold double, parameters array<string>, seed bigint, feature_version int,"
    " feature_names array<string>, selection_digest string, dataset_digest string, stages_digest string"
)


def _stages_digest(spark: SparkSession, folder: str) -> str:
    """One digest over the files of all stages; there are a few per stage."""
    files = file_inventory(spark, f"{folder}/stages").filter("path NOT LIKE '%.crc'")
    ordered = F.array_sort(F.collect_list(F.concat_ws(":", "path", "actual_sha256")))
    return files.agg(F.sha2(F.array_join(ordered, ","), 256).alias("d")).first().d


def save_model(selected: Selected, path: str, *, selection_digest: str, dataset_digest: str) -> None:
    """Store model stages, metadata bound to the stages and the dataset, and the validation metrics.

    All of it appears at once; a path that holds a model is an error.
    """
    spark = selected.evaluations.sparkSession
    for digest in (selection_digest, dataset_digest):
        if len(digest) != 64 or set(digest) - set("0123456789abcdef"):
            raise ValueError("dataset digests must be 64 lower-case hex digits")
    if not selection.unequal_totals(selected.evaluations, []).isEmpty():
        raise ValueError("models were measured on different numbers of rows")
    parameters = [] if selected.candidate is None else [str(value) for value in selected.candidate.parameters]

    def write(folder: str) -> None:
        for index, stage in enumerate(selected.stages):
            stage.save(f"{folder}/stages/{index}")
        bound = _stages_digest(spark, folder) if selected.stages else ""
        row = (selected.name, selected.threshold, parameters, selected.seed, FEATURE_VERSION, list(FEATURES),
               selection_digest, dataset_digest, bound)
        selected.evaluations.write.parquet(f"{folder}/evaluations")
        spark.createDataFrame([row], _METADATA).write.parquet(f"{folder}/metadata")

    VersionedTable(path).publish_once(spark, write)


def _metadata(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_METADATA).parquet(f"{folder}/metadata")


def load_model(spark: SparkSession, path: str) -> Selected:
    """The stored model, only if its features and the files of its stages are those it was stored with."""
    folder = VersionedTable(path).published(spark)
    metadata = _metadata(spark, folder).first()
    if metadata["feature_version"] != FEATURE_VERSION or tuple(metadata["feature_names"]) != FEATURES:
        raise ValueError("features have another version, names or order")
    name, parameters = metadata["model_name"], metadata["parameters"]
    candidate, stages = None, []
    if name != "rule":
        if _stages_digest(spark, folder) != metadata["stages_digest"]:
            raise ValueError("stages differ from those that were stored")
        parsed = ((float(parameters[0]), parameters[1]) if name == "rbf_svm"
                  else (int(parameters[0]), int(parameters[1])))
        candidate = Candidate(name, parsed, metadata["seed"])
        exact = kernel_machine.is_saved(spark, f"{folder}/stages/0")
        stages = [KernelMachine.load(spark, f"{folder}/stages/0")] if exact else [
            PipelineModel.load(f"{folder}/stages/{index}") for index in range(2 if name == "rbf_svm" else 1)]
    return Selected(name, metadata["threshold"], candidate, stages,
                    spark.read.parquet(f"{folder}/evaluations"), metadata["seed"])


def model_id(metadata: DataFrame) -> DataFrame:
    """The metadata with ``model_id``, a digest over all of it: name, parameters, data and stages."""
    return metadata.withColumn("model_id", F.sha2(F.to_json(F.struct(*metadata.columns)), 256))


def record_evaluation(spark: SparkSession, path: str, metrics: DataFrame, *, dataset_digest: str) -> None:
    """The one test evaluation of a model: a second one, or other data, is refused.

    Its key is the digest of the model's own metadata, not a name that the caller picks.
    """
    stored = model_id(_metadata(spark, VersionedTable(path).published(spark))).first()
    if stored["dataset_digest"] != dataset_digest:
        raise ValueError("model was selected for another test set")
    if not selection.metric_disagreements(metrics).isEmpty():
        raise ValueError("stored metrics differ from those of the counts")
    VersionedTable(f"{path}/ledger").append_unique(
        metrics.select(F.lit(stored["model_id"]).alias("model_id"), F.lit(dataset_digest).alias("dataset_digest"), "*"),
        "model_id", "test evaluation")


def report(spark: SparkSession, path: str) -> DataFrame:
    """Selection metadata beside the single test evaluation."""
    metadata = model_id(_metadata(spark, VersionedTable(path).published(spark))).drop("feature_names", "dataset_digest")
    return metadata.join(VersionedTable(f"{path}/ledger").read(spark), "model_id")
