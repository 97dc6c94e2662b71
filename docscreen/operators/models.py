"""Multi-class classifiers (M1-M7): one interface over probabilities or margins.

Linear ones come from the joint solver of ``linear``; naive Bayes and forests are Spark ML's.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (NaiveBayes, NaiveBayesModel, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.operators import evaluate, linear
from docscreen.operators.linear import HINGE, SOFTMAX, Blocks, Fit, Problem
from docscreen.operators.profile import class_weights
from docscreen.operators.split import stratified_folds
from docscreen.session import cut_lineage

FEATURES, TARGET, WEIGHT = "features", "target", "weight"


def class_labels(df: DataFrame, label: str = "label") -> list[str]:
    """Sorted class names: one short row per class."""
    return sorted(r[0] for r in df.filter(F.col(label).isNotNull()).select(label).distinct()
                  .collect())


def with_target(df: DataFrame, labels: Sequence[str], label: str = "label") -> DataFrame:
    """Numeric class index for Spark ML."""
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    return df.withColumn(TARGET, index.cast("double"))


# -- classifiers -------------------------------------------------------------------

class Classifier:
    """Fitted classifier: ``scores`` aligned with ``labels``; probabilities if it has any."""

    probabilistic = True

    def __init__(self, labels: Sequence[str]):
        self.labels = list(labels)

    def score(self, df: DataFrame, output: str = "scores") -> DataFrame:
        raise NotImplementedError

    def named_scores(self, scores: str = "scores") -> Column:
        """``array<struct<name, score>>``."""
        names = F.array(*[F.lit(x) for x in self.labels])
        return F.zip_with(names, F.col(scores), lambda n, s: F.struct(
            n.alias("name"), s.alias("score")))

    def predict(self, df: DataFrame, k: int = 3) -> DataFrame:
        """Add ``prediction``, ``confidence`` (null without probabilities), ``top_predictions``."""
        ordered = F.sort_array(F.transform(self.named_scores("_scores"), lambda s: F.struct(
            (-s["score"]).alias("neg"), s["name"].alias("role"))))
        top = F.transform(F.slice(ordered, 1, k), lambda s: F.struct(
            s["role"].alias("role"), (-s["neg"]).alias("confidence")))
        out = self.score(df, "_scores").withColumn("_top", top)
        best = F.get("_top", F.lit(0))
        none = F.array().cast("array<struct<role:string,confidence:double>>")
        return (out.withColumn("prediction", best["role"])
                .withColumn("confidence", best["confidence"] if self.probabilistic
                            else F.lit(None).cast("double"))
                .withColumn("top_predictions", F.col("_top") if self.probabilistic else none)
                .withColumn("top_labels", F.transform("_top", lambda t: t["role"]))
                .drop("_scores", "_top"))

    def save(self, spark: SparkSession, path: str) -> None:
        note = {"kind": type(self).__name__, "labels": self.labels, **self._save_parts(path)}
        (spark.createDataFrame([(json.dumps(note),)], "note string").write.mode("overwrite")
         .text(f"{path}/note"))

    def _save_parts(self, path: str) -> dict:
        raise NotImplementedError


_PROBABILITY_MODELS = {m.__name__: m for m in (NaiveBayesModel, RandomForestClassificationModel)}


class ProbabilityClassifier(Classifier):
    """Naive Bayes or random forest."""

    def __init__(self, labels, model):
        super().__init__(labels)
        self.model = model

    def score(self, df, output="scores"):
        model = self.model.copy()
        model.setFeaturesCol(FEATURES).setProbabilityCol("_probability").setPredictionCol("_class")
        model.setRawPredictionCol("_raw")
        return (model.transform(df).withColumn(output, vector_to_array("_probability"))
                .drop("_probability", "_class", "_raw"))

    def _save_parts(self, path):
        self.model.write().overwrite().save(f"{path}/model")
        return {"model": type(self.model).__name__}


def _shares(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _calibrated(margins: np.ndarray, slopes: np.ndarray, offsets: np.ndarray, classes: int) -> np.ndarray:
    """Mean over folds of sigmoids that are divided by their sum (even shares if that is zero)."""
    p = 1.0 / (1.0 + np.exp(np.clip(margins * slopes + offsets, -700, 700)))
    p = p.reshape(len(p), len(slopes) // classes, classes)
    total = p.sum(axis=2, keepdims=True)
    return np.where(total > 0, p / np.where(total > 0, total, 1.0), 1.0 / classes).mean(axis=1)


class LinearClassifier(Classifier):
    """Margins, softmax of margins, or calibrated margins of several folds, by one product.

    ``fit`` has a row for each class, or for each fold and class where ``sigmoids`` are given.
    """

    def __init__(self, labels, fit: Fit, softmax: bool = False,
                 sigmoids: tuple[np.ndarray, np.ndarray] | None = None):
        super().__init__(labels)
        self.fit, self.softmax, self.sigmoids = fit, softmax, sigmoids
        self.probabilistic = softmax or sigmoids is not None

    def score(self, df, output="scores"):
        sigmoids, classes, softmax = self.sigmoids, len(self.labels), self.softmax

        def finish(margins: np.ndarray) -> np.ndarray:
            if sigmoids is not None:
                return _calibrated(margins, *sigmoids, classes)
            return _shares(margins) if softmax and len(margins) else margins

        return df.withColumn(output, linear.products(df, self.fit.weights, self.fit.intercepts, FEATURES, finish))

    def _save_parts(self, path):
        spark = SparkSession.getActiveSession()
        rows = [(i, float(b), w.tolist()) for i, (w, b) in enumerate(zip(self.fit.weights, self.fit.intercepts,
                                                                         strict=True))]
        (spark.createDataFrame(rows, "position int, intercept double, weights array<double>")
         .write.mode("overwrite").parquet(f"{path}/weights"))
        return {"softmax": self.softmax, "sigmoids": [x.tolist() for x in self.sigmoids] if self.sigmoids else None}


def load_classifier(spark: SparkSession, path: str) -> Classifier:
    note = json.loads(spark.read.text(f"{path}/note").first().value)
    labels = note["labels"]
    if note["kind"] == "ProbabilityClassifier":
        model = _PROBABILITY_MODELS[note["model"]].load(f"{path}/model")
        return ProbabilityClassifier(labels, model)
    rows = spark.read.parquet(f"{path}/weights").orderBy("position").collect()  # the model itself
    fit = Fit(np.array([r.weights for r in rows]), np.array([r.intercept for r in rows]))
    return LinearClassifier(labels, fit, note["softmax"],
                            tuple(np.array(x) for x in note["sigmoids"]) if note["sigmoids"] else None)


# -- fitting -----------------------------------------------------------------------
# ``train`` has the columns features, label, doc_id.  ``c`` is the inverse regularisation of the
# summed loss.

# Iterative fits run one small job per step: few, well-filled tasks for small inputs.
ROWS_PER_TASK = 5_000


@contextmanager
def _training(train: DataFrame, labels: Sequence[str], balanced: bool):
    """Prepared rows, held in memory and on disk during a fit, and their number."""
    rows = train.filter(F.col("label").isNotNull())
    count = max(rows.count(), 1)
    prepared = _prepared(rows, labels, balanced).select(FEATURES, TARGET, WEIGHT)
    tasks = math.ceil(count / ROWS_PER_TASK)
    if tasks < prepared.rdd.getNumPartitions():
        prepared = prepared.coalesce(tasks)
    prepared = prepared.persist()
    try:
        yield prepared, count
    finally:
        prepared.unpersist()


def _prepared(train: DataFrame, labels: Sequence[str], balanced: bool) -> DataFrame:
    out = with_target(train.filter(F.col("label").isNotNull()), labels)
    if not balanced:
        return out.withColumn(WEIGHT, F.lit(1.0))
    # One row per class of the model, so the weights become a literal map.
    weights = {r.label: r.weight for r in class_weights(train).collect()}
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    return out.withColumn(WEIGHT, F.element_at(F.create_map(*pairs), F.col("label")))


def fit_naive_bayes(train: DataFrame, labels: Sequence[str], alpha: float = 1.0) -> Classifier:
    with _training(train, labels, False) as (rows, _):
        model = NaiveBayes(featuresCol=FEATURES, labelCol=TARGET, modelType="multinomial",
                           smoothing=alpha).fit(rows)
    return ProbabilityClassifier(labels, model)


@dataclass(frozen=True)
class LinearKind:
    """A linear classifier as the problems of the joint solver; ``folds`` for calibration."""

    loss: str
    balanced: bool = False
    folds: int = 0

    def problems(self, blocks: Blocks, c: float = 1.0, features: int = 0, balanced: bool | None = None
                 ) -> list[Problem]:
        even = self.balanced if balanced is None else balanced
        held = range(self.folds) if self.folds else [None]
        return [Problem(self.loss, c, blocks.balanced() if even else None, f, features) for f in held]


LINEAR = {
    "LogisticRegression": LinearKind(SOFTMAX),
    "LinearSVC": LinearKind(HINGE),
    "Calibrated LinearSVC": LinearKind(HINGE, folds=3),
    "LinearSVC balanced": LinearKind(HINGE, balanced=True),
}


def linear_blocks(train: DataFrame, labels: Sequence[str], folds: int = 0,
                  subsets: Sequence[np.ndarray | None] = (None,)) -> Blocks:
    """Labelled rows for the joint solver, with a fold each where ``folds`` are asked for."""
    rows = train.filter(F.col("label").isNotNull())
    if folds:
        rows = rows.join(stratified_folds(rows, folds).select("doc_id", "fold"), "doc_id")
    rows = cut_lineage(with_target(rows, labels).select(FEATURES, TARGET, *(["fold"] if folds else [])))
    first = rows.select(FEATURES).first()
    size = first[0].size if first else 0
    return linear.blocks_of(linear.few_tasks(rows), size, len(labels), FEATURES, TARGET, "fold" if folds else None,
                            subsets)


def fitted_linear(blocks: Blocks, labels: Sequence[str], kind: LinearKind, c: float = 1.0, max_iter: int = 100,
                  balanced: bool | None = None) -> LinearClassifier:
    problems = kind.problems(blocks, c, 0, balanced)
    return linear_classifier(blocks, labels, kind, problems, linear.solve(blocks, problems, max_iter=max_iter))


def linear_classifier(blocks: Blocks, labels: Sequence[str], kind: LinearKind, problems: Sequence[Problem],
                      fits: Sequence[Fit]) -> LinearClassifier:
    """Classifier over the features of its problems, from the solver's weights."""
    subset = blocks.subsets[problems[0].features]
    keep = slice(None) if subset is None else np.flatnonzero(subset)
    fit = Fit(np.concatenate([f.weights[:, keep] for f in fits]), np.concatenate([f.intercepts for f in fits]))
    sigmoids = None
    if kind.folds:
        held = linear.held_margins(blocks, problems, fits)
        sigmoids = linear.sigmoids(held, len(problems) * blocks.classes)
    return LinearClassifier(labels, fit, kind.loss == SOFTMAX, sigmoids)


def _fit_kind(train, labels, kind: LinearKind, **params) -> LinearClassifier:
    blocks = linear_blocks(train, labels, kind.folds)
    try:
        return fitted_linear(blocks, labels, kind, **params)
    finally:
        blocks.release()


def fit_logistic(train: DataFrame, labels: Sequence[str], c: float = 1.0, balanced: bool = False,
                 max_iter: int = 100) -> Classifier:
    return _fit_kind(train, labels, LINEAR["LogisticRegression"], c=c, balanced=balanced, max_iter=max_iter)


def fit_svc(train: DataFrame, labels: Sequence[str], c: float = 1.0, balanced: bool = False,
            max_iter: int = 100) -> Classifier:
    """One against the rest; with ``balanced`` a row carries the weight of its own class."""
    return _fit_kind(train, labels, LINEAR["LinearSVC"], c=c, balanced=balanced, max_iter=max_iter)


def fit_calibrated_svc(train: DataFrame, labels: Sequence[str], folds: int = 3, c: float = 1.0,
                       max_iter: int = 100) -> Classifier:
    """Per fold: SVM on the other folds, sigmoid on the held-out margins; all folds in one solve (M5)."""
    return _fit_kind(train, labels, LinearKind(HINGE, folds=folds), c=c, max_iter=max_iter)


def fit_sigmoids(table: DataFrame, iterations: int = 30, tolerance: float = 1e-6,
                 ) -> dict[tuple[int, int], tuple[float, float]]:
    """Platt's sigmoid ``1 / (1 + exp(a m + b))`` for every (fold, class) of a table of margins."""
    keys = [tuple(r) for r in table.select("fold", "cls").distinct().orderBy("fold", "cls").collect()]
    place = {k: i for i, k in enumerate(keys)}  # one entry a fold and class

    def arrays(batches):
        for batch in batches:
            fold, cls, target, m = (batch.column(i).to_numpy() for i in range(4))
            group = np.array([place[k] for k in zip(fold.tolist(), cls.tolist(), strict=True)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (
                group, target == cls, m.astype(np.float64))], names=["g", "h", "m"])

    rows = table.select("fold", "cls", TARGET, "m").mapInArrow(arrays, "g binary, h binary, m binary")
    margins = rows.rdd.map(lambda r: (np.frombuffer(r.g, np.int32), np.frombuffer(r.h, bool), np.frombuffer(r.m)))
    a, b = linear.sigmoids(margins, len(keys), iterations, tolerance)
    return {k: (float(a[i]), float(b[i])) for k, i in place.items()}


def fit_forest(train: DataFrame, labels: Sequence[str], trees: int = 100, depth: int = 10,
               min_leaf: int = 1, balanced: bool = False, seed: int = C.SEED) -> Classifier:
    with _training(train, labels, balanced) as (rows, _):
        model = RandomForestClassifier(
            featuresCol=FEATURES, labelCol=TARGET, weightCol=WEIGHT, numTrees=trees,
            maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed).fit(rows)
    return ProbabilityClassifier(labels, model)


FITTERS = {
    "LogisticRegression": fit_logistic,
    "LinearSVC": fit_svc,
    "Calibrated LinearSVC": fit_calibrated_svc,
    "LinearSVC balanced": lambda train, labels, **kw: fit_svc(train, labels, balanced=True, **kw),
    "MultinomialNB": fit_naive_bayes,
    "RandomForest": fit_forest,
}


# -- search (M6, M7) ------------------------------------------------------------------

class MacroF1(Evaluator):
    """Unweighted mean of the class F1 values; Spark's own evaluators only weight by support."""

    def __init__(self, label: str = TARGET, prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        grid = evaluate.confusion_grid(dataset, self.label, self.prediction)
        return float(evaluate.metrics(grid).first().macro_f1 or 0.0)

    def isLargerBetter(self) -> bool:  # noqa: N802
        return True


@dataclass
class Search:
    """Mean macro F1 of every setting, and the best one fitted on all rows."""

    settings: list[tuple[dict, float]]
    best: Classifier


#: Values that a search goes through unless told otherwise.
GRIDS = {
    "MultinomialNB": {"smoothing": [0.01, 0.1, 0.5, 1.0, 2.0]},
    "LogisticRegression": {"C": [0.1, 1.0, 5.0, 10.0]},
    "LinearSVC": {"C": [0.1, 1.0, 5.0, 10.0]},
    "RandomForest": {"numTrees": [100, 200], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2]},
}


def grid_search(train: DataFrame, labels: Sequence[str], kind: str, folds: int = 5,
                grid: Mapping | None = None, draws: int | None = None, balanced: bool = False,
                parallelism: int = 2, seed: int = C.SEED) -> Search:
    """Stratified cross-validation by macro F1; ``draws`` takes a seeded subset of the grid.

    ``grid`` maps parameter names to values. All values and folds of a linear kind are one solve.
    """
    options = {k: list(v) for k, v in (GRIDS[kind] if grid is None else grid).items()}
    if kind in LINEAR:
        return _linear_search(train, labels, LINEAR[kind], folds, options, draws, balanced, seed)
    assigned = train.join(stratified_folds(train, folds).select("doc_id", "fold"), "doc_id")
    prepared = cut_lineage(_prepared(assigned, labels, balanced))
    rows = prepared.count()
    if math.ceil(rows / ROWS_PER_TASK) < prepared.rdd.getNumPartitions():
        prepared = prepared.coalesce(math.ceil(rows / ROWS_PER_TASK))
    if kind == "MultinomialNB":
        estimator = NaiveBayes(featuresCol=FEATURES, labelCol=TARGET, modelType="multinomial")
    else:
        estimator = RandomForestClassifier(featuresCol=FEATURES, labelCol=TARGET, weightCol=WEIGHT, seed=C.SEED)
    builder = ParamGridBuilder()
    for name, values in options.items():
        builder.addGrid(estimator.getParam(name), values)
    maps = builder.build()
    if draws is not None and draws < len(maps):
        maps = random.Random(seed).sample(maps, draws)
    found = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=MacroF1(),
                           foldCol="fold", numFolds=folds, parallelism=parallelism).fit(prepared)
    return Search([({p.name: v for p, v in m.items()}, float(score)) for m, score in zip(maps, found.avgMetrics)],
                  ProbabilityClassifier(labels, found.bestModel))


def _linear_search(train, labels, kind: LinearKind, folds: int, options: Mapping[str, list], draws, balanced,
                   seed) -> Search:
    if set(options) != {"C"} or kind.folds:
        raise ValueError("linear kinds without calibration are searched by C")
    values = options["C"]
    if draws is not None and draws < len(values):
        values = random.Random(seed).sample(values, draws)
    blocks = linear_blocks(train, labels, folds)
    try:
        weights = blocks.balanced() if balanced or kind.balanced else None
        problems = [Problem(kind.loss, c, weights, f) for c in values for f in range(folds)]
        counted = linear.confusions(blocks, problems, linear.solve(blocks, problems))
        scores = [linear.macro_f1(x) for x in counted]
        means = [sum(scores[i * folds:(i + 1) * folds]) / folds for i in range(len(values))]
        best = values[max(range(len(values)), key=lambda i: (means[i], -i))]
        return Search([({"C": c}, m) for c, m in zip(values, means, strict=True)],
                      fitted_linear(blocks, labels, kind, best, balanced=balanced or kind.balanced))
    finally:
        blocks.release()


def search_results(found: Search) -> list[tuple[str, float]]:
    """Parameters and mean macro F1 of every setting, best first."""
    rows = [(json.dumps(p, sort_keys=True), score) for p, score in found.settings]
    return sorted(rows, key=lambda r: (-r[1], r[0]))
