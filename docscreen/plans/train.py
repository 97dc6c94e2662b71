"""From audited splits to a selected, refitted and saved model."""

from __future__ import annotations

import itertools
import json
from collections.abc import Mapping, Sequence
from dataclasses import replace
from time import perf_counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.functions import text as X
from docscreen.operators import evaluate
from docscreen.operators.features import LsaModel, TfidfModel, TfidfParams, first_features, frequent_statistics
from docscreen.operators.linear import confusions, macro_f1, solve
from docscreen.operators.models import (FITTERS, LINEAR, Classifier, class_labels, linear_blocks, linear_classifier,
                                        load_classifier)
from docscreen.session import cut_lineage, release, written

METRICS = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision",
           "weighted_recall", "weighted_f1", "minority_f1")


class ScreeningModel:
    """Vocabulary, optional LSA projection and classifier: everything scoring needs.

    The same text stage (cleaning, accents, tokens) runs in training and in scoring.
    """

    def __init__(self, tfidf: TfidfModel, classifier: Classifier, lsa: LsaModel | None = None):
        self.tfidf, self.classifier, self.lsa = tfidf, classifier, lsa

    def vectors(self, df: DataFrame, text: str = "text") -> DataFrame:
        return vectorise(self.tfidf, df, text, self.lsa)

    def predict(self, df: DataFrame, text: str = "text") -> DataFrame:
        return self.classifier.predict(self.vectors(df, text)).drop("features")

    def predict_cleaned(self, df: DataFrame, cleaned: str) -> DataFrame:
        """Same for a column that has been through the cleaning chain already."""
        return self.classifier.predict(project(self.tfidf, df, cleaned, self.lsa)).drop("features")

    def save(self, spark: SparkSession, path: str) -> None:
        self.tfidf.save(spark, f"{path}/vocabulary")
        if self.lsa is not None:
            rows = [(i, [float(x) for x in row])
                    for i, row in enumerate(self.lsa.components.toArray())]
            (spark.createDataFrame(rows, "position int, row array<double>")
             .write.mode("overwrite").parquet(f"{path}/lsa"))
        self.classifier.save(spark, f"{path}/classifier")
        note = {"lsa": self.lsa is not None,
                "singular_values": self.lsa.singular_values if self.lsa else []}
        (spark.createDataFrame([(json.dumps(note),)], "note string").write.mode("overwrite")
         .text(f"{path}/model"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ScreeningModel":
        note = json.loads(spark.read.text(f"{path}/model").first().value)
        lsa = None
        if note["lsa"]:
            from pyspark.ml.linalg import DenseMatrix

            rows = [r.row for r in spark.read.parquet(f"{path}/lsa").orderBy("position").collect()]
            flat = [x for column in zip(*rows) for x in column]
            lsa = LsaModel(DenseMatrix(len(rows), len(rows[0]), flat), note["singular_values"])
        return cls(TfidfModel.load(spark, f"{path}/vocabulary"),
                   load_classifier(spark, f"{path}/classifier"), lsa)


def load_first(spark: SparkSession, paths: Sequence[str]) -> ScreeningModel:
    """First path that holds a complete model; the error names every missing artifact."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    missing = []
    for path in paths:
        absent = []
        for part in ("model", "vocabulary", "classifier"):
            place = hadoop.Path(f"{path}/{part}")
            if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
                absent.append(f"{path}/{part}")
        if not absent:
            return ScreeningModel.load(spark, path)
        missing += absent
    raise FileNotFoundError("model artifacts not found: " + ", ".join(missing))


def vectorise(tfidf: TfidfModel, df: DataFrame, text: str, lsa: LsaModel | None = None):
    """Add ``features`` from the cleaned text."""
    cleaned = df.withColumn("_clean", X.clean_text(F.col(text)))
    return project(tfidf, cleaned, "_clean", lsa).drop("_clean")


def project(tfidf: TfidfModel, df: DataFrame, cleaned: str, lsa: LsaModel | None = None):
    out = tfidf.transform(df, cleaned)
    return lsa.transform(out, "features", "features") if lsa else out


def _cleaned(df: DataFrame, text: str) -> DataFrame:
    return df.select(X.clean_text(F.col(text)).alias("_clean"))


def fit_vocabulary(train: DataFrame, text: str, params: TfidfParams) -> TfidfModel:
    return TfidfModel.fit(_cleaned(train, text), "_clean", params)


def model_metrics(classifier: Classifier, vectors: DataFrame, k: int = 3) -> dict[str, float]:
    """All metrics of one classifier on one split, from a single pass over the rows."""
    predicted = classifier.predict(vectors, k)
    hit = F.array_contains("top_labels", F.col("label"))
    grid = (predicted.filter(F.col("label").isNotNull())
            .groupBy("label", "prediction")
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("hits")))
    rows = grid.collect()  # one row per pair of classes
    table = vectors.sparkSession.createDataFrame(
        [(r.label, r.prediction, r.rows) for r in rows], "label string, prediction string, rows bigint")
    out = {m: float(v) for m, v in evaluate.metrics(table).first().asDict().items()}
    out["topk_accuracy"] = sum(r.hits for r in rows) / sum(r.rows for r in rows)
    return out


def metric_rows(spark: SparkSession, found: Mapping[tuple[str, str], Mapping[str, float]]):
    """``{(model, split): metrics}`` as long rows."""
    rows = [(model, split, name, float(value)) for (model, split), values in found.items()
            for name, value in values.items()]
    return spark.createDataFrame(rows, "model string, split string, metric string, value double")


# -- sweep and selection (M8, M9) ---------------------------------------------------------

def candidate_sweep(splits: DataFrame, text: str = "text",
                    sizes: Sequence[int] = C.MAX_FEATURES_GRID,
                    kinds: Sequence[str] = ("LogisticRegression", "LinearSVC",
                                            "Calibrated LinearSVC", "LinearSVC balanced"),
                    params: Mapping[str, Mapping] | None = None):
    """Every feature size with every model: validation metrics and fit seconds.

    A vocabulary contains every smaller one, so texts are cleaned and turned into vectors once, for the
    largest; those of a size are its first features at unit length. Linear models of all sizes read the same
    blocks and are one solve, calibrated ones a second. ``fit_seconds`` is the fit alone; models of one solve
    share its seconds evenly.
    Returns the table and the fitted ``{(kind, size): ScreeningModel}``.
    """
    sizes = sorted(set(sizes))
    train = splits.filter(F.col("split") == "train")
    labels = class_labels(train)
    cleaned = cut_lineage(splits.filter(F.col("split").isin("train", "validation"))
                          .select("doc_id", "label", "split", X.clean_text(F.col(text)).alias("_clean")))
    texts = written()[-1:]
    widest = TfidfModel.fit(cleaned.filter("split = 'train'").select("_clean"), "_clean",
                            TfidfParams(max_features=sizes[-1]))
    rows = cut_lineage(project(widest, cleaned, "_clean").select("doc_id", "label", "split", "features"))
    release(splits.sparkSession, texts)
    fit_on, check_on = (rows.filter(F.col("split") == s).drop("split") for s in ("train", "validation"))
    known = len(widest.terms)
    subsets = [np.arange(known) < size for size in sizes]
    linear = [k for k in kinds if k in LINEAR]
    blocks = linear_blocks(fit_on, labels, max([LINEAR[k].folds for k in linear], default=0), subsets) if linear else None
    out, fitted = [], {}
    models = _linear_models(blocks, labels, linear, len(sizes), params or {}) if linear else {}
    for place, size in enumerate(sizes):
        own = widest.first(size)
        check = cut_lineage(check_on.withColumn("features", first_features("features", len(own.terms))))
        for kind in kinds:
            if kind in LINEAR:
                model, seconds = models[kind, place]
            else:
                narrow = cut_lineage(fit_on.withColumn("features", first_features("features", len(own.terms))))
                started = perf_counter()
                model = FITTERS[kind](narrow, labels, **(params or {}).get(kind, {}))
                seconds = perf_counter() - started
            found = model_metrics(model, check)
            out.append((kind, size, *[found[m] for m in METRICS], seconds))
            fitted[kind, size] = ScreeningModel(own, model)
    if blocks:
        blocks.release()
    schema = ", ".join(["model string", "max_features int"] + [f"{m} double" for m in METRICS]
                       + ["fit_seconds double"])
    return splits.sparkSession.createDataFrame(out, schema), fitted


def _linear_models(blocks, labels, kinds, subsets: int, params: Mapping) -> dict:
    """``{(kind, subset of the features): (model, seconds)}``.

    Kinds are solved together; calibrated ones after the others, as their folds start from the model of all rows.
    """
    models, plain = {}, {}
    groups = itertools.groupby(sorted(kinds, key=lambda k: (LINEAR[k].folds > 0, _options(params, k)[2])),
                               lambda k: (LINEAR[k].folds > 0, _options(params, k)[2]))
    for (_, max_iter), group in groups:
        started, problems = perf_counter(), {}
        for kind in group:
            c, balanced, _ = _options(params, kind)
            problems |= {(kind, i): LINEAR[kind].problems(blocks, c, i, balanced) for i in range(subsets)}
        asked = [p for own in problems.values() for p in own]
        solved = iter(solve(blocks, asked, [plain.get(replace(p, held_out=None)) for p in asked], max_iter))
        shared = (perf_counter() - started) / len(problems)
        for (kind, i), own in problems.items():
            started, fits = perf_counter(), [next(solved) for _ in own]
            plain |= zip(own, fits, strict=True)
            models[kind, i] = (linear_classifier(blocks, labels, LINEAR[kind], own, fits), shared + perf_counter() - started)
    return models


def _options(params: Mapping, kind: str) -> tuple:
    own = params.get(kind, {})
    return own.get("c", 1.0), own.get("balanced"), own.get("max_iter", 100)


def select_model(candidates: DataFrame, criteria=("macro_f1", "accuracy", "weighted_f1")):
    return evaluate.select_best(candidates, criteria)


def refit(splits: DataFrame, kind: str, size: int, text: str = "text",
          params: Mapping | None = None) -> ScreeningModel:
    """The chosen configuration on train and validation together."""
    rows = splits.filter(F.col("split").isin("train", "validation"))
    tfidf = fit_vocabulary(rows, text, TfidfParams(max_features=size))
    vectors = cut_lineage(vectorise(tfidf, rows, text).select("doc_id", "label", "features"))
    return ScreeningModel(tfidf, FITTERS[kind](vectors, class_labels(rows), **(params or {})))


def fit_lsa_model(train: DataFrame, text: str = "text", dimensions: int = C.LSA_DIMENSIONS,
                  params: TfidfParams = TfidfParams(min_df=2, max_df=0.95),
                  kind: str = "Calibrated LinearSVC", **fit) -> ScreeningModel:
    """TF-IDF, truncated SVD, classifier on the dense projection."""
    tfidf = fit_vocabulary(train, text, params)
    sparse = cut_lineage(vectorise(tfidf, train, text).select("doc_id", "label", "features"))
    lsa = LsaModel.fit(sparse, "features", dimensions)
    dense = cut_lineage(lsa.transform(sparse, "features", "features"))
    return ScreeningModel(tfidf, FITTERS[kind](dense, class_labels(train), **fit), lsa)


def active_model(spark: SparkSession, accuracy: Mapping[str, float]) -> DataFrame:
    """Which model serves: the higher test accuracy, the first named on a tie."""
    rows = [(i, name, value) for i, (name, value) in enumerate(accuracy.items())]
    table = spark.createDataFrame(rows, "place int, model string, accuracy double")
    return table.orderBy(F.desc("accuracy"), "place").limit(1).select("model", "accuracy")


def evaluate_saved(spark: SparkSession, path: str, rows: DataFrame, text: str = "text"):
    """Metrics of a saved model on a reproduced split."""
    model = ScreeningModel.load(spark, path)
    return metric_rows(spark, {("saved", "test"): model_metrics(
        model.classifier, model.vectors(rows, text))})


# -- grid over TF-IDF settings (F4) ---------------------------------------------------------

def tfidf_grid(splits: DataFrame, text: str = "text", grid: Mapping = C.TFIDF_GRID,
               probe: str = "LogisticRegression", **fit) -> DataFrame:
    """Validation macro F1 of a linear probe for every setting, best first.

    Settings of one n-gram range differ in which terms they keep, not in their weights: one
    vocabulary holds the terms of all of them, each setting is a subset of its features, and the
    probes of all settings are one solve over one table of vectors.
    """
    spark = splits.sparkSession
    train, validation = (splits.filter(F.col("split") == s) for s in ("train", "validation"))
    labels, n = class_labels(train), train.count()
    kind, rows = LINEAR[probe], []
    balanced, c, max_iter = fit.get("balanced", True), fit.get("c", 1.0), fit.get("max_iter", 100)
    bounds = list(itertools.product(grid["min_df"], grid["max_df"]))
    for low, high in grid["ngram_range"]:
        params = TfidfParams(max(grid["max_features"]), low, high, strip_accents=False)
        stats = frequent_statistics(_cleaned(train, text), "_clean", params, bounds)
        kept = {b: _ranked_terms(stats, b, n, max(grid["max_features"])) for b in bounds}
        union = sorted({t for own in kept.values() for t in own}, key=lambda t: (-t[1], t[0]))
        place = {t[0]: i for i, t in enumerate(union)}
        tfidf = TfidfModel([t[0] for t in union], [t[2] for t in union], params)
        settings, subsets = [], []
        for size, bound in itertools.product(grid["max_features"], bounds):
            own = np.zeros(len(union), dtype=bool)
            own[[place[t[0]] for t in kept[bound][:size]]] = True
            settings.append((size, bound, int(own.sum())))
            subsets.append(own)
        keep = ["doc_id", "label", "features"]
        blocks = linear_blocks(vectorise(tfidf, train, text).select(*keep), labels, subsets=subsets)
        check = linear_blocks(vectorise(tfidf, validation, text).select(*keep), labels, subsets=subsets)
        problems = [p for i in range(len(subsets)) for p in kind.problems(blocks, c, i, balanced)]
        found = confusions(check, problems, solve(blocks, problems, max_iter=max_iter), held_out=False)
        for block in (blocks, check):
            block.release()
        rows += [(size, f"({low}, {high})", bound[0], float(bound[1]), terms, round(macro_f1(x), 4))
                 for (size, bound, terms), x in zip(settings, found, strict=True)]
    return spark.createDataFrame(
        rows, "max_features int, ngram_range string, min_df int, max_df double, "
        "vocab_size int, macro_f1 double").orderBy(F.desc("macro_f1"), "max_features")


def _ranked_terms(stats: DataFrame, bound: tuple, n: int, most: int) -> list[tuple[str, int, float]]:
    """(term, frequency, idf) of the most frequent terms within the bounds: the vocabulary itself."""
    rows = (stats.filter((F.col("df") >= bound[0]) & (F.col("df") <= bound[1] * n))
            .orderBy(F.desc("cf"), "term").limit(most)
            .select("term", "cf", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf")).collect())
    return [(r.term, r.cf, r.idf) for r in rows]
