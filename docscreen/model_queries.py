"""Registered queries with fitted models.

Naive Bayes is a closed formula and is compared value by value. Of the iteratively fitted models a
query returns what must hold whatever the solver does: one row per test document with its label,
whether the prediction is a known class, whether the scores are proper, and whether the model is
accurate; of sweeps and searches every setting with a check of its metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.operators import evaluate, models
from docscreen.operators.features import LsaModel, TfidfParams, first_features
from docscreen.plans import audit, score, train
from docscreen.queries import (D, REQUIREMENTS, by_lang, lines, query, screened, table,
                               vocabulary_words)
from docscreen.session import cut_lineage, shared_folder, spread
from docscreen.streaming import arrivals

#: Features of the fitted models, as the default of the sweep's smallest size.
FEATURES = C.MAX_FEATURES_GRID[0]
KINDS = ("LogisticRegression", "LinearSVC", "Calibrated LinearSVC", "LinearSVC balanced")
#: Kinds whose grids ``grid_search`` goes through.
SEARCHED = ("MultinomialNB", "LogisticRegression", "LinearSVC")
#: Accuracy on the test rows that a useful model reaches, and that of the shallow forest.
GOOD, FAIR = 0.8, 0.5

_stages: dict[tuple, object] = {}


def _version(spark: SparkSession, sf: str) -> tuple:
    """Application, path, size and time of the input: what a shared stage depends on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    status = files.getFileStatus(path)
    return (spark.sparkContext.applicationId, sf, files.getContentSummary(path).getLength(),
            status.getModificationTime())


def _shared(build):
    """A stage that several queries need: built once for one state of the input."""
    def get(spark, sf):
        key = (build.__name__, *_version(spark, sf))
        if key not in _stages:
            for old in [k for k in _stages if k[:3] == key[:3]]:
                del _stages[old]
            _stages[key] = build(spark, sf)
        return _stages[key]

    return get


@_shared
def _splits(spark: SparkSession, sf: str) -> DataFrame:
    """Audited, split corpus."""
    return spread(cut_lineage(audit.audited_splits(by_lang(spark, sf))), D)


@_shared
def _vectors(spark: SparkSession, sf: str):
    """Vocabulary of the training rows and the vectors of all splits."""
    splits = _splits(spark, sf)
    tfidf = train.fit_vocabulary(splits.filter("split = 'train'"), "text",
                                 TfidfParams(max_features=FEATURES))
    return tfidf, cut_lineage(train.vectorise(tfidf, splits, "text").select(
        D, "text", "label", "split", "features"))


def _part(spark, sf, name):
    return _vectors(spark, sf)[1].filter(F.col("split") == name)


def _fit(spark, sf, kind, **params):
    rows = _part(spark, sf, "train").select(D, "label", "features")
    return models.FITTERS[kind](rows, models.class_labels(rows), **params)


@_shared
def _model(spark, sf) -> train.ScreeningModel:
    return train.ScreeningModel(_vectors(spark, sf)[0], _fit(spark, sf, "MultinomialNB"))


def checked(predicted: DataFrame, classes, floor: float, scores: str | None = None) -> DataFrame:
    """What must hold of every prediction and of all of them together."""
    rows = cut_lineage(predicted.select(D, "label", F.col("prediction").isin(list(classes)).alias("known"), (
        F.abs(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-6 if scores
        else F.lit(True)).alias("proper"), (F.col("label") == F.col("prediction")).alias("_hit")))
    share = rows.agg(F.avg(F.col("_hit").cast("int"))).first()[0]
    return rows.select(D, "label", "known", "proper", F.lit(bool(share and share >= floor)).alias("accurate"))


def _tested(spark, sf, kind, floor=GOOD, **params) -> DataFrame:
    fitted = _fit(spark, sf, kind, **params)
    test = _part(spark, sf, "test")
    if not fitted.probabilistic:
        return checked(fitted.predict(test), fitted.labels, floor)
    return checked(fitted.score(fitted.predict(test), "scores"), fitted.labels, floor, "scores")


@query
def nb_fit(spark, sf):
    fitted = _model(spark, sf).classifier
    return fitted.predict(_part(spark, sf, "test")).select(
        D, "label", "prediction", F.round("confidence", 6).alias("confidence"))


@query
def lr_fit(spark, sf):
    return _tested(spark, sf, "LogisticRegression", balanced=True)


@query
def svc_fit(spark, sf):
    return _tested(spark, sf, "LinearSVC balanced")


@query
def svc_plain_fit(spark, sf):
    """Every class with the same weight."""
    return _tested(spark, sf, "LinearSVC")


@query
def calibrated_fit(spark, sf):
    return _tested(spark, sf, "Calibrated LinearSVC")


@query
def forest_fit(spark, sf):
    return _tested(spark, sf, "RandomForest", FAIR)


def _searched(spark, found) -> DataFrame:
    rows = models.search_results(found)
    return spark.createDataFrame([(p, 0.0 <= f1 <= 1.0) for p, f1 in rows], "params string, in_range boolean")


@query
def grid_search(spark, sf):
    """Every value of the grid of each kind by cross-validation."""
    rows = _part(spark, sf, "train").select(D, "label", "features")
    labels = models.class_labels(rows)
    out = [(kind, p, 0.0 <= f1 <= 1.0) for kind in SEARCHED
           for p, f1 in models.search_results(models.grid_search(rows, labels, kind, balanced=kind != "MultinomialNB"))]
    return spark.createDataFrame(out, "model string, params string, in_range boolean")


#: Smaller forests than the default grid of the operator, whose 40 fits take hours on one machine.
FOREST_GRID = {"numTrees": [10, 20], "maxDepth": [4, 6], "minInstancesPerNode": [1, 2]}


@query
def forest_search(spark, sf):
    rows = _part(spark, sf, "train").select(D, "label", "features")
    return _searched(spark, models.grid_search(rows, models.class_labels(rows), "RandomForest",
                                               draws=8, grid=FOREST_GRID))


@query
def tfidf_grid(spark, sf):
    """All settings with the logistic probe."""
    out = train.tfidf_grid(_splits(spark, sf))
    return out.select("max_features", "ngram_range", "min_df", "max_df", "vocab_size",
                      F.col("macro_f1").between(0, 1).alias("in_range"))


@_shared
def _sweep(spark, sf):
    return train.candidate_sweep(_splits(spark, sf))


@_shared
def _smallest(spark, sf):
    """All kinds at the smallest size."""
    return train.candidate_sweep(_splits(spark, sf), sizes=(FEATURES,))


def _consistent(model: train.ScreeningModel, vectors: DataFrame, reported: dict) -> bool:
    """Reported accuracy and class F1 against a plain count over the predictions."""
    counted = model.classifier.predict(vectors).groupBy("label", "prediction").count().collect()  # pairs of classes
    pairs = [(r.label, r.prediction, r["count"]) for r in counted]
    total = sum(n for *_, n in pairs)
    hits = sum(n for a, b, n in pairs if a == b)
    f1 = []
    for c in {a for a, *_ in pairs} | {b for _, b, _ in pairs}:
        support = sum(n for a, _, n in pairs if a == c)
        guessed = sum(n for _, b, n in pairs if b == c)
        f1.append(2 * sum(n for a, b, n in pairs if a == b == c) / (support + guessed))
    return (abs(hits / total - reported["accuracy"]) < 1e-9
            and abs(sum(f1) / len(f1) - reported["macro_f1"]) < 1e-9
            and all(0 <= reported[m] <= 1 for m in train.METRICS))


@query
def candidate_sweep(spark, sf):
    """Every size with every kind; metrics against a recount over the predictions."""
    candidates, fitted = _sweep(spark, sf)
    rows = _splits(spark, sf).filter("split = 'validation'")
    # Those of the smallest size come from its own vocabulary, not from the vectors of the largest one.
    small, *_, large = C.MAX_FEATURES_GRID
    widest = cut_lineage(fitted[KINDS[0], large].vectors(rows).select(D, "label", "features"))
    vectors = {size: widest.withColumn("features", first_features("features", len(fitted[KINDS[0], size].tfidf.terms)))
               for size in C.MAX_FEATURES_GRID}
    vectors[small] = cut_lineage(fitted[KINDS[0], small].vectors(rows).select(D, "label", "features"))
    out = [(r.model, r.max_features, _consistent(fitted[r.model, r.max_features], vectors[r.max_features], r.asDict()))
           for r in candidates.collect()]
    return spark.createDataFrame(out, "model string, max_features int, consistent boolean")


@query
def model_select(spark, sf):
    candidates = _sweep(spark, sf)[0]
    best = train.select_model(candidates)
    top = max(tuple(r) for r in candidates.select("macro_f1", "accuracy", "weighted_f1").collect())
    return best.select(F.col("model").isin(list(KINDS)).alias("known"),
                       F.col("max_features").isin(list(C.MAX_FEATURES_GRID)).alias("swept"),
                       F.lit(tuple(best.select("macro_f1", "accuracy", "weighted_f1").first()) == top).alias("best"))


def _test_rows(spark, sf) -> DataFrame:
    """Metrics of the models of the smallest size on both splits, as long rows."""
    found = {}
    for (kind, _), model in _smallest(spark, sf)[1].items():
        for part in ("validation", "test"):
            found[kind, part] = train.model_metrics(model.classifier, _part(spark, sf, part))
    return train.metric_rows(spark, found)


@query
def model_table(spark, sf):
    """One row per model, one column per split and metric."""
    out = evaluate.comparison_table(_test_rows(spark, sf))
    names = [c for c in out.columns if c != "model"]
    fine = F.lit(True)
    for n in names:
        fine = fine & F.coalesce(F.col(n).between(0, 1), F.lit(False))
    return out.select("model", F.lit(len(names)).alias("metrics"), fine.alias("in_range"))


@query
def model_compare(spark, sf):
    """Validation next to test, joined by model name."""
    rows = _test_rows(spark, sf).filter("metric = 'macro_f1'")
    sides = [rows.filter(F.col("split") == s).select("model", F.col("value").alias(s))
             for s in ("validation", "test")]
    return sides[0].join(sides[1], "model").select("model", *[
        F.col(s).between(0, 1).alias(s) for s in ("validation", "test")])


@query
def refit(spark, sf):
    best = train.select_model(_sweep(spark, sf)[0]).first()
    model = train.refit(_splits(spark, sf), best.model, best.max_features)
    return checked(model.predict(_splits(spark, sf).filter("split = 'test'")), model.classifier.labels, GOOD)


@query
def lsa(spark, sf):
    """Projection of every document on the leading singular vectors: no unit vector gets longer."""
    from pyspark.ml.functions import vector_to_array

    rows = _vectors(spark, sf)[1]
    fitted = LsaModel.fit(rows.filter("split = 'train'"), "features", C.LSA_DIMENSIONS)
    out = fitted.transform(rows.select(D, "features"), "features", "v")
    ordered = all(a >= b - 1e-9 for a, b in zip(fitted.singular_values, fitted.singular_values[1:]))
    return out.select(D, F.aggregate(vector_to_array("v"), F.lit(0.0), lambda a, x: a + x * x)
                      .between(0, 1 + 1e-6).alias("bounded"), F.lit(ordered).alias("ordered"),
                      F.lit(0 < fitted.explained <= 1 + 1e-6).alias("explained"))


@query
def active_model(spark, sf):
    """LSA against TF-IDF by test accuracy."""
    splits, test = _splits(spark, sf), _splits(spark, sf).filter("split = 'test'")
    semantic = train.fit_lsa_model(splits.filter("split = 'train'"),
                                   params=TfidfParams(max_features=FEATURES), kind="LogisticRegression")
    plain = _model(spark, sf)
    accuracy = {name: train.model_metrics(m.classifier, m.vectors(test))["accuracy"]
                for name, m in (("tfidf", plain), ("semantic", semantic))}
    return train.active_model(spark, accuracy).select(
        F.col("model").isin(list(accuracy)).alias("known"),
        (F.col("accuracy") == max(accuracy.values())).alias("best"))


@query
def reevaluate(spark, sf):
    """A saved and loaded model has the metrics of the one in memory."""
    model, test = _model(spark, sf), _splits(spark, sf).filter("split = 'test'")
    path = f"{shared_folder(spark)}/saved-{spark.sparkContext.applicationId}"
    model.save(spark, path)
    now = train.model_metrics(model.classifier, model.vectors(test))
    saved = train.evaluate_saved(spark, path, test)
    expected = F.create_map(*[F.lit(x) for kv in now.items() for x in kv])
    return saved.select("model", "split", "metric", (
        F.abs(F.col("value") - F.element_at(expected, F.col("metric"))) < 1e-9).alias("equal"))


# -- scoring ---------------------------------------------------------------------------------

@query
def score_docs(spark, sf):
    return score.score_documents(by_lang(spark, sf), _model(spark, sf)).select(
        D, "status", "prediction", F.round("confidence", 6).alias("confidence"),
        lines(F.col("top_labels")).alias("top"))


@query
def analyze(spark, sf):
    out = score.analyze(by_lang(spark, sf), _model(spark, sf), vocabulary_words(), REQUIREMENTS)
    return out.select(D, "status", "predicted_role", lines(F.col("detected_skills")).alias(
        "skills"), F.col("screening_breakdown.final_score_pct").alias("final"))


def _stream_folder(spark) -> str:
    import uuid

    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query
def stream_screening(spark, sf):
    """Documents as a file stream through the rule classifier and the screening score."""
    schema = table(spark, sf, "documents").schema
    stream = arrivals.read_table_arrivals(spark, f"{sf}/documents.parquet", schema)
    out = _stream_folder(spark)

    def step(docs):
        parts = "screening_breakdown"
        return screened(spark, sf, docs).select(
            D, F.col(f"{parts}.final_score_pct").alias("final"),
            lines(F.col("missing_common_skills")).alias("missing"))

    arrivals.run_available(stream, step, f"{out}/data", f"{out}/state")
    return spark.read.parquet(f"{out}/data")


@query
def stream_repeats(spark, sf):
    """Events as a stream; the first event per user and type is kept within the watermark."""
    schema = table(spark, sf, "events").schema
    stream = arrivals.read_table_arrivals(spark, f"{sf}/events.parquet", schema)
    out = _stream_folder(spark)

    def step(events):
        timed = events.withColumn("at", F.col("ts").cast("timestamp"))
        key = F.concat_ws("|", "user_id", "event_type")
        return arrivals.drop_repeats(timed, key, "at", "3650 days").select("user_id", "event_type")

    arrivals.run_available(stream, step, f"{out}/data", f"{out}/state")
    return spark.read.parquet(f"{out}/data")


#: Windows of ``stream_windows``, and how long one takes rows after its end.
STREAM_WINDOW, STREAM_DELAY = "6 hours", "1 day"


@query
def stream_windows(spark, sf):
    """Events in three deliveries, a tenth of them one delivery too late: the first event per user, type
    and window, and what came after its window was closed, in an output of its own.

    Each delivery starts the streams anew; they go on from their checkpoints.
    """
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    third = F.least(F.floor((F.dayofmonth("at") - 1) / 10), F.lit(2))
    slow = (F.col("event_id") % 10 == 7).cast("int")
    events = events.withColumn("delivery", F.least(third + slow, F.lit(2)).cast("int"))
    out = _stream_folder(spark)
    for i in range(3):
        events.filter(F.col("delivery") == i).drop("delivery").write.mode("append").parquet(f"{out}/in")
        stream = arrivals.read_arrivals(spark, f"{out}/in", events.drop("delivery").schema)
        arrivals.run_available(stream, lambda df: arrivals.first_in_window(
            df, ["user_id", "event_type"], "at", STREAM_WINDOW, STREAM_DELAY), f"{out}/first", f"{out}/state")
        arrivals.run_late(stream, "at", f"{out}/late", f"{out}/late-state", STREAM_WINDOW, STREAM_DELAY)
    first = spark.read.parquet(f"{out}/first").select(
        F.lit("first").alias("kind"), "user_id", "event_type", F.col("window.start").alias("start"))
    late = spark.read.schema(events.drop("delivery").schema).parquet(f"{out}/late").select(
        F.lit("late").alias("kind"), "user_id", "event_type", F.window("at", STREAM_WINDOW)["start"].alias("start"))
    return (first.unionByName(late).groupBy("kind", "user_id", "event_type", F.unix_timestamp("start").alias("start"))
            .agg(F.count(F.lit(1)).alias("rows")))
