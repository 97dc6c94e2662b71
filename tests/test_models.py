import math

import pytest
from pyspark.sql import functions as F

from docscreen.operators import models
from docscreen.operators.features import TfidfParams
from docscreen.plans import score, train

WORDS = {"sea": ["ship", "wave", "port"], "air": ["wing", "pilot", "cloud"],
         "land": ["road", "truck", "bridge"]}


@pytest.fixture(scope="module")
def splits(spark):
    rows = []
    for i in range(90):
        label = list(WORDS)[i % 3]
        words = WORDS[label]
        text = " ".join([words[i % 2], words[(i + 1) % 3], words[2], "common", "filler"] * 5)
        rows.append((i, f"{text} n{i}x", label, ("train", "validation", "test")[(i // 3) % 3]))
    return spark.createDataFrame(rows, "doc_id bigint, text string, label string, split string")


@pytest.fixture(scope="module")
def vectors(splits):
    rows = splits.filter("split = 'train'")
    tfidf = train.fit_vocabulary(rows, "text", TfidfParams(max_features=40))
    return tfidf, train.vectorise(tfidf, splits, "text").select(
        "doc_id", "label", "split", "text", "features").cache()


@pytest.mark.parametrize("kind, params", [
    ("MultinomialNB", {}), ("LogisticRegression", {"max_iter": 20}), ("LinearSVC", {"max_iter": 10}),
    ("LinearSVC balanced", {"max_iter": 10}), ("Calibrated LinearSVC", {"max_iter": 10}),
    ("RandomForest", {"trees": 5, "depth": 4})])
def test_classifiers(spark, splits, vectors, tmp_path, kind, params):
    tfidf, rows = vectors
    fit_on = rows.filter("split = 'train'")
    labels = models.class_labels(fit_on)
    assert labels == sorted(WORDS)
    model = models.FITTERS[kind](fit_on, labels, **params)
    test = rows.filter("split = 'test'")
    found = train.model_metrics(model, test)
    assert found["accuracy"] == found["macro_f1"] == found["topk_accuracy"] == 1.0
    first = model.predict(test).orderBy("doc_id").first()
    if model.probabilistic:
        assert first.confidence == pytest.approx(first.top_predictions[0].confidence)
        assert sum(p.confidence for p in first.top_predictions) == pytest.approx(1.0)
    else:
        assert first.confidence is None and first.top_predictions == []
    whole = train.ScreeningModel(tfidf, model)
    whole.save(spark, f"{tmp_path}/m")
    again = train.load_first(spark, [f"{tmp_path}/absent", f"{tmp_path}/m"])
    ask = splits.filter("split = 'test'")
    assert sorted(map(str, again.predict(ask).collect())) == sorted(
        map(str, whole.predict(ask).collect()))


def test_missing_artifacts_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="one/vocabulary.*two/classifier"):
        train.load_first(spark, [f"{tmp_path}/one", f"{tmp_path}/two"])


def test_sigmoids_minimise_the_smoothed_loss(spark):
    data = [(0, c, float((i % 2) == c), (i % 7 - 3) * (1 if (i % 2) == c else 0.4) + c)
            for i in range(60) for c in (0, 1)]
    rows = [(f, float(c) if hit else 5.0, c, float(m)) for f, c, hit, m in data]
    table = spark.createDataFrame(rows, "fold int, target double, cls int, m double")
    found = models.fit_sigmoids(table)
    for c in (0, 1):
        own = [(hit, m) for _, k, hit, m in data if k == c]
        p = sum(h for h, _ in own)
        hi, lo = (p + 1) / (p + 2), 1 / (len(own) - p + 2)

        def loss(a, b):
            total = 0.0
            for h, m in own:
                q = 1 / (1 + math.exp(a * m + b))
                t = hi if h else lo
                total -= t * math.log(q) + (1 - t) * math.log(1 - q)
            return total

        a, b = found[0, c]
        best = loss(a, b)
        for da, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
            assert loss(a + da, b + db) >= best - 1e-9


def test_lsa_projection_and_reload(spark, splits, tmp_path):
    model = train.fit_lsa_model(splits.filter("split = 'train'"), dimensions=5,
                                params=TfidfParams(max_features=40), kind="LogisticRegression",
                                max_iter=20)
    assert 0 < model.lsa.explained <= 1.0 + 1e-9
    assert model.lsa.singular_values == sorted(model.lsa.singular_values, reverse=True)
    ask = splits.filter("split = 'test'")
    assert train.model_metrics(model.classifier, model.vectors(ask))["accuracy"] == 1.0
    model.save(spark, f"{tmp_path}/lsa")
    again = train.ScreeningModel.load(spark, f"{tmp_path}/lsa")
    assert sorted(map(str, again.predict(ask).collect())) == sorted(
        map(str, model.predict(ask).collect()))


def test_grid_search_and_evaluator(vectors):
    rows = vectors[1].filter("split = 'train'")
    found = models.grid_search(rows, models.class_labels(rows), "MultinomialNB", folds=2,
                               grid={"smoothing": [0.1, 1.0]})
    results = models.search_results(found)
    assert len(results) == 2 and all(0.0 <= s <= 1.0 for _, s in results)


def test_status_and_scoring(spark, vectors):
    tfidf, rows = vectors
    fit_on = rows.filter("split = 'train'")
    model = train.ScreeningModel(tfidf, models.fit_naive_bayes(fit_on, models.class_labels(fit_on)))
    docs = spark.createDataFrame(
        [(1, None), (2, "  "), (3, "!!!"), (4, "ship wave"), (5, "ship wave port " * 8)],
        "doc_id bigint, text string")
    got = {r.doc_id: r for r in score.score_documents(docs, model).collect()}
    assert [got[i].status for i in range(1, 6)] == [
        "insufficient text", "insufficient text", "no usable text", "too short", "ok"]
    assert got[4].prediction is None and got[5].prediction == "sea"
    full = {r.doc_id: r for r in score.analyze(
        docs, model, {"wave": "Wave"}, {"Sailor": ["Wave", "Rope"]},
        role_aliases={"sea": "Sailor"}).collect()}
    assert full[5].detected_skills == ["Wave"] and full[5].missing_common_skills == ["Rope"]
    assert full[5].predicted_role == "sea" and full[1].screening_breakdown is None
    raw = model.classifier.score(model.vectors(docs.filter("doc_id = 5")))
    p = raw.select(score.probability_map(model).alias("p")).first().p
    assert max(p, key=p.get) == "sea"


def test_active_model(spark):
    assert train.active_model(spark, {"tfidf": 0.5, "semantic": 0.5}).first().model == "tfidf"
    assert train.active_model(spark, {"tfidf": 0.5, "semantic": 0.6}).first().model == "semantic"


def test_weighted_rows(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(4)],
                               "doc_id bigint, label string").withColumn("features", F.lit(1))
    rows = models._prepared(df, ["a", "b"], True).collect()
    assert {r.label: round(r.weight, 6) for r in rows} == {"a": round(4 / 6, 6), "b": 2.0}


def test_lsa_equals_a_plain_decomposition_within_few_jobs(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from docscreen.operators.features import LsaModel

    draw = np.random.default_rng(3)
    x = draw.exponential(size=(500, 300)) * (draw.random((500, 300)) < 0.1) / np.sqrt(np.arange(1, 301))
    df = spark.createDataFrame([(Vectors.sparse(300, [(j, float(v)) for j, v in enumerate(r) if v]),) for r in x], ["features"])
    spark.sparkContext.setJobGroup("lsa", "lsa")
    fitted = LsaModel.fit(df.repartition(4), "features", 60)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("lsa"))
    spark.sparkContext.setJobGroup("other", "other")
    _, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(fitted.singular_values, s[:60], rtol=1e-6)
    assert np.allclose(np.abs(np.sum(fitted.components.toArray().T[:20] * v[:20], axis=1)), 1, atol=1e-3)
    assert jobs <= 40
