"""The joint solver against plain gradient checks and separate fits."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from docscreen.operators import linear, models
from docscreen.operators.linear import HINGE, SOFTMAX, Fit, Problem

D, K = 14, 3
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.random((240, D)) * (rng.random((240, D)) < 0.35)
    x[7] = 0.0
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = np.where(norm > 0, x / np.where(norm > 0, norm, 1), 0)
    target = (x @ rng.standard_normal((D, K)) + 0.3 * rng.standard_normal((240, K))).argmax(axis=1)
    return x, target, np.arange(240) % 3


@pytest.fixture(scope="module")
def blocks(spark, data):
    x, target, fold = data
    rows = [(Vectors.sparse(D, [(j, float(v)) for j, v in enumerate(r) if v]), float(t), int(f))
            for r, t, f in zip(x, target, fold)] + [(Vectors.sparse(D, [(0, 1.0)]), None, 0)]
    df = spark.createDataFrame(rows, ["features", "target", "fold"])
    subsets = [None, np.arange(D) < 6, np.arange(D) % 2 == 0]
    out = linear.blocks_of(df.repartition(3), D, K, fold="fold", subsets=subsets)
    yield out
    out.release()


def objective(x, target, problem, fold, fit, subset):
    if subset is not None:
        x = x * subset
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = np.where(norm > 0, x / np.where(norm > 0, norm, 1), 0)
    own = np.full(len(x), problem.c)
    if problem.weights:
        own *= np.asarray(problem.weights)[target]
    if problem.held_out is not None:
        own *= fold != problem.held_out
    m = x @ fit.weights.T + fit.intercepts
    half = 0.5 * (fit.weights ** 2).sum()
    if problem.loss == HINGE:
        sign = np.where(target[:, None] == np.arange(K), 1, -1)
        return half + 0.5 * (fit.intercepts ** 2).sum() + (own[:, None] * np.maximum(0, 1 - sign * m) ** 2).sum()
    return half + (own * (np.log(np.exp(m).sum(axis=1)) - m[np.arange(len(x)), target])).sum()


PROBLEMS = [Problem(HINGE), Problem(SOFTMAX), Problem(HINGE, 5.0, (1.0, 2.0, 0.5), 1), Problem(SOFTMAX, 0.3, (3.0, 1.0, 1.0), 2, 1),
            Problem(HINGE, 1.0, None, 0, 2), Problem(SOFTMAX, 10.0)]


@pytest.fixture(scope="module")
def fits(blocks):
    return linear.solve(blocks, PROBLEMS)


@pytest.mark.parametrize("i", range(len(PROBLEMS)))
def test_no_small_move_lowers_the_objective(data, blocks, fits, i):
    x, target, fold = data
    problem, fit = PROBLEMS[i], fits[i]
    subset = blocks.subsets[problem.features]
    best = objective(x, target, problem, fold, fit, subset)
    rng = np.random.default_rng(i)
    size = 0.05 * np.linalg.norm(fit.weights)  # ten times the tolerance
    for _ in range(60):
        move = rng.standard_normal((K, D))
        if subset is not None:
            move *= subset
        move *= size / np.linalg.norm(move)
        free = rng.standard_normal(K) * 0.02
        assert objective(x, target, problem, fold, Fit(fit.weights + move, fit.intercepts + free), subset) >= best - 1e-6
    if subset is not None:
        assert not fit.weights[:, ~subset].any()


def test_joint_and_single_solves_agree(blocks, fits, monkeypatch):
    monkeypatch.setattr(linear, "TOLERANCE", 1e-6)
    for problem, fit in zip(PROBLEMS, fits):
        alone = linear.solve(blocks, [problem])[0]
        assert np.linalg.norm(alone.weights - fit.weights) <= 2 * 5e-3 * np.linalg.norm(alone.weights) + 1e-6
    warm = linear.solve(blocks, PROBLEMS[:1], [Fit(fits[0].weights[:, :6], fits[0].intercepts)])[0]
    exact = linear.solve(blocks, PROBLEMS[:1])[0]
    assert np.abs(warm.weights - exact.weights).max() < 1e-4


def test_few_curvature_rows_do_not_change_the_result(blocks, fits, monkeypatch):
    monkeypatch.setattr(linear, "CURVE_ROWS", 3)
    again = linear.solve(blocks, PROBLEMS)
    for a, b in zip(again, fits):
        assert np.linalg.norm(a.weights - b.weights) <= 2e-2 * np.linalg.norm(b.weights)


def test_confusions_and_f1(data, blocks, fits):
    x, target, fold = data
    problem, fit = PROBLEMS[2], fits[2]
    own = fold == 1
    best = (x @ fit.weights.T + fit.intercepts).argmax(axis=1)
    expected = np.zeros((K, K), dtype=int)
    np.add.at(expected, (target[own], best[own]), 1)
    assert (linear.confusions(blocks, [problem], [fit])[0] == expected).all()
    assert linear.confusions(blocks, [problem], [fit], held_out=False).sum() == len(x)
    assert linear.macro_f1(np.array([[2, 0], [0, 0]])) == 1.0
    assert linear.macro_f1(np.array([[1, 1], [0, 2]])) == pytest.approx((2 / 3 + 4 / 5) / 2)


def test_dense_vectors_and_scores(spark, data):
    x, target, _ = data
    names = ["a", "b", "c"]
    rows = [(i, names[t], Vectors.dense(r)) for i, (r, t) in enumerate(zip(x.tolist(), target))]
    df = spark.createDataFrame(rows, ["doc_id", "label", "features"])
    for kind in ("LinearSVC", "LogisticRegression", "Calibrated LinearSVC"):
        model = models.FITTERS[kind](df, names)
        got = {r.doc_id: r.scores for r in model.score(df).collect()}
        s = np.array([got[i] for i in range(len(x))])
        assert (s.argmax(axis=1) == target).mean() > 0.8
        if kind == "LinearSVC":
            assert np.allclose(s, x @ model.fit.weights.T + model.fit.intercepts)
        else:
            assert np.allclose(s.sum(axis=1), 1.0)


@pytest.mark.parametrize("kind", ["LogisticRegression", "LinearSVC"])
def test_search_by_c(spark, data, kind):
    x, target, _ = data
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(i, names[t], Vectors.dense(r)) for i, (r, t) in enumerate(zip(x.tolist(), target))],
                               ["doc_id", "label", "features"])
    found = models.grid_search(df, names, kind, folds=3, balanced=True)
    assert [p["C"] for p, _ in found.settings] == [0.1, 1.0, 5.0, 10.0]
    assert max(s for _, s in found.settings) > 0.6
    assert found.best.predict(df).count() == len(x)


def test_no_rows(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 0.0]), 0.0)], ["features", "target"]).filter("target > 3")
    blocks = linear.blocks_of(df, 2, 2)
    fit = linear.solve(blocks, [Problem(HINGE)])[0]
    assert not fit.weights.any() and blocks.counts.tolist() == [0, 0]


def test_sums_are_cut_into_slices(spark, monkeypatch):
    """Beyond a few bytes every task hands slices to the executors: the driver gets one array."""
    rows = spark.sparkContext.parallelize(range(40), 5)
    got = []

    def work(part):
        total = sum(part)
        yield np.arange(21.0).reshape(7, 3) * total

    collect = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: got.append(collect(self)) or got[-1])
    monkeypatch.setattr(linear, "FLAT_BYTES", 0)
    found = linear._reduced(rows, work, (7, 3))
    assert (found == np.arange(21.0).reshape(7, 3) * 780).all()
    assert sum(len(piece) for _, piece in got[0]) == 21


def test_blocks_are_cut_by_all_tasks_at_once(spark, monkeypatch):
    """The pass that fills the blocks is one job, not one for each partition."""
    from pyspark import RDD

    monkeypatch.delattr(RDD, "toLocalIterator")
    vectors = [(Vectors.sparse(3, [i % 3], [1.0]), i % 2) for i in range(30)]
    blocks = linear.blocks_of(spark.createDataFrame(vectors, ["features", "target"]).repartition(4), 3, 2)
    assert blocks.counts.tolist() == [15, 15]
    blocks.release()


def test_passes_over_margin_losses_are_few(spark, monkeypatch):
    """Weak regularisation and more rows than are picked, so that these change from step to step."""
    draw = np.random.default_rng(5)
    x = draw.exponential(size=(1500, 120)) * (draw.random((1500, 120)) < 0.2)
    y = (x @ draw.normal(size=120) + 0.3 * draw.normal(size=1500) > 0).astype(float)
    rows = [(Vectors.dense(v / max(np.linalg.norm(v), 1e-9)), t) for v, t in zip(x.tolist(), y.tolist(), strict=True)]
    blocks = linear.blocks_of(spark.createDataFrame(rows, ["features", "target"]).repartition(4), 120, 2)
    valued, passes = linear._valued, []
    monkeypatch.setattr(linear, "CURVE_ROWS", 1000)
    monkeypatch.setattr(linear, "_valued", lambda *a: passes.append(1) or valued(*a))
    fit = linear.solve(blocks, [Problem(HINGE, 100.0)])[0]
    assert len(passes) <= 20
    gradient = valued(blocks, [Problem(HINGE, 100.0)], linear._stacked([fit]))[0, :, :121] + linear._stacked([fit])[0]
    assert np.linalg.norm(gradient) <= 2 * linear.TOLERANCE * np.linalg.norm(linear._stacked([fit])[0])
    blocks.release()


def test_each_class_goes_on_over_its_own_near_rows(spark, monkeypatch):
    """Rows near the margin are too many for all classes together, not for one: the search still ends after few passes."""
    draw = np.random.default_rng(8)
    x = draw.exponential(size=(4000, 150)) * (draw.random((4000, 150)) < 0.15)
    y = (x @ draw.normal(size=(150, 5)) + 0.2 * draw.normal(size=(4000, 5))).argmax(axis=1).astype(float)
    rows = [(Vectors.dense(v / max(np.linalg.norm(v), 1e-9)), t) for v, t in zip(x.tolist(), y.tolist(), strict=True)]
    blocks = linear.blocks_of(spark.createDataFrame(rows, ["features", "target"]).repartition(4), 150, 5)
    valued, passes = linear._valued, []
    monkeypatch.setattr(linear, "CURVE_ROWS", 500)
    monkeypatch.setattr(linear, "NEAR_ROWS", 2500)
    monkeypatch.setattr(linear, "_valued", lambda *a: passes.append(1) or valued(*a))
    fit = linear.solve(blocks, [Problem(HINGE, 10.0)])[0]
    assert len(passes) <= 10
    gradient = valued(blocks, [Problem(HINGE, 10.0)], linear._stacked([fit]))[0, :, :151] + linear._stacked([fit])[0]
    assert (np.linalg.norm(gradient, axis=1) <= 2 * linear.TOLERANCE * np.linalg.norm(linear._stacked([fit])[0], axis=1)).all()
    blocks.release()


def test_slow_softmax_steps_go_on_with_more_rows(spark, monkeypatch):
    """A sample too small for its features makes steps slow; then more rows shape them."""
    draw = np.random.default_rng(9)
    x = draw.exponential(size=(1500, 200)) * (draw.random((1500, 200)) < 0.1)
    y = (x @ draw.normal(size=(200, 3)) + 0.2 * draw.normal(size=(1500, 3))).argmax(axis=1).astype(float)
    rows = [(Vectors.dense(v / max(np.linalg.norm(v), 1e-9)), t) for v, t in zip(x.tolist(), y.tolist(), strict=True)]
    table = spark.createDataFrame(rows, ["features", "target"]).repartition(4)
    spark.conf.set(BATCH, "30")  # and so the rows of a block
    blocks = linear.blocks_of(table, 200, 3)
    spark.conf.unset(BATCH)
    valued, passes = linear._valued, []
    monkeypatch.setattr(linear, "CURVE_ROWS", 8)
    monkeypatch.setattr(linear, "_valued", lambda *a: passes.append(1) or valued(*a))
    linear.solve(blocks, [Problem(SOFTMAX, 50.0)])
    assert len(passes) <= 30
    blocks.release()
