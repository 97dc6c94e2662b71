"""Linear classifiers of all classes, folds and settings solved together.

The weights of every class of every problem are rows of one matrix. A step of the solver is two
jobs. The first is a pass over blocks of all rows that gives losses, gradients and the curvature of
each feature, added up in a tree; the blocks stay in executor memory (or on their disks) between
passes. In the second, tasks solve the Newton equations of the classes and problems by conjugate
gradients; these use the whole gradient and the curvature of at most ``CURVE_ROWS`` rows, corrected
by that of all rows feature by feature. A margin loss begins with the way to the lowest point over these rows, the
gradient made that of all rows. Only rows near the margin bend it: where those of a class are at most ``NEAR_ROWS`` (a
pass counts them for several reaches), a task goes on with all of them, and no others, to the lowest point of its loss.
Where they are more, what the sample does not know of the curvature is learned from the gradients of the last
``MEMORY`` steps (L-BFGS with the sampled Newton equations as its first guess), so the number of steps does not grow
with the rows that stay outside the sample. Softmax losses whose slope no longer halves with a step go on
with up to ``WIDE_ROWS`` rows. A step is shortened if the loss of all rows does not fall. A problem is a loss, a regularisation,
class weights, a fold that it does not see and a set of features, so folds of a calibration, values
of a grid and vocabularies of several sizes need one set of blocks and one sequence of passes.

Losses are summed over rows and multiplied by ``c`` next to half the squared weights. The margin
loss is the squared hinge, one class against the others, with the intercept among the weights; the
softmax loss leaves the intercepts free. Both are smooth and the weights' own term makes them
strongly convex, so a gradient of norm e proves an error of the weights of e at most: a search stops
when that is below ``TOLERANCE`` of their norm.

The driver holds weights, gradients and steps: features x classes x problems numbers, a size that the
parameters bound, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HINGE, SOFTMAX = "squared_hinge", "softmax"
#: Error of the weights, relative to their norm, at which a search stops.
TOLERANCE = 5e-3
#: Rows whose curvature shapes a step, steps of conjugate gradients, and the part of the gradient at
#: which they stop. Loss and gradient, and so the result, always come from all rows.
CURVE_ROWS, CURVE_STEPS, CURVE_TOLERANCE = 8192, 30, 0.1
WIDE_ROWS = 65536
#: Bytes of these rows at most, and the curvature of a row (1: undecided) that a step may leave out.
CURVE_BYTES, FLAT = 96 << 20, 1e-4
#: Rows near the margin that a margin loss may be brought to its lowest point over, Newton steps for that, steps of
#: conjugate gradients of each, and the part of the slope at which it ends.
NEAR_ROWS, INNER_STEPS, INNER_CURVE_STEPS, INNER_TOLERANCE = 16384, 12, 60, 0.02
#: How far beyond the margin "near" may reach, and first steps that go to the lowest point over the sample.
REACHES, SAMPLE_STEPS = (0.0, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0, 1.5, 2.0), 3
#: Rows of a block, and of a task while there are few.
BLOCK_ROWS, ROWS_PER_TASK = 256, 512
#: Steps whose gradients correct the sampled curvature.
MEMORY = 10
#: A step: one Newton direction of the sample, the way to the lowest point over the sample or over all rows near the
#: margin, or one Newton direction of up to ``WIDE_ROWS`` rows, for a smooth loss whose last step took less than half the slope.
NEWTON, SAMPLE, NEAR, WIDE = "newton", "sample", "near", "wide"
#: Tasks for each core among which the searches of a step are dealt: these differ in length.
TURNING_TASKS = 4
#: Bytes that one pass may send to the driver without adding up in executors first.
FLAT_BYTES = 8 << 20


@dataclass(frozen=True)
class Problem:
    """One classifier. ``features`` is a place in ``Blocks.subsets``."""

    loss: str
    c: float = 1.0
    weights: tuple[float, ...] | None = None
    held_out: int | None = None
    features: int = 0


@dataclass
class Fit:
    """(classes, features) weights and one intercept a class."""

    weights: np.ndarray
    intercepts: np.ndarray


@dataclass
class Blocks:
    """Rows as blocks of arrays, and what all problems share."""

    rdd: RDD
    size: int
    classes: int
    subsets: list[np.ndarray | None]
    #: Rows of each class.
    counts: np.ndarray

    def balanced(self) -> tuple[float, ...]:
        """``n / (k * n_c)`` for each class."""
        return tuple((self.counts.sum() / (self.classes * np.maximum(self.counts, 1))).tolist())

    def release(self) -> None:
        self.rdd.unpersist()


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column."""
    offsets = column.offsets.to_numpy()
    return np.diff(offsets), column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy()


def _entries(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of each row, their features and values, for sparse and dense vectors."""
    lengths, values = _lists(column.field("values"))
    if column.field("indices").null_count == len(column):
        return lengths, np.concatenate([np.arange(n, dtype=np.int32) for n in lengths] or [np.zeros(0, np.int32)]), values
    return lengths, _lists(column.field("indices"))[1], values


def _scales(rows: np.ndarray, n: int, indices: np.ndarray, values: np.ndarray,
            subsets: Sequence[np.ndarray | None]) -> np.ndarray:
    """(subsets, rows): one over the norm of a row within each subset of the features."""
    out = np.ones((len(subsets), n))
    for i, subset in enumerate(subsets):
        if subset is not None:
            own = subset[indices]
            norm = np.sqrt(np.bincount(rows[own], weights=values[own] ** 2, minlength=n))
            out[i] = np.where(norm > 0, 1.0 / np.where(norm > 0, norm, 1.0), 0.0)
    return out


def blocks_of(df: DataFrame, size: int, classes: int, features: str = "features", target: str = "target",
              fold: str | None = None, subsets: Sequence[np.ndarray | None] = (None,)) -> Blocks:
    """Blocks of the rows with a target (a class number); kept until ``release``.

    A subset (a boolean for each feature) stands for vectors that have these features only and unit
    length; None for the vectors as they are. Rows without a fold are seen by every problem.
    """
    shared = df.sparkSession.sparkContext.broadcast(list(subsets))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                lengths, indices, values = _entries(part.column(0))
                rows = np.repeat(np.arange(len(lengths)), lengths)
                arrays = (lengths.astype(np.int64), indices.astype(np.int32), values.astype(np.float64),
                          part.column(1).to_numpy().astype(np.int32), part.column(2).to_numpy().astype(np.int32),
                          _scales(rows, len(lengths), indices, values, shared.value))
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays],
                                                 names=["lengths", "indices", "values", "target", "fold", "scales"])

    own = df.select(F.unwrap_udt(F.col(features)).alias("v"), F.col(target).cast("int").alias("t"),
                    (F.coalesce(F.col(fold), F.lit(-1)) if fold else F.lit(-1)).cast("int").alias("f"))
    cutted = own.filter("t is not null and t >= 0").mapInArrow(
        cut, "lengths binary, indices binary, values binary, target binary, fold binary, scales binary")
    rdd = cutted.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

    def count(rows):
        total = np.zeros(classes, dtype=np.int64)
        for row in rows:
            total += np.bincount(np.frombuffer(row[3], dtype=np.int32), minlength=classes)
        yield total

    return Blocks(rdd, size, classes, list(subsets), _reduced(rdd, count, (classes,)).astype(np.int64))


def few_tasks(df: DataFrame) -> DataFrame:
    """Passes are short: few, well-filled tasks for small inputs."""
    tasks = max(1, math.ceil(df.count() / ROWS_PER_TASK))
    return df.coalesce(tasks) if tasks < df.rdd.getNumPartitions() else df


class _Rows:
    """A block opened for a pass; values are in single precision where they only shape a step."""

    def __init__(self, row: tuple, subsets: int, kind=np.float64):
        self.lengths = np.frombuffer(row[0], dtype=np.int64)
        self.n = len(self.lengths)
        self.indices = np.frombuffer(row[1], dtype=np.int32).astype(np.intp)
        self.values = np.frombuffer(row[2], dtype=kind)
        self.target = np.frombuffer(row[3], dtype=np.int32)
        self.fold = np.frombuffer(row[4], dtype=np.int32)
        self.scales = np.frombuffer(row[5], dtype=np.float64).reshape(subsets, self.n)
        self.filled = np.flatnonzero(self.lengths)
        self.starts = (np.cumsum(self.lengths) - self.lengths)[self.filled]
        self.row = np.repeat(np.arange(self.n), self.lengths)

    def margins(self, weights: np.ndarray, subset: int) -> np.ndarray:
        """(classes, rows); the last weight of a class is its intercept."""
        out = np.zeros((len(weights), self.n))
        for k, w in enumerate(weights):
            if len(self.filled):
                out[k, self.filled] = np.add.reduceat(self.values * w[self.indices], self.starts)
        return out * self.scales[subset] + weights[:, -1:]

    def add_slopes(self, gradient: np.ndarray, squares: np.ndarray, slopes: np.ndarray, curves: np.ndarray,
                   subset: int) -> None:
        """Sums of slope times value, and of curvature times squared value; rows without a slope are left out."""
        width = gradient.shape[1] - 1
        scaled = self.values * self.scales[subset][self.row]
        squared = scaled * scaled
        for k, (s, c) in enumerate(zip(slopes, curves, strict=True)):
            on = s != 0
            if not on.any():
                continue
            few = slice(None) if 2 * np.count_nonzero(on) > self.n else on[self.row]
            indices, row = self.indices[few], self.row[few]
            gradient[k, :-1] += np.bincount(indices, scaled[few] * s[row], minlength=width)
            squares[k] += np.bincount(indices, squared[few] * c[row], minlength=width)
        gradient[:, -1] += slopes.sum(axis=1)


def _row_weights(problem: Problem, rows: _Rows) -> np.ndarray:
    own = np.full(rows.n, problem.c)
    if problem.weights is not None:
        own *= np.asarray(problem.weights)[rows.target]
    if problem.held_out is not None:
        own *= rows.fold != problem.held_out
    return own


def _signs(rows: _Rows, classes: int) -> np.ndarray:
    sign = np.full((classes, rows.n), -1.0)
    sign[rows.target, np.arange(rows.n)] = 1.0
    return sign


def _softmax(margins: np.ndarray) -> np.ndarray:
    shares = np.exp(margins - margins.max(axis=0))
    return shares / shares.sum(axis=0)


def _losses(problem: Problem, rows: _Rows, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each class (softmax: all in the first), its slope and its curvature for every margin."""
    own = _row_weights(problem, rows)
    if problem.loss == HINGE:
        sign = _signs(rows, len(margins))
        short = np.maximum(0.0, 1.0 - sign * margins)
        return (own * short * short).sum(axis=1), -2.0 * own * sign * short, 2.0 * own * (short > 0)
    at = (rows.target, np.arange(rows.n))
    top = margins.max(axis=0)
    loss = np.zeros(len(margins))
    loss[0] = (own * (np.log(np.exp(margins - top).sum(axis=0)) + top - margins[at])).sum()
    slopes = _softmax(margins)
    curves = own * slopes * (1.0 - slopes)
    slopes[at] -= 1.0
    return loss, own * slopes, curves


def _direction(problem: Problem, blocks: Iterator[_Rows], weights: np.ndarray, gradient: np.ndarray,
               bends: np.ndarray, scale: float, subset: np.ndarray | None, own_class: int | None,
               reach: float) -> np.ndarray:
    """Newton direction with the curvature of these rows, each of them standing for ``scale`` rows.

    Only rows that are curved are gone through: the undecided ones, or those short of their margin and, as
    the step may make them so, those up to ``reach`` beyond it.
    """
    free, width = np.ones_like(weights), weights.shape[1] - 1
    if problem.loss == SOFTMAX:
        free[:, -1] = 0.0
    parts = []  # one a block, which stays in the processor's cache
    for b in blocks:
        margins, own = b.margins(weights, problem.features), scale * _row_weights(problem, b)
        if problem.loss == HINGE:
            shares = np.ones_like(margins)
            own = 2.0 * own * (np.where(b.target == own_class, 1.0, -1.0) * margins[0] < 1.0 + reach)
            curved_rows = own > 0
        else:
            shares = _softmax(margins)
            curved_rows = own * (1.0 - shares.max(axis=0)) > FLAT * scale * problem.c
        keep = curved_rows[b.row]
        if curved_rows.any():
            place = np.cumsum(curved_rows) - 1
            row = place[b.row[keep]].astype(np.int32)
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            parts.append((row, starts, b.indices[keep].astype(np.int32),
                          (b.values * b.scales[problem.features][b.row])[keep].astype(np.float32),
                          own[curved_rows], shares[:, curved_rows]))

    def add(out: np.ndarray, row: np.ndarray, at: np.ndarray, along: np.ndarray, factors: np.ndarray) -> None:
        for k, a in enumerate(along):
            out[k, :-1] += np.bincount(at, factors * a[row], minlength=width)
        out[:, -1] += along.sum(axis=1)

    own_bends = np.zeros_like(weights)
    for row, starts, at, values, own, shares in parts:
        add(own_bends, row, at, own * (shares if problem.loss == HINGE else shares * (1.0 - shares)), values * values)
    # Features that these rows have less of than all rows keep the curvature that all rows give them.
    missing = np.maximum(0.0, bends - own_bends)
    bends = free + np.maximum(bends, own_bends) + (free == 0) * 1e-9

    def curved(v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for row, starts, at, values, own, shares in parts:
            along = np.zeros((len(v), len(own)))
            if len(starts):
                along[:, row[starts]] = [np.add.reduceat(values * w[at], starts) for w in v]
            along += v[:, -1:]
            along = own * along if problem.loss == HINGE else own * shares * (along - (shares * along).sum(axis=0))
            add(out, row, at, along, values)
        if subset is not None:
            out[:, :-1][:, ~subset] = 0.0
        return out + (free + missing) * v

    x, r = np.zeros_like(gradient), -gradient
    z = r / bends
    p, rz, first = z, float(np.vdot(r, z)), float(np.vdot(r, r))
    for _ in range(CURVE_STEPS):
        q = curved(p)
        pq = float(np.vdot(p, q))
        if pq <= 0:  # a free intercept that no row pins down
            break
        x, r = x + (rz / pq) * p, r - (rz / pq) * q
        if float(np.vdot(r, r)) <= CURVE_TOLERANCE ** 2 * first:
            break
        z = r / bends
        rz, before = float(np.vdot(r, z)), rz
        p = z + (rz / before) * p
    return x


def _near(problem: Problem, rows: _Rows, weights: np.ndarray, classes: Sequence[int], reach: Sequence[float]) -> np.ndarray:
    """(classes, rows): which are short of the margin, or up to ``reach`` beyond it, as a step may make them short."""
    margins = rows.margins(weights, problem.features)
    signed = np.where(rows.target == np.asarray(classes)[:, None], margins, -margins)
    return (signed < 1.0 + np.asarray(reach)[:, None]) & (_row_weights(problem, rows) > 0)


def _lowest(problem: Problem, blocks: Iterator[_Rows], weights: np.ndarray, gradient: np.ndarray, bends: np.ndarray,
            subset: np.ndarray | None, own_class: int, reach: float, aim: float,
            scale: float = 1.0) -> np.ndarray:
    """Way to the lowest point of the margin loss of one class over these rows, ``scale`` times each, its slope at
    ``weights`` made ``gradient`` and its curvature that of all rows where these have less."""
    start, width = weights[0], weights.shape[1] - 1
    sizes, at, values, cost, sign = [], [], [], [], []
    for b in blocks:
        keep = _near(problem, b, weights, [own_class], [reach])[0]
        entries = keep[b.row]
        sizes.append(b.lengths[keep])
        at.append(b.indices[entries])
        values.append((b.values * b.scales[problem.features][b.row])[entries])
        cost.append(scale * _row_weights(problem, b)[keep])
        sign.append(np.where(b.target[keep] == own_class, 1.0, -1.0))
    sizes, at, values, cost, sign = (np.concatenate([*x, np.zeros(0, kind)]) for x, kind in (
        (sizes, np.int64), (at, np.intp), (values, float), (cost, float), (sign, float)))
    filled, row = np.flatnonzero(sizes), np.repeat(np.arange(len(sizes)), sizes)
    starts = (np.cumsum(sizes) - sizes)[filled]

    def along(v: np.ndarray) -> np.ndarray:
        out = np.full(len(sizes), v[-1])
        if len(filled):
            out[filled] += np.add.reduceat(values * v[at], starts)
        return out

    def back(r: np.ndarray, entries: tuple) -> np.ndarray:
        """Sum of rows times ``r``, over the given entries."""
        where, of, own = entries
        out = np.append(np.bincount(where, own * r[of], minlength=width), r.sum())
        if subset is not None:
            out[:-1][~subset] = 0.0
        return out

    every = (at, row, values)
    margins = along(start)
    short = np.maximum(0.0, 1.0 - sign * margins)
    fixed = gradient[0] - start + 2.0 * back(cost * sign * short, every)
    met = back(2.0 * cost * (short > 0), (at, row, values * values))
    missing = np.maximum(0.0, bends[0] - met)
    x, slope = start.copy(), gradient[0]

    def loss(x: np.ndarray, short: np.ndarray) -> float:
        moved = x - start
        return float(0.5 * x @ x + (cost * short * short).sum() + fixed @ x + 0.5 * (missing * moved) @ moved)

    here = loss(x, short)
    for _ in range(INNER_STEPS):
        if np.linalg.norm(slope) <= aim:
            break
        active = short > 0
        inside = active[row]
        entries = (at[inside], row[inside], values[inside])
        weight = 2.0 * cost * active
        held = np.cumsum(sizes * active) - sizes * active
        some = np.flatnonzero((sizes > 0) & active)

        def curved(v: np.ndarray) -> np.ndarray:
            out = np.full(len(sizes), v[-1])
            if len(some):
                out[some] += np.add.reduceat(entries[2] * v[entries[0]], held[some])
            return (1.0 + missing) * v + back(weight * out, entries)

        bend = 1.0 + missing + back(weight, (*entries[:2], entries[2] ** 2))
        step, r = np.zeros_like(x), -slope
        z = r / bend
        p, rz, first = z, float(r @ z), float(r @ r)
        for _ in range(INNER_CURVE_STEPS):
            q = curved(p)
            size = rz / float(p @ q)
            step, r = step + size * p, r - size * q
            if float(r @ r) <= CURVE_TOLERANCE ** 2 * first:
                break
            z = r / bend
            rz, before = float(r @ z), rz
            p = z + (rz / before) * p
        change, fall, t = along(step), float(slope @ step), 1.0
        while True:
            nearer = np.maximum(0.0, 1.0 - sign * (margins + t * change))
            there = loss(x + t * step, nearer)
            if there <= here + 1e-4 * t * fall or t < 1e-6:
                break
            t *= 0.5
        if there >= here:
            break
        x, margins, short, here = x + t * step, margins + t * change, nearer, there
        slope = x + fixed + missing * (x - start) - 2.0 * back(cost * sign * short, every)
    return (x - start)[None, :]


class _Search:
    """One unit of the solver: takes a step if the loss falls enough, else a shorter one."""

    def __init__(self, start: np.ndarray, steps: int, memory: int = 0):
        self.trial, self.steps_left, self.tries_left = start, steps, 3 * steps + 10
        self.x = self.loss = self.gradient = None
        self.done, self.turning = False, False
        self.reach, self.memory = 0.5, memory
        self.sample_steps, self.counts = 0, None
        self.step, self.slow, self.norm = 0.0, False, math.inf
        self.past: list[tuple[np.ndarray, np.ndarray, float]] = []

    def told(self, loss: float, gradient: np.ndarray) -> None:
        """Loss and gradient at ``trial``."""
        self.tries_left -= 1
        if self.x is not None and not loss <= self.loss + 1e-4 * self.slope * self.step and self.tries_left > 0:
            # Too far: the lowest point of the parabola through what is known.
            bend = loss - self.loss - self.slope * self.step
            shrink = -self.slope * self.step / (2 * bend) if math.isfinite(bend) and bend > 0 else 0.1
            self.step *= min(0.5, max(0.1, shrink))
            self.done = self.step * np.linalg.norm(self.direction) <= 1e-10 * (1 + np.linalg.norm(self.x))
            self.trial = self.x + self.step * self.direction
            return
        if self.x is not None:
            moved, bent = self.trial - self.x, gradient - self.gradient
            along = float(np.vdot(moved, bent))
            # A shortened step has met rows that its curvature did not know of.
            self.reach = 0.8 * self.reach if self.step == 1.0 else min(4.0, 1.5 * self.reach)
            if along > 0 and self.memory:
                self.past = [*self.past, (moved, bent, along)][-self.memory:]
        self.x, self.loss, self.gradient = self.trial, loss, gradient
        norm = float(np.linalg.norm(gradient))
        self.slow, self.norm = self.slow or 2 * norm > self.norm, norm
        self.steps_left -= 1
        self.done = (norm <= TOLERANCE * float(np.linalg.norm(self.x)) or norm == 0.0 or self.steps_left < 0
                     or self.tries_left <= 0)
        self.turning = not self.done

    def near(self, most: float) -> float | None:
        """How far to go beyond the margin for at most ``NEAR_ROWS`` rows; None if too many are short of it."""
        return max((r for r, n in zip(REACHES, self.counts, strict=True) if n <= NEAR_ROWS and r <= most), default=None)

    def asked(self, known: bool) -> np.ndarray:
        """The gradient without what the past steps explain, which is nothing if all curvature is ``known``."""
        if known:
            self.past = []
        rest, self.parts = self.gradient.copy(), []
        for moved, bent, along in reversed(self.past):
            self.parts.append(float(np.vdot(moved, rest)) / along)
            rest -= self.parts[-1] * bent
        return rest

    def turned(self, direction: np.ndarray) -> None:
        """The direction of the next step, from the solution for ``asked``."""
        for (moved, bent, along), part in zip(self.past, reversed(self.parts), strict=True):
            direction = direction - (part + float(np.vdot(bent, direction)) / along) * moved
        self.direction, self.slope, self.step, self.turning = direction, float(np.vdot(direction, self.gradient)), 1.0, False
        if self.slope >= 0:
            norm = float(np.linalg.norm(self.gradient))
            self.direction, self.slope = -self.gradient / norm, -norm
        self.trial = self.x + self.step * self.direction


def _reduced(rdd: RDD, work, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the arrays of all tasks.

    Few numbers meet on the driver. Else every task cuts its array, executors add up one slice each, and
    the driver gets one array, however many tasks there are.
    """
    parts, numbers = rdd.getNumPartitions(), math.prod(shape)
    if parts * numbers * 8 <= FLAT_BYTES:
        return sum(rdd.mapPartitions(work).collect(), np.zeros(shape))
    slices = min(parts, rdd.context.defaultParallelism, numbers)

    def cut(rows):
        for out in work(rows):
            yield from enumerate(np.array_split(out.ravel(), slices))

    found = rdd.mapPartitions(cut).reduceByKey(lambda a, b: a + b, slices).collect()
    return np.concatenate([piece for _, piece in sorted(found, key=lambda x: x[0])]).reshape(shape)


def solve(blocks: Blocks, problems: Sequence[Problem], start: Sequence[Fit | None] | None = None,
          max_iter: int = 100) -> list[Fit]:
    """All problems at once; ``start`` may give weights to begin with, of fewer features too."""
    k, d = blocks.classes, blocks.size
    searches: list[list[_Search]] = []
    bends: list[np.ndarray | None] = [None] * len(problems)
    held, caps = {}, REACHES[::-2]
    for i, problem in enumerate(problems):
        first = np.zeros((k, d + 1))
        if start and start[i] is not None:
            first[:, :start[i].weights.shape[1]] = start[i].weights
            first[:, -1] = start[i].intercepts
        # Classes of a margin loss do not depend on each other, those of softmax do.
        parts = [first[c:c + 1] for c in range(k)] if problem.loss == HINGE else [first]
        # The smooth softmax needs no more than its Newton equations.
        searches.append([_Search(p, max_iter, MEMORY if problem.loss == HINGE else 0) for p in parts])
    while True:
        asked = [i for i, own in enumerate(searches) if not all(s.done for s in own)]
        if not asked:
            break
        trial = np.stack([np.concatenate([s.x if s.done else s.trial for s in searches[i]]) for i in asked])
        found = _valued(blocks, [problems[i] for i in asked], trial)
        for j, i in enumerate(asked):
            problem, w, gradient, bends[i] = problems[i], trial[j], found[j, :, :d + 1], found[j, :, d + 1:2 * d + 2]
            subset = blocks.subsets[problem.features]
            if subset is not None:
                gradient[:, :-1][:, ~subset] = 0.0
            own = w if problem.loss == HINGE else np.concatenate([w[:, :-1], np.zeros((k, 1))], axis=1)
            gradient += own
            loss = found[j, :, 2 * d + 2] + 0.5 * (own * own).sum(axis=1)
            for c, s in enumerate(searches[i]):
                if not s.done:
                    s.told(*((float(loss[c]), gradient[c:c + 1]) if problem.loss == HINGE
                             else (float(loss.sum()), gradient)))
                    if s.turning:
                        s.counts = found[j, c, 2 * d + 3:]
        # Softmax first: its units are the longest.
        turning = sorted(((i, c, s) for i, own in enumerate(searches) for c, s in enumerate(own) if s.turning),
                         key=lambda t: problems[t[0]].loss == HINGE)
        if not turning:
            continue
        margins = [t for t in turning if problems[t[0]].loss == HINGE]
        near, known, places, tried = None, {}, [], list(caps)
        while not near:
            if tried:
                most = tried.pop(0)
                places = [(t, reach) for t in margins if (reach := t[2].near(most)) is not None]
            else:  # those with the fewest rows
                places = sorted(places, key=lambda p: p[0][2].counts[0])[:len(places) // 2]
            if not places:
                break
            near = _curved(blocks, problems, places)
        if near:
            caps, known = [c for c in caps if c <= most], {id(t[2]): reach for t, reach in places}
        units = []
        for i, c, s in turning:
            margin = problems[i].loss == HINGE
            aim = max(INNER_TOLERANCE * float(np.linalg.norm(s.gradient)), 0.2 * TOLERANCE * float(np.linalg.norm(s.x)))
            way, reach = (NEAR, known[id(s)]) if id(s) in known else (NEWTON, s.reach)
            if margin and way == NEWTON and s.sample_steps < SAMPLE_STEPS:
                way, s.sample_steps = SAMPLE, s.sample_steps + 1
            if not margin and s.slow:
                way = WIDE
            units.append((problems[i], s.x, s.asked(way != NEWTON), bends[i][c:c + 1] if margin else bends[i],
                          c if margin else None, reach, aim, way))
        ways = {u[-1] for u in units}
        if ways & {NEWTON, SAMPLE} and NEWTON not in held:
            held[NEWTON] = held[SAMPLE] = _sampled(blocks, CURVE_ROWS)
        if WIDE in ways and WIDE not in held:
            held[WIDE] = _sampled(blocks, WIDE_ROWS)
        for (_, _, s), direction in zip(turning, _turned(blocks, held | {NEAR: near}, units), strict=True):
            s.turned(direction)
        if near:
            near.destroy()
    for way in (NEWTON, WIDE):
        if way in held:
            held[way].destroy()
    fits = []
    for own in searches:
        whole = np.concatenate([s.x for s in own])
        fits.append(Fit(whole[:, :-1], whole[:, -1]))
    return fits


def _valued(blocks: Blocks, problems: list[Problem], weights: np.ndarray) -> np.ndarray:
    """(problems, classes, ...): gradients, curvatures of each feature, the loss and, for a margin loss, the rows within
    each of ``REACHES``, summed over all rows."""
    shared, subsets = blocks.rdd.context.broadcast(weights), len(blocks.subsets)

    def work(rows):
        width = shared.value.shape[2]
        out = np.zeros((*shared.value.shape[:2], 2 * width + 1 + len(REACHES)))
        for row in rows:
            block = _Rows(row, subsets)
            for j, problem in enumerate(problems):
                margins = block.margins(shared.value[j], problem.features)
                loss, slopes, curves = _losses(problem, block, margins)
                out[j, :, 2 * width] += loss
                block.add_slopes(out[j, :, :width], out[j, :, width:2 * width - 1], slopes, curves, problem.features)
                out[j, :, 2 * width - 1] += curves.sum(axis=1)
                if problem.loss == HINGE:
                    signed, seen = _signs(block, len(margins)) * margins, _row_weights(problem, block) > 0
                    for r, reach in enumerate(REACHES):
                        out[j, :, 2 * width + 1 + r] += ((signed < 1.0 + reach) & seen).sum(axis=1)
        yield out

    found = _reduced(blocks.rdd, work, (*weights.shape[:2], 2 * weights.shape[2] + 1 + len(REACHES)))
    shared.destroy()
    return found


def _sampled(blocks: Blocks, wanted: int):
    """Broadcast of the subsets and of about ``wanted`` rows, from the head of every partition."""
    parts = max(1, blocks.rdd.getNumPartitions())
    most, room, subsets = math.ceil(wanted / parts), CURVE_BYTES / parts, len(blocks.subsets)

    def head(rows):
        size = held = 0
        for row in rows:
            if size >= most or held >= room:
                break
            block = _Rows(row, subsets)
            size += block.n
            yield (picked := _picked(block, np.ones(block.n, dtype=bool)))
            held += sum(map(len, picked))

    return blocks.rdd.context.broadcast((blocks.subsets, blocks.rdd.mapPartitions(head).collect()))


def _curved(blocks: Blocks, problems: Sequence[Problem], places: Sequence[tuple[tuple[int, int, _Search], float]]):
    """Broadcast of the subsets and of all rows near the margin of a search at its place; None if they are more than
    ``CURVE_BYTES``, of which no partition sends more than its share."""
    parts = max(1, blocks.rdd.getNumPartitions())
    room, subsets = CURVE_BYTES / parts, len(blocks.subsets)
    by_problem: dict[int, list[tuple[int, _Search, float]]] = {}
    for (i, c, search), reach in places:
        by_problem.setdefault(i, []).append((c, search, reach))
    shared = blocks.rdd.context.broadcast([(problems[i], np.concatenate([s.x for _, s, _ in own]), [c for c, *_ in own],
                                            [reach for *_, reach in own]) for i, own in by_problem.items()])

    def pick(rows):
        size, kept = 0, []
        for row in rows:
            block = _Rows(row, subsets)
            near = np.zeros(block.n, dtype=bool)
            for problem, weights, classes, reach in shared.value:
                near |= _near(problem, block, weights, classes, reach).any(axis=0)
            if near.any():
                kept.append(_picked(block, near))
                size += sum(map(len, kept[-1]))
                if size > room:
                    yield None
                    return
        yield from kept

    found = blocks.rdd.mapPartitions(pick).collect()
    shared.destroy()
    return None if any(row is None for row in found) else blocks.rdd.context.broadcast((blocks.subsets, found))


def _picked(block: _Rows, keep: np.ndarray) -> tuple:
    entries = keep[block.row]
    arrays = (block.lengths[keep], block.indices[entries].astype(np.int32), block.values[entries].astype(np.float32), block.target[keep],
              block.fold[keep], block.scales[:, keep])
    return tuple(a.tobytes() for a in arrays)


def _turned(blocks: Blocks, held: dict, units: list[tuple]) -> list[np.ndarray]:
    """Directions of (problem, weights, gradient, curvatures, class or None for all classes, reach, slope that is small
    enough, way); ``held`` has the broadcast rows of each way."""
    context, all_rows = blocks.rdd.context, int(blocks.counts.sum())
    shared = context.broadcast(units)

    def work(places):
        for i in places:
            problem, weights, gradient, bends, own, reach, aim, way = shared.value[i]
            subsets, rows = held[way].value
            some, subset = (_Rows(row, len(subsets), np.float32) for row in rows), subsets[problem.features]
            scale = all_rows / max(1, sum(len(row[0]) // 8 for row in rows))
            if way in (NEWTON, WIDE):
                yield _direction(problem, some, weights, gradient, bends, scale, subset, own, reach)
            else:
                scale, far = (1.0, reach) if way == NEAR else (scale, math.inf)
                yield _lowest(problem, some, weights, gradient, bends, subset, own, far, aim, scale)

    tasks = min(len(units), TURNING_TASKS * context.defaultParallelism)
    found = context.parallelize(range(len(units)), tasks).mapPartitions(work).collect()
    shared.destroy()
    return found


def _stacked(fits: Sequence[Fit]) -> np.ndarray:
    return np.stack([np.concatenate([f.weights, f.intercepts[:, None]], axis=1) for f in fits])


def confusions(blocks: Blocks, problems: Sequence[Problem], fits: Sequence[Fit], held_out: bool = True) -> np.ndarray:
    """(problems, class, predicted class) counts, over the rows a problem does not see or over all.

    Of equal margins the first class wins.
    """
    k, subsets, asked = blocks.classes, len(blocks.subsets), list(problems)
    shared = blocks.rdd.context.broadcast(_stacked(fits))

    def work(rows):
        out = np.zeros((len(asked), k, k), dtype=np.int64)
        for row in rows:
            block = _Rows(row, subsets)
            for j, problem in enumerate(asked):
                own = block.fold == problem.held_out if held_out else np.ones(block.n, dtype=bool)
                best = block.margins(shared.value[j], problem.features).argmax(axis=0)
                np.add.at(out[j], (block.target[own], best[own]), 1)
        yield out

    found = _reduced(blocks.rdd, work, (len(asked), k, k)).astype(np.int64)
    shared.destroy()
    return found


def macro_f1(confusion: np.ndarray) -> float:
    """Unweighted mean over the classes that occur as a label or as a prediction."""
    hits = np.diag(confusion).astype(np.float64)
    sizes = confusion.sum(axis=0) + confusion.sum(axis=1)
    known = sizes > 0
    return float((2 * hits[known] / sizes[known]).mean()) if known.any() else 0.0


# -- sigmoids (M5) ---------------------------------------------------------------------------------

def held_margins(blocks: Blocks, problems: Sequence[Problem], fits: Sequence[Fit]) -> RDD:
    """(group, hit, margin) arrays of the rows that a problem does not see; group = problem * classes + class."""
    k, subsets, asked = blocks.classes, len(blocks.subsets), list(problems)
    shared = blocks.rdd.context.broadcast(_stacked(fits))

    def work(rows):
        for row in rows:
            block = _Rows(row, subsets)
            for j, problem in enumerate(asked):
                own = block.fold == problem.held_out
                margins = block.margins(shared.value[j], problem.features)[:, own]
                for c in range(k):
                    yield (np.full(margins.shape[1], j * k + c, dtype=np.int32), block.target[own] == c, margins[c])

    return blocks.rdd.mapPartitions(work)


def sigmoids(margins: RDD, groups: int, iterations: int = 30, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Platt's sigmoid ``1 / (1 + exp(a m + b))`` of every group at once.

    Newton steps: each is one pass over the margins of all groups, of which five sums a group reach
    the driver. Targets are smoothed by the counts of a group; a group without rows gets a = 0.
    """
    rows = margins.persist(StorageLevel.MEMORY_AND_DISK)

    def sizes(parts):
        out = np.zeros((2, groups))
        for group, hit, _ in parts:
            out[0] += np.bincount(group[hit], minlength=groups)
            out[1] += np.bincount(group[~hit], minlength=groups)
        yield out

    p, n = _reduced(rows, sizes, (2, groups))
    high, low = (p + 1.0) / (p + 2.0), 1.0 / (n + 2.0)
    a, b = np.zeros(groups), np.log((n + 1.0) / (p + 1.0))
    for _ in range(iterations):
        state = (a.copy(), b.copy())

        def step(parts, state=state):
            out = np.zeros((5, groups))
            for group, hit, m in parts:
                share = 1.0 / (1.0 + np.exp(np.clip(state[0][group] * m + state[1][group], -700, 700)))
                d = np.where(hit, high[group], low[group]) - share
                w = share * (1 - share)
                for i, x in enumerate((d * m, d, w * m * m, w * m, w)):
                    out[i] += np.bincount(group, x, minlength=groups)
            yield out

        ga, gb, haa, hab, hbb = _reduced(rows, step, (5, groups))
        haa, hbb = haa + 1e-9, hbb + 1e-9
        det = haa * hbb - hab * hab
        da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        size = np.maximum(np.abs(da), np.abs(db))
        scale = np.minimum(1.0, 5.0 / np.maximum(size, 5.0))  # no step leaves the sane range
        a, b = a + scale * da, b + scale * db
        if size.max(initial=0.0) < tolerance:
            break
    rows.unpersist()
    return a, b


# -- scoring ----------------------------------------------------------------------------------------

def products(df: DataFrame, weights: np.ndarray, intercepts: np.ndarray, features: str, finish) -> Column:
    """Array column ``finish(margins)``: one product of each batch with all rows of ``weights``."""
    shared = df.sparkSession.sparkContext.broadcast((weights, intercepts))

    def run(indices: pd.Series, values: pd.Series) -> pd.Series:
        w, b = shared.value
        lengths = np.fromiter((len(v) for v in values), dtype=np.int64, count=len(values))
        flat = np.concatenate([*values, np.zeros(0)])
        at = np.concatenate([*(np.arange(n) if i is None else i for i, n in zip(indices, lengths, strict=True)),
                             np.zeros(0, dtype=np.int64)]).astype(np.int64)
        filled = np.flatnonzero(lengths)
        starts = (np.cumsum(lengths) - lengths)[filled]
        out = np.zeros((len(lengths), len(w)))
        if len(filled):
            for k, own in enumerate(w):
                out[filled, k] = np.add.reduceat(flat * own[at], starts)
        return pd.Series(list(finish(out + b)))

    raw = F.unwrap_udt(F.col(features))
    return F.pandas_udf(run, "array<double>")(raw["indices"], raw["values"])
