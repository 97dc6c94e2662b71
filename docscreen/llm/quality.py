"""Quality classifier by attention-based multiple-instance learning.

Method. A text is a bag of passages of about ``PASSAGE`` bytes. Every passage is encoded as a
vector: shares of kinds of characters, word lengths, repetition of words, and hashed words and
byte pairs. A small network turns it into a hidden vector h; gated attention,
``softmax(w . (tanh(V h) * sigmoid(U h)))`` over the passages of a document, weighs them, and the
weighted sum is scored by a logistic unit. Only documents have labels; the attention learns which
passages decide.

Fitting takes at most about ``FIT_DOCUMENTS`` labelled documents, those with the smallest hashes
of their ids, in one task with a fixed seed; this bound is the only sample. Scoring reads every
passage of every text.

Defined cases: a null or empty text is one empty passage and is scored like any other; documents
whose label is missing teach nothing; without both labels every score is the share of label 1 (0.5
without any label); other columns are ignored; repeated rows get equal rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docscreen.llm.common import cut_lineage, held_out, id_and_bytes, map_batches, read
from docscreen.llm.words import SPACED_LOWER, chunks, split_words

FIT_DOCUMENTS = 4000
PASSAGE = 400
WORD_SLOTS, PAIR_SLOTS = 512, 128
HIDDEN, GATE = 24, 16
EPOCHS, BATCH, RATE, DECAY = 40, 64, 3e-3, 1e-4
SEED = 5

#: Kinds of bytes: lower, upper, digit, space, line end, full stop or comma, other ASCII, others.
_KIND = np.full(256, 6, dtype=np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[32], _KIND[10] = 0, 1, 2, 3, 4
_KIND[[44, 46]], _KIND[128:] = 5, 7
_KINDS = 8
_OTHERS = 9
FEATURES = _KINDS + _OTHERS + WORD_SLOTS + PAIR_SLOTS


def passages(values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(passages, FEATURES) matrix and the first passage of each text (and the total at the end)."""
    sizes = np.array([len(v or b"") for v in values], dtype=np.int64)
    parts = np.maximum(-(-sizes // PASSAGE), 1)
    first = np.concatenate(([0], np.cumsum(parts)))
    n = int(first[-1])
    data = np.frombuffer(b"".join(v or b"" for v in values), dtype=np.uint8)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = np.repeat(first[:-1], sizes) + inside // PASSAGE
    length = np.bincount(own, minlength=n).astype(np.float32)
    some = np.maximum(length, 1)
    kinds = np.bincount(own * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS) / some[:, None]
    # Pairs of neighbouring bytes of the same kind of place, hashed.
    pair = data[:-1].astype(np.uint32) * np.uint32(2654435761) + data[1:].astype(np.uint32) * np.uint32(40503)
    pair = (pair >> np.uint32(16)) % np.uint32(PAIR_SLOTS)
    pairs = np.bincount(own[:-1] * PAIR_SLOTS + pair, minlength=n * PAIR_SLOTS).reshape(n, PAIR_SLOTS)
    same = np.bincount(own[:-1], weights=data[:-1] == data[1:], minlength=n)

    words = split_words(values, SPACED_LOWER)
    hashes, text = words.hashes(), words.text_of_word()
    starts = words.start - 1 - np.repeat(np.cumsum(sizes + 1) - sizes - 1, words.counts)
    where = first[text] + np.minimum(starts // PASSAGE, parts[text] - 1)
    count = np.bincount(where, minlength=n).astype(np.float64)
    any_word = np.maximum(count, 1)
    slots = np.bincount(where * WORD_SLOTS + (hashes >> np.uint64(40)).astype(np.int64) % WORD_SLOTS,
                        minlength=n * WORD_SLOTS).reshape(n, WORD_SLOTS)
    size = (words.end - words.start).astype(np.float64)
    order = np.lexsort((hashes, where))
    again = (hashes[order][1:] == hashes[order][:-1]) & (where[order][1:] == where[order][:-1])
    repeated = np.bincount(where[order][1:], weights=again, minlength=n)
    follows = np.zeros(len(hashes))
    if len(hashes) > 1:
        follows[1:] = (hashes[1:] == hashes[:-1]) & (where[1:] == where[:-1])
    text_share = np.repeat(np.log1p(parts), parts)
    others = np.stack([
        length / PASSAGE, np.log1p(np.repeat(sizes, parts)) / 10, text_share / 5,
        np.bincount(where, weights=size, minlength=n) / any_word / 10,
        np.sqrt(np.bincount(where, weights=size * size, minlength=n) / any_word) / 10,
        repeated / any_word, np.bincount(where, weights=follows, minlength=n) / any_word,
        same / some, count / some * 5], axis=1)
    made = np.concatenate([
        kinds * 4, others,
        np.sqrt(slots) / np.sqrt(any_word)[:, None] * 2, np.sqrt(pairs) / np.sqrt(some)[:, None]], axis=1)
    return made.astype(np.float32), first


def _forward(x: np.ndarray, first: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * s) @ w["a"]
    sizes = np.diff(first)
    top = np.repeat(np.maximum.reduceat(e, first[:-1]), sizes)
    raw = np.exp(e - top)
    alpha = raw / np.repeat(np.add.reduceat(raw, first[:-1]), sizes)
    z = np.add.reduceat(alpha[:, None] * h, first[:-1], axis=0)
    p = 1 / (1 + np.exp(-(z @ w["o"] + w["c"])))
    return {"h": h, "t": t, "s": s, "alpha": alpha, "z": z, "p": p}


def _gradients(x: np.ndarray, first: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    f = _forward(x, first, w)
    h, t, s, alpha, z = f["h"], f["t"], f["s"], f["alpha"], f["z"]
    sizes = np.diff(first)
    d = (f["p"] - y) / len(y)
    back = np.repeat(d, sizes)
    towards = h @ w["o"]
    # Through the weighted sum and through the attention that weighs it.
    middle = np.repeat(np.add.reduceat(alpha * towards, first[:-1]), sizes)
    de = back * alpha * (towards - middle)
    dt = de[:, None] * w["a"] * s * (1 - t * t)
    ds = de[:, None] * w["a"] * t * s * (1 - s)
    dh = (back * alpha)[:, None] * w["o"] + dt @ w["V"].T + ds @ w["U"].T
    dx = dh * (1 - h * h)
    return {"W": x.T @ dx, "b": dx.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "a": (t * s).T @ de,
            "o": z.T @ d, "c": np.array(d.sum())}


def fit_bags(x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Weights of the network after ``EPOCHS`` passes of Adam; the same for the same rows."""
    random = np.random.default_rng(SEED)
    rate = float(y.mean()) if len(y) else 0.5
    mean, spread = x.mean(axis=0), x.std(axis=0) + 0.05
    normal = lambda *n: (random.standard_normal(n) / np.sqrt(n[0])).astype(np.float32)
    w = {"W": normal(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": normal(HIDDEN, GATE),
         "U": normal(HIDDEN, GATE), "a": normal(GATE), "o": np.zeros(HIDDEN, np.float32),
         "c": np.float32(np.log(max(rate, 1e-3) / max(1 - rate, 1e-3)))}
    if 0 < rate < 1:
        x = (x - mean) / spread
        moved = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = random.permutation(len(y))
            speed = RATE * (1 - epoch / EPOCHS)
            for lo in range(0, len(order), BATCH):
                docs = order[lo:lo + BATCH]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in docs])
                bounds = np.concatenate(([0], np.cumsum(first[docs + 1] - first[docs])))
                step += 1
                for k, g in _gradients(x[rows], bounds, y[docs], w).items():
                    g = g + DECAY * w[k]
                    m, v = moved[k]
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    moved[k] = (m, v)
                    w[k] = w[k] - speed * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    # The scaling of the features becomes part of the first layer.
    scaled = w["W"] / spread[:, None]
    return w | {"b": w["b"] - mean @ scaled, "W": scaled}


def score_bags(values: list[bytes | None], w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text and the largest attention weight of one of its passages."""
    x, first = passages(values)
    f = _forward(x, first, w)
    return f["p"].astype(np.float64), np.maximum.reduceat(f["alpha"], first[:-1]).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> dict[str, np.ndarray]:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    known = (labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    rows = known.count()
    share = min(1.0, fit_documents / rows) if rows else 1.0
    few = cut_lineage(known.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
                                   < F.lit(int(share * (1 << 30)))))

    def train(batches):
        texts: list[bytes | None] = []
        y: list[int] = []
        for batch in batches:
            texts += batch.column(1).to_pylist()
            y += batch.column(2).to_pylist()
        if texts:
            made = [passages(texts[lo:hi]) for lo, hi in chunks(texts)]
            x = np.concatenate([m for m, _ in made])
            sizes = np.concatenate([np.diff(f) for _, f in made])
            w = fit_bags(x, np.concatenate(([0], np.cumsum(sizes))), np.array(y, dtype=np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(w)])], ["weights"])

    own = id_and_bytes(docs).join(few, "doc_id").select("doc_id", "text", "quality")
    # One task sees the sample, in an order of its own: the weights do not depend on partitions.
    one = own.repartition(1).sortWithinPartitions("doc_id", "text")
    found = one.mapInArrow(train, "weights binary").collect()
    if found:
        return pickle.loads(found[0].weights)
    return fit_bags(np.zeros((1, FEATURES), np.float32), np.array([0, 1]), np.array([0.5]))


def score(docs: DataFrame, weights: dict[str, np.ndarray], threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, top_attention."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work(batch: pa.RecordBatch) -> list:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        made = [score_bags(texts[lo:hi], shared.value) for lo, hi in chunks(texts)]
        p = np.concatenate([a for a, _ in made])
        return [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)),
                pa.array(np.concatenate([b for _, b in made]))]

    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return map_batches(own, work, T.StructType([
        docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()), T.StructField("top_attention", T.DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
