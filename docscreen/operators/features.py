"""Vocabulary, TF-IDF and LSA.

The vocabulary is one distributed aggregation; its size is bounded by ``max_features``.  Turning
documents into vectors needs no shuffle: runs of known words are looked up and weighed as flat arrays
of a whole batch.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import DenseMatrix, VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docscreen.functions import text as X
from docscreen.operators.grouping import unnest
from docscreen.session import cut_lineage, release, written


@dataclass(frozen=True)
class TfidfParams:
    max_features: int = 10_000
    low: int = 1
    high: int = 2
    min_df: int = 1
    max_df: float = 1.0
    sublinear: bool = True
    strip_accents: bool = True

    def terms(self, text):
        if self.strip_accents:
            text = X.translate_accents(text)
        found = X.tokens(text)
        return X.ngrams(found, self.low, self.high) if self.high > 1 else found


def _token_line(params: TfidfParams, text):
    """All tokens of a text, joined by one space: what batches of texts are counted from."""
    return F.array_join(replace(params, low=1, high=1).terms(text), " ")


def _split_lines(lines: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of tokens of each line, and all tokens."""
    found = pc.split_pattern(pc.fill_null(lines, ""), " ")
    offsets, tokens = found.offsets.to_numpy(), found.flatten()
    empty = pc.equal(tokens, "").to_numpy(zero_copy_only=False)  # a line without tokens
    row = np.repeat(np.arange(len(found)), np.diff(offsets))
    return np.bincount(row[~empty], minlength=len(found)), tokens.filter(pa.array(~empty))


def _grams(codes: np.ndarray, lengths: np.ndarray, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers (digits to ``base``) of the runs of ``n`` known tokens; an unknown one is -1."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    keys, fits = codes[:max(len(codes) - n + 1, 0)].copy(), np.ones(max(len(codes) - n + 1, 0), dtype=bool)
    for k in range(n):
        part = codes[k:k + len(keys)]
        fits &= (part >= 0) & (row[k:k + len(keys)] == row[:len(keys)])
        if k:
            keys = keys * base + part
    return row[:len(keys)][fits], keys[fits]


#: Rows whose terms are counted at a time.
COUNTED_ROWS = 2_000


def _counted(lines: DataFrame, n: int, known: list[str] | None = None) -> DataFrame:
    """(term, df, cf) of the runs of ``n`` tokens, of ``known`` ones if given; batches are counted as arrays."""
    shared = None if known is None else lines.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        words = None if shared is None else pa.array(shared.value, pa.string())
        for batch in batches:
            for lo in range(0, batch.num_rows, COUNTED_ROWS):
                lengths, tokens = _split_lines(batch.column(0).slice(lo, COUNTED_ROWS))
                if words is None:
                    coded = tokens.dictionary_encode()
                    names, codes = coded.dictionary, coded.indices.to_numpy()
                else:
                    names, codes = words, pc.fill_null(pc.index_in(tokens, words), -1).to_numpy()
                base = max(len(names), 1)
                row, keys = _grams(codes.astype(np.int64), lengths, n, base)
                found, place, cf = np.unique(keys, return_inverse=True, return_counts=True)
                df = np.bincount(np.unique(row * max(len(found), 1) + place) % max(len(found), 1), minlength=len(found))
                parts = [names.take(pa.array(found // base ** k % base)) for k in reversed(range(n))]
                terms = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
                yield pa.RecordBatch.from_arrays([terms, pa.array(df), pa.array(cf)], names=["term", "df", "cf"])

    return (lines.mapInArrow(count, "term string, df long, cf long").groupBy("term")
            .agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")))


#: Most words whose runs are numbered (two or three of them in 63 bits).
KNOWN_WORDS = 1_000_000


def frequent_statistics(df: DataFrame, text: str, params: TfidfParams, bounds=None) -> DataFrame:
    """Document and corpus frequency of every term that can be among the ``max_features`` most frequent ones
    within each of the ``bounds`` (least df, greatest share of the rows); rarer terms may be missing.

    A run of words is not more frequent than each of them. So single words are counted first; they tell how
    frequent a term must be, and runs are only counted where all their words are as frequent.
    """
    bounds = bounds or [(params.min_df, params.max_df)]
    lines = cut_lineage(df.select(_token_line(params, F.col(text)).alias("t")))
    table = written()[-1:]
    single = cut_lineage(_counted(lines, 1))
    rows, floor = lines.count(), None
    level = F.floor(F.log2("cf"))
    for low, high in bounds:
        usable = single.filter((F.col("df") >= low) & (F.col("df") <= F.lit(high) * rows))
        levels = sorted(((r.level, r["count"]) for r in usable.groupBy(level.alias("level")).count().collect()), reverse=True)
        total, least = 0, 1  # at most 63 levels; too few single words: every run counts
        for at, number in levels:
            total += number
            if total >= params.max_features:
                least = 2 ** at
                break
        floor = least if floor is None else min(floor, least)
    out = [single] if params.low == 1 else []
    wanted = single.filter(F.col("cf") >= floor).select("term")
    known = [r.term for r in wanted.limit(KNOWN_WORDS + 1).collect()] if params.low == 1 and floor > 1 else None
    if known is not None and (len(known) > KNOWN_WORDS or max(len(known), 1) ** params.high >= 2 ** 62):
        known = None
    for n in range(max(params.low, 2), params.high + 1):
        out.append(cut_lineage(_counted(lines, n, sorted(known)) if known is not None else
                               _statistics(lines.select(X.term_counts(_runs(F.col("t"), n)).alias("t")))))
    release(df.sparkSession, table)
    return reduce(DataFrame.unionByName, out)


def _runs(line, n: int):
    return X.ngrams(F.filter(F.split(line, " "), lambda w: w != ""), n, n)


def _statistics(counted: DataFrame) -> DataFrame:
    """Frequencies from a column ``t`` of term counts; they combine map-side."""
    return (unnest(counted, F.col("t"), "t").groupBy(F.col("t.term").alias("term"))
            .agg(F.count(F.lit(1)).alias("df"), F.sum("t.tf").alias("cf")))


def _most_frequent(stats: DataFrame, df: DataFrame, params: TfidfParams) -> DataFrame:
    """Top terms by corpus frequency, from a written table of statistics.

    A top-k over millions of terms would send k rows of every partition to one task.  The powers
    of two of the frequency are counted first, and only levels that can hold a top term go on.
    """
    n = df.agg(F.count(F.lit(1))).scalar()
    level = F.floor(F.log2("cf"))
    usable = (stats.withColumn("_n", n)
              .filter((F.col("df") >= params.min_df)
                      & (F.col("df") <= F.lit(params.max_df) * F.col("_n")))
              .withColumn("_level", level))
    downwards = Window.orderBy(F.desc("_level"))  # at most 63 levels
    lowest = (usable.groupBy("_level").agg(F.count(F.lit(1)).alias("_terms"))
              .select("_level", F.sum("_terms").over(downwards).alias("_above"))
              .filter(F.col("_above") >= params.max_features).agg(F.max("_level"))).scalar()
    return (usable.filter(F.col("_level") >= F.coalesce(lowest, F.lit(0)))
            .orderBy(F.desc("cf"), "term").limit(params.max_features)
            .select("term", "df", "cf",
                    (F.log((F.col("_n") + 1) / (F.col("df") + 1)) + 1).alias("idf")))


def vocabulary(df: DataFrame, text: str, params: TfidfParams = TfidfParams()) -> DataFrame:
    """``(term, df, cf, idf)`` of the most frequent terms; ties are broken by the term (F1)."""
    return _most_frequent(frequent_statistics(df, text, params), df, params)


class TfidfModel:
    """A fitted vocabulary; ``transform`` adds an L2-normalised sparse vector column."""

    def __init__(self, terms: list[str], idf: list[float], params: TfidfParams):
        self.terms, self.idf, self.params = list(terms), list(idf), params

    @classmethod
    def fit(cls, df: DataFrame, text: str, params: TfidfParams = TfidfParams()) -> "TfidfModel":
        # At most ``max_features`` short rows reach the driver: the model itself.
        rows = vocabulary(df, text, params).select("term", "idf").collect()
        if not rows:
            raise ValueError("empty vocabulary")
        return cls([r.term for r in rows], [r.idf for r in rows], params)

    def first(self, size: int) -> "TfidfModel":
        """The model of the ``size`` most frequent terms."""
        if size >= len(self.terms):
            return self
        return TfidfModel(self.terms[:size], self.idf[:size], replace(self.params, max_features=size))

    def transform(self, df: DataFrame, text: str, output: str = "features") -> DataFrame:
        # A missing text has no terms.
        line = _token_line(self.params, F.coalesce(text, F.lit("")))
        return df.withColumn(output, _vectorising(self.terms, self.idf, self.params)(line))

    def weights(self, df: DataFrame, text: str, row_id: str = "doc_id") -> DataFrame:
        """Long form ``(row_id, term, weight)``."""
        vectors = self.transform(df.select(row_id, text), text, "_v")
        entries = unnest(vectors, vector_entries(F.col("_v")), "e", row_id)
        terms = df.sparkSession.createDataFrame(
            list(enumerate(self.terms)), "index int, term string")
        return (entries.join(F.broadcast(terms), F.col("e.index") == F.col("index"))
                .select(row_id, "term", F.col("e.value").alias("weight")))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, t, w) for i, (t, w) in enumerate(zip(self.terms, self.idf))]
        (spark.createDataFrame(rows, "position int, term string, idf double")
         .write.mode("overwrite").parquet(f"{path}/terms"))
        (spark.createDataFrame([(json.dumps(asdict(self.params)),)], "params string")
         .write.mode("overwrite").text(f"{path}/params"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TfidfModel":
        rows = spark.read.parquet(f"{path}/terms").orderBy("position").collect()
        params = json.loads(spark.read.text(f"{path}/params").first().value)
        return cls([r.term for r in rows], [r.idf for r in rows], TfidfParams(**params))


def vector_entries(vector):
    """``array<struct<index, value>>`` of a sparse vector column."""
    raw = F.unwrap_udt(vector)
    return X.let(raw, lambda r: F.zip_with(r["indices"], r["values"], lambda i, v: F.struct(
        i.alias("index"), v.alias("value"))))


def first_features(column: str, size: int):
    """Sparse vectors of the first ``size`` features, at unit length."""
    def cut(indices: pd.Series, values: pd.Series) -> pd.DataFrame:
        out_at, out = [], []
        for at, v in zip(indices, values):
            n = int(np.searchsorted(at, size))  # features of a vector ascend
            v = np.asarray(v)[:n]
            norm = np.sqrt(v @ v)
            out_at.append(np.asarray(at)[:n])
            out.append(v / norm if norm > 0 else v)
        return pd.DataFrame({"type": 0, "size": size, "indices": out_at, "values": out})

    raw = F.unwrap_udt(F.col(column))
    return F.pandas_udf(cut, VectorUDT())(raw["indices"], raw["values"])


def _vectorising(terms: list[str], idf: list[float], params: TfidfParams):
    """Lines of tokens to L2-normalised vectors of the known terms: whole Arrow batches as flat arrays."""
    factors = np.asarray(idf)
    split = [t.split(" ") for t in terms]
    names = sorted({w for t in split for w in t})
    at = {w: i for i, w in enumerate(names)}
    base, tables = max(len(names), 1), []
    kind = np.int64 if base ** params.high < 2 ** 63 else object
    for n in range(params.low, params.high + 1):
        own = [(reduce(lambda key, w: key * base + at[w], t, 0), i) for i, t in enumerate(split) if len(t) == n]
        own.sort()
        tables.append((n, np.array([k for k, _ in own], dtype=kind), np.array([i for _, i in own], dtype=np.int64)))
    words = pa.array(names, pa.string())

    def part(lines: pd.Series) -> tuple[list, list]:
        size, rows = len(factors), len(lines)
        lengths, tokens = _split_lines(pa.array(lines, pa.string()))
        codes = pc.fill_null(pc.index_in(tokens, words), -1).to_numpy().astype(kind)
        entries = [np.zeros(0, dtype=np.int64)]
        for n, keys, place in tables:
            if not len(keys):
                continue
            row, found = _grams(codes, lengths, n, base)
            near = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            known = keys[near] == found
            entries.append(row[known] * size + place[near[known]])
        entry, tf = np.unique(np.concatenate(entries), return_counts=True)
        row, index = entry // size, entry % size
        w = (1.0 + np.log(tf) if params.sublinear else tf) * factors[index]
        w = w / np.sqrt(np.bincount(row, weights=w * w, minlength=rows))[row]
        ends = np.cumsum(np.bincount(row, minlength=rows))[:-1]
        return np.split(index.astype(np.int32), ends), np.split(w, ends)

    def vectorise(lines: pd.Series) -> pd.DataFrame:
        indices, values = [], []
        for lo in range(0, len(lines), COUNTED_ROWS):
            at, w = part(lines.iloc[lo:lo + COUNTED_ROWS])
            indices += at
            values += w
        return pd.DataFrame({"type": 0, "size": len(factors), "indices": indices, "values": values})

    return F.pandas_udf(vectorise, VectorUDT())


# -- naive Bayes parameters in plain aggregates (M1) ---------------------------

def naive_bayes_parameters(df: DataFrame, text: str, label: str, model: TfidfModel,
                           alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Log priors per class, and log probabilities of every (class, term), seen or not."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    n = df.agg(F.count(F.lit(1))).scalar()
    priors = counts.select(label, F.log(F.col("rows") / n).alias("log_prior"))
    terms = df.sparkSession.createDataFrame([(t,) for t in model.terms], "term string")
    per_term = (unnest(df, X.term_counts(model.params.terms(F.col(text))), "t", label)
                .select(label, "t.term", "t.tf").join(F.broadcast(terms), "term")
                .groupBy(label, "term").agg(F.sum("tf").alias("tf")))
    per_class = per_term.groupBy(label).agg(F.sum("tf").alias("total"))
    size = len(model.terms)
    grid = (counts.filter(F.col(label).isNotNull()).join(per_class, label, "left")
            .withColumn("_terms", terms.agg(F.collect_list("term")).scalar())
            .select(label, F.coalesce("total", F.lit(0)).alias("total"), F.explode("_terms").alias("term")))
    probabilities = grid.join(per_term, [label, "term"], "left").select(
        label, "term", F.log((F.coalesce("tf", F.lit(0)) + alpha) / (F.col("total") + alpha * size))
        .alias("log_probability"))
    return priors, probabilities


# -- LSA (F5) ------------------------------------------------------------------

#: Columns of a block, columns of the basis as a multiple of the dimensions, squared singular values' error that ends
#: the search (relative to the largest), passes at most, and rows of a dense block of vectors.
LSA_BLOCK, LSA_BASIS, LSA_TOLERANCE, LSA_PASSES, LSA_ROWS = 128, 6, 1e-6, 300, 256


def _gram_product(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """``A'(A block)`` for rows of indices ``i`` (null: dense) and values ``v``: slices are added up by executors."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def multiply(batches):
        q, out = shared.value, np.zeros(shared.value.shape)
        for batch in batches:
            for lo in range(0, batch.num_rows, LSA_ROWS):
                part = batch.slice(lo, LSA_ROWS)
                values = [np.asarray(v) for v in part.column(1).to_numpy(zero_copy_only=False)]
                lengths = [len(v) for v in values]
                at = np.concatenate([*(np.arange(n) if i is None else np.asarray(i) for i, n in zip(
                    part.column(0).to_numpy(zero_copy_only=False), lengths, strict=True)), np.zeros(0)]).astype(np.int64)
                known, place = np.unique(at, return_inverse=True)
                dense = np.zeros((len(values), len(known)))
                dense[np.repeat(np.arange(len(values)), lengths), place] = np.concatenate([*values, np.zeros(0)])
                out[known] += dense.T @ (dense @ q[known])
        for k, piece in enumerate(np.array_split(out, LSA_SLICES)):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([piece.tobytes()], pa.binary())], names=["k", "b"])

    def add(a: bytes, b: bytes) -> bytes:
        return (np.frombuffer(a) + np.frombuffer(b)).tobytes()

    found = rows.mapInArrow(multiply, "k long, b binary").rdd.map(tuple).reduceByKey(add).collect()
    shared.destroy()
    flat = np.concatenate([np.frombuffer(b) for _, b in sorted(found)])
    return flat.reshape(block.shape)


#: Slices of the terms in which products are added up.
LSA_SLICES = 16


def _singular(product, size: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest singular values and right singular vectors, from products with the Gram matrix."""
    block = min(LSA_BLOCK, size)
    start = np.linalg.qr(np.random.default_rng(0).standard_normal((size, block)))[0]
    basis, image = start, product(start)
    for _ in range(LSA_PASSES):
        small = basis.T @ image
        found, turn = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(found)[::-1][:wanted]
        errors = np.linalg.norm(image @ turn[:, top] - (basis @ turn[:, top]) * found[top], axis=0)
        open_ = np.flatnonzero(errors > LSA_TOLERANCE * max(found[top[0]], 1e-300))
        if (len(top) == wanted and not len(open_)) or basis.shape[1] >= size:
            break
        if basis.shape[1] + block > max(LSA_BASIS * wanted, 2 * block):  # keep the best and go on from there
            keep = np.argsort(found)[::-1][:max(2 * wanted, block)]
            basis, image = basis @ turn[:, keep], image @ turn[:, keep]
            grown = (image - basis * found[keep])[:, :max(wanted, block)][:, open_[:block]]
        else:
            grown = image[:, -block:]
        for _ in range(2):  # twice is enough for orthogonality
            grown = grown - basis @ (basis.T @ grown)
            u, s, _ = np.linalg.svd(grown, full_matrices=False)
            grown = u[:, s > 1e-10 * max(s[0], 1e-300)] if len(s) and s[0] > 1e-12 else u[:, :0]
        if not grown.shape[1]:
            if basis.shape[1] >= wanted:
                break
            grown = np.random.default_rng(basis.shape[1]).standard_normal((size, min(block, size - basis.shape[1])))
            for _ in range(2):
                grown = np.linalg.qr(grown - basis @ (basis.T @ grown))[0]
        basis, image = np.hstack([basis, grown]), np.hstack([image, product(grown)])
    values = np.sqrt(np.maximum(found[top], 0.0))
    known = values > 1e-7 * max(values[0], 1e-300)  # below it is rounding
    return values[known], (basis @ turn[:, top])[:, known]


class LsaModel:
    """Truncated SVD of a vector column: projection onto the right singular vectors."""

    def __init__(self, components: DenseMatrix, singular_values: list[float],
                 explained: float | None = None):
        self.components, self.singular_values = components, singular_values
        self.explained = explained

    @classmethod
    def fit(cls, vectors: DataFrame, column: str = "features", dimensions: int = 256,
            ) -> "LsaModel":
        """Block Krylov iterations with Rayleigh-Ritz: every pass over the vectors multiplies a block of
        ``LSA_BLOCK`` columns by their Gram matrix; the driver holds a basis of at most ``LSA_BASIS`` times
        ``dimensions`` columns of ``terms`` numbers, which then starts anew from the best of it.
        """
        size = vectors.select(column).first()[0].size
        wanted = min(dimensions, size - 1)
        raw = F.unwrap_udt(F.col(column))
        rows = cut_lineage(vectors.select(raw["indices"].alias("i"), raw["values"].alias("v")))
        values, basis = _singular(lambda block: _gram_product(rows, block), size, wanted)
        model = cls(DenseMatrix(size, len(values), basis.ravel(order="F")), [float(x) for x in values])
        model.explained = model._explained(vectors, column)
        return model

    def transform(self, df: DataFrame, column: str = "features", output: str = "lsa") -> DataFrame:
        """Blocked matrix product inside Arrow batches: sparse entries in, dense arrays out."""
        matrix = df.sparkSession.sparkContext.broadcast(self.components.toArray())

        def project(indices: pd.Series, values: pd.Series) -> pd.DataFrame:
            v = matrix.value
            dense = [np.asarray(x) @ v[np.asarray(i)] if len(i) else np.zeros(v.shape[1])
                     for i, x in zip(indices, values)]
            return pd.DataFrame({"type": 1, "size": None, "indices": None, "values": dense})

        raw = F.unwrap_udt(F.col(column))
        return df.withColumn(output, F.pandas_udf(project, VectorUDT())(
            raw["indices"], raw["values"]))

    def _explained(self, vectors: DataFrame, column: str) -> float:
        """Variance of the projected columns over the variance of the original ones."""
        from pyspark.ml.stat import Summarizer

        projected = self.transform(vectors.select(column), column, "_p")
        row = projected.select(Summarizer.variance(F.col(column)).alias("a"),
                               Summarizer.variance(F.col("_p")).alias("b")).first()
        return float(sum(row.b) / sum(row.a)) if sum(row.a) else 0.0
