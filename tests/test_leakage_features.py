import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from docscreen.functions import text as X
from docscreen.operators import dedup, evaluate as E, features, leakage, neardup
from docscreen.operators.features import TfidfModel, TfidfParams, vocabulary


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, label string")


# -- leakage ---------------------------------------------------------------------

@pytest.mark.parametrize("limit, portion", [(0, 1 << 20), (2, 900), (300, 1 << 20)])
def test_phrase_matches_both_ways(spark, sf, limit, portion, monkeypatch):
    """Literals, one automaton and automata of several portions find what plain containment finds."""
    monkeypatch.setattr(leakage, "PORTION_BYTES", portion)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    phrases = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    phrases += ["of the", "tion", "h the in", "e la le d", "Is and", "is AND", "a", "nowhere at all to be found"]
    table = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    got = {(r.phrase, r.doc_id) for r in leakage.phrase_matches(
        docs, "text", table, literal_limit=limit).collect()}
    expected = {(p, r.doc_id) for r in docs.collect() for p in phrases
                if p.lower() in r.text.lower()}
    assert got == expected


@pytest.mark.parametrize("text, label, marker, suffix", [
    ("text\nCategory: HR", "HR", True, True),
    ("text\n  job category - hr  \n", "HR", True, True),
    ("Target Role= Data Engineer", "Data Engineer", True, True),
    ("text category: HR", "HR", False, True),
    ("text\nCategory: HR more", "HR", False, False),
    ("works in xHR", "HR", False, False),
    ("hr", "HR", False, True)])
def test_marker_and_suffix(evaluate, text, label, marker, suffix):
    t, own = F.col("text"), F.col("label")
    assert evaluate(leakage.label_marker(t, own), text=text, label=label) is marker
    assert evaluate(leakage.label_suffix(t, own), text=text, label=label) is suffix


def test_label_words(evaluate):
    t, own = F.col("text"), F.col("label")
    for empty_is in (True, False):
        assert evaluate(leakage.label_words(t, own, empty_is), text="x", label="HR") is empty_is
    assert evaluate(leakage.label_words(t, own, False), text="Java web developers",
                    label="Java Developer") is True


def test_label_position(spark):
    df = corpus(spark, [(1, "x" * 60 + " HR\n" + "y" * 60, "hr"), (2, "none", "hr")])
    row = leakage.label_position(df).collect()
    assert len(row) == 1 and row[0]["at"] == 61 and len(row[0].context) == 102
    assert row[0].percent == round(61 / 124 * 100)


def test_boilerplate(spark):
    head = "A" * 60 + "B" * 60 + "C" * 60
    rows = [(i, head + f" own text {i}", "x") for i in range(5)] + [(9, head, "y")]
    found = {(r.window, r.share, r.suspicious) for r in leakage.boilerplate(
        corpus(spark, rows)).collect()}
    assert found == {(0, 1.0, True), (1, 1.0, True), (2, 1.0, True)}


@pytest.mark.parametrize("shared, portion", [(10**6, 1 << 18), (-1, 7)])
def test_boilerplate_windows_equal_counting_all(spark, shared, portion, monkeypatch):
    monkeypatch.setattr(leakage, "SHARED_MARKS", shared)
    monkeypatch.setattr(leakage, "_CHARS_AT_ONCE", portion)
    random.seed(1)
    word = lambda: random.choice(["aa", "b", "Ünï", "😀", "x1"])
    foot = " ".join(word() for _ in range(30))
    rows = [(i, None if i == 3 else " ".join(word() for _ in range(i * 3)) + (foot if i % 4 else foot[:40]) + "z" * i, "pq"[i % 2])
            for i in range(24)] + [(50, foot * 3, "p"), (51, "", "p"), (52, "short", "q"), (53, foot, None), (54, foot, "r")]
    counts, sizes = Counter(), Counter()
    for _, text, label in rows:
        if label:
            sizes[label] += 1
            low = (text or "").lower()
            counts.update({(label, low[i:i + 60]) for i in range(len(low) - 59)})
    expected = {(k, w, n, round(n / sizes[k], 6)) for (k, w), n in counts.items() if sizes[k] >= 5 and n > 0.5 * sizes[k]}
    got = {(r.label, r.block, r.rows, r.share) for r in leakage.boilerplate_windows(corpus(spark, rows), share=0.5).collect()}
    assert got == expected and len(expected) > 10


def test_boilerplate_marks_are_few():
    random.seed(2)
    text = "".join(random.choice("abcdefghij ") for _ in range(20_000))
    marks = np.concatenate([m for _, m in leakage._window_marks(text, 60)])
    assert len(marks) == len(text) - 59 and len(np.unique(marks)) < len(text) / 15


def test_boilerplate_windows_at_any_offset(spark):
    passage = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(30))[:62]  # three windows of 60
    rows = [(i, "#" * (i * 7 + i * i) + passage + f" own text {i}", "x") for i in range(6)] + [(9, passage, "y")]
    rows += [(20 + i, f"{i} " * 40, "z") for i in range(6)]
    found = {(r.label, r.block, r.rows, r.share) for r in leakage.boilerplate_windows(corpus(spark, rows)).collect()}
    assert {f for f in found if "#" not in f[1] and f[1] in passage} == {("x", passage[k:k + 60], 6, 1.0) for k in range(3)}
    assert {f[0] for f in found} == {"x"}


def test_verdict(spark):
    clean = corpus(spark, [(i, f"words {i}", "label") for i in range(20)])
    assert leakage.leak_verdict(clean).first().verdict == "pass"
    bad = corpus(spark, [(i, "the label target role: x", "label" if i else "the") for i in range(9)])
    row = leakage.leak_verdict(bad).first()
    assert (row.points, row.verdict) == (8, "fail")


# -- tf-idf and near duplicates against brute force ------------------------------------

def brute_vectors(texts, size, sublinear):
    bags = [Counter(w for w in t.lower().split() if len(w) > 1) for t in texts]
    cf, df = Counter(), Counter()
    for b in bags:
        cf.update(b)
        df.update(b.keys())
    vocab = sorted(cf, key=lambda t: (-cf[t], t))[:size]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in vocab}
    out = []
    for b in bags:
        v = {t: ((1 + math.log(n)) if sublinear else n) * idf[t] for t, n in b.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()} if norm else {})
    return out


def test_tfidf_equals_brute_force(spark):
    texts = ["aa bb bb cc", "bb cc dd dd dd", "aa aa ee", "zz", "x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = TfidfModel.fit(df, "text", TfidfParams(max_features=5, high=1))
    expected = brute_vectors(texts, 5, True)
    got = {(r.doc_id, r.term): r.weight for r in model.weights(df, "text").collect()}
    assert set(got) == {(i, t) for i, v in enumerate(expected) for t in v}
    for (i, t), w in got.items():
        assert w == pytest.approx(expected[i][t], abs=1e-12)


@pytest.mark.parametrize("size, low, high, known", [(5, 1, 2, 10**6), (40, 1, 3, 10**6), (40, 1, 2, 3), (12, 2, 2, 10**6), (10**4, 1, 2, 10**6)])
def test_vocabulary_counts_only_runs_of_frequent_words(spark, size, low, high, known, monkeypatch):
    """The most frequent terms and the vectors equal plain counts; rare words are in no counted run."""
    monkeypatch.setattr(features, "KNOWN_WORDS", known)
    draw = random.Random(5)
    texts = [" ".join(draw.choices([f"w{i}é" for i in range(20)], range(20, 0, -1), k=30)) + f" once{n}" for n in range(60)]
    texts += ["", "a", None, "once0", "w1\u00e9 w1e\u0301"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    params = TfidfParams(size, low, high, min_df=2, max_df=0.9)
    words = [[w for w in (t or "").replace("é", "e").replace("e\u0301", "e").split() if len(w) > 1] for t in texts]
    runs = [[" ".join(w[i:i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)] for w in words]
    cf, rows = Counter(), Counter()
    for r in runs:
        cf.update(r)
        rows.update(set(r))
    usable = [t for t in cf if 2 <= rows[t] <= 0.9 * len(texts)]
    best = sorted(usable, key=lambda t: (-cf[t], t))[:size]
    assert [(r.term, r.df, r.cf) for r in vocabulary(df, "text", params).collect()] == [(t, rows[t], cf[t]) for t in best]
    model = TfidfModel.fit(df, "text", params)
    got = {r.doc_id: {model.terms[i]: v for i, v in zip(r.v.indices, r.v.values, strict=True)}
           for r in model.transform(df, "text", "v").collect()}
    for i, r in enumerate(runs):
        raw = {t: (1 + math.log(n)) * (math.log((len(texts) + 1) / (rows[t] + 1)) + 1) for t, n in Counter(r).items() if t in set(best)}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        assert got[i] == pytest.approx({t: x / norm for t, x in raw.items()}, abs=1e-12)
    if size == 5:
        assert not [r for r in features.frequent_statistics(df, "text", params).collect() if " once" in r.term]


def near_texts():
    base = [f"w{i % 17}a w{i % 5}b w{i % 3}c common words here" for i in range(40)]
    long = " ".join(f"term{i}" for i in range(60))
    heavy = [" ".join(["same"] * 50 + [f"own{i}"] * (i % 3)) for i in range(12)]
    return (base + [long, long + " extra", long + " other more", long, "common words here"] + heavy) * 2 + ["", "!", "x"]


@pytest.mark.parametrize("crowd, depth, block, size, shared", [(64, 4, 1000, 0, 100), (2, 4, 2, 0, 10**6),
                                                               (1, 2, 3, 3000, 10**6), (3, 9, 5, 9, 10**6)])
def test_near_duplicates_equal_brute_force(spark, crowd, depth, block, size, shared, monkeypatch):
    for name, value in (("CROWD", crowd), ("DEPTH", depth), ("BLOCK", block), ("SHARED_TERMS", shared), ("HOT_ROWS", 40)):
        monkeypatch.setattr(neardup, name, value)
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    copies, pairs = neardup.near_duplicates(df, "text", params=replace(neardup.WHOLE, max_features=size))
    vectors = brute_vectors(texts, size or 10**9, False)

    def cosine(a, b):
        return sum(x * vectors[b].get(t, 0.0) for t, x in vectors[a].items())

    expected = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))
                if round(cosine(a, b), 6) >= 0.95}
    rep = {r.doc_id: r.rep_id for r in copies.collect()}
    assert sorted(rep) == list(range(len(texts)))
    near = {(r.id_a, r.id_b) for r in pairs.collect()}
    got = {(a, b) for a in rep for b in rep if a < b and (
        rep[a] == rep[b] or (min(rep[a], rep[b]), max(rep[a], rep[b])) in near)}
    assert got == expected
    summary = neardup.near_duplicate_summary(copies, pairs).first()
    assert summary.equal_pairs + summary.near_pairs == len(expected)


def test_near_duplicates_tell_rare_words_apart(spark):
    """Beyond the most frequent terms, texts of rare words only still meet."""
    common = [" ".join(f"c{j}" for j in range(i % 7, i % 7 + 5)) for i in range(60)]
    rare = [" ".join(f"rare{k}x{j}" for j in range(40)) for k in range(3)]
    df = spark.createDataFrame(list(enumerate(common + rare + [r + " tail" for r in rare])), "doc_id bigint, text string")
    whole = {(r.id_a, r.id_b) for r in neardup.near_duplicates(df, "text")[1].collect()}
    capped = {(r.id_a, r.id_b) for r in neardup.near_duplicates(
        df, "text", params=replace(neardup.CAPPED, max_features=11))[1].collect()}
    assert {(60, 63), (61, 64), (62, 65)} <= whole and not {(60, 63), (61, 64), (62, 65)} & capped


def test_copies_need_no_pairs(spark, sf, monkeypatch):
    """The copies come from ids and keys: neither pairs nor weights are built for them."""
    from docscreen import queries

    df = spark.createDataFrame(list(enumerate(near_texts())), "doc_id bigint, text string")
    expected = sorted(map(tuple, neardup.near_duplicates(df, "text")[0].collect()))
    monkeypatch.setattr(neardup, "_near_pairs", None)
    monkeypatch.setattr(neardup, "_weighed", None)
    assert sorted(map(tuple, neardup.equal_vectors(df, "text").collect())) == expected
    assert queries.near_dup_copies(spark, sf).count() == 200


def test_near_duplicates_of_common_words_write_little(spark, tmp_path):
    """Texts that share all their words are compared without copies of rows or lists of candidates."""
    draw = random.Random(3)
    texts = [" ".join(draw.choices([f"word{i}" for i in range(60)], k=40)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    before = spark.conf.get("docscreen.work.dir", None)
    spark.conf.set("docscreen.work.dir", str(tmp_path))
    try:
        neardup.near_duplicates(df, "text")[1].count()
    finally:
        spark.conf.set("docscreen.work.dir", before) if before else spark.conf.unset("docscreen.work.dir")
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 2 * sum(map(len, texts))


def test_near_duplicates_of_nothing(spark):
    copies, pairs = neardup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string"), "text")
    assert copies.count() == 0 and pairs.count() == 0


def test_seeded_sample(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    a = {r.doc_id for r in dedup.seeded_sample(df.repartition(3), 10).collect()}
    assert a == {r.doc_id for r in dedup.seeded_sample(df.repartition(7), 10).collect()}
    assert len(a) == 10


# -- metrics -------------------------------------------------------------------------

def test_metrics(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 3 + [("b", "b")] * 2 + [("c", "a")] + [("b", "d")]
    df = spark.createDataFrame(pairs, "label string, prediction string")
    grid = E.confusion_grid(df)
    classes = ["a", "b", "c", "d"]
    f1 = []
    for c in classes:
        tp = sum(t == p == c for t, p in pairs)
        fp = sum(p == c != t for t, p in pairs)
        fn = sum(t == c != p for t, p in pairs)
        f1.append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    row = E.metrics(grid).first()
    assert row.accuracy == pytest.approx(7 / 12) == pytest.approx(row.weighted_recall)
    assert row.macro_f1 == pytest.approx(sum(f1) / 4) and row.minority_f1 == 0.0
    assert E.confusion_matrix(grid).count() == 16
    assert E.class_report(grid).count() == 4


def test_top_k_ties_by_name(spark):
    scores = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("score"))
                       for n, s in (("b", 1.0), ("a", 1.0), ("c", 2.0))])
    assert spark.range(1).select(E.top_k(scores, 2).alias("t")).first().t == ["c", "a"]


def test_select_best(spark):
    rows = spark.createDataFrame([("x", 0.9, 0.8, 2.0), ("y", 0.9, 0.8, 1.0), ("z", 0.8, 1.0, 0.1)],
                                 "model string, macro_f1 double, accuracy double, s double")
    assert E.select_best(rows, ["macro_f1", "accuracy", "-s"]).first().model == "y"


def test_key_hash_is_short(evaluate):
    assert len(evaluate(X.key_hash(F.col("text")), text="x" * 1000)) == 16


def test_blocks_of_near_duplicates_are_held_a_few_at_a_time(spark, monkeypatch):
    """Rows of megabytes: files are written in parts of few blocks and read block by block, and settings are restored."""
    import pyarrow.parquet as pq

    seen = {}

    def compared(blocks, *rest):
        files = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")) for f in blocks.inputFiles()]
        seen["groups"], seen["blocks"] = sum(f.num_row_groups for f in files), blocks.count()
        return near_pairs(blocks, *rest)

    near_pairs = neardup._near_pairs
    monkeypatch.setattr(neardup, "_near_pairs", compared)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setitem(neardup.LARGE_ROWS, "parquet.block.size", "500")
    size = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    words = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(i, f"{words} own{i} other{i % 7}") for i in range(80)], "doc_id bigint, text string").coalesce(1)
    assert neardup.near_duplicates(df, "text", threshold=0.3)[1].count() > 0
    assert seen["blocks"] >= 20 and seen["groups"] >= 20
    assert neardup.LARGE_ROWS["spark.sql.parquet.columnarReaderBatchSize"] == "1"
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == size
