import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.functions import text as X
from docscreen.operators import dedup, grouping, profile, schema, split
from docscreen.plans import audit


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, label string")


@pytest.mark.parametrize("hot_rows", [1, 5, 10**6])
@pytest.mark.parametrize("few_keys", [True, False])
def test_group_stats_equals_window(spark, hot_rows, few_keys):
    """A third of the rows share one key, some keys are null."""
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"k{i % 11}"), f"l{i % 2}")
            for i in range(300)]
    df = corpus(spark, rows)
    got = grouping.with_group_stats(df, ["text"], "doc_id", hot_rows=hot_rows, few_keys=few_keys,
                                    n=F.count(F.lit(1)), first=F.min("doc_id"))
    window = Window.partitionBy("text")
    expected = df.withColumn("n", F.count(F.lit(1)).over(window)).withColumn(
        "first", F.min("doc_id").over(window))
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("digits", [0, 1, 3])
def test_exact_rank_equals_row_number(spark, digits, monkeypatch):
    monkeypatch.setattr(grouping, "HASH_DIGITS", digits)
    df = corpus(spark, [(i, "x", "a" if i % 3 else "b") for i in range(500)])
    got = {(r.doc_id, r.rank) for r in grouping.exact_rank(df, "label", "doc_id").collect()}
    window = Window.partitionBy("label").orderBy(grouping.hash_order("doc_id"), "doc_id")
    expected = {(r.doc_id, r.r) for r in df.withColumn(
        "r", F.row_number().over(window)).collect()}
    assert got == expected


@pytest.mark.parametrize("slice_rows", [40, 250, 10**6])
def test_ordered_ids(spark, slice_rows):
    df = spark.range(0, 700).select((F.col("id") * F.col("id")).alias("k"))
    got = grouping.ordered_ids(df.repartition(5), "k", slice_rows).orderBy("k").collect()
    assert [r.position for r in got] == list(range(700))


def test_ordered_ids_of_equal_keys(spark):
    """One key on most rows: positions are dense, follow the key and do not depend on partitions."""
    df = spark.range(0, 600).select(F.when(F.col("id") < 500, 7).when(F.col("id") < 590, F.col("id") % 5).alias("k"), "id")
    runs = [sorted((r.position, r.k, r.id) for r in grouping.ordered_ids(df.repartition(n), "k", rows).collect())
            for n, rows in ((2, 30), (7, 100), (1, 10**6))]
    assert runs[0] == runs[1] == runs[2]
    assert [p for p, *_ in runs[0]] == list(range(600))
    keys = [-1 if k is None else k for _, k, _ in runs[0]]
    assert keys == sorted(keys) and keys[0] == -1
    assert grouping.ordered_ids(df.limit(0), "k").count() == 0


def test_quotas_of_the_published_split(spark):
    """11,916 rows over 43 classes gave 8,340 / 1,788 / 1,788."""
    sizes = [277 + (1 if i < 11916 - 277 * 43 else 0) for i in range(43)]
    counts = spark.createDataFrame([(f"c{i:02d}", n) for i, n in enumerate(sizes)],
                                   "label string, rows bigint")
    q = split.split_quotas(counts, "label", C.HOLDOUTS_70_15_15)
    total = q.agg(F.sum("n_train"), F.sum("n_validation"), F.sum("n_test")).first()
    assert tuple(total) == (8340, 1788, 1788)
    for r in q.collect():
        assert r.n_train + r.n_validation + r.n_test == r.rows
        assert abs(r.n_test - 0.15 * r.rows) < 1.5 and abs(r.n_train - 0.70 * r.rows) < 1.5


def test_split_properties(spark):
    df = corpus(spark, [(i, f"text {i}", "ab"[i % 5 == 0] + str(i % 3)) for i in range(400)])
    first = split.stratified_split(df.repartition(2))
    again = split.stratified_split(df.repartition(13))
    a = {(r.doc_id, r.split) for r in first.collect()}
    assert a == {(r.doc_id, r.split) for r in again.collect()} and len(a) == 400
    faults = split.split_partition(df, first).first()
    assert tuple(faults) == (0, 0, 0)
    sizes = {r["split"]: r["count"] for r in first.groupBy("split").count().collect()}
    assert sizes["test"] == math.ceil(0.15 * 400)
    pairs = split.split_overlap(first, F.col("text")).collect()
    assert len(pairs) == 3 and {r.shared for r in pairs} == {0}


def test_folds(spark):
    df = corpus(spark, [(i, "t", "ab"[i % 4 == 0]) for i in range(103)])
    folds = split.stratified_folds(df, 5)
    sizes = folds.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("d")).collect()
    assert folds.count() == 103 and all(r.d <= 1 for r in sizes)


def test_gate(spark):
    full = corpus(spark, [(i, f"t{i}", "a") for i in range(6)])
    parts = full.withColumn("split", F.when(F.col("doc_id") < 3, "train").otherwise("test"))
    split.require_clean_splits(full, parts)
    with pytest.raises(split.LeakageError, match="status"):
        split.require_clean_splits(full, parts, status="FAILED")
    with pytest.raises(split.LeakageError, match="partition"):
        split.require_clean_splits(full, parts.filter("doc_id > 0"))
    leaky = corpus(spark, [(0, "Same text!", "a"), (1, "same  TEXT", "a")])
    with pytest.raises(split.LeakageError, match="shared"):
        split.require_clean_splits(leaky, leaky.withColumn(
            "split", F.when(F.col("doc_id") < 1, "train").otherwise("test")))


def test_conflicts_and_keep_first(spark):
    df = corpus(spark, [(3, "A b", "x"), (1, "a-b", "x"), (2, "c", "x"), (4, "C", "y"),
                        (5, "d", "y"), (6, None, "y")])
    key = X.dedup_key(F.col("text"))
    assert {r.doc_id for r in dedup.drop_conflicts(df.filter("text is not null"), key)
            .collect()} == {1, 3, 5}
    assert {r.doc_id for r in dedup.resolve_groups(df.filter("text is not null"), key)
            .collect()} == {1, 5}
    once = dedup.keep_first(df, key)
    assert {r.doc_id for r in dedup.keep_first(once, key).collect()} == {
        r.doc_id for r in once.collect()}
    audit = dedup.duplicate_audit(df).first()
    assert audit.exact_repeat_rows == 0 and audit.normalised_repeat_rows == 2
    assert (audit.conflicting_groups, audit.rows_in_conflicting_groups) == (1, 2)


def test_viable_classes_strict(spark):
    df = corpus(spark, [(i, "t", "a") for i in range(3)] + [(9, "t", "b")])
    assert {r.label for r in schema.viable_classes(df).collect()} == {"a"}
    with pytest.raises(ValueError, match="'b'"):
        schema.viable_classes(df, strict=True)


def test_quality_profile_counts_nulls_as_equal(spark):
    df = spark.createDataFrame([(None,), (None,), ("",), ("a",), ("a",)], "t string")
    row = profile.quality_profile(df, "t").first()
    assert (row.total, row.missing, row.empty, row.repeats) == (5, 2, 3, 2)


def test_class_weights(spark):
    df = corpus(spark, [(i, "t", "a" if i < 6 else "b") for i in range(8)])
    weights = {r.label: r.weight for r in profile.class_weights(df).collect()}
    assert weights == {"a": 8 / 12, "b": 8 / 4}
    assert {r.label: r.weight for r in profile.with_class_weight(df).collect()} == weights


def test_find_and_detect_columns(spark):
    assert schema.find_column(["Job Role", "x"], C.LABEL_ALIASES, "label") == "Job Role"
    with pytest.raises(KeyError):
        schema.find_column(["x"], C.LABEL_ALIASES, "label")
    df = spark.createDataFrame([("long text here", "a", "i1"), ("another long text", "a", "i2")],
                               "body string, kind string, id string")
    assert schema.detect_columns(df) == ("body", "kind")
    with pytest.raises(ValueError):
        schema.detect_columns(df.select("body", F.col("body").alias("copy")))
    with pytest.raises(ValueError):
        schema.detect_columns(df.select("body", "id", F.col("id").alias("id2")))
    with pytest.raises(KeyError):
        schema.require_columns(df, ["absent"])
    with pytest.raises(KeyError):
        schema.require_columns(df, ["body"], exact=True)


@pytest.mark.parametrize("text, expected", [
    (" Data Platform Design \nx", "Data Engineer"), ("Foo\nbar", "Unknown: Foo"), ("   ", None),
    (None, None)])
def test_label_from_first_line(evaluate, text, expected):
    assert evaluate(schema.label_from_first_line(F.col("text"), C.LABEL_MAP), text=text) == expected


def test_merged_sketches_estimate_as_one(spark):
    from docscreen.operators import profile

    df = spark.range(6000).select(
        F.concat(F.lit("text "), (F.col("id") % 2500).cast("string"), F.repeat(F.lit("x"), (F.col("id") % 300).cast("int"))).alias("text"),
        F.when(F.col("id") < 5900, "a").otherwise("b").alias("label"), (F.col("id") % 7).alias("run"))
    stored = [profile.class_sketches(df.filter(F.col("run") == r)) for r in range(7)]
    union = stored[0]
    for s in stored[1:]:
        union = union.unionByName(s)
    merged = {r.label: r for r in profile.sketch_estimates(profile.merged_sketches(union)).collect()}
    exact = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("u"),
                                    *[F.percentile(F.length("text"), q / 100).alias(f"q{q}") for q in (25, 50, 75)]).collect()
    for r in exact:
        m = merged[r.label]
        assert m.rows == r.n and abs(m.unique_texts - r.u) <= 0.03 * r.u
        assert all(abs(m[f"chars_{q}"] - r[f"q{q}"]) <= 10 for q in (25, 50, 75))
    assert profile.merged_sketches(profile.class_sketches(df.limit(0))).count() == 0


def test_classified_rows_normalise_a_text_once(spark, capsys):
    """The groups, their rows and the blank rows come from one written table of keys."""
    rows = [(1, "A b", "x"), (2, "a  B", "x"), (3, "c", "x"), (4, "C!", "y"), (5, " ", "x"), (6, None, "x")]
    found = audit.classify_rows(spark.createDataFrame(rows, "doc_id int, text string, label string"))
    assert dict(found.collect()) == {1: "kept", 2: "repeat", 3: "conflicting labels", 4: "conflicting labels",
                                     5: "missing or empty", 6: "missing or empty"}
    found.explain()
    assert "regexp_replace" not in capsys.readouterr().out
