import json

import pytest
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.functions import text as X
from docscreen.plans import audit
from docscreen.sources import corpus, dictionaries, files, sinks
from docscreen.streaming import arrivals


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def test_csv_round_trip(spark, folder):
    rows = [(1, 'say "hi",\nbye', "a"), (2, "é, ü", "b"), (3, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    sinks.write_csv(df.coalesce(1), f"{folder}/c")
    back = corpus.read_csv(spark, f"{folder}/c", df.schema)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(a, b) for a, b, _ in rows]


def test_encoding_and_lossy(spark, folder):
    (folder / "l.csv").write_bytes("text,label\ncafé,x\n".encode("latin-1"))
    (folder / "u.csv").write_bytes("text,label\ncafé,x\n".encode())
    schema = "text string, label string"
    for name in ("l.csv", "u.csv"):
        got = corpus.read_csv_any_encoding(spark, f"{folder}/{name}", schema).first()
        assert got.text == "café"
    content = spark.createDataFrame([(bytearray(b"ab\xffc"),)], "b binary")
    assert content.select(corpus.lossy_text(F.col("b")).alias("t")).first().t == "ab�c"


def test_corpus_aliases(spark, folder):
    spark.createDataFrame([("t", " hr ")], "Resume string, Category string").write.parquet(
        f"{folder}/p")
    got = corpus.read_corpus(spark, f"{folder}/p")
    assert got.columns == ["text", "label"] and got.first().label == "hr"
    assert got.schema["text"].metadata["source_column"] == "Resume"


def test_text_files_and_intake(spark, folder):
    (folder / "a.txt").write_text("first\nsecond")
    (folder / "blank.txt").write_text("  \n")
    (folder / "empty.txt").write_text("")
    (folder / "x.exe").write_text("x")
    (folder / "big.txt").write_text("b" * 50)
    names = {r.file_name: r.text for r in corpus.read_text_files(spark, str(folder)).collect()}
    assert names["a.txt"] == "first\nsecond" and "x.exe" not in names
    status = {r.path.rsplit("/", 1)[1]: (r.status, r.text)
              for r in files.intake(spark, str(folder), max_bytes=40).collect()}
    assert status["a.txt"] == (200, "first\nsecond")
    assert {n: s for n, (s, _) in status.items()} == {
        "a.txt": 200, "blank.txt": 422, "empty.txt": 422, "x.exe": 415, "big.txt": 413}


@pytest.mark.parametrize("name, size, status", [
    ("x.exe", 1, 415), ("x.PDF", C.MAX_FILE_BYTES + 1, 413), ("x.png", 0, 422), ("x.jpeg", 5, 200)])
def test_intake_status(spark, name, size, status):
    row = spark.createDataFrame([(name, size)], "path string, length bigint")
    assert row.select(files.intake_status(F.col("path"), F.col("length")).alias("s")).first(
    ).s == status


def test_inventory(spark, folder):
    (folder / "sub").mkdir()
    (folder / "sub" / "d.csv").write_text("a" * 1024)
    (folder / "models.csv").write_text("a")
    found = files.inventory(spark, str(folder), exclude=["models"]).collect()
    assert len(found) == 1 and found[0].megabytes == 1 / 1024


def test_dictionaries(spark, folder):
    (folder / "r.json").write_text(json.dumps(
        {"Tester": {"skills": ["Java", "SQL"]}, "Chef": {"skills": []}}, indent=1))
    table = dictionaries.read_requirements(spark, f"{folder}/r.json")
    assert dictionaries.as_dict(table) == {"Tester": ["Java", "SQL"], "Chef": []}
    assert [(r.role, r.position, r.skill) for r in dictionaries.requirement_rows(table).collect()
            ] == [("Tester", 0, "Java"), ("Tester", 1, "SQL")]
    (folder / "m.json").write_text(json.dumps(C.LABEL_MAP))
    assert dictionaries.as_dict(dictionaries.read_label_map(spark, f"{folder}/m.json")
                                ) == C.LABEL_MAP
    (folder / "w.json").write_text(json.dumps(C.WEIGHTS))
    assert dictionaries.as_dict(dictionaries.read_weights(spark, f"{folder}/w.json")) == C.WEIGHTS


def test_splits_and_report(spark, folder, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", "text", F.col("lang").alias("label"))
    parts = audit.audited_splits(docs)
    sinks.write_splits(parts, f"{folder}/s")
    assert spark.read.parquet(f"{folder}/s").groupBy("split").count().count() == 3
    sinks.write_split_ids(parts, f"{folder}/ids", "test")
    ids = corpus.read_split_ids(spark, f"{folder}/ids")
    assert ids.count() == parts.filter("split = 'test'").count()
    sinks.write_report(audit.audit_report(docs, parts), f"{folder}/r")
    report = spark.read.json(f"{folder}/r").first()
    assert report.status == "CLEAN" and report.total_rows == docs.count()
    assert report.rows_after_filtering + report.filtering["repeat"] == report.total_rows


def test_stream_equals_batch(spark, folder):
    rows = [(i, f"Text number {i % 4}!") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df.repartition(3).write.parquet(f"{folder}/in")

    def step(d):
        return d.select("doc_id", X.clean_text(F.col("text")).alias("c"))

    def run():
        stream = arrivals.read_arrivals(spark, f"{folder}/in", df.schema, files_per_trigger=1)
        arrivals.run_available(stream, step, f"{folder}/out", f"{folder}/state")
        return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))

    assert run() == sorted(map(tuple, step(df).collect()))
    df.limit(2).withColumn("doc_id", F.col("doc_id") + 100).write.mode("append").parquet(
        f"{folder}/in")
    assert len(run()) == 14  # only the new file is processed on restart


def test_text_arrivals(spark, folder):
    (folder / "in").mkdir()
    (folder / "in" / "a.txt").write_text("one\ntwo")
    stream = arrivals.read_text_arrivals(spark, f"{folder}/in")
    arrivals.run_available(stream, lambda d: d, f"{folder}/out", f"{folder}/state")
    assert [tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()] == [
        ("a.txt", "one\ntwo")]


def test_stream_repeats(spark, folder):
    rows = [("A b", "2024-01-01 00:00:00"), ("a-B!", "2024-01-01 00:10:00"),
            ("c", "2024-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "text string, at string").withColumn(
        "at", F.col("at").cast("timestamp"))
    df.write.parquet(f"{folder}/in")
    stream = arrivals.read_arrivals(spark, f"{folder}/in", df.schema)
    arrivals.run_available(
        stream, lambda d: arrivals.drop_repeats(d, X.dedup_key(F.col("text")), "at"),
        f"{folder}/out", f"{folder}/state")
    assert spark.read.parquet(f"{folder}/out").count() == 2


def test_windows_expire_and_late_rows_are_kept(spark, folder):
    """Deliveries out of order: each row is either in the first rows' windows or late, none is lost."""
    import datetime

    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    deliveries = [[("a", day(1, 1)), ("a", day(1, 2)), ("b", day(2, 23))],
                  [("a", day(1, 3)), ("c", day(2, 1)), ("d", day(9, 1)), ("b", day(2, 22))],
                  [("d", day(9, 2)), ("e", day(7, 23)), ("f", day(8, 20)), (None, day(9, 1))]]
    schema = "k string, at timestamp"
    for rows in deliveries:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/in")
        for _ in range(2):  # starting again without new files changes nothing
            stream = arrivals.read_arrivals(spark, f"{folder}/in", spark.createDataFrame([], schema).schema)
            arrivals.run_available(stream, lambda df: arrivals.first_in_window(df, ["k"], "at"), f"{folder}/first", f"{folder}/s")
            arrivals.run_late(stream, "at", f"{folder}/late", f"{folder}/ls")
    first = sorted((str(r.k), r.start.day, r.start.hour) for r in spark.read.parquet(f"{folder}/first").selectExpr("k", "window.start").collect())
    late = sorted((str(r.k), r["at"].day, r["at"].hour) for r in spark.read.schema(schema).parquet(f"{folder}/late").collect())
    # Before the second delivery the latest event is of day 2, 23:00: windows up to day 1, 18:00 are closed.
    assert late == [("a", 1, 3), ("e", 7, 23)]
    assert first == [("None", 9, 0), ("a", 1, 0), ("b", 2, 18), ("c", 2, 0), ("d", 9, 0), ("f", 8, 18)]


def test_stream_of_a_table_in_several_files(spark, sf, folder):
    """A table may be one file or a folder of files."""
    from docscreen.model_queries import stream_screening

    spark.read.parquet(f"{sf}/documents.parquet").repartition(3).write.parquet(f"{folder}/documents.parquet")
    rows = [sorted(map(tuple, stream_screening(spark, place).collect())) for place in (sf, folder)]
    assert rows[0] == rows[1] and len(rows[0]) == 200
