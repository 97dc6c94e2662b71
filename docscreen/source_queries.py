"""Registered round trips of readers, writers and gates, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.functions import text as X
from docscreen.operators import schema, split
from docscreen.oracles import ORACLES, oracle
from docscreen.plans import audit
from docscreen.queries import D, T, by_lang, query, table
from docscreen.session import cut_lineage, shared_folder
from docscreen.sources import corpus, dictionaries, files, sinks

#: Largest file that the intake query lets in, so that some documents are refused.
INTAKE_BYTES = 4096
_NAMES = (".txt", ".PDF", ".exe", "", ".png")
_REFUSED = ", ".join(str(i) for i, n in enumerate(_NAMES) if n.lower() not in C.FILE_EXTENSIONS)
_DIGEST = "SELECT doc_id, sha256(text) AS digest, source AS label FROM documents"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _digests(df: DataFrame) -> DataFrame:
    return df.select(D, F.sha2(T(), 256).alias("digest"), "label")


def _labelled(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(D, "text", F.col("source").alias("label"))


@query
def csv_round_trip(spark, sf):
    """Texts with quotes and line breaks, written and read back."""
    path = _folder(spark, "csv")
    sinks.write_csv(_labelled(spark, sf).withColumn("text", F.concat(F.lit('"\n, '), T())), path)
    back = corpus.read_csv(spark, path, "doc_id bigint, text string, label string")
    return _digests(back.withColumn("text", F.substr(T(), F.lit(5))))


oracle("csv_round_trip", _DIGEST)


@query
def csv_encodings(spark, sf):
    """Texts that fit Latin-1 in files of that encoding, all others in UTF-8; each file read in its own."""
    path, docs = _folder(spark, "encodings"), _labelled(spark, sf)
    latin = T().rlike(r"^[\x00-\xFF]*$")
    for name, rows, encoding in (("a", docs.filter(latin), "ISO-8859-1"), ("b", docs.filter(~latin), "UTF-8")):
        rows.write.options(header=True, quote='"', escape='"', quoteAll=True, encoding=encoding).csv(f"{path}/{name}")
    return _digests(corpus.read_csv_any_encoding(spark, f"{path}/*", "doc_id bigint, text string, label string"))


oracle("csv_encodings", _DIGEST)


@query
def lossy_text(spark, sf):
    """Texts followed by a byte that is no UTF-8."""
    docs = _labelled(spark, sf)
    broken = F.concat(T().cast("binary"), F.unhex(F.lit("FF")))
    return _digests(docs.withColumn("text", corpus.lossy_text(broken)))


oracle("lossy_text", "SELECT doc_id, sha256(text || chr(65533)) AS digest, source AS label FROM documents")


@query
def dictionary_rows(spark, sf):
    """A JSON dictionary of the sources of each language as rows."""
    path = _folder(spark, "dictionary")
    lists = (table(spark, sf, "documents").filter("lang is not null and source is not null").groupBy("lang")
             .agg(F.struct(F.sort_array(F.collect_set("source")).alias("skills")).alias("v")))
    # One row a language.
    lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("lang", "v"))))).coalesce(1).write.text(path)
    return dictionaries.requirement_rows(dictionaries.read_requirements(spark, path))


oracle("dictionary_rows", "SELECT lang AS role, CAST(row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS INTEGER) "
       "AS position, source AS skill FROM (SELECT DISTINCT lang, source FROM documents "
       "WHERE lang IS NOT NULL AND source IS NOT NULL)")


@query
def text_files(spark, sf):
    """Documents as lines of text files, and the files read whole."""
    path = _folder(spark, "texts")
    one_line = F.regexp_replace(F.coalesce(T(), F.lit("")), r"[\r\n]", " ")
    table(spark, sf, "documents").select(one_line.alias("value")).write.text(path)
    found = corpus.read_text_files(spark, path)
    return found.agg(F.sum(F.length("text")).alias("chars"),
                     F.bool_and(F.endswith("file_name", F.lit(".txt"))).alias("named"))


oracle("text_files", "SELECT CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS chars, true AS named FROM documents")


@query
def file_inventory(spark, sf):
    """Files of three formats by extension; excluded folders are left out."""
    path, docs = _folder(spark, "inventory"), table(spark, sf, "documents")
    docs.write.parquet(f"{path}/kept/a")
    docs.select(D, "lang").write.csv(f"{path}/kept/b")
    docs.select(D, "lang").write.json(f"{path}/kept/c")
    docs.select(D).write.csv(f"{path}/models/d")
    found = files.inventory(spark, path, exclude=["models"])
    return found.groupBy(files.extension(F.col("path")).alias("extension")).agg(
        (F.sum("megabytes") > 0).alias("some"), F.bool_and(F.contains("path", F.lit("/kept/"))).alias("kept"))


oracle("file_inventory", "SELECT extension, true AS some, true AS kept FROM (VALUES ('.parquet'), ('.csv')) t(extension)")


@query
def intake_gate(spark, sf):
    """Documents as uploads: by name, size and content."""
    name = F.concat(F.lit("d"), F.col(D).cast("string"), F.element_at(F.array(
        *[F.lit(x) for x in _NAMES]), (F.length(T()) % len(_NAMES) + 1).cast("int")))
    text = F.when(F.length(T()) % 7 == 0, F.lit(" \n")).otherwise(T())
    return table(spark, sf, "documents").select(D, files.intake_status(
        name, F.octet_length(T()), text, max_bytes=INTAKE_BYTES).alias("status"))


oracle("intake_gate", f"""
SELECT doc_id, CAST(CASE WHEN length(text) % {len(_NAMES)} IN ({_REFUSED}) THEN 415 WHEN strlen(text) > {INTAKE_BYTES} THEN 413
 WHEN strlen(text) = 0 OR length(text) % 7 = 0 OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 422
 ELSE 200 END AS INTEGER) AS status FROM documents""")


@query
def json_report(spark, sf):
    """A nested report written as one document and read back."""
    path = _folder(spark, "report")
    report = table(spark, sf, "documents").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.struct(F.sum(F.length(T())).alias("chars"), F.count_distinct("lang").alias("langs"),
                 F.lit(None).cast("string").alias("note")).alias("texts"))
    sinks.write_report(report, path)
    back = spark.read.json(path)
    return back.select("total_rows", "texts.chars", "texts.langs", F.array_contains(F.array(
        *[F.lit(c) for c in back.select("texts.*").columns]), "note").alias("kept_null"))


oracle("json_report", "SELECT count(*) AS total_rows, CAST(sum(length(text)) AS BIGINT) AS chars, "
       "count(DISTINCT lang) AS langs, true AS kept_null FROM documents")


@query
def alias_columns(spark, sf):
    """Columns found by other names that ignore case, spaces and underscores."""
    docs = table(spark, sf, "documents").select(D, T().alias("RESUME text"), F.col("source").alias("Job_Role"), "n_chars")
    names = docs.columns
    found = [schema.find_column(names, ["resume", "resume_text"], "text"), schema.find_column(names, ["jobrole"], "label")]
    return _digests(docs.select(D, F.col(found[0]).alias("text"), F.col(found[1]).alias("label")))


oracle("alias_columns", _DIGEST)


def _refused(call, error) -> bool:
    try:
        call()
    except error:
        return True
    return False


@query
def required_columns(spark, sf):
    """Rows pass if the columns do; missing and unexpected ones are refused."""
    docs = table(spark, sf, "documents").select(D, "lang")
    refused = (_refused(lambda: schema.require_columns(docs, [D, "label"]), KeyError)
               and _refused(lambda: schema.require_columns(docs, [D], exact=True), KeyError))
    return schema.require_columns(docs, [D, "lang"], exact=True).withColumn("refused", F.lit(refused))


oracle("required_columns", "SELECT doc_id, lang, true AS refused FROM documents")


@query
def split_files(spark, sf):
    """Splits that pass the leakage gate, written by split and read back; repeated ids are refused."""
    path, docs = _folder(spark, "splits"), by_lang(spark, sf)
    parts = cut_lineage(audit.audited_splits(docs))
    full = docs.join(parts.select(D), D, "left_semi")
    refused = _refused(lambda: split.require_clean_splits(full, parts.unionByName(parts)), split.LeakageError)
    sinks.write_splits(split.require_clean_splits(full, parts), path)
    sinks.write_split_ids(parts, f"{path}-ids", "test")
    ids = corpus.read_split_ids(spark, f"{path}-ids").select(D, F.lit(True).alias("listed"))
    back = spark.read.parquet(path).join(ids, D, "left")
    return back.select(D, "label", "split", (F.coalesce("listed", F.lit(False)) == (F.col("split") == "test")).alias("ids"),
                       F.lit(refused).alias("refused"), X.is_blank(T()).alias("blank"))


ORACLES["split_files"] = ("SELECT doc_id, label, split, true AS ids, true AS refused, false AS blank FROM ("
                          + ORACLES["audited_splits"] + ") AS audited")
