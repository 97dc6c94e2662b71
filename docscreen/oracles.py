"""The registered queries once more, as independent SQL for DuckDB.

Written against the plain tables, without the tricks that make the Spark side scale: the naive
form is the point of comparison.
"""

from __future__ import annotations

from docscreen import constants as C
from docscreen import queries as Q

ORACLES: dict[str, str] = {}
W, S = C.WORD, C.SPACE


def s(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def rep(text: str, pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({text}, {s(pattern)}, {s(by)}, {s(flags)})"


def strip(text: str) -> str:
    return rep(text, f"^[{S}]+|[{S}]+$", "")


def collapse(text: str) -> str:
    return strip(rep(text, f"[{S}]+", " "))


# RE2 has no lookaround; its word boundary serves the driver texts.
PHONE = (rf"\b(?:\+?\d{{1,3}}[{S}-]?)?(?:\(\d{{2,4}}\)[{S}-]?|\d{{2,4}}[{S}-])?"
         rf"\d{{3,4}}[{S}-]?\d{{3,4}}\b")
ADDRESS = (rf"\b\d{{1,5}}[{S}]+(?:[A-Za-z0-9]+[{S}]){{0,3}}"
           r"(?:street|st|avenue|ave|road|rd|lane|ln|boulevard|blvd|way|court|ct)\b")


def urls(t):
    return rep(t, C.URL, " ", "gi")


def tags(t):
    return rep(t, C.HTML_TAG, " ")


def emails(t):
    return rep(t, C.EMAIL, " ")


def phones(t):
    return rep(t, PHONE, " ")


def addresses(t):
    return rep(t, ADDRESS, " ", "gi")


def special(t):
    return rep(t, C.SPECIAL_CHARS, " ")


def clean(t: str) -> str:
    return collapse(special(addresses(phones(emails(tags(urls(f"lower({t})")))))))


def key(t: str) -> str:
    return f"trim({rep(f'replace(lower({t}), {s(chr(223))}, {s("ss")})', f'[^{W}]+', ' ')})"


def is_blank_sql(t: str) -> str:
    return f"({t} IS NULL OR {strip(t)} = '')"


def tokens(t: str) -> str:
    return f"regexp_extract_all(lower({t}), {s(f'[{W}]{{2,}}')})"


def words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, {s(f'[{S}]+')}), lambda x: x <> '')"


def listing(items) -> str:
    return "[" + ", ".join(s(i) for i in items) + "]"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(s(v) for v in r) + ")" for r in rows) + ")"


def case(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in mapping.items()) + \
        " END"


LANG = "docs AS (SELECT doc_id, text, lang AS label FROM documents)"
SOURCE = "docs AS (SELECT doc_id, text, source AS label FROM documents)"
QUALITY = ("docs AS (SELECT d.doc_id, d.text, CAST(l.quality AS VARCHAR) AS label "
           "FROM documents d LEFT JOIN labels l USING (doc_id))")
PHRASES = f"phrases AS (SELECT * FROM {values(Q.PHRASES.items())} t(phrase, label))"


def oracle(name: str, sql: str, *ctes: str) -> None:
    ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql


# -- scans and schema ----------------------------------------------------------
oracle("corpus_scan", "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, source AS label FROM documents")
oracle("column_profile", """
SELECT * FROM (
 SELECT 'text' AS "column", round(avg(length(text)), 6) AS mean_length,
        count(DISTINCT text) AS distinct_values FROM documents
 UNION ALL SELECT 'lang', round(avg(length(lang)), 6), count(DISTINCT lang) FROM documents
 UNION ALL SELECT 'source', round(avg(length(source)), 6), count(DISTINCT source) FROM documents)
""")
oracle("doc_ids", "SELECT doc_id, lang, printf('doc-%06d', row_number() OVER (ORDER BY doc_id) - 1)"
       " AS document_id FROM documents")
oracle("valid_rows", "SELECT doc_id, trim(label) AS label FROM docs "
       "WHERE trim(text) <> '' AND trim(label) <> ''", QUALITY)
oracle("missing_counts", """
SELECT count(*) FILTER (text IS NULL) AS missing_text,
       count(*) FILTER (trim(text) = '') AS empty_text,
       count(*) FILTER (label IS NULL) AS missing_label,
       count(*) FILTER (trim(label) = '') AS empty_label FROM docs""", QUALITY)
oracle("min_chars", f"SELECT doc_id, CAST(length(c) AS INTEGER) AS chars FROM "
       f"(SELECT doc_id, {clean('text')} AS c FROM documents) WHERE length(c) >= 30")
oracle("min_tokens", f"SELECT doc_id, CAST(len({words('c')}) AS INTEGER) AS n FROM "
       f"(SELECT doc_id, {clean('text')} AS c FROM documents) WHERE len({words('c')}) >= 20")
oracle("viable_classes", """
SELECT doc_id, label FROM (
 SELECT doc_id, lang || '/' || source AS label,
        count(*) OVER (PARTITION BY lang, source) AS n FROM documents) WHERE n >= 3""")
oracle("short_flags", "SELECT doc_id, length(text) < 100 AS is_short FROM documents")
oracle("snippets", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' "
       "ELSE text END AS snippet FROM documents")
LOOKUP = ("CASE WHEN trim(role) = '' OR role IS NULL THEN NULL "
          "WHEN lower(trim(split_part(role, chr(10), 1))) = 'user' THEN 'question' "
          "ELSE 'Unknown: ' || left(trim(split_part(role, chr(10), 1)), 40) END")
oracle("label_lookup", f"SELECT conv_id, turn, {LOOKUP} AS mapped_label FROM conversations")
oracle("label_lookup_table", """
SELECT c_custkey, r_name AS mapped_label FROM customer
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
oracle("before_after", f"SELECT doc_id, text AS before, {clean('text')} AS after FROM documents")

# -- aggregations ----------------------------------------------------------------
_QP = """SELECT count(*) AS total, count(*) FILTER ({t} IS NULL) AS missing,
 count(*) FILTER (coalesce({t}, '') = '') AS empty,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT {t} FROM docs)) AS repeats,
 count(*) FILTER (length(coalesce({t}, '')) < 30) AS short,
 count(*) FILTER (length(coalesce({t}, '')) > 3000) AS long, '{stage}' AS stage FROM docs"""
oracle("quality_profile", _QP.format(t="text", stage="before") + " UNION ALL "
       + _QP.format(t="clean", stage="after"),
       f"docs AS (SELECT text, {clean('text')} AS clean FROM documents)")
oracle("null_profile", """
SELECT 'doc_id' AS "column", count(*) FILTER (doc_id IS NULL) AS nulls FROM docs
UNION ALL SELECT 'text', count(*) FILTER (text IS NULL) FROM docs
UNION ALL SELECT 'label', count(*) FILTER (label IS NULL) FROM docs""", QUALITY)
oracle("repeated_rows", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM "
       "documents)) AS repeated_rows FROM documents")
_LS = """SELECT '{m}' AS measure, round(avg(n), 6) AS mean, CAST(median(n) AS DOUBLE) AS median,
 CAST(min(n) AS BIGINT) AS min, CAST(max(n) AS BIGINT) AS max, round(stddev_samp(n), 6) AS std
 FROM (SELECT {e} AS n FROM documents)"""
oracle("length_stats", _LS.format(m="chars", e="length(text)") + " UNION ALL "
       + _LS.format(m="tokens", e=f"len({words('text')})"))
_HIST = """SELECT '{m}' AS measure, bin, round(lo + bin * greatest(hi - lo, 1) / 40.0, 6) AS from_length,
 round(lo + (bin + 1) * greatest(hi - lo, 1) / 40.0, 6) AS to_length,
 (SELECT count(*) FROM {m} WHERE least(floor((n - lo) * 40.0 / greatest(hi - lo, 1)), 39) = bin) AS rows, mid AS median
FROM (SELECT min(n) AS lo, max(n) AS hi, CAST(median(n) AS DOUBLE) AS mid FROM {m}), range(40) r(bin)"""
oracle("length_hist", _HIST.format(m="chars") + " UNION ALL " + _HIST.format(m="tokens"),
       "chars AS (SELECT length(text) AS n FROM documents)",
       f"tokens AS (SELECT len({words('text')}) AS n FROM documents)")
oracle("class_dist", "SELECT lang AS label, count(*) AS rows, "
       "round(count(*) * 100.0 / (SELECT count(*) FROM documents), 2) AS percent "
       "FROM documents GROUP BY 1")
oracle("class_summary", """
SELECT count(*) AS classes, min(n) AS min_rows,
 (SELECT label FROM c ORDER BY n, label LIMIT 1) AS min_label, max(n) AS max_rows,
 (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS max_label, round(avg(n), 6) AS mean_rows
FROM c""", "c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1)")
oracle("tiny_classes", "SELECT lang || '/' || source AS label, count(*) AS rows FROM documents "
       "GROUP BY 1 HAVING count(*) < 5")
oracle("label_validation", f"""
SELECT count(*) AS total,
 count(*) FILTER (m IS NOT NULL AND NOT starts_with(m, 'Unknown')) AS labelled,
 count(*) FILTER (m IS NULL OR starts_with(m, 'Unknown')) AS unknown,
 count(DISTINCT m) AS unique_labels FROM (SELECT {LOOKUP} AS m FROM conversations)""")
oracle("distinct_counts", "SELECT count(DISTINCT text) AS text, count(DISTINCT lang) AS lang, "
       "count(DISTINCT source) AS source FROM documents")
oracle("unique_per_class", "SELECT label, count(DISTINCT text) AS unique_texts, count(*) AS total "
       "FROM docs GROUP BY label", SOURCE)
_REP = "r AS (SELECT text, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text)"
oracle("sketch_merge", "SELECT label, count(*) AS rows, true AS \"distinct\", true AS quantiles FROM docs "
       "WHERE label IS NOT NULL GROUP BY label", LANG)
oracle("repeat_hist", "SELECT count(*) FILTER (n = 1) AS once, count(*) FILTER (n > 1) AS repeated, "
       "count(*) AS distinct_texts FROM r", _REP)
oracle("repeat_top", "SELECT first_id, replace(left(text, 80), chr(10), ' ') AS snippet, n AS times "
       "FROM r ORDER BY n DESC, first_id LIMIT 10", _REP)
oracle("imbalance", "SELECT round(max(n) / min(n), 6) AS ratio, max(n) / min(n) >= 2.0 "
       "AS use_weights FROM (SELECT count(*) AS n FROM documents GROUP BY lang)")
oracle("class_weights", "SELECT label, n AS rows, round((SELECT sum(n) FROM c) / "
       "((SELECT count(*) FROM c) * n), 6) AS weight FROM c",
       "c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1)")
LINE = f"lower({strip("split_part(text, chr(10), 1)")})"
oracle("line_label_card", f"""
SELECT count(*) FILTER (n = 1) AS single_label_lines, count(*) FILTER (n > 1) AS multi_label_lines
FROM (SELECT {LINE} AS line, count(DISTINCT label) AS n FROM docs GROUP BY 1)""", SOURCE)
oracle("line_label_top", f"""
SELECT label, line, n AS rows FROM (
 SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, line) AS r FROM (
  SELECT label, {LINE} AS line, count(*) AS n FROM docs GROUP BY 1, 2)) WHERE r = 1""", LANG)

# -- splits ------------------------------------------------------------------------


def split_ctes(source: str, holdouts=C.HOLDOUTS_70_15_15) -> list[str]:
    """Quotas by largest remainder, then places in hash order, as plain windows."""
    ctes = [source, "q0 AS (SELECT label, count(*) AS n, count(*) AS remain FROM docs "
            "WHERE label IS NOT NULL GROUP BY label)"]
    for i, (name, fraction) in enumerate(holdouts):
        ctes += [
            f"k{i} AS (SELECT *, sum(remain) OVER () - ceil(round({fraction!r} * "
            f"(sum(remain) OVER ()), 9)) AS keep, sum(remain) OVER () AS total FROM q{i})",
            f"f{i} AS (SELECT *, remain * keep / total AS share, "
            f"floor(remain * keep / total) AS base FROM k{i})",
            f"q{i + 1} AS (SELECT * EXCLUDE (remain, keep, total, share, base), "
            f"remain - st{i} AS n_{name}, st{i} AS remain FROM (SELECT *, CAST(base + CASE WHEN "
            f"row_number() OVER (ORDER BY round(share - base, 9) DESC, label) <= keep - "
            f"sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS st{i} FROM f{i}))"]
    names = [n for n, _ in reversed(holdouts)]
    limits, cases = "remain", "WHEN r <= remain THEN 'train' "
    for name in names[:-1]:
        limits += f" + n_{name}"
        cases += f"WHEN r <= {limits} THEN '{name}' "
    ctes.append(
        f"parts AS (SELECT doc_id, text, label, CASE {cases}ELSE '{names[-1]}' END AS split FROM ("
        "SELECT d.*, q.* EXCLUDE (label), row_number() OVER (PARTITION BY d.label ORDER BY "
        f"md5(d.doc_id || '|42'), d.doc_id) AS r FROM docs d JOIN q{len(holdouts)} q "
        "ON d.label = q.label))")
    return ctes


oracle("stratified_split", "SELECT doc_id, label, split FROM parts", *split_ctes(LANG))
oracle("split_80_20", "SELECT doc_id, label, split FROM parts",
       *split_ctes(SOURCE, C.HOLDOUTS_80_20))
oracle("split_class_counts", "SELECT split, label, count(*) AS rows FROM parts GROUP BY ALL "
       "UNION ALL SELECT split, '(all)', count(*) FROM parts GROUP BY ALL", *split_ctes(LANG))
oracle("kfold", "SELECT label, doc_id, CAST((row_number() OVER (PARTITION BY label ORDER BY "
       "md5(doc_id || '|42'), doc_id) - 1) % 5 AS INTEGER) AS fold FROM docs", LANG)
oracle("split_semi", "SELECT doc_id, label FROM docs WHERE doc_id IN "
       "(SELECT doc_id FROM labels WHERE quality = 1)", LANG)
oracle("split_overlap", f"""
SELECT x.split AS split_a, y.split AS split_b, (SELECT count(DISTINCT a.k)
 FROM (SELECT split, {key('text')} AS k FROM parts) a
 JOIN (SELECT split, {key('text')} AS k FROM parts) b ON a.k = b.k
 WHERE a.split = x.split AND b.split = y.split) AS shared
FROM (SELECT DISTINCT split FROM parts) x JOIN (SELECT DISTINCT split FROM parts) y ON x.split < y.split""",
       *split_ctes(LANG))

# -- repeats and conflicts -----------------------------------------------------------
KEYED = f"keyed AS (SELECT doc_id, text, label, {key('text')} AS k FROM docs)"
GROUPS = ("g AS (SELECT k, count(*) AS n, min(doc_id) AS first_id, count(DISTINCT label) AS labels "
          "FROM keyed GROUP BY k)")
oracle("dup_after_first", "SELECT doc_id, row_number() OVER (PARTITION BY k ORDER BY doc_id) > 1 "
       "AS is_repeat FROM keyed", SOURCE, KEYED)
oracle("dup_all", "SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS in_repeated_group "
       "FROM documents")
oracle("dedup_first", "SELECT doc_id, label FROM keyed QUALIFY row_number() OVER "
       "(PARTITION BY k ORDER BY doc_id) = 1", SOURCE, KEYED)
oracle("label_conflicts", "SELECT first_id, n AS rows, labels FROM g WHERE labels > 1",
       SOURCE, KEYED, GROUPS)
oracle("drop_conflicts", "SELECT doc_id, label FROM keyed WHERE k NOT IN "
       "(SELECT k FROM g WHERE labels > 1)", SOURCE, KEYED, GROUPS)
CORPUS = ("corpus AS (SELECT doc_id, text, label FROM keyed WHERE k NOT IN (SELECT k FROM g WHERE "
          "labels > 1) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1)")
oracle("clean_corpus", "SELECT doc_id, label FROM corpus", SOURCE, KEYED, GROUPS, CORPUS)
oracle("duplicate_audit", """
SELECT CAST((SELECT sum(n - 1) FROM e) AS BIGINT) AS exact_repeat_rows,
 (SELECT count(*) FROM e WHERE n > 1) AS exact_repeat_groups,
 CAST((SELECT sum(n - 1) FROM g) AS BIGINT) AS normalised_repeat_rows,
 (SELECT count(*) FROM g WHERE n > 1) AS normalised_repeat_groups,
 (SELECT count(*) FROM g WHERE labels > 1) AS conflicting_groups,
 CAST((SELECT coalesce(sum(n), 0) FROM g WHERE labels > 1) AS BIGINT) AS rows_in_conflicting_groups
""", SOURCE, KEYED, GROUPS, "e AS (SELECT text, count(*) AS n FROM docs GROUP BY text)")
oracle("seeded_sample", "SELECT doc_id, label FROM docs ORDER BY md5(doc_id || '|42'), doc_id "
       "LIMIT 500", LANG)
oracle("dup_in_class", "SELECT doc_id, row_number() OVER (PARTITION BY label, text ORDER BY doc_id) "
       "> 1 AS is_repeat FROM docs", SOURCE)
REASONS = ("reasons AS (SELECT doc_id, CASE WHEN labels > 1 THEN 'conflicting labels' WHEN doc_id <> "
           "first_id THEN 'repeat' ELSE 'kept' END AS reason FROM keyed JOIN g USING (k))")
oracle("filter_reasons", "SELECT doc_id, reason FROM reasons", SOURCE, KEYED, GROUPS, REASONS)
oracle("filter_ledger", "SELECT reason, count(*) AS rows FROM reasons GROUP BY 1",
       SOURCE, KEYED, GROUPS, REASONS)
_AUDITED = [LANG.replace("docs AS", "raw AS"),
            f"keyed AS (SELECT doc_id, text, label, {key('text')} AS k FROM raw)", GROUPS, CORPUS]
_SPLIT_CORPUS = split_ctes("docs AS (SELECT * FROM corpus)")
oracle("audited_splits", "SELECT doc_id, label, split FROM parts", *_AUDITED, *_SPLIT_CORPUS)
oracle("split_partition", """
SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p)) AS missing,
 (SELECT count(*) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS "foreign",
 (SELECT count(*) FROM (SELECT doc_id FROM p GROUP BY 1 HAVING count(*) > 1)) AS repeated""",
       f"p AS ({ORACLES['audited_splits']})")


def suffix(text: str, label: str) -> str:
    return f"ends_with(' ' || {key(text)}, ' ' || {key(label)})"


oracle("audit_report", f"""
SELECT (SELECT count(*) FROM raw) AS total_rows, (SELECT count(DISTINCT label) FROM raw) AS classes,
 (SELECT count(*) FROM parts WHERE length(text) < 100) AS short_rows,
 (SELECT count(*) FROM parts) AS rows_after_filtering, CAST(0 AS BIGINT) AS overlap,
 'CLEAN' AS status,
 (SELECT count(*) - count(DISTINCT text) FROM raw) AS exact_repeat_rows,
 (SELECT count(*) FROM g WHERE labels > 1) AS conflicting_groups,
 (SELECT count(*) FROM raw WHERE label IS NULL) AS missing_label,
 (SELECT count(*) FROM raw WHERE {suffix('text', 'label')}) AS suffix_rows,
 (SELECT count(*) FROM parts) AS kept,
 (SELECT count(*) FROM parts WHERE split = 'train') AS train,
 (SELECT count(*) FROM parts WHERE split = 'validation') AS validation,
 (SELECT count(*) FROM parts WHERE split = 'test') AS test,
 (SELECT count(*) FROM parts WHERE label = 'fr') AS fr_after""", *_AUDITED, *_SPLIT_CORPUS)

# -- text functions --------------------------------------------------------------------


def per_doc(name: str, **columns: str) -> None:
    listed = ", ".join(f'{e} AS "{n}"' for n, e in columns.items())
    oracle(name, f"SELECT doc_id, {listed} FROM docs", LANG)


def per_page(name: str, **columns: str) -> None:
    listed = ", ".join(f'{e} AS "{n}"' for n, e in columns.items())
    oracle(name, f"SELECT page_id, {listed} FROM pages")


per_doc("clean_text", clean=clean("text"))
per_page("clean_pages", clean=clean("html"))
per_doc("step_lower", out="lower(text)")
per_page("step_urls", out=urls("concat_ws(' ', 'see', url, 'or www.x.org/a?b now')"))
per_page("step_tags", out=tags("html"))
per_doc("step_emails", out=emails("text"))
per_doc("step_phones", out=phones("text"))
oracle("step_addresses", "SELECT doc_id, "
       + addresses("concat_ws(' ', n_chars, 'Old', lang, 'Road.', text)")
       + " AS out FROM documents")
per_doc("step_special", out=special("text"))
per_doc("step_spaces", out=collapse("text"))
per_doc("norm_key", key=key("text"))
per_doc("norm_key_unicode", key=key("('café fi abc ' || text)"))


def bounded(pattern: str) -> str:
    return f"(^|[^{W}])(?:{pattern})($|[^{W}])"


def clean_tech(text: str) -> str:
    """Boundaries consume a character here, which is put back; the head is added twice over."""
    out = f"lower({text})"
    for pattern, by in ((r"c\+\+", " czqpluszqplus "), ("c#", " czqhash "),
                        (r"asp\.net", " aspzqdotnet "), (r"\.net", " zqdotnet "),
                        ("scikit-learn", " scikitzqdashlearn ")):
        for _ in range(2):
            out = rep(out, bounded(pattern), rf"\1{by}\2")
    for _ in range(2):
        out = rep(out, f"(^|[^{W}])([a-z0-9]+)\\.(js|py|go|rb|ts)($|[^{W}])", r"\1 \2zqdot\3 \4")
    for _ in range(2):
        out = rep(out, f"(^|[^{W}])power[{S}]*(bi|query)($|[^{W}])", r"\1 power_\2 \3")
    for pattern in (C.URL, C.TECH_EMAIL, C.TECH_PHONE, C.TECH_OTHER):
        out = rep(out, pattern, " ")
    for a, b in (("zqplus", "+"), ("zqhash", "#"), ("zqdot", "."), ("zqdash", "-")):
        out = f"replace({out}, '{a}', '{b}')"
    stop = [w for w in C.ENGLISH_STOP_WORDS if w not in C.STOP_WORD_EXCEPTIONS]
    return (f"array_to_string(list_filter({words(out)}, lambda x: NOT list_contains({listing(stop)}, x))"
            ", ' ')")


per_doc("clean_tech", clean=clean_tech(
    "'C++, C# (.NET/ASP.NET) node.js main.py Power' || chr(10) || 'BI PowerQuery scikit-learn; ' || text"))
per_doc("first_line", line=LINE)
per_page("quoted_items", items="array_to_string(list_concat("
         f"regexp_extract_all(html, {s("'([^']{2,80})'")}, 1), "
         f"""regexp_extract_all(html, {s('"([^"]{2,80})"')}, 1)), '|')""")


def truncate(text: str, phrases) -> str:
    at = ", ".join(f"nullif(instr(lower({text}), {s(p.lower())}), 0)" for p in phrases)
    body = f"left({text}, CAST(coalesce(least({at}) - 1, length({text})) AS BIGINT))"
    return strip(rep(body, rf"[\[\]'{S}]+$", ""))


per_doc("truncate_at_phrase", body=truncate("text", Q.PHRASES))
oracle("combined_text", "SELECT page_id, " + strip(
    "body || ' ' || array_to_string(list_concat("
    f"regexp_extract_all(body, {s("'([^']{2,80})'")}, 1), "
    f"""regexp_extract_all(body, {s('"([^"]{2,80})"')}, 1)), ' ')""")
    + " AS combined FROM (SELECT page_id, " + truncate("html", ["</main>", "<footer"])
    + " AS body FROM pages)")


def tail(text: str) -> str:
    after = strip(f"split_part({text}, ']', -1)")
    return (f"CASE WHEN contains({text}, ']') THEN left({strip(f"split_part({after}, '[', 1)")}, "
            "300) ELSE '' END")


per_doc("tail_block", last=tail("('[a] ' || text || ' [b]')"), none=tail("text"),
        block=tail("('[a]' || text)"),
        line=f"left({strip(f"split_part({tail("('[a]' || text)")}, chr(10), 1)")}, 80)")
per_doc("keyword_flags", first="contains(lower(text), 'tion') OR contains(lower(text), 'und ')",
        education=" OR ".join(f"contains(lower(text), {s(w)})" for w in C.EDUCATION_WORDS))
oracle("ngrams", f"""
SELECT term, count(*) AS n FROM (
 SELECT unnest(t) AS term FROM tok UNION ALL
 SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tok)
GROUP BY term""", f"tok AS (SELECT {tokens('text')} AS t FROM documents)")
per_doc("strip_accents", out="strip_accents(text)")
per_doc("strip_accents_unicode", out="'salek caj fin ' || strip_accents(text)")
per_doc("stopwords", out=f"array_to_string(list_filter({words('lower(text)')}, "
        f"lambda x: NOT list_contains({listing(Q.STOP_WORDS)}, x)), ' ')")

# -- leakage ---------------------------------------------------------------------------------
_HITS = """SELECT p.phrase, count(d.doc_id) AS rows,
 round(count(d.doc_id) * 100.0 / (SELECT count(*) FROM docs), 1) AS percent,
 count(d.doc_id) > 50 AS leak
FROM {p} p LEFT JOIN docs d ON contains(lower(d.text), lower(p.phrase)) GROUP BY p.phrase"""
oracle("phrase_hits", _HITS.format(p="phrases"), LANG, PHRASES)
oracle("passage_hits", _HITS.format(p="(SELECT DISTINCT text AS phrase FROM benchmark)"), LANG)
oracle("phrase_rows", """
SELECT count(*) AS pairs, count(DISTINCT doc_id) AS rows_with_phrase
FROM docs JOIN phrases ON contains(lower(text), lower(phrase))""", LANG, PHRASES)
_CLEANED = [f"cdocs AS (SELECT doc_id, label, {clean('text')} AS c FROM docs)",
            f"cp AS (SELECT DISTINCT {clean('phrase')} AS phrase FROM phrases)",
            "hit AS (SELECT phrase, doc_id, label FROM cdocs JOIN cp ON contains(c, phrase))"]
oracle("phrase_survivors", "SELECT phrase, count(*) AS rows FROM hit GROUP BY 1",
       LANG, PHRASES, *_CLEANED)
oracle("phrase_uniformity", """
SELECT phrase, CAST(sum(n) AS BIGINT) AS rows, count(*) AS classes,
 round(stddev_samp(n), 6) AS std, coalesce(stddev_samp(n) < 2.0, false) AS uniform
FROM (SELECT phrase, label, count(*) AS n FROM hit GROUP BY 1, 2) GROUP BY 1""",
       SOURCE, PHRASES, *_CLEANED)
oracle("label_marker", rf"""
SELECT doc_id, ends_with(lower(b), label) AND regexp_matches(left(b, length(b) - length(label)),
 '(?:^|\n)[{S}]*(?:category|job[{S}]+category|target[{S}]+role|classification)[{S}]*[:=-][{S}]*$',
 'i') AS flag FROM (SELECT doc_id, label, {rep("t", f"[{S}]+$", "")} AS b FROM (
  SELECT doc_id, label, CASE WHEN label = 'fr' THEN text || chr(10) || 'Target Role: FR  '
  ELSE text || ' category: ' || label END AS t FROM docs))""", LANG)
_DE = "CASE WHEN label = 'de' THEN text || ' (DE)' ELSE text END"
oracle("label_suffix", f"SELECT doc_id, {suffix('t', 'label')} AS flag FROM "
       f"(SELECT doc_id, label, {_DE} AS t FROM docs)", LANG)
oracle("label_suffix_report", """
SELECT CAST(0 AS BIGINT) AS marker_rows, count(*) FILTER (flag) AS suffix_rows,
 (SELECT string_agg(doc_id, '|' ORDER BY doc_id) FROM
  (SELECT doc_id FROM f WHERE flag ORDER BY doc_id LIMIT 10)) AS examples FROM f""",
       LANG, f"f AS (SELECT doc_id, {suffix('t', 'label')} AS flag FROM "
       f"(SELECT doc_id, label, {_DE} AS t FROM docs))")
oracle("label_verbatim", "SELECT 'verbatim' AS \"check\", count(*) FILTER (contains(lower(text), "
       "lower(label))) AS rows, round(count(*) FILTER (contains(lower(text), lower(label))) "
       "* 100.0 / count(*), 1) AS percent FROM docs", LANG)
oracle("label_words", f"""
SELECT doc_id, (SELECT bool_and(contains(lower(text), w)) FROM (SELECT unnest(string_split(
 {case('label', Q.ROLE_NAMES)}, ' ')) AS w) WHERE length(w) > 3) AS all_words,
 false AS none_false, true AS none_true FROM docs""", LANG)
oracle("label_position", """
SELECT doc_id, CAST(a AS INTEGER) AS "at", CAST(round_even(a * 100.0 / length(text), 0) AS INTEGER)
 AS percent, replace(substring(text, greatest(a - 50, 0) + 1,
  least(length(text), a + length(label) + 50) - greatest(a - 50, 0)), chr(10), ' ') AS context
FROM (SELECT *, instr(lower(text), lower(label)) - 1 AS a FROM docs) WHERE a >= 0""", LANG)
oracle("label_tail", "SELECT doc_id, contains(substring(lower(text), "
       "CAST(floor(length(text) * 0.9) AS BIGINT) + 1), label) AS flag FROM docs", LANG)
oracle("template_markers", "SELECT doc_id, regexp_matches(lower(CASE WHEN length(text) % 2 = 0 THEN "
       "text || ' Target role : x' ELSE text END), " + s("|".join(C.TEMPLATE_MARKERS))
       + ") AS flag FROM docs", LANG)
oracle("boilerplate", """
SELECT d.label, CAST(w.no AS INTEGER) AS "window", left(w.block, 50) AS block,
 count(*) FILTER (contains(lower(d.text), lower(w.block))) AS rows,
 round(avg(CASE WHEN contains(lower(d.text), lower(w.block)) THEN 1 ELSE 0 END), 6) AS share,
 round(avg(CASE WHEN contains(lower(d.text), lower(w.block)) THEN 1 ELSE 0 END), 6) > 0.7
  AS suspicious
FROM head d JOIN w USING (label) GROUP BY d.label, w.no, w.block""", LANG,
       "head AS (SELECT doc_id, label, CASE WHEN label IN ('fr', 'de') THEN label || "
       "' company profile, equal opportunity, all rights ' || "
       "'reserved by the owner of this page. ' || text ELSE text END AS text FROM docs)",
       "w AS (SELECT label, no, substring(text, no * 60 + 1, 60) AS block FROM (SELECT label, "
       "left(arg_min(text, doc_id), 300) AS text FROM head GROUP BY label HAVING count(*) >= 5), "
       "(VALUES (0), (1), (2)) n(no) WHERE length(substring(text, no * 60 + 1, 60)) = 60)")
oracle("boilerplate_windows", """
SELECT label, block, rows, round(rows / total, 6) AS share FROM (
 SELECT label, block, count(*) AS rows FROM (
  SELECT DISTINCT doc_id, label, substring(text, i, 60) AS block
  FROM head, LATERAL (SELECT unnest(range(1, length(text) - 58)) AS i)) GROUP BY 1, 2)
JOIN (SELECT label, count(*) AS total FROM head GROUP BY 1) USING (label)
WHERE total >= 5 AND rows > 0.7 * total""", LANG,
       "head AS (SELECT doc_id, label, lower(CASE WHEN label IN ('fr', 'de') THEN left(text, length(text) % 97) || "
       "label || ' company profile, equal opportunity, all rights ' || 'reserved by the owner of this page. ' || "
       "substring(text, length(text) % 97 + 1) ELSE text END) AS text FROM docs)")
_VERDICT = """
SELECT verbatim, markers, repeats, conflicts, points,
 CASE WHEN points = 0 THEN 'pass' WHEN points <= 2 THEN 'minor' ELSE 'fail' END AS verdict
FROM (SELECT *, CAST(CASE WHEN verbatim > n * 0.3 THEN 3 WHEN verbatim > n * 0.05 THEN 1 ELSE 0 END
 + CASE WHEN markers > 0 THEN 2 ELSE 0 END + CASE WHEN repeats > n * 0.1 THEN 1 ELSE 0 END
 + CASE WHEN conflicts > 0 THEN 2 ELSE 0 END AS INTEGER) AS points FROM (
 SELECT (SELECT count(*) FROM docs) AS n,
 (SELECT count(*) FROM docs WHERE contains(lower(text), lower(label))) AS verbatim,
 (SELECT count(*) FROM docs WHERE regexp_matches(lower(text), {m})) AS markers,
 CAST((SELECT coalesce(sum(n), 0) FROM t WHERE n > 1) AS BIGINT) AS repeats,
 (SELECT count(*) FROM t WHERE l > 1) AS conflicts))"""
oracle("leak_verdict", _VERDICT.format(m=s("|".join(C.TEMPLATE_MARKERS))), SOURCE,
       "t AS (SELECT text, count(*) AS n, count(DISTINCT label) AS l FROM docs GROUP BY text)")
oracle("leak_hypotheses", f"""
SELECT 'texts shared between splits' AS hypothesis,
 CASE WHEN o.n > 0 THEN 'HIGH' ELSE 'LOW' END AS severity, o.n AS evidence
FROM (SELECT count(*) AS n FROM (SELECT DISTINCT a.split, b.split, a.k
 FROM (SELECT split, {key('text')} AS k FROM parts) a
 JOIN (SELECT split, {key('text')} AS k FROM parts) b ON a.k = b.k AND a.split < b.split)) o
UNION ALL SELECT 'label phrase survives cleaning', CASE WHEN n > 1000 THEN 'HIGH' WHEN n > 100 THEN
 'MEDIUM' ELSE 'LOW-MEDIUM' END, n FROM (SELECT count(*) AS n FROM hit)
UNION ALL SELECT 'label phrase in text', CASE WHEN n > (SELECT count(*) FROM docs) * 0.5 THEN 'HIGH'
 ELSE 'MEDIUM' END, n FROM (SELECT count(DISTINCT doc_id) AS n FROM docs
 JOIN phrases ON contains(lower(text), lower(phrase)))""",
       *split_ctes(LANG), PHRASES, *_CLEANED)

# -- features ----------------------------------------------------------------------------------


def terms_cte(name: str, text: str, source: str, bigrams: bool, accents: bool = True) -> str:
    t = tokens(f"strip_accents({text})" if accents else text)
    grams = ("list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"
             if bigrams else "t")
    return (f"{name} AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, "
            f"unnest({grams}) AS term FROM (SELECT doc_id, {t} AS t FROM {source})) GROUP BY 1, 2)")


def vocab_cte(name: str, terms: str, docs: str, size: int, min_df: int = 1,
              max_df: float = 1.0) -> str:
    n = f"(SELECT count(*) FROM {docs})"
    return (f"{name} AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, "
            f"ln(({n} + 1.0) / (count(*) + 1)) + 1 AS idf FROM {terms} GROUP BY term "
            f"HAVING count(*) >= {min_df} AND count(*) <= {max_df} * {n} "
            f"ORDER BY cf DESC, term LIMIT {size})")


oracle("vocab", "SELECT term, df, cf, round(idf, 6) AS idf FROM v",
       terms_cte("t", "text", "documents", True), vocab_cte("v", "t", "documents", 2000, 2, 0.85))
_WEIGHTS = """SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
FROM (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM {t} JOIN v USING (term))"""
oracle("tfidf", _WEIGHTS.format(t="t"), terms_cte("t", "text", "documents", False),
       vocab_cte("v", "t", "documents", 500, 2, 0.95))
oracle("tfidf_transform", _WEIGHTS.format(t="tt"), *split_ctes(LANG),
       "train AS (SELECT * FROM parts WHERE split = 'train')",
       "test AS (SELECT * FROM parts WHERE split = 'test')",
       terms_cte("t", "text", "train", False), terms_cte("tt", "text", "test", False),
       vocab_cte("v", "t", "train", 500, 2, 0.95))
oracle("nb_params", """
SELECT label, term, round(ln((n + 1.0) / (sum(n) OVER (PARTITION BY label) +
 (SELECT count(*) FROM v))), 6) AS value
FROM (SELECT c.label, v.term, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT label FROM docs) c CROSS JOIN v
 LEFT JOIN (SELECT label, term, sum(tf) AS n FROM t JOIN docs USING (doc_id) GROUP BY 1, 2) s
 ON s.label = c.label AND s.term = v.term)
UNION ALL SELECT label, '(prior)', round(ln(count(*) / (SELECT count(*) FROM docs)), 6)
FROM docs GROUP BY label""", LANG, terms_cte("t", "text", "docs", False),
       vocab_cte("v", "t", "docs", 500, 2, 0.95))
def _near(size: int) -> list[str]:
    return [f"cdocs AS (SELECT doc_id, {clean('text')} AS c FROM documents)",
            terms_cte("t", "c", "cdocs", False, accents=False), vocab_cte("v", "t", "cdocs", size),
            "w AS (SELECT doc_id, term, tf, tf * idf AS w FROM t JOIN v USING (term))",
            "sig AS (SELECT doc_id, string_agg(term || ':' || tf, ',' ORDER BY term) AS sig, "
            "sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)",
            "cop AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS rep_id, "
            "count(*) OVER (PARTITION BY sig) AS copies, norm FROM sig)",
            "allcop AS (SELECT doc_id, rep_id, copies FROM cop UNION ALL SELECT doc_id, doc_id, 1 "
            "FROM cdocs WHERE doc_id NOT IN (SELECT doc_id FROM w))",
            "rep AS (SELECT * FROM cop WHERE doc_id = rep_id)",
            "u AS (SELECT doc_id, term, copies, w / norm AS w FROM w JOIN rep USING (doc_id))",
            "near AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, a.copies AS copies_a, "
            "b.copies AS copies_b, round(sum(a.w * b.w), 6) AS cosine FROM u a JOIN u b "
            "ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4 "
            "HAVING round(sum(a.w * b.w), 6) >= 0.95)"]


#: More terms than any corpus has: the whole vocabulary.
_NEAR = _near(10**15)
oracle("near_dups", "SELECT * FROM near", *_NEAR)
oracle("near_dups_capped", "SELECT * FROM near", *_near(C.NEAR_DUP_FEATURES))
oracle("near_dup_copies", "SELECT doc_id, rep_id, copies FROM allcop", *_NEAR[:-3])
oracle("near_dup_summary", """
SELECT CAST((SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM cop GROUP BY rep_id))
 AS BIGINT) AS equal_pairs,
 CAST((SELECT coalesce(sum(copies_a * copies_b), 0) FROM near) AS BIGINT) AS near_pairs""", *_NEAR)

# -- evaluation -----------------------------------------------------------------------------
_SCORES = ", ".join(f"CAST(len(list_filter(t, lambda x: list_contains({listing(ws)}, x))) AS INTEGER) "
                    f"AS s_{lang}" for lang, ws in Q.LANGUAGE_WORDS.items())
SCORED = (f"scored AS (SELECT doc_id, text, label, {_SCORES} FROM "
          f"(SELECT *, {tokens('text')} AS t FROM docs))")
LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT doc_id, text, label, '{lang}' AS name, s_{lang} AS score FROM scored"
    for lang in Q.LANGUAGE_WORDS) + ")"
RANKED = ("ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) "
          "AS r FROM long)")
PRED = "pred AS (SELECT doc_id, text, label, name AS prediction FROM ranked WHERE r = 1)"
PREDICTED = [LANG, SCORED, LONG, RANKED, PRED]
CLASSES = "classes AS (SELECT label FROM pred UNION SELECT prediction FROM pred)"
REPORT = """report AS (SELECT label, CASE WHEN p > 0 THEN h / p ELSE 0.0 END AS precision,
 CASE WHEN t > 0 THEN h / t ELSE 0.0 END AS recall,
 CASE WHEN p + t > 0 THEN 2.0 * h / (p + t) ELSE 0.0 END AS f1, t AS support, h FROM (
 SELECT c.label, (SELECT count(*) FROM pred WHERE label = c.label) AS t,
 (SELECT count(*) FROM pred WHERE prediction = c.label) AS p,
 (SELECT count(*) FROM pred WHERE label = c.label AND prediction = c.label) AS h FROM classes c))"""
oracle("class_report", "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, "
       "round(f1, 6) AS f1, support FROM report", *PREDICTED, CLASSES, REPORT)
oracle("metrics", """
SELECT round(sum(h) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision,
 round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
 round(sum(precision * support) / sum(support), 6) AS weighted_precision,
 round(sum(recall * support) / sum(support), 6) AS weighted_recall,
 round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(min(f1), 6) AS minority_f1
FROM report""", *PREDICTED, CLASSES, REPORT)
oracle("confusion", "SELECT a.label, b.label AS prediction, (SELECT count(*) FROM pred p WHERE "
       "p.label = a.label AND p.prediction = b.label) AS rows FROM classes a, classes b",
       *PREDICTED, CLASSES)
oracle("topk_accuracy", "SELECT count(DISTINCT doc_id) AS rows, count(*) FILTER (r <= 2 AND "
       "name = label) AS hits, round(count(*) FILTER (r <= 2 AND name = label) / "
       "count(DISTINCT doc_id), 6) AS accuracy FROM ranked", *PREDICTED)
_SNIP = "CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END"
oracle("misclassified", f"SELECT doc_id, label, prediction, {_SNIP} AS snippet FROM pred "
       "WHERE label <> prediction", *PREDICTED)
oracle("error_words", f"SELECT doc_id, array_to_string(list_filter({listing(Q.WATCH_WORDS)}, "
       "lambda w: contains(lower(text), w)), '|') AS words FROM pred WHERE label <> prediction",
       *PREDICTED)
oracle("error_pairs", "SELECT label, prediction, count(*) AS rows FROM pred WHERE label <> prediction "
       "GROUP BY 1, 2 ORDER BY rows DESC, label, prediction LIMIT 10", *PREDICTED)

# -- skills and screening ------------------------------------------------------------------


def re_escape(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|#&~-" else c for c in text)


def skill_regex(skill: str) -> str:
    first, last = skill[0], skill[-1]
    before = f"(^|[^{W}])" if first.isalnum() or first == "_" else f"(^|[{S}])"
    open_end = last.isalnum() or last == "_" or skill in ("c++", "c#")
    return before + re_escape(skill) + (f"($|[^{W}])" if open_end else f"($|[{S}])")


_VOCAB = Q.vocabulary_words()
_FOUND = ("list_sort(list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(lower(text), {s(skill_regex(k))}) THEN {s(v)} END"
    for k, v in _VOCAB.items()) + "], lambda x: x IS NOT NULL))")
_REQUIRED = "CASE label " + " ".join(
    f"WHEN {s(role)} THEN {listing(skills)}" for role, skills in Q.REQUIREMENTS.items()) + " ELSE [] END"
FOUND = f"found AS (SELECT *, {_FOUND} AS skills, {_REQUIRED} AS required FROM scored)"
MISSING = ("miss AS (SELECT *, list_filter(required, lambda r: NOT list_contains("
           "list_transform(skills, lambda x: lower(x)), lower(r))) AS missing FROM found)")
oracle("skills", "SELECT doc_id, array_to_string(skills, '|') AS skills FROM found",
       LANG, SCORED, FOUND)


def _word_pairs(name: str, row: str, source: str) -> list[str]:
    """CTEs up to ``name`` (row, skill): the words and the pairs of words with one space between them."""
    return [f"{name}_p AS (SELECT {row}, row_number() OVER () AS piece, string_split(x, ' ') AS w FROM (SELECT {row}, "
            f"unnest(string_split_regex(lower(coalesce(text, '')), {s(f'[^{W} ]+| {{2,}}')})) AS x FROM {source}))",
            f"{name}_w AS (SELECT {row}, piece, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM {name}_p)",
            f"{name}_n AS (SELECT {row}, w, lead(w) OVER (PARTITION BY piece ORDER BY i) AS nxt FROM {name}_w)",
            f"{name} AS (SELECT DISTINCT {row}, skill FROM (SELECT {row}, w AS skill FROM {name}_n WHERE w <> '' UNION ALL "
            f"SELECT {row}, w || ' ' || nxt FROM {name}_n WHERE w <> '' AND nxt <> ''))"]


oracle("skill_table", "SELECT skill, count(*) AS docs FROM said WHERE skill IN (SELECT skill FROM wanted) GROUP BY skill",
       *_word_pairs("wanted", "item_id", "benchmark"), *_word_pairs("said", "doc_id", "documents"))
oracle("missing_skills", "SELECT doc_id, array_to_string(missing, '|') AS missing FROM miss",
       LANG, SCORED, FOUND, MISSING)


def alias_sql(skill: str, patterns) -> str:
    body = "|".join(patterns)
    hits = (f"regexp_extract_all(regexp_replace(text, {s(f'([^{W}])')}, {s(r'\1\1')}, 'g'), "
            f"{s(f'(?i)(?:^|[^{W}])({body})(?:$|[^{W}])')}, 1)")
    return f"SELECT doc_id, {s(skill)} AS skill, {hits} AS h FROM docs"


# Every separator is doubled so that neighbouring matches do not compete for it.
oracle("skill_matches", """
SELECT doc_id, skill, array_to_string(list_filter(h, lambda x, i: list_position(
 list_transform(h, lambda y: lower(y)), lower(x)) = i), '|') AS matches
FROM hits WHERE len(h) > 0""", LANG,
       "hits AS (SELECT doc_id, skill, list_transform(h, lambda x: replace(x, '  ', ' ')) AS h FROM (" + " UNION ALL ".join(
           alias_sql(k, [p.replace(" ", "  ") for p in v]) for k, v in Q.ALIASES.items()) + "))")
_ANY = lambda ws: "(" + " OR ".join(f"contains(lower(text), {s(w)})" for w in ws) + ")"
COMPONENTS = f"""comp AS (SELECT *,
 CASE WHEN coalesce(conf, 0) = 0 THEN 0.5e0 ELSE least(1.0e0, conf * 3.5e0) END AS c_role,
 CASE WHEN len(required) > 0 THEN 1.0e0 - len(missing) / len(required) ELSE 0.5e0 END AS c_skill,
 CASE WHEN {_ANY(C.EXPERIENCE_WORDS)} THEN 0.8e0 ELSE 0.4e0 END AS c_exp,
 CASE WHEN {_ANY(C.EDUCATION_WORDS)} THEN 0.9e0 ELSE 0.3e0 END AS c_edu
 FROM (SELECT *, greatest(s_de, s_en, s_es, s_fr) /
  nullif(s_de + s_en + s_es + s_fr, 0) / 3 AS conf FROM miss))"""
_PCT = "CAST(round_even(({}) * 100, 0) AS INTEGER)"
SCREENED = ("screened AS (SELECT *, " + ", ".join(
    f"{_PCT.format(e)} AS {n}" for n, e in
    (("role_match", "c_role"), ("skills_match", "c_skill"), ("experience_match", "c_exp"),
     ("education_match", "c_edu"),
     ("final", "c_role * 0.4e0 + c_skill * 0.4e0 + c_exp * 0.15e0 + c_edu * 0.05e0")))
    + " FROM comp)")
oracle("screening_score", "SELECT doc_id, role_match, skills_match, experience_match, "
       "education_match, final FROM screened", LANG, SCORED, FOUND, MISSING, COMPONENTS, SCREENED)
_CAT = {"en": "data", "fr": "hr", "de": "software", "es": "generic"}
_ENTRIES = "entries AS (" + " UNION ALL ".join(
    f"SELECT {s(c)} AS category, {s(n)} AS entry_name, {listing(f)} AS focus"
    for c, rows in Q.CATALOGUE.items() for n, f in rows) + ")"
oracle("catalogue_match", """
SELECT doc_id, entry_name, array_to_string(m, '|') AS matches, array_to_string(CASE
 WHEN len(r1) < 3 AND experience_match > 0 THEN list_append(r1, CASE WHEN experience_match >= 50
  THEN 'Relevant experience signal' ELSE 'Experience considered' END) ELSE r1 END, '|') AS reasons,
 CAST(least(94, 70 + floor(role_match * 0.08e0 + 0.5) + least(len(m), 4) * 2 +
  CASE WHEN experience_match >= 50 THEN 3 ELSE 0 END +
  CASE WHEN education_match >= 50 THEN 2 ELSE 0 END) AS INTEGER) AS score
FROM (SELECT *, CASE WHEN len(m) < 2 AND len(list_filter(m, lambda x: contains(lower(role), lower(x))
  OR contains(lower(x), lower(role)))) = 0 THEN list_append(m[1:3], role || ' alignment')
  ELSE m[1:3] END AS r1
 FROM (SELECT *, CASE WHEN len(l) < 2 THEN list_concat(l, list_filter(focus, lambda f:
   contains(lower(text), lower(f)) AND NOT list_contains(list_transform(l, lambda x: lower(x)), lower(f)))
   )[1:3] ELSE l END AS m
  FROM (SELECT *, list_filter(list_transform(focus, lambda f: list_filter(skills, lambda x:
     lower(x) = lower(f))[-1]), lambda x: x IS NOT NULL) AS l
   FROM (SELECT *, """ + case("label", Q.ROLE_TITLES) + " AS role, "
       + case("label", _CAT) + """ AS category FROM screened) JOIN entries USING (category))))""",
       LANG, SCORED, FOUND, MISSING, COMPONENTS, SCREENED, _ENTRIES)

# -- streams: the batch result over the same table -------------------------------------------
oracle("stream_screening", "SELECT doc_id, final, array_to_string(missing, '|') AS missing "
       "FROM screened", LANG, SCORED, FOUND, MISSING, COMPONENTS, SCREENED)
oracle("stream_repeats", "SELECT DISTINCT user_id, event_type FROM events")
