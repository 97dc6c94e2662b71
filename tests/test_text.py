import contextlib
import io
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docscreen.functions import text as X
from docscreen.functions import unicode as U
from docscreen.operators import schema

T = "text"


def col():
    return F.col(T)


@pytest.mark.parametrize("given_text, expected", [
    (None, None),
    ("See https://a.b/c or me@x.org now", "see or now"),
    ("<p>Hi</p>", "hi"),
    ("C++, C# & .NET!", "c++ c# & .net"),
    ("2019-2021 lead", "lead"),
    ("12 Old Mill Road, Leeds", "leeds"),
    ("call +1 (555) 123-4567 now", "call + now"),
    ("a b c", "a b c"),
    ("x 12345678 y 12 z", "x y 12 z"),
])
def test_clean_text(evaluate, given_text, expected):
    assert evaluate(X.clean_text(col()), text=given_text) == expected


@pytest.mark.parametrize("given_text", ["A--b,  C!", "a b c", " a  B\tc. "])
def test_dedup_key(evaluate, given_text):
    assert evaluate(X.dedup_key(col()), text=given_text) == "a b c"


@pytest.mark.parametrize("given_text", [
    "Straße ﬁn Ⅷ ２", "école", "Plain text", "ΑΣ", "İstanbul", "ǆ x²"])
def test_dedup_key_full_unicode(evaluate, given_text):
    folded = unicodedata.normalize("NFKC", given_text).casefold()
    expected = re.sub(r"\s+", " ", re.sub(r"[^\w]+", " ", folded)).strip()
    got = evaluate(X.dedup_key(col(), full_unicode=True), text=given_text)
    # Marks are word characters in neither engine.
    assert got == expected


def test_stable_letters():
    """What the fast path promises: NFKC is the identity and lower equals casefold."""
    ranges = re.findall(r"\\u([0-9A-F]{4})-\\u([0-9A-F]{4})", U.STABLE)
    codes = list(range(0x80))
    for low, high in ranges:
        codes += range(int(low, 16), int(high, 16) + 1)
    text = "".join(map(chr, codes))
    assert unicodedata.normalize("NFKC", text) == text
    for c in map(chr, codes):
        assert c.casefold() == c.lower().replace("ß", "ss")


def test_strip_accents(evaluate):
    assert evaluate(X.strip_accents(col()), text="Éçole naïve ß") == "Ecole naive ß"
    assert evaluate(X.strip_accents(col(), True), text="Ǻ ﬁ é") == "A fi e"


def test_clean_technical(evaluate):
    got = evaluate(X.clean_technical(col()), text=(
        "Experienced in C++, C#, and Java. Contact me at john@example.com or +1-800-555-0199. "
        ".NET Core and Node.js; Power BI and Scikit-learn"))
    words = got.split()
    for kept in ("c++", "c#", "java", ".net", "node.js", "power_bi", "scikit-learn", "at", "or"):
        assert kept in words or kept == "or"
    assert "john" not in got and "800" not in got and "and" not in words


@pytest.mark.parametrize("given_text, expected", [
    (" Data Platform Design \nx", "data platform design"), ("", ""), (None, None)])
def test_first_line(evaluate, given_text, expected):
    assert evaluate(X.first_line(col()), text=given_text) == expected


def test_quoted_items(evaluate):
    assert evaluate(X.quoted_items(col()), text="['ab', 'cde'] \"xy\"") == ["ab", "cde", "xy"]
    text = "['a', 'bcd', 'ef']"  # the one-letter item shifts the pairing, as the pattern scans
    assert evaluate(X.quoted_items(col()), text=text) == re.findall(r"'([^']{2,80})'", text)


def test_truncate_and_combine(evaluate):
    text = "Body ['SQL', 'ETL'] Data Platform Design\nrest 'no'"
    phrases = ["Data Platform Design", "Absent"]
    assert evaluate(X.truncate_at_phrase(col(), phrases), text=text) == "Body ['SQL', 'ETL"
    assert evaluate(X.truncate_at_phrase(col(), phrases), text="plain ] ") == "plain"
    body = evaluate(X.body_with_items(col(), phrases), text=text)
    assert body.startswith("Body") and "no" not in body.split()


def test_tail_block(evaluate):
    assert evaluate(X.tail_block(col()), text="a ['x'] first line\nmore") == "first line\nmore"
    assert evaluate(X.tail_block_line(col()), text="a ['x'] first line\nmore") == "first line"
    assert evaluate(X.tail_block(col()), text="no list") == ""


def test_tokens_and_ngrams(evaluate):
    assert evaluate(X.tokens(col()), text="A bc DÉ_f 12 x") == ["bc", "dé_f", "12"]
    assert evaluate(X.ngrams(X.tokens(col())), text="aa bb cc") == [
        "aa", "bb", "cc", "aa bb", "bb cc"]
    assert evaluate(X.ngrams(X.tokens(col())), text="") == []
    counted = evaluate(X.term_counts(X.tokens(col())), text="bb aa bb cc bb aa")
    assert [(r.term, r.tf) for r in counted] == [("aa", 2), ("bb", 3), ("cc", 1)]
    assert evaluate(X.term_counts(X.tokens(col())), text="") == []


def test_snippet_and_percent(spark, evaluate):
    assert evaluate(X.snippet(col(), 3), text="abcd") == "abc..."
    assert evaluate(X.snippet(col(), 4), text="abcd") == "abcd"
    shares = spark.createDataFrame([(0.625,), (0.635,), (0.005,)], "s double")
    assert [r.p for r in shares.select(X.percent(F.col("s")).alias("p")).collect()] == [
        round(62.5), round(63.5), 0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n.-<>@7+", max_size=30), min_size=1, max_size=20))
def test_clean_text_is_idempotent_in_shape(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        X.clean_text(col()).alias("c")).collect()
    for r in rows:
        assert r.c == r.c.strip() and "  " not in r.c and "\n" not in r.c


def test_characters_that_need_python(spark):
    """The quick tests find the characters that the plain classes find, every one of them."""
    codes = [c for c in range(1, 0x10FFFF, 1) if not 0xD800 <= c < 0xE000 and (c < 0x11000 or c % 997 == 0)]
    chars = spark.createDataFrame([(chr(c),) for c in codes], "text string")
    for quick, plain in ((U.UNSTABLE, f"[^{U.STABLE}]"), (U.BEYOND_LATIN, r"[^\x00-\x7FÀ-ÿ]")):
        needs = U._needs(col(), quick).isNotNull()
        assert chars.filter(needs != col().rlike(plain)).count() == 0
        assert quick.startswith(r"[^\x00-\x7F](")


@pytest.mark.parametrize("given_text, expected", [
    (None, 0), ("", 0), (" 　\n", 0), ("a", 1), ("  a b \n c ", 3), ("a\x85b", 2)])
def test_word_count(evaluate, given_text, expected):
    assert evaluate(X.word_count(col()), text=given_text) == expected


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_filters_do_not_clean_again(spark):
    """A filter on cleaned texts and what is selected above it share one pass of the cleaning chain."""
    docs = spark.createDataFrame([(1, "One two, three"), (2, None), (3, "one")], "doc_id int, text string")
    cleaned = docs.withColumn("clean", X.clean_text(col()))
    for kept in (schema.min_tokens(cleaned, "clean", 3), schema.min_chars(cleaned, "clean", 5)):
        assert kept.columns == cleaned.columns
        assert [tuple(r) for r in kept.collect()] == [(1, "One two, three", "one two three")]
        assert _plan(kept.select("doc_id", F.length("clean"))).count("https?") == 1
