"""Text functions.  Every function maps Columns to a Column; nulls stay null."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docscreen import constants as C


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# -- whitespace ------------------------------------------------------------

def strip(text: Column) -> Column:
    return F.trim(text, F.lit(C.SPACE_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(C.SPACE_CHARS))


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"[{C.SPACE}]+", " "))


def is_blank(text: Column) -> Column:
    """Null or nothing but white space."""
    return text.isNull() | (strip(text) == "")


# -- cleaning chain (T1) -----------------------------------------------------

def drop_urls(text: Column) -> Column:
    return F.regexp_replace(text, f"(?i){C.URL}", " ")


def drop_tags(text: Column) -> Column:
    return F.regexp_replace(text, C.HTML_TAG, " ")


def drop_emails(text: Column) -> Column:
    """The pattern walks through every word once from each of its letters, so only where an ``@`` is."""
    return let(text, lambda t: F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, C.EMAIL, " ")).otherwise(t))


def drop_phones(text: Column) -> Column:
    """Also removes year ranges and plain 6-8 digit numbers, by definition of the pattern."""
    return F.regexp_replace(text, C.PHONE, " ")


def drop_addresses(text: Column) -> Column:
    return F.regexp_replace(text, C.ADDRESS, " ")


def drop_special(text: Column) -> Column:
    return F.regexp_replace(text, C.SPECIAL_CHARS, " ")


CLEANING_STEPS = (F.lower, drop_urls, drop_tags, drop_emails, drop_phones, drop_addresses,
                  drop_special, collapse_spaces)


def clean_text(text: Column) -> Column:
    return reduce(lambda column, step: step(column), CLEANING_STEPS, text)


# -- deduplication key (T2) --------------------------------------------------

def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def dedup_key(text: Column, full_unicode: bool = True) -> Column:
    """Case-folded NFKC text with every run of non-word characters as one space.

    Compatibility forms and full case folding come from one vectorised UDF that only receives the
    rows which need it.  ``full_unicode=False`` leaves it out: the key is then a pure JVM
    expression, and wrong for decomposed letters, ligatures and full-width forms.
    """
    if full_unicode:
        from docscreen.functions.unicode import nfkc_casefold

        folded = nfkc_casefold(text)
    else:
        folded = casefold(text)
    return F.trim(F.regexp_replace(folded, f"[^{C.WORD}]+", " "))


def key_hash(text: Column) -> Column:
    """16-byte stand-in for a long text in shuffles and groupings."""
    return F.unhex(F.md5(text))


# -- technical-token cleaner (T3) --------------------------------------------

_NOT_IN_WORD = (rf"(?<![{C.WORD}])", rf"(?![{C.WORD}])")
# Letter-only stand-ins for the punctuation inside a technical token; digits, capitals and
# punctuation would not survive the following steps.
_STAND_INS = (("zqplus", "+"), ("zqhash", "#"), ("zqdot", "."), ("zqdash", "-"))
_PROTECT = (
    (r"c\+\+", " czqpluszqplus "),
    (r"c#", " czqhash "),
    (r"asp\.net", " aspzqdotnet "),
    (r"\.net", " zqdotnet "),
    (r"([a-z0-9]+)\.(js|py|go|rb|ts)", " $1zqdot$2 "),
    (r"scikit-learn", " scikitzqdashlearn "),
    (rf"power[{C.SPACE}]*(bi|query)", " power_$1 "),
)


def clean_technical(text: Column, stop_words=None) -> Column:
    """Lower-case word list that keeps ``c++ c# .net node.js scikit-learn power_bi``."""
    if stop_words is None:
        stop_words = [w for w in C.ENGLISH_STOP_WORDS if w not in C.STOP_WORD_EXCEPTIONS]
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, stand_in in _PROTECT:
        out = F.regexp_replace(out, _NOT_IN_WORD[0] + pattern + _NOT_IN_WORD[1], stand_in)
    for pattern in (C.URL, C.TECH_EMAIL, C.TECH_PHONE, C.TECH_OTHER):
        out = F.regexp_replace(out, pattern, " ")
    for stand_in, symbol in _STAND_INS:
        out = F.replace(out, F.lit(stand_in), F.lit(symbol))
    return remove_stop_words(out, stop_words)


def remove_stop_words(text: Column, stop_words) -> Column:
    """White-space tokens that are not in ``stop_words``, joined by one space."""
    stop_words = list(stop_words)
    return F.array_join(F.filter(words(text), lambda w: ~w.isin(stop_words)), " ")


# -- tokens and n-grams (T10, T13) -------------------------------------------

def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{C.SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return let(strip(F.coalesce(text, F.lit(""))), lambda t: F.when(t == "", F.lit(0)).otherwise(
        F.size(F.split(t, f"[{C.SPACE}]+"))))


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{C.WORD}]{{2,}}"), F.lit(0))


def ngrams(token_array: Column, low: int = 1, high: int = 2) -> Column:
    """All word n-grams with ``low <= n <= high``."""

    def of_size(items: Column, n: int) -> Column:
        if n == 1:
            return items
        starts = F.when(F.size(items) >= n, F.sequence(F.lit(0), F.size(items) - n)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(
            " ", *[F.get(items, i + k) for k in range(n)]))

    return let(token_array, lambda items: F.concat(*[of_size(items, n)
                                                     for n in range(low, high + 1)]))


def term_counts(terms: Column) -> Column:
    """``array<struct<term, tf>>`` of one row's terms, without a shuffle.

    The terms are sorted and cut at the places where the value changes.
    """

    def count(sorted_terms: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(sorted_terms) - 1),
            lambda i: (i == 0) | (F.get(sorted_terms, i) != F.get(sorted_terms, i - 1)))
        counted = let(starts, lambda s: F.transform(s, lambda start, j: F.struct(
            F.get(sorted_terms, start).alias("term"),
            (F.coalesce(F.get(s, j + 1), F.size(sorted_terms)) - start).alias("tf"))))
        empty = F.array().cast("array<struct<term:string,tf:int>>")
        return F.when(F.size(sorted_terms) > 0, counted).otherwise(empty)

    # sort_array is native code; array_sort would interpret a comparison for every pair.
    return let(F.sort_array(terms), count)


# -- accents (T11) -----------------------------------------------------------

# Diacritical marks that combine with the letter before them.
MARKS = "\\u0300-\\u036F\\u1AB0-\\u1AFF\\u1DC0-\\u1DFF\\u20D0-\\u20FF\\uFE20-\\uFE2F"


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Characters whose compatibility decomposition without marks is one other character, and it."""
    pairs = []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x10000)):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != char and not unicodedata.combining(char):
            pairs.append((char, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(text: Column, full_unicode: bool = True) -> Column:
    """Text without combining marks (NFKD); rows beyond Latin-1 letters go through one UDF."""
    if full_unicode:
        from docscreen.functions.unicode import nfkd_without_marks

        return nfkd_without_marks(text)
    return translate_accents(text)


def translate_accents(text: Column) -> Column:
    """Every character that becomes one other character, and combining marks, in the JVM.

    What is left to the UDF of ``strip_accents`` are characters that become several (ligatures,
    fractions, Hangul syllables).
    """
    accented, plain = accent_table()
    # Most texts have nothing to translate, and the test is far cheaper than the translation.
    return let(text, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(
        t, accented, plain), f"[{MARKS}]+", "")).otherwise(t))


# -- structure inside a text (T4-T8) -----------------------------------------

def first_line(text: Column) -> Column:
    return F.lower(strip(F.split_part(text, F.lit("\n"), F.lit(1))))


def quoted_items(text: Column) -> Column:
    """Items of 2-80 characters in single quotes, then those in double quotes."""
    found = [F.regexp_extract_all(text, F.lit(f"{q}([^{q}]{{2,80}}){q}"), F.lit(1))
             for q in ("'", '"')]
    return F.concat(*found)


def truncate_at_phrase(text: Column, phrases) -> Column:
    """Text before the earliest of ``phrases`` without trailing list punctuation."""
    lowered = F.lower(text)
    cut = F.lit(None).cast("int")
    positions = [F.nullif(F.instr(lowered, phrase.lower()), F.lit(0)) for phrase in phrases]
    if len(positions) > 1:
        cut = F.least(*positions)
    elif positions:
        cut = positions[0]
    head = F.when(cut.isNull(), text).otherwise(F.left(text, cut - 1))
    return strip(F.regexp_replace(head, rf"[\[\]'{C.SPACE}]+$", ""))


def body_with_items(text: Column, phrases) -> Column:
    """Truncated body followed by the quoted items of that body."""
    return let(truncate_at_phrase(text, phrases), lambda body: strip(
        F.concat(body, F.lit(" "), F.array_join(quoted_items(body), " "))))


def tail_block(text: Column, max_chars: int = 300) -> Column:
    """What stands between the last ``]`` and the next ``[``; empty without a ``]``."""
    after = strip(F.substring_index(text, "]", -1))
    block = F.left(strip(F.substring_index(after, "[", 1)), F.lit(max_chars))
    return F.when(F.contains(text, F.lit("]")), block).otherwise(
        F.when(text.isNotNull(), F.lit("")))


def tail_block_line(text: Column, max_chars: int = 80) -> Column:
    return F.left(strip(F.split_part(tail_block(text), F.lit("\n"), F.lit(1))), F.lit(max_chars))


# -- containment (P12, P13, T9) ----------------------------------------------

def contains_ci(text: Column, phrase: Column) -> Column:
    """Literal containment ignoring case; null text or phrase gives false."""
    return F.coalesce(F.contains(F.lower(text), F.lower(phrase)), F.lit(False))


def any_word(lowered: Column, word_list) -> Column:
    return reduce(lambda a, b: a | b,
                  [F.contains(lowered, F.lit(w)) for w in word_list])


def snippet(text: Column, chars: int = C.SNIPPET_CHARS) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit("..."))
                  ).otherwise(text)


# -- numbers (T14) -----------------------------------------------------------

def percent(share: Column) -> Column:
    """Whole percent, ties to even."""
    return F.bround(share * 100, 0).cast("int")
