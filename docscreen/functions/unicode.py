"""The two vectorised UDFs: compatibility normalisation has no built-in expression.

Rows whose letters are already in normal form never leave the JVM: the UDF gets null for
them and the native expression supplies the value.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docscreen.functions.text import translate_accents

# Letters for which NFKC is the identity (alone and next to each other) and for which
# lower-casing equals case folding, apart from the sharp s: ASCII, Latin-1 letters, basic
# Cyrillic, kana without marks, unified CJK.  Verified character by character in the tests.
STABLE = ("\\x00-\\x7F\\u00C0-\\u00FF\\u0410-\\u044F\\u3041-\\u3096\\u30A1-\\u30FA\\u4E00-\\u9FFF")
# One range turns ASCII away; the union of all of them costs ten times as much on every character.
UNSTABLE = f"[^\\x00-\\x7F](?<=[^{STABLE}])"
BEYOND_LATIN = "[^\\x00-\\x7F](?<=[^\\x00-\\x7F\\u00C0-\\u00FF])"


def _udf(function):
    def apply(batch: pd.Series) -> pd.Series:
        return batch.map(function, na_action="ignore")

    return F.pandas_udf(apply, "string")


def _fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def _without_marks(text: str) -> str:
    decomposed = unicodedata.normalize("NFKD", text)
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def _needs(text: Column, pattern: str) -> Column:
    """Rows with such a character; those of ASCII alone have as many bytes as characters."""
    return F.when((F.octet_length(text) != F.length(text)) & text.rlike(pattern), text)


def nfkc_casefold(text: Column) -> Column:
    native = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.coalesce(_udf(_fold)(_needs(text, UNSTABLE)), native)


def nfkd_without_marks(text: Column) -> Column:
    # Latin-1 letters have a native form; anything else, combining marks included, does not.
    return F.coalesce(_udf(_without_marks)(_needs(text, BEYOND_LATIN)),
                      translate_accents(text))
