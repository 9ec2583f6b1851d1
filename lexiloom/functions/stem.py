"""Porter's stemmer (1980), with -bli -> -ble and -logi -> -log, and its Spark forms.

Case matters: upper-case letters are consonants, as the source data's convention has it; stem_lower lower-cases first,
as the evaluator's stemmer does. Words of one or two characters stay, null becomes the empty string.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The published suffix tables, longest of rivals first.
DERIVED = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
SHORTENED = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
REMOVED = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
]


def form(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return form(word).count("vc")


def short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return form(word).endswith("cvc") and word[-1] not in "wxy"


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and form(word)[-1] == "c"


def _inflection(w: str) -> str:
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if "v" not in form(base):
                return w
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if doubled(base):
                return base if base[-1] in "lsz" else base[:-1]
            return base + "e" if measure(base) == 1 and short_end(base) else base
    return w


def _replaced(w: str, table: list[tuple[str, str]]) -> str:
    for suffix, new in table:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            return base + new if measure(base) > 0 else w
    return w


def _removed(w: str) -> str:
    for suffix in sorted(REMOVED, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)] + (suffix[0] if suffix in ("sion", "tion") else "")
            return base if measure(base) > 1 else w
    return w


def _final(w: str) -> str:
    m = measure(w)
    if w.endswith("e") and (m > 1 or (m == 1 and not short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("l") and doubled(w) and m > 1 else w


@lru_cache(maxsize=200_000)
def porter(word: str | None) -> str:
    if not word or len(word) < 3:
        return word or ""
    w = _inflection(word)
    if w.endswith("y") and "v" in form(w[:-1]):
        w = w[:-1] + "i"
    return _final(_removed(_replaced(_replaced(w, DERIVED), SHORTENED)))


@F.pandas_udf(T.StringType())
def stem(words: pd.Series) -> pd.Series:
    return words.map(porter, na_action=None)


@F.pandas_udf(T.StringType())
def stem_lower(words: pd.Series) -> pd.Series:
    return words.map(lambda w: porter(w and w.lower()), na_action=None)


def identity(words: Column) -> Column:
    return F.coalesce(words, F.lit(""))


def stem_vocabulary(df: DataFrame, column: str, lowercase: bool = False) -> DataFrame:
    """word, stem of each distinct word of the column: the stemmer runs once a word, not once a row."""
    return df.select(F.col(column).alias("word")).filter("word is not null").distinct().withColumn("stem", (stem_lower if lowercase else stem)("word"))
