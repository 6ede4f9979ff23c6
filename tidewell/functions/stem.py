"""Porter's stemmer, as published in 1980, over columns of distinct terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Suffixes and what replaces them, by step.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_CONSONANT, _VOWEL = "(?:[^aeiouy]|(?<![^aeiou])y)", "(?:[aeiou]|(?<=[^aeiou])y)"
_CYCLE = re.compile(f"{_VOWEL}+{_CONSONANT}+")
_HAS_VOWEL = re.compile(_VOWEL)
_SHORT = re.compile(f"{_CONSONANT}{_VOWEL}(?![wxy])[^aeiou]$")


def _measure(stem: str) -> int:
    return len(_CYCLE.findall(stem))


def _swap(word: str, table: dict[str, str], least: int) -> str:
    end = max((s for s in table if word.endswith(s)), key=len, default=None)
    if end is not None and _measure(word[: -len(end)]) >= least:
        return word[: -len(end)] + table[end]
    return word


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeiou"


def stem_word(word: str) -> str:
    """The stem of a lower-case English word; short and other words stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    word = _swap(word, {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}, 0)
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        end = next((s for s in ("ed", "ing") if word.endswith(s)), None)
        if end and _HAS_VOWEL.search(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _SHORT.search(word):
                word += "e"
    if word.endswith("y") and _HAS_VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2, 1), STEP_3, 1)
    end = max((s for s in STEP_4 if word.endswith(s)), key=len, default=None)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _SHORT.search(word[:-1])):
            word = word[:-1]
    return word[:-1] if _double(word) and word[-1] == "l" and _measure(word) > 1 else word


@F.pandas_udf(StringType())
def stemmed(terms: pd.Series) -> pd.Series:
    """Use it on distinct terms, or on postings, not on whole texts."""
    return terms.map(lambda t: None if t is None else stem_word(t))
