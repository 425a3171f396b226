"""Stems of English words by Porter's published rules, so that inflected forms meet in a search."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Endings and what takes their place (fixed values of the rules), where what is left holds a vowel and then a consonant (steps 2 and 3).
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Endings that go where what is left holds two such pairs (step 4).
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """A word with v for its vowels and c for its consonants; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    """Whether a word ends in consonant, vowel and a consonant other than w, x and y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replaced(word: str, endings: dict[str, str]) -> str:
    for end in sorted((e for e in endings if word.endswith(e)), key=len, reverse=True)[:1]:
        if _measure(word[: -len(end)]) > 0:
            return word[: -len(end)] + endings[end]
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters or over 64 are their own."""
    if not 3 <= len(word) <= 64:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (end := next((e for e in ("ed", "ing") if word.endswith(e)), "")) and "v" in _shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word).endswith("c") and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, SECOND), THIRD)
    for end in sorted((e for e in FOURTH if word.endswith(e)), key=len, reverse=True)[:1]:
        left = word[: -len(end)]
        if _measure(left) > 1 and (end != "ion" or left.endswith(("s", "t"))):
            word = left
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda found: [stem(t) for t in found])


def stemmed(tokens: Column) -> Column:
    """The stems of an array of tokens, in Arrow batches; a worker remembers those it has made."""
    return _stems(tokens)
