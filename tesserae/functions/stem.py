"""Suffix stripping for English after Porter (1980): measure-based rules in five steps."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes and replacements of steps 2 to 4, in the order of the published lists.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(stem: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(stem):
        vowel = ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _mapped(w: str, rules: list[tuple[str, str]]) -> str:
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            return stem + new if measure(stem) > 0 else w
    return w


def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: len(w) - len(end)]):
                w = w[: len(w) - len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _doubled(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _mapped(_mapped(w, STEP2), STEP3)
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            s = w[: len(w) - len(end)]
            if measure(s) > 1 and (end != "ion" or s.endswith(("s", "t"))):
                w = s
            break
    if w.endswith("e"):
        s = w[:-1]
        if measure(s) > 1 or measure(s) == 1 and not _cvc(s):
            w = s
    if measure(w) > 1 and _doubled(w) and w.endswith("l"):
        w = w[:-1]
    return w


def stemmed(word: Column) -> Column:
    """Arrow batches; call it on distinct words, not on texts."""
    @F.pandas_udf("string")
    def of(words: pd.Series) -> pd.Series:
        return words.map({w: stem(w) for w in words.dropna().unique()})

    return of(word)
