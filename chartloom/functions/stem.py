"""The Porter stemmer (Porter, 1980), for use over distinct terms."""

import functools
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonants(w: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(w):
        out.append(c not in "aeiou" and (c != "y" or i == 0 or not out[i - 1]))
    return out


def _measure(w: str) -> int:
    flags = _consonants(w)
    return sum(1 for a, b in zip(flags, flags[1:]) if not a and b)


def _has_vowel(w: str) -> bool:
    return not all(_consonants(w))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1]


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonants(w)[-3:] == [True, False, True] and w[-1] not in "wxy"


def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for suffix in sorted(table, key=len, reverse=True):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + table[suffix]
                break
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stemmed(term: pd.Series) -> pd.Series:
    return term.map(lambda t: None if t is None else stem(t))


@F.pandas_udf(ArrayType(StringType()))
def stemmed_all(terms: pd.Series) -> pd.Series:
    """Every term of a list folded and stemmed."""
    return terms.map(lambda ts: None if ts is None else [_folded_stem(t) for t in ts])


@functools.lru_cache(1 << 17)
def _folded_stem(term: str) -> str:
    return stem("".join(c for c in unicodedata.normalize("NFKD", term) if unicodedata.category(c) != "Mn"))
