"""Porter's suffix-stripping algorithm (1980), for distinct terms in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the published algorithm: suffixes of its steps 2, 3 and 4, longest first where one ends with another.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c or v for each letter: y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str], least: int) -> str:
    found = max((s for s in table if word.endswith(s)), key=len, default=None)
    if found is None or _measure(word[: -len(found)]) <= least:
        return word
    return word[: -len(found)] + table[found]


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + new
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
        if cut is not None:
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP2, 0), STEP3, 0)
    last = max((s for s in STEP4 if word.endswith(s)), key=len, default=None)
    if last and _measure(word[: -len(last)]) > 1 and (last != "ion" or word[: -len(last)].endswith(("s", "t"))):
        word = word[: -len(last)]
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stems(words: Column) -> Column:
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(stem)

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())(words)
