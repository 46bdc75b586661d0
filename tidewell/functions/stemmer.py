"""The suffix-stripping stemmer of M. F. Porter, "An algorithm for suffix stripping"
(Program 14, 1980), as a vectorised function over distinct words."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The suffix rules of the published steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

SHAPE = re.compile("(?<=v)c")


def shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def measure(stem: str) -> int:
    """The number of vowel-consonant turns."""
    return len(SHAPE.findall(shape(stem)))


def ends_cvc(stem: str) -> bool:
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c"


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def step_1(w: str) -> str:
    """Plurals and -ed, -ing."""
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    suffix = longest(w, ("ed", "ing"))
    if not suffix or "v" not in shape(w[: -len(suffix)]):
        return w
    w = w[: -len(suffix)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if doubled(w) and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if measure(w) == 1 and ends_cvc(w) else w


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = step_1(word)
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        suffix = longest(w, rules)
        if suffix and measure(w[: -len(suffix)]) > 0:
            w = w[: -len(suffix)] + rules[suffix]
    suffix = longest(w, STEP_4)
    if suffix and measure(w[: -len(suffix)]) > 1 and (suffix != "ion" or w[: -len(suffix)].endswith(("s", "t"))):
        w = w[: -len(suffix)]
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or m == 1 and not ends_cvc(w[:-1]):
            w = w[:-1]
    return w[:-1] if measure(w) > 1 and w.endswith("ll") else w


@F.pandas_udf(StringType())
def stem_udf(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for w in words:
        yield w.map(lambda x: stem(x) if x is not None else None)


def with_stems(terms: DataFrame, column: str = "word") -> DataFrame:
    """Terms with a column ``stem``: each distinct word is stemmed once and joined back."""
    stems = terms.select(column).distinct().withColumn("stem", stem_udf(column))
    return terms.join(stems, column)
