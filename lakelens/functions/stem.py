"""Word forms for search: accents folded, English suffixes cut by Porter's rules of 1980."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: The suffixes of steps 2, 3 and 4 with what takes their place.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def fold(word: str) -> str:
    """The word without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")


def shape(word: str) -> str:
    """c or v for every letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return shape(word).count("vc")


def ends_cvc(word: str) -> bool:
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """Porter's stem of a lower-case word; words of two letters or with other signs than a-z stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    elif word.endswith("ed") and "v" in shape(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in shape(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            cut += "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and shape(cut)[-1] == "c" and cut[-1] not in "lsz":
            cut = cut[:-1]
        elif measure(cut) == 1 and ends_cvc(cut):
            cut += "e"
        word = cut
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        s = longest(word, table)
        if s and measure(word[: -len(s)]):
            word = word[: -len(s)] + table[s]
    s = longest(word, STEP4)
    if s and measure(word[: -len(s)]) > 1 and (s != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(s)]
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not ends_cvc(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word
