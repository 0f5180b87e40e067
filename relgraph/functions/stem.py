"""The stemmer of Porter (1980), for English words in lower case."""

from __future__ import annotations

import re
from functools import lru_cache

# The endings of the paper's steps 2, 3 and 4, longest first where one ends another.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _kinds(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c", _kinds(word)))


def _short(word: str) -> bool:
    """Whether it ends consonant, vowel, consonant, the last not w, x or y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _changed(word: str, endings, least: int) -> str:
    """The longest ending that fits decides, whether or not its condition holds."""
    for end, new in sorted(endings, key=lambda e: -len(e[0])):
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            return stem + new if measure(stem) > least else word
    return word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if "v" in _kinds(word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _double(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _changed(word, STEP2, 0)
    word = _changed(word, STEP3, 0)
    for end in sorted(STEP4, key=len, reverse=True):
        if word.endswith(end):
            rest = word[: len(word) - len(end)]
            if measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if measure(word) > 1 and _double(word) and word[-1] == "l":
        word = word[:-1]
    return word
