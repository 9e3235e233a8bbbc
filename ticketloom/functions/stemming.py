"""English stems by the published Snowball rules (Porter2)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the published rules: letters, suffixes with their replacements, and words with stems of their own.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
VALID_LI = "cdeghkmnrt"
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURALS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
LONG_BEGINNINGS = ("gener", "commun", "arsen")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
    "ative": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize",
    "ion",
)


def _after_vowel_group(word: str, start: int) -> int:
    """Where the region begins: behind the first consonant that follows a vowel, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _regions(word: str) -> tuple[int, int]:
    first = next((len(b) for b in LONG_BEGINNINGS if word.startswith(b)), None)
    first = _after_vowel_group(word, 0) if first is None else first
    return first, _after_vowel_group(word, first)


def _ends_short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")) or not word.endswith("s"):
        return word
    return word[:-1] if any(c in VOWELS for c in word[:-2]) else word


def _past(word: str, r1: int) -> str:
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    if suffix.startswith("eed"):
        return stem + "ee" if len(stem) >= r1 else word
    if not any(c in VOWELS for c in stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem.endswith(DOUBLES):
        return stem[:-1]
    return stem + "e" if len(stem) <= r1 and _ends_short(stem) else stem


def _step_2(word: str, r1: int) -> str:
    suffix = _longest(word, STEP_2)
    if suffix is None or len(word) - len(suffix) < r1:
        return word
    stem = word[: -len(suffix)]
    if suffix == "ogi" and not stem.endswith("l") or suffix == "li" and not (stem and stem[-1] in VALID_LI):
        return word
    return stem + STEP_2[suffix]


def _step_3(word: str, r1: int, r2: int) -> str:
    suffix = _longest(word, STEP_3)
    if suffix is None or len(word) - len(suffix) < (r2 if suffix == "ative" else r1):
        return word
    return word[: -len(suffix)] + STEP_3[suffix]


def _step_4(word: str, r2: int) -> str:
    suffix = _longest(word, STEP_4)
    if suffix is None or len(word) - len(suffix) < r2:
        return word
    stem = word[: -len(suffix)]
    return word if suffix == "ion" and not stem.endswith(("s", "t")) else stem


def _step_5(word: str, r1: int, r2: int) -> str:
    at = len(word) - 1
    if word.endswith("e") and (at >= r2 or at >= r1 and not _ends_short(word[:-1])):
        return word[:-1]
    return word[:-1] if word.endswith("ll") and at >= r2 else word


def stem(word: str) -> str:
    """The stem of a lower-case word. Words of up to two letters, and those with other characters than a-z and the
    apostrophe, stay as they are."""
    if len(word) <= 2 or not word.replace("'", "").isalpha() or not word.isascii():
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = word.removeprefix("'")
    # A y that begins a word or follows a vowel is a consonant.
    letters = list(word)
    for i, letter in enumerate(letters):
        if letter == "y" and (i == 0 or letters[i - 1] in VOWELS):
            letters[i] = "Y"
    word = "".join(letters)
    r1, r2 = _regions(word)
    for ending in ("'s'", "'s", "'"):
        if word.endswith(ending):
            word = word[: -len(ending)]
            break
    word = _plural(word)
    if word in AFTER_PLURALS:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _step_3(_step_2(word, r1), r1, r2)
    return _step_5(_step_4(word, r2), r1, r2).replace("Y", "y")


def _stemmed(tokens: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def of(token):
        if token not in known:
            known[token] = token if token is None else stem(token)
        return known[token]

    return pd.Series([None if row is None else [of(t) for t in row] for row in tokens])


def stems(tokens: Column) -> Column:
    """An array of lower-case tokens as their English stems, in the same order; each distinct token of an Arrow batch is
    stemmed once."""
    return F.pandas_udf(_stemmed, ArrayType(StringType()))(tokens)
