"""English stemming after Porter's second algorithm, as published on snowballstem.org."""

from __future__ import annotations

import re

_VOWELS = frozenset("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

# Fixed values of the published algorithm: whole-word exceptions and suffix tables.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = frozenset(
    ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
)
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism",
    "ate", "iti", "ous", "ive", "ize", "ion",
)

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")
_HAS_VOWEL = re.compile(r"[aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    """Start offsets of the two suffix regions."""
    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            first = len(prefix)
            break
    else:
        found = _REGION.search(word)
        first = found.end() if found else len(word)
    found = _REGION.search(word, first)
    return first, found.end() if found else len(word)


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters stay as they are."""
    if len(word) <= 2 or word in WHOLE:
        return WHOLE.get(word, word)
    # y acts as a consonant at the start and after a vowel
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)

    # plurals
    end = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and _HAS_VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in AFTER_PLURAL:
        return word

    # past and progressive forms
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and _HAS_VOWEL.search(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT_END.search(word):
            word += "e"

    if word[-1] in "yY" and len(word) > 2 and word[-2] not in _VOWELS:
        word = word[:-1] + "i"

    # derivational endings
    end = _longest(word, STEP2)
    at = len(word) - len(end)
    if end and at >= r1:
        allowed = (
            word[:at].endswith("l") if end == "ogi"
            else word[at - 1 : at] in tuple("cdeghkmnrt") if end == "li"
            else True
        )
        if allowed:
            word = word[:at] + STEP2[end]
    end = _longest(word, STEP3)
    at = len(word) - len(end)
    if end and at >= r1 and (end != "ative" or at >= r2):
        word = word[:at] + STEP3[end]
    end = _longest(word, STEP4)
    at = len(word) - len(end)
    if end and at >= r2 and (end != "ion" or word[:at].endswith(("s", "t"))):
        word = word[:at]

    # final e and double l
    at = len(word) - 1
    if word.endswith("e"):
        if at >= r2 or (at >= r1 and not _SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and at >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
