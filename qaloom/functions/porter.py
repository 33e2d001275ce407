"""The Porter stemming algorithm (M. F. Porter, 1980), as a table of suffix rules with conditions on the stem."""

from __future__ import annotations

from functools import lru_cache

#: Suffix rules of steps 2 to 4: suffix -> replacement (fixed values of the algorithm).
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """The word as consonants (c) and vowels (v); y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    return _shape(stem).count("vc")


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def stem(w: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(w) <= 2:
        return w
    if (s := _longest(w, ("sses", "ies", "ss", "s"))) is not None:
        w = w[: len(w) - len(s)] + {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}[s]
    s = _longest(w, ("eed", "ed", "ing"))
    if s == "eed":
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif s and "v" in _shape(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        if (s := _longest(w, rules)) and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + rules[s]
    if s := _longest(w, STEP4):
        rest = w[: -len(s)]
        if _measure(rest) > 1 and (s != "ion" or rest.endswith(("s", "t"))):
            w = rest
    if w.endswith("e"):
        rest = w[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _cvc(rest)):
            w = rest
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w
