"""The Porter2 (English) stemmer, from its published description."""

from __future__ import annotations

import re

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _vowel(w: str, i: int) -> bool:
    return w[i] in _VOWELS


def _region(w: str, start: int) -> int:
    """Just after the first non-vowel that follows a vowel at or after ``start``."""
    for i in range(start + 1, len(w)):
        if not _vowel(w, i) and _vowel(w, i - 1):
            return i + 1
    return len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return _vowel(w, 0) and not _vowel(w, 1)
    return len(w) > 2 and not _vowel(w, -1 + len(w)) and w[-1] not in "wxY" and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 3)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    w = word.replace("’", "'")
    if len(w) <= 2:
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    w = w.lstrip("'")
    if not w:
        return w
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, 0)
    r2 = _region(w, r1)

    for end in ("'s'", "'s", "'"):  # 0
        if w.endswith(end):
            w = w[: -len(end)]
            break

    if w.endswith("sses"):  # 1a
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w

    if w.endswith(("eedly", "eed")):  # 1b
        end = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), None)
        if end and any(c in _VOWELS for c in w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"

    if len(w) > 2 and w[-1] in "yY" and not _vowel(w, len(w) - 2):  # 1c
        w = w[:-1] + "i"

    for end, new in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and not (end == "ogi" and w[-4:-3] != "l") and not (end == "li" and w[-3:-2] not in tuple("cdeghkmnrt")):
                w = w[: -len(end)] + new
            break
    for end, new in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + new
            break
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and not (end == "ion" and w[-4:-3] not in ("s", "t")):
                w = w[: -len(end)]
            break

    if w.endswith("e"):  # 5
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
