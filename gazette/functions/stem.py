"""English stemming after the published Porter2 algorithm."""

from __future__ import annotations

import re
from functools import lru_cache

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Words with stems of their own.
_OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_STOPPED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Endings of steps 2 and 3 and what replaces them.
_TWO = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_THREE = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOUR = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    m = re.match("gener|commun|arsen", w)
    first = m.end() if m else (x.end() if (x := re.search(f"[{_V}][^{_V}]", w)) else len(w))
    second = first + x.end() if (x := re.search(f"[{_V}][^{_V}]", w[first:])) else len(w)
    return first, second


def _short_end(w: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", w) or re.fullmatch(f"[{_V}][^{_V}]", w))


def _longest(w: str, endings) -> str:
    return max((e for e in endings if w.endswith(e)), key=len, default="")


@lru_cache(1 << 16)
def stemmed(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) <= 2 or not w.isascii():
        return w
    if w in _OWN:
        return _OWN[w]
    w = w.removeprefix("'")
    w = re.sub(f"(^|(?<=[{_V}]))y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _STOPPED:
        return w
    if e := _longest(w, ("eedly", "eed")):
        w = w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
    elif (e := _longest(w, ("ingly", "edly", "ing", "ed"))) and re.search(f"[{_V}]", w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if re.search(f".[^{_V}][yY]$", w):
        w = w[:-1] + "i"
    e = _longest(w, [*_TWO, "ogi", "li"])
    if e and len(w) - len(e) >= r1:
        if e == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif e == "li":
            w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
        else:
            w = w[: -len(e)] + _TWO[e]
    e = _longest(w, [*_THREE, "ative"])
    if e and len(w) - len(e) >= r1:
        if e == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(e)] + _THREE[e]
    e = _longest(w, [*_FOUR, "ion"])
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
