"""English stemming after Porter's second algorithm as published; other languages have none here."""

from __future__ import annotations

import re

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Fixed values of the published algorithm.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    m = re.match("gener|commun|arsen", w) or re.search(f"[{_V}][^{_V}]", w)
    r1 = m.end() if m else len(w)
    m = re.search(f"[{_V}][^{_V}]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short_syllable(w: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", w) or re.fullmatch(f"[{_V}][^{_V}]", w))


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.lstrip("'") if word.startswith("'") else word
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = re.sub(f"(^|[{_V}])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif re.search("(ied|ies)$", w):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not re.search("(us|ss)$", w) and re.search(f"[{_V}].*.s$", w):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    if m := re.search("(eedly|eed)$", w):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(f"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif _short_syllable(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for a, b in _STEP2:
        if w.endswith(a):
            w = w[: -len(a)] + b if len(w) - len(a) >= r1 else w
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l" or w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-1] if w.endswith("ogi") else w[:-2]
    for a, b in _STEP3:
        if w.endswith(a):
            w = w[: -len(a)] + b if len(w) - len(a) >= r1 else w
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for a in _STEP4:
        if w.endswith(a):
            w = w[: -len(a)] if len(w) - len(a) >= r2 else w
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
