"""Scripts, the ranges of their code points, and language detection."""

from __future__ import annotations

import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stopwords

#: Code points of each script; a completion stays within the range of what was typed.
RANGES: dict[str, tuple[tuple[int, int], ...]] = {
    "latin": ((0x0000, 0x024F),),
    "cyrillic": ((0x0400, 0x052F),),
    "arabic": ((0x0600, 0x06FF), (0x0750, 0x077F)),
    "armenian": ((0x0530, 0x058F),),
    "devanagari": ((0x0900, 0x097F),),
    "hiragana": ((0x3040, 0x309F),),
    "katakana": ((0x30A0, 0x30FF), (0x31F0, 0x31FF)),
    "ethiopic": ((0x1200, 0x139F), (0x2D80, 0x2DDF)),
    "hebrew": ((0x0590, 0x05FF),),
    "bengali": ((0x0980, 0x09FF),),
    "georgian": ((0x10A0, 0x10FF), (0x2D00, 0x2D2F)),
    "mandarin": ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2CEAF)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F)),
    "greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)),
    "kannada": ((0x0C80, 0x0CFF),),
    "tamil": ((0x0B80, 0x0BFF),),
    "thai": ((0x0E00, 0x0E7F),),
    "gujarati": ((0x0A80, 0x0AFF),),
    "gurmukhi": ((0x0A00, 0x0A7F),),
    "telugu": ((0x0C00, 0x0C7F),),
    "malayalam": ((0x0D00, 0x0D7F),),
    "oriya": ((0x0B00, 0x0B7F),),
    "myanmar": ((0x1000, 0x109F),),
    "sinhala": ((0x0D80, 0x0DFF),),
    "khmer": ((0x1780, 0x17FF), (0x19E0, 0x19FF)),
}
#: Languages written in a script; with Latin and Cyrillic those that have a stop-word list.
LANGS = {
    "arabic": ("ara",), "armenian": ("hye",), "bengali": ("ben",), "cyrillic": ("rus",), "devanagari": ("hin",), "ethiopic": ("amh",), "georgian": ("kat",), "greek": ("ell",),
    "gujarati": ("guj",), "gurmukhi": ("pan",), "hangul": ("kor",), "hebrew": ("heb",), "hiragana": ("jpn",), "kannada": ("kan",), "katakana": ("jpn",), "khmer": ("khm",),
    "malayalam": ("mal",), "mandarin": ("cmn",), "myanmar": ("mya",), "oriya": ("ori",), "sinhala": ("sin",), "tamil": ("tam",), "telugu": ("tel",), "thai": ("tha",),
    "latin": tuple(x for x in stopwords.LISTS if x != "rus"),
}
#: The codes that LANG takes.
KNOWN = frozenset("""afr aka amh ara aze bel ben bul cat ces cmn cym dan deu ell eng epo est fin fra guj heb hin hrv hun hye ind ita jav jpn kan kat khm kor lat lav
lit mal mar mkd mya nep nld nob ori pan pes pol por ron rus sin slk slv sna spa srp swe tam tel tgl tha tuk tur ukr urd uzb vie yid zul""".split())
#: Bytes below which nothing is detected, bytes looked at, bytes below which trigrams come first.
LEAST_BYTES, MOST_BYTES, SHORT_BYTES = 20, 200, 60


def regex_class(script: str) -> str:
    """The class of a script's characters as a regular expression."""
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in RANGES[script]) + "]"


def script_of(text: str) -> str | None:
    """The script of most letters; ties go to the one that comes first in RANGES."""
    count = Counter()
    for c in text:
        if c.isalpha():
            for name, spans in RANGES.items():
                if any(a <= ord(c) <= b for a, b in spans):
                    count[name] += 1
                    break
            else:
                if 0xAC00 <= ord(c) <= 0xD7AF:
                    count["hangul"] += 1
    return max(RANGES, key=lambda s: count[s]) if count else None


def stays_in_script(term: Column, word: Column) -> Column:
    """Whether what word adds to term is written in the term's script.

    A term of Latin letters and common signs is Latin; another is of the first script that it has a letter of.
    """
    suffix = F.substring(word, F.length(term) + 1, F.length(word))
    within = lambda s: suffix.rlike(f"^{regex_class(s)}*$")
    others = within("latin")
    for s in reversed(list(RANGES)[1:]):
        others = F.when(term.rlike(regex_class(s)), within(s)).otherwise(others)
    return F.when(term.rlike(r"^[\x{0000}-\x{024F}]*$"), within("latin")).otherwise(others)


def guess_by_stopwords(text: str, script: str) -> str | None:
    """The language of the script with most stop-words among the blank-separated words as written; the first wins ties."""
    found = [unicodedata.normalize("NFKD", w) for w in text.split()]
    best, most = None, 0
    for x in LANGS[script]:
        n = sum(w in stopwords._set(x) for w in found)
        if n > most:
            best, most = x, n
    return best


def _trigrams(text: str) -> Counter:
    t = f" {' '.join(text.lower().split())} "
    return Counter(t[i : i + 3] for i in range(len(t) - 2))


_PROFILES: dict[str, Counter] = {}


def guess_by_trigrams(text: str, script: str) -> tuple[str | None, bool]:
    """The language whose stop-words share most trigrams with the text, and whether it leads clearly."""
    langs = LANGS[script]
    if len(langs) == 1:
        return langs[0], True
    for x in langs:
        if x not in _PROFILES:
            _PROFILES[x] = _trigrams(" ".join(stopwords.words(x)))
    seen = _trigrams(text)
    scores = sorted(((sum(n for g, n in seen.items() if g in _PROFILES[x]) / (1 + len(_PROFILES[x])) ** 0.25, -i, x) for i, x in enumerate(langs)), reverse=True)
    if scores[0][0] == 0:
        return None, False
    return scores[0][2], scores[0][0] > 1.5 * scores[1][0]


def detect(text: str | None) -> str | None:
    """The language of a text, as the lexer guesses it: none under 20 bytes; short texts by trigrams unless stop-words
    speak against an unsure guess; longer ones by the stop-words of their first 200 bytes, else by trigrams."""
    raw = (text or "").encode()
    if len(raw) < LEAST_BYTES:
        return None
    head = raw[:MOST_BYTES].decode(errors="ignore")
    script = script_of(head)
    if script is None:
        return None
    if len(raw) < SHORT_BYTES:
        guess, sure = guess_by_trigrams(head, script)
        return guess if sure else guess_by_stopwords(head, script) or guess
    return guess_by_stopwords(head, script) or guess_by_trigrams(head, script)[0]


def detect_udf():
    """:func:`detect` as an Arrow-batched function of a text column; only the head of a text is sent to it."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(detect)

    return lambda c: run(F.substring(c, 1, MOST_BYTES))


def guess_languages(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and lang by stop-words alone, as joins: the Latin-script language with most of them, the first wins ties."""
    listed = stopwords.frame(df.sparkSession, LANGS["latin"])
    seen = df.select(key, F.explode(F.split(text, r"[ \t\n\x0B\f\r]+")).alias("term"))
    hits = seen.join(F.broadcast(listed), "term").groupBy(key, "lang", "lang_order").agg(F.count("*").alias("n"))
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "lang_order"))).where("r = 1")
    return df.select(key).join(best.select(key, "lang", "n"), key, "left").select(key, "lang", F.coalesce("n", F.lit(0)).alias("hits"))
