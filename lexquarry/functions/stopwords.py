"""Stop-words, from the lists that Spark ships for its StopWordsRemover; they lie beside this module in stopwords.txt."""

from __future__ import annotations

import functools
import unicodedata
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages of Spark's lists by their ISO 639-3 codes, in the order in which ties are decided.
LISTS = ("dan", "deu", "eng", "fin", "fra", "hun", "ita", "nld", "nob", "por", "rus", "spa", "swe", "tur")
#: Two-letter codes that data often carry.
CODES = {"da": "dan", "de": "deu", "en": "eng", "fi": "fin", "fr": "fra", "hu": "hun", "it": "ita", "nl": "nld", "no": "nob", "nb": "nob", "pt": "por", "ru": "rus", "es": "spa", "sv": "swe", "tr": "tur"}


@functools.cache
def _lists() -> dict[str, tuple[str, ...]]:
    """The words of each language, lower-case, NFKD, sorted."""
    held = (resources.files(__package__) / "stopwords.txt").read_text(encoding="utf-8")
    rows = (line.split("\t") for line in held.splitlines() if line and not line.startswith("#"))
    return {lang: tuple(sorted({unicodedata.normalize("NFKD", w.lower()) for w in ws.split()})) for lang, ws in rows}


def words(lang: str) -> tuple[str, ...]:
    """The stop-words of a language; none for a language without a list."""
    return _lists().get(lang, ())


def iso(lang: str | None) -> str | None:
    """A language code in lower case with three letters; ``none`` stays, blank is null."""
    x = (lang or "").strip().lower()
    return CODES.get(x, x) or None


def forms(words) -> tuple[str, ...]:
    """Words as they are and composed: what the same word may look like in a text."""
    return tuple(sorted({f for w in words for f in (w, unicodedata.normalize("NFC", w))}))


def iso_column(lang: Column) -> Column:
    """:func:`iso` of a column."""
    x = F.lower(F.trim(lang))
    known = F.create_map(*[F.lit(v) for pair in CODES.items() for v in pair])
    return F.when(x != "", F.coalesce(F.element_at(known, x), x))


@functools.cache
def _set(lang: str) -> frozenset:
    return frozenset(words(lang))


def frame(spark: SparkSession, langs=LISTS) -> DataFrame:
    """(lang, lang_order, term) with composed and decomposed forms; a fixed table of a few thousand rows."""
    rows = [(x, i, w) for i, x in enumerate(langs) for w in forms(words(x))]
    return spark.createDataFrame(rows, "lang string, lang_order int, term string")


def is_stopword(word: str, lang: str | None, allow=(), deny=()) -> bool:
    """deny holds in any language; without a language nothing else is a stop-word; allow overrides the list."""
    w = unicodedata.normalize("NFKD", word)
    if w in deny:
        return True
    return lang is not None and w not in allow and w in _set(lang)
