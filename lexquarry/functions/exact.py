"""The lexer with full Unicode rules, in Arrow batches: exact word boundaries, case folding, stemming, normal forms.

Used where the configuration asks for stemming or a normal form, or on request; the column lexer serves otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
import xxhash
from pyspark.sql import functions as F

from ..config import Config
from . import langs, stem, stopwords
from .lexer import SPECIALS

_BOUNDARY = regex.compile(r"(?V1w)\b")
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")
_SPECIAL = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in SPECIALS).replace(r"\x{85}", "\x85"))


def unicode_words(text: str) -> list[str]:
    """Words between Unicode word boundaries that hold a letter or digit; Han and Hiragana come one by one."""
    return [w for w in _BOUNDARY.split(text) if w and _ALNUM.search(w)]


def pieces(text: str, config: Config) -> Iterator[tuple[bool, str]]:
    """(special, text as written or normalised) in order."""
    at = 0
    if config.tokenization.detect_special_patterns:
        for m in _SPECIAL.finditer(text):
            yield from ((False, w) for w in unicode_words(text[at : m.start()]))
            if config.tokenization.compat_split_special_patterns:
                yield from ((True, w) for w in unicode_words(m[0]) or [m[0]])
            elif m["ipv4"]:
                yield True, m[m.re.groupindex["ipv4"] + 1]
            else:
                yield True, "".join(c for c in m[0] if c in "+0123456789") if m["phone"] else m[0]
            at = m.end()
    yield from ((False, w) for w in unicode_words(text[at:]))


def normalise(word: str, config: Config, lang: str | None) -> str:
    w = word.casefold()
    if config.normalization.diacritic_folding_enabled:
        w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.category(c).startswith("M"))
    if config.normalization.stemming_enabled and lang == "eng":
        w = stem.english(w)
    return w


def lex(text: str, config: Config, lang: str | None = None, cleanup: bool = True) -> list[tuple[bool, str, int]]:
    """(special, term, bytes) of the distinct terms of a text, in order.

    Without a language the text is guessed, for clean-up and for stemming; ``none`` turns clean-up off.
    """
    code = stopwords.iso(lang)
    if code == "none":
        code, cleanup = None, False
    if code is None and (cleanup or config.normalization.stemming_enabled):
        code = langs.detect(text)
    out, seen = [], set()
    for special, raw in pieces(text, config):
        term = raw if special else normalise(raw, config, code)
        if cleanup and stopwords.is_stopword(term, code, config.stopwords.allow, config.stopwords.deny):
            continue
        if not special and config.normalization.unicode_normalization:
            term = unicodedata.normalize(config.normalization.unicode_normalization.upper(), term)
        if term not in seen:
            seen.add(term)
            out.append((special, term, len(raw.encode())))
    return out


def lex_udf(config: Config, cleanup: bool = True):
    @F.pandas_udf("array<struct<special:boolean,term:string,bytes:int>>")
    def run(texts: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"special": s, "term": w, "bytes": n} for s, w, n in lex(t, config, x, cleanup)] for t, x in zip(texts, lang)])

    return run


def normal_forms_udf():
    """A term and its NFC and NFD forms, without repeats, in this order."""

    @F.pandas_udf("array<string>")
    def run(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: list(dict.fromkeys([t, unicodedata.normalize("NFC", t), unicodedata.normalize("NFD", t)])))

    return run


def term_hash(term: str) -> int:
    """The 32-bit name of a term."""
    return xxhash.xxh32_intdigest(term.encode(), 0)


def term_hash_udf():
    @F.pandas_udf("long")
    def run(terms: pd.Series) -> pd.Series:
        return terms.map(term_hash)

    return run
