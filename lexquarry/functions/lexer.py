"""The lexer as Spark columns: special patterns, words, folding; no Python on this path.

Text between special patterns (e-mail addresses, user names, URLs, IP addresses, phone numbers, domains, identifiers) is
split into words.  Words are case-folded and, if asked for, stripped of diacritics; specials stay as they are.  What
needs Unicode tables beyond regular expressions (exact word boundaries, full case folding, stemming, normal forms) is in
:mod:`lexquarry.functions.exact`.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from . import stopwords

_W, _D, _S = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}", r"\p{Nd}", r" \t\n\r\f\x{85}\p{Z}"
#: The special patterns, first match wins.  The text of an IPv4 address is its group, which leaves out the character after it.
SPECIALS = (
    ("email", rf"[{_W}.+-]+@[{_W}-]+\.[{_W}.-]+"),
    ("username", rf"@[^{_S}]*[{_W}]"),
    ("url", rf"[{_W}]{{2,}}://[^{_S}]*[^{_S}.]"),
    ("ipv4", rf"([{_D}]{{1,3}}(?:\.[{_D}]{{1,3}}){{3}})(?:[^.{_D}]|$)"),
    ("phone", rf"\+?[{_D}]+(?:[{_S}.-]?[{_D}]+){{4,}}"),
    ("domain", r"[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("id", rf"[{_W}:-]*[{_D}_][{_W}:-]*"),
)
#: All of them; group 1 is an IPv4 address, group 2 a phone number.
SPECIAL = "|".join(f"({p})" if k == "phone" else p for k, p in SPECIALS)
#: What any special has somewhere.
TRIGGER = rf"[@{_D}_]|://|\.[a-zA-Z]{{2}}"
#: Words between blanks in which no special can begin; no special but a phone number goes on over a blank.
_CALM = rf"(?:[\p{{L}}\p{{M}},;:!?'\"()’“”«»—–-]*+[.,;:!?'\")’”»]*+[{_S}]++)++"
_BARE = "|".join(p.replace("(", "(?:", 1) if k == "ipv4" else p for k, p in SPECIALS)
#: A text in stretches: group 1 is the gap before a special, group 2 the special (or the text's end, with nothing), then an
#: IPv4 address and a phone number as in SPECIAL.  What :data:`SPECIAL` finds, but words are passed in one step.
STRETCH = "((?:" + _CALM + "|(?!" + _BARE + r")[\s\S])*+)(" + "|".join(f"({p})" if k == "phone" else p for k, p in SPECIALS) + r"|\z)"
#: Scripts are looked up only for characters that may be in them.
_HAN = r"\x{2E80}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}]"
_CHAR = rf"[\p{{L}}\p{{M}}\p{{N}}_&&[^[{_HAN}]]]"
#: Words by the Unicode rules, nearly: letters, marks, digits and underscores, with some signs between letters or digits; Han and Hiragana one by one.
WORD = rf"[{_HAN}]|{_CHAR}++(?:(?:['’.:·]\p{{L}}|[.,;'’]\p{{N}}){_CHAR}*+)*+"
#: The same for engines without class intersection, for texts without Han.
WORD_PLAIN = r"[\p{L}\p{M}\p{N}_]+(?:(?:['’.:·]\p{L}|[.,;'’]\p{N})[\p{L}\p{M}\p{N}_]*)*"


def words(text: Column) -> Column:
    """Words with a letter or a digit."""
    found = lambda: F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    # without marks and underscores there is nothing to test
    return F.when(text.rlike(r"[\p{M}_]"), F.filter(found(), lambda w: w.rlike(r"[\p{L}\p{N}]"))).otherwise(found())


def _folding_table() -> tuple[str, str]:
    """Letters of the European scripts that are another letter with marks, and that letter."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) for c in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folding_table()


def fold_case(x: Column) -> Column:
    return F.replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def fold_diacritics(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, FOLD_FROM, FOLD_TO), r"\p{M}", "")


def specials(text: Column) -> Column:
    """The specials of a text in order: structs of kind, raw (as it stands) and term (normalised)."""
    whole, ip = (F.when(text.rlike(TRIGGER), F.regexp_extract_all(text, F.lit(STRETCH), F.lit(g))) for g in (2, 3))

    def one(m, i):
        a = F.element_at(ip, i + 1)
        kind = F.lit("id")
        for name, pattern in reversed(SPECIALS[:-1]):
            kind = F.when(a != "", "ipv4").otherwise(kind) if name == "ipv4" else F.when(m.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
        raw = F.when(a != "", a).otherwise(m)
        return F.struct(kind.alias("kind"), m.alias("whole"), F.when(kind == "phone", F.regexp_replace(raw, "[^0-9+]", "")).otherwise(raw).alias("term"))

    return F.filter(F.transform(whole, one), lambda s: s.whole != "")


def parts(text: Column, config: Config) -> dict[str, Column]:
    """What :func:`assemble` needs of a text, each found once: its specials, the groups that tell them apart, and the gaps."""
    if not config.tokenization.detect_special_patterns:
        return {"_text": text}
    groups = {"_gaps": 1, "_s0": 2} | ({} if config.tokenization.compat_split_special_patterns else {"_s1": 3, "_s2": 4})
    none = {"_gaps": F.array(text)}  # a text without specials is one gap
    hit = text.rlike(TRIGGER)
    return {k: F.when(hit, F.regexp_extract_all(text, F.lit(STRETCH), F.lit(g))).when(text.isNotNull(), none.get(k, F.array(F.lit("")))) for k, g in groups.items()}


def assemble(part: dict[str, Column], config: Config) -> Column:
    """Tokens in order, repeats included: array of structs of special, term and bytes (of the word as written)."""
    token = lambda special, term, size: F.struct(F.lit(special).alias("special"), term.alias("term"), F.octet_length(size).alias("bytes"))
    fold = (lambda w: fold_diacritics(fold_case(w))) if config.normalization.diacritic_folding_enabled else fold_case
    plain = lambda t: F.transform(words(t), lambda w: token(False, fold(w), w))
    if "_text" in part:
        return plain(part["_text"])
    whole = part["_s0"]
    if config.tokenization.compat_split_special_patterns:

        def special(i):
            found = words(F.get(whole, i))
            return F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(F.get(whole, i))), lambda w: token(True, w, w))

    else:

        def special(i):
            ip, phone = F.get(part["_s1"], i), F.get(part["_s2"], i)
            term = F.when(ip != "", ip).when(phone != "", F.regexp_replace(phone, "[^0-9+]", "")).otherwise(F.get(whole, i))
            return F.transform(F.array(term), lambda t: token(True, t, t))

    none = F.array().cast("array<struct<special:boolean,term:string,bytes:int>>")
    return F.flatten(F.transform(part["_gaps"], lambda g, i: F.concat(plain(g), F.when(F.get(whole, i) != "", special(i)).otherwise(none))))


def lex(text: Column, config: Config) -> Column:
    """:func:`assemble` of the :func:`parts` of a text, as one expression."""
    return assemble(parts(text, config), config)


def needs_exact(config: Config) -> bool:
    return config.normalization.stemming_enabled or config.normalization.unicode_normalization is not None


def tokens(df: DataFrame, config: Config, *, text: str = "text", lang: str | None = "lang", cleanup: bool = True, exact: bool = False) -> DataFrame:
    """One row for each distinct term of each row of df, in order: df's columns (without text) and term, special, bytes, pos.

    ``lang`` names a column of language codes in either case; ``none`` there turns the clean-up off, and where it is null
    or blank the language is guessed from the text's head.  Without such a column nothing is guessed, and only words that
    the configuration denies go.  Null texts have no terms.
    """
    rest = [c for c in df.columns if c != text]
    if exact or needs_exact(config):
        from .exact import lex_udf

        found = lex_udf(config, cleanup)(F.col(text), F.col(lang) if lang else F.lit("und"))
        return df.select(*rest, F.posexplode(found).alias("pos", "_t")).select(*rest, "_t.term", "_t.special", "_t.bytes", "pos")
    part = parts(F.col(text), config)
    code = {"_code": language(F.col(lang), F.col(text))} if lang and cleanup else {}
    df = df.select(*rest, *[c.alias(k) for k, c in (part | code).items()])  # found once, then put together
    found = assemble({k: F.col(k) for k in part}, config)
    # the first of equal terms is kept: a term counts once for a text, with its first place and length
    rows = df.select(*rest, *code, F.posexplode(found).alias("pos", "_t")).select(*rest, *code, "_t.term", "_t.special", "_t.bytes", "pos")
    return drop_stopwords(rows, config, F.col("_code") if code else None).drop(*code) if cleanup else rows


def terms(df: DataFrame, config: Config, *, exact: bool = False) -> DataFrame:
    """df's columns (without text) and term: the distinct terms of :func:`tokens` for each row of df, in no order.

    They are told apart within the row, so no row of theirs is moved.
    """
    rest = [c for c in df.columns if c != "text"]
    if exact or needs_exact(config) or config.normalization.diacritic_folding_enabled:
        found = tokens(df.withColumn("_row", F.monotonically_increasing_id()), config, exact=exact)
        return found.select(*rest, "_row", "term").distinct().drop("_row")
    text = F.col("text")
    plain = words(fold_case(text))  # folding a whole text makes the same words as folding each
    found = F.array_distinct(plain)
    part = {}
    if config.tokenization.detect_special_patterns:
        part = parts(text, config)
        every = assemble({k: F.col(k) for k in part}, config)
        found = F.when(F.col("_hit"), F.array_distinct(F.transform(every, lambda t: t.term))).otherwise(found)
        part = part | {"_hit": text.rlike(TRIGGER)}
    df = df.select("*", language(F.col("lang"), text).alias("_code"), *[c.alias(k) for k, c in part.items()])
    rows = df.select(*rest, "_code", F.explode(found).alias("term"))
    return drop_stopwords(rows, config, F.col("_code")).drop("_code")


def language(lang: Column, text: Column) -> Column:
    """The language of a text: the code that is given, else what :func:`lexquarry.functions.langs.detect` makes of its head.

    Only heads of texts without a code are sent to Python.
    """
    from .langs import detect_udf

    given = stopwords.iso_column(lang)
    return F.coalesce(given, detect_udf()(F.when(given.isNull(), text)))


def drop_stopwords(rows: DataFrame, config: Config, code: Column | None) -> DataFrame:
    """rows (with term) without stop-words; the lists are a fixed, small table that is broadcast.  code: of :func:`language`."""
    deny = stopwords.forms(config.stopwords.deny)
    if code is None:
        return rows.where(~F.col("term").isin(*deny)) if deny else rows
    listed = stopwords.frame(rows.sparkSession).select(F.col("lang").alias("_l"), F.col("term").alias("_s"))
    if config.stopwords.allow:
        listed = listed.where(~F.col("_s").isin(*stopwords.forms(config.stopwords.allow)))
    out = rows.join(F.broadcast(listed), (code == F.col("_l")) & (F.col("term") == F.col("_s")), "left_anti")
    if deny:
        out = out.where((F.coalesce(code, F.lit("")) == "none") | ~F.col("term").isin(*deny))
    return out


def distinct_terms(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first occurrence of each term for each key: keys, term, special, bytes, pos."""
    # place, size and kind in one number, which is added up by hashing; a row has neither 2^31 places nor bytes
    packed = F.shiftleft(F.col("pos").cast("long"), 32) + F.shiftleft(F.col("bytes").cast("long"), 1) + F.col("special").cast("long")
    rows = rows.groupBy(*keys, "term").agg(F.min(packed).alias("_f"))
    return rows.select(*keys, "term", (F.col("_f") % 2 == 1).alias("special"), F.shiftright(F.col("_f") % (1 << 32), 1).cast("int").alias("bytes"), F.shiftright("_f", 32).cast("int").alias("pos"))
