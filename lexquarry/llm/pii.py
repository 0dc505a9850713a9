"""Surrogates for personal data, in DataFrame operations only.

Entities are found by patterns and split into parts (a name into given name and surname, a password line into its key
and its value).  Each distinct part gets one surrogate, drawn from a keyed hash and shaped like the part: digits for
digits, letters for letters, valid check digits, names of the same gender and script.  A given name's gender is settled
over all its mentions first.  Surrogates that two parts share, or that are themselves parts of the corpus, are drawn
again until all differ, so distinct entities stay distinct and mentions of one entity agree throughout the corpus.

Names are found after a title, after words that introduce a person, or by a common given name; others are not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import free_name, materialise, table

#: Titles by gender, and given names by gender and script.
TITLES = {"m": ("Mr", "Herr", "Señor", "Monsieur", "Господин", "Κύριος"), "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Señorita", "Госпожа", "Κυρία"), "u": ("Dr", "Prof")}
GIVEN = {
    ("m", "latin"): ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Charles", "Daniel", "Paul", "Peter", "Hans", "Klaus", "Jean", "Pierre", "Luis", "Carlos", "José", "Juan", "Miguel"),
    ("f", "latin"): ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Jessica", "Sarah", "Karen", "Anna", "Laura", "Julia", "Claire", "Sophie", "Marie", "Ingrid", "Petra", "Carmen", "Lucía", "Elena"),
    ("m", "cyrillic"): ("Иван", "Пётр", "Сергей", "Андрей", "Дмитрий", "Николай", "Алексей", "Михаил"),
    ("f", "cyrillic"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"),
    ("m", "greek"): ("Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Παύλος", "Πέτρος", "Ανδρέας", "Σπύρος"),
    ("f", "greek"): ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Άννα", "Ειρήνη", "Δήμητρα", "Χριστίνα"),
}
SYLLABLES = {
    "latin": ("bar", "ben", "cal", "dor", "fen", "gar", "hal", "kel", "lan", "mor", "nor", "per", "ros", "sel", "tam", "ver"),
    "cyrillic": ("бар", "бел", "вол", "гор", "дор", "зар", "кал", "лан", "мор", "нов", "пер", "рос", "сел", "тар", "фед", "хол"),
    "greek": ("βαρ", "γαλ", "δορ", "ζαν", "καλ", "λαμ", "μαρ", "νικ", "παλ", "ραν", "σαλ", "ταν", "φιλ", "χαρ", "ψαλ", "ωρα"),
}
#: Words that introduce a person.
INTRODUCTIONS = ("my name is", "name is", "name:", "contact:", "signed,", "sincerely,", "regards,", "je m'appelle", "mon nom est", "nom:", "ich heiße", "mein Name ist", "Name:", "me llamo", "mi nombre es", "nombre:", "меня зовут", "με λένε")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_CAPITAL = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.? +"
_AFTER = "(?<=(?:" + "|".join(f"[{i[0].upper()}{i[0].lower()}]{i[1:]}" for i in INTRODUCTIONS) + r")[ \n]{1,2})"
_GIVEN = "(?:" + "|".join(n for ns in GIVEN.values() for n in ns) + ")"
#: Numbers as they are written in fr, es, de and en: a country code with an optional trunk zero, or that zero, and groups.
_ABROAD = r"(?:\+|00 ?)\d{1,3}[ .-]?(?:\(0\)[ .-]?)?"
_GROUPS = (
    r"(?:(?:\+|00 ?)33[ .-]?(?:\(0\)[ .-]?)?|0)[1-9](?:[ .-]?\d{2}){4}(?!\d)",  # 06 12 34 56 78
    r"(?:(?:\+|00 ?)34[ .-]?)?(?:[67]\d{2}(?:[ -]\d{3}){2}|[6-9]\d{2}(?:[ -]\d{2}){3}|[89]\d[ -]\d{3}(?:[ -]\d{2}){2})(?![ .,]?\d)",  # 612 345 678
    rf"(?=[+0])(?=(?:\D{{0,3}}\d){{9}})(?:{_ABROAD}|0)[1-9]\d{{1,4}}(?: ?[/-] ?|[ .])\d{{2,8}}(?:[ .-]\d{{2,5}}){{0,3}}(?!\d)",  # 0171 1234567, +44 20 7946 0958
)
#: Kinds and their patterns; where several begin at one place, the first wins.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+",
    "secret": r"(?i:password|passwd|pwd|token|secret|api[_-]?key)\s?[=:]\s?[\"']?[A-Za-z0-9_/+-]{8,}",
    "access": r"\bAKIA[0-9A-Z]{16}\b",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "card": r"(?<![\d-])(?:\d{4}[ -]?){3}\d{1,4}(?![\d-])|(?<![\d-])\d{4}[ -]?\d{6}[ -]?\d{4,5}(?![\d-])|(?<![\d.])\d{13,19}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "phone": r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]?\d{4}(?![\w])|(?<!\w)\+\d{8,15}(?!\d)|(?<![\w+.-])(?:" + "|".join(_GROUPS) + ")",
    "name": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLE}{_CAPITAL}(?: +{_CAPITAL})?|{_GIVEN} +{_CAPITAL}|{_AFTER}{_CAPITAL} +{_CAPITAL})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Cheap tests, one of which every entity meets, to spare most texts the patterns.
HINT = r"[0-9@=:]|AKIA"
NAME_HINT = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLE}|{_GIVEN} +|{_AFTER})\p{{Lu}}"
#: Draws after which shapes give way so that a free surrogate must turn up.
LOOSE = 6
#: Parts drawn in one task, about.
DRAWN = 8192


def _kind(m: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").when(x.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(title: Column, given: Column) -> Column:
    has = lambda g: title.rlike("^(?:" + "|".join(TITLES[g]) + r")\b")
    among = lambda g: given.isin([n for (x, _), ns in GIVEN.items() if x == g for n in ns])
    return F.when(has("m"), "m").when(has("f"), "f").when(among("f"), "f").when(among("m"), "m").otherwise("u")


def parts(m: Column) -> Column:
    """The parts of a mention: structs of the text before the part, its kind, the gender that a given name shows, its
    canonical form and its raw form."""
    kind = _kind(m)
    none = F.lit("")
    part = lambda before, kind, canon, raw, gender=none: F.struct(before.alias("before"), kind.alias("kind"), gender.alias("gender"), canon.alias("canon"), raw.alias("raw"))
    cut = lambda g: F.regexp_extract(m, r"^([\s\S]*[=:]\s?[\"']?)([A-Za-z0-9_/+-]{8,})$", g)
    digits = F.regexp_replace(m, "[^0-9]", "")
    title = F.regexp_extract(m, f"^({_TITLE})", 1)
    bare = F.substring(m, F.length(title) + 1, F.length(m))
    first, last = F.regexp_extract(bare, f"^({_CAPITAL})(?: +{_CAPITAL})$", 1), F.regexp_extract(bare, f"({_CAPITAL})$", 1)
    gap = F.regexp_extract(bare, f"^{_CAPITAL}( +){_CAPITAL}$", 1)
    given_kind = F.concat(F.lit("given_"), _script(first))
    surname_kind = F.concat(F.lit("surname_"), _script(last))
    name = F.when(first == "", F.array(part(title, surname_kind, F.lower(last), last))).otherwise(
        F.array(part(title, given_kind, F.lower(first), first, _gender(title, first)), part(gap, surname_kind, F.lower(last), last))
    )
    plain = F.array(part(none, kind, F.when(kind.isin("card", "phone", "ssn"), digits).when(kind == "email", F.lower(m)).when(kind == "iban", F.regexp_replace(m, " ", "")).otherwise(m), m))
    return F.when(kind == "name", name).when(kind == "secret", F.array(part(cut(1), kind, cut(2), cut(2)))).otherwise(plain)


def _bytes(seed: Column, n: Column) -> Column:
    """Hex digits of a keyed hash, two for each of n characters at least."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 32).cast("int")), lambda i: F.sha2(F.concat(seed, F.lit("|"), i.cast("string")), 256)), "")


def _byte(hexed: Column, j: Column) -> Column:
    return F.conv(F.substring(hexed, (2 * j + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _letter(alphabet: str, at: Column) -> Column:
    return F.substring(F.lit(alphabet), (at % len(alphabet) + 1).cast("int"), F.lit(1))


def _alike(x: Column, hexed: Column, hexadecimal: Column) -> Column:
    """Each digit and ASCII letter replaced by one of its kind; the rest stays."""
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def one(j):
        c, b = F.substring(x, (j + 1).cast("int"), F.lit(1)), _byte(hexed, j)
        return (
            F.when(hexadecimal == "x", _letter(num + "abcdef", b)).when(hexadecimal == "X", _letter(num + "ABCDEF", b))
            .when(c.between("0", "9"), _letter(num, b)).when(c.between("a", "z"), _letter(low, b)).when(c.between("A", "Z"), _letter(up, b)).otherwise(c)
        )

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(x) - 1), one), "")


def _luhn(body: Column) -> Column:
    """The body with its check digit."""
    n = F.length(body)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.floor(2 * F.substring(body, i, F.lit(1)).cast("int") / 10).cast("int") + 2 * F.substring(body, i, F.lit(1)).cast("int") % 10).otherwise(F.substring(body, i, F.lit(1)).cast("int")),
    )
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def draw(kind: Column, gender: Column, canon: Column, turn: Column, key: str) -> Column:
    """The surrogate of a part at its n-th draw."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, turn.cast("string"))
    hexed = _bytes(seed, F.length(canon))
    no = F.lit("")
    alike = _alike(canon, hexed, no)
    at = F.instr(canon, "@")
    domain = F.substring(canon, at + 1, F.length(canon))
    host = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
    new_host = _alike(host, _bytes(F.concat_ws("|", F.lit(key), F.lit("host"), host), F.length(host)), no)
    email = F.concat(_alike(F.substring(canon, F.lit(1), at - 1), hexed, no), F.when(turn >= LOOSE, turn.cast("string")).otherwise(no), F.lit("@"), new_host, F.substring(domain, F.length(host) + 1, F.length(domain)))
    octets = F.split(canon, r"\.")

    def octet(o, i):
        b = _byte(hexed, i)
        tight = F.when(F.length(o) == 3, 100 + b % 156).when(F.length(o) == 2, 10 + b % 90).otherwise(1 + b % 9)
        return F.when(turn >= LOOSE, 1 + b % 254).otherwise(tight).cast("string")

    ip = F.array_join(F.transform(octets, octet), ".")
    card = _luhn(F.concat(F.substring(canon, 1, 1), F.substring(alike, F.lit(2), F.length(canon) - 2)))
    # a trunk zero and the country codes of _GROUPS stay
    country = F.when(canon.rlike("^00"), 4).when(canon.startswith("0"), 1).when(canon.rlike("^(?:33|34|44|49)[0-9]{9,}$"), 2).otherwise(F.greatest(F.length(canon) - 10, F.lit(0)))
    phone = F.concat(F.substring(canon, F.lit(1), country), (2 + _byte(hexed, F.lit(0)) % 8).cast("string"), F.substring(alike, country + 2, F.length(canon)))
    hexadecimal = F.when(canon.rlike("^(?=.*[a-f])[0-9a-f]+$"), "x").when(canon.rlike("^(?=.*[A-F])[0-9A-F]+$"), "X").otherwise("")
    script = F.regexp_extract(kind, "_([a-z]+)$", 1)
    pick = lambda options, j: F.element_at(F.array(*[F.lit(o) for o in options]), (_byte(hexed, j) % len(options) + 1).cast("int"))

    def given(s):
        one = lambda j: F.when(gender == "f", pick(GIVEN["f", s], j)).when(gender == "m", pick(GIVEN["m", s], j)).otherwise(pick(GIVEN["m", s] + GIVEN["f", s], j))
        more = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(turn - 3, F.lit(0))), lambda j: pick(SYLLABLES[s], j + 3)), "")
        return F.when(turn == 0, one(F.lit(0))).when(turn < 3, F.concat(one(F.lit(0)), F.lit("-"), one(F.lit(1)))).otherwise(F.concat(one(F.lit(0)), F.lit("-"), F.initcap(more)))

    surname = lambda s: F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + turn), lambda j: pick(SYLLABLES[s], j)), ""))
    by_script = lambda f: F.when(script == "cyrillic", f("cyrillic")).when(script == "greek", f("greek")).otherwise(f("latin"))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
        .when(kind == "access", F.concat(F.lit("AKIA"), F.substring(alike, F.lit(5), F.lit(16)))).when(kind == "secret", _alike(canon, hexed, hexadecimal))
        .when(kind == "iban", F.concat(F.substring(canon, 1, 2), F.substring(alike, F.lit(3), F.length(canon)))).when(kind.startswith("given_"), by_script(given)).when(kind.startswith("surname_"), by_script(surname)).otherwise(alike)
    )


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for the distinct parts in found (kind, gender, canon).

    A given name that mentions show as male and female, or as neither, has no gender.  In each round the parts without a
    surrogate draw one; who draws what is taken, what occurs in the corpus as a part of this kind, or what a part with a
    smaller canonical form has drawn in this round, draws again in the next.  Rounds end when none is left over; most
    parts are settled in the first, and only the rest are looked at again.
    """
    name = F.col("kind").rlike("^(?:given|surname)_")
    shown = lambda g: F.max((F.col("gender") == g).cast("int"))
    gender = F.when(shown("m") > shown("f"), "m").when(shown("f") > shown("m"), "f").otherwise("")
    now = materialise(found.groupBy("kind", "canon").agg(gender.alias("gender")), "pii-parts")
    real = now.select("kind", F.col("canon").alias("folded"))
    settled, turn = None, 0
    while n := now.count():
        # a draw is costly: parts are dealt out evenly before it
        dealt = now.repartition(-(-n // DRAWN), "kind", "canon")
        drawn = dealt.withColumn("surrogate", draw(F.col("kind"), F.col("gender"), F.col("canon"), F.lit(turn), key))
        drawn = materialise(drawn.withColumn("folded", F.when(name, F.lower("surrogate")).otherwise(F.col("surrogate"))), "pii-drawn")
        # the few names of the first draw are drawn by very many: an aggregation combines them before the shuffle
        free = drawn.groupBy("kind", "folded").agg(F.min("canon").alias("canon")).join(real, ["kind", "folded"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "folded"), ["kind", "folded"], "left_anti")
        free = free.select("kind", "canon", F.lit(True).alias("free"))
        checked = materialise(drawn.join(free, ["kind", "canon"], "left").withColumn("free", F.coalesce("free", F.lit(False))), "pii-checked")
        got, now, turn = checked.where("free"), checked.where("not free").select("kind", "canon", "gender"), turn + 1
        settled = got if settled is None else settled.unionByName(got)
    if settled is None:
        return found.where("false").select("kind", "canon", F.lit("").alias("surrogate"))
    return settled.select("kind", "canon", "surrogate")


def _shaped(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the format of a mention: its punctuation, its capitals."""
    digit = lambda j: F.substring(raw, j, F.lit(1)).rlike(r"\d")
    seen = lambda j: F.length(F.regexp_replace(F.substring(raw, F.lit(1), j), "[^0-9]", ""))
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), lambda j: F.when(digit(j), F.substring(surrogate, seen(j), F.lit(1))).otherwise(F.substring(raw, j, F.lit(1)))), "")
    letter = lambda j: F.substring(raw, j, F.lit(1)) != " "
    spaced = F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), lambda j: F.when(letter(j), F.substring(surrogate, F.length(F.regexp_replace(F.substring(raw, F.lit(1), j), " ", "")), F.lit(1))).otherwise(F.lit(" "))), "")
    shouted = kind.rlike("^(?:given|surname)_|^email") & (raw == F.upper(raw)) & (raw != F.lower(raw))
    return F.when(kind.isin("card", "phone", "ssn"), numbers).when(kind == "iban", spaced).when(shouted, F.upper(surrogate)).otherwise(surrogate)


def replace_pii(docs: DataFrame, *, text: str = "text", key: str = "lexquarry") -> DataFrame:
    """docs with every entity in ``text`` replaced, and n_entities (number of mentions) and kinds (theirs, in order).

    Null texts stay null and have no entities.  The same key gives the same surrogates for the same corpus.  Repeated rows
    are replaced alike.  Columns of docs with the added names are replaced, all others stay.  An empty table gives none.
    """
    base = docs.drop("n_entities", "kinds")
    names = base.columns
    gaps, sorts, pieces, row = (free_name(base, x) for x in ("gaps", "sorts", "pieces", "row"))
    has = F.coalesce((F.col(text).rlike(HINT) | F.col(text).rlike(NAME_HINT)) & F.col(text).rlike(ANY), F.lit(False))
    rest = base.where(~has).withColumn("n_entities", F.lit(0).cast("long")).withColumn("kinds", F.array().cast("array<string>"))
    mentions = free_name(base, "mentions")
    found = base.where(has).withColumn(mentions, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).withColumn(gaps, F.split(text, ANY, -1))
    found = found.withColumn(sorts, F.transform(mentions, _kind)).withColumn(pieces, F.transform(mentions, parts)).withColumn(row, F.monotonically_increasing_id())
    found = materialise(found.drop(mentions, text), "pii-found")
    lean = found.select(F.col(row).alias("row"), F.col(gaps).alias("gaps"), F.col(pieces).alias("pieces"))
    flat = lean.select("row", "gaps", F.posexplode("pieces").alias("i", "ps")).select("row", "i", F.element_at("gaps", F.col("i") + 1).alias("gap"), F.posexplode("ps").alias("j", "p"))
    flat = flat.select("row", "i", "j", F.when(F.col("j") == 0, F.col("gap")).otherwise("").alias("gap"), "p.*")
    chosen = surrogates(flat.select("kind", "gender", "canon"), key)
    piece = F.concat("gap", "before", _shaped(F.col("kind"), F.col("raw"), F.col("surrogate")))
    put = flat.join(chosen, ["kind", "canon"]).select("row", F.struct("i", "j", piece.alias("s")).alias("x"))
    put = put.groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["s"]), "").alias("head"))
    head = free_name(found, "head")
    made = found.join(put.select(F.col("row").alias(row), F.col("head").alias(head)), row).withColumn(text, F.concat(head, F.element_at(gaps, -1)))
    made = made.withColumn("n_entities", F.size(sorts).cast("long")).withColumn("kinds", F.col(sorts))
    out = [*names, "n_entities", "kinds"]
    return rest.select(*out).unionByName(made.select(*out))


def op3_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """:func:`replace_pii` of ``documents``: doc_id, n_entities, kinds, text.  Null texts stay null, repeated rows are alike."""
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_entities", "kinds", "text")
