"""Language identification of texts and of the spans of mixed-language texts.

The script of a word narrows the languages that it may be in; letter trigrams score it for each of these; Viterbi with
a penalty for switching labels the words.  A text for which no run of words can pay for a switch is settled without
the dynamic programme: if every run of words gains at most half the penalty in another language than the overall best
one, no path with switches can win.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import column, fold, map_blocks, table, texts

#: Labelled rows that the fit uses at most (expected size of a sample by hash).
MAX_LABELLED = 20_000
#: Cost of a switch and the most that one word counts for, in nats.
SWITCH, WORD_MOST = 14.0, 4.0
#: Words that a worker remembers.
MEMO = 300_000
UND = "und"


def _class(kinds: str) -> str:
    """The code points of the general categories that begin with one of ``kinds``, as ranges of a regular expression."""
    out, start = [], None
    for c in range(0x110001):
        within = c < 0x110000 and unicodedata.category(chr(c))[0] in kinds
        if within and start is None:
            start = c
        elif not within and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


#: A word: a letter and the letters and marks that follow; numeric signs are none.
_WORD = re.compile(f"[{_class('L')}][{_class('LM')}]*")
_ASCII_WORD = re.compile("[A-Za-z]+")
#: First code points of blocks of letters and the script that begins there.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0x20000, "Han"), (0x30000, "Other"),
)
_STARTS = np.array([a for a, _ in SCRIPTS])


def script(word: str) -> str:
    """The script of a word's first letter."""
    return SCRIPTS[int(np.searchsorted(_STARTS, ord(word[0]), side="right")) - 1][1]


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class LanguageModel:
    def __init__(self, counts: dict[str, Counter], scripts: dict[str, Counter], switch: float = SWITCH):
        """counts: trigrams by language; scripts: words by language and script."""
        self.langs, self.switch = sorted(counts, key=str.encode), switch
        size = len(set().union(*counts.values())) + 1 if counts else 1
        totals = np.array([sum(counts[x].values()) for x in self.langs], dtype=float)
        # row 0 is that of all trigrams that were not seen
        self.place = {g: i + 1 for i, g in enumerate(sorted(set().union(*counts.values())))} if counts else {}
        self.rows = np.tile(np.log(0.5 / (totals + 0.5 * size)), (len(self.place) + 1, 1))
        for j, x in enumerate(self.langs):
            at = np.fromiter((self.place[g] for g in counts[x]), dtype=np.int64, count=len(counts[x]))
            self.rows[at, j] = np.log((np.array(list(counts[x].values()), dtype=float) + 0.5) / (totals[j] + 0.5 * size))
        seen = defaultdict(list)
        for j, x in enumerate(self.langs):
            whole = sum(scripts[x].values())
            for s, n in scripts[x].items():
                if n >= 0.01 * whole:
                    seen[s].append(j)
        #: For each block of SCRIPTS which languages are candidates.
        self.candidates = np.array([[j in seen[s] for j in range(len(self.langs))] for _, s in SCRIPTS], dtype=bool).reshape(len(SCRIPTS), len(self.langs))

    def words(self, words: list[str]) -> np.ndarray:
        """For each word and language, nats below the best one; no more than WORD_MOST.  A script that no language uses decides nothing."""
        if not words or not self.langs:
            return np.zeros((len(words), len(self.langs)))
        get, flat, starts = self.place.get, [], []
        for w in words:
            v = f"^{w}$"
            starts.append(len(flat))
            flat += [get(v[i : i + 3], 0) for i in range(len(w))]
        s = np.add.reduceat(self.rows[flat], starts, axis=0)
        among = self.candidates[np.searchsorted(_STARTS, [ord(w[0]) for w in words], side="right") - 1]
        best = np.where(among, s, -np.inf).max(axis=1, keepdims=True)
        out = np.where(among, np.maximum(s - np.where(np.isfinite(best), best, 0), -WORD_MOST), -WORD_MOST)
        out[~among.any(axis=1)] = 0
        return out

    def word(self, w: str) -> np.ndarray:
        return self.words([w])[0]


def viterbi(s: np.ndarray, switch: float) -> np.ndarray:
    """The best path through scores (words x languages); ties to staying, then to the earlier language."""
    n, k = s.shape
    rows, back = s.tolist(), []
    best = list(rows[0])
    for row in rows[1:]:
        top = max(best)
        at, jump = best.index(top), top - switch
        back.append([at if jump > b else j for j, b in enumerate(best)])
        best = [x + (jump if jump > b else b) for x, b in zip(row, best)]
    j = best.index(max(best))
    path = [j]
    for b in reversed(back):
        j = b[j]
        path.append(j)
    return np.array(path[::-1])


class Labeller:
    """Labels blocks of texts; holds the scores of the words seen."""

    def __init__(self, model: LanguageModel):
        self.model, self.memo = model, {}
        self.scores = np.zeros((1024, max(1, len(model.langs))))

    def paths(self, docs: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each list of words the language of each word, and each language's score over all of them."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list(set().union(*docs).difference(self.memo))
        for a in range(0, len(new), 1 << 14):
            some = new[a : a + (1 << 14)]
            n = len(self.memo)
            while n + len(some) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[n : n + len(some), : len(self.model.langs)] = self.model.words(some)
            self.memo.update(zip(some, range(n, n + len(some))))
        at = self.memo.__getitem__
        each = [self.scores[np.fromiter(map(at, d), dtype=np.int64, count=len(d))] for d in docs]
        return self.settle(each), [s.sum(axis=0) for s in each]

    def settle(self, each: list[np.ndarray]) -> list[np.ndarray]:
        switch, out = self.model.switch, []
        for s in each:
            if not len(s):
                out.append(np.zeros(0, dtype=np.int64))
                continue
            j = int(s.sum(axis=0).argmax())
            c = np.cumsum(s - s[:, j : j + 1], axis=0)
            low = np.minimum(np.minimum.accumulate(c, axis=0), 0)
            gain = np.maximum(c[0], 0) if len(c) == 1 else np.maximum((c[1:] - low[:-1]).max(axis=0), c[0])
            out.append(np.full(len(s), j) if gain.max() <= switch / 2 else viterbi(s, switch))
        return out


def summarise(model: LanguageModel, words: list[str], path: np.ndarray, total: np.ndarray) -> tuple[str, float]:
    """The language with the most letters, and its share of the letters times its odds over the whole text."""
    if not words or not model.langs:
        return UND, 0.0
    j, share = int(path[0]), 1.0
    if (path != j).any():
        letters = np.bincount(path, [len(w) for w in words], len(model.langs))
        j = int(letters.argmax())
        share = letters[j] / letters.sum()
    sure = 1 / np.exp(np.minimum(total - total[j], 50)).sum()
    return model.langs[j], float(share * sure)


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", max_labelled: int = MAX_LABELLED) -> LanguageModel:
    """Fit on the rows of docs whose language is known; more than ``max_labelled`` are sampled by hash to about that many.

    Rows with a null language or text are left out, a null key is one like others, equal rows count each, and without rows
    there is a model that knows no language.  The trigrams of the labelled rows, and only theirs, reach the driver.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64(F.lit("fit"), "_k", "text"), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))

    def count(block):
        found: dict[tuple, Counter] = defaultdict(Counter)
        for t, x in zip(texts(block), column(block, "lang").to_pylist()):
            for w, n in Counter(words_of(t)).items():
                found["script", x][script(w)] += n
                mine = found["gram", x]
                for g in grams(w):
                    mine[g] += n
        rows = [(kind, x, g, n) for (kind, x), c in found.items() for g, n in c.items()]
        return dict(zip(("kind", "lang", "item", "n"), zip(*rows))) if rows else {"kind": [], "lang": [], "item": [], "n": []}

    total = map_blocks(known, lambda: count, "kind string, lang string, item string, n long").groupBy("kind", "lang", "item").agg(F.sum("n").alias("n"))
    counts, scripts = defaultdict(Counter), defaultdict(Counter)
    for r in total.collect():
        (counts if r["kind"] == "gram" else scripts)[r["lang"]][r["item"]] += r["n"]
    return LanguageModel(dict(counts), scripts)


def words_of(text: str) -> list[str]:
    """The words of a text in lower case.  Where lower-casing lengthens it, words are found first: a new mark would split one."""
    low = text.lower()
    if low.isascii():
        return _ASCII_WORD.findall(low)
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", spans: bool = True) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and, if asked for, spans (start, end, lang) in code points.

    Null texts and texts without a letter are ``und`` with score 0 and no spans.  Ties go to the language that sorts
    first by code point.  Columns of docs with the added names are replaced.
    """
    base = docs.drop("lang_pred", "score", "spans")
    names = base.columns
    added = T._parse_datatype_string("lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled rows

    def make():
        m = shared.value
        labeller = Labeller(m)

        def work(block):
            raw = [t or "" for t in texts(block, text)]
            words = [words_of(t) for t in raw]
            paths, totals = labeller.paths(words) if m.langs else ([np.zeros(0)] * len(words),) * 2
            said = [summarise(m, w, p, s) for w, p, s in zip(words, paths, totals)]
            out = {f: column(block, f) for f in names} | {"lang_pred": [x for x, _ in said], "score": [x for _, x in said]}
            return out | ({"spans": [spans_of(m, t, p) for t, p in zip(raw, paths)]} if spans else {})

        return work

    return map_blocks(base, make, T.StructType(base.schema.fields + added.fields), weigh=text)


def spans_of(model: LanguageModel, text: str, path: np.ndarray) -> list[dict]:
    """Runs of words of one language; path has a place for each word of the text as written."""
    if len(path) and model.langs and (path == path[0]).all():  # one run: its first and last word are enough
        first, last = _WORD.search(text), None
        for last in _WORD.finditer(text, max(first.start(), len(text) - 200)):
            pass
        if last and (last.end() - last.start() < 100 or last.start() == first.start()):
            return [{"start": first.start(), "end": last.end(), "lang": model.langs[path[0]]}]
    found = [m.span() for m in _WORD.finditer(text)]
    if len(found) != len(path) or not model.langs:
        return []
    out: list[dict] = []
    for (a, b), j in zip(found, path.tolist()):
        if out and out[-1]["lang"] == model.langs[j]:
            out[-1]["end"] = b
        else:
            out.append({"start": a, "end": b, "lang": model.langs[j]})
    return out


def op6_language_spans(spark, sf_dir: str) -> DataFrame:
    """:func:`identify` on ``documents``: doc_id, held_out, lang_pred, score, spans; texts without a letter are ``und``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(fold("doc_id", 4) != 2))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "spans")
