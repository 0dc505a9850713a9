"""A plain sequential model of the engine: dictionaries, one operation or query after the other."""

from __future__ import annotations

import math
from collections import OrderedDict, defaultdict

from lexquarry.functions import exact
from lexquarry.functions.langs import RANGES


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def allowed(size: int) -> int:
    return 0 if size <= 3 else 1 if size <= 6 else 2 if size <= 9 else 3


class Bucket:
    def __init__(self):
        self.births, self.ids, self.links, self.terms = 0, {}, defaultdict(list), defaultdict(list)
        self.words: set[str] = set()


class Model:
    def __init__(self, config):
        self.config, self.buckets = config, defaultdict(Bucket)
        self.published: dict = {}

    def lex(self, text, lang, cleanup=True):
        return exact.lex(text, self.config, lang, cleanup)

    def push(self, c, b, o, text, lang=None):
        k = self.buckets[c, b]
        if o not in k.ids:
            k.ids[o] = k.births
            k.births += 1
        iid = k.ids[o]
        for _, term, _ in self.lex(text, lang):
            if term not in k.terms[iid]:
                k.links[term].insert(0, iid)
                k.terms[iid].append(term)
                for lost in k.links[term][self.config.store.retain_word_objects :]:
                    k.links[term].remove(lost)
                    k.terms[lost].remove(term)
                    if not k.terms[lost]:  # an object without terms goes
                        k.ids = {x: i for x, i in k.ids.items() if i != lost}
            if len(term.encode()) <= 40:
                k.words.add(term)

    def pop(self, c, b, o, text):
        k = self.buckets[c, b]
        if o not in k.ids:
            return 0
        iid = k.ids[o]
        gone = [t for _, t, _ in self.lex(text, "none") if t in k.terms[iid]]
        rest = [t for t in k.terms[iid] if t not in gone]
        if gone and not rest:
            self.flusho(c, b, o)
        else:
            for t in gone:
                k.links[t].remove(iid)
                if not k.links[t]:
                    k.words.discard(t)
            k.terms[iid] = rest
        return len(gone)

    def flusho(self, c, b, o):
        k = self.buckets[c, b]
        if o not in k.ids:
            return 0
        iid = k.ids.pop(o)
        for t in k.terms[iid]:
            k.links[t].remove(iid)
        return len(k.terms.pop(iid))

    def flushb(self, c, b):
        self.buckets.pop((c, b), None)
        self.published.pop((c, b), None)

    def flushc(self, c):
        for key in [k for k in self.buckets if k[0] == c]:
            self.flushb(*key)

    def consolidate(self):
        self.published = {key: sorted(k.words, key=str.encode)[: self.config.store.max_words] for key, k in self.buckets.items()}

    def in_script(self, term, word):
        suffix = word[len(term) :]
        for name, spans in list(RANGES.items())[1:]:
            if any(a <= ord(x) <= z for x in term for a, z in spans) and any(ord(x) > 0x24F for x in term):
                return all(any(a <= ord(x) <= z for a, z in RANGES[name]) for x in suffix)
        return all(ord(x) <= 0x24F for x in suffix)

    def query(self, c, b, text, limit, offset=0, lang=None):
        s, k = self.config.search, self.buckets[c, b]
        names = {i: o for o, i in k.ids.items()}
        n = k.births
        tokens = list(OrderedDict.fromkeys(self.lex(text, lang)))
        most = self.config.store.retain_word_objects
        gate = s.query_minimum_term_idf if n >= s.query_minimum_term_idf_minimum_object_count else 0
        cells: dict[int, list] = {}
        budget = [s.query_alternates_try]
        weight = lambda df: math.log(1 + (max(n, df) - df + 0.5) / (df + 0.5))

        def put(iid, i, score):
            new = iid not in cells
            row = cells.setdefault(iid, [None] * len(tokens))
            row[i] = score if row[i] is None else (min if s.merge == "min" else max)(row[i], score)
            return new

        def exact_phase():
            for i, (_, t, _) in enumerate(tokens):
                df = len(k.links.get(t, []))
                if df and gate and math.log(n / df) < gate:
                    continue
                for iid in list(k.links.get(t, [])):
                    put(iid, i, weight(df))
                    if len(cells) >= most:
                        return

        def alternate(i, term, word, base):
            df = len(k.links.get(word, []))
            if word == term or not df or gate and math.log(n / df) < gate:
                return
            for iid in list(k.links[word])[: budget[0]]:
                budget[0] -= 1
                put(iid, i, base * weight(df))

        exact_phase()
        words = self.published.get((c, b), [])
        if len(cells) < most and s.prefix_matching_enabled:
            for i, (_, t, size) in enumerate(tokens):
                for w in words:
                    if w.startswith(t) and self.in_script(t, w):
                        alternate(i, t, w, 20 / (20 + abs(size - len(w.encode())) / size))
        if len(cells) < most and s.fuzzy_matching_enabled:
            for i, (special, t, size) in enumerate(tokens):
                for f in range(1, 0 if special else allowed(size) + 1):
                    for w in words:
                        if budget[0] and distance(t, w) <= f:
                            alternate(i, t, w, 1 - min(f / size, 1))
        rows = [(i, row) for i, row in cells.items() if not any(x for x, _, _ in tokens) or None not in row]
        rows = sorted(rows, key=lambda r: -round(sum(x or 0 for x in r[1]) / len(tokens), 9))
        return [names[i] for i, _ in rows[offset : offset + limit] if i in names]
