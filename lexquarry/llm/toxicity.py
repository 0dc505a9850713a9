"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words and frequent word beginnings whose presence differs between the labels by more than chance would
give over the whole vocabulary; their inverse document frequencies are counted over all documents.  The labelled
examples that hold such a term (a bounded sample) form an inverted index in blocks.  For a document, the largest
weights of each term in each block bound the cosines of that block; blocks are opened by falling bound until no
bound can reach the k nearest found, so the k nearest are exact.  Their votes, weighted by nearness, are calibrated
by leaving each example out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import column, fold, labelled, map_blocks, materialise, table, texts, tidy

#: Labelled rows that the fit uses at most, neighbours, and entries of a block.
MAX_LABELLED, NEIGHBOURS, BLOCK = 20_000, 15, 64
#: How much more often than overall the texts with a term are toxic, at least.
LIFT = 3.0
#: Results that a worker remembers, for vectors of so many terms at most: these come again and again.
MEMO, MEMO_TERMS = 4_000, 4
#: Letters of the word beginnings, and the counts that are marked.
BEGINNINGS, COUNTS = (4, 5), (1, 2, 4, 8)
_SPLIT = re.compile(r"[\W\d_]+")


def words_of(text: str | None) -> Counter:
    return Counter(filter(None, _SPLIT.split((text or "").lower())))


def features(counts: Counter, known=None) -> Counter:
    """Words with their counts, and marks ``beginning~n`` of word beginnings that occur n times at least.

    The marks tell a text that holds one such word by chance from one that is full of them, which the length of a
    cosine's vectors hides.  known: the beginnings to look at (all, if none are given).
    """
    out, begun = Counter(counts), Counter()
    for w, n in counts.items():
        for k in BEGINNINGS:
            if len(w) >= k and (known is None or w[:k] in known):
                begun[w[:k]] += n
    for f, n in begun.items():
        for c in COUNTS:
            if n >= c:
                out[f"{f}~{c}"] = 1
    return out


def _distinct_features(block: pa.RecordBatch) -> dict:
    out, ys = [], column(block, "_y").to_pylist()
    seen: dict[str, list[int]] = {}
    for t, y in zip(texts(block), ys):
        for f in features(words_of(t)):
            pair = seen.setdefault(f, [0, 0])
            pair[y] += 1
    out = list(seen)
    return {"term": out, "clean": [seen[f][0] for f in out], "toxic": [seen[f][1] for f in out]}


def select_terms(rows: DataFrame, n0: int, n1: int) -> list[str]:
    """Terms by the log-likelihood ratio; the limit grows with the vocabulary so that about one term passes by chance."""
    counts = map_blocks(rows, lambda: _distinct_features, "term string, clean long, toxic long", most=1 << 19).groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")).where("a + b >= 3")
    counts = materialise(counts, "tox-terms")
    x, n = lambda k, share: F.when(k > 0, k * F.log(k / share)).otherwise(0.0), float(n0 + n1)
    a, b = F.col("a"), F.col("b")
    both = a + b
    g = 2 * (x(a, both * (n0 / n)) + x(b, both * (n1 / n)) + x(n0 - a, (n - both) * (n0 / n)) + x(n1 - b, (n - both) * (n1 / n)))
    lifted = b / both >= min(0.5, LIFT * n1 / n)  # terms that speak for a toxic text, not those of a language or topic
    ranked = counts.where(lifted).withColumn("g", g).where(F.col("g") > 10)
    size = max(2, counts.count())
    least = max(10.0, 2 * math.log(size) - math.log(math.log(size)) - 1.14)
    return sorted(r["term"] for r in ranked.where(F.col("g") >= least).select("term").collect())


class BlockMaxIndex:
    """Unit vectors in blocks of rows; exact k nearest by cosine.

    Equal vectors are one entry that stands for its rows.  ``peaks`` holds the largest weight of each term in each block;
    the entries of a block lie together and are scored at once.
    """

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        alike: dict[tuple, list[int]] = {}
        for i, v in enumerate(vectors):
            alike.setdefault(tuple(sorted((t, round(w, 12)) for t, w in v.items())), []).append(i)
        order = sorted(alike, key=lambda v: sorted(v, key=lambda x: -x[1])[:2])  # similar entries share blocks
        self.rows = [alike[v] for v in order]
        self.n, self.blocks = len(order), -(-len(order) // BLOCK)
        self.terms = np.array([t for v in order for t, _ in v], dtype=np.int64)
        self.weights = np.array([w for v in order for _, w in v])
        self.start = np.cumsum([0] + [len(v) for v in order])
        self.entry = np.repeat(np.arange(self.n), np.diff(self.start))
        self.peaks = np.zeros((n_terms, self.blocks))
        np.maximum.at(self.peaks, (self.terms, self.entry // BLOCK), self.weights)
        self.query = np.zeros(n_terms)

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, row) of the k largest cosines above 0.  Blocks are opened by falling bound; ties go to the entry found
        first, and within an entry to the smaller row."""
        terms, weights = np.fromiter(query, dtype=np.int64), np.fromiter(query.values(), dtype=float)
        bound = weights @ self.peaks[terms]
        self.query[terms] = weights
        want = k + (without >= 0)
        best_s, best_e = np.zeros(0), np.zeros(0, dtype=np.int64)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best_s) >= want and bound[b] <= best_s[-1]:
                break
            lo, hi = b * BLOCK, min(self.n, (b + 1) * BLOCK)
            x, y = self.start[lo], self.start[hi]
            score = np.bincount(self.entry[x:y] - lo, self.weights[x:y] * self.query[self.terms[x:y]], hi - lo)
            at = np.flatnonzero(score > (best_s[-1] if len(best_s) >= want else 0))
            if len(at):
                best_s, best_e = np.append(best_s, score[at]), np.append(best_e, lo + at)
                first = np.argsort(-best_s, kind="stable")[:want]
                best_s, best_e = best_s[first], best_e[first]
        self.query[terms] = 0
        found: list[tuple[float, int]] = []
        for s, e in zip(best_s.tolist(), best_e.tolist()):
            found += [(s, i) for i in self.rows[e][: k + 1] if i != without]
            if len(found) >= k:
                break
        return found[:k]


class ToxicityModel:
    def __init__(self, terms: list[str], idf: np.ndarray, ids: list, vectors: list[dict], toxic: np.ndarray, empty: tuple[int, int], k: int = NEIGHBOURS):
        self.terms, self.known = {t: i for i, t in enumerate(terms)}, beginnings(terms)
        self.idf, self.ids, self.toxic, self.k = idf, ids, toxic, k
        self.index = BlockMaxIndex(vectors, len(terms))
        self.memo: dict[tuple, tuple] = {}
        self.empty_score = (empty[1] + 0.5) / (sum(empty) + 1)
        votes = np.array([self.vote(self.index.nearest(v, k, without=i)) for i, v in enumerate(vectors)])
        self.a, self.b = calibrate(votes, toxic)

    def vector(self, text: str | None) -> dict[int, float]:
        return unit(term_counts(text, self.terms, self.known), self.idf)

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of the toxic among the nearest, weighted by 1 / (distance + 0.1); two shares of a half keep few votes from being sure."""
        weights = [1 / (1.1 - s) for s, _ in near]
        return (sum(w for w, (_, i) in zip(weights, near) if self.toxic[i]) + 0.5) / (sum(weights) + 1)

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        v = self.vector(text)
        if not v:
            return self.empty_score, []
        key = tuple(sorted(v.items())) if len(v) <= MEMO_TERMS else None
        if key in self.memo:
            return self.memo[key]
        near = self.index.nearest(v, self.k)
        found = (float(1 / (1 + np.exp(-(self.a * self.vote(near) + self.b)))) if near else self.empty_score, near)
        if key and len(self.memo) < MEMO:
            self.memo[key] = found
        return found


def beginnings(terms) -> frozenset:
    return frozenset(t.partition("~")[0] for t in terms if "~" in t)


def term_counts(text: str | None, terms: dict[str, int], known: frozenset) -> Counter:
    """How often each known term occurs in a text."""
    return Counter({terms[f]: n for f, n in features(words_of(text), known).items() if f in terms})


def unit(counts: Counter, idf: np.ndarray) -> dict[int, float]:
    v = {t: (1 + math.log(n)) * float(idf[t]) for t, n in counts.items()}
    length = math.sqrt(sum(x * x for x in v.values()))
    return {t: x / length for t, x in v.items()} if length else {}


def calibrate(votes: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic curve over the votes (Newton's method, lightly regularised); needs both labels, else votes pass through a fixed one."""
    a, b = 6.0, -3.0
    if len(votes) < 20 or y.min() == y.max():
        return a, b
    x, w = np.c_[votes, np.ones(len(votes))], np.array([a, b])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) + 0.1 * (w - (6.0, -3.0))
        h = (x.T * (p * (1 - p))) @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.1)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Fit on the labelled rows of docs; more than ``max_labelled`` are sampled by hash to about that many.

    Rows with a null label or key are left out; of several labels of a key the largest counts; equal rows count once; null
    texts have no terms.  Without rows of both labels there are no terms, and every text gets the labels' smoothed share.
    Document frequencies of the terms are counted over all rows of docs.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    n = marks.count()
    if n > max_labelled:
        marks = marks.where(F.pmod(F.xxhash64(F.lit("fit"), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    rows = labelled(docs, marks, key, text, max_labelled)
    have = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = have.get(0, 0), have.get(1, 0)
    terms = select_terms(rows, n0, n1) if n0 and n1 else []
    place, known = {t: i for i, t in enumerate(terms)}, beginnings(terms)

    def count_docs():
        def work(block):
            df = np.zeros(len(place), dtype=np.int64)
            for t in texts(block):
                for i in term_counts(t, place, known):
                    df[i] += 1
            at = np.flatnonzero(df)
            return {"t": at, "n": df[at]}

        return work

    n_docs = docs.count()
    df = np.zeros(len(terms))
    if terms:
        for r in map_blocks(docs.select(F.col(text).alias("text")), count_docs, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
            df[r["t"]] = r["n"]
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    def examples():
        def work(block):
            vs = [unit(term_counts(t, place, known), idf) for t in texts(block)]
            return {"id": [str(x) for x in column(block, "_k").to_pylist()], "t": [list(v) for v in vs], "w": [list(v.values()) for v in vs], "y": column(block, "_y").to_pylist()}

        return work

    got = sorted(map_blocks(rows, examples, "id string, t array<int>, w array<double>, y int").collect(), key=lambda r: (len(r["id"]), r["id"], r["t"])) if terms else []
    held = [r for r in got if r["t"]]
    empty = Counter(r["y"] for r in got if not r["t"]) if terms else Counter({0: n0, 1: n1})
    return ToxicityModel(terms, idf, [r["id"] for r in held], [dict(zip(r["t"], r["w"])) for r in held], np.array([r["y"] for r in held], dtype=float), (empty[0], empty[1]))


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1), predicted and evidence (the nearest labelled examples: id, cosine, toxic).

    Null, empty and term-free texts get the share of toxic ones among the labelled texts without terms, and no evidence.
    Ties among neighbours go to the example found first, the same one on every run.  Columns of docs with the added names are replaced.
    """
    base = docs.drop("score", "predicted", "evidence")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_labelled
    added = T._parse_datatype_string("score double, predicted int, evidence array<struct<id:string,cosine:double,toxic:int>>")
    schema, names = T.StructType(base.schema.fields + added.fields), base.columns

    def make():
        m = shared.value

        def work(block):
            scored = [m.score(t) for t in texts(block, text)]
            out = {f: column(block, f) for f in names}
            return out | {"score": [s for s, _ in scored], "predicted": [int(s >= threshold) for s, _ in scored], "evidence": [[{"id": m.ids[i], "cosine": c, "toxic": int(m.toxic[i])} for c, i in near] for _, near in scored]}

        return work

    return map_blocks(base, make, schema, weigh=text)


def op2_toxicity_knn(spark, sf_dir: str) -> DataFrame:
    """:func:`score` of ``documents``: doc_id, held_out, score, predicted; null and empty texts have a score like others."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    with tidy():
        model = train(docs, labels.where(fold("doc_id", 3) != 1))
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
