"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Shallow boosted trees are grown over text statistics of a bounded labelled sample; every path from a root becomes a
conjunctive rule; an L1-penalised logistic regression keeps few of the rules; the kept ones become one Column of
CASE expressions, so that scoring is a single scan inside whole-stage code generation, without Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import WORD, fold, free_name, labelled, table, tidy

#: Labelled rows that the fit uses at most (expected size of a sample by hash).
MAX_LABELLED = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text, as columns; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    words = F.greatest(F.regexp_count(t, F.lit(WORD)), F.lit(1))
    lines = F.split(t, "\n", -1)
    per_char = lambda pattern: F.regexp_count(t, F.lit(pattern)) / chars
    return {
        "log_chars": F.log1p(F.length(t)).cast("double"),
        "word_chars": F.length(t) / words,
        "upper": per_char("[A-Z]"),
        "digits": per_char("[0-9]"),
        "stops": per_char("[.,;:]"),
        "bangs": per_char("[!?]"),
        "symbols": per_char(r"[#$%&*+/<=>@\\^_`{|}~\[\]]"),
        "lone_symbols": F.regexp_count(t, F.lit(r" [^\p{L}\p{N}\s](?= )")) / words,
        "line_words": words / F.size(lines),
        "new_lines_share": F.size(F.array_distinct(lines)) / F.size(lines),
    }


def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 10) -> list[tuple]:
    """Paths of gradient-boosted trees: tuples of (feature, is_above, threshold), without repeats."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    logit, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        level = [(np.arange(len(y)), ())]
        for d in range(depth + 1):
            after = []
            for rows, path in level:
                if path:
                    rules[tuple(sorted(path))] = None
                best = (1e-9, None, None)
                if d < depth and len(rows) >= 2 * least:
                    g, h = grad[rows], hess[rows]
                    whole = g.sum() ** 2 / (h.sum() + 1)
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        b = bins[rows, j]
                        gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g, h, None))
                        gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                        gain[(ns < least) | (len(rows) - ns < least)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], j, k)
                _, j, k = best
                if j is None:
                    logit[rows] += rate * grad[rows].sum() / (hess[rows].sum() + 1)
                else:
                    above = bins[rows, j] > k
                    after += [(rows[~above], (*path, (j, False, float(edges[j][k])))), (rows[above], (*path, (j, True, float(edges[j][k]))))]
            level = after
    return list(rules)


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient."""
    n, k = m.shape
    step = 4 * n / (np.linalg.norm(np.c_[m, np.ones(n)], 2) ** 2)
    w = v = np.zeros(k + 1)
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    v, t = w.copy(), 1.0
    a = np.c_[m, np.ones(n)]
    for _ in range(rounds):
        z = v - step * (a.T @ (1 / (1 + np.exp(-a @ v)) - y)) / n
        new = np.sign(z) * np.maximum(np.abs(z) - step * penalty, 0)
        new[-1] = z[-1]
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:-1], float(w[-1])


@dataclass
class RuleEnsemble:
    names: list[str]
    rules: list[tuple] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    @classmethod
    def fit(cls, names: list[str], x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> RuleEnsemble:
        """One class only, or no rows: no rules, and the score is the smoothed share of ones."""
        share = (y.sum() + 1) / (len(y) + 2)
        model = cls(names, bias=float(np.log(share / (1 - share))))
        rules = boosted_rules(x, y) if 0 < y.sum() < len(y) else []
        if rules:
            m = np.stack([np.all([(x[:, j] > c) == above for j, above, c in r], axis=0) for r in rules], axis=1).astype(float)
            w, model.bias = lasso_logistic(m, y, penalty)
            model.rules, model.weights = zip(*[(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-4]) if np.abs(w).max() > 1e-4 else ([], [])
        return model

    def score(self, stats: dict[str, Column]) -> Column:
        """The ensemble as one column."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            holds = None
            for j, above, c in rule:
                test = stats[self.names[j]] > c if above else stats[self.names[j]] <= c
                holds = test if holds is None else holds & test
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{self.names[j]} {'>' if a else '<='} {c:.4g}" for j, a, c in r) for r, w in sorted(zip(self.rules, self.weights), key=lambda x: -abs(x[1]))]


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> RuleEnsemble:
    """Fit on the labelled rows of docs; where there are more than ``max_labelled``, on a sample of about that size by hash.

    Rows with a null label or key are left out; of several labels of a key the largest counts; equal rows count once.
    Null texts are texts without characters.  Without rows, or with one label only, there are no rules.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_y"))
    n = marks.count()
    if n > max_labelled:
        marks = marks.where(F.pmod(F.xxhash64(F.lit("fit"), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    rows = labelled(docs, marks, key, text, max_labelled)
    stats = statistics(F.col("text"))
    got = rows.select("_k", *[c.alias(k) for k, c in stats.items()], "_y").toPandas()
    got = got.sort_values(list(got.columns)).reset_index(drop=True)
    return RuleEnsemble.fit(list(stats), got[list(stats)].to_numpy(float), got["_y"].to_numpy(float))


def classify(docs: DataFrame, model: RuleEnsemble, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted.  Null and empty texts are scored by their statistics, as any text.

    Repeated rows are scored alike, an empty table gives none; columns with the added names are replaced, all others stay.
    """
    stats, base = statistics(F.col(text)), docs.drop("score", "predicted")
    s = free_name(base, "statistics")
    held = base.withColumn(s, F.struct(*[c.alias(k) for k, c in stats.items()]))
    scored = held.withColumn("score", model.score({k: F.col(s)[k] for k in stats})).drop(s)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """:func:`classify` on ``documents``: doc_id, held_out, score, predicted; null texts have a score like others."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    with tidy():
        model = train(docs, labels.where(fold("doc_id", 5) != 0))
    return classify(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
