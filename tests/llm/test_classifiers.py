import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import langid, quality, registry, toxicity

SF = "/root/testdata/sf0.01"


def test_block_max_search_equals_brute_force():
    rng = random.Random(5)
    vectors = []
    for _ in range(500):
        v = {rng.randrange(60): rng.random() for _ in range(rng.randint(1, 8))}
        n = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / n for t, x in v.items()})
    vectors[9] = vectors[200] = vectors[3]
    index = toxicity.BlockMaxIndex(vectors, 61)
    for q in [*vectors[:60], {60: 1.0}]:
        cos = [(-round(sum(w * v.get(t, 0) for t, w in q.items()), 12), i) for i, v in enumerate(vectors)]
        want = sorted(x for x in cos if x[0] < 0)[:10]
        got = index.nearest(q, 10)
        assert [s for s, _ in got] == pytest.approx([-s for s, _ in want], abs=1e-9)
        assert len({i for _, i in got}) == len(got) and all(dict((i, -s) for s, i in cos)[i] == pytest.approx(s, abs=1e-9) for s, i in got)
    assert 3 not in {i for _, i in index.nearest(vectors[3], 10, without=3)} and {9, 200} <= {i for _, i in index.nearest(vectors[3], 10, without=3)}


def held_out(spark, name, label, threshold):
    got = registry.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
    return got


def test_toxicity_on_held_out_rows(spark):
    got = held_out(spark, "op2_toxicity_knn", "toxic", 0.7)
    assert sum(r.toxic == r.predicted for r in got) / len(got) > 0.94
    assert sum(r.predicted for r in got if not r.toxic) <= 1


def test_quality_on_held_out_rows(spark):
    got = held_out(spark, "op7_quality_rules", "quality", 0.3)
    assert sum(r.quality == r.predicted for r in got) / len(got) > 0.94


def test_language_on_held_out_rows(spark):
    got = registry.QUERIES["op6_language_spans"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98


EDGES = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "12 34 !?", "x"), (5, "word " * 40000, "x"), (5, "word " * 40000, "x"), (None, "the end", None)]


def test_edges_of_the_scores(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, score string")
    train = spark.createDataFrame([(10 + i, "you idiot fool " + "abc def " * i if i % 2 else "good day to you " + "ghi jkl " * i) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(10 + i, i % 2, 1 - i % 2) for i in range(40)], "doc_id long, toxic int, quality int")
    model = toxicity.train(train, labels)
    for m in (model, toxicity.train(train.limit(0), labels.limit(0))):
        out = toxicity.score(docs, m)
        assert out.count() == len(EDGES) and all(0 <= r.score <= 1 for r in out.collect())
    out = toxicity.score(spark.createDataFrame([(1, "an idiot"), (2, "a good day")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert out[0].score > 0.7 > 0.3 > out[1].score and out[0].evidence[0].toxic == 1
    for m in (quality.train(train, labels), quality.train(train.limit(0), labels.limit(0))):
        out = quality.classify(docs, m)
        assert out.count() == len(EDGES) and all(0 <= r.score <= 1 for r in out.collect())
    assert quality.classify(docs.limit(0), quality.train(train, labels)).count() == 0


def test_rules_as_columns_equal_rules_as_arrays(spark):
    rng = np.random.default_rng(2)
    x = rng.random((500, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 2] < 0.7)).astype(float)
    model = quality.RuleEnsemble.fit(["a", "b", "c"], x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r.s for r in df.select(model.score({k: F.col(k) for k in "abc"}).alias("s")).collect()]
    z = model.bias + sum(w * np.all([(x[:, j] > c) == up for j, up, c in r], axis=0) for r, w in zip(model.rules, model.weights))
    assert np.allclose(got, 1 / (1 + np.exp(-z)))
    assert ((np.array(got) > 0.5) == y).mean() > 0.97 and model.describe()


def toy_model():
    from collections import Counter

    en, ru = Counter(), Counter()
    for w in ("the", "house", "and", "with", "this"):
        en.update(langid.grams(w))
    de = Counter(g for w in ("und", "das", "haus", "mit", "dies") for g in langid.grams(w))
    ru.update(g for w in ("дом", "это") for g in langid.grams(w))
    return langid.LanguageModel({"en": en, "de": de, "ru": ru}, {"en": Counter(Latin=9), "de": Counter(Latin=9), "ru": Counter(Cyrillic=9)})


def test_shortcut_of_the_path_equals_viterbi():
    rng = np.random.default_rng(1)
    model = toy_model()
    labeller = langid.Labeller(model)
    for _ in range(400):
        s = -rng.random((rng.integers(1, 60), 3)) * rng.choice([0.2, 1, 4])
        a, b = labeller.settle([s])[0], langid.viterbi(s, model.switch)
        value = lambda p: s[np.arange(len(s)), p].sum() - model.switch * (np.diff(p) != 0).sum()
        assert value(a) == pytest.approx(value(b))


def test_languages_of_spans_and_edges(spark):
    model = toy_model()
    rows = [(1, "the house and this " * 9 + "das haus und dies " * 9), (2, None), (3, "1234 !"), (4, ""), (5, "это дом"), (6, "漢字"), (7, "the " * 50000), (8, "① ½ ² Ⅷ"), (9, "\u0301 \u0300")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de"] and got[1].spans[1].start == len("the house and this " * 9)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].spans == [] for i in (2, 3, 4, 8, 9))
    assert got[5].lang_pred == "ru" and got[6].lang_pred in ("de", "en", "ru") and got[7].lang_pred == "en"
    empty = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame(rows[:1], "doc_id long, text string"), empty).collect()] == ["und"]


def test_spans_of_a_text_that_lower_case_lengthens(spark):
    text = "İx " + "the house and this " * 9 + "das haus und dies " * 9
    got = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), toy_model()).collect()[0]
    assert [s.lang for s in got.spans][-2:] == ["en", "de"] and got.spans[-1].end == len(text.rstrip())


def test_words_keep_their_marks():
    assert langid.words_of("नमस्ते Ab1c ½x") == ["नमस्ते", "ab", "c", "x"]


def test_spans_of_one_language_are_those_of_all_words():
    rng = random.Random(4)
    model = toy_model()
    for _ in range(300):
        text = "".join(rng.choice(["the", "Das", " ", "1", "é", "İ", "é́", ".", "x" * 150]) for _ in range(rng.randint(0, 60)))
        words = [m.span() for m in langid._WORD.finditer(text)]
        want = [{"start": words[0][0], "end": words[-1][1], "lang": "en"}] if words else []
        assert langid.spans_of(model, text, np.full(len(words), model.langs.index("en"))) == want


def test_labels_of_the_query_against_plain_viterbi(spark):
    """op6 on the whole table at sf0.01: the labels are those of a plain dynamic programme over every text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where(langid.fold("doc_id", 4) != 2))
    rows = {r.doc_id: r for r in registry.QUERIES["op6_language_spans"](spark, SF).collect()}
    for d in docs.collect():
        words = langid.words_of(d.text or "")
        if not words:
            assert (rows[d.doc_id].lang_pred, rows[d.doc_id].score) == ("und", 0.0)
            continue
        path = langid.viterbi(np.array([model.word(w) for w in words]), model.switch)
        letters = np.bincount(path, [len(w) for w in words], len(model.langs))
        got = rows[d.doc_id]
        assert got.lang_pred == model.langs[int(letters.argmax())] or len(set(np.sort(letters)[-2:])) == 1
        assert [s.lang for s in got.spans] == [model.langs[j] for i, j in enumerate(path) if not i or path[i - 1] != j]
