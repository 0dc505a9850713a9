"""The engine against the sequential model, and the behaviours that users rely on."""

import random

import pytest
from pyspark.sql import functions as F

from lexquarry.config import Config
from lexquarry.engine import Engine, PolicyReject
from lexquarry.operators import oplog, search, suggest
from lexquarry.operators.index import Index
from lexquarry.operators.suggest import SuggestError
from lexquarry.schema import OPLOG, ItemError, ItemRef

from .model import Model

BASE = Config().with_(normalization={"diacritic_folding_enabled": True}, tokenization={"compat_split_special_patterns": False})
QUERIES = "qid long, collection string, bucket string, terms string, limit int, offset long, lang string"


def run_log(spark, ops, config, published=None):
    return Index.from_log(spark.createDataFrame([(i, *op) for i, op in enumerate(ops)], OPLOG), config, published=published).kept()


def push(o, text, b="b", c="c", lang="none"):
    return ("push", c, b, o, text, lang)


def ask(spark, index, config, *texts, limit=1000, lang="none", b="b"):
    q = spark.createDataFrame([(i, "c", b, t, limit, 0, lang) for i, t in enumerate(texts)], QUERIES)
    rows = search.search(q, index, config).orderBy("qid", "rank").collect()
    out = [[r.object_id for r in rows if r.qid == i] for i in range(len(texts))]
    return out[0] if len(texts) == 1 else out


def random_log(seed, n=160, objects=30):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 8))) for _ in range(60)] + ["a@b.co", "x-12"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 7)))
    ops = []
    for _ in range(n):
        o, b = f"o{rng.randrange(objects)}", rng.choice(["b", "b", "d"])
        kind = rng.choice(["push"] * 12 + ["pop"] * 5 + ["flusho"] * 2 + (["flushb"] if rng.random() < 0.1 else []))
        ops.append((kind, "c", b, o if kind != "flushb" else None, text() if kind in ("push", "pop") else None, "none"))
    return ops, words


def play(ops, config):
    m = Model(config)
    for kind, c, b, o, text, lang in ops:
        {"push": lambda: m.push(c, b, o, text, lang), "pop": lambda: m.pop(c, b, o, text), "flusho": lambda: m.flusho(c, b, o), "flushb": lambda: m.flushb(c, b), "flushc": lambda: m.flushc(c)}[kind]()
    m.consolidate()
    return m


@pytest.mark.parametrize("seed", [1, 2])
def test_log_fold_equals_replay(spark, seed):
    ops, _ = random_log(seed)
    m, index = play(ops, BASE), run_log(spark, ops, BASE)
    links = {(c, b, t, o) for (c, b), k in m.buckets.items() for o, i in k.ids.items() for t in k.terms[i]}
    assert {(r.collection, r.bucket, r.term, r.object_id) for r in index.postings.collect()} == links
    assert {(b, o, i) for (_, b), k in m.buckets.items() for o, i in k.ids.items()} == {(r.bucket, r.object_id, r.iid) for r in index.objects.collect()}
    assert {(r.bucket, r.n) for r in index.bucket_stats.collect()} == {(b, k.births) for (_, b), k in m.buckets.items() if k.births}
    assert {(b, w) for (_, b), ws in m.published.items() for w in ws} == {(r.bucket, r.term) for r in index.lexicon.collect()}
    for (_, b), k in m.buckets.items():
        order = {t: [r.iid for r in index.postings.where((F.col("bucket") == b) & (F.col("term") == t)).orderBy(F.desc("link_seq")).collect()] for t in list(k.links)[:5]}
        assert all(order[t] == k.links[t] for t in order)


@pytest.mark.parametrize("seed,search_config", [(3, {"query_alternates_try": 6}), (4, {"query_alternates_try": 30, "merge": "max"}), (5, {"query_minimum_term_idf": 1.0, "query_minimum_term_idf_minimum_object_count": 10})])
def test_queries_equal_the_model(spark, seed, search_config):
    config = BASE.with_(search=search_config)
    rng = random.Random(seed)
    ops, words = random_log(seed)
    m, index = play(ops, config), run_log(spark, ops, config)
    texts = []
    for _ in range(40):
        some = [rng.choice(words) for _ in range(rng.randint(1, 4))]
        some = [w[: rng.randint(2, len(w))] if rng.random() < 0.3 else w.replace("b", "q", 1) if rng.random() < 0.3 else w for w in some]
        texts.append(" ".join(some))
    got = ask(spark, index, config, *texts)
    for t, g in zip(texts, got):
        assert g == m.query("c", "b", t, 1000, lang="none"), t


def test_retention_caps_exact_matches(spark):
    config = BASE.with_(store={"retain_word_objects": 5})
    ops = [push(f"o{i}", "word other" if i % 3 else "word") for i in range(20)]
    m, index = play(ops, config), run_log(spark, ops, config)
    assert index.postings.count() == 10
    for text in ("word", "other word", "wor", "word other"):
        assert ask(spark, index, config, text) == m.query("c", "b", text, 1000, lang="none")
    bulk = spark.createDataFrame([(op[1], op[2], op[3], op[4], "none", i) for i, op in enumerate(ops)], "collection string, bucket string, object_id string, text string, lang string, seq long")
    assert sorted(map(repr, Index.from_documents(bulk, config).postings.collect())) == sorted(map(repr, index.postings.select("collection", "bucket", "term", "object_id", "iid", "link_seq").collect()))


def test_ranking_or_semantics_and_recency(spark):
    ops = [push("1", "the harbour bridge opened at noon"), push("2", "a bridge of stone"), push("3", "the harbour was closed"), push("4", "nothing to see")]
    index = run_log(spark, ops, BASE)
    assert ask(spark, index, BASE, "harbour bridge")[0] == "1"
    assert set(ask(spark, index, BASE, "harbour bridge")) == {"1", "2", "3"}
    assert ask(spark, index, BASE, "bridge") == ["2", "1"]  # equal scores: the most recent first
    assert ask(spark, index, BASE, "bridge", limit=1) == ["2"]
    assert ask(spark, index, BASE, "harbou")[:2] == ["3", "1"]


def test_prefix_before_typo_and_rare_before_frequent(spark):
    index = run_log(spark, [push("1", "navigation"), push("2", "navigating")], BASE)
    assert ask(spark, index, BASE, "navigatio") == ["1", "2"]
    index = run_log(spark, [push("1", "common rare"), push("2", "common thing"), push("3", "common else")], BASE)
    assert ask(spark, index, BASE, "common rare")[0] == "1"


@pytest.mark.parametrize("needle,hit", [("sun", True), ("sum", False), ("comet", True), ("comit", True), ("cemit", False), ("nebulae", True), ("nabulse", True), ("nabulsa", False), ("telescopes", True), ("tolascopos", True), ("tolascopoz", False)])
def test_typos_by_length(spark, needle, hit):
    if not hasattr(test_typos_by_length, "index"):
        test_typos_by_length.index = run_log(spark, [push("1", "sun comet nebulae telescopes")], BASE)
    assert bool(ask(spark, test_typos_by_length.index, BASE, needle)) == hit


def test_identifiers_match_exactly_and_all_must(spark):
    ops = [push("0", "write to ann@example.org about KX-2210 at 192.168.0.7, +33 6 12 34 56 78"), push("1", "write to anne@example.org about KX-2211 at 192.168.1.9, +33 6 12 34 56 79"), push("2", "write about it")]
    index = run_log(spark, ops, BASE)
    for text in ("ann@example.org", "KX-2210", "192.168.0.7", "+33612345678", "+33 6 12 34 56 78", "write ann@example.org", "KX-2210 write"):
        assert ask(spark, index, BASE, text) == ["0"], text
    assert ask(spark, index, BASE, "ann@example.org KX-2211") == []
    split = BASE.with_(tokenization={"compat_split_special_patterns": True})
    assert set(ask(spark, run_log(spark, ops, split), split, "anne@example.org")) == {"1"}
    off = BASE.with_(tokenization={"detect_special_patterns": False})
    assert set(ask(spark, run_log(spark, ops, off), off, "ann@example.org")) == {"0", "1"}


def test_case_diacritics_scoping(spark):
    ops = [push("1", "Das Café an der STRASSE"), push("2", "ΟΔΟΣ Зима"), push("3", "Cinéma", b="other")]
    index = run_log(spark, ops, BASE)
    for text, want in (("cafe", ["1"]), ("CAFÉ", ["1"]), ("straße", ["1"]), ("οδος", ["2"]), ("ЗИМА", ["2"]), ("cinema", [])):
        assert ask(spark, index, BASE, text) == want, text
    assert ask(spark, index, BASE, "cinema", b="other") == ["3"]


def test_normal_forms(spark):
    plain = Config().with_(tokenization={"detect_special_patterns": False})
    index = run_log(spark, [push("1", "café"), push("2", "café")], plain)
    assert set(ask(spark, index, plain, "café")) == set(ask(spark, index, plain, "café")) == {"1", "2"}
    nfc = plain.with_(normalization={"unicode_normalization": "nfc"})
    assert set(ask(spark, run_log(spark, [push("1", "café"), push("2", "café")], nfc), nfc, "café")) == {"1", "2"}


def test_stopwords(spark):
    ops = [push("1", "the microscope and the lens", lang="eng"), push("2", "foobar lens", lang="eng")]
    assert ask(spark, run_log(spark, ops, BASE), BASE, "the", lang="eng") == []
    allow = BASE.with_(stopwords={"allow": ("the",)})
    assert ask(spark, run_log(spark, ops, allow), allow, "the", lang="en") == ["1"]
    deny = BASE.with_(stopwords={"deny": ("foobar",)})
    assert ask(spark, run_log(spark, ops, deny), deny, "foobar", lang="eng") == []


def test_suggestions(spark):
    index = run_log(spark, [push("1", "docks doctor document dock 北京 北海 cafés")], BASE)

    def say(word, limit=20):
        q = spark.createDataFrame([(0, "c", "b", word, limit)], "qid long, collection string, bucket string, word string, limit int")
        return [r.word for r in suggest.suggest(q, index.lexicon, BASE).orderBy("rank").collect()]

    assert say("doc") == ["dock", "docks", "doctor", "document"]
    assert say("dock") == ["dock", "docks"]
    assert say("dack") == ["dock"]
    assert say("caf") == ["cafes"]
    assert say("two words") == [] and say("x" * 41) == []
    assert [r.term for r in suggest.list_terms(index.lexicon, "c", "b", BASE, 2, 1).collect()] == ["dock", "docks"]


def test_lifecycle(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), BASE)
    assert e.count("c") == 0 and e.query("c", "b", "word") == []
    e.push("c", "b", "o:1", "foo bar baz", "none")
    assert e.query("c", "b", "foo", lang="none") == ["o:1"]  # exact matches at once
    assert e.count("c", "b") == 0 and e.list_terms("c", "b") == [] and e.query("c", "b", "fo", lang="none") == []
    assert e.info()["fst_consolidate_count"] == 1
    e.consolidate()
    assert e.count("c") == 1 and e.count("c", "b") == 3 and e.count("c", "b", "o:1") == 3 and e.query("c", "b", "fo", lang="none") == ["o:1"]
    assert e.pop("c", "b", "o:1", "foo bar nope") == 2
    e.consolidate()
    assert e.list_terms("c", "b") == ["baz"]
    e.push("c", "b", "o:2", "one two three", "none")
    again = Engine(spark, str(tmp_path / "store"), BASE)
    assert again.count("c", "b", "o:2") == 3 and again.list_terms("c", "b") == ["baz"]
    again.consolidate()
    again.backup(str(tmp_path / "backup"))
    assert again.publish() == 1 and again.store.index().postings.count() == 4
    assert again.pop("c", "b", "o:1", "baz two") == 1 and again.query("c", "b", "two", lang="none") == ["o:2"]
    again.push("c", "b", "o:1", "baz", "none")
    other = Engine(spark, str(tmp_path / "other"), BASE)
    other.push("c", "b", "gone", "forgotten words", "none")
    other.restore(str(tmp_path / "backup"))
    other.push("c", "b", "o:3", "three four", "none")  # a backup that was restored stays
    assert other.query("c", "b", "three", lang="none") == ["o:3", "o:2"] and other.query("c", "b", "forgotten", lang="none") == []
    assert other.compact() == 2 and other.store.log().isEmpty()
    other = Engine(spark, str(tmp_path / "other"), BASE)
    assert other.query("c", "b", "three", lang="none") == ["o:3", "o:2"] and other.pop("c", "b", "o:3", "four") == 1
    assert other.list_terms("c", "b") == ["baz", "one", "three", "two"] and other.query("c", "b", "thre", lang="none") == ["o:3", "o:2"]
    assert again.flush("c", "b", "o:2") == 3 and again.count("c", "b", "o:2") == 0
    assert again.flush("c", "b") == 1 and again.list_terms("c", "b") == []
    assert again.flush("c") == 0 and again.flush("nowhere") == 0
    with pytest.raises(PolicyReject):
        e.query("c", "b", "x", limit=101)
    with pytest.raises(SuggestError):
        e.suggest("c", "b", "two words")
    with pytest.raises(ItemError):
        e.push("", "b", "o", "x")
    with pytest.raises(ItemError):
        ItemRef("c", "é")


def test_retain_keeps_ties_whole(spark):
    rows = [("c", "b", "t", f"o{i}", i, i) for i in range(300)]
    kept, lost = oplog.retain(spark.createDataFrame(rows, "collection string, bucket string, term string, object_id string, iid long, link_seq long"), 120)
    assert {r.iid for r in kept.collect()} == set(range(180, 300)) and lost.count() == 180


SENTENCES = [
    ("the house and the garden are what they wanted to have when it was summer", "eng"), ("der Hund und die Katze sind nicht mit dem Vater in das Haus gegangen", "deu"),
    ("je ne sais pas ce que nous avons dans la maison de mon père", "fra"), ("café été à même", None), ("short text", None), ("it was the", None),
]


@pytest.mark.parametrize("hint", [None, "", "ENG", "Fr", "none", "eng"])
def test_column_lexer_and_full_lexer_agree_on_languages(spark, hint):
    from lexquarry.functions import exact, lexer

    config = BASE.with_(normalization={"diacritic_folding_enabled": False}, stopwords={"deny": ("garden", "été"), "allow": ("was",)})
    df = spark.createDataFrame([(i, t, hint) for i, (t, _) in enumerate(SENTENCES)], "i int, text string, lang string")
    for cleanup in (True, False):
        rows = lexer.distinct_terms(lexer.tokens(df, config, cleanup=cleanup), ["i"]).collect()
        full = lexer.tokens(df, config, cleanup=cleanup, exact=True).collect()
        for i, (t, _) in enumerate(SENTENCES):
            want = [w for _, w, _ in exact.lex(t, config, hint, cleanup)]
            assert [r.term for r in sorted(rows, key=lambda r: r.pos) if r.i == i] == want == [r.term for r in full if r.i == i]


def test_languages_are_guessed_on_push_and_query(spark):
    ops = [("push", "c", "b", f"o{i}", t, hint) for i, (t, hint) in enumerate([(SENTENCES[0][0], None), (SENTENCES[1][0], None), (SENTENCES[2][0], "FRA"), (SENTENCES[2][0], "none")])]
    m, index = play(ops, BASE), run_log(spark, ops, BASE)
    assert {(b, t, o) for (_, b), k in m.buckets.items() for o, i in k.ids.items() for t in k.terms[i]} == {(r.bucket, r.term, r.object_id) for r in index.postings.collect()}
    kept = {r.term for r in index.postings.where("object_id = 'o0'").collect()}
    assert "house" in kept and not kept & {"the", "and", "they"}
    assert ask(spark, index, BASE, "the house and the garden of my father", lang=None) == m.query("c", "b", "the house and the garden of my father", 1000)


def tables_of(index):
    plain = lambda df, *cols: sorted(tuple(r) for r in df.select(*cols).collect())
    return [plain(index.postings, "bucket", "term", "object_id", "iid", "link_seq"), plain(index.objects, "bucket", "object_id", "iid"), plain(index.lexicon, "bucket", "term"), plain(index.term_stats, "bucket", "term", "df"), plain(index.bucket_stats, "bucket", "n")]


@pytest.mark.parametrize("seed,cuts", [(21, (40, 100)), (22, (150,))])
def test_states_carried_on_equal_one_fold(spark, seed, cuts):
    ops, _ = random_log(seed)
    rows = [(i, *op) for i, op in enumerate(ops)]
    index = None
    for a, b in zip((0, *cuts), (*cuts, len(rows))):
        index = Index.from_log(spark.createDataFrame(rows[a:b], OPLOG), BASE, earlier=index).kept()
    assert tables_of(index) == tables_of(run_log(spark, ops, BASE))


def test_retention_over_states_equals_the_model(spark):
    """An object that lost a term before a state was published is linked again; one that still has it is not moved."""
    config = BASE.with_(store={"retain_word_objects": 3})
    ops = [push(f"o{i}", f"word w{i}" if i else "word") for i in range(9)] + [push("o0", "word"), push("o7", "word"), push("o6", "word")]
    m, rows, index = play(ops, config), [(i, *op) for i, op in enumerate(ops)], None
    for a, b in ((0, 9), (9, 11), (11, 12)):
        index = Index.from_log(spark.createDataFrame(rows[a:b], OPLOG), config, earlier=index).kept()
    k = m.buckets["c", "b"]
    names = {i: o for o, i in k.ids.items()}
    assert {(t, names[i]) for t, ids in k.links.items() for i in ids} == {(r.term, r.object_id) for r in index.postings.collect()}
    assert k.ids == {r.object_id: r.iid for r in index.objects.collect()}
