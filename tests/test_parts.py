"""Configuration, lexer, scores, languages, protocol, streaming."""

import math

import pytest
from pyspark.sql import functions as F

from lexquarry import config as cfg
from lexquarry.config import Config, ConfigError
from lexquarry.engine import Engine
from lexquarry.functions import exact, langs, lexer, scoring, stem, stopwords
from lexquarry.protocol import Session, metas, quoted, unescape
from lexquarry.sources.store import Store, read_any
from lexquarry.streaming.ingest import consolidate, ingest

PLAIN = Config().with_(tokenization={"compat_split_special_patterns": False})
SENTENCES = [
    ("Mail ann.lee+x@mail.example.org now", [("ann.lee+x@mail.example.org", True), ("mail", False), ("now", False)]),
    ("ask @some_user, please", [("@some_user", True), ("ask", False), ("please", False)]),
    ("see https://example.org/a?b=c.", [("https://example.org/a?b=c", True), ("see", False)]),
    ("host 192.168.10.1!", [("192.168.10.1", True), ("host", False)]),
    ("call +33 6 12-34.56 78", [("+33612345678", True), ("call", False)]),
    ("at example.org today", [("example.org", True), ("at", False), ("today", False)]),
    ("part AB-12_c and a:1", [("AB-12_c", True), ("a:1", True), ("and", False), ("part", False)]),
    ("no special here", [("here", False), ("no", False), ("special", False)]),
    ("🙂 🙂", []),
    ("北京 l'été don't", [("don't", False), ("l'été", False), ("京", False), ("北", False)]),
]


@pytest.mark.parametrize("text,want", SENTENCES)
def test_both_lexers_find_the_same_tokens(spark, text, want):
    assert sorted((t, s) for s, t, _ in exact.lex(text, PLAIN, None, cleanup=False)) == sorted(want)
    row = spark.createDataFrame([(text,)], "t string").select(lexer.lex(F.col("t"), PLAIN).alias("x")).head()
    assert sorted({(r.term, r.special) for r in row.x}) == sorted(want)


def test_lexers_agree_on_lengths_and_splits(spark):
    for config in (Config(), PLAIN, PLAIN.with_(normalization={"diacritic_folding_enabled": True})):
        for text in ("Größe ÉTÉ ann@example.org 10.0.0.1x +1 22 33 44 55 été", "", "a", "_ __ _1"):
            want = [(s, t, n) for s, t, n in exact.lex(text, config, None, cleanup=False)]
            row = spark.createDataFrame([(text,)], "t string").select(lexer.lex(F.col("t"), config).alias("x")).head()
            got = list({(r.special, r.term): (r.special, r.term, r.bytes) for r in reversed(row.x)}.values())
            assert sorted(got) == sorted(want), text


def test_clean_up_and_languages():
    text = "The quick brown fox jumps over the lazy dog!"
    assert [t for _, t, _ in exact.lex(text, PLAIN)] == ["quick", "brown", "fox", "jumps", "lazy", "dog"]
    assert langs.detect("The committee has said that it will not be there before the end of the week, and we are glad of it.") == "eng"
    assert langs.detect("Le comité a dit que nous serons dans la ville avec vous et les autres avant la fin de la semaine.") == "fra"
    assert langs.detect("short") is None and langs.detect(None) is None and langs.detect("12345 67890 12345 67890") is None
    assert langs.detect("Это предложение написано на русском языке, и оно довольно длинное.") == "rus"
    assert langs.script_of("北京") == "mandarin" and langs.script_of("1") is None
    assert stopwords.is_stopword("the", "eng") and not stopwords.is_stopword("the", None) and stopwords.is_stopword("x", None, deny=("x",))


def test_stemming_and_hash():
    for word, want in (("running", "run"), ("happiness", "happi"), ("relational", "relat"), ("cats", "cat"), ("flies", "fli"), ("agreed", "agre"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("skies", "sky"), ("news", "news"), ("ties", "tie")):
        assert stem.english(word) == want, word
    assert [exact.term_hash(t) for t in ("hash:1", "hash:2")] == [3637660813, 3577985381]


def test_scores(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).head().v
    assert value(scoring.prefix_score(F.lit(4), F.lit(8.0))) == pytest.approx(20 / 20.5)
    assert value(scoring.typo_score(F.lit(2), F.lit(8.0))) == 0.75 and value(scoring.typo_score(F.lit(3), F.lit(2.0))) == 0
    assert value(scoring.idf_weight(F.lit(10), F.lit(4))) == pytest.approx(math.log(1 + 6.5 / 4.5))
    assert value(scoring.overall_score(F.array(F.lit(1.0), F.lit(None).cast("double")), F.lit(2))) == 0.5
    assert [value(scoring.typo_factor(F.lit(n))) for n in (3, 4, 6, 7, 9, 10)] == [0, 1, 1, 2, 2, 3]


def test_configuration():
    text = """
        [normalization]
        unicode_normalization = "nfkc"
        [search]
        query_limit_default = 20
        [stopwords]
        deny = ["${env.WORD}"]
        [store.kv]
        retain_word_objects = 50
        [store.fst.graph]
        consolidate_after = 60
        [channel.search]
        suggest_limit_maximum = 30
        [server]
        log_level = "debug"
    """
    c = cfg.load(text, {"WORD": "spam", "LEXQUARRY_SEARCH__LIST_LIMIT_DEFAULT": "7"})
    assert (c.normalization.unicode_normalization, c.search.query_limit_default, c.stopwords.deny, c.store.retain_word_objects, c.store.consolidate_after, c.search.suggest_limit_maximum, c.search.list_limit_default) == ("nfkc", 20, ("spam",), 50, 60, 30, 7)
    assert cfg.load("", {}) == Config()
    with pytest.warns(UserWarning):
        cfg.load("[store.kv.database]\nparallelism = 2", {})
    for bad in ('[normalization]\nunicode_normalization = "nfd"', "[nope]\na = 1", "[store.kv.database]\nwrite_buffer = 0", "[store.kv.database]\nmax_flushes = 1\nmax_background_jobs = 1", '[stopwords]\nallow = ["a"]\ndeny = ["a"]', '[store.kv]\npath = "${env.NONE}"', "[store.fst.graph]\nconsolidate_after = 300", "[search]\nquery_limit_default = 500"):
        with pytest.raises(ConfigError), __import__("warnings").catch_warnings():
            __import__("warnings").simplefilter("ignore")
            cfg.load(bad, {})


def test_command_grammar():
    assert unescape(r"a\nb\"c\xd\\e") == 'a\nb"c\\d\\e'
    assert quoted(' "two   words\t here"  LIMIT(3)') == ("two words here", "  LIMIT(3)")
    assert quoted(r'"say \"hi\" now" X') == ('say "hi" now', " X")
    for bad in ("", "plain", '"open', '""', '" "'):
        with pytest.raises(ValueError):
            quoted(bad)
    assert metas("LIMIT(3)", {"LIMIT": int}) == {"limit": 3}


def test_session(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), Config())
    s = Session(e, "secret")
    assert s.send("START ingest wrong") == ["ENDED authentication_failed"] and s.send("PING") == []
    assert Session(e).send("HELLO") == ["ENDED not_recognized"] and Session(e).send("START x") == ["ENDED invalid_mode"] and Session(e, "p").send("START search") == ["ENDED authentication_required"]
    ingest_, search_, control = Session(e), Session(e), Session(e)
    assert [x.send(f"START {m}") for x, m in ((ingest_, "ingest"), (search_, "search"), (control, "control"))] == [["STARTED ingest"], ["STARTED search"], ["STARTED control"]]
    assert ingest_.send(r'PUSH messages user:0 conv:1 "say \"foo\"	bar\nend" LANG(none)') == ["OK"]
    assert control.send("TRIGGER consolidate") == ["OK"] and control.send("TRIGGER") == ["RESULT actions(consolidate, backup, restore)"]
    pending, event = search_.send('QUERY messages user:0 "foo" LANG(none)')
    assert pending.split()[0] == "PENDING" and event == f"EVENT QUERY {pending.split()[1]} conv:1"
    assert search_.send("LIST messages user:0 LIMIT(2)")[1].split()[3:] == ["bar", "end"]
    assert search_.send('SUGGEST messages user:0 "fo"')[1].split()[3:] == ["foo"]
    assert ingest_.send("COUNT messages user:0") == ["RESULT 4"] and ingest_.send("COUNT messages") == ["RESULT 1"]
    assert ingest_.send('POP messages user:0 conv:1 "foo bar"') == ["RESULT 2"]
    assert ingest_.send("FLUSHO messages user:0 conv:1") == ["RESULT 2"] and ingest_.send("FLUSHB messages user:0") == ["RESULT 0"]
    for line, reply in (
        ("NOPE", "ERR unknown_command"), ("PUSH a b", "ERR unknown_command"), ('QUERY a b "x" LIMIT(0)', "ERR policy_reject(LIMIT out of minimum/maximum bounds)"), ('QUERY a b "x" LIMIT(x)', "ERR invalid_meta_value(LIMIT[x])"),
        ('QUERY a b "x" FOO(1)', "ERR invalid_meta_key(FOO[1])"), ('QUERY a b "x" junk', "ERR invalid_meta_key(?[junk])"), ('SUGGEST a b "two words"', "ERR query_error"), ("PING now", "ERR invalid_format(PING)"),
        ("QUERY a b x", 'ERR invalid_format(QUERY <collection> <bucket> "<terms>" [LIMIT(<count>)]? [OFFSET(<count>)]? [LANG(<locale>)]?)'), ("HELP commands", "RESULT commands(QUERY, SUGGEST, LIST, PING, HELP, QUIT)"), ("HELP x", "ERR not_found"), ("ping", "PONG"), ("QUIT", "ENDED quit"),
    ):
        assert search_.send(line) == [reply], line
    assert control.send("INFO")[0].startswith("RESULT uptime(") and control.send("TRIGGER nope") == ["ERR not_found"] and control.send("TRIGGER backup") == ["ERR invalid_format(TRIGGER backup <path>)"]


def test_streaming_equals_batch_and_repeats_nothing(spark, tmp_path):
    rows = [(i, "push", "c", "b", f"o{i % 7}", f"word{i} shared", "none") for i in range(40)]
    from lexquarry.operators.index import Index
    from lexquarry.schema import OPLOG

    spark.createDataFrame(rows, OPLOG).repartition(5, "seq").write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(OPLOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    clock = iter(range(0, 10_000, 100))
    q = ingest(stream, store, checkpoint=str(tmp_path / "ck"), config=PLAIN, trigger={"availableNow": True}, clock=lambda: next(clock))
    q.awaitTermination()
    assert store.version() is not None  # due changes were published on the way
    consolidate(store, PLAIN)
    want = Index.from_log(spark.createDataFrame(rows, OPLOG), PLAIN)
    key = ["collection", "bucket", "term", "object_id", "iid", "link_seq"]
    assert sorted(map(tuple, store.current(PLAIN).postings.select(key).collect())) == sorted(map(tuple, want.postings.select(key).collect()))
    store.append(spark.createDataFrame(rows, OPLOG), 0)
    store.append(spark.createDataFrame(rows, OPLOG), 0)
    assert store.log().where("seq = 0").count() <= 2


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([("q1", "d1", "1")], "query_id string, corpus_id string, score string")
    df.write.parquet(str(tmp_path / "a.parquet"))
    df.write.json(str(tmp_path / "b.jsonl"))
    df.write.csv(str(tmp_path / "c.tsv"), sep="\t", header=True)
    want = [("q1", "d1", "1")]
    for name in ("a.parquet", "b.jsonl", "c.tsv"):
        assert [tuple(r) for r in read_any(spark, str(tmp_path / name)).select("query_id", "corpus_id", "score").collect()] == want


def test_the_entry_needs_no_jar_of_spark(tmp_path):
    """Imports and builds all SQL where pyspark has no jars beside it."""
    import os
    import pathlib
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    code = f"import pyspark; pyspark.__file__ = {str(tmp_path / '__init__.py')!r}; import __spark_entry__ as e; sql = e.oracle_sql(); assert set(sql) <= set(e.queries()) and len(sql) > 50 and not any('{{{{' in s for s in sql.values())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(root), "SPARK_HOME": str(tmp_path)})


def test_shutdown_and_the_flush_action():
    from types import SimpleNamespace

    from lexquarry.engine import Statistics
    from lexquarry.protocol import Session

    done = []
    engine = SimpleNamespace(closing=False, stats=Statistics(), compact=lambda: done.append("compact"))
    plain, more = Session(engine), Session(engine, more_actions=True)
    for s in (plain, more):
        assert s.send("START control") == ["STARTED control"]
    assert plain.send("TRIGGER flush") == ["ERR not_found"] and not done
    assert more.send("TRIGGER flush") == ["OK"] and done == ["compact"]
    engine.closing = True
    assert plain.send("PING") == more.send("TRIGGER consolidate") == ["ERR shutting_down"]


def test_languages_of_the_protocol_in_either_case():
    from lexquarry.protocol import _language

    assert _language("ENG") == _language("eng") == "eng" and _language("none") == "none"
    for x in ("xyz", "NONE", "english", ""):
        with pytest.raises(ValueError):
            _language(x)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lexquarry.sources import scratch

    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(scratch.NoSharedFolder):
        scratch.shared_dir(session)
