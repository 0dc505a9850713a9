"""Logs that only push: the tables of the general fold, without its windows."""

from lexquarry.config import Config
from lexquarry.operators import oplog
from lexquarry.operators.index import Index
from lexquarry.schema import OPLOG


def tables(index):
    out = {}
    for name in ("postings", "objects", "lexicon", "bucket_stats", "words"):
        df = getattr(index, name)
        out[name] = sorted(tuple(map(str, (r[c] for c in sorted(df.columns)))) for r in df.collect())
    return out


def check(spark, most, again):
    config = Config().with_(store={"retain_word_objects": most})
    rows = [(i, "push", "c", f"b{i % 2}", f"o{i % 7 if again else i}", f"apple w{i % 5} pear{i} the a@b{i % 3}.org", "eng") for i in range(20)]
    rows += [(20, "push", "c", "b0", "empty", "", "eng"), (21, "push", "c", "b1", "null", None, "eng"), (22, "push", "", "b1", "bad", "word", "eng")]
    plain = spark.createDataFrame(rows, OPLOG)
    # a flush of an object that never was, before all pushes, changes nothing
    general = spark.createDataFrame([(-1, "flusho", "c", "b0", "never", None, None), *rows], OPLOG)
    got = Index.from_log(plain, config)
    assert tables(got) == tables(Index.from_log(general, config))
    return got


def test_pushes_alone(spark):
    got = check(spark, 1000, False)
    assert "Window" not in got.postings._jdf.queryExecution().optimizedPlan().toString()
    assert got.kept().postings is got.postings  # written once


def test_objects_pushed_again(spark):
    check(spark, 1000, True)


def test_pushes_with_retention(spark):
    check(spark, 3, False)
    check(spark, 3, True)


def test_nothing(spark):
    assert oplog.fold(spark.createDataFrame([], OPLOG), Config())["postings"].count() == 0
