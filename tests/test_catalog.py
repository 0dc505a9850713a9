"""Every query with SQL agrees with DuckDB on the smallest tables; the others run."""

import duckdb
import pytest

from lexquarry.plans import catalog

ORACLES = catalog.oracles()
SF = "/root/testdata/sf0.001"


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else repr(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "conversations", "part"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        r = con.execute(ORACLES[name])
        cols = [d[0] for d in r.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows(df.columns, [tuple(x) for x in got]) == rows(cols, r.fetchall())
    else:
        assert got


def test_alternates_never_fall_back_to_nested_loops(spark):
    from lexquarry.operators import search

    index = catalog.index_of(spark, SF)
    plan = search.search(catalog.asked(spark, SF, catalog._CUT()), index, catalog.WORDS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan


def agrees(spark, name, sf):
    df, con = catalog.QUERIES[name](spark, sf), duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "part"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    r = con.execute(ORACLES[name])
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows([d[0] for d in r.description], r.fetchall())


@pytest.mark.parametrize("name", ["index_df", "index_idf", "index_postings", "count_object", "count_bucket", "list_terms", "query_exact"])
def test_frequent_words_are_whole(spark, name):
    """Tables on which words are in more than 1000 documents of a language."""
    agrees(spark, name, "/root/testdata/sf0.1")


def test_an_address_in_many_documents(spark, tmp_path):
    rows = [(i, "write to anna.7@mail1.example.com" + " again" * (i % 3), "en") for i in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.mail, r.docs, r.first_doc) for r in catalog.QUERIES["query_special_and"](spark, str(tmp_path)).collect()] == [("anna.7@mail1.example.com", 1200, 0)]


def test_addresses_are_asked_for_in_an_index_of_their_own(spark, tmp_path, monkeypatch):
    """Postings are made for the addresses alone, whatever else the texts hold; the answer is the SQL's."""
    made = []
    whole = catalog.Index.from_documents
    monkeypatch.setattr(catalog.Index, "from_documents", lambda *a, **b: made.append(whole(*a, **b)) or made[-1])
    texts = ["Plain words, ends. at naïve café", "ask b@x.org or a.1@y.de, b@x.org", "éb@x.org x 10.0.0.1 @user", None, "", "b@x.org_1 +49 30 1234567"]
    rows = [(i, texts[i % len(texts)], "de" if i % 4 else "en") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    r = con.execute(ORACLES["query_special_and"])
    got = catalog.QUERIES["query_special_and"](spark, str(tmp_path))
    assert rows_of(got) == sorted(map(tuple, r.fetchall()))
    assert {x["term"] for x in made[0].postings.select("term").distinct().collect()} == {x[0] for x in rows_of(got)}


def rows_of(df):
    return sorted(tuple(r[c] for c in ("mail", "docs", "first_doc")) for r in df.collect())


def test_a_word_with_thousands_of_dots(spark):
    from pyspark.sql import functions as F

    from lexquarry.functions import lexer

    text = "a." * 6000 + " b"
    assert spark.createDataFrame([(text,)], "text string").select(lexer.words(F.col("text"))).head()[0] == [text[:-3], "b"]
