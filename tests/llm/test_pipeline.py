import re

from pyspark.sql import functions as F

import corpus_pipeline
from lexquarry.llm import bpe, neardup, pii, toxicity
from lexquarry.sources import scratch

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "near_dedup", "pii", "mixing", "bpe"]
    clean = steps["toxicity"](spark, docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scored.where("score < 0.7").collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()}
    known = {r.doc_id for r in labels.collect()}
    assert len(gone & toxic) >= 0.5 * len(toxic)  # labels have errors
    assert len((gone & known) - toxic) <= 0.05 * len(known)
    alone = steps["near_dedup"](spark, clean, SF).cache()
    kept = neardup.near_duplicates(clean, percent=corpus_pipeline.NEAR_PERCENT).where("kept")
    assert sorted(r.doc_id for r in alone.collect()) == sorted(r.doc_id for r in kept.collect())
    private = steps["pii"](spark, alone, SF).cache()
    assert private.columns == docs.columns and private.count() == alone.count()
    assert all(r.n_chars == len(r.text) for r in private.collect())
    found = pii.replace_pii(alone).where("n_entities > 0").select("doc_id").collect()
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in (alone, private))
    assert found and all(before[r.doc_id] != after[r.doc_id] for r in found) and sum(before[k] != after[k] for k in before) == len(found)
    mails = lambda df: {m for r in df.collect() for m in re.findall(r"[\w.]+@[\w.]+\w", r.text)}
    assert mails(alone) and not mails(alone) & mails(private)
    mixed = steps["mixing"](spark, private, SF).cache()
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert abs(words(mixed) - 1.5 * words(private)) < 0.02 * words(private)
    coded = steps["bpe"](spark, mixed, SF)
    t = bpe.load(None)
    want = sorted(len(t.encode(r.text, add_special_tokens=False).ids) for r in mixed.collect())
    assert sorted(r.n_tokens for r in coded.collect()) == want


def test_repeated_and_odd_rows(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "A b c d e f", "en", "s", 11), (3, None, None, None, None), (None, "", "en", "s", 0), (4, "x", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "3", "4", "None"]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), SF).count() == 0
    private = corpus_pipeline.replace_personal_data(spark, docs, SF)
    assert sorted(map(repr, private.collect())) == sorted(repr(r) for r in docs.withColumn("n_chars", F.length("text").cast("long")).collect())
    mixed = corpus_pipeline.mix_sources(spark, private, SF)
    assert mixed.columns == docs.columns
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert abs(words(mixed) - 1.5 * words(docs)) <= 2 and {r.doc_id for r in mixed.collect()} <= {1, 2, 4}


def test_near_dedup_stage_against_brute_force(spark):
    from .test_neardup import brute, corpus

    # 200 distinct words and a copy with 4 changed far apart: 176 shingles of 216 are shared, a similarity of 0.81
    words = [f"w{i}" for i in range(200)]
    edited = [f"x{i}" if i % 50 == 25 else w for i, w in enumerate(words)]
    rows = [*((k + 10, t) for k, t in corpus(7, 80)), (1, " ".join(words)), (2, " ".join(edited))]
    assert (2, 196, 2, True) in brute(rows) and (2, 196, 1, False) in brute(rows, 80)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in out) == [k for k, _, _, kept in brute(rows, 80) if kept]


def test_errors_guaranteed_at_80_percent_share_a_bucket():
    import random

    np, rng, chunks = neardup.np, random.Random(5), neardup.layout(80)
    base = np.array([rng.randrange(1 << 16) for _ in range(neardup.HASHES)], dtype=np.uint16)
    for _ in range(200):
        other = base.copy()
        for i in rng.sample(range(neardup.HASHES), 2 * chunks - 1):
            other[i] ^= 1
        assert set(neardup.keys(base, chunks)) & set(neardup.keys(other, chunks))


def test_different_texts_of_a_doc_id_stay(spark):
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (1, "A b c d e f"), (2, "P q r s t u"), (3, ""), (3, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, "A b c d e f"), (1, "p q r s t u"), (3, "")]


def test_run_applies_all_stages_and_leaves_only_its_result(spark):
    before = scratch.written()
    out = corpus_pipeline.run(spark, SF)
    assert scratch.written() == before
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
