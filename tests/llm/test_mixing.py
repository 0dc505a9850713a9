import heapq
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexquarry.llm import mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Brute force: shares by weight in the order of code points; who is above the cap stops there, the excess goes round again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight, size = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}, dict(order)
    left, out, free = share * sum(size.values()), {}, [s for s, _ in order]
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > cap * size[s]]
        out |= {s: cap * size[s] if full else unit * weight[s] for s in full or free}
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def test_targets_stop_at_the_cap_and_share_the_excess(spark):
    rng = random.Random(7)
    many = [(f"host{i}.example", rng.choice([0, 1, 30, 500, 100000])) for i in range(300)] + [("Ä", 40), (None, 70)]
    for sizes in ([("b", 10), ("a", 1000), (None, 100), ("c", 500)], [("a", 0), ("b", 0)], many):
        df = spark.createDataFrame([("n" if s is None else "s" + s, w) for s, w in sizes], "source_key string, source_size long").repartition(3)
        got = {None if r.source_key == "n" else r.source_key[1:]: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(targets(sizes))
    assert mixing.targets(df.where("false")).collect() == []


@pytest.mark.parametrize("at_once", [8192, 5])
def test_quotas_are_those_of_the_highest_quotients(spark, monkeypatch, at_once):
    monkeypatch.setattr(mixing, "RANKED", at_once)
    rng = random.Random(1)
    rows, want = [], {}
    for s in ("x", "y"):
        words = [rng.choice([0, 1, 5, 90, 700, 701, 5000]) for _ in range(40)]
        seats = {"x": 777, "y": 13}[s]
        rows += [(s, i, w, seats) for i, w in enumerate(words)]
        heap, got = [(-float(w), i, 0) for i, w in enumerate(words) if w], dict.fromkeys(range(40), 0)
        heapq.heapify(heap)
        for _ in range(seats):
            _, i, k = heapq.heappop(heap)
            got[i] += 1
            heapq.heappush(heap, (-words[i] / (2 * k + 3), i, k + 1))
        want |= {(s, i): n for i, n in got.items()}
    out = mixing.quotas(spark.createDataFrame(rows, "source_key string, shard int, weight long, seats_of_source long"))
    assert {(r.source_key, r.shard): r.seats for r in out.collect()} == want


@pytest.mark.parametrize("shard_words", [1 << 16, 400])
def test_mix_keeps_its_promises(spark, monkeypatch, shard_words):
    monkeypatch.setattr(mixing, "SHARD_WORDS", shard_words)
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), " ".join(["w"] * rng.randint(0, 300)), "old", i) for i in range(400)]
    rows += [(7, "a", "x y z", "old", 1)] * 3 + [(None, "b", "one two", "old", 1), (500, "b", None, "old", 1), (501, "d", "long " * 30000, "old", 1), (502, "e", " \n", "old", 1), (503, "f", "three small words", "old", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, Taken string, Shard long").repartition(5)
    out = mixing.mix(docs)
    first = sorted(map(repr, out.select("doc_id", "size", "taken", "target").collect()))
    assert first == sorted(map(repr, mixing.mix(docs.repartition(2)).select("doc_id", "size", "taken", "target").collect()))
    got = out.collect()
    assert len(got) == len(rows) and sum(r.Shard for r in got) == sum(r[-1] for r in rows)
    assert all(0 <= r.taken <= 2 * r.size and r.size == len((r.text or "").split()) for r in got)
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert sum(r.size for r in mine) == mine[0].source_size
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(1, 0.004 * mine[0].target)
    copies = mixing.taken_texts(out).groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n"))
    taken = out.where("taken > 0").groupBy("doc_id").agg(F.sum("taken").alias("n"))
    assert sorted(map(repr, copies.collect())) == sorted(map(repr, taken.collect()))


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_small_and_large_sources_both_meet_their_targets(spark, monkeypatch):
    """Many shards for one source, some for the other."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1000)
    rows = [(i, "big" if i < 3000 else "small", " ".join(["w"] * 20)) for i in range(3300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"))
    for r in got.collect():
        assert r.taken == pytest.approx(r.target, rel=0.002)


def test_the_query_on_whole_tables(spark):
    """op9 against plain sums at sf0.01: sizes, targets, and each source's words near its target."""
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: (r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t) in text.items()}
    whole = Counter()
    for i, (s, _) in text.items():
        whole[s] += size[i]
    aim, taken = targets(list(whole.items())), Counter()
    got = mixing.op9_mix_sources(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        s = text[r.doc_id][0]
        assert (r["size"], r.source_size) == (size[r.doc_id], whole[s]) and r.target == pytest.approx(aim[s]) and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in whole:
        assert taken[s] == pytest.approx(aim[s], rel=0.004)
