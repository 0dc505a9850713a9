import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexquarry.llm import neardup


def brute(rows, percent=85):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for key, text in rows:
        w = (text or "").translate(lower).replace("\x1c", "_").replace("\x85", "_").encode().split()
        n = min(5, len(w))
        sets.append((key, frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()))
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted((k, len(s), find(k) if s else k, (find(k) if s else k) == k) for k, s in sets)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component_id string, rep int")
    return sorted(tuple(r) for r in neardup.near_duplicates(df).collect())


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.75:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w).swapcase() if rng.random() < 0.2 else " ".join(w))
        else:
            texts.append(" ".join(word() for _ in range(rng.choice([3, 30, 80, 150, 400]))))
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, texts))


def test_against_brute_force(spark):
    for seed in range(2):
        rows = corpus(seed)
        assert got(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(5, None), (4, ""), (3, " \n\t"), (9, "one two"), (2, "ONE\x0btwo"), (7, "one two three four five"), (8, "one two three four five six"), (1, "é " * 30000), (11, "É " * 30000), (12, "é " * 30001)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_repeated_keys_are_one_document(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    assert got(spark, [(7, a), (7, a), (7, b), (8, b), (9, "z"), (9, None)]) == [(7, 4, 7, True)] * 3 + [(8, 4, 7, False), (9, 0, 9, True), (9, 1, 9, True)]
    out = neardup.near_duplicates(spark.createDataFrame([(None, a), (None, a), (1, a)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in out) == [(False, 1, True), (True, None, True), (True, None, True)]


def test_every_allowed_error_pattern_shares_a_bucket():
    rng = random.Random(4)
    base = neardup.np.array([rng.randrange(1 << 16) for _ in range(neardup.HASHES)], dtype=neardup.np.uint16)
    for _ in range(200):
        other = base.copy()
        for i in rng.sample(range(neardup.HASHES), neardup.MOST_ERRORS):
            other[i] ^= 1
        assert set(neardup.keys(base)) & set(neardup.keys(other))


def test_components_of_a_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(500, 501)], "a long, b long")
    found = defaultdict(set)
    for r in neardup.components(links).collect():
        found[r.comp].add(r.rep)
    assert found == {0: set(range(n)), 500: {500, 501}}


def test_a_pair_is_met_once(spark):
    rng, np = random.Random(6), neardup.np
    rows, want = [], []
    for pair in range(60):
        a = np.array([rng.randrange(1 << 16) for _ in range(neardup.HASHES)], dtype=np.uint16)
        b = a.copy()
        for i in rng.sample(range(neardup.HASHES), rng.choice([0, 1, 3, 12, 23, 30])):
            b[i] ^= 5
        x, y = neardup.keys(a), neardup.keys(b)
        rows += [(pair, int(k), a.tobytes(), b.tobytes()) for k in np.flatnonzero(x == y)]
        want += [(pair, 1)] if (x == y).any() else []
    df = spark.createDataFrame(rows, "pair int, k int, x binary, y binary").where(neardup._first_meeting("k", "x", "y"))
    assert sorted((r["pair"], r["count"]) for r in df.groupBy("pair").count().collect()) == want


def test_own_shingles_against_brute_force(spark):
    """Common names, texts that share everything, and a key with two texts; in one block and in several."""
    rng = random.Random(9)
    line = " ".join(f"l{i}" for i in range(12))
    rows = [(i, f"{line} " + " ".join(rng.choice("abcd") + str(rng.randrange(40)) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, line), (61, line), (62, "p q r s t u"), (62, "p q r s t v w")]
    sets = [(k, set(neardup.shingles(t).tolist())) for k, t in rows]
    seen = Counter(x for _, s in sets for x in s)
    want = {k: sum(seen[x] == 1 for x in s) for k, s in sets} | {62: 0}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert {r.rep: r.own for r in neardup.own_shingles(df, 5 << 20).collect()} == want


def test_the_query_on_whole_tables(spark):
    """op1 against all pairs that share a shingle, at sf0.01."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.op1_minhash_components(spark, sf).collect()}
    assert got == set(brute(rows))


def test_long_sketches_differ_as_expected(spark):
    """Differences grow with 1 - similarity; the columns count what the arrays say."""
    np, rng = neardup.np, random.Random(3)
    names = np.array(sorted(rng.randrange(1 << 63) for _ in range(3000)), dtype=np.uint64)
    n = neardup.LONG // 64
    nibbles = lambda w: [sum((int(w[b * n + i // 64]) >> i % 64 & 1) << b for b in range(neardup.BITS)) for i in range(neardup.LONG)]
    rows = []
    for share in (1.0, 0.9, 0.8, 0.6):
        cut = int(1000 * 2 * share / (1 + share))
        a, b = neardup.long_sketch(names[:1000]), neardup.long_sketch(np.sort(np.append(names[:cut], names[1000 : 2000 - cut])))
        wrong = sum(x != y for x, y in zip(nibbles(a), nibbles(b)))
        expected = neardup.LONG * (1 - share) * 15 / 16
        assert abs(wrong - expected) <= 5 * (expected + 1) ** 0.5 and (share < 0.8 or wrong <= neardup.most_apart(80))
        rows.append((wrong, *[int(x) for x in a.view(np.int64)], *[int(x) for x in b.view(np.int64)]))
    words = neardup._WORDS
    df = spark.createDataFrame(rows, "n int, " + ", ".join(f"a{w} long" for w in words) + ", " + ", ".join(f"b{w} long" for w in words))
    df = df.select("n", F.struct(*[F.col(f"a{w}").alias(w) for w in words]).alias("l"), F.struct(*[F.col(f"b{w}").alias(w) for w in words]).alias("r"))
    assert [r.n for r in df.collect()] == [r.n for r in df.select(neardup._apart("l", "r").alias("n")).collect()]


def test_a_group_of_copies_that_all_differ(spark):
    """Edits of one text, most of them linked with few others: components as by brute force."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for k in range(80):
        w = list(base)
        for i in rng.sample(range(200), rng.choice([1, 2, 3, 4, 5, 6])):
            w[i] = f"e{rng.randrange(30)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        assert sorted(tuple(r) for r in neardup.near_duplicates(df, percent=percent).collect()) == brute(rows, percent)
