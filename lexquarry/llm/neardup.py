"""MinHash near-duplicates by a multi-index Hamming join.

A document is its set of five-word shingles.  HASHES minima of it, cut to 16 bits each, are its signature; two signatures
differ in the hashes at which they disagree.  At similarity 0.85 a signature differs in 0.15 * HASHES places on average;
MOST_ERRORS lies almost five deviations above this, and so does ``layout``'s choice for 0.80.  The signature is split into CHUNKS chunks: a pair with at most
MOST_ERRORS differences has a chunk with at most MOST_ERRORS // CHUNKS of them (pigeonhole), so each document is filed
under every chunk with up to that many places left out, and every such pair meets in a bucket.  Links are confirmed on
the full sets.

Documents that stay open after the first round get a long sketch, LONG minima of four bits each: two sketches that differ
in more places than DEVIATIONS deviations above what is expected at the similarity asked for are no link.  In a group of
copies that differ from one another by many edits this rules out most pairs before their texts are read.

Equal sets are one class from the start, and buckets with the same members are one bucket.  Within a bucket members are
first tried against its lead, the one with the fewest shingles of its own; only buckets whose members then still lie in different components give
further pairs, and only between components: a link inside a component changes nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import column, map_blocks, materialise, release, table, tidy

#: Words of a shingle, minima, and the chunks of the signature with the errors allowed in each.
SHINGLE, HASHES, MOST_ERRORS, CHUNKS = 5, 64, 23, 12
ERRORS = MOST_ERRORS // CHUNKS
assert ERRORS == 1  # _first_meeting counts on it
#: Least similarity in percent, with the chunks that guarantee it (one error each: twice as many differences less one).
LAYOUTS = ((85, CHUNKS), (80, 14))
#: Minima of a long sketch (four bits each, the bits of 64 minima to a word), and deviations above the expected differences.
LONG, BITS, DEVIATIONS = 512, 4, 5.0
_WORDS = [f"w{b}_{i}" for b in range(BITS) for i in range(LONG // 64)]
#: Names of shingles that are counted together, about.
SHARD_NAMES = 1 << 19
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD = np.random.default_rng(20).integers(1, 1 << 62, 2 * HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LONG_ODD = np.random.default_rng(21).integers(1, 1 << 62, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit names of the distinct shingles; fewer words than a shingle are one shingle; no words, none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = min(width, len(words))
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    h = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = mixed(h * _ODD[0] + w[k : len(w) - n + 1 + k])
    return np.unique(h + np.uint64(n < width))


def signature(names: np.ndarray) -> np.ndarray:
    """HASHES minima, the low 16 bits of each."""
    out = np.empty(HASHES, dtype=np.uint16)
    for k in range(HASHES):
        h = names * _ODD[k]
        h ^= h >> np.uint64(32)
        h *= _ODD[HASHES + k]
        out[k] = int(h.min()) >> 40 & 0xFFFF
    return out


def long_sketch(names: np.ndarray) -> np.ndarray:
    """LONG minima, BITS bits of each, as words: first the lowest bits of all, then the next."""
    least = np.full(LONG, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(names), 256):
        h = names[a : a + 256, None] * _LONG_ODD
        h ^= h >> np.uint64(32)
        h *= _LONG_ODD[::-1]
        np.minimum(least, h.min(axis=0), out=least)
    planes = [np.packbits((least >> np.uint64(40 + b) & np.uint64(1)).astype(bool)) for b in range(BITS)]
    return np.concatenate(planes).view(np.uint64)


def most_apart(percent: int) -> int:
    """Differences of long sketches that a pair of the least similarity has with near certainty at most."""
    p = (100 - percent) / 100 * (1 - 2.0**-BITS)
    return int(LONG * p + DEVIATIONS * (LONG * p * (1 - p)) ** 0.5)


def _sketched(block: pa.RecordBatch) -> dict:
    each = np.array([long_sketch(shingles(t)) for t in column(block, "text").to_pylist()]).view(np.int64)
    return {"rep": column(block, "doc_id")} | {w: each[:, i] for i, w in enumerate(_WORDS)}


def _apart(x: str, y: str):
    """Places at which two long sketches (columns of the two sides) differ."""
    differ = lambda w: F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))
    each = [F.bit_count(reduce(lambda p, q: p.bitwiseOR(q), [differ(f"w{b}_{i}") for b in range(BITS)])) for i in range(LONG // 64)]
    return reduce(lambda p, q: p + q, each)


def layout(percent: int) -> int:
    """The chunks for a similarity: 2 * chunks - 1 differences lie almost five deviations above those expected."""
    for least, chunks in LAYOUTS:
        if percent >= least:
            return chunks
    raise ValueError(f"percent: {percent} is below {LAYOUTS[-1][0]}, the least that the signatures are laid out for")


def plan(hashes: int = HASHES, chunks: int = CHUNKS, errors: int = ERRORS) -> list[tuple[int, ...]]:
    """The places of every bucket key: each chunk with every choice of ``errors`` places left out."""
    from itertools import combinations

    cut = [hashes * i // chunks for i in range(chunks + 1)]
    return [kept for a, b in zip(cut, cut[1:]) for kept in combinations(range(a, b), b - a - errors)]


_PLANS = {chunks: plan(chunks=chunks) for _, chunks in LAYOUTS}


def keys(sig: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    out = np.empty(len(_PLANS[chunks]), dtype=np.uint64)
    for i, places in enumerate(_PLANS[chunks]):
        out[i] = xxhash.xxh64_intdigest(sig[list(places)].tobytes(), i)
    return out


def _signed(block: pa.RecordBatch) -> dict:
    found = [shingles(t) for t in column(block, "text").to_pylist()]
    return {
        "doc_id": column(block, "doc_id"),
        "n_shingles": [len(x) for x in found],
        "set_key": [xxhash.xxh128_digest(x.tobytes()) if len(x) else None for x in found],
        "sig": [signature(x).tobytes() if len(x) else None for x in found],
    }


def _filed(chunks: int):
    def work(block: pa.RecordBatch) -> dict:
        sigs = [np.frombuffer(x, dtype=np.uint16) for x in column(block, "sig").to_pylist()]
        return {"rep": column(block, "rep"), "keys": [keys(s, chunks).view(np.int64) for s in sigs]}

    return work


def _confirm(percent: int):
    def work(block: pa.RecordBatch) -> dict:
        a, b, ok, known = column(block, "a").to_pylist(), column(block, "b").to_pylist(), [], {}

        def names(text):
            if text not in known:
                known[text] = shingles(text)
            return known[text]

        for x, y in zip(column(block, "text_a").to_pylist(), column(block, "text_b").to_pylist()):
            x, y = names(x), names(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        return {"a": [v for v, k in zip(a, ok) if k], "b": [v for v, k in zip(b, ok) if k]}

    return work


def _errors(x: str, y: str):
    """Hashes at which two signatures (binary columns) differ."""
    return _errors_in(x, y, range(HASHES))


def _errors_in(x: str, y: str, places):
    return reduce(lambda p, q: p + q, [(F.substring(x, 2 * i + 1, 2) != F.substring(y, 2 * i + 1, 2)).cast("int") for i in places])


def _first_meeting(k: str, x: str, y: str, chunks: int = CHUNKS):
    """Whether key number k is the first of those under which a pair of signatures is filed alike.

    The first chunk with one error at most decides: with one, a single key of it leaves that place out; with none, its
    first key counts.  So each pair is met once, however many buckets it shares.
    """
    cut = [HASHES * i // chunks for i in range(chunks + 1)]
    chunk_of = [next(c for c in range(chunks) if kept[0] < cut[c + 1]) for kept in _PLANS[chunks]]
    errors = [_errors_in(x, y, range(a, b)) for a, b in zip(cut, cut[1:])]
    chunk, wrong = F.lit(chunks), F.lit(0)
    for c in reversed(range(chunks)):
        chunk, wrong = F.when(errors[c] <= 1, c).otherwise(chunk), F.when(errors[c] <= 1, errors[c]).otherwise(wrong)
    at = F.col(k)
    mine = F.get(F.array(*map(F.lit, chunk_of)), at)
    opens = F.get(F.array(*[F.lit(i == 0 or chunk_of[i - 1] != c) for i, c in enumerate(chunk_of)]), at)
    return (mine == chunk) & ((wrong == 1) | opens)


def _packed(shards: int):
    """Names of a block's texts by shard.  Names that several of its texts have come once, with a null rep: they are shared
    in any case, so a name that is very common is sent once for a block and not for each text."""

    def work(block: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"shard": [], "rep": [], "h": [], "names": []}

        def deal(rep, h, names):
            at = (names % np.uint64(shards)).astype(np.int64)
            names = names[np.argsort(at, kind="stable")]
            for k, n in zip(*np.unique(at, return_counts=True)) if len(names) else [(h % shards, 0)]:
                out["shard"].append(int(k))
                out["rep"].append(rep)
                out["h"].append(h)
                out["names"].append(names[:n].tobytes())
                names = names[n:]

        raw = column(block, "text").to_pylist()
        each = [shingles(t) for t in raw]
        known, inverse, count = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        lone, at = count[inverse] == 1, 0
        for rep, text, names in zip(column(block, "doc_id").to_pylist(), raw, each):
            deal(rep, xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) >> 1, names[lone[at : at + len(names)]])
            at += len(names)
        deal(None, 0, known[count > 1])
        return out

    return work


def _alone(t: pa.Table) -> pa.Table:
    """How many shingles of each document are in no other, within a shard of names."""
    parts = [np.frombuffer(x, dtype=np.uint64) for x in t.column("names").to_pylist()]
    reps = t.column("rep").to_pylist()
    common = [x for x, rep in zip(parts, reps) if rep is None]
    _, inverse, count = np.unique(np.concatenate(parts + common), return_inverse=True, return_counts=True)
    once = np.append(0, np.cumsum(count[inverse] == 1))
    own = np.diff(once[np.cumsum([0] + [len(x) for x in parts])]).astype(np.int64)
    out = pa.table({"rep": t.column("rep"), "h": t.column("h"), "own": own})
    out = out.filter(pc.is_valid(out.column("rep")))
    del parts, common, inverse, count, once
    release()
    return out


def own_shingles(texts: DataFrame, total: int) -> DataFrame:
    """(rep, own): shingles that no other of the texts has.

    What a document has alone can't be in an intersection, so this bounds its similarity to any other; in a group of
    copies with differing edits it rules out most pairs that signatures can't.
    """
    shards = max(1, -(-total // SHARD_NAMES))
    packed = map_blocks(texts, lambda: _packed(shards), "shard long, rep long, h long, names binary")
    each = packed.groupBy("shard").applyInArrow(_alone, "rep long, h long, own long")
    each = each.groupBy("rep", "h").agg(F.sum("own").alias("own"))
    return each.groupBy("rep").agg(F.when(F.count("*") == 1, F.max("own")).otherwise(0).alias("own"))  # a key with several texts: no bound


def _near(percent: int, n_a: str, n_b: str, own_a: str, own_b: str, sig_a: str, sig_b: str):
    """Whether sizes, lone shingles and signatures leave a pair a chance."""
    need = (F.col(n_a) + F.col(n_b)) * percent / (100.0 + percent) - 1e-6  # of the intersection, for the similarity asked for
    return (F.least(F.col(n_a) - F.col(own_a), F.col(n_b) - F.col(own_b)) >= need) & (_errors(sig_a, sig_b) < 2 * layout(percent))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, label: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; a frequent document's pairs can be split by the joins."""
    pairs = materialise(pairs.distinct(), f"{label}-pairs")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return materialise(map_blocks(both, lambda: _confirm(percent), "a long, b long", weigh="text_a").distinct(), f"{label}-links")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(rep, comp) for the nodes that have links: the smallest node reachable.

    In a round every node looks at its neighbours' labels, and the whole of a component then follows the smallest label
    that any of its nodes has seen, and that one's own; rounds grow with the logarithm of the longest chain.
    """
    both = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-both")
    now = both.select(F.col("a").alias("rep"), F.col("a").alias("comp")).distinct()
    while True:
        near = both.join(now.select(F.col("rep").alias("b"), "comp"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("comp").alias("least"))
        new = now.join(near, "rep").select("rep", "comp", F.least("comp", "least").alias("next"))
        hook = new.groupBy("comp").agg(F.min("next").alias("root"))
        hook = hook.join(hook.select(F.col("comp").alias("root"), F.col("root").alias("root2")), "root", "left").select("comp", F.coalesce("root2", "root").alias("root"))
        settled = F.least("next", "root")
        after = materialise(new.join(hook, "comp").select("rep", settled.alias("comp"), (settled < F.col("comp")).cast("int").alias("moved")), label)
        if not after.agg(F.max("moved")).head()[0]:
            return after.select("rep", "comp")
        now = after.select("rep", "comp")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id, kept.

    Links join documents with ``100 * intersection >= percent * union`` of their shingle sets (percent of 80 or more: for
    less no signature distance is laid out).  component_id is the smallest key reachable over links, itself included;
    kept is true where it is the row's own.  Null, empty and blank texts have no shingles and are linked with nothing.
    Keys are integers; rows with the same key are one document, linked with each other.  Rows with a null key have a null
    component_id, are kept and linked with nothing.
    """
    with tidy() as keep:  # only the outcome, a small row for each document, is read from now on
        chunks = layout(percent)
        lean = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        built = materialise(map_blocks(lean, lambda: _signed, "doc_id long, n_shingles long, set_key binary, sig binary"), "dup-signed")
        whole = built.where("set_key is not null and doc_id is not null")
        classes = whole.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        heads = materialise(classes, "dup-classes")
        members = materialise(whole.select("doc_id", "set_key").join(heads.select("set_key", "rep"), "set_key").select("doc_id", "rep").distinct(), "dup-members")
        entries = map_blocks(heads.select("rep", "sig"), lambda: _filed(chunks), "rep long, keys array<long>", weigh="sig").select("rep", F.posexplode("keys").alias("k", "bucket"))
        entries = materialise(entries, "dup-entries")
        shared = entries.groupBy("bucket").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("bucket")
        buckets = materialise(entries.join(shared, "bucket"), "dup-buckets")
        # only documents that share a bucket can have links; their texts are gathered once
        wanted = buckets.select(F.col("rep").alias("doc_id")).distinct()
        held = materialise(lean.join(wanted, "doc_id", "left_semi"), "dup-texts")
        total = heads.join(wanted, heads["rep"] == wanted["doc_id"], "left_semi").agg(F.sum("n_shingles")).head()[0] or 0
        facts = materialise(heads.select("rep", "n_shingles", "sig").join(own_shingles(held, total), "rep"), "dup-facts")
        # the member with the fewest shingles of its own leads a bucket: the others are most alike to it
        leads = buckets.join(facts.select("rep", "n_shingles", (F.col("own") / F.col("n_shingles")).alias("odd")), "rep").groupBy("bucket").agg(F.min(F.struct("odd", "rep"))["rep"].alias("lead"))
        buckets = materialise(buckets.join(leads, "bucket"), "dup-led")
        ends = [facts.select(F.col("rep").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("own").alias(f"own_{k}"), F.col("sig").alias(f"sig_{k}")) for k in "ab"]
        stars = buckets.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
        stars = stars.join(ends[0], "a").join(ends[1], "b").where(_near(percent, "n_a", "n_b", "own_a", "own_b", "sig_a", "sig_b")).select("a", "b")
        links = confirmed(stars, held, percent, "dup-first")
        same_key = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
        first = components(links.unionByName(same_key), "dup-first")
        # what stays open: buckets whose members lie in several components
        comp = F.coalesce("comp", "rep")
        tagged = buckets.join(first, "rep", "left").select("bucket", "k", "rep", "lead", comp.alias("comp"))
        mixed_up = tagged.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
        # the pairs of the lead have been tried; who has too many shingles of its own has no partner of any size
        still = tagged.join(mixed_up, "bucket").where("rep <> lead").join(facts, "rep").where(F.col("own") * 100 <= (100 - percent) * F.col("n_shingles"))
        reps = still.select(F.col("rep").alias("doc_id")).distinct()
        sketches = materialise(map_blocks(held.join(reps, "doc_id", "left_semi"), lambda: _sketched, "rep long, " + ", ".join(f"{w} long" for w in _WORDS)), "dup-sketches")
        still = materialise(still.join(sketches, "rep"), "dup-open")
        l, r = still.alias("l"), still.alias("r")
        apart = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.rep") < F.col("r.rep")) & (F.col("l.comp") != F.col("r.comp")) & (_apart("l", "r") <= most_apart(percent))
        cross = l.join(r, apart & _near(percent, "l.n_shingles", "r.n_shingles", "l.own", "r.own", "l.sig", "r.sig") & _first_meeting("l.k", "l.sig", "r.sig", chunks))
        more = confirmed(cross.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")), held, percent, "dup-more")
        final = first if more.isEmpty() else components(links.unionByName(same_key).unionByName(more), "dup-all")
        placed = members.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(final, "rep", "left").select("doc_id", comp.alias("comp"))
        out = keep(materialise(built.select("doc_id", "n_shingles").join(placed, "doc_id", "left"), "dup-out"))
    ident = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(key), "n_shingles", ident.alias("component_id"), F.coalesce(ident == F.col("doc_id"), F.lit(True)).alias("kept"))


def op1_minhash_components(spark, sf_dir: str) -> DataFrame:
    """:func:`near_duplicates` of ``documents``; texts without words are linked with nothing, repeated rows with each other."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
