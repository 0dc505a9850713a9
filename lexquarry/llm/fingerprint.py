"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing cuts a sequence into phrases whose ends depend on a few neighbouring symbols only: runs are
contracted, each symbol is labelled by the lowest bit in which it differs from the symbol before it, four times, until
few labels are left, and phrases start at the local maxima of the labels.  The names of the phrases (hashes of their
symbols) are the next level's sequence.  Equal substrings so get equal phrase names in their interiors wherever they
stand.  A fingerprint is the SKETCH smallest names of the levels from FIRST_LEVEL on.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neardup import mixed
from .util import blocks, table

#: Levels whose phrases count (phrases of level 3 have about 30 characters), and names kept.
FIRST_LEVEL, LAST_LEVEL, SKETCH = 3, 5, 64
_C = np.uint64(0x9E3779B97F4A7C15)
#: Code points that are parsed at a time (one text at least).
CHARS = 1 << 19
#: Rows of a range, about; bounds of a group, within which a row's range is looked up; most groups.
RANGE_ROWS, GROUP, MOST_GROUPS = 2048, 256, 256


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing: 64-bit symbols to fewer than 6 labels; neighbours stay different."""
    for width in (64, 8, 4, 3):
        before = np.empty_like(x)
        before[1:] = x[:-1]
        before[first] = x[first] ^ x.dtype.type(1)
        d = x ^ before
        at = np.bitwise_count((d & -d) - x.dtype.type(1))
        x = ((at << 1) | ((x >> at.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)).astype(np.uint8)
    return x


def parse(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases, and the places (in the new sequence) where texts begin.

    x: names of all texts one after the other; first: places where texts begin (none is empty).
    """
    new = np.empty(len(x), dtype=bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[first] = True
    at = np.flatnonzero(new)
    y, run = x[at], np.diff(at, append=len(x))
    long = run > 1
    y[long] = mixed(y[long] + run[long].astype(np.uint64) * _C)
    begins = np.searchsorted(at, first)
    lab = _labels(y, begins)
    peak = np.zeros(len(y), dtype=bool)
    peak[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:])
    ends = np.append(begins[1:], len(y)) - 1
    peak[ends] = False
    peak[begins] = True
    starts = np.flatnonzero(peak)
    place = np.arange(len(y)) - np.repeat(starts, np.diff(starts, append=len(y)))
    names = mixed(np.add.reduceat(mixed(y + place.astype(np.uint64) * _C), starts))
    return names, np.searchsorted(starts, begins)


def sketches(texts: list[str]) -> list[np.ndarray]:
    """For each text its SKETCH smallest 32-bit names, ascending; none for an empty text."""
    out = [np.zeros(0, dtype=np.uint32)] * len(texts)
    held, chars = [], 0
    for i, t in enumerate(texts):
        if t:
            held.append(i)
            chars += len(t)
        if held and (chars >= CHARS or i == len(texts) - 1):
            for j, s in zip(held, _sketches([texts[j] for j in held])):
                out[j] = s
            held, chars = [], 0
    if held:
        for j, s in zip(held, _sketches([texts[j] for j in held])):
            out[j] = s
    return out


def _sketches(texts: list[str]) -> list[np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    first = np.cumsum([0] + [len(t) for t in texts[:-1]])
    x = mixed((codes.astype(np.uint64) + np.uint64(1)) * _C)
    kept: list[list[np.ndarray]] = [[] for _ in texts]
    for level in range(1, LAST_LEVEL + 1):
        x, first = parse(x, first)
        if level >= FIRST_LEVEL:
            for i, (a, b) in enumerate(zip(first, np.append(first[1:], len(x)))):
                kept[i].append((mixed(x[a:b] + np.uint64(level)) >> np.uint64(32)).astype(np.uint32))
    return [np.unique(np.concatenate(k))[:SKETCH] for k in kept]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common names among the SKETCH smallest of both together; 1 for two empty texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SKETCH]
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True).sum() / len(union))


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by the first as many code points of the following one, or all of them."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, fingerprint for each row; null counts as empty; empty texts have the empty fingerprint; equal texts
    have equal ones.  Other columns of docs are left out."""
    from .util import column, map_blocks

    lean = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def work(block):
        ts = column(block, "text").to_pylist()
        return {key: column(block, "_k"), "n_chars": [len(t) for t in ts], "fingerprint": [written(s) for s in sketches(ts)]}

    return map_blocks(lean, lambda: work, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_chars long, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _follow(batches):
    """Rows of a range in order, then its trailing row: the text that follows the range's last."""
    arrow = pa.schema([(x.split()[0], {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[x.split()[1]]) for x in _OUT.split(", ")])
    held: list = []  # the row whose following text is not yet known, with its sketch

    def flush(rows):
        mine, texts = rows, [t for *_, t in rows]
        sk = sketches(texts)
        pairs = [(i, i + 1) for i in range(len(mine) - 1) if mine[i][0] == mine[i + 1][0] and not mine[i][2]]
        new = [edited(texts[i], texts[j]) for i, j in pairs]
        es = sketches(new)
        cols = [
            [mine[i][1] for i, _ in pairs],
            [len(texts[i]) for i, _ in pairs],
            [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in new],
            [written(sk[i]) for i, _ in pairs],
            [written(e) for e in es],
            [likeness(sk[i], e) for (i, _), e in zip(pairs, es)],
            [likeness(sk[i], sk[j]) for i, j in pairs],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    for block in blocks(batches, "text"):
        rows = held + list(zip(*(block.column(block.schema.get_field_index(c)).to_pylist() for c in ("rng", "doc_id", "trailing", "text"))))
        if len(rows) > 1:
            yield flush(rows)
        held = rows[-1:]


def _range_of(ident: Column, bounds: list[int]) -> Column:
    """How many of the falling bounds are above ident: groups are told apart by their last bounds, then one is searched."""
    above = lambda xs: F.size(F.filter(xs, lambda b: b > ident))
    as_array = lambda xs, kind: F.from_json(F.lit(json.dumps(xs)), kind)  # noqa: E731  one literal, whatever the number
    if len(bounds) < GROUP:
        return above(as_array(bounds, "array<long>")).cast("int")
    groups = [bounds[i : i + GROUP] for i in range(0, len(bounds), GROUP)]
    group = above(as_array([g[-1] for g in groups if len(g) == GROUP], "array<long>"))
    within = F.coalesce(F.get(as_array(groups, "array<array<long>>"), group), as_array([], "array<long>"))
    return (group * GROUP + above(within)).cast("int")


def edited_fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third comes from the next one in descending key order.

    Null texts count as empty, null keys come last, rows with equal keys are ordered by text; after the last row comes the
    first; a single row follows itself.  An empty table gives no rows.  Rows are dealt into ranges of keys (65,536 at most;
    they then hold more rows, which are worked on as streams); the first row of a range is also sent to the range before
    it, so that ranges are worked on apart.  doc_id, n_chars and the columns of the op10 query.
    """
    lean = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ident = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    n = lean.count()
    parts = max(1, min(GROUP * MOST_GROUPS, -(-n // RANGE_ROWS)))
    cuts = [i / parts for i in range(1, parts)]
    bounds = lean.agg(F.percentile_approx(ident, cuts, max(10000, 4 * parts))).head()[0] if cuts else []
    rng = _range_of(ident, sorted(set(bounds or []), reverse=True))
    ranged = lean.withColumn("rng", rng)
    # one row for each range: its first key, and the range before it, which that row follows
    heads = sorted((r["rng"], r["head"]) for r in ranged.select("rng", ident.alias("ident")).groupBy("rng").agg(F.max("ident").alias("head")).collect())
    if not heads:
        return lean.sparkSession.createDataFrame([], _OUT)
    trails = [(heads[(i + 1) % len(heads)][1], r) for i, (r, _) in enumerate(heads)]
    trail = lean.sparkSession.createDataFrame(trails, "head long, also int")
    ranged = ranged.join(F.broadcast(trail), ident == F.col("head"), "left")  # a row for each range, GROUP * MOST_GROUPS at most
    copies = F.array_compact(F.array(F.struct(F.col("rng").alias("rng"), F.lit(False).alias("trailing")), F.when(F.col("also").isNotNull(), F.struct(F.col("also").alias("rng"), F.lit(True).alias("trailing")))))
    dealt = ranged.withColumn("copy", F.explode(copies)).select("copy.rng", "copy.trailing", "doc_id", "text")
    sorted_rows = dealt.repartition(len(heads), "rng").sortWithinPartitions("rng", "trailing", F.desc_nulls_last("doc_id"), "text")
    return sorted_rows.mapInArrow(_follow, _OUT)


def op10_lcp_fingerprints(spark, sf_dir: str) -> DataFrame:
    """:func:`edited_fingerprints` of ``documents``; null texts count as empty."""
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
