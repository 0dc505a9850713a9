"""Removal of repeated substrings with suffix arrays.

Every string of LENGTH bytes has an anchor: the leftmost of its smallest GRAM-byte hashes.  Equal strings have the same
anchor at the same place, so only stretches of text whose anchor occurs again can hold repeats, and two stretches need
comparing only if their anchors agree.  Stretches that are equal throughout are counted first and stand for one another.
The others are dealt into shards, anchor by anchor; a shard sorts its suffixes (Larsson-Sadakane refinement in numpy,
starting from seven-byte keys), computes the common prefixes of neighbours (Kasai's rule: a suffix that follows one of
the same kind has a prefix one shorter, so only the others are compared) and reads off the strings that occur twice.  An
anchor with very many different stretches is dealt over several shards; their sorted strings are then cut into ranges,
and the lists of a range are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import mixed
from .util import column, map_blocks, materialise, table, tidy

#: Bytes of a repeated string, of a hashed gram, and of a piece of a text that is parsed at a time.
LENGTH, GRAM, PIECE = 200, 24, 8 << 20
#: Bytes of a shard, about, and different stretches of an anchor above which it is dealt over several shards.
SHARD_BYTES, SPLIT = 1 << 20, 2048
_PLACE = np.uint64((1 << 24) - 1)
_B = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray, width: int = GRAM) -> np.ndarray:
    """Hashes of all substrings of ``width`` bytes (a sum of powers of two of at least 8), by doubling."""
    step, m, h, out, covered = 1, _B, mixed(data.astype(np.uint64) + np.uint64(1)), None, 0
    n = len(data) - width + 1
    with np.errstate(over="ignore"):
        while True:
            if width & step:
                part = h[covered : covered + n]
                out = part.copy() if out is None else out * m + part  # m is base ** step here
                covered += step
            if covered == width:
                return mixed(out)
            h = h[:-step] * m + h[step:]
            step, m = 2 * step, m * m


def stretches(data: bytes, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor) of the runs of starts of ``length``-byte strings with one anchor.

    ``ends``: where the texts in data end.  No string crosses an end.
    """
    x = np.frombuffer(data, dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if len(x) < length:
        return none, none, none.astype(np.uint64)
    h = gram_hashes(x, gram)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    wide, step, low = length - gram + 1, 1, key
    while 2 * step <= wide:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    n = len(x) - length + 1
    anchor = (np.minimum(low[:n], low[wide - step : wide - step + n]) & _PLACE).astype(np.int64)
    valid = np.zeros(n, dtype=bool)
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        valid[a : max(a, b - length + 1)] = True
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stop = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid) + 1
    return first, stop - first, h[anchor[first]]


def suffix_array(text: np.ndarray, ends: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of the strings in text (each ends at its end), sorted by their first ``depth`` symbols at least."""
    n = len(text)
    sym = np.zeros(n + 7, dtype=np.int64)
    sym[:n] = text.astype(np.int64) + 1
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)  # symbols to the end of the string
    key = np.zeros(n, dtype=np.int64)
    for k in range(7):
        key = (key << 9) | np.where(left > k, sym[k : k + n], 0)
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    head = np.empty(n, dtype=bool)
    head[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=head[1:])
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.flatnonzero(head)[np.cumsum(head) - 1]  # a group is named by its first place
    h = 7
    while h < depth:
        # the groups that are not sorted out: places whose neighbour is of the same group
        single = head & np.append(head[1:], True)
        at = np.flatnonzero(~single)
        if not len(at):
            break
        who = sa[at]
        far = np.where(left[who] > h, rank[np.minimum(who + h, n - 1)], -1)
        order = np.lexsort((far, rank[who]))
        who, far = who[order], far[order]
        sa[at] = who
        group = rank[who]
        start = np.empty(len(at), dtype=bool)
        start[0] = True
        start[1:] = (group[1:] != group[:-1]) | (far[1:] != far[:-1])
        head[at] = start
        rank[who] = at[np.flatnonzero(start)][np.cumsum(start) - 1]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, ends: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[i]: common prefix of suffixes sa[i - 1] and sa[i]; 0 for the first."""
    n = len(text)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
    begin = np.zeros(n, dtype=bool)
    begin[0] = True
    begin[ends[:-1][ends[:-1] < n]] = True
    phi = np.empty(n, dtype=np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    # where both suffixes follow equal symbols, the prefix is one shorter than that of the suffix before
    prev = np.maximum(np.arange(n) - 1, 0)
    derived = ~begin & (phi > 0)
    derived &= ~begin[np.maximum(phi, 0)] & (text[prev] == text[np.maximum(phi, 1) - 1])
    derived &= phi[prev] == phi - 1
    at = np.flatnonzero(~derived)
    found = np.zeros(len(at), dtype=np.int64)
    live = np.flatnonzero(phi[at] >= 0)
    words = np.zeros(n + 8, dtype=np.uint8)
    words[:n] = text
    packed = np.lib.stride_tricks.sliding_window_view(words, 8)
    while len(live):
        i, j, k = at[live], phi[at[live]], found[live]
        most = np.minimum(left[i], left[j]) - k
        same = packed[np.minimum(i + k, n)] == packed[np.minimum(j + k, n)]
        run = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        step = np.minimum(run, most)
        found[live] += step
        live = live[(step == 8) & (most > 8)]
    plcp = np.zeros(n, dtype=np.int64)
    plcp[at] = found
    source = np.maximum.accumulate(np.where(derived, 0, np.arange(n)))
    plcp = np.maximum(plcp[source] - (np.arange(n) - source), 0)
    return plcp[sa]


def repeated_starts(parts: list[bytes], weights: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all strings of ``length`` bytes in the parts: the part, its offset, and how often the string occurs (by weight)."""
    text = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    sa = suffix_array(text, ends, length)
    lcp = common_prefixes(text, ends, sa)
    group = np.cumsum(lcp < length)
    part = np.repeat(np.arange(len(parts)), sizes)
    whole = (ends[part] - np.arange(len(text)) >= length)[sa]
    where, group = sa[whole], group[whole]
    total = np.bincount(group, weights[part[where]])[group] if len(group) else np.zeros(0)
    return part[where], where - (ends - sizes)[part[where]], total


def _parse(block: pa.RecordBatch) -> dict:
    out: dict[str, list] = {k: [] for k in ("doc_id", "h", "anchors", "stretches", "starts", "counts")}
    rows = [(d, h, (t or "").encode("utf-8", "surrogatepass")) for d, h, t in zip(*(column(block, c).to_pylist() for c in ("doc_id", "h", "text")))]
    for piece in _pieces(rows):
        data = b"".join(x for *_, x in piece)
        ends = np.cumsum([len(x) for *_, x in piece])
        first, count, anchor = stretches(data, ends)
        view = memoryview(data)
        names = np.fromiter((xxhash.xxh3_64_intdigest(view[a : a + c + LENGTH - 1]) for a, c in zip(first.tolist(), count.tolist())), dtype=np.uint64, count=len(first))
        cut = np.searchsorted(first, ends, side="left")
        for (d, h, base, x), a, b, end in zip(piece, [0, *cut[:-1].tolist()], cut.tolist(), ends.tolist()):
            if b > a:
                out["doc_id"].append(d)
                out["h"].append(h)
                out["anchors"].append(anchor[a:b].view(np.int64))
                out["stretches"].append(names[a:b].view(np.int64))
                out["starts"].append(first[a:b] - (end - len(x)) + base)
                out["counts"].append(count[a:b])
    return out


def _pieces(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Lists of (doc_id, h, offset, bytes) of about PIECE bytes; a longer text comes in pieces that overlap."""
    held, size = [], 0
    for d, h, x in rows:
        for a in range(0, max(1, len(x) - LENGTH + 1), PIECE):
            part = x[a : a + PIECE + LENGTH - 1]
            if held and size + len(part) > PIECE:
                yield held
                held, size = [], 0
            held.append((d, h, a, part))
            size += len(part)
    if held:
        yield held


def _cut_out(block: pa.RecordBatch) -> dict:
    out: dict[str, list] = {k: [] for k in ("anchor", "stretch", "weight", "splits", "bytes")}
    for t, wanted in zip(column(block, "text").to_pylist(), column(block, "wanted").to_pylist()):
        x = t.encode("utf-8", "surrogatepass")
        for w in wanted:
            out["anchor"].append(w["anchor"])
            out["stretch"].append(w["stretch"])
            out["weight"].append(w["weight"])
            out["splits"].append(w["splits"])
            out["bytes"].append(x[w["start"] : w["start"] + w["n"] + LENGTH - 1])
    return out


def _spans(offsets: np.ndarray) -> list[int]:
    """Ascending offsets as first, past-the-last, first, past-the-last, ..."""
    cut = np.flatnonzero(np.diff(offsets) != 1) + 1
    return np.stack([offsets[np.append(0, cut)], offsets[np.append(cut, len(offsets)) - 1] + 1], axis=1).ravel().tolist()


_FOUND = pa.schema([("anchor", pa.int64()), ("stretch", pa.int64()), ("spans", pa.list_(pa.int32())), ("range", pa.int32()), ("names", pa.binary()), ("weights", pa.binary()), ("owners", pa.binary()), ("offsets", pa.binary())])


def _shard(t: pa.Table) -> pa.Table:
    """Repeats within a shard; for split anchors the strings, sorted and cut into ranges, for the merge."""
    t = t.combine_chunks()
    anchor, stretch, splits = (t.column(c).to_numpy() for c in ("anchor", "stretch", "splits"))
    weight, parts = t.column("weight").to_numpy().astype(float), t.column("bytes").to_pylist()
    part, offset, total = repeated_starts(parts, weight)
    out: list[dict] = []
    mine = (splits[part] == 1) & (weight[part] == 1) & (total >= 2)
    p, o = part[mine], offset[mine]
    order = np.lexsort((o, p))
    p, o = p[order], o[order]
    for a, b in zip(*_runs(p)):
        out.append({"anchor": int(anchor[p[a]]), "stretch": int(stretch[p[a]]), "spans": _spans(o[a:b])})
    for key in np.unique(anchor[splits > 1]):
        these = np.flatnonzero(anchor[part] == key)
        p, o = part[these], offset[these]
        names = np.fromiter((xxhash.xxh3_64_intdigest(parts[i][j : j + LENGTH]) for i, j in zip(p.tolist(), o.tolist())), dtype=np.uint64, count=len(p))
        order = np.argsort(names, kind="stable")
        names, p, o = names[order], p[order], o[order]
        ranges = int(splits[anchor == key][0])
        cuts = np.searchsorted(names, [np.uint64((r << 64) // ranges) for r in range(1, ranges)])
        for r, (a, b) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)])):
            if b > a:
                out.append({"anchor": int(key), "range": r, "names": names[a:b].tobytes(), "weights": weight[p[a:b]].astype(np.int64).tobytes(), "owners": stretch[p[a:b]].tobytes(), "offsets": o[a:b].astype(np.int32).tobytes()})
    return pa.Table.from_pylist(out, schema=_FOUND)


def _runs(sorted_values: np.ndarray) -> tuple[list[int], list[int]]:
    cut = (np.flatnonzero(np.diff(sorted_values) != 0) + 1).tolist()
    return ([0, *cut], [*cut, len(sorted_values)]) if len(sorted_values) else ([], [])


_MERGED = pa.schema([("anchor", pa.int64()), ("stretch", pa.int64()), ("spans", pa.list_(pa.int32()))])


def _merge(t: pa.Table) -> pa.Table:
    """The sorted lists of one range of an anchor from all shards: occurrences are summed where binary search finds a name."""
    lists = [[np.frombuffer(x, dtype=d) for x in t.column(c).to_pylist()] for c, d in (("names", np.uint64), ("weights", np.int64), ("owners", np.int64), ("offsets", np.int32))]
    known = np.unique(np.concatenate(lists[0]))
    total = np.zeros(len(known), dtype=np.int64)
    for names, weights in zip(lists[0], lists[1]):
        np.add.at(total, np.searchsorted(known, names), weights)
    owners, offsets = [], []
    for names, weights, owner, offset in zip(*lists):
        twice = (total[np.searchsorted(known, names)] >= 2) & (weights == 1)
        owners.append(owner[twice])
        offsets.append(offset[twice])
    o, f = np.concatenate(owners), np.concatenate(offsets)
    order = np.lexsort((f, o))
    o, f = o[order], f[order]
    anchor = t.column("anchor")[0].as_py()
    return pa.Table.from_pylist([{"anchor": anchor, "stretch": int(o[a]), "spans": _spans(f[a:b])} for a, b in zip(*_runs(o))], schema=_MERGED)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, h, spans): where strings of LENGTH bytes that also start elsewhere cover the text.

    docs: doc_id, h (hash of the text), text.
    """
    parsed = materialise(map_blocks(docs, lambda: _parse, "doc_id long, h long, anchors array<long>, stretches array<long>, starts array<int>, counts array<int>"), "rep-parsed")
    # written before the join: a frequent anchor's rows can then be split over tasks
    twice = materialise(parsed.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "rep-twice")
    zipped = parsed.select("doc_id", "h", F.explode(F.arrays_zip("anchors", "stretches", "starts", "counts")).alias("x"))
    entries = zipped.select("doc_id", "h", F.col("x.anchors").alias("anchor"), F.col("x.stretches").alias("stretch"), F.col("x.starts").alias("start"), F.col("x.counts").alias("n"))
    shared = materialise(entries.join(twice, "anchor"), "rep-shared")
    # equal stretches stand for one another; those of one kind only are settled by their number
    kinds = materialise(shared.groupBy("anchor", "stretch").agg(F.count("*").alias("weight"), F.min(F.struct("doc_id", "h", "start", "n")).alias("at")), "rep-kinds")
    open_anchors = kinds.groupBy("anchor").agg(F.count("*").alias("m"), F.min("weight").alias("least"), F.sum(F.col("at.n") + LENGTH - 1).alias("size")).where("m > 1 and least = 1")
    open_anchors = materialise(open_anchors.select("anchor", F.ceil(F.col("m") / SPLIT).cast("int").alias("splits"), "size"), "rep-open")
    size = open_anchors.agg(F.sum("size")).head()[0] or 0
    chosen = kinds.join(open_anchors.select("anchor", "splits"), "anchor")
    wanted = chosen.groupBy("at.doc_id", "at.h").agg(F.collect_list(F.struct("anchor", "stretch", "weight", "splits", F.col("at.start").alias("start"), F.col("at.n").alias("n"))).alias("wanted"))
    held = docs.alias("l").join(wanted.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.h") == F.col("r.h"))).select("text", "wanted")
    parts = map_blocks(held, lambda: _cut_out, "anchor long, stretch long, weight long, splits int, bytes binary").dropDuplicates(["anchor", "stretch"])
    shards = max(1, -(-size // SHARD_BYTES))
    place = F.pmod(F.xxhash64("anchor", F.pmod(F.col("stretch"), F.col("splits"))), F.lit(shards))
    found = materialise(parts.withColumn("shard", place).groupBy("shard").applyInArrow(_shard, "anchor long, stretch long, spans array<int>, range int, names binary, weights binary, owners binary, offsets binary"), "rep-found")
    merged = found.where("range is not null").select("anchor", "range", "names", "weights", "owners", "offsets").groupBy("anchor", "range").applyInArrow(_merge, "anchor long, stretch long, spans array<int>")
    single = found.where("range is null").select("anchor", "stretch", "spans").unionByName(merged)
    single = single.select("anchor", "stretch", F.explode(F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct(F.col("spans")[i].alias("a"), F.col("spans")[i + 1].alias("b")))).alias("s"))
    single = single.select("anchor", "stretch", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    whole = kinds.where("weight > 1").select("anchor", "stretch", F.lit(0).alias("a"), F.col("at.n").alias("b"))
    covered = shared.join(whole.unionByName(single), ["anchor", "stretch"])
    spans = F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + LENGTH - 1).alias("b"))
    return covered.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(spans)).alias("spans"))


def _cleaned(names: list[str], key: str):
    def work(block: pa.RecordBatch) -> dict:
        out: dict = {f: column(block, f) for f in names}
        rows: list[tuple] = []
        for t, spans in zip(column(block, "text").to_pylist(), column(block, "spans").to_pylist()):
            x = (t or "").encode("utf-8", "surrogatepass")
            kept, at, runs, gone = [], 0, 0, 0
            for s in spans or []:
                a, b = s["a"], s["b"]
                if not runs or a > at:
                    kept.append(x[at:a])
                    runs += 1
                    gone += b - a
                    at = b
                elif b > at:
                    gone += b - at
                    at = b
            kept.append(x[at:])
            rows.append((len(x), gone, runs, b"".join(kept)))
        for f, values in zip(("n_bytes", "n_removed", "n_spans", "kept"), zip(*rows)):
            out[f] = list(values)
        out["kept_sha256"] = [hashlib.sha256(x).hexdigest() for x in out["kept"]]
        return out

    return work


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", with_bytes: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes) of every row.

    A byte goes if it is covered by a string of 200 bytes that also starts elsewhere in the corpus, itself included.
    Null texts count as empty; texts under 200 bytes keep all; rows that repeat remove each other's texts.  What remains
    may not be valid UTF-8, so it is binary.
    """
    lean = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    with tidy() as keep:  # only the spans are read from now on
        spans = keep(materialise(repeats(lean), "rep-spans"))
    r = spans.alias("r")
    out = lean.alias("l").join(r, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.h") == F.col("r.h")), "left").select(F.col("l.doc_id").alias(key), "text", "spans")
    schema = f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return map_blocks(out, lambda: _cleaned([key], key), schema)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """:func:`remove_repeats` of ``documents`` without the bytes; null texts count as empty, repeated rows remove each other's."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_bytes=False)
