"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source is dealt into shards by a hash of its rows, about SHARD_WORDS words each, and every shard is one stream of
words cut into blocks whose lengths differ by one word at most.  A source's target is turned into seats (one seat: one
block), which its shards receive by the highest quotients ``blocks / (2 k + 1)``.  A shard with q seats and n blocks takes
each block ``q // n`` times and ``q % n`` of them once more, chosen by a seeded permutation.  Ranks, targets and quotas
are computed on tables with one row for each source or shard; only single numbers and counts of partitions reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import WORD, free_name, materialise, table, tidy

#: Words of a block at most; a source has this many blocks at least, or blocks of a single word.
BLOCK_WORDS, LEAST_BLOCKS = 16, 256
#: Words of a shard, about.
SHARD_WORDS = 1 << 16
#: Open quotients of a source that are ranked in one window, and cuts of a source's range of quotients in one pass before that.
RANKED, CUTS = 8192, 16
#: Primes over any number of blocks; one of them steps through the blocks of a shard.
STEPS = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def ranked(sources: DataFrame) -> DataFrame:
    """sources (one row for each source_key) with place: from 0, by code point, the null source last.

    Rows are sorted by ranges, numbered within them, and only the ranges' row counts meet on the driver.
    """
    order = [F.col("source_key") == "n", F.col("source_key")]
    dealt = materialise(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-sources")
    counts = sorted((r["range"], r["count"]) for r in dealt.groupBy("range").count().collect())
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    start = dealt.sparkSession.createDataFrame(starts, "range int, start long")
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return dealt.withColumn("within", within).join(F.broadcast(start), "range").withColumn("place", F.col("start") + F.col("within")).drop("range", "start", "within")


def targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source_key, source_size) with target: shares of ``share`` times all sizes by weight, weights repeating in the
    order of the sources, none above ``cap`` times its size, the excess shared anew until none is above."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = materialise(ranked(sources).withColumn("weight", weight).drop("place"), "mix-ranked")
    whole, free = s.agg(F.sum("source_size"), F.sum("weight")).head()
    unit, full = share * (whole or 0) / (free or 1), 0
    while free:
        over = F.lit(unit) * F.col("weight") > F.lit(float(cap)) * F.col("source_size")
        n, held, free = s.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, cap * F.col("source_size"))), F.lit(0.0)), F.sum(F.when(~over, F.col("weight")))).head()
        if n == full or not free:  # a share per weight only rises, so a source that is full stays so
            break
        unit, full = (share * whole - held) / free, n
    return s.withColumn("target", F.least(F.lit(float(cap)) * F.col("source_size"), F.lit(unit) * F.col("weight"))).drop("weight")


def _won(weight: Column, least: Column) -> Column:
    """How many of the quotients weight / 1, weight / 3, weight / 5, ... are ``least`` or more."""
    k = F.floor((weight / least + 1) / 2)
    return F.when(weight / (2 * k + 1) >= least, k + 1).when((k > 0) & (weight / (2 * k - 1) < least), k - 1).otherwise(k)


def quotas(shards: DataFrame) -> DataFrame:
    """Seats of each shard (source_key, shard, weight, seats_of_source) by the highest quotients weight / (2 k + 1).

    With S seats, a whole weight of N and m shards, N / (2 S + m) and N / (2 S - m) enclose the lowest winning quotient.  The range is
    narrowed by counting the quotients above CUTS points of it at a time, until RANKED quotients at most lie within (or
    no further number does); those are ranked, ties to the smaller shard.  Shards without weight have no seats.
    """
    able = shards.where("weight > 0 and seats_of_source > 0")
    s, n, m = F.col("seats"), F.col("n"), F.col("m")
    whole = able.groupBy("source_key").agg(F.first("seats_of_source").alias("seats"), F.sum("weight").alias("n"), F.count("*").alias("m"), F.max("weight").alias("top"))
    start = F.when(2 * s > m, F.least(n / (2 * s - m), F.col("top") + 1.0)).otherwise(F.col("top") + 1.0)
    # a last place more or less, so that rounding can't put a winner outside
    bounds = whole.select("source_key", "seats", (n / (2 * s + m) * (1 - 1e-12)).alias("lo"), (start * (1 + 1e-12)).alias("hi"))
    counted = lambda b, points: able.join(b, "source_key").groupBy("source_key", "seats", "lo", "hi").agg(*[F.sum(_won(F.col("weight"), p)).alias(f"c{i}") for i, p in enumerate(points)])
    bounds = materialise(counted(bounds, [F.col("lo"), F.col("hi")]).withColumnsRenamed({"c0": "n_lo", "c1": "n_hi"}), "mix-bounds")
    step = lambda g: F.col("lo") + (F.col("hi") - F.col("lo")) * (g / CUTS)
    wide = (F.col("n_lo") - F.col("n_hi") > RANKED) & (step(1) > F.col("lo")) & (step(CUTS - 1) < F.col("hi"))
    while not bounds.where(wide).isEmpty():
        at = [step(g) for g in range(CUTS + 1)]
        c = counted(bounds.where(wide).select("source_key", "seats", "lo", "hi"), at)
        lo, hi = F.struct(F.col("lo").alias("t"), F.col("c0").alias("c")), F.struct(F.col("hi").alias("t"), F.col(f"c{CUTS}").alias("c"))
        for g in range(1, CUTS):
            lo = F.when(F.col(f"c{g}") >= s, F.struct(at[g].alias("t"), F.col(f"c{g}").alias("c"))).otherwise(lo)
        for g in range(CUTS - 1, 0, -1):
            hi = F.when(F.col(f"c{g}") <= s, F.struct(at[g].alias("t"), F.col(f"c{g}").alias("c"))).otherwise(hi)
        c = c.select("source_key", "seats", lo.alias("l"), hi.alias("h")).select("source_key", "seats", F.col("l.t").alias("lo"), F.col("h.t").alias("hi"), F.col("l.c").alias("n_lo"), F.col("h.c").alias("n_hi"))
        bounds = materialise(bounds.where(~wide).unionByName(c), "mix-bounds")
    q = able.join(bounds, "source_key").withColumn("sure", _won(F.col("weight"), F.col("hi"))).withColumn("most", _won(F.col("weight"), F.col("lo")))
    open_ = q.where("most > sure").withColumn("k", F.explode(F.sequence(F.col("sure"), F.col("most") - 1)))
    place = F.row_number().over(Window.partitionBy("source_key").orderBy((F.col("weight") / (2 * F.col("k") + 1)).desc(), "shard", "k"))
    more = open_.withColumn("place", place).where("place <= seats - n_hi").groupBy("source_key", "shard").agg(F.count("*").alias("more"))
    got = q.join(more, ["source_key", "shard"], "left").select("source_key", "shard", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("seats"))
    return shards.join(got, ["source_key", "shard"], "left").select("source_key", "shard", F.coalesce("seats", F.lit(0)).cast("long").alias("seats"))


def _copies(index: Column, n: Column, seats: Column, step: Column, offset: Column) -> Column:
    """How often block ``index`` of n is taken."""
    base = F.floor(seats / n)
    extra = seats - base * n
    return base + F.when(F.pmod(index * (step % n) + offset, n) < extra, 1).otherwise(0)


def _block(word: Column, n: Column, words: Column) -> Column:
    """The block of a shard's word; block i begins at word ``i * words // n``."""
    return F.floor(((word + 1) * n - 1) / words)


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """Each row of docs with what the mix takes of it.

    Adds size (words), source_size, target (of its source), taken (words taken, repeats counted), first_word (place of
    its first word in its shard) and the shard's shard_words, n_blocks, seats, step, shift, from which
    :func:`taken_texts` cuts.

    Null or blank texts have size 0 and are taken 0 times.  A null source is a source of its own, the last in order.
    Rows that repeat are taken row by row; equal rows are interchangeable.  A null key is a key like others.  An empty
    table gives no rows.  Columns of the input that have one of the added names are replaced; all others stay.
    """
    added = ("size", "source_size", "target", "taken", "first_word", "shard_words", "n_blocks", "seats", "step", "shift")
    base = docs.drop(*[c for c in docs.columns if c.lower() in added])
    skey, shard, mark, n_shards = (free_name(base, x) for x in ("source_key", "shard", "mark", "n_shards"))
    sized = base.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))
    sized = sized.withColumn(skey, F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")))
    sized = sized.withColumn(mark, F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(text)))
    with tidy() as keep:  # only the facts and the plan are read from now on
        lean = materialise(sized.select(F.col(skey).alias("source_key"), F.col(mark).alias("mark"), "size"), "mix-sizes")
        facts = targets(lean.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, share, cap)
        facts = facts.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long"))
        facts = keep(materialise(facts, "mix-facts"))

        def dealt(mark: Column, n: Column) -> Column:
            return F.pmod(F.xxhash64(mark), n)

        shards = lean.join(facts, "source_key").groupBy("source_key", dealt(F.col("mark"), F.col("n_shards")).alias("shard"), "source_size", "target").agg(F.sum("size").alias("words"))
        length = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("source_size") / LEAST_BLOCKS)))
        shards = materialise(shards.withColumn("n_blocks", F.greatest(F.lit(1), F.round(F.col("words") / length)).cast("long")), "mix-shards")
        blocks = shards.where("words > 0").groupBy("source_key").agg(F.sum("n_blocks").alias("all_blocks"))
        asked = F.round(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)) * F.col("all_blocks")).cast("long")
        draw = F.xxhash64(F.lit(seed), "source_key", "shard")
        # a shard counts by its blocks; a seeded fraction settles ties, which would be many
        weight = F.when(F.col("words") > 0, F.col("n_blocks") + F.pmod(draw, F.lit(1 << 20)) / float(1 << 30)).otherwise(0.0)
        seats = quotas(materialise(shards.join(blocks, "source_key", "left").select("source_key", "shard", weight.alias("weight"), F.coalesce(asked, F.lit(0)).alias("seats_of_source")), "mix-asked"))
        plan = seats.join(shards, ["source_key", "shard"]).select(
            F.col("source_key").alias(skey),
            F.col("shard").alias(shard),
            "source_size",
            "target",
            F.col("words").alias("shard_words"),
            "n_blocks",
            F.least(F.col("seats"), (F.lit(cap) * F.col("n_blocks")).cast("long")).alias("seats"),
            F.element_at(F.array(*[F.lit(s) for s in STEPS]), (F.pmod(draw, F.lit(len(STEPS))) + 1).cast("int")).cast("long").alias("step"),
            F.pmod(F.shiftright(draw, 7), F.col("n_blocks")).alias("shift"),
        )
        plan = keep(materialise(plan, "mix-plan"))
    counts = facts.select(F.col("source_key").alias(skey), F.col("n_shards").alias(n_shards))
    out = sized.join(counts, skey).withColumn(shard, dealt(F.col(mark), F.col(n_shards)))
    order = Window.partitionBy(skey, shard).orderBy(mark, "size", F.col(key)).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("first_word", F.coalesce(F.sum("size").over(order), F.lit(0))).join(plan, [skey, shard])
    lo, hi, n, words = F.col("first_word"), F.col("first_word") + F.col("size"), F.col("n_blocks"), F.greatest(F.col("shard_words"), F.lit(1))
    begin = lambda i: F.floor(i * words / n)
    taken = F.aggregate(
        F.sequence(_block(lo, n, words), _block(hi - 1, n, words)),
        F.lit(0).cast("long"),
        lambda acc, i: acc + _copies(i, n, F.col("seats"), F.col("step"), F.col("shift")) * (F.least(hi, begin(i + 1)) - F.greatest(lo, begin(i))),
    )
    return out.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long")).select(*base.columns, *added)


def taken_texts(mixed: DataFrame, *, text: str = "text", cap: int = 2) -> DataFrame:
    """One row for each copy that the mix takes of a document: the whole text, or the words of the blocks that are taken.

    Documents of which nothing is taken, null and blank texts among them, have no row.  Equal rows are cut row by row.
    All columns stay as they are but for the text.
    """
    copy = free_name(mixed, "copy")
    copies = mixed.where("taken > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.lit(int(cap)))))
    n = F.col("n_blocks")
    count = lambda i: _copies(_block(F.col("first_word") + i, n, F.col("shard_words")), n, F.col("seats"), F.col("step"), F.col("shift"))
    base = F.floor(F.col("seats") / n)
    kept = F.array_join(F.filter(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1)), lambda _, i: count(i) >= F.col(copy)), " ")
    never = (base + F.when(F.col("seats") % n > 0, 1).otherwise(0)) < F.col(copy)
    out = copies.withColumn(text, F.when(base >= F.col(copy), F.col(text)).when(never, F.lit("")).otherwise(kept))
    return out.where(F.col(text) != "").drop(copy)


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """:func:`mix` of ``documents``: doc_id, size, source_size, target, taken.  Null texts have size 0, repeated rows come row by row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
