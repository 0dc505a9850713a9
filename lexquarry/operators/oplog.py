"""From the log of operations to the live index.

A log row is a push, a pop or a flush of an object, bucket or collection, ordered by ``seq``.  The state after the log is
computed by windows over the events of each object and term, without replaying rows one by one:

* a flush opens a new epoch for what it covers; only links of the last epoch can be live;
* within an epoch a term's link comes with the push that finds it unlinked and goes with the pop that finds it linked;
* a pop after which an object has no links removes the object; its next push is a new birth;
* internal ids number the births of a bucket since it was last flushed, in the order of the log;
* of a term's objects the most recently linked ``retain_word_objects`` are kept.  This is exact where objects are pushed
  once; where an object that lost a term by retention is pushed again, the term counts as linked all along, unless a state
  was published in between.

With an earlier state only the operations since then are read, and only the objects that they name are computed anew.

A log that only pushes needs no windows: see :func:`pushed`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.lexer import distinct_terms, terms, tokens
from ..schema import WORD_BYTES, valid_part
from ..sources.scratch import materialise

#: Log positions numbered in one window; births of a bucket are numbered chunk by chunk.
CHUNK = 1_000_000
_BUCKET = ["collection", "bucket"]
_OBJECT = [*_BUCKET, "object_id"]


def valid(ops: DataFrame) -> DataFrame:
    """The rows whose addresses are well formed; flushes of buckets and collections need no deeper parts."""
    deep = F.col("op").isin("push", "pop", "flusho")
    return ops.where(valid_part(F.col("collection")) & (valid_part(F.col("bucket")) | (F.col("op") == "flushc")) & (valid_part(F.col("object_id")) | ~deep))


def _last_flush(ops: DataFrame, op: str, keys: list[str]) -> DataFrame:
    return ops.where(F.col("op") == op).groupBy(*keys).agg(F.max("seq").alias(f"last_{op}"))


def with_epochs(ops: DataFrame) -> DataFrame:
    """Pushes and pops with bucket_live (after the last flush of their bucket and collection), born_in (flushes of the
    object before them) and live (after the last flush of any kind that covers them).

    Flushes are few; they are joined by key, so a hot bucket's operations need not meet in one task.
    """
    work = ops.where(F.col("op").isin("push", "pop"))
    out = work.join(_last_flush(ops, "flushc", ["collection"]), "collection", "left").join(_last_flush(ops, "flushb", _BUCKET), _BUCKET, "left")
    wide = F.greatest(F.coalesce("last_flushc", F.lit(-1)), F.coalesce("last_flushb", F.lit(-1)))
    out = out.where(F.col("seq") > wide)
    flushed = ops.where("op = 'flusho'").groupBy(*_OBJECT).agg(F.sort_array(F.collect_list("seq")).alias("cuts"))
    out = out.join(flushed, _OBJECT, "left").withColumn("epoch", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("seq"))), F.lit(0)))
    out = out.withColumn("ends", F.get("cuts", F.col("epoch")))  # the flush that ends the epoch; none for the last
    return out.withColumn("live", F.col("ends").isNull()).drop("last_flushc", "last_flushb", "cuts")


def transitions(events: DataFrame) -> DataFrame:
    """events (object, epoch, term, seq, op) with change: 1 where a push links the term, -1 where a pop unlinks it, else 0."""
    by = Window.partitionBy(*_OBJECT, "epoch", "term").orderBy("seq")
    before = F.lag("op", 1, "pop").over(by)
    return events.withColumn("change", F.when((F.col("op") == "push") & (before == "pop"), 1).when((F.col("op") == "pop") & (before == "push"), -1).otherwise(0))


class Earlier:
    """What an earlier state (postings, objects, words, bucket_stats, term_stats) brings into a fold of the operations since.

    ``touched`` are the objects that those operations name; their links enter the fold as pushes at the places where they
    were linked, and they themselves as births with a known number.  All other rows stay as they are, but for those of
    buckets and collections that have been flushed.
    """

    def __init__(self, state, ops: DataFrame):
        self.state = state
        self.touched = materialise(ops.where(F.col("op").isin("push", "pop", "flusho")).select(*_OBJECT).distinct(), "touched")
        self._buckets = ops.where("op = 'flushb'").select(*_BUCKET).distinct()
        self._collections = ops.where("op = 'flushc'").select("collection").distinct()
        self._cuts = ops.where("op = 'flusho'").groupBy(*_OBJECT).agg(F.min("seq").alias("ends"))
        self.links = self.rest("postings").join(self.touched, _OBJECT, "left_semi")
        self.objects = self.rest("objects").join(self.touched, _OBJECT, "left_semi")

    def rest(self, name: str) -> DataFrame:
        """A table of the state without flushed buckets and collections."""
        return getattr(self.state, name).join(self._buckets, _BUCKET, "left_anti").join(self._collections, "collection", "left_anti")

    def untouched(self, name: str) -> DataFrame:
        return self.rest(name).join(self.touched, _OBJECT, "left_anti")

    def _placed(self, df: DataFrame, *more) -> DataFrame:
        df = df.join(self._cuts, _OBJECT, "left")
        return df.select(*_OBJECT, F.lit(0).alias("epoch"), F.col("ends").isNull().alias("live"), "ends", *more, F.lit("push").alias("op"))

    def events(self) -> DataFrame:
        return self._placed(self.links, "term", F.col("link_seq").alias("seq"))

    def operations(self) -> DataFrame:
        """A push for each object, before all others, with the number of its links."""
        linked = self.links.groupBy(*_OBJECT).agg(F.count("*").alias("change"))
        return self._placed(self.objects.join(linked, _OBJECT, "left").fillna(0, ["change"]), F.lit(_BEFORE).cast("long").alias("seq"), "change")


#: Place in the log of what an earlier state brings.
_BEFORE = -1


def fold(ops: DataFrame, config: Config, *, exact: bool = False, earlier=None) -> dict[str, DataFrame]:
    """The live tables after the log: postings, objects, words (lexicon candidates), bucket_stats, term_stats.

    earlier: the state (an :class:`lexquarry.operators.index.Index`) before ops, whose places in the log all come after it.
    Only what the operations name is computed; the rest of the earlier tables is passed on.
    """
    ops = valid(ops)
    if earlier is None and ops.where("op <> 'push'").isEmpty():
        return pushed(ops.where("op = 'push'"), config, exact=exact)
    work = with_epochs(ops)
    plain = config.with_(normalization={"unicode_normalization": None}) if not exact else config
    pushes = tokens(work.where("op = 'push'"), config, exact=exact)
    pops = tokens(work.where("op = 'pop'").withColumn("lang", F.lit("none")), plain, cleanup=False, exact=exact)
    keys = [*_OBJECT, "epoch", "live", "ends", "seq", "op"]
    found = distinct_terms(pushes.unionByName(pops), keys).select(*keys, "term", F.lit(False).alias("old"))
    e = Earlier(earlier, ops) if earlier is not None else None
    if e:
        found = found.unionByName(e.events().withColumn("old", F.lit(True)))
    # everything below reads the events several times: they are computed once
    events = materialise(transitions(found), "events")
    # operations with what they changed; those without terms count as births too
    ops_seen = work.select(*keys).join(events.groupBy(*_OBJECT, "epoch", "seq", "op").agg(F.sum("change").alias("change")), [*_OBJECT, "epoch", "seq", "op"], "left").fillna(0, ["change"])
    if e:
        ops_seen = ops_seen.unionByName(e.operations())
    run = Window.partitionBy(*_OBJECT, "epoch").orderBy("seq")
    counted = ops_seen.withColumn("linked", F.sum("change").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    emptied = counted.withColumn("emptied", (F.col("op") == "pop") & (F.col("change") < 0) & (F.col("linked") == 0))
    lives = emptied.withColumn("life", F.coalesce(F.sum(F.col("emptied").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    born = lives.where("op = 'push'").groupBy(*_OBJECT, "epoch", "life").agg(F.min("seq").alias("birth"))
    births = number_births(born.where(F.col("birth") > _BEFORE))
    sizes = births.groupBy(*_BUCKET).agg(F.count("*").alias("n"))
    if e:
        before = e.rest("bucket_stats")
        births = births.join(before, _BUCKET, "left").withColumn("iid", F.col("iid") + F.coalesce("n", F.lit(0))).drop("n")
        births = births.unionByName(born.where(F.col("birth") == _BEFORE).join(e.objects, _OBJECT))
        sizes = before.unionByName(sizes).groupBy(*_BUCKET).agg(F.sum("n").alias("n"))
    last = lives.groupBy(*_OBJECT, "epoch").agg(F.max("live").alias("live"), F.max_by("emptied", "seq").alias("gone"), F.max("life").alias("life"))
    objects = births.join(last, [*_OBJECT, "epoch", "life"]).where("live and not gone").select(*_OBJECT, "iid")
    by_term = events.groupBy(*_OBJECT, "epoch", "live", "term").agg(F.sum("change").alias("linked"), F.max(F.when(F.col("change") == 1, F.col("seq"))).alias("link_seq"))
    postings = by_term.where("live and linked = 1").join(objects, _OBJECT).select(*_BUCKET, "term", "object_id", "iid", "link_seq")
    most = config.store.retain_word_objects
    if e:
        return _joined(e, materialise(postings, "links"), materialise(objects, "births"), words(events, e), sizes, most)
    kept, lost = retain(postings, most)
    return {"postings": kept, "objects": _left(objects, kept, lost), "words": words(events), "bucket_stats": sizes, "term_stats": None}


def pushed(pushes: DataFrame, config: Config, *, exact: bool = False, asked: DataFrame | None = None, few: bool = False) -> dict[str, DataFrame]:
    """The tables of :func:`fold` for operations that are all pushes, and ``born``, the objects before retention.

    Objects are numbered before their texts are lexed, so terms come with their object's number and are told apart within
    their text; they are moved only where an object is pushed more than once.  asked: the only terms (collection, bucket,
    term) whose postings are made, of all texts; few: send them to all executors.
    """
    births = pushes.groupBy(*_OBJECT).agg(F.min("seq").alias("birth"), F.count("*").alias("pushes"))
    births = materialise(number_births(births), "births")
    sizes = births.groupBy(*_BUCKET).agg(F.count("*").alias("n"), F.max("pushes").alias("pushes"))
    largest, again = sizes.agg(F.max("n"), F.max("pushes")).head()
    found = terms(pushes.join(births.select(*_OBJECT, "iid"), _OBJECT).select(*_OBJECT, "iid", "seq", "text", "lang"), config, exact=exact)
    if asked is not None:
        found = found.join(F.broadcast(asked) if few else asked, [*_BUCKET, "term"], "left_semi")
    columns, last = [*_BUCKET, "term", "object_id", "iid"], "link_seq"
    if (again or 0) > 1:
        found, last = found.groupBy(*columns).agg(F.min("seq").alias("link_seq"), F.max("seq").alias("pushed")), "pushed"
        links = materialise(found, "links")
        postings = links.drop("pushed")
    else:
        postings = links = materialise(found.select(*columns, F.col("seq").alias("link_seq")), "links")
    words = links.where(F.octet_length("term") <= WORD_BYTES).groupBy(*_BUCKET, "term").agg(F.max(last).alias("pushed"))
    objects = born = births.select(*_OBJECT, "iid")
    if (largest or 0) > config.store.retain_word_objects:  # no term has more objects than its bucket
        postings, lost = retain(postings, config.store.retain_word_objects)
        objects = _left(objects, postings, lost)
    return {"postings": postings, "objects": objects, "born": born, "words": materialise(words, "words"), "bucket_stats": sizes.drop("pushes"), "term_stats": None}


def _left(objects: DataFrame, kept: DataFrame, lost: DataFrame) -> DataFrame:
    """objects without those that retention has taken the last term from."""
    gone = lost.select(*_OBJECT).distinct().join(kept.select(*_OBJECT).distinct(), _OBJECT, "left_anti")
    return objects.join(gone, _OBJECT, "left_anti")


def _joined(e: Earlier, postings: DataFrame, objects: DataFrame, words: DataFrame, sizes: DataFrame, most: int) -> dict[str, DataFrame]:
    """The tables of the touched objects put together with the rest of the earlier ones."""
    term = [*_BUCKET, "term"]
    change = lambda df, n: df.groupBy(*term).agg((F.count("*") * n).alias("df"))
    # what the operations changed is small; the earlier counts are only looked up
    delta = materialise(change(postings, 1).unionByName(change(e.links, -1)).groupBy(*term).agg(F.sum("df").alias("more")).where("more <> 0"), "counts")

    def counted(delta: DataFrame) -> DataFrame:
        stats = e.rest("term_stats")
        known = stats.join(delta, term, "left").select(*term, (F.col("df") + F.coalesce("more", F.lit(0))).alias("df")).where("df > 0")
        return known.unionByName(delta.join(stats, term, "left_anti").select(*term, F.col("more").alias("df")))

    every, all_objects, stats = e.untouched("postings").unionByName(postings), e.untouched("objects").unionByName(objects), counted(delta)
    over = materialise(stats.where(F.col("df") > most).join(delta.where("more > 0"), term, "left_semi").select(*term), "over")
    if not over.isEmpty():
        _, lost = retain(every.join(over, term, "left_semi"), most)
        lost = materialise(lost.select(*term, "object_id"), "lost")
        every = every.join(lost, [*term, "object_id"], "left_anti")
        hit = every.join(lost.select(*_OBJECT).distinct(), _OBJECT, "left_semi")
        all_objects = _left(all_objects, hit, lost)
        delta = delta.unionByName(change(lost, -1).withColumnRenamed("df", "more")).groupBy(*term).agg(F.sum("more").alias("more"))
        stats = counted(delta)
    return {"postings": every, "objects": all_objects, "words": words, "bucket_stats": sizes, "term_stats": stats}


def number_births(born: DataFrame) -> DataFrame:
    """born with iid: its place among the births of its bucket.  Chunks of the log are numbered apart; their starts are
    running sums over one row for each chunk."""
    chunked = born.withColumn("chunk", F.floor(F.col("birth") / CHUNK))
    sizes = chunked.groupBy(*_BUCKET, "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*_BUCKET).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy(*_BUCKET, "chunk").orderBy("birth")) - 1
    return chunked.withColumn("place", place).join(starts, [*_BUCKET, "chunk"]).withColumn("iid", (F.col("start") + F.col("place")).cast("long")).drop("chunk", "place", "start")


def retain(postings: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Postings of the most recent objects of each term, and those that fall away.

    Only terms with more than ``most`` objects are ranked; a frequent term's rows are first cut within salted parts, each
    of which keeps its own most recent, so no task ranks them all.
    """
    salt = F.pmod(F.xxhash64("object_id"), F.lit(64))
    term = [*_BUCKET, "term"]
    part = F.row_number().over(Window.partitionBy(*term, "salt").orderBy(F.desc("link_seq")))
    whole = F.row_number().over(Window.partitionBy(*term).orderBy(F.desc("link_seq")))
    top = postings.withColumn("salt", salt).withColumn("r", part).where(F.col("r") <= most).drop("salt", "r")
    top = top.withColumn("r", whole).where(F.col("r") <= most).drop("r")
    counts = postings.groupBy(*term).agg(F.count("*").alias("n")).where(F.col("n") > most)
    full = postings.join(counts.select(*term), term, "left_semi")
    return top, full.join(top.select(*term, "object_id"), [*term, "object_id"], "left_anti")


def words(events: DataFrame, earlier: Earlier | None = None) -> DataFrame:
    """Words that pushes brought and no later pop took: a pop takes a word with its last object, if that keeps other words.

    Flushing an object leaves its words; an object that a pop empties leaves them too.  Only the events of words that a
    pop has unlinked are put in order, word by word.
    """
    term = [*_BUCKET, "term"]
    by_object = Window.partitionBy(*_OBJECT, "epoch").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)
    by_term = Window.partitionBy(*term).orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)
    # a flushed object's links end at the flush
    ended = events.where("ends is not null").groupBy(*_OBJECT, "epoch", "term", "ends").agg(F.sum("change").alias("linked")).where("linked = 1")
    ended = ended.select(*_OBJECT, "epoch", "term", F.col("ends").alias("seq"), F.lit("flusho").alias("op"), F.lit(-1).alias("change"))
    state = events.select(ended.columns).unionByName(ended)
    # objects without a pop take no words: only the others' terms are counted
    popping = events.where("op = 'pop' and change = -1").select(*_OBJECT).distinct()
    left = state.join(popping, _OBJECT, "left_semi").withColumn("left", F.sum("change").over(by_object)).where("op = 'pop' and change = -1").select(*_OBJECT, "epoch", "term", "seq", "left")
    popped = events.where("op = 'pop' and change = -1").select(*term).distinct()
    moves = state.join(popped, term, "left_semi").groupBy(*term, "seq").agg(F.sum("change").alias("change"))
    if earlier is not None:
        # links of objects that no operation names
        held = earlier.rest("term_stats").join(popped, term, "left_semi").select(*term, "df")
        own = earlier.links.join(popped, term, "left_semi").groupBy(*term).agg(F.count("*").alias("own"))
        moves = moves.unionByName(held.join(own, term, "left").select(*term, F.lit(_BEFORE - 1).cast("long").alias("seq"), (F.col("df") - F.coalesce("own", F.lit(0))).alias("change")))
    at = moves.withColumn("objects", F.sum("change").over(by_term)).where("objects = 0").select(*term, "seq")
    taken = left.where("left > 0").join(at, [*term, "seq"]).groupBy(*term).agg(F.max("seq").alias("taken"))
    pushed = events.where("op = 'push' and not old").groupBy(*term).agg(F.max("seq").alias("pushed")).where(F.octet_length("term") <= WORD_BYTES)
    if earlier is not None:
        pushed = earlier.rest("words").unionByName(pushed).groupBy(*term).agg(F.max("pushed").alias("pushed"))
    return pushed.join(taken, term, "left").where("taken is null or pushed > taken").select(*term, "pushed")


def lexicon(words: DataFrame, most: int) -> DataFrame:
    """The published words of each bucket: in byte order, the first ``most``.

    Only buckets with more words than that are ranked.
    """
    sizes = words.groupBy(*_BUCKET).agg(F.count("*").alias("n"))
    over = sizes.where(F.col("n") > most).select(*_BUCKET)
    small = words.join(over, _BUCKET, "left_anti")
    ranked = words.join(over, _BUCKET, "left_semi").withColumn("r", F.row_number().over(Window.partitionBy(*_BUCKET).orderBy("term"))).where(F.col("r") <= most)
    return small.select(*_BUCKET, "term").unionByName(ranked.select(*_BUCKET, "term"))


def popped_counts(ops: DataFrame, config: Config, *, earlier=None) -> DataFrame:
    """seq and popped (number of terms unlinked) of every pop.  earlier: the state before ops, as for :func:`fold`."""
    ops = valid(ops)
    work = with_epochs(ops)
    pushes = tokens(work.where("op = 'push'"), config)
    pops = tokens(work.where("op = 'pop'").withColumn("lang", F.lit("none")), config, cleanup=False)
    keys = [*_OBJECT, "epoch", "live", "ends", "seq", "op"]
    found = distinct_terms(pushes.unionByName(pops), keys).select(*keys, "term")
    if earlier is not None:
        found = found.unionByName(Earlier(earlier, ops).events())
    done = transitions(found).where("op = 'pop'").groupBy("seq").agg((-F.sum("change")).alias("popped"))
    return work.where("op = 'pop'").select("seq").join(done, "seq", "left").select("seq", F.coalesce("popped", F.lit(0)).cast("long").alias("popped"))


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy(*_BUCKET, "term").agg(F.count("*").alias("df"))
