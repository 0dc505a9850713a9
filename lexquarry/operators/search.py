"""Ranked retrieval: one plan for any number of queries.

Exact matches come first; queries that stay below the retention limit may use a few alternates, words that begin with a
term and words within its typo limit, in a fixed order and up to a budget of postings.  Scores of a document and term are
merged, summed over the terms and divided by their number; ties go to what was found first, that is to recent documents.
Internal ids become object ids only for the page that is returned.

Steps that only some queries need (the retention limit, words with typos) are left out of the plan where a look at the
small tables of query terms shows that no query needs them; so planning runs a few short jobs.

A query that reaches the retention limit inside its alternates keeps taking alternates up to its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.langs import stays_in_script
from ..functions.lexer import distinct_terms, tokens
from ..functions.scoring import idf_weight, prefix_score, typo_factor, typo_score
from ..sources.scratch import materialise
from .index import Index

#: Characters of the keys by which prefixes are joined.
PREFIX_KEY = 4
#: Query words of a batch (some 100 bytes each) up to which they are broadcast; above, postings and words are shuffled.
BROADCAST_WORDS = 200_000
#: Bits of a place in the log; the words of a query are numbered above them.
PLACE_BITS = 43
#: Alternates are numbered from here, after any exact word.
AFTER_EXACT = 1 << 19
#: Scores are added as whole numbers of this many parts, so that sums do not hang on their order.
PARTS = 1 << 40
_BUCKET = ["collection", "bucket"]


def query_terms(queries: DataFrame, config: Config, *, exact: bool = False) -> DataFrame:
    """qid, collection, bucket, idx (place among the query's terms), term, special, bytes, n_terms."""
    keys = ["qid", *_BUCKET]
    rows = distinct_terms(tokens(queries.select(*keys, F.col("terms").alias("text"), "lang"), config, exact=exact), keys)
    by = Window.partitionBy("qid")
    return rows.withColumn("idx", F.row_number().over(by.orderBy("pos")) - 1).withColumn("n_terms", F.count("*").over(by)).drop("pos")


def _gate(n: Column, df: Column, config: Config) -> Column:
    """Whether a word is rare enough to count."""
    s = config.search
    if s.query_minimum_term_idf <= 0:
        return F.lit(True)
    return (n < s.query_minimum_term_idf_minimum_object_count) | (F.log(n / df) >= s.query_minimum_term_idf)


def weighed(terms: DataFrame, index: Index, config: Config) -> DataFrame:
    """qid, collection, bucket, idx, term, form, score, found: the words whose postings are read, and how many these are.

    Terms too frequent to count are left out; a term's score is that of its own postings, whatever form is found.
    """
    q = terms.join(index.term_stats, [*_BUCKET, "term"], "left").join(index.bucket_stats, _BUCKET).withColumn("df", F.coalesce("df", F.lit(0)))
    q = q.where((F.col("df") == 0) | _gate(F.col("n"), F.col("df"), config)).withColumn("score", idf_weight(F.col("n"), F.col("df")))
    columns = ["qid", *_BUCKET, "idx", "term", "form", "score", "found"]
    own = q.withColumn("form", F.lit(0)).withColumnRenamed("df", "found").where("found > 0").select(columns)
    if not config.search.match_normal_forms or config.normalization.unicode_normalization is not None:
        return own
    from ..functions.exact import normal_forms_udf

    odd = q.where(~F.col("special") & F.col("term").rlike(r"[^\x00-\x7F]"))
    forms = odd.select("*", F.posexplode(normal_forms_udf()(F.col("term"))).alias("form", "word")).where("form > 0").drop("term").withColumnRenamed("word", "term")
    found = index.term_stats.withColumnRenamed("df", "found")
    return own.unionByName(forms.join(found, [*_BUCKET, "term"]).select(columns))


def exact_rows(words: DataFrame, index: Index, n_words: int) -> DataFrame:
    """qid, idx, iid, score, key of the postings of the :func:`weighed` words.  n_words: how many these are at most; few
    are sent to all executors."""
    ranked = words.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("idx", "form", "term")))
    rows = index.postings.join(F.broadcast(ranked) if n_words <= BROADCAST_WORDS else ranked, [*_BUCKET, "term"])
    return rows.select("qid", "idx", "iid", "score", order_key(F.col("nth"), F.col("link_seq")))


def order_key(nth: Column, seq: Column) -> Column:
    """When a posting is looked at, as one number that sorts so: the nth word of its query, then the most recent links."""
    return (F.shiftleft(nth.cast("long"), PLACE_BITS) + (F.lit((1 << PLACE_BITS) - 1) - F.least(seq, F.lit((1 << PLACE_BITS) - 1)))).alias("key")


def capped(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """rows up to the ``most``-th document of each query, and (qid, docs): how many documents each query has by then.

    Only queries with more documents than that are ranked.
    """
    firsts = rows.groupBy("qid", "iid").agg(F.min("key").alias("key"))
    counts = firsts.groupBy("qid").agg(F.count("*").alias("docs"))
    over = counts.where(F.col("docs") > most)
    ranked = firsts.join(over, "qid", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("key"))).where(F.col("r") <= most)
    cut = ranked.groupBy("qid").agg(F.max("key").alias("cut"))
    kept = rows.join(cut, "qid", "left").where("cut is null or key <= cut").drop("cut")
    return kept, counts


def prefix_candidates(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """terms with word: the words that go on a term within its script.  Joined on the first characters."""
    w = lexicon.withColumnRenamed("term", "word")
    w = w.select("*", F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(PREFIX_KEY)))).alias("_n")).withColumn("_k", F.substring(F.col("word"), F.lit(1), F.col("_n"))).drop("_n")
    t = terms.withColumn("_k", F.substring("term", 1, PREFIX_KEY))
    out = t.join(w, [*_BUCKET, "_k"]).where(F.col("word").startswith(F.col("term")) & (F.col("word") != F.col("term")))
    return out.where(stays_in_script(F.col("term"), F.col("word"))).drop("_k")


def _pieces(terms: DataFrame) -> DataFrame:
    """Each term's ``most + 1`` pieces with the places where a word within that distance may have one of them unchanged."""
    size, k = F.length("term"), F.col("most") + 1
    out = terms.select("*", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("_i"))
    out = out.withColumn("_a", F.floor(size * F.col("_i") / k).cast("int")).withColumn("_b", F.floor(size * (F.col("_i") + 1) / k).cast("int"))
    out = out.withColumn("_piece", F.substring(F.col("term"), F.col("_a") + 1, F.col("_b") - F.col("_a")))
    return out.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_a") - F.col("most")), F.col("_a") + F.col("most"))).alias("_at")).drop("_i", "_a", "_b")


def typo_candidates(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """terms (with most, the typos allowed) with word and distance, for words within the distance.

    A word within k edits of a term holds one of the term's k + 1 pieces unchanged, moved by at most k places; words are
    joined on such pieces.  Terms too short to be cut into pieces are joined on the words' lengths.
    """
    w = lexicon.withColumnRenamed("term", "word")
    pieced = _pieces(terms.where((F.col("most") > 0) & (F.length("term") > F.col("most"))))
    sizes = pieced.select(F.length("_piece").alias("_s")).distinct()
    cuts = w.join(F.broadcast(sizes), F.length("word") >= F.col("_s"))  # a few small numbers
    cuts = cuts.select("*", F.explode(F.sequence(F.lit(0), F.length("word") - F.col("_s"))).alias("_at")).withColumn("_piece", F.substring(F.col("word"), F.col("_at") + 1, F.col("_s"))).drop("_s")
    near = pieced.join(cuts, [*_BUCKET, "_piece", "_at"]).where(F.abs(F.length("word") - F.length("term")) <= F.col("most")).drop("_piece", "_at")
    tiny = terms.where((F.col("most") > 0) & (F.length("term") <= F.col("most"))).join(w.where(F.length("word") <= 6), _BUCKET)
    found = near.select(*terms.columns, "word").unionByName(tiny.select(*terms.columns, "word")).distinct()
    found = found.withColumn("distance", F.levenshtein("term", "word"))
    return found.where(F.col("distance") <= F.col("most"))


def _first_words(words: DataFrame, index: Index, config: Config) -> DataFrame:
    """The words (qid, idx, word, phase, factor, base) that a query's budget can reach, with df and score: as many as it has
    units, since each posting costs one."""
    stats = index.term_stats.withColumnRenamed("term", "word")
    every = words.join(stats, [*_BUCKET, "word"]).join(index.bucket_stats, _BUCKET).where(_gate(F.col("n"), F.col("df"), config))
    every = every.withColumn("score", F.col("base") * idf_weight(F.col("n"), F.col("df"))).select("qid", *_BUCKET, "idx", "word", "phase", "factor", "df", "score")
    r = F.row_number().over(Window.partitionBy("qid").orderBy("phase", "idx", "factor", "word"))
    return every.withColumn("r", r).where(F.col("r") <= config.search.query_alternates_try).drop("r")


def alternates(terms: DataFrame, index: Index, config: Config) -> DataFrame:
    """qid, idx, iid, score, key of the alternates' postings within each query's budget.

    Words with typos come after those that go on a term: they are looked for only for queries that have budget left.
    """
    s, parts = config.search, []
    length = F.col("bytes").cast("double")
    if s.prefix_matching_enabled:
        p = prefix_candidates(terms, index.lexicon)
        far = F.abs(F.col("bytes") - F.octet_length("word"))
        p = p.select("qid", *_BUCKET, "idx", "word", F.lit(1).alias("phase"), F.lit(0).alias("factor"), prefix_score(far, length).alias("base"))
        parts.append(materialise(_first_words(p, index, config), "prefixes"))
        spent = parts[0].groupBy("qid").agg(F.sum("df").alias("spent")).where(F.col("spent") >= s.query_alternates_try)
        terms = terms.join(spent, "qid", "left_anti")
    able = terms.where("not special").withColumn("most", typo_factor(F.col("bytes"))).where("most > 0")
    if s.fuzzy_matching_enabled and not able.isEmpty():
        t = typo_candidates(able, index.lexicon)
        t = t.where("word <> term").select("*", F.explode(F.sequence(F.greatest(F.lit(1), F.col("distance")), F.col("most"))).alias("factor"))
        t = t.select("qid", *_BUCKET, "idx", "word", F.lit(2).alias("phase"), "factor", typo_score(F.col("factor"), length).alias("base"))
        parts.append(_first_words(t, index, config))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # each posting costs one unit; words beyond the budget are cut before their postings are read
    order = Window.partitionBy("qid").orderBy("phase", "idx", "factor", "word")
    spent = F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = every.withColumn("spent", spent).withColumn("nth", F.row_number().over(order) + AFTER_EXACT).where(F.col("spent") < s.query_alternates_try)
    rows = index.postings.join(within.select("qid", *_BUCKET, "idx", F.col("word").alias("term"), "nth", "score"), [*_BUCKET, "term"])
    rows = rows.select("qid", "idx", "iid", "score", order_key(F.col("nth"), F.col("link_seq")))
    taken = rows.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("key"))).where(F.col("r") <= s.query_alternates_try)
    return taken.drop("r")


def rank(rows: DataFrame, terms: DataFrame, config: Config, most: int | None = None) -> DataFrame:
    """qid, collection, bucket, iid, score, place: documents in their order.  most: places that anyone will look at."""
    merge = F.min if config.search.merge == "min" else F.max
    # dealt out once for both steps: few cells have more than one row
    cells = rows.repartition("qid", "iid").groupBy("qid", "iid", "idx").agg(merge("score").alias("score"), F.min("key").alias("key"))
    facts = terms.groupBy("qid", *_BUCKET).agg(F.max("n_terms").alias("n_terms"), F.max("special").alias("any_special"))
    docs = cells.groupBy("qid", "iid").agg(F.sum(F.round(F.col("score") * PARTS).cast("long")).alias("total"), F.count("*").alias("cells"), F.min("key").alias("key")).join(facts, "qid")
    docs = docs.where("not any_special or cells = n_terms").withColumn("score", F.col("total") / PARTS / F.col("n_terms"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "key")
    ranked = docs.withColumn("place", F.row_number().over(order))
    return (ranked if most is None else ranked.where(F.col("place") <= most)).select("qid", *_BUCKET, "iid", "score", "place")


def search(queries: DataFrame, index: Index, config: Config, *, exact: bool = False) -> DataFrame:
    """qid, rank (from 1 on the page), object_id, score for every query (qid, collection, bucket, terms, limit, offset, lang).

    A null limit is the default, a null offset 0.  Queries without terms after the clean-up have no rows.
    """
    most, s = config.store.retain_word_objects, config.search
    terms = materialise(query_terms(queries, config, exact=exact), "query-terms")
    words = materialise(weighed(terms, index, config), "query-words")
    # a query's documents are no more than its postings: only those with many can meet the retention limit
    each = words.groupBy("qid").agg(F.sum("found").alias("found"), F.count("*").alias("n"))
    largest, n_words = each.agg(F.coalesce(F.max("found"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).head()
    rows, open_terms = exact_rows(words, index, n_words), terms
    if largest >= most:
        many = each.where(F.col("found") >= most).select("qid")
        cut, counts = capped(exact_rows(words.join(many, "qid", "left_semi"), index, n_words), most)
        rows = exact_rows(words.join(many, "qid", "left_anti"), index, n_words).unionByName(cut)
        open_terms = terms.join(counts.where(F.col("docs") >= most).select("qid"), "qid", "left_anti")
    if s.query_alternates_try > 0 and (s.prefix_matching_enabled or s.fuzzy_matching_enabled):
        rows = rows.unionByName(alternates(open_terms, index, config))
    last = queries.agg(F.max(F.coalesce(F.col("limit").cast("long"), F.lit(s.query_limit_default)) + F.coalesce(F.col("offset").cast("long"), F.lit(0)))).head()[0]
    return page(rank(rows, terms, config, min(last or 0, (1 << 31) - 1)), queries, index, config)


def page(ranked: DataFrame, queries: DataFrame, index: Index, config: Config) -> DataFrame:
    limits = queries.select("qid", F.coalesce("limit", F.lit(config.search.query_limit_default)).alias("_n"), F.coalesce("offset", F.lit(0)).alias("_o"))
    shown = ranked.join(limits, "qid").where((F.col("place") > F.col("_o")) & (F.col("place") <= F.col("_o") + F.col("_n")))
    shown = shown.withColumn("rank", (F.col("place") - F.col("_o")).cast("long"))
    return shown.join(index.objects, [*_BUCKET, "iid"]).select("qid", "rank", "object_id", "score")
