"""Completions and listings of the published vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.lexer import distinct_terms, tokens
from ..functions.scoring import typo_factor
from ..schema import WORD_BYTES
from .search import prefix_candidates, typo_candidates

_BUCKET = ["collection", "bucket"]


class SuggestError(ValueError):
    """The text to complete is not exactly one word."""


def suggest(words: DataFrame, lexicon: DataFrame, config: Config) -> DataFrame:
    """qid, rank, word for every row of words (qid, collection, bucket, word, limit).

    Words that begin with the word come first, itself included, in byte order; then those with 1, 2, ... typos.  A text
    that is not exactly one token, and a word of over 40 bytes, has no suggestions.
    """
    keys = ["qid", *_BUCKET]
    asked = words.select(*keys, F.col("word").alias("text"), F.lit(None).cast("string").alias("lang"))
    terms = distinct_terms(tokens(asked, config, cleanup=False), keys)
    terms = terms.withColumn("n", F.count("*").over(Window.partitionBy("qid"))).where((F.col("n") == 1) & (F.octet_length("term") <= WORD_BYTES)).drop("n", "pos")
    itself = terms.join(lexicon, [*_BUCKET, "term"]).select("qid", F.col("term").alias("word"), F.lit(0).alias("factor"))
    found = itself.unionByName(prefix_candidates(terms, lexicon).select("qid", "word", F.lit(0).alias("factor")))
    near = typo_candidates(terms.where("not special").withColumn("most", typo_factor(F.col("bytes"))), lexicon)
    found = found.unionByName(near.where("distance > 0").select("qid", "word", F.col("distance").alias("factor")))
    best = found.groupBy("qid", "word").agg(F.min("factor").alias("factor"))
    limits = words.select("qid", F.coalesce("limit", F.lit(config.search.suggest_limit_default)).alias("_n"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("factor", "word")).cast("long"))
    return ranked.join(limits, "qid").where(F.col("rank") <= F.col("_n")).select("qid", "rank", "word")


def list_terms(lexicon: DataFrame, collection: str, bucket: str, config: Config, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The bucket's words in byte order, a page of them."""
    n = config.search.list_limit_default if limit is None else limit
    here = lexicon.where((F.col("collection") == collection) & (F.col("bucket") == bucket))
    return here.select("term").orderBy("term").offset(offset).limit(n)
