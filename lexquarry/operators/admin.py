"""Counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index


def count_objects(index: Index) -> DataFrame:
    """Terms of each object."""
    return index.postings.groupBy("collection", "bucket", "object_id").agg(F.count("*").alias("terms"))


def count_buckets(index: Index) -> DataFrame:
    """Published words of each bucket."""
    return index.lexicon.groupBy("collection", "bucket").agg(F.count("*").alias("words"))


def count_collections(index: Index) -> DataFrame:
    """Buckets of each collection that have a published lexicon."""
    return index.lexicon.select("collection", "bucket").distinct().groupBy("collection").agg(F.count("*").alias("buckets"))


def hierarchy(index: Index) -> DataFrame:
    """Published words, rolled up over collection and bucket."""
    return index.lexicon.rollup("collection", "bucket").agg(F.count("*").alias("words"))
