"""The index: postings, objects, lexicon and statistics as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..sources.scratch import materialise
from . import oplog


@dataclass
class Index:
    """``lexicon`` is what was last published; the other tables follow the log at once.

    ``words`` are those of the log, with the place of their last push: the next lexicon.
    """

    postings: DataFrame
    objects: DataFrame
    lexicon: DataFrame
    term_stats: DataFrame
    bucket_stats: DataFrame
    words: DataFrame | None = None

    @classmethod
    def from_log(cls, ops: DataFrame, config: Config, *, published: int | None = None, exact: bool = False, earlier: Index | None = None) -> Index:
        """The index after a log.

        published: the last position that the lexicon has seen (all of them, if None).  earlier: the index before the
        first of ops; its lexicon is what stays published, but for flushed buckets, unless published is None.
        """
        state = oplog.fold(ops, config, exact=exact, earlier=earlier)
        if earlier is not None:
            seen = oplog.lexicon(state["words"], config.store.max_words) if published is None else oplog.Earlier(earlier, oplog.valid(ops)).rest("lexicon")
            return cls(state["postings"], state["objects"], seen, state["term_stats"], state["bucket_stats"], state["words"])
        earlier = state if published is None else oplog.fold(ops.where(F.col("seq") <= published), config, exact=exact)
        seen = earlier["words"]
        if published is not None:
            # a flush of a bucket or collection erases published words at once
            cut = ops.where(F.col("seq") > published)
            seen = seen.join(cut.where("op = 'flushb'").select("collection", "bucket").distinct(), ["collection", "bucket"], "left_anti")
            seen = seen.join(cut.where("op = 'flushc'").select("collection").distinct(), "collection", "left_anti")
        return cls(state["postings"], state["objects"], oplog.lexicon(seen, config.store.max_words), oplog.term_stats(state["postings"]), state["bucket_stats"], state["words"])

    @classmethod
    def from_documents(cls, docs: DataFrame, config: Config, *, exact: bool = False, asked: DataFrame | None = None, few: bool = False) -> Index:
        """Bulk load: each object is pushed once (collection, bucket, object_id, text, lang, seq), nothing is removed.

        The plan is the numbering of the objects and one lexing pass.  asked: as for :func:`oplog.pushed`, for queries whose
        terms are known; all texts are lexed and all objects counted, but other terms have no postings and statistics.
        """
        docs = oplog.valid(docs.withColumn("op", F.lit("push")))
        state = oplog.pushed(docs, config, exact=exact, asked=asked, few=few)
        return cls(state["postings"], state["born"], oplog.lexicon(state["words"], config.store.max_words), oplog.term_stats(state["postings"]), state["bucket_stats"], state["words"])

    def kept(self) -> Index:
        """The same, with tables that are written once to the shared folder and then read from it."""
        once = lambda df, label: df if hasattr(df, "scratch_path") else materialise(df, label)
        postings, words = once(self.postings, "postings"), self.words and once(self.words, "words")
        return Index(postings, once(self.objects, "objects"), once(self.lexicon, "lexicon"), materialise(oplog.term_stats(postings), "term-stats"), once(self.bucket_stats, "bucket-stats"), words)
