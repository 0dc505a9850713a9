"""The engine's API: a store, its log, and the operations on it.

Results of reads are DataFrames (lazy, any number of queries in one plan); writes append to the log.  Exact matches
follow the log at once; completions, listings and counts of words follow :meth:`Engine.consolidate`.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import admin, search, suggest
from .operators.index import Index
from .operators.oplog import popped_counts
from .schema import OPLOG, ItemRef
from .sources import scratch
from .sources.store import Store, backup, restore


class PolicyReject(ValueError):
    """A limit out of its bounds."""


@dataclass
class Statistics:
    started: float = field(default_factory=time.time)
    commands_total: int = 0
    latency_best: float = 0.0
    latency_worst: float = 0.0

    def record(self, seconds: float) -> None:
        ms = seconds * 1000
        self.commands_total += 1
        self.latency_best = min(self.latency_best or ms, ms)
        self.latency_worst = max(self.latency_worst, ms)


class Engine:
    def __init__(self, spark: SparkSession, path: str | None = None, config: Config | None = None, *, exact: bool = False):
        self.spark, self.config, self.exact = spark, config or Config(), exact
        self.store = Store(spark, path or self.config.store.path)
        self.stats = Statistics()
        self._live: tuple[int, Index] | None = None
        self._tables: list[str] = []
        last, found = self.store.log().agg(F.max("seq")).head()[0], self.store.state()
        self._seq = max(-1 if last is None else last, found["seq"] if found else -1)
        #: This engine's batches in the log; single operations get the places after the last one it knows.
        self._writer, self._batch = uuid.uuid4().hex, 0
        #: Set by :meth:`shutdown`; sessions then take no more commands.
        self.closing = False

    # -- writing ----------------------------------------------------------------------------------------------------

    def append(self, ops: DataFrame) -> None:
        """Log operations given with their seq (the log's columns)."""
        self._batch += 1
        self.store.append(ops, self._batch, self._writer)
        top = ops.agg(F.max("seq")).head()[0]
        self._seq = max(self._seq, -1 if top is None else top)
        self._live = None

    def _one(self, op: str, item: ItemRef, text: str | None = None, lang: str | None = None) -> int:
        self._seq += 1
        self.append(self.spark.createDataFrame([(self._seq, op, item.collection, item.bucket, item.object_id, text, lang)], OPLOG))
        return self._seq

    def push(self, collection: str, bucket: str, object_id: str, text: str, lang: str | None = None) -> None:
        self._one("push", ItemRef(collection, bucket, object_id), text, lang)

    def pop(self, collection: str, bucket: str, object_id: str, text: str) -> int:
        """How many terms were unlinked."""
        seq = self._one("pop", ItemRef(collection, bucket, object_id), text)
        ops, earlier = self.store.since()
        mine = ops.where((F.col("collection") == collection) & (F.col("object_id").isNull() | (F.col("object_id") == object_id)) & (F.col("bucket").isNull() | (F.col("bucket") == bucket)))
        found = popped_counts(mine, self.config, earlier=earlier).where(F.col("seq") == seq).head()
        return found["popped"] if found else 0

    def flush(self, collection: str, bucket: str | None = None, object_id: str | None = None) -> int:
        """An object: its number of terms; a bucket or collection: 1 if the collection was there, else 0."""
        item = ItemRef(collection, bucket, object_id)
        if item.depth == 3:
            before = self.count(collection, bucket, object_id)
        else:
            before = int(not self._index().objects.where(F.col("collection") == collection).isEmpty())
        self._one(("flushc", "flushb", "flusho")[item.depth - 1], item)
        return before

    # -- reading ----------------------------------------------------------------------------------------------------

    def _index(self) -> Index:
        if self._live is None or self._live[0] != self._seq:
            scratch.forget(self._tables)
            before = scratch.written()
            index = self.store.current(self.config, exact=self.exact)
            if self.store.version() is None:
                index = index.kept()  # with a version most rows lie written, and what came since has been
            self._live, self._tables = (self._seq, index), scratch.written_since(before)
        return self._live[1]

    def _limit(self, kind: str, limit: int | None) -> int:
        most, usual = getattr(self.config.search, f"{kind}_limit_maximum"), getattr(self.config.search, f"{kind}_limit_default")
        n = usual if limit is None else limit
        if not 1 <= n <= most:
            raise PolicyReject("LIMIT out of minimum/maximum bounds")
        return n

    def query_batch(self, queries: DataFrame) -> DataFrame:
        """qid, rank, object_id, score for queries (qid, collection, bucket, terms, limit, offset, lang), in one plan."""
        return search.search(queries, self._index(), self.config, exact=self.exact)

    def query(self, collection: str, bucket: str, terms: str, limit: int | None = None, offset: int = 0, lang: str | None = None) -> list[str]:
        ItemRef(collection, bucket)
        rows = [(0, collection, bucket, terms, self._limit("query", limit), offset, lang)]
        asked = self.spark.createDataFrame(rows, "qid long, collection string, bucket string, terms string, limit int, offset long, lang string")
        return [r["object_id"] for r in self.query_batch(asked).orderBy("rank").collect()]

    def suggest_batch(self, words: DataFrame) -> DataFrame:
        return suggest.suggest(words, self._index().lexicon, self.config)

    def suggest(self, collection: str, bucket: str, word: str, limit: int | None = None) -> list[str]:
        from .functions.exact import pieces

        ItemRef(collection, bucket)
        if len({p for _, p in pieces(word, self.config)}) != 1:
            raise suggest.SuggestError(word)
        asked = self.spark.createDataFrame([(0, collection, bucket, word, self._limit("suggest", limit))], "qid long, collection string, bucket string, word string, limit int")
        return [r["word"] for r in self.suggest_batch(asked).orderBy("rank").collect()]

    def list_terms(self, collection: str, bucket: str, limit: int | None = None, offset: int = 0) -> list[str]:
        ItemRef(collection, bucket)
        return [r["term"] for r in suggest.list_terms(self._index().lexicon, collection, bucket, self.config, self._limit("list", limit), offset).collect()]

    def count(self, collection: str, bucket: str | None = None, object_id: str | None = None) -> int:
        """Terms of an object, published words of a bucket, or buckets of a collection that have any."""
        item, index = ItemRef(collection, bucket, object_id), self._index()
        here = F.col("collection") == collection
        if item.depth == 1:
            return index.lexicon.where(here).select("bucket").distinct().count()
        here &= F.col("bucket") == bucket
        return index.lexicon.where(here).count() if item.depth == 2 else index.postings.where(here & (F.col("object_id") == object_id)).count()

    # -- upkeep -----------------------------------------------------------------------------------------------------

    def consolidate(self) -> None:
        """Publish the words of the log so far."""
        self.store.consolidate(self.config, self._index(), exact=self.exact)
        self._live = None

    def publish(self) -> int:
        """Write the index as a new version of the store's tables, from which reads then go on; the log stays."""
        return self.store.compact(self.config, exact=self.exact, drop=False)

    def compact(self) -> int:
        """The same, and delete the log's batches that are in the version."""
        version, self._live = self.store.compact(self.config, exact=self.exact), None
        return version

    def backup(self, path: str) -> None:
        backup(self._index(), path)

    def restore(self, path: str) -> Index:
        """The index of a backup becomes the store's newest version, in place of all that was logged so far."""
        batches, index = self.store.batches(), restore(self.spark, path)
        top = index.postings.agg(F.max("link_seq")).head()[0]
        self._seq = max(self._seq, -1 if top is None else top)  # what comes next comes after all that the backup has seen
        self.store.publish(index, (self.store.version() or 0) + 1, seq=self._seq, batches=batches)
        self._live = None
        return self._index()

    def shutdown(self) -> None:
        """Take no more commands, publish the words, and write the state."""
        self.closing = True
        self.consolidate()
        self.publish()

    def info(self) -> dict[str, int]:
        index = self._index()
        found = self.store.state()
        pending = self.store.log().where(F.col("seq") > (found["upto"] if found else -1)).select("collection", "bucket").distinct().count()
        # fixed values: the names of the figures
        return {
            "uptime": int(time.time() - self.stats.started),
            "clients_connected": 1,
            "commands_total": self.stats.commands_total,
            "command_latency_best": int(self.stats.latency_best),
            "command_latency_worst": int(self.stats.latency_worst),
            "kv_open_count": index.objects.select("collection").distinct().count(),
            "fst_open_count": index.lexicon.select("collection", "bucket").distinct().count(),
            "fst_consolidate_count": pending,
        }

    def counts(self) -> DataFrame:
        return admin.hierarchy(self._index())
