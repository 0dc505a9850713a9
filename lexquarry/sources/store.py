"""Tables on storage: the operation log, published index versions, backups, and readers of common inputs."""

from __future__ import annotations

import dataclasses

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import oplog
from ..operators.index import Index
from ..schema import LEXICON, OPLOG
from . import scratch


class LateOperations(RuntimeError):
    """Operations came whose places lie before a state whose log is gone."""


class Store:
    """A folder (any that Spark can reach) with ``log/writer=<id>/batch=<n>``, ``version=<n>/<table>`` and ``lexicon/n=<n>``.

    A log batch has its writer and number in its path, so a writer that writes a batch again replaces it, nothing counts
    twice, and writers can't replace each other's batches.  A version holds the state after the batches it names; readers
    take the newest and fold only the batches since.  What is published of the words is named by the marker that is
    written last, beside the version.
    """

    TABLES = ("postings", "objects", "lexicon", "term_stats", "bucket_stats", "words")
    SCHEMAS = {"postings": "term string, object_id string, iid long, link_seq long", "objects": "object_id string, iid long", "lexicon": "term string", "term_stats": "term string, df long", "bucket_stats": "n long", "words": "term string, pushed long"}
    MARK = "n long, version long, seq long, upto long, lexicon string"
    #: Share of a version's objects that operations since may name before a consolidation writes a new version.
    NEW_VERSION = 0.25

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- the log ------------------------------------------------------------------------------------------------------

    def append(self, ops: DataFrame, batch: int, writer: str = "bulk") -> None:
        ops.select(*[c.split()[0] for c in OPLOG.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/log/writer={writer}/batch={batch}")

    def _rows(self) -> DataFrame:
        schema = OPLOG + ", writer string, batch long"
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.path}/log").parquet(f"{self.path}/log")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        """All operations of the log, but for those that a compaction has taken out."""
        return self._rows().drop("writer", "batch")

    # -- versions -----------------------------------------------------------------------------------------------------

    def state(self) -> Row | None:
        """The newest marker: version, seq (the last place in it), lexicon and upto (the last place the lexicon knows)."""
        try:
            return self.spark.read.schema(self.MARK).parquet(f"{self.path}/published").orderBy(F.desc("n")).limit(1).head()
        except AnalysisException:
            return None

    def _mark(self, version: int, seq: int, upto: int, lexicon: str) -> None:
        last = self.state()
        self.spark.createDataFrame([(last["n"] + 1 if last else 0, version, seq, upto, lexicon)], self.MARK).coalesce(1).write.mode("append").parquet(f"{self.path}/published")

    def version(self) -> int | None:
        found = self.state()
        return found["version"] if found and found["version"] else None

    def publish(self, index: Index, version: int, *, seq: int = -1, batches: DataFrame | None = None, published: Row | None = None) -> None:
        """Write all tables; postings and words are sorted by term within a bucket's files, so that filters on them skip
        row groups.  A hot bucket is dealt over many files by its terms.

        seq and batches: what of the log is in it.  published: the marker of the lexicon that stays published (else the
        index's own is).
        """
        root = f"{self.path}/version={version}"
        with scratch.tidy(), scratch.cleaning(self.spark):
            index = index.kept()  # each table is made once: dealing by ranges reads it twice
            for name in self.TABLES:
                if (df := getattr(index, name)) is None:
                    df = index.lexicon.withColumn("pushed", F.lit(seq).cast("long"))
                if name in ("bucket_stats", "objects"):
                    df.write.mode("overwrite").partitionBy("collection", "bucket").parquet(f"{root}/{name}")
                else:
                    # by ranges, as many as the data need: a hot bucket has many, a frequent term may have several
                    order = ["collection", "bucket", "term"] + ["iid"] * (name == "postings")
                    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("collection", "bucket").parquet(f"{root}/{name}")
        if batches is not None:
            batches.write.mode("overwrite").parquet(f"{root}/batches")
        if published is None:
            self._mark(version, seq, seq, f"version={version}/lexicon")
        else:
            self._mark(version, seq, published["upto"], published["lexicon"])

    def _table(self, name: str, folder: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMAS[name] + ", collection string, bucket string").parquet(f"{self.path}/{folder}")

    def index(self) -> Index:
        """The tables of the newest version, as they lie; empty ones without a version."""
        if (v := self.version()) is None:
            return Index(*(self.spark.createDataFrame([], s + ", collection string, bucket string") for s in map(self.SCHEMAS.get, self.TABLES)))
        return Index(*(self._table(name, f"version={v}/{name}") for name in self.TABLES))

    # -- the present --------------------------------------------------------------------------------------------------

    def _since(self, rows: DataFrame) -> tuple[DataFrame, Index | None]:
        """Operations to fold, and the state before them.

        A stream may bring places below those of the version; then the whole log is folded anew, if it is still there.
        """
        found = self.state()
        if not found or not found["version"]:
            return rows, None
        try:
            covered = self.spark.read.schema("writer string, batch long, gone boolean").parquet(f"{self.path}/version={found['version']}/batches")
        except AnalysisException:
            covered = self.spark.createDataFrame([], "writer string, batch long, gone boolean")
        tail = rows.join(covered, ["writer", "batch"], "left_anti")
        least = tail.agg(F.min("seq")).head()[0]
        if least is None or least > found["seq"]:
            return tail, self.index()
        if not covered.where("gone").isEmpty():
            raise LateOperations(f"operation {least} comes after a compaction up to {found['seq']}")
        return rows, None

    def since(self) -> tuple[DataFrame, Index | None]:
        """The operations since the newest version, and its index."""
        ops, earlier = self._since(self._rows())
        return ops.drop("writer", "batch"), earlier

    def batches(self) -> DataFrame:
        """The batches of the log as a version's table of what is in it."""
        return self._rows().select("writer", "batch").distinct().withColumn("gone", F.lit(True))

    def current(self, config: Config, *, exact: bool = False) -> Index:
        """The index after the whole log: exact matches follow the log, completions what was published last."""
        return self._present(*self.since(), config, exact)

    def _present(self, ops: DataFrame, earlier: Index | None, config: Config, exact: bool) -> Index:
        found = self.state()
        now = earlier if earlier is not None and ops.isEmpty() else Index.from_log(ops, config, exact=exact, earlier=earlier)
        if not found or not found["lexicon"]:
            return dataclasses.replace(now, lexicon=self.spark.createDataFrame([], LEXICON))
        words = self._table("lexicon", found["lexicon"])
        flushed = self.log().where(F.col("seq") > found["upto"])  # a flush takes published words at once
        words = words.join(flushed.where("op = 'flushb'").select("collection", "bucket").distinct(), ["collection", "bucket"], "left_anti")
        return dataclasses.replace(now, lexicon=words.join(flushed.where("op = 'flushc'").select("collection").distinct(), "collection", "left_anti"))

    def consolidate(self, config: Config, index: Index | None = None, *, exact: bool = False, versions: bool = False) -> None:
        """Publish the words of the log so far.  The words are merged from the version's and the operations' since.

        versions: also write a new version once the operations since the last one are many.
        """
        last = self.log().agg(F.max("seq")).head()[0]
        found = self.state()
        if versions:
            ops, earlier = self._since(self._rows())
            if earlier is None or ops.count() > self.NEW_VERSION * earlier.objects.count():
                return self.compact(config, exact=exact, drop=False, lexicon=True)
        index = index or self.current(config, exact=exact)
        folder = f"lexicon/n={found['n'] + 1 if found else 0}"
        oplog.lexicon(index.words, config.store.max_words).repartitionByRange("collection", "bucket", "term").sortWithinPartitions("collection", "bucket", "term").write.mode("overwrite").partitionBy("collection", "bucket").parquet(f"{self.path}/{folder}")
        seq = found["seq"] if found else -1
        self._mark(found["version"] if found else 0, seq, max(seq, -1 if last is None else last), folder)

    def compact(self, config: Config, *, exact: bool = False, drop: bool = True, lexicon: bool = False) -> int:
        """Write the state after the log as a new version, and delete the batches that are in it.

        Batches that come meanwhile are left for the next time.  lexicon: publish its words too.  Returns the version.
        """
        with scratch.tidy():
            batches = scratch.materialise(self._rows().groupBy("writer", "batch").agg(F.max("seq").alias("seq")), "batches")
            found, version = self.state(), (self.version() or 0) + 1
            ops, earlier = self._since(self._rows().join(batches.select("writer", "batch"), ["writer", "batch"], "left_semi"))
            now = self._present(ops.drop("writer", "batch"), earlier, config, exact)
            seq = max(found["seq"] if found else -1, batches.agg(F.coalesce(F.max("seq"), F.lit(-1))).head()[0])
            if lexicon:
                now = dataclasses.replace(now, lexicon=oplog.lexicon(now.words, config.store.max_words))
            keep = found if found and found["lexicon"] and not lexicon else None
            self.publish(now, version, seq=seq, batches=batches.select("writer", "batch", F.lit(drop).alias("gone")), published=keep)
            if drop:
                for r in batches.select("writer", "batch").collect():  # a row for each batch
                    scratch.remove(self.spark, f"{self.path}/log/writer={r['writer']}/batch={r['batch']}")
        return version


def backup(index: Index, path: str) -> None:
    """``<path>/kv``: postings and objects as Parquet; ``<path>/fst``: the words as text, one a line."""
    for name in ("postings", "objects", "bucket_stats"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/kv/{name}")
    index.lexicon.select("collection", "bucket", "term").repartition("collection", "bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("collection", "bucket").text(f"{path}/fst")


def restore(spark: SparkSession, path: str) -> Index:
    from ..operators.oplog import term_stats

    postings, objects, sizes = (spark.read.parquet(f"{path}/kv/{name}") for name in ("postings", "objects", "bucket_stats"))
    try:
        words = spark.read.schema("value string, collection string, bucket string").text(f"{path}/fst").withColumnRenamed("value", "term")
    except AnalysisException:
        words = spark.createDataFrame([], LEXICON)
    words = words.select("collection", "bucket", "term")
    return Index(postings, objects, words, term_stats(postings), sizes, words.withColumn("pushed", F.lit(0).cast("long")))


def read_any(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Parquet, JSON lines, tab-separated with a header, or text, by the file's ending unless a kind is given."""
    kind = kind or {"parquet": "parquet", "json": "json", "jsonl": "json", "tsv": "tsv", "csv": "csv", "txt": "text"}.get(path.rstrip("/").rpartition(".")[2], "parquet")
    if kind in ("tsv", "csv"):
        return spark.read.csv(path, sep="\t" if kind == "tsv" else ",", header=True)
    return getattr(spark.read, kind)(path)
