"""Streaming ingest: micro-batches of operations go to the log; the index is published as a separate step.

A batch is written under the stream's id and its number, so a batch that is run again after a failure replaces itself, and
no other stream's.  Until the next
publication, exact matches on the log are possible, completions are not: the lexicon is what was last published.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..schema import OPLOG
from ..sources.scratch import cleaning, remove, shared_dir
from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, *, checkpoint: str, config: Config, publish: bool = True, trigger: dict | None = None, clock: Callable[[], float] = time.time):
    """Start a query that appends a stream of operations (the columns of the log) to the store.

    With ``publish`` the index is published when ``consolidate_after`` seconds have passed since the first change that was
    not yet published; the last change waits for the next batch or for :func:`consolidate`.
    """
    due: list[float] = []

    def write(batch: DataFrame, number: int) -> None:
        # the id stays with the checkpoint; a stream that starts anew has another, and can't replace batches
        store.append(batch, number, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream")
        now = clock()
        due.append(now) if not due else None
        if publish and now - due[0] >= config.store.consolidate_after:
            consolidate(store, config)
            due.clear()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def consolidate(store: Store, config: Config) -> None:
    """Publish the words of the log so far; where the log has grown by much since the last version, a new version too."""
    store.consolidate(config, versions=True)


def replay(spark: SparkSession, ops: DataFrame, config: Config) -> DataFrame:
    """Documents written as files, streamed in micro-batches into a store, published, counted by object."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    with cleaning(spark):
        ops.repartition(4, "seq").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(OPLOG).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    store = Store(spark, f"{root}/store")
    run = ingest(stream, store, checkpoint=f"{root}/progress", config=config, publish=False, trigger={"availableNow": True})
    run.awaitTermination()
    remove(spark, f"{root}/in")  # all of it is in the log now
    consolidate(store, config)
    from ..operators.admin import count_objects

    return count_objects(store.current(config)).drop("collection")
