"""Tables that a computation needs more than once, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: dict[str, SparkSession] = {}
#: Paths written within the innermost :func:`tidy`, apart for each thread.
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)
_LOCK, _CLEANING, _BEFORE = threading.Lock(), Counter(), {}


class NoSharedFolder(RuntimeError):
    """A cluster needs ``spark.checkpoint.dir``: a temporary folder would be another one on every machine."""


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where a session on a single machine has none (tests), a temporary one is made and set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexquarry-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


@contextlib.contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """CLEANUP is on while any write of the session runs; the last one to end puts the session's own value back."""
    ident = id(spark)
    with _LOCK:
        if not _CLEANING[ident]:
            _BEFORE[ident] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _CLEANING[ident] += 1
    try:
        yield
    finally:
        with _LOCK:
            _CLEANING[ident] -= 1
            if not _CLEANING[ident]:
                before = _BEFORE.pop(ident)
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back; this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexquarry/{label}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    with cleaning(spark):  # the table replaces the shuffles it was made from
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


@contextlib.contextmanager
def tidy() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that :func:`materialise` writes inside are deleted at the end, but for those given to the yielded function.

    These pass to the enclosing ``tidy``, if there is one, or stay until :func:`forget`.
    """
    mine: list[str] = []
    token, kept = _SCOPE.set(mine), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.scratch_path)
        return df

    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        forget([p for p in mine if p not in kept])
        if (outer := _SCOPE.get()) is not None:
            outer += [p for p in mine if p in kept]


def forget(paths: list[str] | None = None) -> None:
    """Delete tables written by :func:`materialise`: those given, or all.  Call it once the results have been stored."""
    for path in list(_WRITTEN) if paths is None else paths:
        if (spark := _WRITTEN.pop(path, None)) is not None:
            with contextlib.suppress(Exception):  # the session may have ended, and its folder with it
                remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can reach it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written_since(before: set[str]) -> list[str]:
    return [p for p in _WRITTEN if p not in before]


def written() -> set[str]:
    return set(_WRITTEN)


atexit.register(forget)
