"""Helpers shared by the operators of this package: tables, shared storage, bounded Arrow blocks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import forget, materialise, remove, shared_dir, tidy  # noqa: F401  the operators' own names for them

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a worker handles at a time.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, n: int):
    """Remainder of crc32 of the key written as text, modulo n."""
    return F.crc32(F.col(key).cast("string")) % n


def free_name(df: DataFrame, name: str) -> str:
    """A column name for a helper that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def labelled(docs: DataFrame, marks: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(_k, text, _y) of the rows of docs whose key has a mark (key, _y), equal rows once, written.

    Where keys repeat with different texts there can be more rows than marks; above twice ``most`` they are sampled by a
    hash of key and text to about ``most``, so what is fitted stays bounded.
    """
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("text")).join(marks.withColumnRenamed(key, "_k"), "_k")
    rows = materialise(rows.dropDuplicates(["_k", "text", "_y"]), "labelled")
    n = rows.count()
    if n > 2 * most:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("rows"), "_k", "text"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return rows


def blocks(batches: Iterable[pa.RecordBatch], weigh: str | None, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes in the column ``weigh`` (one row at least)."""
    for batch in batches:
        if weigh is None or not batch.num_rows:
            yield batch
            continue
        column = batch.column(batch.schema.get_field_index(weigh))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size + 64
        yield batch.slice(start)


def release() -> None:
    """Give freed memory back: a worker waits for its next task, and other stages need the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def map_blocks(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str | T.StructType, weigh: str | None = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """mapInArrow in blocks of bounded size.  ``make()`` runs once per task and returns block -> {column: values}."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        work = make()
        for block in blocks(batches, weigh, most):
            if block.num_rows:
                out = work(block)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        work = out = block = None
        release()

    return df.mapInArrow(run, kind)


def texts(block: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return block.column(block.schema.get_field_index(name)).to_pylist()


def column(block: pa.RecordBatch, name: str) -> pa.Array:
    return block.column(block.schema.get_field_index(name))
