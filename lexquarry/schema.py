"""Schemas of the tables, and validation of item addresses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OPLOG = "seq long, op string, collection string, bucket string, object_id string, text string, lang string"
OPS = ("push", "pop", "flusho", "flushb", "flushc")
QUERIES = "qid long, collection string, bucket string, terms string, limit int, offset long, lang string"
POSTINGS = "collection string, bucket string, term string, object_id string, iid long, link_seq long"
OBJECTS = "collection string, bucket string, object_id string, iid long"
LEXICON = "collection string, bucket string, term string"
TERM_STATS = "collection string, bucket string, term string, df long"
BUCKET_STATS = "collection string, bucket string, n long"
#: Bytes of a part of an address, and of a word of the lexicon.
PART_BYTES, WORD_BYTES = 128, 40


class ItemError(ValueError):
    pass


class InvalidCollection(ItemError):
    pass


class InvalidBucket(ItemError):
    pass


class InvalidObject(ItemError):
    pass


def _valid(part: str) -> bool:
    return 0 < len(part.encode()) <= PART_BYTES and part.isascii()


@dataclass(frozen=True)
class ItemRef:
    """A collection, a bucket in it, or an object in that; parts are 1 to 128 ASCII bytes."""

    collection: str
    bucket: str | None = None
    object_id: str | None = None

    def __post_init__(self):
        for part, error in ((self.collection, InvalidCollection), (self.bucket, InvalidBucket), (self.object_id, InvalidObject)):
            if part is not None and not _valid(part):
                raise error(part)

    @property
    def depth(self) -> int:
        return 1 + (self.bucket is not None) + (self.object_id is not None)


def valid_part(part: Column) -> Column:
    """The same test as a column."""
    return F.coalesce(F.octet_length(part).between(1, PART_BYTES) & ~part.rlike(r"[^\x00-\x7F]"), F.lit(False))
