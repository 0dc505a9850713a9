"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents.

toxicity      documents that the nearest labelled examples call toxic go
near_dedup    of each component of near-duplicates (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays
pii           personal data is replaced by surrogates in what is left
mixing        sources are mixed to their target weights; a document that is taken twice comes twice, one that is taken in
              part comes with the words of its blocks that are taken
bpe           every text is encoded and decoded; the last stage's rows carry the number of tokens and both digests
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.llm import bpe, mixing, neardup, pii, toxicity
from lexquarry.llm.util import materialise, remove, shared_dir, tidy

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Similarity of shingle sets, in percent, from which documents are near-duplicates.
NEAR_PERCENT = 80


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7.  All labels train it.

    Null and empty texts are scored like those without a telling term, and stay unless most such labelled texts are toxic;
    equal rows go or stay together.  An empty table gives none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id (of rows that share it, the first by text).

    Rows that share a doc_id are one document only where they are linked or have the same text.
    """
    lone = docs.where("doc_id is null").select(*COLUMNS)
    docs = docs.where("doc_id is not null")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _drop_by_row(docs).unionByName(lone)
    kept = neardup.near_duplicates(docs, percent=NEAR_PERCENT).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS).unionByName(lone)


def _drop_by_row(docs: DataFrame) -> DataFrame:
    """The same for a doc_id with several rows: each text of a doc_id is a document of its own."""
    same = Window.partitionBy("doc_id", "text").orderBy("lang", "source")
    first = docs.select(*COLUMNS).withColumn("_r", F.row_number().over(same)).where("_r = 1").drop("_r")
    first = materialise(first.withColumn("_row", F.monotonically_increasing_id()), "dedup-rows")
    marks = neardup.near_duplicates(first, key="_row", percent=NEAR_PERCENT).select("_row", "component_id")
    order = Window.partitionBy("component_id").orderBy("doc_id", "text")
    rows = first.join(marks, "_row").withColumn("_first", F.row_number().over(order)).where("_first = 1")
    return rows.select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates for personal data.  Null and empty texts stay; equal rows come out equal."""
    return _documents(pii.replace_pii(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document: a row for each time it is taken, wholly or in part.

    Null and blank texts have no words and no row.  A null source is a source of its own; equal rows are taken one by one.
    """
    return _documents(mixing.taken_texts(mixing.mix(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256, decoded_sha256 of every text; a null text counts as empty, no row is dropped."""
    return bpe.digests(docs).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("pii", replace_personal_data), ("mixing", mix_sources), ("bpe", encode)]
#: The stages train a model and hash shingles; SQL can't express them.  The tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``.

    What a stage wrote for itself goes once its result is written, and a stage's result once the next one's is.  Columns
    that documents have besides COLUMNS end at the first stage; an empty table passes through all of them.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_dir(spark)}/lexquarry/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        with tidy():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
