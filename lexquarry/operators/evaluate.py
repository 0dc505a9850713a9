"""Relevance metrics of ranked lists.  run: qid, rank, object_id; qrels: qid, object_id, rel.  One row for each judged query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _judged(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    return run.where(F.col("rank") <= k).join(qrels, ["qid", "object_id"]).where(F.col("rel") > 0)


def _per_query(qrels: DataFrame, found: DataFrame, value, name: str) -> DataFrame:
    wanted = qrels.where(F.col("rel") > 0).groupBy("qid").agg(F.count("*").alias("_n"))
    return wanted.join(found, "qid", "left").select("qid", F.round(value, 6).alias(name))


def ndcg(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Gain (2 ** rel - 1) / log2(rank + 1) over that of the best order."""
    gain = lambda rank: (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(rank + 1.0)
    got = _judged(run, qrels, k).groupBy("qid").agg(F.sum(gain(F.col("rank"))).alias("_got"))
    order = Window.partitionBy("qid").orderBy(F.desc("rel"))
    best = qrels.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).groupBy("qid").agg(F.sum(gain(F.col("_r"))).alias("_best"))
    return _per_query(qrels, best.join(got, "qid", "left"), F.coalesce("_got", F.lit(0.0)) / F.col("_best"), "ndcg")


def average_precision(run: DataFrame, qrels: DataFrame, k: int = 100) -> DataFrame:
    hits = _judged(run, qrels, k).withColumn("_k", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    got = hits.groupBy("qid").agg(F.sum(F.col("_k") / F.col("rank")).alias("_got"))
    return _per_query(qrels, got, F.coalesce("_got", F.lit(0.0)) / F.col("_n"), "ap")


def recall(run: DataFrame, qrels: DataFrame, k: int = 100) -> DataFrame:
    got = _judged(run, qrels, k).groupBy("qid").agg(F.count("*").alias("_got"))
    return _per_query(qrels, got, F.coalesce("_got", F.lit(0)) / F.col("_n"), "recall")


def precision(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    got = _judged(run, qrels, k).groupBy("qid").agg(F.count("*").alias("_got"))
    return _per_query(qrels, got, F.coalesce("_got", F.lit(0)) / F.lit(float(k)), "precision")


def latencies(times: DataFrame, column: str = "seconds") -> DataFrame:
    """Throughput and percentiles of measured times."""
    q = lambda p: F.expr(f"percentile({column}, {p})")
    return times.agg((F.count("*") / F.sum(column)).alias("per_second"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))
