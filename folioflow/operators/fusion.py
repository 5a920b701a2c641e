"""Reciprocal-rank fusion of two ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse(vector: DataFrame, bm25: DataFrame, k: int = 6, rrf_k: int = 60) -> DataFrame:
    """``qid, rec_id, score, vec_rank, bm25_rank, rank`` of the k best by summed reciprocal ranks.

    ``vector`` has ``qid, rec_id, rank``; ``bm25`` also ``score``, of which only positive ones count.
    A record that one list lacks has a null rank there. Ties go by vec_rank (nulls last), then by bm25_rank.
    """
    a = vector.select("qid", "rec_id", F.col("rank").alias("vec_rank"))
    b = bm25.where("score > 0").select("qid", "rec_id", F.col("rank").alias("bm25_rank"))
    gain = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    both = a.join(b, ["qid", "rec_id"], "full_outer").withColumn("score", gain("vec_rank") + gain("bm25_rank"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("bm25_rank"), "rec_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
