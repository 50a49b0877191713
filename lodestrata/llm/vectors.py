"""Tables of vectors: validity, and classes of equal vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import stored


def valid(vectors: DataFrame, empty: bool = False) -> DataFrame:
    """(vec_id, v) of the rows whose vector is not null, not empty unless ``empty``, and has only finite components; null vec_ids are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.col("vec_id").isNotNull() & (F.size("embedding") >= (0 if empty else 1))
    return vectors.where(some & ~bad).select("vec_id", F.col("embedding").alias("v"))


def candidates(rows: DataFrame, keep: int) -> DataFrame:
    """(cid, vec_id, v, first): of equal vectors those of the ``keep`` smallest vec_ids; ``first`` marks one of each class.

    No search for ``keep`` neighbours can return another one. A large class is cut
    to that many rows in each task before the shuffle.
    """
    order = W.partitionBy("v").orderBy("vec_id")
    ranked = rows.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= keep).dropDuplicates(["v", "vec_id"])
    return stored(ranked.select(F.monotonically_increasing_id().alias("cid"), "vec_id", "v", (F.col("nth") == 1).alias("first")), "candidates")


def query_classes(rows: DataFrame, found: DataFrame, which: Column) -> DataFrame:
    """(query_id, class): each query row and the cid of the candidate that has its vector."""
    reps = found.where("first").select(F.col("cid").alias("class"), "v")
    asked = rows.where(which).select(F.col("vec_id").alias("query_id"), "v").distinct()
    return stored(asked.join(reps, "v").select("query_id", "class"), "queries")


def vectors_of_an_id(rows: DataFrame) -> int:
    """The largest number of different vectors under one vec_id, 1 unless ids repeat."""
    counts = rows.select("vec_id", F.xxhash64("v").alias("h")).distinct().groupBy("vec_id").agg(F.count("*").alias("n"))
    return counts.agg(F.max("n")).first()[0] or 1


def nearest_of_queries(queries: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from (class, list of (score, vec_id)), the best of each class.

    A query_id with several vectors has one list of the best of all; a vec_id with
    several is one candidate, with its best score. For that, lists hold at least
    (k + 1) * ``vectors_of_an_id`` entries if there are so many.
    """
    own = queries.join(lists, "class").select("query_id", F.explode(F.filter("list", lambda x: x["vec_id"] != F.col("query_id"))).alias("x"))
    best = own.groupBy("query_id", F.col("x.vec_id").alias("vec_id")).agg(F.max("x.score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
