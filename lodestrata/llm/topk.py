"""Exact top-k inner products in three phases with a uniform threshold.

The components are dealt to a few nodes; each node knows only its part of every
vector. Phase 1 gathers the best entries of each node's score list and resolves
their full scores, which gives a safe cutoff: a score of at least t has a part
of at least t over the number of nodes. Phase 2 sends that cutoff to the nodes
and collects all entries above it. Phase 3 tightens the cutoff, drops what can't
reach it and resolves the rest. Scores may be negative.

A node's vectors and the queries are dealt to blocks by hash. A task holds one
block of either and meets them in pieces, keeping the best entries of each query
over the whole block. So each vector is sent once for each block of queries, each
query once for each block of vectors, and a block is a bounded number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import stored
from .vectors import candidates, nearest_of_queries, query_classes, valid, vectors_of_an_id

ENTRY = "class long, node int, cid long, part double"


def _best(rows: DataFrame, by: list[str], score: str, n: int, tie: str = "cid") -> DataFrame:
    """The n rows of highest score of each group; tasks keep n before the shuffle."""
    order = W.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def _parts(rows: DataFrame, nodes: int, width: int) -> DataFrame:
    """Each row once for each node, with the node's components only."""
    cuts = [width * n // nodes for n in range(nodes + 1)]
    own = F.array(*(F.struct(F.lit(n).alias("node"), F.slice("v", a + 1, b - a).alias("part")) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))
    return rows.select(*(c for c in rows.columns if c != "v"), F.inline(own).alias("node", "v"))


def _matrix(column: pd.Series) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros."""
    out = np.zeros((len(column), max(map(len, column), default=0)))
    for row, v in zip(out, column, strict=True):
        row[: len(v)] = v
    return out


def _scores(q: pd.DataFrame, c: pd.DataFrame, piece: int = 256):
    """Pieces of queries and their partial scores with all candidates of the block."""
    x, y = _matrix(c["v"]), _matrix(q["v"])
    width = min(x.shape[1], y.shape[1])
    for i in range(0, len(y), piece):
        yield slice(i, i + piece), y[i : i + piece, :width] @ x[:, :width].T


def search(vectors: DataFrame, k: int, every: int, nodes: int = 2, depth: int = 5, scale: int = 1024, query_block: int = 8192, block: int = 16_384) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score) for each vec_id divisible by ``every``.

    A component x counts as floor(scale * x). Null vectors and those with null or
    non-finite components take no part; neither do rows with null vec_id. An empty
    vector has score 0 with all. Shorter vectors count as filled up with zeros.
    Repeated rows count once; a vec_id with several vectors is one candidate with its best
    score, and as a query has one list. Ties go to the smaller vec_id. Other columns are not read.

    Queries meet all candidates block by block, which is the stated set of queries
    against all rows.
    """
    rows = valid(vectors, empty=True).select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    k1 = (k + 1) * vectors_of_an_id(rows)
    found = candidates(rows, k1)
    queries = query_classes(rows, found, F.col("vec_id") % every == 0)
    count, width = found.agg(F.count("*"), F.max(F.size("v"))).first()
    asking = stored(queries.select(F.col("class").alias("cid")).distinct().join(found, "cid").select("cid", "v"), "asking")
    blocks, query_blocks = -(-count // block) or 1, -(-asking.count() // query_block) or 1
    block_of = F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int").alias("block")
    set_of = F.pmod(F.xxhash64("class"), F.lit(query_blocks)).cast("int").alias("set")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vectors_ = _parts(found.select("cid", "v"), nodes, width or 0).select("cid", "v", "node", block_of, every_of(query_blocks).alias("set"))
    asked = _parts(asking.withColumnRenamed("cid", "class"), nodes, width or 0).select("class", "v", "node", set_of)

    def met(sent: DataFrame, meet) -> DataFrame:
        """Each block of queries with each block of vectors of the same node."""
        keys = ["node", "block", "set"]
        return sent.withColumn("block", every_of(blocks)).groupBy(*keys).cogroup(vectors_.groupBy(*keys)).applyInPandas(meet, ENTRY)

    def gather(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out, n = [], min(depth * k1, len(c))
        for some, s in _scores(q, c) if len(q) and n else ():
            at = np.argpartition(-s, n - 1, axis=1)[:, :n]
            out.append(pd.DataFrame({"class": np.repeat(q["class"].to_numpy()[some], n), "cid": c["cid"].to_numpy()[at].ravel(), "part": np.take_along_axis(s, at, 1).ravel()}))
        return _entries(out, q)

    def collect(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out, least = [], q["t"].fillna(-np.inf).to_numpy(float) / nodes
        for some, s in _scores(q, c) if len(q) and len(c) else ():
            i, j = np.nonzero(s >= least[some][:, None])
            out.append(pd.DataFrame({"class": q["class"].to_numpy()[some][i], "cid": c["cid"].to_numpy()[j], "part": s[i, j]}))
        return _entries(out, q)

    def _entries(out: list[pd.DataFrame], q: pd.DataFrame) -> pd.DataFrame:
        if not out:
            return pd.DataFrame({"class": [], "node": [], "cid": [], "part": []})
        return pd.concat(out).assign(node=int(q["node"].iloc[0]))[["class", "node", "cid", "part"]]

    def resolved(pairs: DataFrame) -> DataFrame:
        """Full scores of (class, cid)."""
        product = F.aggregate(
            F.zip_with("v", "w", lambda x, y: F.coalesce(x, F.lit(0).cast("long")) * F.coalesce(y, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x
        )
        ask = asking.select(F.col("cid").alias("class"), F.col("v").alias("w"))
        return pairs.join(found.select("cid", "vec_id", "v"), "cid").join(ask, "class").select("class", "cid", "vec_id", product.alias("score"))

    def cutoff(scores: DataFrame) -> DataFrame:
        """The (k + 1)th highest known score of each class; a class with fewer has none."""
        return _best(scores, ["class"], "score", k1).where(F.col("nth") == k1).select("class", F.col("score").alias("t"))

    # Phase 1
    first = _best(met(asked, gather), ["class", "node"], "part", depth * k1)
    known = stored(resolved(first.select("class", "cid").distinct()), "phase-1")

    # Phase 2
    cuts = stored(cutoff(known), "cutoffs")
    entries = met(asked.join(cuts, "class", "left"), collect)
    seen = stored(entries.groupBy("class", "cid").agg(F.sum("part").alias("part"), F.count("*").alias("nodes")), "phase-2")

    # Phase 3
    whole = seen.where(F.col("nodes") == nodes).select("class", "cid", F.col("part").cast("long").alias("score"))
    tight = stored(cutoff(whole.unionByName(known.select("class", "cid", "score")).distinct()), "cutoffs").withColumnRenamed("t", "tight")
    reach = F.col("part") + (nodes - F.col("nodes")) * F.col("t") / nodes
    left = seen.join(cuts, "class", "left").join(tight, "class", "left").where(F.col("tight").isNull() | (reach >= F.col("tight")))
    scores = resolved(left.select("class", "cid"))
    best = _best(scores, ["class"], "score", k1, "vec_id")
    lists = best.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("nth", "score", "vec_id"))).alias("list"))
    return nearest_of_queries(queries, lists, k)


def op10_uniform_threshold(spark, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every vec_id divisible by 100."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 10, 100).withColumn("score", F.col("score").cast("long"))


OP10_SQL = """
WITH valid AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v, c.v)::BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
