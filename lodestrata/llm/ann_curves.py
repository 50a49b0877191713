"""Approximate nearest neighbours by shifted Hilbert curves.

Candidates are parted into bands of about equal length. In each band their
directions are projected on a few random axes, cut to a grid of quantiles, shifted,
and put in the order of a Hilbert curve; several such orders (lanes) are made.
Spark range-partitions each lane and numbers it. A query sees the candidates within
a reach of places to either side of its own, in each lane; the reach grows with the
band, so that recall does not fall as the table grows. The best of all lanes are
merged and ranked by the exact inner product.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import stored
from .vectors import candidates, nearest_of_queries, query_classes, valid, vectors_of_an_id

BLOCK = 65536  # most places compared at once
SAMPLE = 4096  # vectors from which the grids are made

def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (unsigned coordinates below 2**bits) on the Hilbert curve; bits times dimensions at most 63.

    The coordinates are turned in place into the transposed index, from the top bit
    down, then Gray-decoded and interleaved (Skilling, 2004).
    """
    x = points.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in x:
            on = (axis >> bit) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(on, low, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> bit) & 1)
    return key


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros."""
    out = np.zeros((len(column), width))
    for row, v in zip(out, column, strict=True):
        row[: len(v)] = v
    return out


def _directions(column: pd.Series, width: int) -> np.ndarray:
    """Vectors of length 1."""
    x = _matrix(column, width)
    x /= np.maximum(np.abs(x).max(1, keepdims=True, initial=0), np.finfo(float).tiny)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def bands_of(counts: dict[int, int], least: int) -> dict[int, int]:
    """Step of length -> band: neighbouring steps, from the longest, that hold at most ``least`` candidates together; a larger step is a band of its own."""
    out, band, held = {}, -1, least + 1
    for step in sorted(counts, reverse=True):
        if held + counts[step] > least:
            band, held = band + 1, 0
        out[step] = band
        held += counts[step]
    return out


def search(
    vectors: DataFrame, k: int, every: int, curves: int = 6, window: int = 8192, axes: int = 4, bits: int = 8, seed: int = 11, share: float = 0.1, query_set: int = 8192
) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score), the k nearest found of each vec_id divisible by ``every``.

    Null or zero vectors, and those with null or non-finite components, take no
    part; neither do rows with null vec_id. Shorter vectors count as filled up with
    zeros. Repeated rows count once; a vec_id with several vectors is one candidate with
    its best score, and as a query has one list. Ties go to the smaller vec_id. Other
    columns are not read. Near means a large inner product: lengths are cut into steps of half
    an octave, steps of few candidates share a band, and each band is searched by
    direction. In every lane a query sees ``window`` places to either side, or the
    part ``share`` of its band's candidates if that is more; a band of at most
    ``window`` candidates is seen whole, by one lane.
    """
    rows = valid(vectors).where(F.exists("v", lambda x: x != 0))
    keep = (k + 1) * vectors_of_an_id(rows)
    found = candidates(rows, keep)
    queries = query_classes(rows, found, F.col("vec_id") % every == 0)
    spark = found.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    step = F.floor(F.greatest(F.lit(-3000.0), F.least(F.lit(3000.0), F.log2(square))) + 0.5).cast("int")
    width = found.agg(F.max(F.size("v"))).first()[0] or 1
    counts = {r["step"]: r["count"] for r in found.groupBy(step.alias("step")).count().collect()}
    band_of, sizes = bands_of(counts, window), defaultdict(int)
    for at, n in counts.items():
        sizes[band_of[at]] += n
    lanes = {band: 1 if n <= window else curves for band, n in sizes.items()}
    reach = {band: max(window, math.ceil(share * n)) for band, n in sizes.items()}

    r = np.random.default_rng(seed)
    axes_of = [np.linalg.qr(r.normal(size=(width, min(axes, width))))[0] for _ in range(curves)]
    shifts = [r.integers(0, 1 << bits, a.shape[1]) for a in axes_of]
    some = [row["v"] for row in found.where("first").orderBy(F.xxhash64("v"), "vec_id").select("v").limit(SAMPLE).collect()]
    sample = _directions(pd.Series(some), width)
    grids = [np.quantile(sample @ a, np.arange(1, 1 << bits) / (1 << bits), axis=0) if some else np.zeros((1, a.shape[1])) for a in axes_of]

    def place(batches):
        for b in batches:
            x = _directions(b["v"], width)
            asks = b["asks"].to_numpy(bool)
            own = b["step"].map(band_of).to_numpy()
            for n, (to, shift, grid) in enumerate(zip(axes_of, shifts, grids, strict=True)):
                p = x @ to
                cells = np.stack([np.searchsorted(grid[:, i], p[:, i]) for i in range(p.shape[1])], 1) + shift
                key = hilbert(cells, bits + 1)
                for band, many in lanes.items():
                    at = asks | (own == band)
                    if n < many and at.any():
                        yield b[at].drop(columns="step").assign(lane=band * curves + n, key=key[at])

    def number(batches):
        """Counts the candidates of each lane before each row; the rows come in order."""
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for b in batches:
            out = np.zeros(len(b), np.int64)
            for lane in b["lane"].unique():
                at = (b["lane"] == lane).to_numpy()
                count = np.cumsum(~b["asks"].to_numpy(bool)[at])
                out[at] = seen.get(lane, 0) + count - ~b["asks"].to_numpy(bool)[at]
                seen[lane] = seen.get(lane, 0) + int(count[-1])
            yield b.assign(part=part, nth=out)

    asking = queries.select(F.col("class").alias("cid")).distinct().join(found, "cid")
    points = found.select("cid", "vec_id", "v", F.lit(False).alias("asks")).unionByName(asking.select("cid", "vec_id", "v", F.lit(True).alias("asks")))
    shape = f"cid long, vec_id long, v {found.schema['v'].dataType.simpleString()}, asks boolean, lane int, key long"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), curves)
    ordered = (
        points.withColumn("step", step)
        .mapInPandas(place, shape)
        .repartitionByRange(parts, "lane", "key", "vec_id", "asks")
        .sortWithinPartitions("lane", "key", "vec_id", "asks")
        .mapInPandas(number, f"{shape}, part int, nth long")
    )
    ordered = stored(ordered.drop("key"), "curves")
    before = W.partitionBy("lane").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = ordered.where("not asks").groupBy("lane", "part").agg(F.count("*").alias("n"))
    # One row for each lane and partition.
    starts = ordered.select("lane", "part").distinct().join(starts, ["lane", "part"], "left").select("lane", "part", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(before), F.lit(0)).alias("start"))
    # Queries that reach a block are cut into sets by hash, so that a group is bounded as the table grows.
    asked = queries.select("class").distinct().count()
    met = {band: asked * min(1.0, (2 * reach[band] + min(reach[band], BLOCK)) / max(n, 1)) for band, n in sizes.items()}
    widths = spark.createDataFrame(
        [(band * curves + n, reach[band], min(reach[band], BLOCK), math.ceil(met[band] / query_set) or 1) for band in lanes for n in range(lanes[band])], "lane int, reach long, size long, sets int"
    )
    ranked = ordered.join(F.broadcast(starts), ["lane", "part"]).join(F.broadcast(widths), "lane").withColumn("place", F.col("start") + F.col("nth"))
    # A candidate lies in one block; a query, of which there are fewer, goes to all blocks that it reaches.
    blocks = F.when(F.col("asks"), F.expr("sequence(greatest(place - reach, 0) div size, (place + reach) div size)")).otherwise(F.array(F.expr("place div size")))
    in_sets = F.when(F.col("asks"), F.array(F.pmod(F.xxhash64("cid"), F.col("sets")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("sets") - 1))
    spread = ranked.select("cid", "vec_id", "v", "asks", "lane", "place", "reach", in_sets.alias("in_sets"), F.explode(blocks).alias("block"))
    spread = spread.select(*(c for c in spread.columns if c != "in_sets"), F.explode("in_sets").alias("set"))

    def rank(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        c, q = group[~asks], group[asks]
        out = []
        if len(c) and len(q):
            x, places, ids = _matrix(c["v"], width), c["place"].to_numpy(), c["vec_id"].to_numpy()
            for i in range(0, len(q), 128):
                some = q.iloc[i : i + 128]
                y = _matrix(some["v"], width)
                scores = y @ x.T
                scores[np.abs(places[None] - some["place"].to_numpy()[:, None]) > some["reach"].to_numpy()[:, None]] = -np.inf
                for n, cid in enumerate(some["cid"]):
                    s = scores[n]
                    least = -np.inf if len(s) <= keep else np.partition(s, len(s) - keep)[len(s) - keep]
                    at = np.flatnonzero((s >= least - 1e-9 * (1 + abs(least) if np.isfinite(least) else 0)) & np.isfinite(s))
                    exact = (x[at] * y[n]).sum(1)  # equal vectors, equal sums
                    best = np.lexsort((ids[at], -exact))[:keep]
                    out += [(cid, ids[at][j], exact[j]) for j in best]
        return pd.DataFrame(out, columns=["class", "vec_id", "score"])

    best = spread.groupBy("lane", "block", "set").applyInPandas(rank, "class long, vec_id long, score double")
    # At most ``keep`` entries for each class and block in its reach.
    lists = best.groupBy("class").agg(F.collect_set(F.struct((-F.col("score")).alias("less"), "vec_id")).alias("all"))
    lists = lists.select("class", F.transform(F.slice(F.array_sort("all"), 1, keep), lambda x: F.struct((-x["less"]).alias("score"), x["vec_id"].alias("vec_id"))).alias("list"))
    return nearest_of_queries(queries, lists, k)


def op6_hilbert_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vec_id divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 20, 20)
