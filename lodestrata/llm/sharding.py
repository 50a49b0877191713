"""Sharding by sampled splitters under the law ``bytes``: shards of near equal size.

Records are ordered by the hash of their text (equal texts lie together), then
doc_id. Size-weighted samples of the key give the splitters of a fixed number of
ranges, and a key that would fill one gets a range of its own; the ranges are
summed, an overfull one (a large group of equal texts) is subdivided, and running
sums inside each range turn a record's place into a byte offset, and that into a
shard. Only DataFrame functions are used, and only narrow rows
(no texts) are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import broadcast_if_small, stored


def _uniform(*cols) -> Column:
    """A number in [0, 1) by the hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def splitters(rows: DataFrame, total: int, ranges: int, per_range: int = 16) -> list[int]:
    """Quantiles of about ranges * per_range keys drawn in proportion to size.

    A key that has a range's share of the draws is cut off on both sides. The
    sample's size is set by the arguments, not by the data; it is the only thing
    that the driver collects besides totals.
    """
    want = F.col("size") * F.lit(ranges * per_range / max(total, 1))
    draws = (F.floor(want) + F.when(_uniform(F.lit("draw"), "key", "row") < want - F.floor(want), 1).otherwise(0)).cast("long")
    # A row of many draws stands for itself as often as it can matter.
    picked = rows.select("key", F.least(draws, F.lit(ranges * per_range).cast("long")).alias("draws")).where("draws > 0")
    keys = picked.groupBy("key").agg(F.sum("draws").alias("draws")).orderBy("key").collect()
    n, seen, out = sum(r["draws"] for r in keys), 0, set()
    for key, d in keys:
        if (seen + d) * ranges // n > seen * ranges // n:
            out.add(key)
        if d * ranges >= n:
            out |= {key, min(key + 1, (1 << 63) - 1)}
        seen += d
    return sorted(out)


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of splitters up to the key, found in two levels."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    all_of = F.array(*map(F.lit, bounds))
    coarse = F.array(*map(F.lit, bounds[step - 1 :: step]))
    block = F.size(F.filter(coarse, lambda b: b <= key)) * F.lit(step)
    return block + F.size(F.filter(F.slice(all_of, block + 1, F.lit(step)), lambda b: b <= key))


def shard_by_bytes(docs: DataFrame, shards: int = 24, ranges: int = 2048) -> DataFrame:
    """(doc_id, text) -> (doc_id, size, text_crc32, shard, slot).

    Size is the UTF-8 bytes of the text plus 8; a null text has no bytes and the
    CRC of an empty one. A record goes to the shard in which the middle of its
    bytes lies, so a shard misses its share by at most one record. Null doc_ids
    come first among equal texts; repeated rows are records of their own; an
    empty table gives no rows. Other columns are not read. Running sums meet in one
    task by range only, of which there are at most some three times ``ranges``.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = stored(
        docs.select(
            docs["doc_id"].alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bounds = splitters(rows, total, ranges)
    rows = rows.withColumn("range", range_of(F.col("key"), bounds))

    # Ranges with several times their share are cut by a hash of the row.
    fair = max(1, total // ranges)
    filled = rows.groupBy("range").agg(F.sum("size").alias("filled"))
    cuts = filled.select("range", F.when(F.col("filled") > 3 * fair, F.ceil(F.col("filled") / fair)).otherwise(1).cast("long").alias("parts"))
    cuts = broadcast_if_small(stored(cuts, "shard-cuts"), 100_000)
    rows = rows.join(cuts, "range").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "row"), F.col("parts")))

    inside = W.partitionBy("range", "part").orderBy("key", F.col("doc_id").asc_nulls_first(), "row")
    along = W.orderBy("range", "part").rowsBetween(W.unboundedPreceding, -1)
    groups = stored(
        rows.groupBy("range", "part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .select("range", "part", F.coalesce(F.sum("bytes").over(along), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("n_before")),
        "shard-groups",
    )
    placed = (
        rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside))
        .join(broadcast_if_small(groups, 100_000), ["range", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.least(
                F.expr(f"((2 * (bytes_before + upto) - size) * {shards}) div (2 * {max(total, 1)})"), F.lit(shards - 1).cast("long")
            ).cast("int").alias("shard"),
            (F.col("n_before") + F.col("nth") - 1).alias("place"),
        )
    )
    placed = stored(placed, "shard-placed")
    starts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))


def op4_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    """Places of all documents in shards 0 to 23."""
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
