"""Mixing sources to target weights.

Sizes are aggregated per source and shared out by weight; a source's rate is its
target over its size. A document is emitted floor(rate) times, plus one copy
with the fraction as its probability, decided by a hash of the document and a
seed. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import broadcast_if_small, stored
from .columns import as_row, unfolded

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources by code point, null last, weigh 1..cycle in turn and share the whole
    size. A target stops at ``most`` times its source's size; the excess goes to
    the others by weight. The level at which that ends is found in closed form:
    with sources by size over weight, the first k are full when the level of the
    rest does not reach the next one. One row per source takes part.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    by_room = W.orderBy(F.col("source_size") / F.col("weight"), F.col("n"))
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    after = by_room.rowsBetween(0, W.unboundedFollowing)
    everything = by_room.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    own = F.col("source_size") * F.lit(most)
    ranked = (
        sizes.withColumn("n", F.row_number().over(order) - 1)
        .withColumn("weight", (F.col("n") % cycle + 1).cast("long"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum(own).over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.sum("weight").over(after).cast("double"))
        .withColumn("rank", F.row_number().over(by_room))
    )
    fits = F.col("level") * F.col("weight") <= own.cast("double")
    level = F.min(F.when(fits, F.struct("rank", "level"))).over(everything)["level"]
    shared = F.col("weight") * F.col("at")
    return ranked.withColumn("at", level).select(
        "source", "source_size", F.when(shared <= own.cast("double"), shared).otherwise(own.cast("double")).alias("target")
    )


KEY = ["origin", "id", "digest"]


def _named(docs: DataFrame, *columns: Column) -> DataFrame:
    """(by, origin, id, digest) of each row: its source, that as text which tells null from all others, its doc_id as text, and the MD5 of its text; and ``columns``."""
    source, text = docs["source"], F.md5(F.coalesce(docs["text"], F.lit("")))
    return docs.select(source.alias("by"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("origin"), F.coalesce(docs["doc_id"].cast("string"), F.lit("null")).alias("id"), text.alias("digest"), *columns)


def _numbered(rows: DataFrame, repeated: DataFrame, salts: int = 64) -> DataFrame:
    """``rows`` with nth: 0, 1, ... among those that share source, id and digest, in the order of ``same``, a hash of all that tells rows apart.

    ``repeated`` holds the keys of more than one row; all others are 0 at once. A large
    group is numbered in ``salts`` parts of its equal rows. Which of equal rows gets
    which number does not matter, so partitions are no part of the result.
    """
    once = rows.join(repeated, KEY, "left_anti").withColumn("nth", F.lit(0).cast("long"))
    again = rows.join(repeated, KEY, "left_semi").withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)))
    part = [*KEY, "same", "salt"]
    again = stored(again.withColumn("nth", F.row_number().over(W.partitionBy(*part).orderBy(F.lit(0))).cast("long") - 1), "mix-repeats")
    before = W.partitionBy(*KEY).orderBy("same", "salt").rowsBetween(W.unboundedPreceding, -1)
    starts = again.groupBy(*part).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    again = again.join(starts, part).withColumn("nth", F.col("nth") + F.col("start"))
    return once.unionByName(again.select(*once.columns))


def _planned(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Narrow rows with sizes, written once; the targets of the sources; and the keys of repeated rows."""
    sized = stored(_named(docs, docs["doc_id"].alias("doc_id"), words(docs["text"]).alias("size"), F.lit(0).cast("long").alias("same")), "mix-sizes")
    targets = broadcast_if_small(stored(source_targets(sized.groupBy(F.col("by").alias("source")).agg(F.sum("size").alias("source_size"))), "targets"))
    repeated = stored(sized.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY), "repeated")
    return sized, targets, broadcast_if_small(repeated, 100_000)


def _with_copies(rows: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """Joins the targets and decides how often a row is emitted."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    code = F.md5(F.concat_ws("|", F.lit(seed), "id", "digest", F.col("nth").cast("string")))
    chance = F.conv(F.substring(code, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    copies = F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)
    return rows.join(targets, F.col("by").eqNullSafe(F.col("source")), "left").withColumn("copies", copies.cast("long"))


def mix_plan(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """(doc_id, text, source) -> (doc_id, size, source_size, target, copies), one row per row.

    Null text has size 0, null source is a source of its own. A source without words
    has target 0 and no copies. Rows of a source that repeat a doc_id and its text are
    numbered, so that each is decided by itself. Other columns are not read. A hot source costs
    nothing: sources are summed before the shuffle and joined by broadcast up to a
    counted number of them. One task orders the sources (not their documents).
    """
    sized, targets, repeated = _planned(docs)
    return _with_copies(_numbered(sized, repeated), targets, seed).select("doc_id", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``docs`` with each row emitted as often as the plan says, all columns kept."""
    _, targets, repeated = _planned(docs)
    rows = _named(docs, as_row(docs).alias("row")).withColumn("same", F.xxhash64("row"))
    emitted = _with_copies(_numbered(rows, repeated), targets, seed).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return emitted.select(*unfolded(F.col("row"), docs.columns))


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; ``taken`` is size times copies."""
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')),
                       row_number() OVER (PARTITION BY source, doc_id, coalesce(text, '') ORDER BY doc_id) - 1)) AS code
  FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, (n % 3 + 1)::BIGINT AS weight,
         row_number() OVER (ORDER BY source_size::DOUBLE / (n % 3 + 1)::DOUBLE, n) AS rank
  FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ranked),
lv AS (SELECT arg_min(level, rank) AS level FROM levels WHERE level * weight <= (3 * source_size)::DOUBLE),
targets AS (
  SELECT l.source, source_size,
         CASE WHEN weight * lv.level <= (3 * source_size)::DOUBLE THEN weight * lv.level ELSE (3 * source_size)::DOUBLE END AS target
  FROM levels l CROSS JOIN lv),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, s.code,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(code, 1, 12))::BIGINT / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
