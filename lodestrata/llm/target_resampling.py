"""Importance resampling towards a target distribution, by a dictionary of distinct features.

Tasks cut their documents into blocks and number the distinct features of each
block; what leaves a task is a block's dictionary with totals, and per document
the numbers and counts of its features. The dictionaries are summed to one of the
corpus, in which each distinct string is hashed once; buckets are summed, their
gains go back to the features of each block by a join on the string, and each
block weighs its documents.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import stored
from .memory import giving_back

# A byte of a word stays, A-Z lower-cased; any other ASCII byte ends a word.
BYTES = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 0x20 for b in range(256)).lower()
COUNTED = "block long, doc_id long, n_words long, n_features long, ids binary, counts binary, feature binary, number int, total long"
WEIGHED = "doc_id long, n_words long, n_features long, weight long"
ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(columns: dict, schema: str = COUNTED) -> pa.RecordBatch:
    """A batch of the schema from some of its columns; the others are null."""
    kinds = {name: ARROW[kind] for name, kind in map(str.split, schema.split(", "))}
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], list(kinds))


def _words(text) -> list[bytes]:
    """Words of a text: runs of ASCII letters, digits and characters beyond ASCII; A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(BYTES).split() if isinstance(text, str) else []


def _features(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by a space."""
    runs = [[b" ".join(run) for run in zip(*(words[k:] for k in range(n)), strict=False)] for n in range(2, longest + 1)]
    return sum(runs, words)


def counted_features(docs: DataFrame, longest: int = 1, block_words: int = 2_000_000) -> DataFrame:
    """Rows of COUNTED: one for each document, with ``ids``, and one for each feature of a block, with ``feature``.

    A block ends with the document that brings it to ``block_words`` words, so a task
    holds the dictionary of one block and one text. ``ids`` are numbers of the
    block's features and ``counts`` how often each occurs, as unsigned 32-bit numbers.
    """

    def count(batches):
        part, blocks, words_left = TaskContext.get().partitionId(), 0, block_words
        numbers: defaultdict[bytes, int] = defaultdict(lambda: len(numbers))
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def dictionary():
            totals = np.zeros(len(numbers), np.int64)
            for ids, counts in parts:
                totals[ids] += counts
            block = np.full(len(numbers), (part << 32) + blocks)
            return _batch({"block": block, "feature": list(numbers), "number": np.arange(len(numbers), dtype=np.int32), "total": totals})

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = _words(text)
                features = _features(words, longest)
                ids, counts = np.unique(np.fromiter(map(numbers.__getitem__, features), np.uint32, len(features)), return_counts=True)
                parts.append((ids, counts))
                rows.append(((part << 32) + blocks, doc_id, len(words), len(features), ids.tobytes(), counts.astype(np.uint32).tobytes()))
                words_left -= len(words)
                if words_left <= 0:
                    yield dictionary()
                    numbers.clear()
                    parts.clear()
                    blocks, words_left = blocks + 1, block_words
            yield _batch(dict(zip(["block", "doc_id", "n_words", "n_features", "ids", "counts"], zip(*rows, strict=True), strict=True)) if rows else {"block": []})
        yield dictionary()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(giving_back(count), COUNTED)


def bucket_gains(dictionary: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of a stored dictionary (bucket, s, t): how much likelier a bucket is in the target, as a floored logarithm.

    Two totals reach the driver. Buckets without features are left out.
    """
    all_s, all_t = dictionary.agg(F.sum("s"), F.sum("t")).first()
    sums = dictionary.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    more = lambda c: F.col(c).cast("double") + 1.0
    ratio = more("t") * float((all_s or 0) + buckets) / (more("s") * float((all_t or 0) + buckets))
    return sums.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, text) and (text) -> rows of WEIGHED: the sum of the gains of each document's features.

    Null texts and texts without words have weight 0. Rows that repeat a doc_id are
    rows of their own. Without target texts, or without documents, the counts on that
    side are 0. Other columns are not read.

    Between tasks go distinct features of blocks, never occurrences; a frequent
    feature is one row for each block. ``buckets`` gains are broadcast.
    """
    counted = stored(counted_features(docs, longest, block_words), "resampling-blocks")
    wanted = counted_features(target.select(F.lit(None).cast("long").alias("doc_id"), target["text"].alias("text")), longest, block_words)
    named = lambda rows, own, other: rows.where("feature is not null").select("feature", F.col("total").alias(own), F.lit(0).cast("long").alias(other))
    both = named(counted, "s", "t").unionByName(named(wanted, "t", "s")).groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    dictionary = stored(both.select("feature", "s", "t", (F.crc32("feature") % buckets).alias("bucket")), "resampling-dictionary")
    gains = stored(bucket_gains(dictionary, buckets), "resampling-gains")
    known = dictionary.where("s > 0").join(F.broadcast(gains), "bucket").select("feature", "gain")
    of_blocks = counted.where("feature is not null").select("block", "number", "feature").join(known, "feature").select(F.col("block").alias("in_block"), "number", "gain")

    def weighed(rows: pa.Table, gained: pa.Table) -> pa.Table:
        gain = np.zeros(len(gained), np.int64)
        gain[gained["number"].to_numpy()] = gained["gain"].to_numpy()
        of_row = lambda i, c: int(gain[np.frombuffer(i, np.uint32)] @ np.frombuffer(c, np.uint32).astype(np.int64))
        weights = pa.array(map(of_row, rows["ids"].to_pylist(), rows["counts"].to_pylist()), pa.int64())
        return rows.select(["doc_id", "n_words", "n_features"]).append_column("weight", weights)

    of_docs = counted.where("ids is not null").select("block", "doc_id", "n_words", "n_features", "ids", "counts")
    return of_docs.groupBy("block").cogroup(of_blocks.groupBy("in_block")).applyInArrow(weighed, WEIGHED)


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of the seed and the document."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    chance = (F.conv(F.substring(code, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(chance))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with rank 1, 2, ... in the order: ranges sorted by themselves, numbered on from the rows before them.

    The order must leave no large ties, or they meet in one range.
    """
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    cut = stored(cut.withColumn("part", F.shiftright("place", 33)), "ranked")
    sizes = cut.groupBy("part").agg((F.max("place") - F.min("place") + 1).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.col("place") - F.shiftleft(F.col("part"), 33)
    return cut.join(starts, "part").withColumn("rank", F.col("start") + at + 1).drop("part", "place", "start")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, block_words: int = 2_000_000
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each document; rank is null for those that are not drawn.

    Of the N documents with at least ``least_words`` words, percent * N / 100 of the
    highest scores are drawn, a score being weight plus Gumbel noise of the doc_id;
    ties go to the smaller doc_id (null last; its noise is that of an empty name),
    then to the larger weight. An empty table gives no rows.
    """
    weights = weigh(docs, target, longest, buckets, block_words)
    scored = weights.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    scored = stored(scored, "resampling-scores")
    able = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features"), F.col("row")]
    drawn = scored.where(able).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    first = ranked(scored.where(able), order).select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return first.unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_feature_dictionary(spark, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the texts of the benchmark."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH codes AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, n)) AS code),
d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
f AS (SELECT row, unnest(words) AS feature FROM d),
b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS feature
  FROM benchmark),
strings AS (SELECT feature, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t
            FROM (SELECT feature, 1 AS s, 0 AS t FROM f UNION ALL SELECT feature, 0, 1 FROM b) GROUP BY feature),
hashed AS (
  SELECT feature, s, t,
         xor(4294967295, list_reduce(list_transform(range(octet_length(encode(feature))), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::BIGINT),
                                     lambda x, y: xor(x // 256, code[(xor(x, y) % 256) + 1]), 4294967295::BIGINT)) % 10000 AS bucket
  FROM strings, codes),
sums AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM sums),
weights AS (SELECT row, sum(gain)::BIGINT AS weight FROM f JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (row)),
places AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN places USING (row)
"""
