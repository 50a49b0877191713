"""A prefix trie of conversations: what they share, from the first turn on.

Conversations are reduced to digests and sizes of their turns; equal ones collapse.
They are dealt out by the digest of the first turn. A subtrie of too many distinct
sequences is not built in one place: its top is summed up by Spark and its
sequences are dealt out again by the next turn, as often as needed. All other
subtries are built in tasks, as nodes with dictionaries of pointers, and summed
from their leaves up. What the tops of subtries hold goes to the nodes above.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import broadcast_if_small, stored
from .mixing import words

NO_ENDS = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
BUILT = pa.schema(
    [(c, pa.int64()) for c in COLUMNS[:-1]] + [("ends_sha256", pa.string()), ("key", pa.string()), ("above", pa.list_(pa.string()))]
)
BUILT_SQL = ", ".join(f"{c} long" for c in COLUMNS[:-1]) + ", ends_sha256 string, key string, above array<string>"


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, digests, sizes): a row for each conv_id, its turns in order.

    Null turns come first, null roles and texts are empty, ties go by the MD5 of role
    and text; repeated rows are turns of their own. Rows of a null conv_id belong to
    no conversation. Other columns are not read. Texts do not leave the task that reads them.
    """
    role, text = F.coalesce(conversations["role"], F.lit("")), F.coalesce(conversations["text"], F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(conversations["turn"].isNotNull().alias("known"), conversations["turn"].alias("turn"), digest.alias("digest"), words(text).alias("size"))
    said = conversations.where(conversations["conv_id"].isNotNull()).select(conversations["conv_id"].cast("long").alias("conv_id"), turn.alias("turn"))
    turns = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return turns.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes"))


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation with its first h turns taken from the first one of its family; h is a hash of its conv_id modulo ``heads``.

    ``family`` neighbouring conv_ids share a first one. Where that is absent, the head is empty.
    """
    base = turns.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), *(F.slice(c, 1, heads - 1).alias(f"head_{c}") for c in ("digests", "sizes")))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    joined = turns.join(base, F.col("conv_id") - F.col("conv_id") % family == F.col("base"), "left")
    spliced = lambda c: F.when(F.col("base").isNull(), F.slice(c, h + 1, F.size(c))).otherwise(F.concat(F.slice(f"head_{c}", F.lit(1), h), F.slice(c, h + 1, F.size(c))))
    return joined.select("conv_id", spliced("digests").alias("digests"), spliced("sizes").alias("sizes"))


def ids_digests(ids: DataFrame, most: int = 10_000) -> DataFrame:
    """(sequence, conv_id) -> (sequence, ends_sha256): SHA-256 of the comma-joined conv_ids of a sequence, ascending.

    Up to ``most`` ids are joined in a row. Longer lists are sorted over all tasks and
    joined in pieces of ``most``, which one task reads in order, holding one batch:
    a digest of a list has no other way.
    """
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string")), ",")
    many = broadcast_if_small(stored(ids.groupBy("sequence").agg(F.count("*").alias("n")).where(F.col("n") > most).select("sequence"), "trie-copies"))
    few = ids.join(many, "sequence", "left_anti").groupBy("sequence").agg(F.sha2(joined("conv_id"), 256).alias("ends_sha256"))
    cut = ids.join(many, "sequence", "left_semi").repartitionByRange("sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    pieces = cut.withColumn("piece", F.expr(f"monotonically_increasing_id() div {most}")).groupBy("sequence", "piece").agg(joined("conv_id").alias("ids"))

    def hashed(batches):
        code, now = None, None
        for batch in batches:
            for sequence, part in zip(batch.column("sequence").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if sequence != now:
                    if code:
                        yield pa.RecordBatch.from_pydict({"sequence": [now], "ends_sha256": [code.hexdigest()]})
                    code, now = hashlib.sha256(), sequence
                else:
                    part = f",{part}"
                code.update(part.encode())
        if code:
            yield pa.RecordBatch.from_pydict({"sequence": [now], "ends_sha256": [code.hexdigest()]})

    whole = pieces.repartition("sequence").sortWithinPartitions("sequence", "piece").mapInArrow(hashed, "sequence string, ends_sha256 string")
    return few.unionByName(whole)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, digests, sizes) -> one row for each distinct sequence: how many conversations, the smallest, and the digest of all."""
    named = stored(turns.withColumn("sequence", F.md5(F.array_join("digests", ""))), "trie-conversations")
    distinct = named.groupBy("sequence").agg(F.first("digests").alias("digests"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    return stored(distinct.join(ids_digests(named.select("sequence", "conv_id")), "sequence"), "trie-sequences")


def _subtries(rows: pa.Table) -> pa.Table:
    """All nodes of the subtries of a bucket; ``key`` and ``above`` name a top and the nodes over it, and are null elsewhere."""
    tops: dict[str, int] = {}
    pointers: list[dict[str, int]] = []
    parent, depth, size, n_convs, conv_id, ends, above = [], [], [], [], [], [], []

    def node(over: int, at: int, words_of: int) -> int:
        pointers.append({})
        for column, value in ((parent, over), (depth, at), (size, words_of), (n_convs, 0), (conv_id, None), (ends, NO_ENDS), (above, None)):
            column.append(value)
        return len(parent) - 1

    columns = ("key", "depth", "digests", "sizes", "n", "conv_id", "ends_sha256", "above")
    for key, start, digests, sizes, n, conv, own_ends, over in zip(*(rows[c].to_pylist() for c in columns), strict=True):
        at = tops.get(key)
        if at is None:
            at = tops[key] = node(-1, start, sizes[start - 1])
            above[at] = over
        for d in range(start, len(digests) + 1):
            if d > start:
                below = pointers[at].get(digests[d - 1])
                if below is None:
                    below = pointers[at][digests[d - 1]] = node(at, d, sizes[d - 1])
                at = below
            n_convs[at] += n
            conv_id[at] = conv if conv_id[at] is None else min(conv, conv_id[at])
        ends[at] = own_ends
    leaves, saved = [0] * len(parent), [0] * len(parent)
    for i in reversed(range(len(parent))):  # a node is made before its children, so all below i are done
        leaves[i] = leaves[i] or 1
        saved[i] += (n_convs[i] - 1) * size[i]
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    names = {i: key for key, i in tops.items()}
    made = [conv_id, depth, [conv_id[p] if p >= 0 else None for p in parent], n_convs, list(map(len, pointers)), leaves, saved, ends, [names.get(i) for i in range(len(parent))], above]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(made, BUILT, strict=True)], schema=BUILT)


def trie(rows: DataFrame, most: int = 200, bucket: int = 2_000) -> DataFrame:
    """Rows of ``sequences`` -> one row for each node of the trie, columns as in COLUMNS.

    A subtrie of more than ``most`` distinct sequences is dealt out again by its next
    turn; each such round reads only what is still too large, and there are as many
    rounds as turns that so many sequences share. Others are built in buckets of about
    ``bucket`` sequences. ``most`` and ``bucket`` are no part of the result. The
    driver sees counts only. No sequences: no rows.
    """
    spark = rows.sparkSession
    split = [
        rows.agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max(F.when(F.size("digests") == 0, F.col("ends_sha256"))).alias("ends"))
        .where("n_convs is not null")
        .select(F.lit("").alias("key"), F.array().cast("array<string>").alias("above"), F.lit(0).alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("size"), "ends")
    ]
    left = rows.where(F.size("digests") > 0).withColumn("key", F.lit("")).withColumn("above", F.array(F.lit("")))
    whole, depth = [], 0
    while True:
        depth += 1
        left = stored(left.withColumn("key", F.md5(F.concat("key", F.get("digests", F.lit(depth - 1))))).withColumn("depth", F.lit(depth)), "trie-level")
        large = stored(left.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > most).select("key"), "trie-large")
        more = not large.isEmpty()
        large = broadcast_if_small(large)
        whole.append(left.join(large, "key", "left_anti") if more else left)
        if not more:
            break
        again = left.join(large, "key", "left_semi")
        ends = F.max(F.when(F.size("digests") == depth, F.col("ends_sha256")))
        split.append(
            again.groupBy("key").agg(
                F.first("above").alias("above"), F.lit(depth).alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"),
                F.first(F.get("sizes", F.lit(depth - 1))).alias("size"), ends.alias("ends"),
            )
        )
        left = again.where(F.size("digests") > depth).withColumn("above", F.concat("above", F.array("key")))
    over, under = _united(split), _united(whole)
    over = stored(over.withColumn("saved", (F.col("n_convs") - 1) * F.col("size")), "trie-split")
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // bucket))
    dealt = under.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    built = stored(dealt.groupBy("bucket").applyInArrow(_subtries, BUILT_SQL), "trie-built")

    # Tops give their sums to all nodes above them, split nodes their own words to themselves as well.
    tops = built.where("key is not null")
    given = tops.select(F.explode("above").alias("key"), "n_leaves", F.col("saved_tokens").alias("saved"))
    given = given.unionByName(over.select(F.explode(F.concat("above", F.array("key"))).alias("key"), F.lit(0).cast("long").alias("n_leaves"), "saved"))
    sums = given.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parent = F.element_at("above", -1).alias("key")
    children = tops.select(parent).unionByName(over.where("depth > 0").select(parent)).groupBy("key").agg(F.count("*").alias("n_children"))
    named = broadcast_if_small(over.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv")))
    last = F.when(F.size("above") > 0, F.element_at("above", -1))
    nodes = over.drop("saved").join(sums, "key").join(children, "key", "left").withColumn("last", last).join(named, F.col("last") == F.col("parent"), "left")
    nodes = nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.when(F.col("n_children").isNull(), F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"), "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    joined = built.withColumn("last", last).join(named, F.col("last") == F.col("parent"), "left")
    return nodes.unionByName(joined.select(*(F.coalesce(c, "parent_conv").alias(c) if c == "parent_conv_id" else c for c in COLUMNS)))


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def prefix_trie(conversations: DataFrame, family: int = 20, heads: int = 4, most: int = 200, bucket: int = 2_000) -> DataFrame:
    """(conv_id, turn, role, text) -> the nodes of the trie of the rebuilt conversations.

    See ``own_turns`` for nulls, ties and repeats, ``rebuilt`` for the heads and
    ``trie`` for the rest. A conversation is one row of digests, so a task holds a
    few hundred whole conversations, never their texts. One without turns left
    belongs to the root only. An empty table gives no rows.
    """
    return trie(sequences(rebuilt(stored(own_turns(conversations), "trie-turns"), family, heads)), most, bucket)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = r"""
WITH codes AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, n)) AS code),
said AS (
  SELECT conv_id, turn, md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest) AS digests, list(size ORDER BY turn NULLS FIRST, digest) AS sizes FROM said GROUP BY conv_id),
hashed AS (
  SELECT own.*, xor(4294967295, list_reduce(list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT),
                                            lambda x, y: xor(x // 256, code[(xor(x, y) % 256) + 1]), 4294967295::BIGINT)) % 4 AS h
  FROM own, codes),
rebuilt AS (
  SELECT o.conv_id, list_concat(list_slice(coalesce(b.digests, []), 1, o.h), list_slice(o.digests, o.h + 1, len(o.digests))) AS digests,
         list_concat(list_slice(coalesce(b.sizes, []), 1, o.h), list_slice(o.sizes, o.h + 1, len(o.sizes))) AS sizes
  FROM hashed o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
steps AS (SELECT conv_id, digests, sizes, unnest(range(len(digests) + 1)) AS depth FROM rebuilt),
prefixes AS (
  SELECT conv_id, depth, array_to_string(list_slice(digests, 1, depth), '') AS key, CASE WHEN depth = 0 THEN 0 ELSE sizes[depth] END AS size, depth = len(digests) AS ends
  FROM steps),
nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY key, depth),
children AS (SELECT left(key, 32 * (depth - 1)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
sums AS (
  SELECT left(key, 32 * over) AS key, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT key, saved, n_children, unnest(range(depth + 1)) AS over FROM counted) GROUP BY ALL)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM counted c JOIN sums s USING (key) LEFT JOIN nodes p ON c.depth > 0 AND p.key = left(c.key, 32 * (c.depth - 1))
"""
