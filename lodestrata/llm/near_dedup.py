"""MinHash near-duplicates: banding, verification, components by stars.

Rows with equal shingle sets are one class from the start; one of them stands for
it. Representatives that share a band's minima are candidates. First each bucket's
smallest member is compared with the others, which joins a large group of near
copies in as many comparisons as it has members. Buckets whose members are then in
one component are done, since no further link could change the components. Those
still open that hang together form a family. If a bounded number of members is outside
its largest component, these are compared with all of it, block by block inside tasks. Of other
families (documents that share boilerplate only, say) each bucket is compared by itself; members of buckets beyond a task's size are dealt anew
by their rarest shingles: of two sets that are similar enough, each holds one of the other's
rarest quarter, and shingles of boilerplate are no rare ones. Inside a task, pairs are found
in the same way. So no step compares all of a large group with all of it, no member goes to
more parts than it has such shingles, and pairs are made in a task's memory only.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored
from .components import components
from .memory import giving_back
from .shingles import WordHashes, mixed, shingle_set

BANDS, ROWS = 32, 4
SLOT = 128  # shingles: a member takes so many slots of a group as its set fills
MOST = 8192  # slots that are compared inside one task at once: 8 MB of shingles
MINOR_BLOCKS = 4
CHUNK = 256  # candidates that are looked at before what they joined is left out


def _hashes(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of 128 universal hashes."""
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


FACTORS, SHIFTS = _hashes(20240229)


def minima(shingles: np.ndarray, block: int = 2048) -> np.ndarray:
    """The least value of each of 128 universal hashes over the shingles, upper 32 bits."""
    out = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), block):
        h = FACTORS[:, None] * shingles[None, i : i + block]
        h += SHIFTS[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def band_keys(minima_: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in minima_.reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.astype(np.int64)


def text_hash(text: Column) -> list[Column]:
    """128 bits that tell a text: columns h1 and h2."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2")]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (row, doc_id, h1, h2, n_shingles, same, bands); ``same`` is a 128-bit hash of the shingle set."""

    def sign(batches):
        words = WordHashes()
        for b in batches:
            found = [shingle_set(words(text)) for text in b["text"]]
            yield b.drop(columns="text").assign(
                doc_id=b["doc_id"].astype("Int64"),
                n_shingles=[len(s) for s in found],
                same=[xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found],
                bands=[band_keys(minima(s)) if len(s) else None for s in found],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), *text_hash(docs["text"]), docs["text"].alias("text"))
    return rows.mapInPandas(giving_back(sign), "row long, doc_id long, h1 long, h2 long, n_shingles long, same binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Minima and sorted shingle hashes of the wanted (node, doc_id, h1, h2)."""

    def sets(batches):
        words = WordHashes()
        for b in batches:
            found = [shingle_set(words(text)) for text in b["text"]]
            yield pd.DataFrame({"node": b["node"], "minima": [minima(s).tobytes() for s in found], "shingles": [s.tobytes() for s in found]})

    rows = docs.select(docs["doc_id"].cast("long").alias("id"), *text_hash(docs["text"]), docs["text"].alias("text"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (rows["h1"] == wanted["h1"]) & (rows["h2"] == wanted["h2"])
    return rows.join(wanted, same).select("node", "text").mapInPandas(giving_back(sets), "node long, minima binary, shingles binary").dropDuplicates(["node"])


def _similar(am: np.ndarray, bm: np.ndarray, ax: np.ndarray, bx: np.ndarray, percent: int) -> bool:
    """Whether two shingle sets are similar enough.

    Minima that agree in under half of the places refuse the pair: at a similarity
    of 0.75 that is over six standard deviations away. The rest is confirmed on
    the full sets.
    """
    if (am == bm).mean() < 0.5:
        return False
    both = len(np.intersect1d(ax, bx, assume_unique=True))
    return 100 * both >= percent * (len(ax) + len(bx) - both)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough."""

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        rows = zip(a, b, x, y, strict=True)
        return pd.Series(
            [_similar(np.frombuffer(am, "<u4"), np.frombuffer(bm, "<u4"), np.frombuffer(ax, np.uint64), np.frombuffer(bx, np.uint64), percent) for am, bm, ax, bx in rows],
            dtype=bool,
        )

    left = sets.select(F.col("node").alias("a"), F.col("minima").alias("am"), F.col("shingles").alias("ax"))
    right = sets.select(F.col("node").alias("b"), F.col("minima").alias("bm"), F.col("shingles").alias("bx"))
    return pairs.join(right, "b").join(left, "a").where(similar("am", "bm", "ax", "bx")).select("a", "b")


def _slots() -> Column:
    """How many slots a member of ``n`` shingles takes, so that groups are bounded in bytes and not in members only."""
    return F.ceil(F.col("n") / SLOT).cast("long")


def _open_members(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (key, node, n) of buckets with several components, with their component, the bucket's smallest member and its size in slots."""
    at = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = (
        at.groupBy("key")
        .agg(F.min(F.struct("node", "component", "n")).alias("pivot"), F.min("component").alias("low"), F.max("component").alias("high"), F.sum(_slots()).alias("size"))
        .where("low <> high")
        .select("key", F.col("pivot.node").alias("a"), F.col("pivot.component").alias("a_component"), F.col("pivot.n").alias("a_n"), "size")
    )
    return stored(at.join(heads, "key"), "open-buckets")


def _pivot_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """Each open bucket's smallest member with those that are not joined with it."""
    able = "component <> a_component and 100 * least(n, a_n) >= %d * greatest(n, a_n)" % percent
    return open_.where(able).select("a", F.col("node").alias("b")).distinct()


def _required(n, percent: int):
    """How many shingles a set of ``n`` shares at least with one that is similar enough."""
    return (percent * n + 99) // 100


def _compare(rows: pd.DataFrame, percent: int, own_band: bool) -> pd.DataFrame:
    """Links between components of a group that fits a task; what is joined already needs none.

    Shingles are numbered from the rarest of the group on. A set that shares ``r`` of its
    ``n`` shingles shares one of its first ``n - r + 1``, whatever their order, so that pairs
    meet by these only. In a bucket, it must be the first that they share (``own_band``),
    since another bucket has the pair otherwise.
    """
    rows = rows.sort_values("node")
    ids, label, sizes = rows["node"].to_numpy(), rows["component"].to_numpy(copy=True), np.array([len(x) // 8 for x in rows["shingles"]])
    m, starts = np.stack([np.frombuffer(x, "<u4") for x in rows["minima"]]), sizes.cumsum() - sizes
    bands, key = np.stack([band_keys(x) for x in m]) if own_band else None, int(rows["key"].iloc[0])
    _, number, often = np.unique(np.frombuffer(b"".join(rows["shingles"]), np.uint64), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    number = np.sort(owner * len(often) + rank[number]) - owner * len(often)
    often = np.sort(often)

    leading = (np.arange(len(owner)) - starts[owner] <= (sizes - _required(sizes, percent))[owner]) & (often[number] > 1)
    lead, lead_owner = number[leading], owner[leading]
    ends = np.bincount(lead, minlength=len(often)).cumsum()
    at = np.concatenate([[0], ends[:-1]])  # of each shingle's holders, the first that was not looked at
    holders, own_ends = lead_owner[np.argsort(lead, kind="stable")], np.bincount(lead_owner, minlength=len(sizes)).cumsum()
    out, met, mark = [], np.zeros(len(sizes), bool), np.zeros(len(often), np.int32)
    for i in range(len(sizes)):
        own = lead[own_ends[i - 1] if i else 0 : own_ends[i]]
        at[own] += 1  # itself
        for a, b in zip(at[own].tolist(), ends[own].tolist(), strict=True):
            met[holders[a:b]] = True
        left = np.flatnonzero(met)
        if not len(left):
            continue
        met[left] = False
        left = left[100 * np.minimum(sizes[left], sizes[i]) >= percent * np.maximum(sizes[left], sizes[i])]
        mark[number[starts[i] : starts[i] + sizes[i]]] = 1
        while len(left := left[label[left] != label[i]]):
            some, left = left[:CHUNK], left[CHUNK:]
            some = some[(m[some] == m[i]).mean(axis=1) >= 0.5]
            if own_band:
                shared = bands[some] == bands[i]
                some = some[shared.any(axis=1) & (bands[i][shared.argmax(axis=1)] == key)]
            if not len(some):
                continue
            of = [number[starts[j] : starts[j] + sizes[j]] for j in some]
            both = np.add.reduceat(mark[np.concatenate(of)], sizes[some].cumsum() - sizes[some])
            for j in some[100 * both >= percent * (sizes[i] + sizes[some] - both)]:
                a, b = sorted((label[i], label[j]))
                if a != b:
                    out.append((ids[i], ids[j]))
                    label[label == b] = a
        mark[number[starts[i] : starts[i] + sizes[i]]] = 0
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _group_links(groups: DataFrame, sets: DataFrame, percent: int, own_band: bool = False) -> DataFrame:
    """Links inside groups (key, node, component) of bounded size."""
    rows = groups.select("key", "node", "component").join(sets, "node")
    return rows.groupBy("key").applyInPandas(lambda group: _compare(group, percent, own_band), "a long, b long")


def _families(placed: DataFrame) -> DataFrame:
    """(family, n, major, minors): slots of the members, the largest component, slots of those outside it."""
    parts = placed.groupBy("family", "component").agg(F.sum(_slots()).alias("n")).groupBy("family").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"))
    return parts.select("family", "n", F.col("top.component").alias("major"), (F.col("n") - F.col("top.n")).alias("minors"))


def _family_blocks(placed: DataFrame, most: int) -> DataFrame:
    """Groups (key, node, component) of families whose members outside the largest component fill at most MINOR_BLOCKS blocks.

    Each block of these meets each block of all members; a block is ``most`` slots. So
    a member is copied at most MINOR_BLOCKS times, and one outside once for each block
    of the family.
    """
    of = _families(placed).where(F.col("minors") <= most * MINOR_BLOCKS)
    blocks, outside = (F.ceil(F.col(c) / most).cast("long").alias(to) for c, to in (("n", "blocks"), ("minors", "outside")))
    rows = placed.join(of.where("minors > 0").select("family", "major", blocks, outside), "family")
    all_of = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = F.pmod(F.xxhash64(F.lit("block"), "node"), "blocks")
    among = rows.select("family", "node", "component", own.alias("j"), F.explode(all_of("outside")).alias("i"))
    apart = rows.where("component <> major").select("family", "node", "component", F.explode(all_of("blocks")).alias("j"), F.pmod(F.xxhash64(F.lit("outside"), "node"), "outside").alias("i"))
    return among.unionByName(apart).select(F.xxhash64("family", "i", "j").alias("key"), "node", "component").distinct()


def _dealt_anew(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (key, node, n) in parts that miss no similar pair: by the shingles of each that are rarest among all of them, as in ``_compare``.

    Parts with the same members, as those of one line's shingles, are one.
    """

    def listed(batches):
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "n": [len(s) // 8 for s in b["shingles"]], "shingles": [np.frombuffer(s, np.int64) for s in b["shingles"]]})

    rows = sets.join(nodes, "node", "left_semi").select("node", "shingles").mapInPandas(giving_back(listed), "node long, n long, shingles array<long>")
    rows = stored(rows.select("node", "n", F.explode("shingles").alias("key")), "shingles")
    rows = rows.join(rows.groupBy("key").agg(F.count("*").alias("often")), "key")
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "key"))
    required = F.expr(f"({percent} * n + 99) div 100")
    rows = stored(rows.withColumn("place", place).where((F.col("place") <= F.col("n") - required + 1) & (F.col("often") > 1)).select("key", "node", "n"), "rarest")
    parts = rows.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit("part"), "node")).alias("y"))
    return stored(rows.join(parts.where("size > 1").groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key"), "key"), "buckets")


def _block_links(members: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """Links inside groups of any size, block by block: what is left when rare shingles did not part them."""
    blocks = F.ceil(F.col("size") / most).cast("long")
    own = F.pmod(F.xxhash64(F.lit("block"), "node"), blocks)
    rows = members.select("key", "node", "component", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key")
    return _group_links(rows.select(pair, "node", "component"), sets, percent)


def near_duplicates(docs: DataFrame, percent: int = 75, most: int = MOST) -> DataFrame:
    """(doc_id, text) -> (row, doc_id, h1, h2, n_shingles, component_id, kept, stays), one row per row.

    Links: 100 * intersection >= percent * union of the shingle sets. A row without
    words is linked with nothing. Rows are told apart even where they share a doc_id or
    have none. ``component_id`` is the smallest doc_id reachable, null if there is none;
    ``kept`` tells that it is the row's own. ``stays`` marks exactly one row of each
    component, that of the smallest doc_id (nulls last), then of the least text hash
    (h1, h2), and each row without words. An empty table gives no rows; other columns
    are not read. ``most`` bounds what is compared inside one task at once: in slots of
    SLOT shingles, of which a member takes one at least.
    """
    signed = stored(signatures(docs), "signatures")
    linked = signed.where("same is not null")
    standing = linked.groupBy("same").agg(F.min("row").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2", "row")).alias("head"))
    standing = stored(standing, "equal-sets")
    reps = linked.join(standing.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    rows = reps.select(F.explode("bands").alias("key"), "node", F.col("n_shingles").alias("n"))
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    members = stored(rows.join(shared, "key"), "buckets")
    wanted = reps.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "h1", "h2")
    sets = stored(_sets(docs, wanted), "sets")

    def joined(links: DataFrame, found: DataFrame) -> DataFrame:
        return components(links.unionByName(found.select(F.col("component").alias("a"), F.col("node").alias("b"))), "a", "b")

    found = docs.sparkSession.createDataFrame([], "node long, component long")
    open_ = _open_members(members, found)
    found = joined(_links(_pivot_pairs(open_, percent), sets, percent), found)

    # What is still open: families with few members outside their largest component, then the small buckets of the others,
    # then the members of their large buckets, dealt anew.
    open_ = _open_members(members, found)
    family = components(open_.where("node <> a"), "a", "node").select("node", F.col("component").alias("family"))
    placed = stored(open_.select("node", "component", "n").distinct().join(family, "node"), "families")
    links = _group_links(_family_blocks(placed, most), sets, percent)
    wide = placed.join(_families(placed).where(F.col("minors") > most * MINOR_BLOCKS), "family").select("node")
    if some_wide := not wide.isEmpty():
        wide = stored(open_.join(wide, "node"), "wide-families")
        links = links.unionByName(_group_links(wide.where(F.col("size") <= most), sets, percent, own_band=True))
    found = joined(links, found)
    if some_wide and not (large := wide.where(F.col("size") > most)).isEmpty():
        members = _dealt_anew(large.select("node").distinct(), sets, percent)
        found = joined(_links(_pivot_pairs(_open_members(members, found), percent), sets, percent), found)
        open_ = _open_members(members, found)
        found = joined(_group_links(open_.where(F.col("size") <= most), sets, percent), found)
        if not (large := open_.where(F.col("size") > most)).isEmpty():
            found = joined(_block_links(_open_members(large.select("key", "node", "n"), found), sets, percent, most), found)

    found = stored(found, "components")
    of = standing.join(found, "node", "left").select("same", "head", F.coalesce("component", "node").alias("component"))
    first = of.groupBy("component").agg(F.min("head").alias("first"))
    of = of.join(first, "component").select("same", F.col("first.doc_id").alias("least"), F.col("first.row").alias("first"))
    result = signed.join(of, "same", "left")
    own, stays = F.when(F.col("same").isNull(), F.col("doc_id")).otherwise(F.col("least")), F.coalesce(F.col("row") == F.col("first"), F.lit(True))
    result = result.withColumn("component_id", own).withColumn("stays", stays)
    return result.select("row", "doc_id", "h1", "h2", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), "stays").alias("kept"), "stays")


def op2_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")
