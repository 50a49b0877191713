"""Line dedup with levelled sorted runs of line hashes.

A run is a table bucketed and sorted by the hash of the line key. Each new batch
of lines is merged with the runs: keys they lack are new, the others are hits; both
go with their counts into a run of level 0. When a level has ``fanout`` runs they
are compacted into one of the next level. Only DataFrame functions are used.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import broadcast_if_small, shared_path, stored
from .columns import as_row

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ("_n_lines", "_n_dropped", "_kept")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """One run of two; both are bucketed and sorted, so nothing is shuffled."""
    other = b.select("h1", "h2", F.col("docs").alias("more"), F.col("last").alias("later"), F.col("fresh").alias("new"))
    docs = F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))
    fresh = F.coalesce("fresh", F.lit(False)) | F.coalesce("new", F.lit(False))
    return a.join(other, ["h1", "h2"], "full").select("h1", "h2", docs.alias("docs"), F.greatest("last", "later").alias("last"), fresh.alias("fresh"))


RUN = "h1 BIGINT, h2 BIGINT, docs BIGINT, last BIGINT, fresh BOOLEAN"
LISTED = "level int, path string, buckets int, fanout int"


class LineRuns:
    """Runs of (h1, h2, docs, last, fresh): hash, documents with the line, largest doc_id among them, and whether no older run has the key.

    Runs are files in the shared folder. ``save`` writes a list of them, with which
    ``opened`` goes on another day, in another session: a later batch meets them then.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = [[]]  # names of tables
        self.paths: dict[str, str] = {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _named(self, path: str | None = None) -> str:
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        self.paths[name] = path or shared_path(self.spark, name)
        return name

    def _run(self, rows: DataFrame) -> str:
        """Writes a sorted run; the rows are clustered by the hash already, so each bucket is one file."""
        name = self._named()
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).format("parquet").saveAsTable(name)
        return name

    @property
    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of (doc_id, h1, h2); returns what of it no run had before."""
        self._compact()
        counted = batch.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
        fresh = F.lit(True)
        for n, run in enumerate(self.runs):
            counted = counted.join(run.where("fresh").select("h1", "h2", F.lit(1).alias(f"run_{n}")), ["h1", "h2"], "left")
            fresh &= F.col(f"run_{n}").isNull()
        self.levels[0].append(new := self._run(counted.select("h1", "h2", "docs", "last", fresh.alias("fresh"))))
        return self.spark.table(new).where("fresh").select("h1", "h2", "docs", "last")

    def _compact(self) -> None:
        for n in range(len(self.levels)):
            if len(self.levels[n]) >= self.fanout:
                merged = reduce(_merged, map(self.spark.table, self.levels[n]))
                self.levels[n] = []
                if n + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[n + 1].append(self._run(merged))

    def totals(self) -> DataFrame:
        """(h1, h2, docs, last) over all that was ingested."""
        return reduce(_merged, self.runs).select("h1", "h2", "docs", "last")

    def save(self, path: str) -> None:
        """Writes a list of the runs, by which ``opened`` finds their files."""
        rows = [(level, self.paths[name], self.buckets, self.fanout) for level, names in enumerate(self.levels) for name in names]
        self.spark.createDataFrame(rows, LISTED).coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> LineRuns:
        """The runs of such a list, under new names in this session's catalog."""
        rows = spark.read.schema(LISTED).json(path).orderBy("level", "path").collect()
        out = cls(spark)
        for r in rows:
            out.buckets, out.fanout = r["buckets"], r["fanout"]
            out.levels += [[] for _ in range(len(out.levels), r["level"] + 1)]
            out.levels[r["level"]].append(name := out._named(r["path"]))
            spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {r['buckets']} BUCKETS LOCATION '{r['path']}'")
        return out

    def close(self) -> None:
        """Takes the runs out of the catalog; their files stay in the shared folder."""
        for name in self.paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def long_lines(docs: DataFrame, min_length: int, batches: int) -> DataFrame:
    """(doc_id, t1, t2, h1, h2, pos, first, batch) of the lines whose key has at least ``min_length`` code points.

    t1 and t2 tell the text, h1 and h2 the key, pos the line; ``first`` marks the
    first line of each key in its row. A row's lines are in one batch, by a hash of its
    doc_id and text.
    """
    keys = F.transform(F.transform(_lines(docs["text"]), line_key), lambda k, i: F.struct(k.alias("k"), i.alias("pos")))
    hashed = F.transform(
        F.filter(keys, lambda x: F.char_length(x["k"]) >= min_length),
        lambda x: F.struct(F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit("line"), x["k"]).alias("h2"), x["pos"].alias("pos")),
    )
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *_text_hash(docs["text"]), F.array_sort(hashed).alias("lines"), F.pmod(F.xxhash64(F.lit("batch"), docs["doc_id"].cast("long"), docs["text"]), F.lit(batches)).alias("batch"))
    before = lambda i: F.get("lines", i - 1)
    marked = F.transform("lines", lambda x, i: F.struct(x["h1"], x["h2"], x["pos"], ((i == 0) | (before(i)["h1"] != x["h1"]) | (before(i)["h2"] != x["h2"])).alias("first")))
    return named.select("doc_id", "t1", "t2", F.inline(marked).alias("h1", "h2", "pos", "first"), "batch")


def _text_hash(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


def drop_common_lines(docs: DataFrame, min_length: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with the columns _n_lines, _n_dropped (long) and _kept (the remaining text).

    Lines are split at \\n; a null or empty text is one empty line. A key of at
    least ``min_length`` code points in at least ``min_docs`` documents loses all
    its lines except in the largest doc_id that holds it. Each row is a document;
    rows that repeat a doc_id keep or lose a line alike. A row with null doc_id
    never has the largest, and keeps its lines only where all doc_ids are null.
    An empty table gives no rows; the other columns stay as they are, but columns
    of the three names are replaced. Work grows with n log n in a text's lines.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "lines")
    long_lines(docs, min_length, batches).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema("doc_id long, t1 long, t2 long, h1 long, h2 long, pos int, first boolean, batch int").parquet(path)

    runs = LineRuns(spark, fanout)
    try:
        for n in range(batches):
            runs.ingest(lines.where((F.col("batch") == n) & F.col("first")))
        # Common lines are few; where they are not, the join shuffles and a very common line's rows can be split.
        common = broadcast_if_small(stored(runs.totals().where(F.col("docs") >= min_docs), "common-lines"), 100_000)
    finally:
        runs.close()
    drops = lines.join(common, ["h1", "h2"]).where("last is not null and not (doc_id <=> last)").groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("gone"))

    rest = [c for c in docs.columns if c not in ADDED and c != "text"]
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), *_text_hash(docs["text"]), docs["text"].alias("text"), as_row(docs, rest).alias("row"))
    met = rows["id"].eqNullSafe(drops["doc_id"]) & (rows["t1"] == drops["t1"]) & (rows["t2"] == drops["t2"])
    split = rows.join(drops, met, "left").select("row", "text", "gone", _lines(F.col("text")).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return split.select(
        *(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ADDED),
        F.size("lines").cast("long").alias("_n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("_n_dropped"),
        kept.alias("_kept"),
    )


def op7_line_runs(spark, sf_dir: str) -> DataFrame:
    """Lines dropped from each document and the digest of the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_common_lines(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5)
SELECT a.doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (c.last IS NOT NULL AND c.last IS DISTINCT FROM a.doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.last IS NULL OR c.last IS NOT DISTINCT FROM a.doc_id), '')) AS kept_sha256
FROM keyed a LEFT JOIN common c ON a.k = c.k
GROUP BY a.r, a.doc_id
"""
