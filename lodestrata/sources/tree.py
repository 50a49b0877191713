"""Source trees as tables of files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import rules
from ..functions import text as t
from ..operators import files


def raw_tree(spark: SparkSession, root: str, project: str) -> DataFrame:
    """(project, path, length, content) of all files under a folder that any file system of Spark can reach.

    Spark lists no hidden files, so rules of .gitignore don't apply; ``SourceTree`` reads these too.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") if ":" in root.split("/")[0] else root
    return read.select(F.lit(project).alias("project"), files.normal_path(plain, base).alias("path"), F.col("length"), "content")


class SourceTree(DataSource):
    """``spark.read.format("sourcetree").option("path", root)``: files under folders that the executors can reach.

    Each folder below the root is a partition. Folders that are never scanned are
    not entered, and files over the limit are named without content. Of a work tree's
    ``.git`` only ``HEAD`` and ``info/exclude`` are read, which tell what is ignored.
    """

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return "project string, path string, length bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["path"], self.options.get("project", self.options["path"]))


def _entered(name: str) -> bool:
    return name not in rules.SKIPPED_DIRS and not name.startswith(".")


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, project: str):
        self.root, self.project = root, project

    def partitions(self) -> list[InputPartition]:
        folders = [e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and _entered(e.name)]
        # Large folders are dealt by their own folders.
        inner = [f"{f}/{e.name}" for f in folders for e in os.scandir(os.path.join(self.root, f)) if e.is_dir(follow_symlinks=False) and _entered(e.name)]
        return [InputPartition(""), *(InputPartition(f"{f}/.") for f in sorted(folders)), *map(InputPartition, sorted(inner))]

    def read(self, partition):
        flat = not partition.value or partition.value.endswith("/.")
        if not partition.value:
            for name in (".git", ".git/HEAD", ".git/info/exclude"):
                if os.path.isfile(full := os.path.join(self.root, name)):
                    with open(full, "rb") as f:
                        yield self.project, name, os.path.getsize(full), f.read()
        for folder, inner, names in os.walk(os.path.normpath(os.path.join(self.root, partition.value))):
            inner[:] = [d for d in inner if not flat and _entered(d)]
            for name in names:
                full = os.path.join(folder, name)
                if os.path.islink(full) or name == ".git":
                    continue
                length = os.path.getsize(full)
                content = None
                known = name == ".gitignore" or name.rpartition(".")[2].lower() in rules.LANGUAGE_OF
                if known and length <= rules.MAX_FILE_BYTES:
                    with open(full, "rb") as f:
                        content = f.read()
                yield self.project, os.path.relpath(full, self.root).replace(os.sep, "/"), length, content


class TreeListing(DataSource):
    """``spark.read.format("treelisting").option("path", root)``: all that exists below the root, by path only.

    Unlike ``SourceTree`` it enters every folder but ``.git`` and opens no file. Folders
    are listed too, and links as far as they lead somewhere.
    """

    @classmethod
    def name(cls) -> str:
        return "treelisting"

    def schema(self) -> str:
        return "project string, path string"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["path"], self.options.get("project", self.options["path"]))


class _ListingReader(DataSourceReader):
    def __init__(self, root: str, project: str):
        self.root, self.project = root, project

    def partitions(self) -> list[InputPartition]:
        folders = sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and e.name != ".git")
        return [InputPartition(""), *map(InputPartition, folders)]

    def read(self, partition):
        top = os.path.join(self.root, partition.value)
        for folder, inner, names in os.walk(top):
            here = os.path.relpath(folder, self.root).replace(os.sep, "/")
            for name in [*inner, *names]:
                if name != ".git" and os.path.exists(os.path.join(folder, name)):
                    yield self.project, name if here == "." else f"{here}/{name}"
            # The root's partition lists the root only, the others all below them.
            inner[:] = [] if not partition.value else [d for d in inner if d != ".git" and not os.path.islink(os.path.join(folder, d))]


def _literal(c: Column) -> Column:
    """Text as a regular expression that matches it alone."""
    return F.regexp_replace(c, r"([\p{Punct}\s])", r"\\$1")


# The parts of a pattern: an escaped sign, folders of any depth, names of any length, a sign, a set of signs, a plain sign.
_PARTS = r"(?s)(\\.|^\*\*/|/\*\*/|/\*\*$|\*+|\?|\[[!^]?\]?(?:\\.|[^\]\\])*\]|.)"


def _part(p: Column) -> Column:
    """A part of a pattern as a regular expression."""
    inner = F.regexp_replace(F.regexp_replace(p, r"^\[[!^]?|\]$", ""), r"(?<!\\)([\[\]&^])", r"\\$1")
    negated = F.when(F.rlike(p, F.lit(r"^\[[!^]")), "^").otherwise("")
    return (
        F.when((F.length(p) == 2) & F.startswith(p, F.lit("\\")), _literal(F.substring(p, 2, 1)))
        .when(p == "**/", "(?:.*/)?")
        .when(p == "/**/", "/(?:.*/)?")
        .when(p == "/**", "/.+")
        .when(F.startswith(p, F.lit("*")), "[^/]*")
        .when(p == "?", "[^/]")
        .when(F.startswith(p, F.lit("[")) & (F.length(p) > 1), F.concat(F.lit("(?!/)["), negated, inner, F.lit("]")))
        .otherwise(_literal(p))
    )


def ignored_by(patterns: DataFrame) -> DataFrame:
    """(project, folder, ord, rule, keep, only_folder) of .gitignore files (project, path, content).

    ``rule`` is a regular expression on whole paths of files or folders under
    ``folder``, which ends with a slash or is empty. ``keep`` marks a rule that takes
    back; of the rules that match, the last of the deepest folder counts. A pattern
    with a set that is not closed matches nothing.
    """
    folder = F.when(F.col("path") == ".git/info/exclude", "").otherwise(F.regexp_replace("path", r"[^/]*$", ""))
    lines = patterns.select("project", folder.alias("folder"), (F.col("path") == ".git/info/exclude").alias("weak"), F.posexplode(t.lines_of(F.col("content"))).alias("ord", "raw"))
    lines = lines.withColumn("ord", F.when(F.col("weak"), F.col("ord") - (1 << 30)).otherwise(F.col("ord")))  # files of the tree come after it
    rows = lines.select("project", "folder", "ord", F.regexp_replace("raw", r"(?<!\\)\s+$", "").alias("raw")).where("raw <> '' and not startswith(raw, '#')")
    keep = F.startswith("raw", F.lit("!"))
    body = F.when(keep, F.substring("raw", 2, 1 << 16)).otherwise(F.col("raw"))
    only_folder = F.endswith(body, F.lit("/"))
    rows = rows.select("project", "folder", "ord", keep.alias("keep"), only_folder.alias("only_folder"), F.regexp_replace(body, "/$", "").alias("body"))
    anchored = F.contains("body", F.lit("/"))
    rows = rows.withColumn("parts", F.regexp_extract_all(F.regexp_replace("body", "^/", ""), F.lit(_PARTS), 1))
    wild = F.array_join(F.transform("parts", _part), "")
    rule = F.concat(F.lit("(?s)^"), _literal(F.col("folder")), F.when(anchored, "").otherwise("(?:.*/)?"), wild, F.lit("$"))
    return rows.where("body <> '' and not array_contains(parts, '[')").select("project", "folder", "ord", rule.alias("rule"), "keep", "only_folder")


def _above(path: Column, itself: bool = False) -> Column:
    """The folders over a path from the root down, without slashes at their ends; the root is an empty name."""
    parts = F.split(path, "/", -1)
    last = F.size(parts) if itself else F.size(parts) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def not_ignored(paths: DataFrame, rules_: DataFrame) -> DataFrame:
    """(project, path) of the files that the rules of ``ignored_by`` leave.

    Folders are decided first: what lies under an ignored folder is ignored, whatever
    later rules say, since it is never entered. Each folder is decided once; files
    then look at their own folder and at the rules on their own names. A path meets
    the rules of the folders over it only.
    """
    paths = paths.select("project", "path")
    folders = paths.select("project", F.explode(F.slice(_above(F.col("path")), F.lit(2), F.size(F.split("path", "/", -1)))).alias("path")).distinct()

    def decided(nodes: DataFrame, of_files: bool) -> DataFrame:
        """(project, path) that the last of their rules ignores."""
        over = F.transform(_above(F.col("path")), lambda f: F.when(f == "", "").otherwise(F.concat(f, F.lit("/"))))
        met = nodes.select("project", "path", F.explode(over).alias("folder")).join(rules_.where("not only_folder") if of_files else rules_, ["project", "folder"])
        last = met.where(F.rlike("path", F.col("rule"))).groupBy("project", "path").agg(F.max_by("keep", F.struct(F.length("folder"), "ord")).alias("keep"))
        return last.where("not keep").select("project", "path")

    closed = decided(folders, False).withColumnRenamed("path", "over")
    cut = folders.select("project", "path", F.explode(_above(F.col("path"), itself=True)).alias("over")).join(closed, ["project", "over"], "left_semi").select("project", F.col("path").alias("folder")).distinct()
    named = paths.withColumn("folder", F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(""))
    return named.join(cut, ["project", "folder"], "left_anti").select("project", "path").join(decided(paths, True), ["project", "path"], "left_anti")


def scan(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, counts): the files to analyse and, for each project, how many were seen, skipped and kept.

    ``raw`` has project, path, length, content. Skipped are files of no known
    language, over the limit, or not UTF-8. Rules of .gitignore and .git/info/exclude
    apply to projects that have a .git/HEAD, or a file .git as work trees and submodules do.
    """
    seen = raw.where(files.is_scanned(F.col("path")) & (F.col("path") != ".git"))
    kept_under_git = raw.where("path in ('.git/HEAD', '.git')").select("project").distinct()
    patterns = raw.where("path = '.git/info/exclude'").unionByName(seen.where("path = '.gitignore' or endswith(path, '/.gitignore')"))
    rules_ = ignored_by(patterns.join(kept_under_git, "project", "left_semi").select("project", "path", F.decode("content", "UTF-8").alias("content")))
    own = seen.join(not_ignored(seen, rules_), ["project", "path"], "left_semi")
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    known = own.where(files.language_of(ext).isNotNull())
    fits = (F.col("length") <= rules.MAX_FILE_BYTES) & F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(False))
    text = known.where(fits).select("project", "path", F.decode("content", "UTF-8").alias("content"))
    recognised = files.language_of(ext).isNotNull()
    counts = own.groupBy("project").agg(
        F.count("*").alias("seen"), F.count_if(recognised).alias("recognised"), F.count_if(~(recognised & fits)).alias("skipped"), F.count_if(recognised & fits).alias("kept")
    )
    return files.as_files(text), counts
