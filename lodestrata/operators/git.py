"""Forensics on version-control logs.

A log is a table (project, line_no, value). Commits are (project, commit, author,
ts), changes (project, commit, path, additions, deletions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as t
from ..scratch import stored
from .files import git_noise, top_of_project


PLACES_OF_BLOCK, ROWS_OF_TASK = 1 << 20, 250_000


def new_path(path: Column) -> Column:
    """The name that a rename ends with, trimmed, without a pair of quotes around it, with forward slashes.

    The first braces count if an arrow is in them, else what is after the first arrow.
    """
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  a value that is named several times is made once
    quote, arrow = F.lit('"'), F.lit(" => ")
    bare = once(t.trimmed(path), lambda p: F.when(F.startswith(p, quote) & F.endswith(p, quote) & (F.length(p) > 1), F.substr(p, F.lit(2), F.length(p) - 2)).otherwise(p))
    braces = r"(?s)^([^{}]*)\{([^}]*?) => ([^}]*)\}(.*)$"
    braced = lambda p: F.replace(F.regexp_replace(p, braces, "$1$3$4"), F.lit("//"), F.lit("/"))
    plain = lambda p: F.regexp_replace(p, r"(?s)^.*? => ", "")
    # Most paths hold no arrow and meet no pattern.
    return F.translate(once(bare, lambda p: F.when(~F.contains(p, arrow), p).when(F.rlike(p, F.lit(braces)), braced(p)).otherwise(plain(p))), "\\", "/")


def parsed_log(log: DataFrame) -> DataFrame:
    """Each line with its commit (the line of its header): header lines have author and ts, change lines the rest.

    A header has a hash of 20 hexadecimal digits at least, an author, who may hold
    tabs, and unix seconds. Changes of binary files, other lines and those before
    the first header are left out, before anything is shuffled. Lines are dealt by blocks
    of places, so that a long log is no single task; the last header of each block is
    carried to the next.
    """
    bare = F.when(F.contains("value", F.lit("\r")), F.regexp_replace("value", r"\r+$", "")).otherwise(F.col("value"))

    def told(f: Column) -> Column:
        field = lambda n: F.get(f, F.lit(n))
        ts, added, deleted = (x.try_cast("bigint") for x in (F.element_at(f, -1), field(0), field(1)))
        is_header = (F.size(f) >= 3) & F.rlike(field(0), F.lit("^[0-9a-fA-F]{20,}$")) & ts.isNotNull()
        is_change = (F.size(f) == 3) & added.isNotNull() & deleted.isNotNull() & (field(2) != "")
        none = {"author": "string", "ts": "bigint", "path": "string", "additions": "bigint", "deletions": "bigint"}
        row = lambda header, **own: F.struct(F.lit(header).alias("is_header"), *(own.get(n, F.lit(None).cast(kind)).alias(n) for n, kind in none.items()))
        header = row(True, author=F.array_join(F.slice(f, F.lit(2), F.size(f) - 2), "\t"), ts=ts)
        return F.when(is_header, header).when(is_change, row(False, path=new_path(field(2)), additions=added, deletions=deleted))

    # Lines are told apart in an outer list: a filter does not go below it, so a line is split once.
    lines = log.select("project", "line_no", F.inline_outer(F.transform(F.array(F.split(bare, "\t", -1)), told)))
    rows = lines.where("is_header is not null").withColumn("block", F.expr(f"line_no div {PLACES_OF_BLOCK}"))
    rows = stored(rows, "log")
    at = F.when(F.col("is_header"), F.col("line_no"))
    # One row for each project and block.
    before = W.partitionBy("project").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy("project", "block").agg(F.max(at).alias("last")).select("project", "block", F.max("last").over(before).alias("carried"))
    own = F.max(at).over(W.partitionBy("project", "block").orderBy("line_no"))
    rows = rows.withColumn("own", own).join(carried, ["project", "block"]).withColumn("commit", F.coalesce("own", "carried"))
    return rows.where(F.col("commit").isNotNull()).select("project", "commit", "is_header", "author", "ts", "path", "additions", "deletions")


def commits_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("is_header").select("project", "commit", "author", "ts")


def changes_of(parsed: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Changes of paths that are no noise and, if given, exist."""
    rows = parsed.where(~F.col("is_header") & ~git_noise(F.col("path"))).select("project", "commit", "path", "additions", "deletions")
    return rows if existing is None else rows.join(existing.select("project", "path"), ["project", "path"], "left_semi")


def per_commit(changes: DataFrame) -> DataFrame:
    """Each path once for a commit, its changes summed."""
    return changes.groupBy("project", "commit", "path").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def totals(commits: DataFrame) -> DataFrame:
    return commits.groupBy("project").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"))


def file_stats(changes: DataFrame, commits: DataFrame, now: int) -> DataFrame:
    """Commits, changes, authors and days since the last change of each path."""
    rows = per_commit(changes).join(commits, ["project", "commit"])
    by_author = rows.groupBy("project", "path", "author").agg(
        F.count("*").alias("n"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.max("ts").alias("ts")
    )
    return by_author.groupBy("project", "path").agg(
        F.sum("n").alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count("*").alias("authors"),
        F.greatest(F.lit(0).cast("long"), F.expr(f"({now} - max(ts)) div 86400")).alias("last_touched_days"),
    )


def top_files(stats: DataFrame, n: int = rules.TOP["git_files"]) -> DataFrame:
    return top_of_project(stats, n, F.col("commits").desc(), F.col("path"))


def hotspots(changes: DataFrame, n: int = rules.TOP["hotspots"]) -> DataFrame:
    """Paths by commits times the logarithm of their churn."""
    rows = per_commit(changes).groupBy("project", "path").agg(F.count("*").alias("commits"), F.sum(F.col("additions") + F.col("deletions")).cast("long").alias("churn"))
    rows = rows.withColumn("score", F.round(F.col("commits") * F.log1p("churn"), 9))
    return top_of_project(rows, n, F.col("score").desc(), F.col("path"))


def _numbered(changes: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(project, commit, id) of the commits that say something, without paths that no pair can need; and (project, path, id) of the paths.

    Ids are numbers in the order of project and path, so that pairs are narrow and
    sorted as their paths are. A pair cannot reach ``least`` commits unless both its paths do, so rarer ones go before pairs are made.
    Commits are dealt over tasks of about ROWS_OF_TASK paths: what a task sums is bounded.
    """
    paths = stored(per_commit(changes).select("project", "commit", "path"), "commit-paths")
    counts = paths.groupBy("project", "commit").agg(F.count("*").alias("n"))
    usable = stored(paths.join(counts.where(F.col("n").between(rules.MIN_PAIR_FILES, rules.MAX_PAIR_FILES)).select("project", "commit"), ["project", "commit"]), "usable-paths")
    frequent = usable.groupBy("project", "path").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    names = stored(frequent.select("project", "path").orderBy("project", "path").withColumn("id", F.monotonically_increasing_id()), "paths")
    rows = usable.join(names, ["project", "path"]).select("project", "commit", "id").repartition(usable.count() // ROWS_OF_TASK + 1, "project", "commit")
    return rows, names


def _sets(rows: DataFrame) -> DataFrame:
    sets = rows.groupBy("project", "commit").agg(F.array_sort(F.collect_list("id")).alias("paths"))
    return sets.where(F.size("paths") > 1)


def pair_sets(changes: DataFrame, least: int = rules.MIN_COCHANGE) -> DataFrame:
    """(project, commit, paths) of the commits that say something: numbers of the paths that a pair can need, in order."""
    return _sets(_numbered(changes, least)[0])


def cochanges(changes: DataFrame, n: int = rules.TOP["cochange"], least: int = rules.MIN_COCHANGE) -> DataFrame:
    """Pairs of paths that change together; commits of one path or of very many say nothing.

    Paths are gathered for each commit, 30 at most by rule, so the pairs of a commit are bounded.
    """
    rows, names = _numbered(changes, least)
    pairs = F.flatten(F.transform("paths", lambda a, i: F.transform(F.slice("paths", i + 2, F.size("paths")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    counts = _sets(rows).select(F.inline_outer(pairs)).groupBy("a", "b").agg(F.count("*").alias("count")).where(F.col("count") >= least)
    first, second = names.select("project", F.col("id").alias("a"), F.col("path").alias("path_a")), names.select(F.col("id").alias("b"), F.col("path").alias("path_b"))
    top = top_of_project(counts.join(first, "a"), n, F.col("count").desc(), F.col("a"), F.col("b"))
    return top.join(second, "b").select("project", F.col("path_a").alias("a"), F.col("path_b").alias("b"), "count", "rank")


def bus_factor(changes: DataFrame, commits: DataFrame, n: int = rules.TOP["bus_factor"]) -> DataFrame:
    """Paths that one author holds: enough commits, most of them of one author, the first by name of equals."""
    by_author = per_commit(changes).join(commits, ["project", "commit"]).groupBy("project", "path", "author").agg(F.count("*").alias("n"))
    rows = by_author.groupBy("project", "path").agg(F.sum("n").alias("commits"), F.min(F.struct((-F.col("n")).alias("less"), "author")).alias("top"))
    rows = rows.select("project", "path", F.col("top.author").alias("top_author"), "commits", (-F.col("top.less") / F.col("commits")).alias("share"))
    rows = rows.where((F.col("commits") >= rules.MIN_OWNER_COMMITS) & (F.col("share") >= rules.MIN_OWNER_SHARE))
    return top_of_project(rows, n, F.col("share").desc(), F.col("commits").desc(), F.col("path"))


def status(commits: DataFrame, projects: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """(project, available, reason): whether a log says anything, and if not, why.

    Line 0 of a log holds the source's reason. A log of lines without a commit could
    not be parsed; one without lines has no commits.
    """
    rows = projects.join(commits.groupBy("project").agg(F.count("*").alias("n")), "project", "left")
    why = F.lit("no commits found")
    if log is not None:
        told = log.groupBy("project").agg(F.max(F.when(F.col("line_no") == 0, F.col("value"))).alias("told"), F.count_if((F.col("line_no") > 0) & (F.trim("value") != "")).alias("lines"))
        rows = rows.join(told, "project", "left")
        why = F.coalesce("told", F.when(F.col("lines") > 0, "could not parse git log output"), why)
    return rows.select("project", F.col("n").isNotNull().alias("available"), F.when(F.col("n").isNull(), why).alias("reason"))
