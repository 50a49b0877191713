"""Classification of files by path, and their lines.

A table of files has the columns project, path, language, ext, size_bytes,
content, noise_reason. The order of a project's files is that of their paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as t
from ..scratch import stored


def language_of(ext: Column) -> Column:
    """Language of a file extension in any case, null if it is not analysed."""
    table = F.create_map(*(F.lit(x) for pair in rules.LANGUAGE_OF.items() for x in pair))
    return table[t.ascii_lower(ext)]


def is_scanned(path: Column) -> Column:
    """Whether no directory above the file is skipped; the root is never looked at."""
    return ~F.rlike(path, F.lit(r"(^|/)(\.[^/]*|" + "|".join(rules.SKIPPED_DIRS) + ")/"))


def normal_path(path: Column, root: str = "") -> Column:
    """Path under the root, with forward slashes."""
    path = F.translate(path, "\\", "/")
    return F.regexp_replace(path, "^" + "\\Q" + root.rstrip("/") + "\\E/", "") if root else path


def noise_reason(path: Column) -> Column:
    """``lockfile``, ``generated`` or null."""
    lower = t.ascii_lower(path)
    name = t.base_name(lower)
    return F.when(name.isin(rules.LOCKFILES), "lockfile").when(
        F.rlike(name, F.lit(rules.GENERATED_SUFFIX)) | F.rlike(lower, F.lit(rules.GENERATED_PATH)), "generated"
    )


def git_noise(path: Column) -> Column:
    """Paths that version-control statistics leave out."""
    lower = t.ascii_lower(path)
    return F.rlike(lower, F.lit(rules.GIT_NOISE)) | t.base_name(lower).isin(rules.GIT_LOCKFILES)


def as_files(paths: DataFrame) -> DataFrame:
    """(project, path, content) as a table of files: languages known, in scanned directories. Rows without content are no files; sources set limits of size."""
    name = t.base_name(F.col("path"))
    last = F.substring_index(name, ".", -1)  # the whole name, if it has no dot
    ext = F.when((last != "") & F.contains(name, F.lit(".")), t.ascii_lower(last))
    return (
        paths.withColumn("ext", ext)
        .withColumn("language", language_of(F.col("ext")))
        .withColumn("size_bytes", F.octet_length("content").cast("long"))
        .where(F.col("language").isNotNull() & F.col("content").isNotNull() & is_scanned(F.col("path")))
        .select("project", "path", "language", "ext", "size_bytes", "content", noise_reason(F.col("path")).alias("noise_reason"))
    )


def with_line_counts(files: DataFrame) -> DataFrame:
    """Adds lines, blank, comment, code of each file."""
    # The tokens are a column of their own, so that they are looked up once for a file and not for a line.
    out = files.withColumn("_t", t.comment_tokens(F.col("language"))).withColumn("_c", t.line_counts(t.lines_of(F.col("content")), F.col("_t")))
    return out.select(
        *files.columns, F.col("_c.total").alias("lines"), F.col("_c.blank").alias("blank"), F.col("_c.comment").alias("comment"),
        (F.col("_c.total") - F.col("_c.blank") - F.col("_c.comment")).alias("code"),
    )


def language_stats(counted: DataFrame) -> DataFrame:
    """Files and lines of each language of a project, noise left out."""
    return counted.where("noise_reason is null").groupBy("project", "language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))


def project_totals(counted: DataFrame) -> DataFrame:
    """One row for each project; bytes include noise, the rest does not."""
    own = F.col("noise_reason").isNull()
    of = lambda c: F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)).cast("long")
    files = F.count_if(own)
    return counted.groupBy("project").agg(
        files.alias("files"), of("lines").alias("lines"), of("code").alias("code"), of("comment").alias("comment"), of("blank").alias("blank"),
        F.sum("size_bytes").alias("bytes"), F.count_if(~own).alias("ignored"), F.count_if(own & (F.col("lines") > rules.HUGE_LINES)).alias("huge_files"),
        F.coalesce(of("lines") / F.nullif(files, F.lit(0)), F.lit(0.0)).alias("average_lines"),
    )


def top_of_project(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each project; ties are for the caller's order to settle."""
    from pyspark.sql import Window as W

    return rows.withColumn("rank", F.row_number().over(W.partitionBy("project").orderBy(*order))).where(F.col("rank") <= n)


def list_of_project(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The same with ``total``: how many rows the list was cut from. The rows are written first, so that both are read off them and made once."""
    rows = stored(rows, "list")
    return top_of_project(rows, n, *order).join(rows.groupBy("project").agg(F.count("*").alias("total")), "project")


def largest_files(counted: DataFrame, n: int = rules.TOP["largest"], noise: bool = False) -> DataFrame:
    rows = counted.where(F.col("noise_reason").isNotNull() if noise else F.col("noise_reason").isNull())
    return top_of_project(rows.select("project", "path", "lines"), n, F.col("lines").desc(), F.col("path"))
