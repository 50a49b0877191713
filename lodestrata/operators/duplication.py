"""Duplicated lines: windows of normalised lines with equal fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as t
from ..scratch import broadcast_if_small, stored
from .files import top_of_project

FILE = ["project", "path"]


def normal_lines(files: DataFrame) -> DataFrame:
    """(project, path, lines): the lines of a file that count, in order."""
    rows = files.where("noise_reason is null").select(*FILE, t.comment_tokens(F.col("language")).alias("tokens"), F.transform(t.lines_of(F.col("content")), t.trimmed).alias("raw"))
    kept = F.filter("raw", lambda x: (F.octet_length(x) > 0) & ~t.starts_comment(x, F.col("tokens")) & F.rlike(x, F.lit(r"(?:[\p{IsAlphabetic}\p{N}][^\p{IsAlphabetic}\p{N}]*){3}")))
    plain = F.transform(kept, lambda x: F.when(F.rlike(x, F.lit(r"(?U)\s\s|[^\S ]")), F.regexp_replace(x, r"(?U)\s+", " ")).otherwise(x))
    return rows.select(*FILE, F.filter(plain, lambda x: F.octet_length(x) >= 12).alias("lines"))


def _run(start: Column, size: int) -> Column:
    return F.array_join(F.slice("lines", start + 1, F.lit(size)), "\n")


def windows(lines: DataFrame, size: int = rules.DUP_WINDOW, mix=F.xxhash64) -> DataFrame:
    """(project, path, start, fp) of every run of ``size`` lines; made inside a file's row, without a shuffle.

    ``fp`` is a 64-bit fingerprint of the hashes of the lines, each of which is taken once.
    """
    rows = lines.where(F.size("lines") >= size).select(*FILE, F.transform("lines", lambda x: F.xxhash64(x)).alias("h"))
    runs = F.transform(F.sequence(F.lit(0), F.size("h") - size), lambda n: F.struct(n.alias("start"), mix(*(F.get("h", n + k) for k in range(size))).alias("fp")))
    return rows.select(*FILE, F.inline(runs).alias("start", "fp"))


def suspected(found: DataFrame) -> DataFrame:
    """Windows whose fingerprint occurs twice at least in their project."""
    twice = found.groupBy("project", "fp").agg(F.count("*").alias("n")).where("n > 1").select("project", "fp")
    return found.join(twice, ["project", "fp"], "left_semi").select(*FILE, "start", "fp")


def confirmed(found: DataFrame, lines: DataFrame, size: int = rules.DUP_WINDOW) -> DataFrame:
    """``found`` with the SHA-256 of the text as ``fp``, so that windows of one fingerprint and different texts part."""
    starts = found.groupBy(*FILE).agg(F.collect_set("start").alias("starts")).join(lines, FILE)
    runs = F.transform("starts", lambda n: F.struct(n.alias("start"), F.sha2(_run(n, size), 256).alias("fp")))
    return starts.select(*FILE, F.inline(runs).alias("start", "fp"))


def repeated(found: DataFrame, lines: DataFrame | None = None, size: int = rules.DUP_WINDOW) -> DataFrame:
    """Windows that occur twice at least, with occurrences and whether it is the first of its project.

    With the lines that the windows were made of, equal fingerprints are confirmed on the
    text, of the windows that have a like only.
    """
    if lines is not None:
        found = stored(confirmed(suspected(found), lines, size), "confirmed")
    place = F.struct("path", "start")
    groups = found.groupBy("project", "fp").agg(F.count("*").alias("occurrences"), F.min(place).alias("first")).where("occurrences > 1")
    return found.join(groups, ["project", "fp"]).withColumn("canonical", (F.col("path") == F.col("first.path")) & (F.col("start") == F.col("first.start"))).drop("first")


def duplicate_ratio(again: DataFrame, code: DataFrame, size: int = rules.DUP_WINDOW) -> DataFrame:
    """(project, masked, ratio): lines of all but the first occurrences, each once, over the lines of code, at most 1."""
    masked = again.where("not canonical").select(*FILE, F.explode(F.sequence("start", F.col("start") + size - 1)).alias("pos")).distinct()
    counts = masked.groupBy("project").agg(F.count("*").alias("masked"))
    rows = code.join(counts, "project", "left").select("project", "code", F.coalesce("masked", F.lit(0)).alias("masked"))
    return rows.select("project", "masked", F.when(F.col("code") > 0, F.least(F.lit(1.0), F.col("masked") / F.col("code"))).otherwise(0.0).alias("ratio"))


def blocks(again: DataFrame, n: int = rules.TOP["blocks"], size: int = rules.DUP_WINDOW, lines: DataFrame | None = None) -> DataFrame:
    """Runs of canonical windows as blocks: in two files at least, or of twice the window's lines.

    ``lines`` are those that the windows were made of; with them a block has a sample of
    its text. Files and samples are gathered for the first ``n`` blocks of a project only.
    """
    again = stored(again, "repeated")
    run, block = F.col("start") - F.row_number().over(W.partitionBy(*FILE).orderBy("start")), [*FILE, "run"]
    own = again.where("canonical").withColumn("run", run).select(*block, "start", "fp", "occurrences")
    of_run = own.groupBy(*block).agg(
        (F.max("start") - F.min("start") + size).alias("line_count"), F.max("occurrences").alias("occurrences"), F.min("start").alias("start"), F.min_by("fp", "start").alias("fingerprint"),
    )
    other = again.select("project", "fp", F.col("path").alias("file")).distinct()
    seen = stored(own.select(*block, "fp", "start").join(other, ["project", "fp"]).groupBy(*block, "file").agg(F.min("start").alias("at")), "block-files")
    rows = of_run.join(seen.groupBy(*block).agg(F.count("*").alias("in_files")), block).where((F.col("in_files") >= 2) | (F.col("line_count") >= 2 * size))
    rows = stored(rows, "all-blocks")
    counts = rows.groupBy("project").agg(F.count("*").alias("blocks"))
    top = top_of_project(rows, n, (F.col("occurrences") * F.col("line_count")).desc(), F.col("path"), F.col("start"))
    # Files of a block in the order in which they come up: by window, then by path.
    top = stored(top, "top-blocks")
    files = seen.join(broadcast_if_small(top.select(*block)), block).groupBy(*block).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "file"))), lambda x: x["file"]).alias("files"))
    top = top.join(files, block).join(counts, "project")
    sample = F.lit(None).cast("string")
    if lines is not None:
        top, sample = top.join(lines, FILE), _run(F.col("start"), size)
    return top.select("project", "rank", "fingerprint", "line_count", "occurrences", "files", sample.alias("sample"), "blocks")
