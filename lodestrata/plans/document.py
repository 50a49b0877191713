"""The analysis of each project as one JSON document, with the field names that its readers know."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def _fields(**values: Column | str) -> Column:
    return F.struct(*((c(v) if isinstance(v, str) else v).alias(k) for k, v in values.items()))


def _lists(rows: DataFrame, name: str, order: Column | str, value: Column) -> DataFrame:
    """(project, name): the rows' values in order. Lists have fixed lengths, but for languages, of which there are few."""
    each = F.struct((c(order) if isinstance(order, str) else order).alias("at"), value.alias("v"))
    return rows.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["v"]).alias(name))


def _file() -> Column:
    does = F.transform("responsibilities", lambda r: F.struct(*(r[k].alias(k) for k in ("kind", "label", "evidence", "token", "line", "snippet"))))
    return _fields(
        path="path", language="language", ext="ext", lines="lines", codeLines="code", commentLines="comment", blankLines="blank", sizeBytes="size_bytes", functions="functions",
        longFunctions="long_functions", noise=c("noise_reason").isNotNull(), noiseReason="noise_reason", runtime="runtime", fileType="file_type", responsibilities=does,
        longestFunction="longest", longestFunctionName="longest_name", longestFunctionLine="longest_line", componentName="symbol", componentLine="symbol_line", fanIn="fan_in",
    )


def documents(analysis: dict[str, DataFrame], generated_at: int, counts: DataFrame | None = None) -> DataFrame:
    """(project, document) of ``analyse``; ``counts`` as ``tree.scan`` returns them, else all files count as seen."""
    a, start = analysis, c("start") + 1
    own = c("noise_reason").isNull()
    more = a["files"].groupBy("project").agg(F.coalesce(F.sum(F.when(~own, c("lines"))), F.lit(0)).alias("ignored_lines"), F.count("*").alias("read"))
    blocks = a["blocks"].groupBy("project").agg(F.max("blocks").alias("all_blocks"))
    parts = [
        more, blocks,
        _lists(a["languages"], "languages", F.struct(-c("lines"), c("language")), _fields(language="language", files="files", lines="lines")),
        _lists(a["largest"], "largest_files", "rank", _file()), _lists(a["ignored"], "ignored_largest", "rank", _file()), _lists(a["all_files"], "all_files", "rank", _file()),
        _lists(a["long_functions"], "long", "rank", _fields(file="path", name="name", startLine=start, length="length", language="language")),
        _lists(a["complex_functions"], "complex", "rank", _fields(file="path", name="name", startLine=start, length="length", complexity="complexity", language="language")),
        _lists(a["blocks"], "duplication", "rank", _fields(fingerprint="fingerprint", lineCount="line_count", occurrences="occurrences", files="files", sample="sample")),
        _lists(a["unused_listed"], "unused", "rank", _fields(file="path", name="name", source="source", line="line")),
        _lists(a["secrets_listed"], "leaks", "rank", _fields(file="path", line="line", kind="kind", severity="severity", snippet="snippet")),
        _lists(a["dependencies"], "edges", "rank", F.struct(c("src").alias("from"), c("dst").alias("to"))),
        _lists(a["cycles"], "rings", "rank", c("files")), a["commands"].select("project", "commands"),
    ]
    if counts is not None:
        parts.append(counts.select("project", "seen", "skipped"))
    rows = reduce(lambda x, y: x.join(y, "project", "left"), parts, a["totals"])
    count = lambda name: F.coalesce(c(name), F.lit(0)).cast("long")
    listed = lambda name: F.coalesce(c(name), F.array())
    document = _fields(
        projectName=F.substring_index("project", "/", -1), projectPath="project", generatedAt=F.lit(generated_at), totalFiles=count("seen") if counts is not None else count("read"), scannedFiles=count("read"),
        skippedFiles=count("skipped") if counts is not None else F.lit(0), analyzedFiles="files", ignoredFiles="ignored", ignoredLines=count("ignored_lines"), totalLines="lines", codeLines="code",
        commentLines="comment", blankLines="blank", totalBytes="bytes", totalFunctions="functions", avgFileLines="average_lines", maxFanIn="max_fan_in", duplicateLineRatio="duplicate_ratio",
        totalLongFunctions="long_functions", totalUnusedImports="unused_imports", totalDuplicateBlocks=count("all_blocks"), hugeFileCount="huge_files", securityHigh="high", securityMedium="medium",
        securityLow="low", avgComplexity="average_complexity", maxComplexity="max_complexity", highComplexityFunctions="high_complexity", cycleCount="cycles", verifyCommands=listed("commands"),
        languages=listed("languages"), largestFiles=listed("largest_files"), ignoredLargest=listed("ignored_largest"), allFiles=listed("all_files"), longFunctions=listed("long"),
        duplication=listed("duplication"), unusedImports=listed("unused"), securityFindings=listed("leaks"), dependencies=listed("edges"), complexFunctions=listed("complex"), cycles=listed("rings"),
    )
    return rows.select("project", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))
