"""Functions of files: where they are, how long, how complex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.spans import functions_of
from .files import list_of_project


def functions(files: DataFrame) -> DataFrame:
    """(project, path, language, ord, name, start, length, complexity) of the functions of files that are not noise.

    ``start`` is 0-based. Functions are looked for in the raw text, in Lua in the
    text without comments; a file is read in one pass, however many it has.
    """
    rows = files.where("noise_reason is null").select("project", "path", "language", functions_of("content", "language").alias("found"))
    return rows.select("project", "path", "language", F.inline("found"))


def with_longest(files: DataFrame) -> DataFrame:
    """Adds longest_name and longest_line of each file, as ``longest_of_file`` tells them; null without functions. Nothing is shuffled."""
    found = functions_of(F.when(F.col("noise_reason").isNull(), F.col("content")), "language")
    best = F.array_max(F.transform(found, lambda f: F.struct(f["length"].alias("length"), (-f["ord"]).alias("earlier"), f["name"].alias("name"), f["start"].alias("start"))))
    return files.withColumn("_b", best).select(*files.columns, F.col("_b.name").alias("longest_name"), (F.col("_b.start") + 1).alias("longest_line"))


def longest_of_file(found: DataFrame) -> DataFrame:
    """The longest function of each file, the first of equals; how many are long."""
    best = F.max_by(F.struct("name", "start", "length"), F.struct("length", -F.col("ord")))
    return found.groupBy("project", "path").agg(
        best.alias("b"), F.count("*").alias("functions"), F.count_if(F.col("length") > rules.LONG_FUNCTION).alias("long_functions"),
        F.max("complexity").alias("max_complexity"),
    ).select(
        "project", "path", "functions", "long_functions", "max_complexity",
        F.col("b.name").alias("longest_name"), (F.col("b.start") + 1).alias("longest_line"), F.col("b.length").alias("longest"),
    )


def long_functions(found: DataFrame, n: int = rules.TOP["long_functions"]) -> DataFrame:
    return list_of_project(found.where(F.col("length") > rules.LONG_FUNCTION), n, F.col("length").desc(), F.col("path"), F.col("ord"))


def complex_functions(found: DataFrame, n: int = rules.TOP["complex"]) -> DataFrame:
    return list_of_project(found.where(F.col("complexity") >= rules.LISTED_CC), n, F.col("complexity").desc(), F.col("path"), F.col("ord"))


def function_totals(found: DataFrame) -> DataFrame:
    """Functions, complexity sums and how many are long or complex, of each project."""
    return found.groupBy("project").agg(
        F.count("*").alias("functions"), F.count_if(F.col("length") > rules.LONG_FUNCTION).alias("long_functions"),
        F.count_if(F.col("complexity") > rules.HIGH_CC).alias("high_complexity"), F.avg("complexity").alias("average_complexity"),
        F.max("complexity").alias("max_complexity"),
    )
