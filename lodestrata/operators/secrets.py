"""Secrets in source text, line by line; the first rule that matches a line counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as t
from .files import list_of_project

REDACTED = "«redacted»"


def redacted(text: Column) -> Column:
    """A line without the values that any of the rules finds in it."""
    for _, _, pattern in rules.SECRETS:
        text = F.regexp_replace(text, pattern, REDACTED)
    for pattern, value in [*((p, r"(\S+)") for _, _, p in rules.CONFIG_SECRETS), (rules.ASSIGNED_SECRET, r"""([^'"]{8,})""")]:
        flags, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
        before, after = body.split(value)
        text = F.regexp_replace(text, f"{flags}({before}){value[1:-1]}(?={after})" if after else f"{flags}({before}){value[1:-1]}", f"$1{REDACTED}")
    return text


def secrets(files: DataFrame, assigned_only: bool = False) -> DataFrame:
    """(project, path, line, kind, severity, snippet) of the first rule that finds a value which is no placeholder.

    Under test paths the severity is low. The snippet shows none of the line's
    secrets. All assigned values count if only they are asked for.
    """
    lines = files.where("noise_reason is null").select("project", "path", "language", F.posexplode_outer(t.lines_of(F.col("content"))).alias("n", "text"))
    text = F.col("text")
    # Outer lists are asked by no filter below, which would make them twice. Few lines hold any of the marks that every rule asks for; only these meet the rules, once.
    lines = lines.where(F.rlike(text, F.lit(rules.SECRET_MARKS)))
    rows = [
        F.when(F.rlike(text, F.lit(p)), F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.regexp_extract(text, p, 0).alias("value")))
        for k, s, p in rules.SECRETS
    ]
    config = [
        F.when((F.col("language") == "Config") & F.rlike(text, F.lit(p)), F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.regexp_extract(text, p, 1).alias("value")))
        for k, s, p in rules.CONFIG_SECRETS
    ]
    value = F.regexp_extract(text, rules.ASSIGNED_SECRET, 2)
    told = lambda kind, severity, v: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), v.alias("value"))
    random = (F.length(value) >= rules.ENTROPY_LENGTH) & (t.entropy(value) >= rules.ENTROPY_BITS)
    assigned = F.when(
        F.rlike(text, F.lit(rules.ASSIGNED_SECRET)),
        F.when(random, told("High-entropy secret", "high", value)).otherwise(told("Hardcoded secret", "medium", value)),
    )
    found = F.array(*([] if assigned_only else rows + config), assigned)
    real = F.filter(found, lambda h: h.isNotNull() & ~F.rlike(h["value"], F.lit(rules.PLACEHOLDER)))
    hits = lines.select("project", "path", "n", "text", F.explode_outer(F.slice(real, 1, 1)).alias("hit")).where("hit is not null")
    severity = F.when(F.rlike("path", F.lit(rules.TEST_PATH)), "low").otherwise(F.col("hit.severity"))
    return hits.select(
        "project", "path", (F.col("n") + 1).alias("line"), F.col("hit.kind").alias("kind"), severity.alias("severity"),
        t.snippet(redacted(text)).alias("snippet"),
    )


def severity_counts(found: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return found.groupBy("project").agg(count("high"), count("medium"), count("low"), F.count("*").alias("total"))


def top_secrets(found: DataFrame, n: int = rules.TOP["security"]) -> DataFrame:
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return list_of_project(found, n, rank, F.col("path"), F.col("line"))
