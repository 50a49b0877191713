"""Scores of a project as expressions on its totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp, js_round


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def _score(*penalties: Column) -> Column:
    """100 less the penalties; one whose inputs are missing takes nothing."""
    left = F.lit(100.0)
    for p in penalties:
        left = left - F.coalesce(p, F.lit(0.0))
    return F.greatest(F.lit(0), F.least(F.lit(100), js_round(left))).cast("int")


def scores(totals: DataFrame) -> DataFrame:
    """Adds maintainability, technical_debt, architecture_health, security_risk, project_score, grade.

    Inputs: code, comment, functions, long_functions, duplicate_ratio, unused_imports,
    huge_files, max_fan_in, average_lines, high, medium, low; and high_complexity,
    average_complexity, cycles, which may be null.
    """
    c = F.col
    long_share, duplicate = _ratio("long_functions", "functions"), c("duplicate_ratio")
    unused = c("unused_imports") / F.greatest(c("code") / 1000, F.lit(1.0))
    complex_share = F.when(c("functions") > 0, c("high_complexity") / c("functions"))
    out = totals.select(
        *totals.columns,
        _score(
            clamp(180 * long_share, 0, 34), clamp((c("average_lines") - 180) / 8, 0, 22), clamp(c("huge_files") * 2.2, 0, 18),
            F.when(_ratio("comment", "code") < 0.04, 8.0), clamp(60 * duplicate, 0, 18),
            F.when(complex_share.isNotNull(), clamp(140 * complex_share, 0, 20)),
            F.when(c("average_complexity") > 6, clamp(3 * (c("average_complexity") - 6), 0, 12)),
        ).alias("maintainability"),
        _score(
            clamp(220 * duplicate, 0, 40), clamp(160 * long_share, 0, 30), clamp(6 * unused, 0, 16), clamp(c("huge_files") * 1.5, 0, 14),
            F.when(complex_share.isNotNull(), clamp(120 * complex_share, 0, 18)),
        ).alias("technical_debt"),
        _score(
            clamp((c("max_fan_in") - 8) * 2.2, 0, 34), clamp(c("huge_files") * 2.5, 0, 24), clamp((c("average_lines") - 160) / 10, 0, 16),
            clamp(50 * duplicate, 0, 14), F.when(c("cycles").isNotNull(), clamp(4 * c("cycles"), 0, 20)),
        ).alias("architecture_health"),
        _score((28 * c("high") + 10 * c("medium") + 3 * c("low")).cast("double")).alias("security_risk"),
    )
    whole = 0.28 * c("maintainability") + 0.26 * c("technical_debt") + 0.24 * c("architecture_health") + 0.22 * c("security_risk")
    return out.withColumn("project_score", js_round(F.round(whole, 9)).cast("int")).withColumn("grade", grade(c("project_score")))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 55, "D").otherwise("F")


# What a grade is called.
VERDICTS = {"A": "Clean Scene", "B": "Minor Offenses", "C": "Persons of Interest", "D": "Active Crime Scene", "F": "Homicide"}


def verdict(grade_: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in VERDICTS.items() for x in pair))[grade_]


def level(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "warn").otherwise("bad")


def complexity_badge(cc: Column) -> Column:
    return F.when(cc >= 20, "high").when(cc >= 14, "medium").otherwise("low")


def share_level(share: Column) -> Column:
    return F.when(share >= 0.8, "bad").when(share >= 0.6, "warn")
