"""Saved reports, projects and settings as tables that are rewritten by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules


def upserted(table: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The table with the rows of ``new`` in place of those with the same keys."""
    return table.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def opened_projects(projects: DataFrame, opened: DataFrame) -> DataFrame:
    """Projects (path, name, last_opened, created_at) after some were opened (path, name, at): known ones keep their creation."""
    last = opened.groupBy("path").agg(F.max_by("name", "at").alias("new_name"), F.max("at").alias("at"), F.min("at").alias("first"))
    return projects.join(last, "path", "full").select(
        "path", F.coalesce("new_name", "name").alias("name"), F.coalesce("at", "last_opened").alias("last_opened"), F.coalesce("created_at", "first").alias("created_at")
    )


def project_list(projects: DataFrame, reports: DataFrame) -> DataFrame:
    """Projects with the number of their reports, last opened first if that is known."""
    counts = reports.groupBy(F.col("project_path").alias("path")).agg(F.count("*").alias("n"))
    rows = projects.join(counts, "path", "left").select(*projects.columns, F.coalesce("n", F.lit(0)).alias("report_count"))
    return rows.orderBy(F.col("last_opened").desc(), "path") if "last_opened" in projects.columns else rows


def saved_report(reports: DataFrame, new: DataFrame) -> DataFrame:
    """The reports with new ones, whose ids are the next by their time."""
    last = reports.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    nth = F.row_number().over(W.orderBy("created_at", "project_path"))  # of the few that are saved at once
    return reports.unionByName(new.crossJoin(F.broadcast(last)).withColumn("id", F.col("last") + nth).select(*reports.columns))  # ``last`` is one row


def report_list(reports: DataFrame, n: int = rules.TOP["reports"], project: str | None = None) -> DataFrame:
    """The newest reports, of one project or all."""
    rows = reports if project is None else reports.where(F.col("project_path") == project)
    return rows.select("id", "project_path", "created_at", "overall_score", "grade", F.col("ai_json").isNotNull().alias("has_ai")).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def with_ai(reports: DataFrame, texts: DataFrame) -> DataFrame:
    """Reports with the texts (id, ai_json) put in."""
    new = texts.select("id", F.col("ai_json").alias("new"))
    columns = [F.coalesce("new", "ai_json").alias("ai_json") if c == "ai_json" else F.col(c) for c in reports.columns]
    return reports.join(new, "id", "left").select(*columns)


def deleted(reports: DataFrame, ids: DataFrame) -> DataFrame:
    return reports.join(ids.select("id"), "id", "left_anti")


def trends(reports: DataFrame, *scores: str) -> DataFrame:
    """Each report's scores less those of the report before it in its project; null for the first."""
    before = W.partitionBy("project_path").orderBy("created_at", "id")
    delta = lambda s: (F.col(s) - F.lag(s).over(before)).alias(f"{s}_delta")
    return reports.select("id", "project_path", "created_at", *scores, *map(delta, scores))


def parsed_scores(scores_json: Column) -> Column:
    """Saved scores; those that an older report lacks are null."""
    return F.from_json(scores_json, "projectScore int, technicalDebt int, architectureHealth int, securityRisk int, maintainability int")


def as_document(row: Column) -> Column:
    """A nested row as JSON; its fields should be named as the reader wants them."""
    return F.to_json(row)
