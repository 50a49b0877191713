"""The whole analysis of a table of files, of any number of projects."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..operators import duplication, evidence, files, functions, git, graph, imports, secrets
from ..scratch import stored
from . import findings as f
from .scoring import scores


def forensics(log: DataFrame, table: DataFrame, now: int) -> dict[str, DataFrame]:
    """Tables git_*: what logs (project, line_no, value) tell of the paths (project, path) that exist; ``now`` in unix seconds."""
    parsed = stored(git.parsed_log(log), "parsed-log")
    commits, changes = git.commits_of(parsed), stored(git.changes_of(parsed, table), "changes")
    return {
        "git_status": git.status(commits, table.select("project").distinct(), log), "git_totals": git.totals(commits), "git_files": git.top_files(git.file_stats(changes, commits, now)),
        "git_hotspots": git.hotspots(changes), "git_cochanges": git.cochanges(changes), "git_bus_factor": git.bus_factor(changes, commits),
    }


def analyse(table: DataFrame, log: DataFrame | None = None, now: int | None = None, inventory: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables by name: files, totals (with scores), languages, functions, blocks, unused, secrets, cycles, findings, brief and others.

    With version-control logs also those of ``forensics``, over the paths of ``inventory``: all that exists, as ``TreeListing``
    reads it, be it of a known language or not. Without it the table's own paths count. Files are read three times at most: for their lines, for what they do and for
    their functions; what is used again is stored in the shared folder.
    """
    counted = files.with_line_counts(table)
    found = stored(functions.functions(table), "functions")
    longest = functions.longest_of_file(found)
    kinds = evidence.classified(table, longest).select("project", "path", "runtime", "file_type", "responsibilities", "symbol", "symbol_line")
    items = stored(imports.imports(table), "imports")
    edges = stored(imports.resolved_imports(items, table), "edges")
    rows = counted.join(kinds, ["project", "path"]).join(longest, ["project", "path"], "left").join(imports.fan_in(edges, table), ["project", "path"], "left")
    info = rows.select(
        "project", "path", "ext", "language", "size_bytes", "noise_reason", "lines", "blank", "comment", "code", "runtime", "file_type", "responsibilities",
        *(F.coalesce(n, F.lit(0)).cast("int").alias(n) for n in ("functions", "long_functions", "max_complexity", "longest", "longest_line", "fan_in")),
        F.coalesce("longest_name", F.lit("")).alias("longest_name"), "symbol", "symbol_line",
    )
    info = stored(info, "files")

    normal = stored(duplication.normal_lines(table), "normal-lines")
    again = stored(duplication.repeated(duplication.windows(normal), normal), "repeated")
    blocks = stored(duplication.blocks(again, lines=normal), "blocks")
    unused = stored(imports.unused_imports(table), "unused")
    leaks = stored(secrets.secrets(table), "secrets")
    cycles = stored(graph.cycle_report(graph.cycles_of(edges)), "cycles")
    base = files.project_totals(info)
    reach = info.where("noise_reason is null and file_type <> 'types'").groupBy("project").agg(F.max("fan_in").alias("max_fan_in"))
    parts = [
        functions.function_totals(found), duplication.duplicate_ratio(again, base.select("project", "code")).withColumnRenamed("ratio", "duplicate_ratio"),
        unused.groupBy("project").agg(F.count("*").alias("unused_imports")), secrets.severity_counts(leaks), reach,
        cycles.groupBy("project").agg(F.max("cycles").alias("cycles")),
    ]
    for part in parts:
        base = base.join(part, "project", "left")
    totals = stored(scores(base.fillna(0)), "totals")
    ignored = files.top_of_project(info.where("noise_reason is not null"), rules.TOP["ignored"], F.col("lines").desc(), F.col("path"))
    streams = [f.file_findings(info), f.security_findings(secrets.top_secrets(leaks)), f.duplication_findings(blocks), f.unused_findings(unused)]
    largest = files.top_of_project(info.where("noise_reason is null"), rules.TOP["largest"], F.col("lines").desc(), F.col("path"))
    all_files = files.top_of_project(info.where("noise_reason is null"), rules.TOP["all_files"], F.col("lines").desc(), F.col("path"))
    commands = stored(imports.verify_commands(table), "commands")
    all_ = stored(f.findings(streams, f.noise_findings(ignored), commands), "findings")
    return {
        "files": info, "totals": totals, "languages": files.language_stats(info), "functions": found, "long_functions": functions.long_functions(found),
        "complex_functions": functions.complex_functions(found), "imports": items, "edges": edges, "top_imported": imports.top_imported(edges), "blocks": blocks,
        "largest": largest, "all_files": all_files, "dependencies": imports.listed(edges), "unused_listed": imports.top_unused(unused), "secrets_listed": secrets.top_secrets(leaks),
        "unused": unused, "secrets": leaks, "cycles": cycles, "ignored": ignored, "findings": all_, "brief": f.brief(all_), "commands": commands,
        **({} if log is None else forensics(log, table if inventory is None else inventory, int(time.time()) if now is None else now)),
    }
