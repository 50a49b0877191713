"""Imports: names, unused ones, the files they resolve to, and the graph of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as t
from ..functions.views import imports_of, unused_of
from .files import list_of_project, top_of_project


def imports(files: DataFrame) -> DataFrame:
    """(project, path, language, ord, names, source, line, relative) of files that are not noise."""
    found = files.where("noise_reason is null").select("project", "path", "language", imports_of("content", "language").alias("found"))
    return found.select("project", "path", "language", F.inline("found"))


def unused_imports(files: DataFrame) -> DataFrame:
    """Imported names that occur once at most in the raw text; Lua has none."""
    able = files.where(F.col("noise_reason").isNull() & F.col("language").isin(*rules.JS, "Python"))
    rows = able.select("project", "path", unused_of("content", "language").alias("found"))
    return rows.select("project", "path", F.inline("found")).select("project", "path", "ord", "pos", "name", "source", "line")


def joined_path(path: Column, source: Column) -> Column:
    """The source seen from the file's directory, ``.`` and ``..`` resolved."""
    start = F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/")
    start = F.filter(start, lambda x: x != "")
    step = lambda acc, x: (
        F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))
    )
    folded = F.array_join(F.aggregate(F.split(source, "/"), start, step), "/")
    # A file beside this one, as most are, needs no folding.
    name = F.substr(source, F.lit(3))
    beside = F.startswith(source, F.lit("./")) & ~F.contains(name, F.lit("/")) & ~name.isin("", ".", "..") & ~F.contains(path, F.lit("//")) & ~F.startswith(path, F.lit("/"))
    return F.when(beside, F.concat(F.substr(path, F.lit(1), F.length(path) - F.length(t.base_name(path))), name)).otherwise(folded)


# What is tried after the path, in order.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".vue", ".svelte", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
LUA_ENDINGS = [".lua", "/init.lua"]


def stem_index(paths: DataFrame) -> DataFrame:
    """(project, lua, stem, dst): for every stem that an import can name the file it stands for, of those the ending tried first.

    A file is its stem and an ending, so only the least ending's number is kept for a stem: numbers are aggregated by hash, texts would be sorted.
    """

    def stems(endings: list[str], lua: bool) -> list[Column]:
        return [
            F.when(F.endswith("path", F.lit(e)), F.struct(F.lit(lua).alias("lua"), F.lit(n).alias("nth"), F.substr("path", F.lit(1), F.length("path") - len(e)).alias("stem")))
            for n, e in enumerate(endings)
        ]

    ending = F.when(F.col("lua"), F.get(F.lit(LUA_ENDINGS), F.col("nth"))).otherwise(F.get(F.lit(ENDINGS), F.col("nth")))

    each = F.array_compact(F.array(*stems(ENDINGS, False), *stems(LUA_ENDINGS, True)))
    rows = paths.select("project", "path", F.inline(each))
    first = rows.groupBy("project", "lua", "stem").agg(F.min("nth").alias("nth"))
    return first.select("project", "lua", "stem", F.concat("stem", ending).alias("dst"))


def resolved_imports(found: DataFrame, paths: DataFrame) -> DataFrame:
    """(project, src, ord, dst) of relative imports: the first candidate that is a file of the project.

    Files are indexed by their stems once, so an import is one row with one key.
    """
    lua = F.col("language") == "Lua"
    base = F.when(lua, F.replace("source", F.lit("."), F.lit("/"))).otherwise(joined_path(F.col("path"), F.col("source")))
    able = found.where("relative and path is not null and source is not null")
    rows = able.select("project", F.col("path").alias("src"), "ord", lua.alias("lua"), F.coalesce(base, F.lit("")).alias("stem"))  # never null: the join does not ask for it once more
    return rows.join(stem_index(paths), ["project", "lua", "stem"]).select("project", "src", "ord", "dst")


def fan_in(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """How many imports name each file; each import counts."""
    n = edges.groupBy("project", F.col("dst").alias("path")).agg(F.count("*").alias("n"))
    return paths.select("project", "path").join(n, ["project", "path"], "left").select("project", "path", F.coalesce("n", F.lit(0)).alias("fan_in"))


def top_unused(unused: DataFrame, n: int = rules.TOP["unused"]) -> DataFrame:
    """The first unused names of each project."""
    return list_of_project(unused, n, F.col("path"), F.col("ord"), F.col("pos"))


def listed(edges: DataFrame, n: int = rules.TOP["dependencies"]) -> DataFrame:
    """The first dependencies of each project."""
    return list_of_project(edges, n, F.col("src"), F.col("ord"), F.col("dst"))


def top_imported(edges: DataFrame, n: int = rules.TOP["imported"], first: int = rules.TOP["dependencies"]) -> DataFrame:
    """The files that most of the first imports of a project name."""
    counts = top_of_project(edges, first, F.col("src"), F.col("ord"), F.col("dst")).groupBy("project", F.col("dst").alias("path")).agg(F.count("*").alias("fan_in"))
    return top_of_project(counts, n, F.col("fan_in").desc(), F.col("path"))


def verify_commands(files: DataFrame) -> DataFrame:
    """(project, commands): by the scripts of the package file nearest to the root."""
    packages = files.where(F.rlike("path", F.lit(r"(^|/)package\.json$")))
    depth = F.struct(F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))), F.col("path"))
    nearest = packages.groupBy("project").agg(F.min_by("content", depth).alias("content"))
    names = F.coalesce(F.json_object_keys(F.get_json_object("content", "$.scripts")), F.array().cast("array<string>"))
    has = lambda n: F.array_contains(names, n)
    run = lambda n: F.lit(f"npm run {n}")
    check = F.when(has("typecheck"), run("typecheck")).when(has("type-check"), run("type-check")).when(has("tsc"), run("tsc"))
    main = F.array_compact(F.array(check, F.when(has("build"), run("build"))))
    rest = F.array_compact(F.array(F.when(has("lint"), run("lint")), F.when(has("test"), run("test"))))
    commands = F.when(F.size(main) > 0, main).when(F.size(rest) > 0, rest).otherwise(F.array(run("build")))
    projects = files.select("project").distinct()
    return projects.join(nearest.select("project", commands.alias("c")), "project", "left").select("project", F.coalesce("c", F.array(run("build"))).alias("commands"))
