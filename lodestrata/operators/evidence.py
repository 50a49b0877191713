"""What files do: responsibilities, where they run, what kind of file they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as t
from ..functions.tokens import ROLES, tokens_of

NONE = "array<struct<kind:string,evidence:string,label:string,token:string,line:int,snippet:string>>"


def _between(low: int, high: int):
    return lambda r: r["role"].between(low, high)


def responsibilities(found: Column, language: Column) -> Column:
    """For each kind in order the first token of its strongest tier that is found, with line and snippet.

    ``found`` holds (role, line, snippet) of the tokens found; roles are numbered in the
    order of kinds, tiers and tokens, so a kind's lowest role is the one that counts.
    """
    names = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(e).alias("evidence"), F.lit(label).alias("label"), F.lit(token).alias("token")) for k, e, label, token in ROLES))
    first = {}
    for n, (kind, *_) in enumerate(ROLES):
        first.setdefault(kind, [n, n])[1] = n
    own = []
    for kind, (low, high) in first.items():
        hit = F.array_min(F.filter(found, _between(low, high)))
        own.append(hit if kind.startswith("fivem_") else F.when(language.isin(rules.JS), hit))

    def out(r: Column) -> Column:
        role = F.get(names, r["role"])
        return F.struct(*(role[c].alias(c) for c in ("kind", "evidence", "label", "token")), r["line"].alias("line"), r["snippet"].alias("snippet"))

    return F.transform(F.array_compact(F.array(*own)), out)


def runtime(path: Column, language: Column, told: Column) -> Column:
    """server, client or shared; ``told`` are the groups of runtime tokens in the text without comments."""
    lower = t.ascii_lower(path)
    has = lambda group: F.array_contains(told, group)
    server_path = t.any_of(lower, rules.SERVER_PATHS) | F.startswith(lower, F.lit(rules.SERVER_PATH_START))
    react = has("react")
    script = (
        F.when(server_path | (has("node") & ~react), "server")
        .when(t.any_of(lower, rules.CLIENT_PATHS) | react, "client")
        .otherwise("shared")
    )
    lua = (
        F.when(t.base_name(lower).isin(rules.LUA_MANIFESTS), "shared")
        .when(F.contains(lower, F.lit("client")), "client")
        .when(F.contains(lower, F.lit("server")), "server")
        .when(F.contains(lower, F.lit("shared")), "shared")
        .when(has("lua_server"), "server")
        .when(has("lua_client"), "client")
        .otherwise("shared")
    )
    return F.when(language.isin(rules.JS), script).when(language == "Lua", lua).otherwise("shared")


def file_type(path: Column, language: Column, ext: Column, where: Column, resp: Column, content: Column, told: Column) -> Column:
    """Kind of file, by name, then by what it does."""
    name = t.ascii_lower(t.base_name(path))
    stem = t.stem(path)
    low_stem = t.ascii_lower(stem)
    has = lambda kind: F.exists(resp, lambda r: r["kind"] == kind)
    direct = F.size(F.filter(resp, lambda r: r["evidence"] == "direct"))
    config = F.contains(name, F.lit(".config."))
    svg = F.regexp_count(content, F.lit("<svg|<path"))
    script = (
        F.when(F.rlike(name, F.lit(r"\.d\.ts$|^types\.ts$|\.types\.ts$")), "types")
        .when(config, "config")
        .when(F.rlike(stem, F.lit("^use[A-Z]")), "react_hook")
        .when((where == "server") & has("http_server") & low_stem.isin("index", "server", "app", "main"), "node_server")
        .when((where == "server") & has("routes"), "route_handler")
        .when((where == "server") & has("http_server"), "node_server")
        .when((where == "server") & (direct >= 2), "node_service")
        .when(~ext.isin("tsx", "jsx"), "utility")
        .when(t.any_of(name, rules.DIALOG_NAMES), "react_dialog")
        .when(F.contains(name, F.lit("icon")), "react_icon")
        .when(low_stem.isin("app", "root", "main"), "react_root")
        .when((svg >= 6) & F.contains(content, F.lit("switch")) & (F.size(resp) == 0), "react_icon")
        .when(has("admin") | has("data_fetching") | has("state_machine"), "react_feature")
        .otherwise("react_component")
    )
    fivem = F.exists(resp, lambda r: F.startswith(r["kind"], F.lit("fivem_"))) | F.arrays_overlap(told, F.array(F.lit("lua_server"), F.lit("lua_client")))
    lua = (
        F.when(name.isin(rules.LUA_MANIFESTS), "fivem_manifest")
        .when(fivem & where.isin("client", "server"), F.concat(F.lit("fivem_"), where, F.lit("_script")))
        .when(fivem, "fivem_shared_script")
        .otherwise("lua_module")
    )
    return F.when(language.isin("TypeScript", "JavaScript"), script).when(language == "Lua", lua).when(config, "config").otherwise("other")


def primary_symbol(path: Column, longest_name: Column) -> Column:
    """The file's stem if it names a hook or a component, else its longest function, else the stem."""
    stem = t.stem(path)
    return F.when(F.rlike(stem, F.lit("^(use)?[A-Z]")) | (F.coalesce(longest_name, F.lit("")) == ""), stem).otherwise(longest_name)


def declaration_line(content: Column, name: Column) -> Column:
    """1-based line of the first of ``function``, ``const``, ``let``, ``var``, ``class`` with the name; 0 if none."""
    places = [F.regexp_instr(content, F.concat(F.lit(f"{t.NOT_BEFORE}{word} \\Q"), name, F.lit("\\E" + t.NOT_AFTER))) for word in ("function", "const", "let", "var", "class")]
    at = F.coalesce(*(F.nullif(p, F.lit(0)) for p in places), F.lit(0))
    # A text without the name meets no pattern; each would be compiled for its row.
    at = F.when(F.contains(content, F.concat(F.lit(" "), name)) & (name != ""), at).otherwise(0)
    line = F.transform(F.array(at), lambda p: F.when(p > 0, t.line_of(content, p)).otherwise(0))  # so that the place is looked for once
    return F.get(line, F.lit(0)).cast("int")


def classified(files: DataFrame, longest: DataFrame | None = None) -> DataFrame:
    """Files with runtime, file_type and responsibilities; noise is shared, of the type of its reason, and does nothing.

    With ``longest`` (project, path, longest_name, longest_line), or files that have
    these columns already, also symbol and symbol_line: where the text without comments declares the symbol, else the line of
    the longest function, 0 if there is none.
    """
    if longest is not None:
        files = files.join(longest.select("project", "path", "longest_name", "longest_line"), ["project", "path"], "left")
    named = "longest_name" in files.columns
    own = F.col("noise_reason").isNull()
    seen = files.withColumn("v", tokens_of("content", "language"))
    seen = seen.withColumn("responsibilities", F.when(own, responsibilities(F.col("v.roles"), F.col("language"))).otherwise(F.array().cast(NONE)))
    seen = seen.withColumn("runtime", F.when(own, runtime(F.col("path"), F.col("language"), F.col("v.runtimes"))).otherwise("shared"))
    kind = file_type(F.col("path"), F.col("language"), F.col("ext"), F.col("runtime"), F.col("responsibilities"), F.col("v.code"), F.col("v.runtimes"))
    seen = seen.withColumn("file_type", F.when(own, kind).otherwise(F.col("noise_reason")))
    if named:
        seen = seen.withColumn("symbol", primary_symbol(F.col("path"), F.col("longest_name")))
        declared = F.nullif(declaration_line(F.col("v.code"), F.col("symbol")), F.lit(0))
        seen = seen.withColumn("symbol_line", F.coalesce(declared, "longest_line", F.lit(0)).cast("int")).drop("longest_name", "longest_line")
    return seen.drop("v")
