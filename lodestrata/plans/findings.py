"""Findings: what to do about a project, by priority.

File rows have project, path, ext, language, lines, file_type, runtime,
responsibilities, fan_in, longest, longest_name, longest_line, long_functions,
symbol, symbol_line. All rules are chained columns; lists are arrays.
Texts are keys (``why.huge_file``) that a dictionary may put in words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as t
from ..operators.files import top_of_project
from .wording import message

c = F.col
RESP = "responsibilities"
STEP = "array<struct<path:string,note:string>>"


def threshold(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in rules.LINE_THRESHOLD.items() for x in pair))
    return F.coalesce(table[kind], F.lit(400))


def with_evidence(files: DataFrame) -> DataFrame:
    """Adds counts of what a file does: direct, indirect, weighty, heavy, io, state."""
    direct = F.filter(RESP, lambda r: r["evidence"] == "direct")
    weighty = F.filter(direct, lambda r: ~((r["kind"] == "timers") & r["label"].isin(rules.WEAK_TIMERS)))
    return files.select(
        *files.columns, F.size(direct).alias("direct"), F.size(F.filter(RESP, lambda r: r["evidence"] == "indirect")).alias("indirect"),
        F.size(weighty).alias("weighty"), F.size(F.filter(weighty, lambda r: r["kind"].isin(rules.HEAVY))).alias("heavy"),
        F.exists(weighty, lambda r: r["kind"].isin(*rules.HEAVY, "data_fetching")).alias("io"),
        F.exists(direct, lambda r: r["kind"] == "state_machine").alias("state"),
        F.exists(direct, lambda r: r["kind"].isin("websocket", "webrtc")).alias("protocol"), threshold(c("file_type")).alias("threshold"),
    )


def has(kind: str) -> Column:
    return F.exists(RESP, lambda r: r["kind"] == kind)


def is_candidate() -> Column:
    near = c("file_type").isin("react_root", "react_feature", "react_dialog", "react_icon") & (c("lines") > c("threshold") - 50)
    return (c("lines") > c("threshold")) | (c("direct") >= 2) | (c("longest") > 130) | near


def severity() -> Column:
    return c("lines") + 2 * c("longest") + 200 * c("direct") + 40 * c("indirect") + 10 * c("fan_in")


def kind_of() -> Column:
    """(kind, confidence, why, next)."""

    def row(kind, confidence, why, step="split"):
        confidence = F.lit(confidence) if isinstance(confidence, str) else confidence
        return F.struct(F.lit(kind).alias("kind"), confidence.alias("confidence"), F.lit(f"why.{why}").alias("why"), F.lit(f"next.{step}").alias("next"))

    if_more = lambda n, more: F.when(n, more).otherwise("medium")
    k = c("file_type")
    return (
        F.when(k == "node_server", row("god_server", if_more(c("direct") >= 2, "high"), "node_server"))
        .when(k == "node_service", row("service_module", if_more(c("weighty") >= 2, "high"), "service_module"))
        .when(k == "route_handler", row("route_handler", "high", "route_handler"))
        .when((k == "react_hook") & c("protocol"), row("god_hook", "high", "react_hook_direct"))
        .when(k == "react_hook", row("big_hook", if_more(c("direct") > 0, "high"), "react_hook_indirect"))
        .when(k == "react_root", row("root_coordinator", "medium", "react_root"))
        .when(k == "react_feature", row("feature_component", "high", "react_feature"))
        .when(k == "react_dialog", row("dialog", "high", "react_dialog"))
        .when(k == "react_icon", row("icon_file", "high", "icon", "icon"))
        .when(k == "react_component", row("long_component", "high", "long_component"))
        .when(c("longest") > 150, row("long_function", "high", "long_function", "extractFn"))
        .otherwise(row("huge_file", "high", "huge_file"))
    )


def blast_radius() -> Column:
    """How far a change reaches: by role, else by imports."""
    by = lambda n, high, medium: F.when(n >= high, "high").when(n >= medium, "medium").otherwise("low")
    k, n = c("file_type"), c("fan_in")
    return (
        F.when(k.isin("react_icon", "react_dialog"), F.when(n >= 12, "medium").otherwise("low"))
        .when((k == "node_server") & (c("heavy") >= 2), "high")
        .when(k == "node_service", F.when((c("weighty") >= 3) | (n >= 6), "high").when(c("weighty") >= 2, "medium").otherwise("low"))
        .when((k == "react_hook") & (c("heavy") > 0) & (c("state") | (c("heavy") >= 2)), "high")
        .when(k == "react_root", F.when(F.size(RESP) >= 3, "medium").otherwise("low"))
        .when(k == "react_feature", by(n, 8, 3))
        .otherwise(by(n, 10, 4))
    )


def risk_score() -> Column:
    """0 to 100; needs the column blast."""
    over = c("lines") - c("threshold")
    parts = [
        F.when(c("blast") == "high", 30.0).when(c("blast") == "medium", 17.0).otherwise(F.least(c("fan_in"), F.lit(6)) * 1.2),
        F.when(c("heavy") > 0, 26.0).when(c("io"), 12.0).otherwise(0.0),
        F.when(c("state"), 10.0).otherwise(0.0),
        t.clamp((c("longest") - 50) / 10, 0, 18),
        t.clamp(over / 20, 0, 20),
        F.least(c("weighty"), F.lit(4)) * 7.0,
        F.least(c("indirect"), F.lit(4)) * 4.0,
        F.when((c("heavy") > 0) & (over > 0), 8.0).otherwise(0.0),
        F.when(c("long_functions") >= 4, 5.0).otherwise(0.0),
    ]
    return t.js_round(t.clamp(reduce(Column.__add__, parts), 0, 100)).cast("int")


def band(score: Column) -> Column:
    return F.when(score >= 70, "P1").when(score >= 45, "P2").otherwise("P3")


def reconciled(score: Column, priority: Column) -> Column:
    """The score moved into the band of its priority."""
    return (
        F.when(priority == "P0", F.greatest(score, F.lit(85))).when(priority == "P1", F.greatest(score, F.lit(70)))
        .when(priority == "P2", F.greatest(F.lit(45), F.least(F.lit(69), score))).otherwise(F.least(score, F.lit(44)))
    )


def by_category(p: Column) -> Column:
    """Priority after the rules of the file's type: icons are of little weight, views without I/O and state are no
    P1, which is for servers and hooks with heavy I/O; large ones of some types are P2 at least."""
    k, heavy, big = c("file_type"), c("heavy") > 0, c("lines") > c("threshold")
    calm = F.when(k.isin("react_dialog", "react_root", "react_component") & ~heavy & ~c("state") & p.isin("P0", "P1"), "P2").otherwise(p)
    kept = F.when((calm == "P1") & ~(k.isin("node_server", "react_hook") & heavy), "P2").otherwise(calm)
    floor = (
        (k == "node_server")
        | ((k == "node_service") & (c("weighty") >= 2))
        | ((k == "react_root") & big & (F.size(RESP) >= 3))
        | ((k == "react_feature") & big)
        | ((k == "react_dialog") & big & (has("validation") | has("data_fetching")))
    )
    return F.when(k == "react_icon", F.when(c("lines") > 700, "P2").otherwise("P3")).otherwise(F.when((kept == "P3") & floor, "P2").otherwise(kept))


def _without_suffix(name: Column, suffixes: list[str]) -> Column:
    out = name
    for s in reversed(suffixes):
        out = F.when(F.endswith(name, F.lit(s)) & (F.length(name) > len(s) + 1), F.substr(name, F.lit(1), F.length(name) - len(s))).otherwise(out)
    return out


def feature_folder(base: Column) -> Column:
    return _without_suffix(F.lower(base), rules.FEATURE_SUFFIXES)


def hook_folder(base: Column) -> Column:
    own = F.lower(F.regexp_replace(base, "^use(?=[A-Z])", ""))
    return F.when(own == "", F.lower(base)).otherwise(_without_suffix(own, rules.HOOK_SUFFIXES))


def expanded(template: str) -> Column:
    """A path template with the file's directory and names put in."""
    folder, base = t.directory(c("path")), t.first_name(c("path"))
    out = F.lit(template)
    for mark, value in (
        ("{fdir}", F.concat(folder, F.lit("/"), feature_folder(base))), ("{hdir}", F.concat(folder, F.lit("/"), hook_folder(base))),
        ("{dir}", folder), ("{Base}", t.capitalized(base)), ("{base}", base),
    ):
        if mark in template:
            out = F.replace(out, F.lit(mark), value)
    return out


def _steps(table: dict, key: Column, row) -> Column:
    """At most six rows of the table that the file's responsibilities allow."""

    def of(rows):
        return F.array(*(row(r) if not r[-1] else F.when(reduce(Column.__or__, map(has, r[-1].split())), row(r)) for r in rows))

    out = of(table[""])
    for k, rows in table.items():
        if k:
            out = F.when(key == k, of(rows)).otherwise(out)
    return F.slice(F.array_compact(out), 1, 6)


def refactoring() -> Column:
    """Steps for script files; a client gets no module of a server."""
    server = lambda s: t.any_of(s["path"], rules.SERVER_MODULES)
    all_ = _steps(rules.REFACTOR, c("file_type"), lambda r: F.struct(expanded(r[0]).alias("path"), F.lit(f"rstep.{r[1]}").alias("note")))
    return (
        F.when(~c("ext").isin(rules.SCRIPT_EXTENSIONS), F.array().cast(STEP)).when(c("runtime") == "client", F.filter(all_, lambda s: ~server(s))).otherwise(all_)
    )


def pull_requests(kind: Column) -> Column:
    return _steps(rules.PULL_REQUESTS, kind, lambda r: F.lit(f"pr.{r[0]}"))


def evidence_lines() -> Column:
    head = F.array_compact(F.array(
        F.concat(c("lines").cast("string"), F.lit(" lines")),
        F.when((c("symbol_line") > 0) & (c("symbol") != ""), F.format_string("%s starts at %d", "symbol", "symbol_line")),
        F.when((c("longest") > 40) & (c("longest_name") != ""), F.concat(c("longest_name"), F.lit("()"), F.when(c("longest_line") > 0, F.concat(F.lit(":"), c("longest_line").cast("string"))).otherwise(""), F.lit(" · "), c("longest").cast("string"), F.lit(" lines"))),
    ))
    each = F.transform(RESP, lambda r: F.concat(
        F.lit("resp."), r["label"], F.lit(": ev."), r["evidence"], F.lit(" ("), r["token"], F.lit(")"),
        F.when(r["line"] > 0, F.concat(F.lit(":"), r["line"].cast("string"))).otherwise(""),
        F.when(r["snippet"] != "", F.concat(F.lit(" — `"), r["snippet"], F.lit("`"))).otherwise(""),
    ))
    return F.concat(head, each)


def said_lines() -> Column:
    """The same as messages, to be worded."""
    place = lambda line: F.when(line > 0, F.concat(F.lit(":"), line.cast("string"))).otherwise("")
    head = F.array_compact(F.array(
        message("ev.lines", lines=c("lines")),
        F.when((c("symbol_line") > 0) & (c("symbol") != ""), message("ev.startsAt", name=c("symbol"), n=c("symbol_line"))),
        F.when((c("longest") > 40) & (c("longest_name") != ""), message("ev.longest", name=c("longest_name"), place=place(c("longest_line")), len=c("longest"))),
    ))
    shown = lambda r: F.when(r["snippet"] != "", F.concat(F.lit(" — `"), r["snippet"], F.lit("`"))).otherwise("")
    each = F.transform(RESP, lambda r: message("ev.found", resp=F.concat(F.lit("resp."), r["label"]), how=F.concat(F.lit("ev."), r["evidence"]), token=r["token"], place=place(r["line"]), snippet=shown(r)))
    return F.concat(head, each)


def notes() -> Column:
    """What is inconsistent in a finding."""
    step_has = lambda p: F.exists("refactor", lambda s: F.rlike(s["path"], F.lit(p)))
    far = F.exists(RESP, lambda r: (r["evidence"] == "direct") & ((F.coalesce(r["token"], F.lit("")) == "") | (r["line"] > c("lines") + 1)))
    return F.array_compact(F.array(
        F.when(c("kind").isin("god_server", "route_handler") & (c("runtime") != "server"), "vrf.runtime"),
        F.when((c("kind") == "icon_file") & (c("file_type") != "react_icon"), "vrf.iconType"),
        F.when(far, "vrf.token"),
        F.when(c("symbol_line") > c("lines") + 1, "vrf.line"),
        F.when((c("runtime") == "client") & step_has("|".join(rules.SERVER_MODULES)), "vrf.clientServer"),
        F.when((c("kind") == "icon_file") & step_has(r"(^|/)use[A-Z][A-Za-z0-9]*\.ts$"), "vrf.iconHook"),
    ))


COLUMNS = (
    "project emit id priority confidence category kind file line symbol runtime evidence why next refactor score blast direct_io state_machine prs notes said".split()
)


def file_findings(files: DataFrame) -> DataFrame:
    """Findings of the gravest candidates among the largest files of each project."""
    rows = top_of_project(files.where("noise_reason is null"), rules.TOP["all_files"], c("lines").desc(), c("path")).drop("rank")
    rows = top_of_project(with_evidence(rows).where(is_candidate()), rules.TOP["candidates"], severity().desc(), c("lines").desc(), c("path"))
    rows = rows.withColumn("k", kind_of()).withColumn("kind", c("k.kind")).withColumn("blast", blast_radius())
    claims = c("kind").isin("god_server", "god_hook", "feature_component", "route_handler") & (c("weighty") == 0)
    rows = rows.withColumn("confidence", F.when(claims, "medium").otherwise(c("k.confidence"))).withColumn("raw", risk_score())
    rows = rows.withColumn("first", by_category(band(c("raw")))).withColumn("score", reconciled(c("raw"), c("first")))
    rows = rows.withColumn("refactor", refactoring()).withColumn("prs", pull_requests(c("kind"))).withColumn("notes", notes())
    doubt = F.size("notes") > 0
    return rows.select(
        "project", F.struct(F.lit(0).alias("group"), c("rank").alias("n")).alias("emit"), F.concat_ws(":", "kind", "path").alias("id"),
        F.when(doubt & c("first").isin("P0", "P1"), "P2").otherwise(c("first")).alias("priority"), F.when(doubt, "low").otherwise(c("confidence")).alias("confidence"),
        F.when(doubt, "needs-verification").when(c("score") < rules.SCORE_FLOOR, "informational").otherwise("actionable").alias("category"),
        "kind", F.when(c("symbol_line") > 0, F.concat_ws(":", "path", c("symbol_line").cast("string"))).otherwise(c("path")).alias("file"),
        c("symbol_line").cast("int").alias("line"), "symbol", "runtime", evidence_lines().alias("evidence"), c("k.why").alias("why"), c("k.next").alias("next"),
        "refactor", "score", "blast", c("io").alias("direct_io"), c("state").alias("state_machine"), "prs", "notes", said_lines().alias("said"),
    )


def _plain(rows: DataFrame, group: int, n: Column, **values) -> DataFrame:
    """Findings of other streams; what is not given has its usual value."""
    usual = {
        "priority": "P3", "confidence": "high", "category": "actionable", "line": F.lit(0), "symbol": "", "runtime": "shared", "why": "", "next": "",
        "refactor": F.array().cast(STEP), "score": F.lit(0), "blast": "low", "direct_io": F.lit(False), "state_machine": F.lit(False),
        "prs": F.array().cast("array<string>"), "notes": F.array().cast("array<string>"),
    } | values
    usual["emit"] = F.struct(F.lit(group).alias("group"), n.cast("int").alias("n"))
    usual["project"] = c("project")
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    cast = lambda k, v: v.cast("int") if k in ("line", "score") else v
    return rows.select(*(cast(k, as_column(usual[k])).alias(k) for k in COLUMNS))


def security_findings(ranked: DataFrame) -> DataFrame:
    """Of the ranked secrets of each project."""
    s = c("severity")
    by = lambda high, medium, low: F.when(s == "high", high).when(s == "medium", medium).otherwise(low)
    place = F.concat_ws(":", "path", c("line").cast("string"))
    return _plain(
        ranked.where(c("rank") <= rules.TOP["security_findings"]), 1, c("rank"), id=F.concat(F.lit("security:"), place), kind="security", file=place, line=c("line"),
        priority=by("P0", "P1", "P2"), score=by(90, 60, 40), evidence=F.array("kind", "snippet"), why="why.security", next="next.rotate",
        said=F.array(message("ev.secret", kind=c("kind"), snippet=c("snippet"))),
    )


def duplication_findings(ranked: DataFrame) -> DataFrame:
    """One for each set of files among the ranked blocks."""
    key = F.array_join(F.array_sort("files"), "|")
    first = ranked.withColumn("same", F.row_number().over(W.partitionBy("project", key).orderBy("rank"))).where("same = 1").drop("same")
    first = top_of_project(first.withColumnRenamed("rank", "at"), rules.TOP["dup_findings"], c("at"))
    return _plain(
        first, 2, c("rank"), id=F.concat(F.lit("dup:"), c("fingerprint")), kind="duplication", priority="P2", score=F.lit(50), file=F.get("files", F.lit(0)),
        blast=F.when(F.size("files") >= 3, "medium").otherwise("low"), why="why.duplication", next="next.dedupe",
        evidence=F.array(F.format_string("%d× · %d lines", "occurrences", "line_count"), F.array_join("files", ", ")),
        said=F.array(message("ev.copies", n=c("occurrences"), lines=c("line_count")), message("ev.files", files=F.array_join("files", ", "))),
    )


def unused_findings(unused: DataFrame) -> DataFrame:
    """One for each project with unused imports."""
    rows = unused.groupBy("project").agg(F.count("*").alias("n"), F.min(F.struct("path", "ord", "pos", "line")).alias("first"))
    return _plain(
        rows, 3, F.lit(1), id="unused:all", kind="unused", score=F.lit(20), file=c("first.path"), line=c("first.line"), evidence=F.array(F.format_string("%d unused imports", "n")),
        why="why.unused", next="next.lint", said=F.array(message("ev.unused", n=c("n"))),
    )


def noise_findings(ignored: DataFrame) -> DataFrame:
    """Of the largest ignored files."""
    return _plain(
        ignored, 4, c("rank"), id=F.concat(F.lit("noise:"), c("path")), kind="noise", category="noise", file=c("path"), why="find.noiseNote",
        evidence=F.array(F.concat(c("lines").cast("string"), F.lit(" lines")), F.coalesce("noise_reason", F.lit("noise"))),
        said=F.array(message("ev.lines", lines=c("lines")), message("ev.reason", reason=F.coalesce("noise_reason", F.lit("noise")))),
    )


def capped(rows: DataFrame) -> DataFrame:
    """P1 only with high confidence, and not for more than three tenths of what is actionable (two at least); security apart."""
    other = c("kind") != "security"
    sure = rows.withColumn("priority", F.when((c("priority") == "P1") & (c("confidence") != "high") & other, "P2").otherwise(c("priority")))
    able = (c("category") == "actionable") & (c("priority") == "P1") & other
    sure = sure.withColumn("able", able).withColumn("all", F.count_if(c("category") == "actionable").over(W.partitionBy("project")))
    nth = F.row_number().over(W.partitionBy("project", "able").orderBy("emit"))
    allowed = F.greatest(F.lit(2), F.ceil(c("all") * 0.3))
    return sure.withColumn("nth", nth).withColumn("priority", F.when(c("able") & (c("nth") > allowed), "P2").otherwise(c("priority"))).drop("able", "all", "nth")


def gated(rows: DataFrame) -> DataFrame:
    """Repairs of actionable findings in order; adds what was violated."""
    rows = rows.withColumn("violations", F.array().cast("array<string>"))

    # A finding that is no longer actionable after the first repair still goes through the others.
    rows = rows.withColumn("gate", c("category") == "actionable")

    def repair(rows: DataFrame, name: str, broken: Column, told: tuple[str, ...] = ("file",), **fix) -> DataFrame:
        rows = rows.withColumn("bad", F.coalesce(c("gate") & broken, F.lit(False)))
        what = F.concat_ws(":", F.lit(name), *(c(x).cast("string") for x in told))
        rows = rows.withColumn("violations", F.when(c("bad"), F.array_append("violations", what)).otherwise(c("violations")))
        for k, v in fix.items():
            rows = rows.withColumn(k, F.when(c("bad"), v).otherwise(c(k)))
        return rows.drop("bad")

    structural = c("kind").isin("security", "duplication", "unused", "noise")
    server = lambda s: t.any_of(s["path"], rules.SERVER_MODULES)
    hook = lambda s: F.rlike(s["path"], F.lit("/use[A-Z]"))
    rows = repair(rows, "below-floor", ~structural & (c("score") < rules.SCORE_FLOOR), ("kind", "file", "score"), category=F.lit("informational"))
    entry = c("kind").isin("god_server", "god_hook")
    rows = repair(rows, "p1-low-blast", (c("priority") == "P1") & entry & (c("blast") == "low"), ("kind", "file"), blast=F.lit("high"))
    claims = c("kind").isin("god_server", "feature_component")
    rows = repair(rows, "weak-high-conf", claims & (c("confidence") == "high") & ~c("direct_io"), ("kind", "file"), confidence=F.lit("medium"))
    rows = repair(rows, "client-server-suggestion", (c("runtime") == "client") & F.exists("refactor", server), refactor=F.filter("refactor", lambda s: ~server(s)))
    rows = repair(rows, "icon-hook", (c("kind") == "icon_file") & F.exists("refactor", hook), refactor=F.filter("refactor", lambda s: ~hook(s)))
    rows = repair(rows, "large-file-priority", (c("kind") == "huge_file") & c("priority").isin("P1", "P2"), priority=F.lit("P3"), score=F.least(c("score"), F.lit(44)))
    unchecked = (F.size("prs") > 0) & ~F.exists("prs", lambda p: F.rlike(p, F.lit(r"(?i)npm run|tsc\b|pnpm|yarn")))
    return repair(rows, "pr-no-verify", unchecked).drop("gate")


def findings(streams: list[DataFrame], noise: DataFrame, commands: DataFrame) -> DataFrame:
    """All streams by priority, noise last; ``rank`` is the place within a project."""
    rows = reduce(DataFrame.unionByName, streams).join(commands, "project", "left")
    check = F.concat(F.lit("pr.verify: "), F.array_join("commands", " && "))
    rows = rows.withColumn("prs", F.when((F.size("prs") > 0) & (F.size("commands") > 0), F.array_append("prs", check)).otherwise(c("prs"))).drop("commands")
    rows = gated(capped(rows)).unionByName(noise.withColumn("violations", F.array().cast("array<string>")))
    place = W.partitionBy("project").orderBy((c("kind") == "noise").cast("int"), "priority", "emit")
    return rows.withColumn("rank", F.row_number().over(place))


def brief(rows: DataFrame) -> DataFrame:
    """(project, primary, inspect, doubtful, ignored, prs, warnings).

    Findings come from lists of fixed lengths, so those of a project are bounded.
    """
    actionable = c("category") == "actionable"
    doubt = (c("category") == "needs-verification") | (actionable & (c("confidence") != "high"))
    ordered = lambda keep, value, n: F.slice(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(c("rank"), value.alias("v"))))), lambda x: x["v"]), 1, n)
    plain = F.substring_index("file", ":", 1)
    out = rows.groupBy("project").agg(
        ordered(actionable, F.struct("file", c("kind").alias("reason"), "priority", "confidence"), rules.TOP["brief"]).alias("inspect"),
        ordered(doubt, F.struct(plain.alias("file"), F.coalesce(F.get("notes", F.lit(0)), F.concat(F.lit("brief.fpWhy:"), c("kind"))).alias("why")), rules.TOP["doubtful"]).alias("doubtful"),
        ordered(c("kind") == "noise", F.concat(c("file"), F.lit(" ("), F.get("evidence", F.lit(1)), F.lit(")")), 1000).alias("ignored"),
        ordered(actionable & (F.size("refactor") > 0), F.struct(F.concat(c("kind"), F.lit(" — "), plain).alias("scope"), F.transform("refactor", lambda s: s["path"]).alias("files"), "why"), 2).alias("prs"),
        F.array_compact(F.array(
            F.when(F.bool_or(actionable & (c("confidence") != "high")), "qw.heuristic"), F.when(F.bool_or(actionable & (F.size("refactor") > 0)), "qw.template"),
            F.when(F.bool_or(c("category") == "needs-verification"), "qw.needsVerify"),
        )).alias("warnings"),
    )
    first = F.get("inspect", F.lit(0))
    return out.withColumn("primary", F.when(first.isNull(), "find.none").otherwise(F.concat_ws(" — ", first["reason"], F.substring_index(first["file"], ":", 1))))
