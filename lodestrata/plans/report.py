"""Reports in Markdown, from the small tables of one project's analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .scoring import VERDICTS
from .wording import Say, speaker


def table(headers: list[str], rows: list[list]) -> list[str]:
    return [f"| {' | '.join(map(str, r))} |" for r in (headers, ["---"] * len(headers), *rows)]


def _of(analysis: dict[str, DataFrame], name: str, project: str, order: str | None = None, n: int = 1000) -> list:
    rows = analysis[name].where(analysis[name]["project"] == project)
    return (rows.orderBy(order) if order else rows).limit(n).collect()


def _finding(f, say: Say) -> list[str]:
    out = [f"### [{f.priority}][confidence: {f.confidence}] {say('ftitle.' + f.kind)} — `{f.file}` _({f.runtime})_"]
    out.append(f"_risk {f.score}/100 · reach {f.blast} · I/O {'yes' if f.direct_io else 'no'} · state machine {'yes' if f.state_machine else 'no'}_")
    values = {m["key"]: m["values"] for m in f.said}
    given = {"lines": values.get("ev.lines", {}).get("lines", ""), "len": values.get("ev.longest", {}).get("len", ""), "n": len(f.said)}
    given["resp"] = ", ".join(say(m["values"]["resp"]) for m in f.said if m["key"] == "ev.found")
    out += [f"- {say(m['key'], **m['values'])}" for m in f.said] + [f"**Why:** {say(f.why, **given)}"] * bool(f.why) + [f"**Next:** {say(f.next, **given)}"] * bool(f.next)
    out += [f"- `{s.path}` — {say(s.note)}" for s in f.refactor] + [f"{n}. {say(p)}" for n, p in enumerate(f.prs, 1)]
    return [*out, ""]


def _history(analysis: dict[str, DataFrame], project: str, say: Say) -> list[str]:
    """Hotspots, pairs and owners by the project's log; nothing if no log was given."""
    status = _of(analysis, "git_status", project) if "git_status" in analysis else []
    if not status:
        return []
    out = ["## History"]
    if not status[0].available:
        return [*out, f"_{say('log.unavailable', reason=status[0].reason)}_", ""]
    t = _of(analysis, "git_totals", project)[0]
    out += [f"_{say('log.count', commits=f'{t.commits:,}', authors=t.authors)}_", ""]
    if hot := _of(analysis, "git_hotspots", project, "rank", 10):
        out += ["**Hotspots**", "", *table(["File", "Commits", "Churn", "Heat"], [[f"`{r.path}`", r.commits, f"{r.churn:,}", f"{r.score:.2f}"] for r in hot]), ""]
    if pairs := _of(analysis, "git_cochanges", project, "rank", 8):
        out += ["**Changed together**", "", *table(["Pair", "Times"], [[f"`{r.a}` ↔ `{r.b}`", f"{r['count']}×"] for r in pairs]), ""]
    if held := _of(analysis, "git_bus_factor", project, "rank", 5):
        out += ["**Known to one author**", "", *table(["File", "Author", "Share"], [[f"`{r.path}`", r.top_author, f"{int(100 * r.share + 0.5)}%"] for r in held]), ""]
    return out


def _named(text: str, say: Say) -> str:
    """A text that begins with a kind of finding, the kind put in words."""
    kind, dash, rest = text.partition(" — ")
    return f"{say('ftitle.' + kind)}{dash}{rest}" if dash else say(text)


def _primary(b, say: Say) -> str:
    """Kind and file of the first finding to inspect, or that there is none."""
    return b.primary if b.inspect else say(b.primary)


def _brief(analysis: dict[str, DataFrame], project: str, say: Say) -> list[str]:
    rows = _of(analysis, "brief", project)
    if not rows:
        return []
    b = rows[0]
    out = ["## Review brief", f"**Primary risk:** {_primary(b, say)}", "", "**Order of inspection:**"]
    out += [f"{n}. `{i.file}` — {say('ftitle.' + i.reason)} — {i.priority} — {i.confidence}" for n, i in enumerate(b.inspect, 1)]
    if b.doubtful:
        out += ["", "**Likely false positives:**", *(f"- `{d.file}` — {say(d.why)}" for d in b.doubtful)]
    out.append("")
    return [*out, "## Warnings", *(f"- {say(w)}" for w in b.warnings), ""] if b.warnings else out


def markdown(analysis: dict[str, DataFrame], project: str, say: Say | None = None, ai_text: str | None = None) -> str:
    """The report of a project; ``say`` puts text keys in words (``wording.speaker``), ``ai_text`` is a text that was written elsewhere."""
    say = say or speaker()
    t = _of(analysis, "totals", project)[0]
    found = _of(analysis, "findings", project, "rank")
    of = lambda c: [f for f in found if f.category == c]
    out = [f"# Health report — {project}", "", f"> Grade **{t.grade}** ({VERDICTS[t.grade]}) · **{t.project_score}/100** — {say('blurb.' + t.grade)}", "", "## Scores"]
    names = ("project_score", "technical_debt", "architecture_health", "security_risk", "maintainability")
    out += table(["Metric", "Score"], [[n.replace("_", " ").capitalize(), t[n]] for n in names])
    out += ["", "## Overview", f"- Files: **{t.files:,}** · ignored: **{t.ignored:,}**", f"- Lines of code: **{t.code:,}** · functions: **{t.functions:,}** · average file: **{t.average_lines:.0f}** lines"]
    out += [f"- Secrets: **{t.high}** high / **{t.medium}** medium / **{t.low}** low — _no security audit_", f"- Duplicated: **{100 * t.duplicate_ratio:.1f}%**", "", "## Actionable findings"]
    out += [x for f in of("actionable") for x in _finding(f, say)] or ["_None._", ""]
    if doubtful := of("needs-verification"):
        out.append("## Needs verification")
        for f in doubtful:
            out += [f"### [{f.priority}] {say('ftitle.' + f.kind)} — `{f.file}` _({f.runtime})_", *(f"- {say(n)}" for n in f.notes)]
        out.append("")
    if known := of("informational"):
        out += ["## Informational", *(f"- `{f.file}` — {say('ftitle.' + f.kind)} (risk {f.score}/100)" for f in known), ""]
    if noise := of("noise"):
        out += ["## Noise", *(f"- `{f.file}` ({f.evidence[1]})" for f in noise), ""]
    out += ["## Complexity", f"_average {t.average_complexity:.1f} · most {t.max_complexity} · **{t.high_complexity}** functions over 10_", ""]
    dear = _of(analysis, "complex_functions", project, "rank", 15)
    out += table(["File", "Function", "Complexity", "Length"], [[f"`{r.path}:{r.start + 1}`", f"`{r.name}`", r.complexity, r.length] for r in dear]) if dear else [f"_{say('complex.none')}_"]
    cycles = _of(analysis, "cycles", project, "rank", 6)
    out += ["", "## Cycles", f"_{say('cycles.count', n=cycles[0].cycles) if cycles else say('cycles.none')}_", *(f"- `{' → '.join([*r.files, r.files[0]])}`" for r in cycles), ""]
    out += ["## Duplication", *(f"- {r.occurrences}× · {r.line_count} lines: {', '.join(f'`{x}`' for x in r.files)}" for r in _of(analysis, "blocks", project, "rank", 10)), ""]
    out += _history(analysis, project, say) + _brief(analysis, project, say)
    out += ["## Languages", *table(["Language", "Files", "Lines"], [[r.language, r.files, r.lines] for r in sorted(_of(analysis, "languages", project), key=lambda r: (-r.lines, r.language))]), ""]
    return "\n".join([*out, *(["## Written review", "", ai_text, ""] if ai_text else []), "---", "_Made by static analysis without network access._", ""])


def summary(analysis: dict[str, DataFrame], project: str) -> str:
    """A short text without code, for a reader who has not seen the project."""
    t = _of(analysis, "totals", project)[0]
    lines = [
        f"Project {project}: {t.files} files, {t.ignored} ignored, {t.code} lines of code, {t.functions} functions, {t.average_lines:.0f} lines a file, fan-in up to {t.max_fan_in}.",
        f"Scores: project {t.project_score} ({t.grade}), maintainability {t.maintainability}, debt {t.technical_debt}, architecture {t.architecture_health}, security {t.security_risk}.",
        f"Secrets: high {t.high}, medium {t.medium}, low {t.low}.",
        f"Complexity: average {t.average_complexity:.1f}, most {t.max_complexity}, over ten {t.high_complexity}; long functions {t.long_functions}; duplicated {100 * t.duplicate_ratio:.1f}%; unused imports {t.unused_imports}; cycles {t.cycles}.",
    ]
    lines += [f"Large: {r.path} ({r.lines} lines, {r.runtime}, {r.file_type})" for r in _of(analysis, "largest", project, "rank", 6)]
    lines += [f"Complex: {r.path}:{r.start + 1} {r.name} ({r.complexity}, {r.length} lines)" for r in _of(analysis, "complex_functions", project, "rank", 5)]
    lines += [f"Cycle: {' -> '.join([*r.files, r.files[0]])}" for r in _of(analysis, "cycles", project, "rank", 3)]
    if "git_status" in analysis and any(r.available for r in _of(analysis, "git_status", project)):
        g = _of(analysis, "git_totals", project)[0]
        lines.append(f"History: {g.commits} commits, {g.authors} authors.")
        lines += [f"Hotspot: {r.path} ({r.commits} commits, churn {r.churn})" for r in _of(analysis, "git_hotspots", project, "rank", 5)]
        lines += [f"Together: {r.a} <-> {r.b} ({r['count']}x)" for r in _of(analysis, "git_cochanges", project, "rank", 3)]
        lines += [f"Owner: {r.path} ({r.top_author} {int(100 * r.share + 0.5)}% of {r.commits} commits)" for r in _of(analysis, "git_bus_factor", project, "rank", 3)]
    lines += [f"[{f.priority}] {f.kind} {f.file} risk {f.score} {f.confidence}" for f in _of(analysis, "findings", project, "rank", 20) if f.category != "noise"]
    return "\n".join(lines)


def fix_prompt(analysis: dict[str, DataFrame], project: str, say: Say | None = None) -> str:
    """Findings with evidence and steps, order of inspection and warnings as a task for whoever mends the project."""
    say = say or speaker()
    b = _of(analysis, "brief", project)[0]
    out = [summary(analysis, project), "", f"Primary risk: {_primary(b, say)}", "", "Inspect in this order:"]
    out += [f"{n}. [{i.priority}] {i.file} — {say('ftitle.' + i.reason)} ({i.confidence})" for n, i in enumerate(b.inspect, 1)]
    out += ["", "Findings:", "", *(x for f in _of(analysis, "findings", project, "rank") if f.category == "actionable" for x in _finding(f, say))]
    out += ["Likely false positives:", *(f"- {d.file}: {say(d.why)}" for d in b.doubtful), "", "Ignored:", *(f"- {x}" for x in b.ignored)]
    for n, p in enumerate(b.prs, 1):
        out += ["", f"Pull request {n}: {_named(p.scope, say)} — {say(p.why)}", *(f"- {x}" for x in p.files)]
    return "\n".join([*out, "", *map(say, b.warnings), ""])


def write_report(text_: str, spark, path: str) -> None:
    """One Markdown file in a folder."""
    spark.createDataFrame([(text_,)], "value string").coalesce(1).write.mode("overwrite").text(path)
