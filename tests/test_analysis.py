import json

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata import queries
from lodestrata.functions import text as t
from lodestrata.functions.views import view
from lodestrata.operators import duplication, files, git, graph
from lodestrata.plans import document, findings, history, report, scoring, wording
from lodestrata.plans.analysis import analyse
from lodestrata.sources import tables

from .compare import same

RAW = "project string, path string, content string"
SHARED = "\n".join(f"const shared_line_{n} = compute({n});" for n in range(8))


def table(spark, *rows):
    return files.as_files(spark.createDataFrame([("p", *r) for r in rows], RAW))


@pytest.fixture(scope="module")
def analysis(spark):
    big = "function big(a) {\n" + "  if (a) { b(); }\n" * 60 + "}\n"
    rows = [
        ("src/a.ts", "import { b } from './b';\nexport const a = () => b;\n" + SHARED),
        ("src/b.ts", "import { a } from './a';\nexport const b = () => a;\n" + SHARED),
        ("src/big.ts", big * 6),
        ("src/unused.ts", "import { x, y } from './b';\nx();\n"),
        ("src/key.ts", f'const k = "ghp_{"a1" * 18}";\n'),
        ("package.json", '{"scripts": {"typecheck": "tsc", "build": "vite build"}}'),
        ("package-lock.json", "{}\n"),
    ]
    head = "a" * 40
    log = [x for n in range(1, 7) for x in (f"{head[:-1]}{n}\tAnn\t170000000{n}", "1\t1\tsrc/a.ts", "2\t0\tsrc/b.ts", "9\t9\tgone.ts")]
    return analyse(table(spark, *rows), spark.createDataFrame([("p", n, x) for n, x in enumerate(log, 1)], "project string, line_no long, value string"), 1_700_086_400)


def test_analysis(analysis):
    total = analysis["totals"].first()
    assert (total.files, total.ignored, total.cycles, total.high, total.unused_imports) == (6, 1, 1, 1, 1)
    assert total.long_functions == 6 and total.high_complexity == 6 and total.duplicate_ratio > 0
    assert [r.files for r in analysis["cycles"].collect()] == [["src/a.ts", "src/b.ts"]]
    assert {(r.path, r.fan_in) for r in analysis["files"].collect() if r.fan_in} == {("src/a.ts", 1), ("src/b.ts", 2)}
    found = analysis["findings"].orderBy("rank").collect()
    assert found[0].kind == "security" and found[0].priority == "P0" and found[-1].kind == "noise"
    assert any(f.kind == "duplication" and "src/a.ts" in f.evidence[1] for f in found)
    assert all(f.prs[-1].startswith("pr.verify: npm run typecheck && npm run build") for f in found if f.prs)
    assert analysis["brief"].first().primary.startswith("security — src/key.ts")


def test_document(analysis):
    row = document.documents(analysis, 5).first()
    d = json.loads(row.document)
    assert (row.project, d["projectName"], d["generatedAt"], d["analyzedFiles"], d["ignoredFiles"], d["cycleCount"], d["securityHigh"]) == ("p", "p", 5, 6, 1, 1, 1)
    assert d["cycles"] == [["src/a.ts", "src/b.ts"]] and d["verifyCommands"] == ["npm run typecheck", "npm run build"]
    assert [f["path"] for f in d["largestFiles"]][0] == "src/big.ts" and d["ignoredLargest"][0]["noiseReason"] == "lockfile" and d["largestFiles"][0]["noiseReason"] is None
    assert {"from": "src/a.ts", "to": "src/b.ts"} in d["dependencies"] and d["unusedImports"][0]["name"] == "y" and len(d["allFiles"]) == 6
    assert d["duplication"][0]["sample"].startswith("const shared_line_0") and d["longFunctions"][0]["startLine"] == 1 and d["securityFindings"][0]["kind"] == "GitHub token"


def test_report(analysis, spark, tmp_path):
    text = report.markdown(analysis, "p")
    assert "### [P0][confidence: high] Secret in the source — `src/key.ts:1` _(shared)_" in text
    history = text[text.index("## History") : text.index("## Review brief")].split("\n")
    assert history == [
        "## History", "_6 commits by 1 authors_", "", "**Hotspots**", "", "| File | Commits | Churn | Heat |", "| --- | --- | --- | --- |",
        "| `src/a.ts` | 6 | 12 | 15.39 |", "| `src/b.ts` | 6 | 12 | 15.39 |", "", "**Changed together**", "", "| Pair | Times |", "| --- | --- |", "| `src/a.ts` ↔ `src/b.ts` | 6× |", "",
        "**Known to one author**", "", "| File | Author | Share |", "| --- | --- | --- |", "| `src/a.ts` | Ann | 100% |", "| `src/b.ts` | Ann | 100% |", "", "",
    ][: len(history)]
    assert "**Primary risk:** security — src/key.ts" in text and "_1 in all_" in text and "## Written review" not in text
    assert "## Written review\n\nhello" in report.markdown(analysis, "p", ai_text="hello")
    assert "why." not in text and "ftitle." not in text and "History: 6 commits, 1 authors." in report.summary(analysis, "p")
    assert "## Scores" in text and "`src/a.ts → src/b.ts → src/a.ts`" in text and "«redacted»" in text and "ghp_" not in text
    assert "Primary risk" in report.fix_prompt(analysis, "p")
    report.write_report(text, spark, str(tmp_path / "out"))
    assert "## Cycles" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())


def test_nothing_at_all(spark):
    empty = analyse(files.as_files(spark.createDataFrame([], RAW)))
    assert {k: v.count() for k, v in empty.items() if v.count()} == {}


def test_nulls(spark):
    rows = spark.createDataFrame([(None, "a.ts", None), ("p", None, "x"), ("p", "b.ts", "let x;\r\n")], RAW)
    assert [(r.path, r.lines) for r in files.with_line_counts(files.as_files(rows)).collect()] == [("b.ts", 1)]


def test_views():
    assert view("a // b\n'c//d' /* e\nf */ g", "TypeScript", False) == "a     \n'c//d'     \n     g"
    assert view("`a\\`b` \"c", "JavaScript", True) == "`    ` \" "
    assert view("'a' \"b\" // c", "Rust", True) == "'a' \" \"     "
    assert view("x = '''a\nb''' # c\n'd'", "Python", True) == "x =     \n        \n' '"
    assert view("--[[a\nb]] x = [[y]] 'z' -- w", "Lua", True) == "     \n    x = [[ ]] ' '     "


def test_duplicates_of_two_files(spark):
    rows = table(spark, ("a.ts", SHARED), ("b.ts", "let something = other;\n" + SHARED))
    again = duplication.repeated(duplication.windows(duplication.normal_lines(rows)))
    ratio = duplication.duplicate_ratio(again, spark.createDataFrame([("p", 50)], "project string, code long")).first()
    block = duplication.blocks(again).collect()
    assert (ratio.masked, ratio.ratio) == (8, 0.16)
    assert [(b.line_count, b.occurrences, b.files) for b in block] == [(8, 2, ["a.ts", "b.ts"])]
    once = table(spark, ("a.ts", "\n".join(SHARED.split("\n")[:6] * 2)))
    again = duplication.repeated(duplication.windows(duplication.normal_lines(once)))
    assert again.count() and not duplication.blocks(again).count()


@pytest.mark.parametrize(
    "edges,want",
    [
        ("ab ba bc", {"a": "a", "b": "a"}),
        ("ab bc cd", {}),
        ("ab bc ca cd de ed", {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}),
        ("ba cb ac xa ax aa", {"a": "a", "b": "a", "c": "a", "x": "a"}),
        ("da ad bd cb bc", {"a": "a", "d": "a", "b": "b", "c": "b"}),
    ],
)
def test_components_of_a_graph(spark, edges, want):
    rows = spark.createDataFrame([("p", e[0], e[1]) for e in edges.split()], "project string, src string, dst string")
    assert {r.node: r.component for r in graph.cycles_of(rows).collect()} == want


def test_a_long_way_takes_few_rounds(spark):
    """A ring of 100 nodes and a way of 100 into it; rounds are counted by what is stored."""
    r = [f"{(n * 7919) % 1009:04d}" for n in range(200)]
    edges = [("p", a, b) for a, b in zip(r, r[1:100] + r[:1])] + [("p", a, b) for a, b in zip(r[100:], [*r[101:], r[0]])]
    kept, rounds = graph.stored, []
    graph.stored = lambda df, name: (rounds.append(name), kept(df, name))[1]
    try:
        got = graph.cycles_of(spark.createDataFrame(edges, "project string, src string, dst string")).collect()
    finally:
        graph.stored = kept
    assert {x.node for x in got} == set(r[:100]) and {x.component for x in got} == {min(r[:100])}
    assert rounds.count("colors") < 120


LOG = """{h}1\tAlice\t1700000000
20\t5\tsrc/app.ts
7\t3\tsrc/util.ts
-\t-\tlogo.png

{h}2\tBob\twith tab\t1700086400\r
1\t0\t"src/app.ts"
9\t9\tnode_modules/x.js
nonsense
{h}3\tAlice\t1700172800
1\t1\ta/{{x.ts => y.ts}}
2\t0\tsrc/app.ts"""


def test_git_log(spark):
    lines = LOG.format(h="a" * 30).split("\n")
    parsed = git.parsed_log(spark.createDataFrame([("p", n, x) for n, x in enumerate(lines)], "project string, line_no long, value string"))
    commits, changes = git.commits_of(parsed), git.changes_of(parsed)
    assert [r.author for r in commits.orderBy("commit").collect()] == ["Alice", "Bob\twith tab", "Alice"]
    stats = {r.path: r for r in git.file_stats(changes, commits, 1_700_259_200).collect()}
    app = stats["src/app.ts"]
    assert (app.commits, app.additions, app.deletions, app.authors, app.last_touched_days) == (3, 23, 5, 2, 1)
    assert set(stats) == {"src/app.ts", "src/util.ts", "a/y.ts"}
    assert git.totals(commits).first().authors == 2
    some = spark.createDataFrame([("p",), ("q",)], "project string")
    assert {r.project: r.available for r in git.status(commits, some).collect()} == {"p": True, "q": False}
    assert [r.path for r in git.changes_of(parsed, spark.createDataFrame([("p", "a/y.ts")], "project string, path string")).collect()] == ["a/y.ts"]


def test_scores_of_known_totals(spark):
    rows = spark.createDataFrame([(37, 47, 53, 72, 51, "F"), (85, 86, 80, 100, 87, "B")], "m int, d int, a int, s int, p int, g string")
    whole = t.js_round(0.28 * F.col("m") + 0.26 * F.col("d") + 0.24 * F.col("a") + 0.22 * F.col("s"))
    assert all(r.x == r.p and r.y == r.g for r in rows.select("*", whole.alias("x"), scoring.grade(whole).alias("y")).collect())


def test_gate(spark):
    columns = "project string, file string, category string, kind string, priority string, score int, blast string, direct_io boolean, confidence string, runtime string, refactor array<struct<path:string,note:string>>, prs array<string>"
    rows = [
        ("p", "a", "actionable", "huge_file", "P2", 50, "low", False, "high", "shared", [], []),
        ("p", "b", "actionable", "god_server", "P1", 80, "low", False, "high", "client", [("x/wsServer.ts", ""), ("x/y.ts", "")], ["pr.types"]),
        ("p", "c", "actionable", "dialog", "P3", 10, "low", False, "high", "shared", [], []),
        ("p", "d", "actionable", "security", "P2", 10, "low", False, "high", "shared", [], []),
    ]
    out = {r.file: r for r in findings.gated(spark.createDataFrame(rows, columns)).collect()}
    assert (out["a"].priority, out["a"].score, out["a"].violations) == ("P3", 44, ["large-file-priority:a"])
    assert out["b"].blast == "high" and out["b"].confidence == "medium" and [s.path for s in out["b"].refactor] == ["x/y.ts"]
    assert out["b"].violations == ["p1-low-blast:god_server:b", "weak-high-conf:god_server:b", "client-server-suggestion:b", "pr-no-verify:b"]
    assert out["c"].category == "informational" and out["d"].violations == []


def test_wording():
    say = wording.speaker({"cycles.count": "{n} Kreise, {x}"})
    assert say("cycles.count", n=3) == "3 Kreise, {x}" and say("cycles.none") == "None." and say("no.such.key") == "no.such.key"
    assert say("pr.verify: npm run build") == "Check it with npm run build" and say("brief.fpWhy:dialog") == "It rests on hints."


def test_history(spark):
    ddl = "id long, project_path string, created_at long, overall_score int, grade string, ai_json string"
    old = spark.createDataFrame([(1, "p", 10, 50, "F", None), (2, "p", 20, 70, "C", "{}"), (3, "q", 5, 90, "A", None)], ddl)
    new = history.saved_report(old, spark.createDataFrame([(None, "p", 30, 80, "B", None)], ddl))
    assert {r.id for r in new.collect()} == {1, 2, 3, 4}
    two = spark.createDataFrame([(None, "p", 31, 1, "F", None), (None, "q", 30, 1, "F", None)], ddl)
    assert {(r.id, r.project_path) for r in history.saved_report(old, two).where("id > 3").collect()} == {(4, "q"), (5, "p")}
    assert {r.id: r.overall_score_delta for r in history.trends(new, "overall_score").collect()} == {1: None, 2: 20, 3: None, 4: 10}
    assert [r.id for r in history.report_list(new, project="p").collect()] == [4, 2, 1]
    texts = spark.createDataFrame([(1, "x")], "id long, ai_json string")
    assert {r.id for r in history.with_ai(old, texts).collect() if r.ai_json} == {1, 2}
    assert {r.id for r in history.deleted(old, texts).collect()} == {2, 3}
    projects = spark.createDataFrame([("p", "P", 1, 1)], "path string, name string, last_opened long, created_at long")
    opened = spark.createDataFrame([("p", "P2", 9), ("r", "R", 8)], "path string, name string, at long")
    assert {tuple(r) for r in history.opened_projects(projects, opened).collect()} == {("p", "P2", 9, 1), ("r", "R", 8, 8)}
    parsed = spark.createDataFrame([('{"projectScore": 5}',)], "s string").select(history.parsed_scores(F.col("s")).alias("x")).first().x
    assert (parsed.projectScore, parsed.maintainability) == (5, None)
    assert json.loads(new.where("id = 4").select(history.as_document(F.struct(F.col("overall_score").alias("overallScore"))).alias("d")).first().d) == {"overallScore": 80}


def test_long_and_null_texts_are_kept(spark, tmp_path):
    long = "some words in a line\n" * 150_000
    rows = [(1, long, "en", "web", len(long)), (2, None, "en", "web", None), (3, "one line", "en", "web", 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = tables.documents(spark, str(tmp_path))
    assert {r.path: r.size_bytes for r in found.collect()} == {"en/d00000001.md": len(long), "en/d00000002.md": 0, "en/d00000003.md": 8}
    assert [tuple(r) for r in queries.language_stats(spark, str(tmp_path)).collect()] == [("web", "Markdown", 3, 150_001)]
    assert [(r.path, r.lines) for r in queries.largest_files(spark, str(tmp_path)).orderBy("rank").collect()][0] == ("en/d00000001.md", 150_000)
    assert queries.huge_files(spark, str(tmp_path)).first().huge_files == 1


def test_language_stats_equal_their_sql_on_odd_texts(spark, tmp_path):
    """Line ends at the very end, no text, null, languages named as folders that a scan leaves out; lines by hand."""
    texts = {"a\nb\n": 2, "a\nb": 2, "": 0, None: 0, "\n": 1, "\n\n": 2, "a\r\nb\r\n": 2, "a\rb": 1, "\na": 2, "  \n \n": 2}
    rows = [(i, t, "en", f"s{i}", 0) for i, t in enumerate(texts)] + [(100 + i, "x\ny\n", lang, lang, 0) for i, lang in enumerate([None, "", "bin", "gen", "out", ".x"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = queries.language_stats(spark, str(tmp_path))
    same(found, sql, queries.SQL["language_stats"])
    assert {(r.project, r.files, r.lines) for r in found.collect()} == {(f"s{i}", 1, n) for i, n in enumerate(texts.values())} | {(lang, 1, 2) for lang in [None, "", "bin", "gen", "out", ".x"]}


def test_severity_counts_all_kinds(spark, tmp_path):
    """A GitHub token in an assignment, an AWS key, a private key, a JWT, an assigned word; by hand."""
    text = "\n".join([f'token = "ghp_{"a1" * 18}"', f"AKIA{'Z' * 16}", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "password = 'aaaabbbbcccc'", "nothing"])
    spark.createDataFrame([(1, text, "en", "web", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    row = queries.secrets_severity(spark, str(tmp_path)).first()
    assert (row.high, row.medium, row.low, row.total) == (3, 2, 0, 5)
    row = queries.secrets_assigned(spark, str(tmp_path)).first()
    assert row.random + row.plain == 2


def test_findings_show_words_and_no_keys(spark):
    """A server by direct and indirect evidence, line by line; then with a dictionary that takes values."""
    resp = "array<struct<kind:string,evidence:string,label:string,token:string,line:int,snippet:string>>"
    ddl = f"project string, path string, ext string, language string, noise_reason string, lines int, file_type string, runtime string, responsibilities {resp}, fan_in int, longest int, longest_name string, longest_line int, long_functions int, symbol string, symbol_line int"
    seen = [("websocket", "direct", "ws_server", "new WebSocketServer", 3, "new WebSocketServer({"), ("http_server", "direct", "http_listen", "createServer(", 9, ""), ("chat", "indirect", "chat_consumer", "chatMessages", 0, "x")]
    rows = [("p", "server/index.ts", "ts", "TypeScript", None, 900, "node_server", "server", seen, 4, 200, "handle", 20, 3, "index", 5), ("p", "lib/large.rs", "rs", "Rust", None, 1200, "other", "shared", [], 0, 10, "f", 1, 0, "", 0)]
    found = findings.findings([findings.file_findings(spark.createDataFrame(rows, ddl))], findings.noise_findings(spark.createDataFrame([("p", "a.min.js", 7, "generated", 1)], "project string, path string, lines int, noise_reason string, rank int")), spark.createDataFrame([("p", ["npm run build"])], "project string, commands array<string>"))
    rows = {r.file: r for r in found.collect()}
    shown = report._finding(rows["server/index.ts:5"], wording.speaker())
    assert shown[2:7] == [
        "- 900 lines", "- index begins on line 5", "- handle():20 takes 200 lines", "- serves web sockets, seen at work (new WebSocketServer):3 — `new WebSocketServer({`", "- listens for requests, seen at work (createServer():9",
    ]
    assert shown[7] == "- shows messages, used through others (chatMessages) — `x`" and shown[-2].endswith("Check it with npm run build")
    import re

    for r in rows.values():
        text = "\n".join(report._finding(r, wording.speaker()))
        assert not re.search(r"\b(resp|ev|rstep|pr|why|next|ftitle|vrf|find)\.[a-z]", text), text
    german = wording.speaker({"why.node_server": "{lines} Zeilen, {len} am Stück, {resp}", "resp.ws_server": "Sockets"})
    assert "**Why:** 900 Zeilen, 200 am Stück, Sockets, listens for requests, shows messages" in report._finding(rows["server/index.ts:5"], german)
    words = {r.file: r.w for r in found.select("file", wording.worded(F.col("said")).alias("w")).collect()}
    assert words["a.min.js"] == ["7 lines", "Left out as generated"] and [f"- {w}" for w in words["server/index.ts:5"]] == shown[2:8]
