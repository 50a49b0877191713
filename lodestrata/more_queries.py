"""Further queries with SQL that computes over whole tables: lists, counters, renderings of every shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .operators import evidence, files, functions, git, graph, imports, secrets
from .plans import findings, history, scoring
from .queries import FUNCTIONS, NOW, RENDERED, REPORTS, query
from .sources import tables


def num() -> Column:
    """The key of an order."""
    return F.col("k")


def _orders(spark, d):
    o = tables.dealt(tables.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("c")), "k")
    return o.select("k", "c", F.format_string("p%02d", F.col("c") % 20).alias("project"))


def _by(n: Column, values: list) -> Column:
    """The value at a place of a list."""
    return F.get(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), n.cast("int"))


def _sql_by(n: str, values: list[str]) -> str:
    return f"CASE {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


ORDERS = "WITH o AS (SELECT o_orderkey::BIGINT AS k, o_custkey::BIGINT AS c, printf('p%02d', o_custkey % 20) AS project FROM orders)"


# Files

ENDINGS_SQL = """
WITH e AS (SELECT row_number() OVER () - 1 AS n, ext, language FROM (VALUES ('rs','Rust'),('ts','TypeScript'),('mts','TypeScript'),('cts','TypeScript'),('tsx','TypeScript'),('js','JavaScript'),('mjs','JavaScript'),
 ('cjs','JavaScript'),('jsx','JavaScript'),('py','Python'),('go','Go'),('java','Java'),('kt','Kotlin'),('kts','Kotlin'),('swift','Swift'),('c','C'),('h','C'),('cpp','C++'),('cc','C++'),('cxx','C++'),('hpp','C++'),
 ('hh','C++'),('cs','C#'),('rb','Ruby'),('php','PHP'),('lua','Lua'),('dart','Dart'),('scala','Scala'),('vue','Vue'),('svelte','Svelte'),('css','CSS'),('scss','CSS'),('sass','CSS'),('less','CSS'),('html','HTML'),
 ('htm','HTML'),('json','JSON'),('yml','YAML'),('yaml','YAML'),('toml','TOML'),('md','Markdown'),('mdx','Markdown'),('sh','Shell'),('bash','Shell'),('zsh','Shell'),('sql','SQL'),('cfg','Config')) t(ext, language)),
o AS (SELECT o_orderkey AS k, o_orderkey % 49 AS n FROM orders)
"""
EXTENSIONS = [e for es in rules.EXTENSIONS.values() for e in es.split()]


@query(ENDINGS_SQL + "SELECT language, count(*)::BIGINT AS files, sum(length('x' || k))::BIGINT AS bytes FROM o JOIN e USING (n) GROUP BY 1")
def languages_of_extensions(spark, d):
    """A file of each extension in turn, every other in capitals; two are of no language."""
    ext = _by(num() % 49, [*EXTENSIONS, "exe", "png"])
    name = F.concat(F.lit("src/f"), num().cast("string"), F.lit("."), F.when(num() % 2 == 0, F.upper(ext)).otherwise(ext))
    rows = files.as_files(_orders(spark, d).select("project", name.alias("path"), F.concat(F.lit("x"), num().cast("string")).alias("content")))
    return rows.groupBy("language").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


FOLDERS = ["src", "node_modules", "src/.next", "lib/target/deep", "builder", "a/vendor", "distant/out.d", ".github", "a/b/c", "coverage/x", "__pycache__", "out"]


@query(ORDERS + f"""SELECT k, f NOT IN ('node_modules', 'src/.next', 'lib/target/deep', 'a/vendor', '.github', 'coverage/x', '__pycache__', 'out') AS scanned
FROM (SELECT k, {_sql_by('k % 12', [repr(f) for f in FOLDERS])} AS f FROM o)""")  # fmt: skip
def scanned_paths(spark, d):
    path = F.concat(_by(num() % len(FOLDERS), FOLDERS), F.lit("/out"), num().cast("string"), F.lit(".ts"))
    return _orders(spark, d).select("k", files.is_scanned(path).alias("scanned"))


FOREIGN = """, f AS (SELECT project, CASE WHEN k % 3 = 0 THEN 'src/gen/f' || k || '.ts' WHEN k % 3 = 1 THEN 'src/f' || k || '.min.js' ELSE 'src/f' || k || '.ts' END AS path, k % 3 < 2 AS noise, 1 + k % 90 AS lines FROM o)"""


def _sized(spark, d):
    name = F.when(num() % 3 == 0, F.concat(F.lit("src/gen/f"), num().cast("string"), F.lit(".ts"))).when(num() % 3 == 1, F.concat(F.lit("src/f"), num().cast("string"), F.lit(".min.js")))
    name = name.otherwise(F.concat(F.lit("src/f"), num().cast("string"), F.lit(".ts")))
    raw = _orders(spark, d).select("project", name.alias("path"), F.repeat(F.lit("let a;\n"), (1 + num() % 90).cast("int")).alias("content"))
    return files.with_line_counts(files.as_files(raw))


@query(ORDERS + FOREIGN + "SELECT * FROM (SELECT project, path, lines, row_number() OVER (PARTITION BY project ORDER BY lines DESC, path)::INTEGER AS rank FROM f WHERE noise) WHERE rank <= 8")
def ignored_files(spark, d):
    return files.largest_files(_sized(spark, d), rules.TOP["ignored"], noise=True)


@query(ORDERS + FOREIGN + "SELECT * FROM (SELECT project, path, lines, row_number() OVER (PARTITION BY project ORDER BY lines DESC, path)::INTEGER AS rank FROM f WHERE NOT noise) WHERE rank <= 120")
def all_files(spark, d):
    return files.largest_files(_sized(spark, d), rules.TOP["all_files"])


# Functions


@query(RENDERED + FUNCTIONS + """ SELECT project, count(*)::BIGINT AS functions, count(*) FILTER (length > 50)::BIGINT AS long_functions, count(*) FILTER (complexity > 10)::BIGINT AS high_complexity,
round(avg(complexity), 9) AS average_complexity, max(complexity)::BIGINT AS max_complexity FROM f GROUP BY 1""")  # fmt: skip
def function_totals(spark, d):
    rows = functions.function_totals(functions.functions(tables.rendered(spark, d)))
    return rows.withColumn("average_complexity", F.round("average_complexity", 9)).withColumn("max_complexity", F.col("max_complexity").cast("long"))


@query(ORDERS + """, f AS (SELECT project, 'o' || k || '.go' AS path, k % 120 + 2 AS length FROM o)
SELECT * FROM (SELECT project, path, 'f' AS name, length, row_number() OVER (PARTITION BY project ORDER BY length DESC, path)::INTEGER AS rank FROM f WHERE length > 50) WHERE rank <= 30""")  # fmt: skip
def longest_functions(spark, d):
    body = F.concat(F.lit("func f() {\n"), F.repeat(F.lit("  a();\n"), (num() % 120).cast("int")), F.lit("}\n"))
    raw = _orders(spark, d).select("project", F.format_string("o%d.go", num()).alias("path"), body.alias("content"))
    rows = functions.long_functions(functions.functions(files.as_files(raw)))
    return rows.select("project", "path", "name", F.col("length").cast("long").alias("length"), "rank")


# Secrets: each order is a line of one of the shapes, with digits of its key.


def _digits(n: int, hexadecimal: bool = False) -> Column:
    """Letters and digits, n of them, that end with the key."""
    return F.lpad(num().cast("string"), n, "0" if hexadecimal else "AB1")


def _line(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


SHAPES = [
    (lambda: _line("-----BEGIN ", "EC PRIVATE KEY----- ", num().cast("string")), "Private key material", "high"),
    (lambda: _line("a = 'gh", "p_", _digits(36), "'"), "GitHub token", "high"),
    (lambda: _line("a = 'github", "_pat_", _digits(60), "'"), "GitHub token", "high"),
    (lambda: _line("a = 'sk", "_live_", _digits(16), "'"), "Stripe live key", "high"),
    (lambda: _line("a = 'AK", "IA", _digits(16), "'"), "AWS access key", "high"),
    (lambda: _line("a = 'AS", "IA", _digits(16), "'"), "AWS temporary key", "high"),
    (lambda: _line("a = 'AI", "za", _digits(35), "'"), "Google API key", "high"),
    (lambda: _line("a = 'xo", "xb-", _digits(12), "'"), "Slack token", "high"),
    (lambda: _line("a = 'sk-", "ant-", _digits(24), "'"), "Provider API key", "high"),
    (lambda: _line("a = 'np", "m_", _digits(36), "'"), "npm token", "high"),
    (lambda: _line("a = 'S", "G.", _digits(16), ".", _digits(16), "'"), "SendGrid key", "high"),
    (lambda: _line("a = '12345678:", "AA", _digits(33), "'"), "Telegram bot token", "high"),
    (lambda: _line("a = 's", "k-", _digits(38), "'"), "API secret key", "high"),
    (lambda: _line("a = 'wh", "sec_", _digits(24), "'"), "Webhook secret", "medium"),
    (lambda: _line("a = 'https://hooks.slack", ".com/services/T", _digits(8), "'"), "Slack webhook", "medium"),
    (lambda: _line("a = 'S", "K", _digits(32, True), "'"), "Twilio key", "medium"),
    (lambda: _line("a = 'ey", "J", _digits(8), ".ey", "J", _digits(8), ".", _digits(8), "'"), "JWT committed to source", "medium"),
    (lambda: _line("pass", "word = 'aaaabbbb", num().cast("string"), "'"), "Hardcoded secret", "medium"),
    (lambda: _line("api", "_key: \"qW3eR5tY7uI9oP1aS4dF", num().cast("string"), "\""), "High-entropy secret", "high"),
    (lambda: _line("tok", "en = 'your-", num().cast("string"), "-goes-here'"), None, None),
    (lambda: _line("let plain = ", num().cast("string")), None, None),
]


def _keys(spark, d):
    line = _by(num() % len(SHAPES), [s() for s, *_ in SHAPES])
    path = F.concat(F.when(num() % 4 == 0, "tests/k").otherwise("src/k"), num().cast("string"), F.lit(".py"))
    return files.as_files(_orders(spark, d).select("project", path.alias("path"), F.concat(F.lit("# line\n"), line).alias("content")))


def _shape_sql(n: int) -> str:
    return _sql_by(f"k % {len(SHAPES)}", [f"'{s[n]}'" if s[n] else "NULL" for s in SHAPES])


FOUND_SQL = ORDERS + f""", s AS (SELECT project, CASE WHEN k % 4 = 0 THEN 'tests/k' ELSE 'src/k' END || k || '.py' AS path, 2 AS line, {_shape_sql(1)} AS kind,
 CASE WHEN k % 4 = 0 THEN 'low' ELSE {_shape_sql(2)} END AS severity FROM o)"""


@query(FOUND_SQL + "SELECT project, path, line, kind, severity FROM s WHERE kind IS NOT NULL")
def secret_shapes(spark, d):
    return secrets.secrets(_keys(spark, d)).select("project", "path", "line", "kind", "severity")


@query(FOUND_SQL + """SELECT * FROM (SELECT project, path, kind, severity, row_number() OVER (PARTITION BY project ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, path, line)::INTEGER AS rank
FROM s WHERE kind IS NOT NULL) WHERE rank <= 100""")  # fmt: skip
def secrets_listed(spark, d):
    return secrets.top_secrets(secrets.secrets(_keys(spark, d))).select("project", "path", "kind", "severity", "rank")


@query(ORDERS + "SELECT k, CASE WHEN k % 3 = 2 THEN 'password = ''«redacted»'' // your' ELSE 'x(''«redacted»'', ''«redacted»'') // ' || k END AS snippet FROM o")
def secrets_redacted(spark, d):
    """Lines with two secrets, or a placeholder before a real one: neither value is shown."""
    two = _line("x('gh", "p_", _digits(36), "', 'AK", "IA", _digits(16), "') // ", num().cast("string"))
    after = _line("pass", "word = 'S", "K", _digits(32, True), "' // your")
    raw = _orders(spark, d).select("project", F.format_string("src/%d.ts", num()).alias("path"), F.when(num() % 3 == 2, after).otherwise(two).alias("content"))
    rows = secrets.secrets(files.as_files(raw))
    return rows.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("k"), "snippet")


# Version control

OLD = ["old%d.ts => new%d.ts", "src/{a => b}/m%d.rs", "a/{ => sub}/f%d.rs", "a/{x => }/f%d.rs", '"q%d.rs"', 'say "hi%d"', "a%d => b => c", "{a => b}/{c => d}/%d.rs", "src\\win\\p%d.rs", " plain%d.rs "]
NEW = ["'new' || k || '.ts'", "'src/b/m' || k || '.rs'", "'a/sub/f' || k || '.rs'", "'a/f' || k || '.rs'", "'q' || k || '.rs'", "'say \"hi' || k || '\"'", "'b => c'", "'b/{c => d}/' || k || '.rs'", "'src/win/p' || k || '.rs'", "'plain' || k || '.rs'"]


@query(ORDERS + f"SELECT k, {_sql_by('k % 10', NEW)} AS path FROM o")
def renamed_paths(spark, d):
    path = F.replace(_by(num() % len(OLD), OLD), F.lit("%d"), num().cast("string"))
    return _orders(spark, d).select("k", git.new_path(path).alias("path"))


@query(ORDERS + """SELECT DISTINCT 'p' || c AS project, c % 4 < 2 AS available,
CASE c % 4 WHEN 2 THEN 'not a git work tree' WHEN 3 THEN CASE WHEN c % 8 = 3 THEN 'could not parse git log output' ELSE 'no commits found' END END AS reason FROM o""")  # fmt: skip
def git_status(spark, d):
    """Logs of customers: with a header, with a reason, with rubbish, or empty."""
    c = F.col("c")
    o = _orders(spark, d).select(F.concat(F.lit("p"), c.cast("string")).alias("project"), "c", "k")
    header = F.concat(F.lpad(F.hex("k"), 40, "0"), F.lit("\tA\t1700000000"))
    value = F.when(c % 4 < 2, header).when(c % 4 == 2, "not a git work tree").when(c % 8 == 3, "rubbish").otherwise("")
    log = o.select("project", F.when(c % 4 == 2, 0).otherwise(num() + 1).alias("line_no"), value.alias("value"))
    return git.status(git.commits_of(git.parsed_log(log)), o.select("project").distinct(), log)


# Imports and their graph

ORIENTED = """
WITH RECURSIVE l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS s FROM lineitem),
p AS (SELECT a.s AS x, b.s AS y, a.k, a.n FROM l a JOIN l b ON a.k = b.k AND b.n = a.n + 1 WHERE a.s <> b.s),
e AS (SELECT printf('s%05d', CASE WHEN m.s_nationkey > n.s_nationkey THEN y ELSE x END) AS src, printf('s%05d', CASE WHEN m.s_nationkey > n.s_nationkey THEN x ELSE y END) AS dst, k, p.n
      FROM p JOIN supplier m ON m.s_suppkey = x JOIN supplier n ON n.s_suppkey = y),
d AS (SELECT DISTINCT src, dst FROM e), r(a, b) AS (SELECT src, dst FROM d UNION SELECT r.a, d.dst FROM r JOIN d ON r.b = d.src),
c AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1)
"""


@query(ORIENTED + "SELECT node, component FROM c")
def scc_by_nation(spark, d):
    """Edges lead to suppliers of the same or a later nation, so components are parts of nations."""
    return graph.cycles_of(tables.imports(spark, d, oriented=True)).select("node", "component")


@query(ORIENTED + """, s AS (SELECT component, count(*)::BIGINT AS size, list_slice(list_sort(list(node)), 1, 12) AS files FROM c GROUP BY 1)
SELECT component, size, array_to_string(files, ' ') AS files, count(*) OVER ()::BIGINT AS cycles, row_number() OVER (ORDER BY size DESC, component)::INTEGER AS rank FROM s QUALIFY rank <= 20""")  # fmt: skip
def cycles_listed(spark, d):
    rows = graph.cycle_report(graph.cycles_of(tables.imports(spark, d, oriented=True)))
    return rows.select("component", "size", F.array_join("files", " ").alias("files"), "cycles", "rank")


@query(ORIENTED + "SELECT src, dst, k AS l_orderkey, n AS l_linenumber, row_number() OVER (ORDER BY src, k, n, dst)::INTEGER AS rank FROM e QUALIFY rank <= 600")
def dependencies_listed(spark, d):
    return imports.listed(tables.imports(spark, d, oriented=True)).select("src", "dst", "ord.l_orderkey", "ord.l_linenumber", "rank")


@query(RENDERED + "SELECT * FROM (SELECT project, path, 'unused' || k AS name, 1 AS line, row_number() OVER (PARTITION BY project ORDER BY path)::INTEGER AS rank FROM r) WHERE rank <= 60")
def unused_listed(spark, d):
    return imports.top_unused(imports.unused_imports(tables.rendered(spark, d))).select("project", "path", "name", "line", "rank")


# Scores, findings, history


@query("""SELECT o_orderkey::BIGINT AS k, CASE WHEN s >= 90 THEN 'Clean Scene' WHEN s >= 80 THEN 'Minor Offenses' WHEN s >= 70 THEN 'Persons of Interest' WHEN s >= 55 THEN 'Active Crime Scene' ELSE 'Homicide' END AS verdict,
CASE WHEN s >= 80 THEN 'good' WHEN s >= 60 THEN 'warn' ELSE 'bad' END AS level, CASE WHEN s >= 20 THEN 'high' WHEN s >= 14 THEN 'medium' ELSE 'low' END AS badge,
CASE WHEN s >= 80 THEN 'bad' WHEN s >= 60 THEN 'warn' END AS share FROM (SELECT o_orderkey, o_orderkey % 101 AS s FROM orders)""")  # fmt: skip
def badges(spark, d):
    s = num() % 101
    return _orders(spark, d).select("k", scoring.verdict(scoring.grade(s)).alias("verdict"), scoring.level(s).alias("level"), scoring.complexity_badge(s).alias("badge"), scoring.share_level(s / 100).alias("share"))


GATED = """
WITH f AS (SELECT o_orderkey AS k, ['huge_file', 'god_server', 'god_hook', 'feature_component', 'icon_file', 'dialog', 'security'][o_orderkey % 7 + 1] AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 'informational' ELSE 'actionable' END AS category,
  ['P1', 'P2', 'P3'][o_orderkey % 3 + 1] AS priority, (o_orderkey % 101)::INTEGER AS score, CASE WHEN o_orderkey % 2 = 0 THEN 'low' ELSE 'high' END AS blast, o_orderkey % 11 = 0 AS io,
  CASE WHEN o_orderkey % 4 = 0 THEN 'client' ELSE 'server' END AS runtime, o_orderkey % 13 < 6 AS checked FROM orders),
g AS (SELECT *, category = 'actionable' AS a, 'f' || k AS file FROM f),
v AS (SELECT *, a AND kind <> 'security' AND score < 20 AS v1, a AND priority = 'P1' AND kind IN ('god_server', 'god_hook') AND blast = 'low' AS v2, a AND kind IN ('god_server', 'feature_component') AND NOT io AS v3,
  a AND runtime = 'client' AS v4, a AND kind = 'icon_file' AS v5, a AND kind = 'huge_file' AND priority IN ('P1', 'P2') AS v6, a AND NOT checked AS v7 FROM g)
SELECT k::BIGINT AS k, CASE WHEN v1 THEN 'informational' ELSE category END AS category, CASE WHEN v6 THEN 'P3' ELSE priority END AS priority, CASE WHEN v6 THEN least(score, 44) ELSE score END AS score,
  CASE WHEN v2 THEN 'high' ELSE blast END AS blast, CASE WHEN v3 THEN 'medium' ELSE 'high' END AS confidence, (3 - CASE WHEN v4 THEN 1 ELSE 0 END - CASE WHEN v5 THEN 1 ELSE 0 END)::INTEGER AS steps,
  concat_ws(' ', CASE WHEN v1 THEN 'below-floor:' || kind || ':' || file || ':' || score END, CASE WHEN v2 THEN 'p1-low-blast:' || kind || ':' || file END, CASE WHEN v3 THEN 'weak-high-conf:' || kind || ':' || file END,
    CASE WHEN v4 THEN 'client-server-suggestion:' || file END, CASE WHEN v5 THEN 'icon-hook:' || file END, CASE WHEN v6 THEN 'large-file-priority:' || file END, CASE WHEN v7 THEN 'pr-no-verify:' || file END) AS violations FROM v"""


@query(GATED)
def gated_findings(spark, d):
    step = lambda p: F.struct(F.lit(p).alias("path"), F.lit("").alias("note"))
    rows = _orders(spark, d).select(
        "k", F.concat(F.lit("f"), num().cast("string")).alias("file"), _by(num() % 7, ["huge_file", "god_server", "god_hook", "feature_component", "icon_file", "dialog", "security"]).alias("kind"),
        F.when(num() % 5 == 0, "informational").otherwise("actionable").alias("category"), _by(num() % 3, ["P1", "P2", "P3"]).alias("priority"), (num() % 101).cast("int").alias("score"),
        F.when(num() % 2 == 0, "low").otherwise("high").alias("blast"), (num() % 11 == 0).alias("direct_io"), F.lit("high").alias("confidence"), F.when(num() % 4 == 0, "client").otherwise("server").alias("runtime"),
        F.array(step("a/wsServer.ts"), step("a/useThing.ts"), step("a/b.ts")).alias("refactor"), F.array(F.lit("pr.types"), F.when(num() % 13 < 6, "pr.verify: npm run build").otherwise("pr.tests")).alias("prs"),
    )
    rows = findings.gated(rows)
    return rows.select("k", "category", "priority", "score", "blast", "confidence", F.size("refactor").alias("steps"), F.array_join("violations", " ").alias("violations"))


@query(FOUND_SQL + """, t AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, path, line) AS rank FROM s WHERE kind IS NOT NULL)
SELECT project, 'security:' || path || ':' || line AS id, CASE severity WHEN 'high' THEN 'P0' WHEN 'medium' THEN 'P1' ELSE 'P2' END AS priority, CASE severity WHEN 'high' THEN 90 WHEN 'medium' THEN 60 ELSE 40 END AS score,
 kind AS first FROM t WHERE rank <= 8""")  # fmt: skip
def security_findings(spark, d):
    rows = findings.security_findings(secrets.top_secrets(secrets.secrets(_keys(spark, d))))
    return rows.select("project", "id", "priority", "score", F.get("evidence", F.lit(0)).alias("first"))


@query(RENDERED + "SELECT project, min(path) AS file, 1 AS line, count(*) || ' unused imports' AS evidence FROM r GROUP BY 1")
def unused_findings(spark, d):
    rows = findings.unused_findings(imports.unused_imports(tables.rendered(spark, d)))
    return rows.select("project", "file", "line", F.array_join("evidence", " ").alias("evidence"))


@query(ORDERS + FOREIGN + """SELECT 'noise:' || path AS id, project, lines || ' lines generated' AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY lines DESC, path) AS rank FROM f WHERE noise) WHERE rank <= 8""")
def noise_findings(spark, d):
    rows = _sized(spark, d)
    ignored = files.top_of_project(rows.where("noise_reason is not null"), rules.TOP["ignored"], F.col("lines").desc(), F.col("path"))
    return findings.noise_findings(ignored).select("id", "project", F.array_join("evidence", " ").alias("evidence"))


@query("""WITH p AS (SELECT 'c' || c_custkey AS path, c_name AS name, 5 AS last_opened, 5 AS created_at FROM customer WHERE c_custkey % 2 = 0),
o AS (SELECT 'c' || o_custkey AS path, arg_max(o_clerk, o_orderkey) AS name, max(o_orderkey) AS seen, min(o_orderkey) AS first FROM (SELECT o_custkey, o_orderkey, 'n' || o_orderkey AS o_clerk FROM orders) GROUP BY 1)
SELECT coalesce(p.path, o.path) AS path, coalesce(o.name, p.name) AS name, coalesce(seen, last_opened)::BIGINT AS last_opened, coalesce(created_at, first)::BIGINT AS created_at FROM p FULL JOIN o ON p.path = o.path""")  # fmt: skip
def projects_opened(spark, d):
    at = F.lit(5).cast("long")
    known = tables.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_name").alias("name"), at.alias("last_opened"), at.alias("created_at"))
    opened = _orders(spark, d).select(F.concat(F.lit("c"), F.col("c").cast("string")).alias("path"), F.concat(F.lit("n"), num().cast("string")).alias("name"), num().alias("at"))
    return history.opened_projects(known, opened)


@query(REPORTS + """SELECT id, project_path, CASE WHEN id % 5 = 0 THEN 'text ' || id WHEN has_ai THEN '{}' END AS ai_json FROM r WHERE id % 7 <> 0
UNION ALL SELECT (SELECT max(id) FROM r WHERE id % 7 <> 0) + n_nationkey + 1, 'new' || n_nationkey, NULL FROM nation""")  # fmt: skip
def reports_kept(spark, d):
    """Reports after some got a text, some were deleted, and one for each nation was saved."""
    rows = tables.reports(spark, d)
    kept = history.deleted(history.with_ai(rows, rows.where("id % 5 = 0").select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("ai_json"))), rows.where("id % 7 = 0"))
    key = F.col("n_nationkey").cast("long")
    new = {"id": F.lit(None).cast("long"), "project_path": F.concat(F.lit("new"), key.cast("string")), "created_at": key, "overall_score": F.lit(1), "ai_json": F.lit(None).cast("string")}
    saved = history.saved_report(kept, tables.table(spark, d, "nation").select(*(new[c].alias(c) for c in kept.columns)))
    return saved.select("id", "project_path", "ai_json")


COMMENT_LINES = [
    ("ts", "// c", "let a;"), ("py", "# c", "a = 1"), ("lua", "-- c", "local a"), ("sql", "-- c", "select 1"), ("css", "/* c */", "a { }"), ("html", "<!-- c -->", "<p>"),
    ("yaml", "# c", "a: 1"), ("rb", "# c", "a"), ("go", "/* c", "*/ a"), ("json", "// no", "{}"),
]


@query(ORDERS + """SELECT k, 2 * (1 + k % 4) + 1 AS lines, 1 AS blank, CASE k % 10 WHEN 8 THEN 2 * (1 + k % 4) WHEN 9 THEN 0 ELSE 1 + k % 4 END AS comment FROM o""")
def comments_of_languages(spark, d):
    """A comment and a line of code of ten languages, some times over; in Go the line of code ends the comment."""
    both = _by(num() % 10, [f"{c}\n{code}\n" for _, c, code in COMMENT_LINES])
    path = F.concat(F.lit("f"), num().cast("string"), F.lit("."), _by(num() % 10, [e for e, *_ in COMMENT_LINES]))
    rows = files.with_line_counts(files.as_files(_orders(spark, d).select("project", path.alias("path"), F.concat(F.repeat(both, (1 + num() % 4).cast("int")), F.lit(" \t\n")).alias("content"))))
    return rows.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("k"), "lines", "blank", "comment")


RUNTIMES = [
    ("server/a.ts", "x", "server"), ("api/a.ts", "x", "server"), ("lib/a.ts", "require('http');", "server"), ("lib/b.ts", "const s = createServer(x);", "server"), ("lib/c.tsx", "const [a] = useState(1);", "client"),
    ("client/d.ts", "x", "client"), ("lib/e.ts", "// createServer(", "shared"), ("lib/f.ts", "import { z } from 'y';", "shared"),
]


@query(ORDERS + "SELECT k, " + _sql_by("k % 8", [f"'{r[2]}'" for r in RUNTIMES]) + " AS runtime, " + _sql_by("k % 8", ["NULL", "NULL", "NULL", "'http_server:direct:http_listen'", "NULL", "NULL", "NULL", "'validation:supporting:validation_type'"]) + " AS does FROM o")
def runtimes(spark, d):
    path = F.concat(F.regexp_replace(_by(num() % 8, [p for p, *_ in RUNTIMES]), r"\.(\w+)$", ""), num().cast("string"), F.lit("."), _by(num() % 8, [p.rpartition(".")[2] for p, *_ in RUNTIMES]))
    raw = _orders(spark, d).select("project", path.alias("path"), _by(num() % 8, [c for _, c, _ in RUNTIMES]).alias("content"))
    rows = evidence.classified(files.as_files(raw))
    first = F.get("responsibilities", F.lit(0))
    does = F.when(first.isNotNull(), F.concat_ws(":", first["kind"], first["evidence"], first["label"]))
    return rows.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("k"), "runtime", does.alias("does"))


@query(ORDERS + f"""SELECT k, CASE WHEN k % 3 = 0 THEN 3 WHEN k % 3 = 1 THEN 1 ELSE 0 END AS symbol_line FROM o WHERE k <= {NOW}""")
def symbol_lines(spark, d):
    """A declaration in a comment does not count; without one it is the longest function's line, without that 0."""
    body = F.when(num() % 3 == 0, _line("// function f", num().cast("string"), "(\n\nfunction f", num().cast("string"), "() {\n  a();\n}\n")).when(num() % 3 == 1, "function other() {\n  a();\n}\n").otherwise("let x;\n")
    path = F.when(num() % 3 == 1, F.format_string("src/useF%d.ts", num())).otherwise(F.format_string("src/f%d.ts", num()))
    rows = files.as_files(_orders(spark, d).select("project", path.alias("path"), body.alias("content")))
    return evidence.classified(functions.with_longest(rows)).select(F.regexp_extract("path", r"(\d+)\.ts$", 1).cast("long").alias("k"), "symbol_line")


