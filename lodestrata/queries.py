"""Queries over the star schema's tables that show each operator, with their SQL.

Operators on source text run on fixed fixtures or on source files rendered from
orders, whose results follow from the keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import rules
from .functions import text as t
from .operators import duplication, evidence, files, functions, git, graph, imports, secrets
from .plans import findings, history, scoring
from .scratch import stored
from .sources import tables

NOW = 1_700_000_000
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Version control

CHANGES = """
WITH c AS (SELECT l_orderkey AS commit, printf('src/%05d', l_partkey) AS path, sum(l_quantity::BIGINT)::BIGINT AS additions, sum(l_linenumber)::BIGINT AS deletions
           FROM lineitem GROUP BY ALL),
o AS (SELECT o_orderkey AS commit, o_custkey::VARCHAR AS author, epoch(o_orderdate)::BIGINT AS ts FROM orders)
"""


@query("SELECT count(*)::BIGINT AS commits, count(DISTINCT o_custkey)::BIGINT AS authors FROM orders")
def git_totals(spark, d):
    return git.totals(tables.commits(spark, d)).drop("project")


@query(CHANGES + f"""
SELECT path, count(*)::BIGINT AS commits, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, count(DISTINCT author)::BIGINT AS authors,
       greatest(0, ({NOW} - max(ts)) // 86400)::BIGINT AS last_touched_days
FROM c JOIN o USING (commit) GROUP BY path""")  # fmt: skip
def git_file_stats(spark, d):
    return git.file_stats(tables.changes(spark, d), tables.commits(spark, d), NOW).drop("project")


@query(CHANGES + """, s AS (SELECT path, count(*)::BIGINT AS commits FROM c JOIN o USING (commit) GROUP BY path)
SELECT path, commits, row_number() OVER (ORDER BY commits DESC, path)::INTEGER AS rank FROM s ORDER BY rank LIMIT 100""")  # fmt: skip
def git_top_files(spark, d):
    return git.top_files(git.file_stats(tables.changes(spark, d), tables.commits(spark, d), NOW)).select("path", "commits", "rank")


@query(CHANGES + """, s AS (SELECT path, count(*)::BIGINT AS commits, sum(additions + deletions)::BIGINT AS churn FROM c GROUP BY path),
r AS (SELECT *, round(commits * ln(1 + churn), 9) AS score FROM s)
SELECT path, commits, churn, score, row_number() OVER (ORDER BY score DESC, path)::INTEGER AS rank FROM r ORDER BY rank LIMIT 20""")  # fmt: skip
def git_hotspots(spark, d):
    return git.hotspots(tables.changes(spark, d)).drop("project")


@query(CHANGES + """, u AS (SELECT commit FROM c GROUP BY commit HAVING count(*) BETWEEN 2 AND 30),
p AS (SELECT a.path AS a, b.path AS b, count(*)::BIGINT AS count FROM c a JOIN c b ON a.commit = b.commit AND a.path < b.path WHERE a.commit IN (SELECT commit FROM u) GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY count DESC, a, b)::INTEGER AS rank FROM p WHERE count >= 3 ORDER BY rank LIMIT 20""")  # fmt: skip
def git_cochange(spark, d):
    return git.cochanges(tables.changes(spark, d)).drop("project")


@query("""
WITH a AS (SELECT printf('src/%05d', o_custkey) AS path, o_orderstatus AS author, count(*) AS n FROM orders GROUP BY ALL),
r AS (SELECT path, arg_min(author, struct_pack(m := -n, author := author)) AS top_author, sum(n)::BIGINT AS commits, max(n) / sum(n) AS share FROM a GROUP BY path)
SELECT *, row_number() OVER (ORDER BY share DESC, commits DESC, path)::INTEGER AS rank FROM r WHERE commits >= 5 AND share >= 0.75 ORDER BY rank LIMIT 10""")  # fmt: skip
def git_bus_factor(spark, d):
    return git.bus_factor(*tables.ownership(spark, d)).drop("project")


@query("""
SELECT o_orderkey::BIGINT AS id, 'a' || chr(9) || o_custkey AS author, count(l_orderkey)::BIGINT AS files, coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS additions,
       coalesce(sum(l_linenumber), 0)::BIGINT AS deletions FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")  # fmt: skip
def gitlog_parse(spark, d):
    """A log is rendered from orders and their lines, with binary files and rubbish, and parsed again."""
    tab = F.lit("\t")
    head = tables.table(spark, d, "orders").select(
        (F.col("o_orderkey") * 100).alias("line_no"), F.concat(F.lpad(F.hex("o_orderkey"), 40, "0"), tab, F.lit("a"), tab, F.col("o_custkey").cast("string"), tab, F.lit("1700000000\r")).alias("value")
    )
    line = tables.table(spark, d, "lineitem")
    at = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 3
    change = line.select(at.alias("line_no"), F.concat_ws("\t", F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string"), F.concat(F.lit("src/{old => new}/"), tables.whole(F.col("l_partkey")), F.lit(".rs"))).alias("value"))
    binary = line.select((at + 1).alias("line_no"), F.lit("-\t-\tlogo.png").alias("value"))
    log = head.unionByName(change).unionByName(binary).withColumn("project", F.pmod(F.floor(F.col("line_no") / 100), F.lit(16)).cast("string"))
    parsed = stored(git.parsed_log(log), "parsed-log")
    n = git.changes_of(parsed).groupBy("project", "commit").agg(F.count_if(F.rlike("path", F.lit(r"^src/new/\d+\.rs$"))).alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    rows = git.commits_of(parsed).join(n, ["project", "commit"], "left").fillna(0)
    return rows.select(F.expr("commit div 100").alias("id"), "author", "files", "additions", "deletions")


PATHS = ["old.ts => new.ts", "src/{a => b}/mod.rs", "a/{x.ts => y.ts}", "a/{ => sub}/f.rs", "{old => }/f.rs", '"quoted.rs"', "plain.rs", "src\\win\\p.rs"]
NEW_PATHS = ["new.ts", "src/b/mod.rs", "a/y.ts", "a/sub/f.rs", "/f.rs", "quoted.rs", "plain.rs", "src/win/p.rs"]


def _values(*rows: tuple) -> str:
    def literal(x):
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return str(x).upper() if isinstance(x, bool) else str(x)

    return ", ".join(f"({', '.join(map(literal, r))})" for r in rows)


@query(f"SELECT * FROM (VALUES {_values(*zip(PATHS, NEW_PATHS, strict=True))}) t(path, new)")
def rename_paths(spark, d):
    return spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", git.new_path(F.col("path")).alias("new"))


NOISE = {
    "package-lock.json": "lockfile", "a/Cargo.lock": "lockfile", "x.min.js": "generated", "a/b.d.ts": "generated", "a/gen/s.json": "generated",
    "generated/x.ts": "generated", "app-schema.json": "generated", "src/app.tsx": None, "src/regen/a.ts": None,
}


@query(f"SELECT * FROM (VALUES {_values(*((k, v, k in ('package-lock.json', 'a/Cargo.lock', 'x.min.js')) for k, v in NOISE.items()))}) t(path, noise, git_noise)")
def noise_paths(spark, d):
    return spark.createDataFrame([(p,) for p in NOISE], "path string").select("path", files.noise_reason(F.col("path")).alias("noise"), files.git_noise(F.col("path")).alias("git_noise"))


LANGUAGES = [("rs", "Rust"), ("TSX", "TypeScript"), ("hh", "C++"), ("cfg", "Config"), ("zsh", "Shell"), ("exe", None)]


@query(f"SELECT * FROM (VALUES {_values(*LANGUAGES)}) t(ext, language)")
def languages(spark, d):
    return spark.createDataFrame([(e,) for e, _ in LANGUAGES], "ext string").select("ext", files.language_of(F.col("ext")).alias("language"))


# Lines

RENDERED = """
WITH r AS (SELECT o_orderkey::BIGINT AS k, o_custkey::BIGINT AS c, printf('p%02d', o_custkey % 20) AS project, printf('src/o%d.ts', o_orderkey) AS path,
                  (o_orderkey % 13 + 1)::BIGINT AS ifs, (o_custkey % 3 = 0)::BIGINT AS comment, (o_custkey % 5 = 0)::BIGINT AS blank FROM orders)
"""


@query(RENDERED + "SELECT project, path, 6 + ifs + comment + blank AS lines, blank, comment, 6 + ifs AS code FROM r")
def line_counts(spark, d):
    return files.with_line_counts(tables.rendered(spark, d)).select("project", "path", "lines", "blank", "comment", "code")


@query("""SELECT source AS project, 'Markdown' AS language, count(*)::BIGINT AS files,
sum(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) - suffix(text, chr(10))::INTEGER END)::BIGINT AS lines FROM documents GROUP BY 1""")  # fmt: skip
def language_stats(spark, d):
    return files.language_stats(files.with_line_counts(tables.documents(spark, d)))


@query(RENDERED + """SELECT project, count(*)::BIGINT AS files, sum(6 + ifs + comment + blank)::BIGINT AS lines, sum(6 + ifs)::BIGINT AS code, sum(comment)::BIGINT AS comment,
sum(blank)::BIGINT AS blank, 0::BIGINT AS ignored, 0::BIGINT AS huge_files, round(avg(6 + ifs + comment + blank), 9) AS average_lines FROM r GROUP BY 1""")  # fmt: skip
def project_totals(spark, d):
    return files.project_totals(files.with_line_counts(tables.rendered(spark, d))).drop("bytes").withColumn("average_lines", F.round("average_lines", 9))


@query("""WITH f AS (SELECT o_orderkey % 3 = 0 AS noise, o_orderkey FROM orders)
SELECT count(*) FILTER (NOT noise)::BIGINT AS files, count(*) FILTER (noise)::BIGINT AS ignored, sum(len('let a = ' || o_orderkey || ';'))::BIGINT AS bytes, count(*) FILTER (NOT noise)::BIGINT AS lines FROM f""")  # fmt: skip
def noise_split(spark, d):
    o = tables.table(spark, d, "orders")
    path = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "generated/f").otherwise("src/f"), F.col("o_orderkey").cast("string"), F.lit(".ts"))
    raw = o.select(F.lit("p").alias("project"), path.alias("path"), F.concat(F.lit("let a = "), F.col("o_orderkey").cast("string"), F.lit(";")).alias("content"))
    return files.project_totals(files.with_line_counts(files.as_files(raw))).select("files", "ignored", "bytes", "lines")


LINES = "WITH l AS (SELECT source AS project, printf('%s/d%08d.md', lang, doc_id) AS path, len(string_split(text, chr(10)))::BIGINT AS lines FROM documents)"


@query(LINES + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY lines DESC, path)::INTEGER AS rank FROM l) WHERE rank <= 15")
def largest_files(spark, d):
    return files.largest_files(files.with_line_counts(tables.documents(spark, d)))


@query(LINES + "SELECT project, count(*) FILTER (lines > 400)::BIGINT AS huge_files FROM l GROUP BY 1")
def huge_files(spark, d):
    return files.project_totals(files.with_line_counts(tables.documents(spark, d))).select("project", "huge_files")


COMMENTED = [
    ("a.ts", "// x\n\n/* a\n\nb */\nlet a; /* no\n/* one */ let b;\n", 7, 2, 4),
    ("b.py", "# x\n\n  # y\nx = 1", 4, 1, 2),
    ("c.lua", "--[[ a\nb ]]\nlocal x\n-- y\r\n", 4, 0, 2),
    ("d.rb", "=begin\nx\n=end\ny\n", 4, 0, 3),
    ("e.html", "<!-- a\nb -->\n<p>\n", 3, 0, 2),
    ("f.sql", "-- a\n/* b\n*/ select 1\nselect 2", 4, 0, 3),
    ("g.json", "// a\n\n", 2, 1, 0),
    ("h.ts", "", 0, 0, 0),
]


@query(f"SELECT * FROM (VALUES {_values(*((p, *n) for p, _, *n in COMMENTED))}) t(path, lines, blank, comment)")
def comment_lines(spark, d):
    raw = spark.createDataFrame([("p", p, c) for p, c, *_ in COMMENTED], "project string, path string, content string")
    return files.with_line_counts(files.as_files(raw)).select("path", "lines", "blank", "comment")


# Duplication

DUPLICATES = r"""
WITH raw AS (SELECT source AS project, printf('%s/d%08d.md', lang, doc_id) AS path, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT project, path, generate_subscripts(ls, 1) AS n, trim(unnest(ls)) AS raw FROM raw),
k AS (SELECT project, path, n, regexp_replace(raw, '\s+', ' ', 'g') AS line FROM l
      WHERE raw <> '' AND NOT starts_with(raw, '<!--') AND length(regexp_replace(raw, '[^\p{L}\p{N}]', '', 'g')) >= 3 AND strlen(regexp_replace(raw, '\s+', ' ', 'g')) >= 12),
m0 AS (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY n) - 1 AS pos FROM k),
w AS (SELECT project, path, pos AS start, list(line) OVER x AS run FROM m0 WINDOW x AS (PARTITION BY project, path ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
f AS (SELECT project, path, start, sha256(array_to_string(run, chr(10))) AS fp FROM w WHERE len(run) = 6),
g AS (SELECT *, count(*) OVER (PARTITION BY project, fp) AS occurrences, row_number() OVER (PARTITION BY project, fp ORDER BY path, start) AS nth FROM f)
"""


@query(DUPLICATES + "SELECT project, count(*)::BIGINT AS windows, count(DISTINCT fp)::BIGINT AS different, count(*) FILTER (occurrences > 1)::BIGINT AS repeated FROM g GROUP BY 1")
def dup_windows(spark, d):
    lines = stored(duplication.normal_lines(tables.documents(spark, d)), "normal-lines")
    w = duplication.windows(lines)
    like = stored(duplication.confirmed(duplication.suspected(w), lines), "confirmed")
    again = duplication.repeated(like).groupBy("project").agg(F.count("*").alias("repeated"))
    # A window without a like has a text of its own.
    texts = like.groupBy("project").agg((F.count("*") - F.countDistinct("fp")).alias("less"))
    rows = w.groupBy("project").agg(F.count("*").alias("windows")).join(again, "project", "left").join(texts, "project", "left").fillna(0)
    return rows.select("project", "windows", (F.col("windows") - F.col("less")).alias("different"), "repeated")


@query(DUPLICATES + """, m AS (SELECT DISTINCT project, path, unnest(range(start, start + 6)) AS pos FROM g WHERE occurrences > 1 AND nth > 1),
c AS (SELECT source AS project, sum(len(string_split(text, chr(10))) - len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '')))::BIGINT AS code FROM documents GROUP BY 1),
n AS (SELECT project, count(*)::BIGINT AS masked FROM m GROUP BY 1)
SELECT project, coalesce(masked, 0) AS masked, round(least(1.0, coalesce(masked, 0) / code), 9) AS ratio FROM c LEFT JOIN n USING (project)""")  # fmt: skip
def dup_ratio(spark, d):
    docs = tables.documents(spark, d)
    code = files.with_line_counts(docs).groupBy("project").agg(F.sum("code").alias("code"))
    lines = stored(duplication.normal_lines(docs), "normal-lines")
    again = duplication.repeated(duplication.windows(lines), lines)
    return duplication.duplicate_ratio(again, code).withColumn("ratio", F.round("ratio", 9))


@query(DUPLICATES + """, i AS (SELECT *, start - row_number() OVER (PARTITION BY project, path ORDER BY start) AS run FROM g WHERE occurrences > 1 AND nth = 1),
b AS (SELECT project, path, run, max(start) - min(start) + 6 AS line_count, max(occurrences) AS occurrences, min(start) AS start, arg_min(fp, start) AS fingerprint FROM i GROUP BY ALL),
p AS (SELECT i.project, i.path, i.run, count(DISTINCT o.path) AS files FROM i JOIN g o ON o.project = i.project AND o.fp = i.fp GROUP BY ALL)
SELECT project, line_count::BIGINT AS line_count, occurrences::BIGINT AS occurrences, files::BIGINT AS files, fingerprint,
       row_number() OVER (PARTITION BY project ORDER BY occurrences * line_count DESC, path, start)::INTEGER AS rank
FROM b JOIN p USING (project, path, run) WHERE files >= 2 OR line_count >= 12 QUALIFY rank <= 20""")  # fmt: skip
def dup_blocks(spark, d):
    lines = stored(duplication.normal_lines(tables.documents(spark, d)), "normal-lines")
    rows = duplication.blocks(duplication.repeated(duplication.windows(lines), lines))
    return rows.select("project", F.col("line_count").cast("long").alias("line_count"), "occurrences", F.size("files").cast("long").alias("files"), "fingerprint", "rank")


# Secrets

ASSIGN = rules.ASSIGNED_SECRET.replace("'", "''")
SECRET_LINES = f"""
WITH l AS (SELECT source AS project, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
a AS (SELECT project, doc_id, regexp_extract(line, '{ASSIGN}', 2) AS value FROM l WHERE regexp_matches(line, '{ASSIGN}')),
v AS (SELECT * FROM a WHERE NOT regexp_matches(value, '{rules.PLACEHOLDER}')),
p AS (SELECT project, doc_id, value, list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: -(len(list_filter(string_split(value, ''), lambda y: y = c)) / len(value)) * log2(len(list_filter(string_split(value, ''), lambda y: y = c)) / len(value)))) AS bits FROM v)
"""


@query(SECRET_LINES + "SELECT project, count(*) FILTER (bits >= 3.5 AND len(value) >= 20)::BIGINT AS random, count(*) FILTER (NOT (bits >= 3.5 AND len(value) >= 20))::BIGINT AS plain FROM p GROUP BY 1")
def secrets_assigned(spark, d):
    found = secrets.secrets(tables.documents(spark, d), assigned_only=True)
    return found.groupBy("project").agg(F.count_if(F.col("severity") == "high").alias("random"), F.count_if(F.col("severity") != "high").alias("plain"))


KEYS = [
    ("src/config.ts", f'const a = "ghp_{"a1" * 18}";', "GitHub token", "high"),
    ("src/b.ts", 'api_key = "your-api-key-here"', None, None),
    ("src/c.ts", 'secret: "abcdefghijklmnopqrstuvwx"', "High-entropy secret", "high"),
    ("src/d.ts", "password = 'aaaabbbbcccc'", "Hardcoded secret", "medium"),
    ("src/e.ts", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "JWT committed to source", "medium"),
    ("server.cfg", "rcon_password hunter22", "RCON password in server.cfg", "high"),
    ("server2.cfg", "  sv_licenseKey abc123", "FiveM license key", "high"),
    ("server3.cfg", "steam_webApiKey 99AA", "Steam Web API key", "high"),
    ("notes.md", "rcon_password hunter22", None, None),
    ("tests/fixtures/k.ts", f'k = "npm_{"b2" * 18}"', "npm token", "low"),
    ("src/f.py", "-----BEGIN RSA PRIVATE KEY-----", "Private key material", "high"),
    ("src/g.py", f"AKIA{'Z' * 16}", "AWS access key", "high"),
    ("src/h.py", f"SK{'0a' * 16}", "Twilio key", "medium"),
]


@query(f"SELECT * FROM (VALUES {_values(*((p, 1, k, s) for p, _, k, s in KEYS if k))}) t(path, line, kind, severity)")
def secrets_rules(spark, d):
    raw = spark.createDataFrame([("p", p, c) for p, c, *_ in KEYS], "project string, path string, content string")
    return secrets.secrets(files.as_files(raw)).select("path", "line", "kind", "severity")


@query(SECRET_LINES + """SELECT project, count(*) FILTER (bits >= 3.5 AND len(value) >= 20)::BIGINT AS high, count(*) FILTER (NOT (bits >= 3.5 AND len(value) >= 20))::BIGINT AS medium,
0::BIGINT AS low, count(*)::BIGINT AS total FROM p GROUP BY 1""")  # fmt: skip
def secrets_severity(spark, d):
    """Secrets of all kinds; the SQL knows assigned values only, which on the given tables is all there is."""
    return secrets.severity_counts(secrets.secrets(tables.documents(spark, d)))


# Functions

FUNCTIONS = """, f AS (SELECT project, path, 'f' || k AS name, 1 + comment + blank AS start, 4 + ifs AS length, 3 + ifs AS complexity, 0 AS ord FROM r
UNION ALL SELECT project, path, 'g' || k, 5 + comment + blank + ifs, 1, 1, 1 FROM r)"""


@query(RENDERED + FUNCTIONS + " SELECT project, path, name, start, length, complexity FROM f")
def fn_complexity(spark, d):
    rows = functions.functions(tables.rendered(spark, d))
    return rows.select("project", "path", "name", *(F.col(c).cast("long").alias(c) for c in ("start", "length", "complexity")))


@query(RENDERED + FUNCTIONS + """ SELECT * FROM (SELECT project, path, name, complexity, row_number() OVER (PARTITION BY project ORDER BY complexity DESC, path, ord)::INTEGER AS rank
FROM f WHERE complexity >= 8) WHERE rank <= 30""")  # fmt: skip
def complex_functions(spark, d):
    rows = functions.complex_functions(functions.functions(tables.rendered(spark, d)))
    return rows.select("project", "path", "name", F.col("complexity").cast("long").alias("complexity"), "rank")


@query(RENDERED + "SELECT project, path, 'f' || k AS longest_name, 4 + ifs AS longest, 2 + comment + blank AS longest_line, 2::BIGINT AS functions FROM r")
def longest_of_file(spark, d):
    rows = functions.longest_of_file(functions.functions(tables.rendered(spark, d)))
    return rows.select("project", "path", "longest_name", F.col("longest").cast("long").alias("longest"), F.col("longest_line").cast("long").alias("longest_line"), "functions")


TS = """function big(a, b) {
  if (a && b) { a = 1; }
  for (const x of a) { b = x ?? 2; }
  while (a) { a = b?.c; }
  const s = "if (x) while"; // if for
  switch (a) {
    case 1:
    case 2:
      break;
  }
  try { f(); } catch (e) { g(); }
  return a || b ? 1 : 2;
}
const short = (x) => x + 1;
const chain = (x) =>
  x.filter((y) => y > 1)
    .map((y) => y);
const braced = async (x) => {
  return x;
};
"""
PY = 'def a(x):\n    if x and 1:\n        return "if"\n    # for\n    for y in x:\n        pass\n\n    return 1\n\nasync def b():\n    """while\n    if"""\n    pass\n'
LUA = "local function outer(a)\n  for i = 1, 2 do\n    if a then x() end\n  end\n  local inner = function(b)\n    repeat y() until b\n  end\nend\nfunction M.quick() return 1 end\n"
RUST = "fn one(x: &'static str) -> u8 {\n    // if\n    match x { \"if\" => 1, _ => loop { break 2; } }\n}\n"
JAVA = "class A {\n  public int go(int x) {\n    if (x > 1 || x < 0) { return 1; }\n    return 2;\n  }\n}\n"
MEASURED = [
    ("a.ts", "big", 0, 13, 10), ("a.ts", "short", 13, 1, 1), ("a.ts", "chain", 14, 3, 1), ("a.ts", "braced", 17, 3, 1),
    ("b.py", "a", 0, 8, 4), ("b.py", "b", 8, 1, 1),
    ("c.lua", "outer", 0, 8, 4), ("c.lua", "M.quick", 8, 1, 1), ("c.lua", "inner", 4, 3, 2),
    ("d.rs", "one", 0, 4, 3), ("e.java", "go", 1, 4, 3),
]


@query(f"SELECT * FROM (VALUES {_values(*MEASURED)}) t(path, name, start, length, complexity)")
def fn_fixtures(spark, d):
    raw = [("p", "a.ts", TS), ("p", "b.py", PY), ("p", "c.lua", LUA), ("p", "d.rs", RUST), ("p", "e.java", JAVA)]
    return functions.functions(files.as_files(spark.createDataFrame(raw, "project string, path string, content string"))).select("path", "name", "start", "length", "complexity")


@query("""SELECT printf('p%02d', o_custkey % 20) AS project, count(*)::BIGINT AS long_functions FROM orders WHERE o_orderkey % 120 > 48 GROUP BY 1""")
def long_functions(spark, d):
    o = tables.dealt(tables.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    body = F.repeat(F.lit("  a();\n"), (F.col("o_orderkey") % 120).cast("int"))
    raw = o.select(F.format_string("p%02d", F.col("o_custkey") % 20).alias("project"), F.format_string("o%d.go", F.col("o_orderkey")).alias("path"), F.concat(F.lit("func f() {\n"), body, F.lit("}\n")).alias("content"))
    rows = functions.longest_of_file(functions.functions(files.as_files(raw)))
    return rows.where("long_functions > 0").groupBy("project").agg(F.sum("long_functions").alias("long_functions"))


# Evidence

SOURCES = [
    ("client/src/App.tsx", 'import React from "react";\nconst r = useRoomManager();\nexport default App;', "client", "react_root", "websocket:indirect:ws_consumer:2"),
    ("server/index.ts", 'import http from "http";\nconst s = http.createServer(app);\nconst w = new WebSocketServer({ server: s });', "server", "node_server", "websocket:direct:ws_server:3 http_server:direct:http_listen:2"),
    ("src/components/icons.tsx", "switch (n) {}\n" + "<svg><path/></svg>\n" * 3, "client", "react_icon", ""),
    ("src/components/VideoDialog.tsx", "v.srcObject = s;", "client", "react_dialog", "webrtc:indirect:webrtc_media:1"),
    ("client/net.ts", "const a = 1;\nconst w = new WebSocket(url);", "client", "utility", "websocket:direct:ws_client:2"),
    ("lib/x.ts", "// new RTCPeerConnection heartbeat\nsetTimeout(f, 1);", "shared", "utility", "timers:indirect:timer_lifecycle:2"),
    ("lib/y.ts", 'const p = "new WebSocketServer";', "server", "utility", ""),
    ("server/auth.ts", "admin.auth().verifyIdToken(t); auth.setCustomUserClaims(u);", "server", "node_service", "firebase_admin:direct:firebase_admin:1 token_verify:direct:token_verify:1 claims:direct:claims:1"),
    ("lib/z.rs", "new WebSocketServer fetch(", "shared", "other", ""),
    ("client/main.lua", "RegisterNetEvent('x')", "client", "fivem_client_script", "fivem_events:direct:event_register:1"),
    ("fxmanifest.lua", "fx_version 'x'", "shared", "fivem_manifest", ""),
    ("util.lua", "return 1", "shared", "lua_module", ""),
    ("src/useThing.ts", "x", "shared", "react_hook", ""),
    ("vite.config.ts", "x", "shared", "config", ""),
    ("a.types.ts", "x", "shared", "types", ""),
]


@query(f"SELECT * FROM (VALUES {_values(*((p, r, k, e) for p, _, r, k, e in SOURCES))}) t(path, runtime, file_type, evidence)")
def classification(spark, d):
    raw = spark.createDataFrame([("p", p, c) for p, c, *_ in SOURCES], "project string, path string, content string")
    one = lambda r: F.concat_ws(":", r["kind"], r["evidence"], r["label"], r["line"].cast("string"))
    return evidence.classified(files.as_files(raw)).select("path", "runtime", "file_type", F.array_join(F.transform("responsibilities", one), " ").alias("evidence"))


SYMBOLS = [("src/useRoom.ts", "f", "useRoom"), ("src/Card.tsx", "f", "Card"), ("src/util.ts", "helper", "helper"), ("src/util.ts", "", "util"), ("a/b.c.ts", None, "b.c")]


@query(f"SELECT * FROM (VALUES {_values(*SYMBOLS)}) t(path, longest, symbol)")
def primary_symbol(spark, d):
    rows = spark.createDataFrame([s[:2] for s in SYMBOLS], "path string, longest string")
    return rows.select("path", "longest", evidence.primary_symbol(F.col("path"), F.col("longest")).alias("symbol"))


@query(RENDERED + "SELECT project, path, 2 + comment + blank AS line FROM r")
def declaration_lines(spark, d):
    rows = tables.rendered(spark, d)
    name = F.concat(F.lit("f"), F.regexp_extract("path", r"(\d+)\.ts$", 1))
    return rows.select("project", "path", evidence.declaration_line(F.col("content"), name).cast("long").alias("line"))


# Imports and their graph


@query(RENDERED + "SELECT project, path, 'f' || CASE WHEN k = 0 THEN '' ELSE (k - 1)::VARCHAR END || ',unused' || k AS names, './o' || (k - 1) AS source, 1 AS line, true AS relative FROM r")
def import_items(spark, d):
    return imports.imports(tables.rendered(spark, d)).select("project", "path", F.array_join("names", ",").alias("names"), "source", "line", "relative")


@query(RENDERED + "SELECT project, path, 'unused' || k AS name, 1 AS line FROM r")
def unused_imports(spark, d):
    return imports.unused_imports(tables.rendered(spark, d)).select("project", "path", "name", "line")


@query(RENDERED + "SELECT r.project, r.path AS src, p.path AS dst FROM r JOIN r p ON p.project = r.project AND p.k = r.k - 1")
def resolved_imports(spark, d):
    rows = tables.rendered(spark, d)
    return imports.resolved_imports(imports.imports(rows), rows).select("project", "src", "dst")


@query(RENDERED + "SELECT r.project, r.path, (count(n.k))::BIGINT AS fan_in FROM r LEFT JOIN r n ON n.project = r.project AND n.k = r.k + 1 GROUP BY 1, 2")
def fan_in(spark, d):
    rows = tables.rendered(spark, d)
    return imports.fan_in(imports.resolved_imports(imports.imports(rows), rows), rows)


BINDINGS = [
    ("a.ts", "import D, { a as b, c } from './x';", "b c D"), ("b.ts", "import * as ns from \"y\";", "ns"), ("c.ts", "import type { T } from 'z';", "T"),
    ("d.py", "from m import a as b, c", "b c"), ("e.py", "import a.b as q, os.path", "q os"), ("f.py", "from m import *", ""), ("g.lua", 'require("shared/config")', ""),
]


@query(f"SELECT * FROM (VALUES {_values(*((p, n) for p, _, n in BINDINGS))}) t(path, names)")
def import_bindings(spark, d):
    raw = files.as_files(spark.createDataFrame([("p", p, c) for p, c, _ in BINDINGS], "project string, path string, content string"))
    names = imports.imports(raw).groupBy("path").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "names"))), lambda x: x["names"])), " ").alias("names"))
    return raw.select("path").join(names, "path", "left").fillna("")


PLACES = [("src/a/x.ts", "./y", "src/a/y"), ("src/a/x.ts", "../b/z", "src/b/z"), ("x.ts", "../../q", "q"), ("src/a/x.ts", ".", "src/a"), ("a.ts", "./b/../c", "c")]


@query(f"SELECT * FROM (VALUES {_values(*PLACES)}) t(path, source, joined)")
def joined_paths(spark, d):
    rows = spark.createDataFrame([p[:2] for p in PLACES], "path string, source string")
    return rows.select("path", "source", imports.joined_path(F.col("path"), F.col("source")).alias("joined"))


PACKAGES = [
    ("a", "package.json", '{"scripts": {"dev": "x", "typecheck": "y", "build": "z"}}', "npm run typecheck && npm run build"),
    ("b", "app/package.json", '{"scripts": {"lint": "x", "test": "y"}}', "npm run lint && npm run test"),
    ("c", "package.json", "not json", "npm run build"), ("d", "x.ts", "let a", "npm run build"), ("e", "package.json", '{"scripts": {"tsc": "x"}}', "npm run tsc"),
]


@query(f"SELECT * FROM (VALUES {_values(*((p, c) for p, _, _, c in PACKAGES))}) t(project, commands)")
def verify_commands(spark, d):
    raw = files.as_files(spark.createDataFrame([p[:3] for p in PACKAGES], "project string, path string, content string"))
    return imports.verify_commands(raw).select("project", F.array_join("commands", " && ").alias("commands"))


EDGES = """
WITH RECURSIVE l AS (SELECT l_orderkey AS k, l_linenumber AS n, printf('s%05d', l_suppkey) AS s FROM lineitem),
e AS (SELECT a.s AS src, b.s AS dst, a.k, a.n FROM l a JOIN l b ON a.k = b.k AND b.n = a.n + 1 WHERE a.s <> b.s)"""


@query(EDGES + ", d AS (SELECT DISTINCT src, dst FROM e), r(a, b) AS (SELECT src, dst FROM d UNION SELECT r.a, d.dst FROM r JOIN d ON r.b = d.src) "
       "SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1")  # fmt: skip
def scc_cycles(spark, d):
    return graph.cycles_of(tables.imports(spark, d)).select("node", "component")


@query(EDGES + " SELECT dst AS path, count(*)::BIGINT AS fan_in, row_number() OVER (ORDER BY count(*) DESC, dst)::INTEGER AS rank "
       "FROM (SELECT * FROM e ORDER BY src, k, n, dst LIMIT 600) GROUP BY 1 ORDER BY rank LIMIT 6")  # fmt: skip
def top_imported(spark, d):
    return imports.top_imported(tables.imports(spark, d)).drop("project")


ALL_EDGES = EDGES


@query(ALL_EDGES + ", d AS (SELECT DISTINCT src, dst FROM e), r(a, b) AS (SELECT src, dst FROM d UNION SELECT r.a, d.dst FROM r JOIN d ON r.b = d.src) "
       "SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1")  # fmt: skip
def scc_cycles_all(spark, d):
    """The same; an older name."""
    return graph.cycles_of(tables.imports(spark, d)).select("node", "component")


@query(ALL_EDGES + " SELECT dst AS path, count(*)::BIGINT AS fan_in, row_number() OVER (ORDER BY count(*) DESC, dst)::INTEGER AS rank "
       "FROM (SELECT * FROM e ORDER BY src, k, n, dst LIMIT 600) GROUP BY 1 ORDER BY rank LIMIT 6")  # fmt: skip
def top_imported_all(spark, d):
    """The same; an older name."""
    return imports.top_imported(tables.imports(spark, d)).drop("project")


# Scores, findings, history

METRICS = """
WITH m AS (SELECT c_nationkey AS nation, (count(*) * 100)::DOUBLE AS code, (sum(c_custkey % 7))::DOUBLE AS comment, count(*)::DOUBLE AS functions, (count(*) FILTER (c_custkey % 11 = 0))::DOUBLE AS long_functions,
  (count(*) FILTER (c_custkey % 5 = 0)) / 100.0::DOUBLE AS duplicate_ratio, (count(*) FILTER (c_custkey % 3 = 0))::DOUBLE AS unused_imports, (count(*) FILTER (c_custkey % 17 = 0))::DOUBLE AS huge_files,
  (max(c_custkey) % 40)::DOUBLE AS max_fan_in, 150 + (min(c_custkey) % 90)::DOUBLE AS average_lines, (count(*) FILTER (c_custkey % 97 = 0))::DOUBLE AS high, (count(*) FILTER (c_custkey % 61 = 0))::DOUBLE AS medium,
  (count(*) FILTER (c_custkey % 31 = 0))::DOUBLE AS low, CASE WHEN c_nationkey % 2 = 0 THEN (count(*) FILTER (c_custkey % 13 = 0))::DOUBLE END AS high_complexity,
  CASE WHEN c_nationkey % 2 = 0 THEN 4 + (c_nationkey % 9)::DOUBLE END AS average_complexity, CASE WHEN c_nationkey % 3 = 0 THEN (c_nationkey % 6)::DOUBLE END AS cycles FROM customer GROUP BY c_nationkey),
x AS (SELECT *, CASE WHEN functions > 0 THEN long_functions / functions ELSE 0 END AS lr, CASE WHEN code > 0 THEN comment / code ELSE 0 END AS cr, unused_imports / greatest(code / 1000, 1) AS upk, high_complexity / nullif(functions, 0) AS hs FROM m),
s AS (SELECT nation,
  greatest(0, least(100, floor(0.5 + 100 - greatest(0, least(34, 180 * lr)) - greatest(0, least(22, (average_lines - 180) / 8)) - greatest(0, least(18, 2.2 * huge_files)) - CASE WHEN cr < 0.04 THEN 8 ELSE 0 END
    - greatest(0, least(18, 60 * duplicate_ratio)) - coalesce(CASE WHEN hs IS NOT NULL THEN least(20, 140 * hs) END, 0) - coalesce(CASE WHEN average_complexity > 6 THEN least(12, 3 * (average_complexity - 6)) END, 0))))::INTEGER AS maintainability,
  greatest(0, least(100, floor(0.5 + 100 - greatest(0, least(40, 220 * duplicate_ratio)) - greatest(0, least(30, 160 * lr)) - greatest(0, least(16, 6 * upk)) - greatest(0, least(14, 1.5 * huge_files)) - coalesce(CASE WHEN hs IS NOT NULL THEN least(18, 120 * hs) END, 0))))::INTEGER AS technical_debt,
  greatest(0, least(100, floor(0.5 + 100 - greatest(0, least(34, 2.2 * (max_fan_in - 8))) - greatest(0, least(24, 2.5 * huge_files)) - greatest(0, least(16, (average_lines - 160) / 10)) - greatest(0, least(14, 50 * duplicate_ratio)) - coalesce(CASE WHEN cycles IS NOT NULL THEN least(20, 4 * cycles) END, 0))))::INTEGER AS architecture_health,
  greatest(0, least(100, 100 - 28 * high - 10 * medium - 3 * low))::INTEGER AS security_risk FROM x),
t AS (SELECT *, floor(0.5 + round(0.28::DOUBLE * maintainability + 0.26::DOUBLE * technical_debt + 0.24::DOUBLE * architecture_health + 0.22::DOUBLE * security_risk, 9))::INTEGER AS project_score FROM s)
SELECT *, CASE WHEN project_score >= 90 THEN 'A' WHEN project_score >= 80 THEN 'B' WHEN project_score >= 70 THEN 'C' WHEN project_score >= 55 THEN 'D' ELSE 'F' END AS grade FROM t"""


@query(METRICS)
def scores(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    every = lambda m: F.count_if(k % m == 0).cast("double")
    m = tables.table(spark, d, "customer").groupBy(n.alias("nation")).agg(
        (F.count("*") * 100).cast("double").alias("code"), F.sum(k % 7).cast("double").alias("comment"), F.count("*").cast("double").alias("functions"), every(11).alias("long_functions"),
        (every(5) / 100).alias("duplicate_ratio"), every(3).alias("unused_imports"), every(17).alias("huge_files"), (F.max(k) % 40).cast("double").alias("max_fan_in"),
        (150 + F.min(k) % 90).cast("double").alias("average_lines"), every(97).alias("high"), every(61).alias("medium"), every(31).alias("low"), every(13).alias("hc"),
    )
    m = m.select(
        "*", F.when(F.col("nation") % 2 == 0, F.col("hc")).alias("high_complexity"), F.when(F.col("nation") % 2 == 0, 4.0 + F.col("nation") % 9).alias("average_complexity"),
        F.when(F.col("nation") % 3 == 0, F.col("nation") % 6).cast("double").alias("cycles"),
    )
    return scoring.scores(m).select("nation", "maintainability", "technical_debt", "architecture_health", "security_risk", "project_score", "grade")


REPORTS = "WITH r AS (SELECT o_orderkey::BIGINT AS id, printf('c%05d', o_custkey) AS project_path, epoch(o_orderdate)::BIGINT AS created_at, least(100, floor(o_totalprice / 4000))::INTEGER AS overall_score, o_orderkey % 2 = 0 AS has_ai FROM orders)"


@query(REPORTS + " SELECT id, project_path, created_at, overall_score, overall_score - lag(overall_score) OVER (PARTITION BY project_path ORDER BY created_at, id) AS overall_score_delta FROM r")
def score_trend(spark, d):
    return history.trends(tables.reports(spark, d), "overall_score")


@query(REPORTS + """ SELECT id, project_path, created_at, overall_score, CASE WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 80 THEN 'B' WHEN overall_score >= 70 THEN 'C' WHEN overall_score >= 55 THEN 'D' ELSE 'F' END AS grade, has_ai
FROM r ORDER BY created_at DESC, id DESC LIMIT 100""")  # fmt: skip
def report_list(spark, d):
    return history.report_list(tables.reports(spark, d).withColumn("grade", scoring.grade(F.col("overall_score"))))


@query(REPORTS + " SELECT printf('c%05d', c_custkey) AS path, count(id)::BIGINT AS report_count FROM customer LEFT JOIN r ON project_path = printf('c%05d', c_custkey) GROUP BY 1")
def project_list(spark, d):
    projects = tables.table(spark, d, "customer").select(F.format_string("c%05d", F.col("c_custkey")).alias("path"))
    return history.project_list(projects, tables.reports(spark, d))


@query("SELECT n_nationkey AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'new ' || n_name ELSE n_name END AS value FROM nation UNION ALL SELECT n_nationkey + 1000, 'added' FROM nation WHERE n_nationkey % 5 = 0")
def settings_upsert(spark, d):
    n = tables.table(spark, d, "nation")
    old = n.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("value"))
    new = old.where("key % 3 = 0").withColumn("value", F.concat(F.lit("new "), F.col("value"))).unionByName(old.where("key % 5 = 0").select((F.col("key") + 1000).alias("key"), F.lit("added").alias("value")))
    return history.upserted(old, new, "key")


BANDS = """SELECT o_orderkey::BIGINT AS id, score, CASE WHEN score >= 70 THEN 'P1' WHEN score >= 45 THEN 'P2' ELSE 'P3' END AS band,
CASE WHEN score >= 70 THEN least(69, score) WHEN score >= 45 THEN score ELSE greatest(45, score) END AS moved FROM (SELECT o_orderkey, (o_orderkey % 101)::INTEGER AS score FROM orders)"""


@query(BANDS)
def finding_bands(spark, d):
    rows = tables.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), (F.col("o_orderkey") % 101).cast("int").alias("score"))
    return rows.select("id", "score", findings.band(F.col("score")).alias("band"), findings.reconciled(F.col("score"), F.lit("P2")).alias("moved"))


def _file(path: str, **values) -> dict:
    return {
        "project": "p", "path": path, "ext": path.rpartition(".")[2], "language": "TypeScript", "noise_reason": None, "lines": 100, "file_type": "utility", "runtime": "shared", "responsibilities": [],
        "fan_in": 0, "longest": 10, "longest_name": "f", "longest_line": 1, "long_functions": 0, "symbol": "f", "symbol_line": 1,
    } | values


def _does(*kinds: str) -> list[tuple]:
    return [(k, "direct", k, "x", 1, "x") for k in kinds]


FILES = [
    _file("src/hooks/useRoomManager.ts", file_type="react_hook", runtime="client", lines=1007, longest=192, long_functions=6, fan_in=11, responsibilities=_does("websocket", "webrtc", "chat", "state_machine", "data_fetching")),
    _file("server/index.ts", file_type="node_server", runtime="server", lines=500, longest=90, responsibilities=_does("http_server", "routes")),
    _file("src/AdminPanel.tsx", file_type="react_feature", runtime="client", lines=400, responsibilities=_does("admin")),
    _file("src/icons.tsx", file_type="react_icon", lines=900),
    _file("src/big.ts", lines=700),
    _file("lib/main.rs", file_type="other", lines=2000, longest=200),
]
FILE_DDL = "project string, path string, ext string, language string, noise_reason string, lines long, file_type string, runtime string, responsibilities " + evidence.NONE + ", fan_in int, longest int, longest_name string, longest_line int, long_functions int, symbol string, symbol_line int"  # noqa: E501
FOUND = [
    ("god_hook:src/hooks/useRoomManager.ts", "P1", "high", 100, "high", "src/hooks/room/useSignalingSocket.ts", 6),
    ("god_server:server/index.ts", "P1", "high", 87, "high", "server/config.ts", 3),
    ("feature_component:src/AdminPanel.tsx", "P2", "high", 45, "low", "src/admin/AdminPanel.tsx", 3),
    ("icon_file:src/icons.tsx", "P2", "high", 45, "low", "lucide-react", 2),
    ("huge_file:src/big.ts", "P3", "high", 20, "low", "src/big.core.ts", 3),
    ("long_function:lib/main.rs", "P3", "high", 35, "low", None, 3),
]


@query(f"SELECT * FROM (VALUES {_values(*FOUND)}) t(id, priority, confidence, score, blast, first_step, prs)")
def file_findings(spark, d):
    rows = findings.file_findings(spark.createDataFrame([tuple(f.values()) for f in FILES], FILE_DDL))
    return rows.select("id", "priority", "confidence", "score", "blast", F.get("refactor", F.lit(0))["path"].alias("first_step"), F.size("prs").alias("prs"))


CAPPED = """
WITH f AS (SELECT o_custkey % 20 AS project, o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'P1' ELSE 'P2' END AS priority, CASE WHEN o_orderkey % 9 = 0 THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN o_orderkey % 12 = 0 THEN 'security' ELSE 'god_hook' END AS kind, CASE WHEN o_orderkey % 7 = 0 THEN 'informational' ELSE 'actionable' END AS category FROM orders),
a AS (SELECT *, CASE WHEN priority = 'P1' AND confidence <> 'high' AND kind <> 'security' THEN 'P2' ELSE priority END AS p FROM f),
b AS (SELECT *, p = 'P1' AND kind <> 'security' AND category = 'actionable' AS able, count(*) FILTER (category = 'actionable') OVER (PARTITION BY project) AS n_all FROM a),
c AS (SELECT *, CASE WHEN able AND row_number() OVER (PARTITION BY project, able ORDER BY n) > greatest(2, ceil(n_all * 0.3)) THEN 'P2' ELSE p END AS final FROM b)
SELECT project::VARCHAR AS project, kind, final AS priority, count(*)::BIGINT AS findings FROM c GROUP BY ALL"""


@query(CAPPED)
def p1_cap(spark, d):
    k = F.col("o_orderkey")
    rows = tables.table(spark, d, "orders").select(
        (F.col("o_custkey") % 20).cast("string").alias("project"), F.struct(F.lit(0).alias("group"), k.cast("int").alias("n")).alias("emit"),
        F.when(k % 3 == 0, "P1").otherwise("P2").alias("priority"), F.when(k % 9 == 0, "medium").otherwise("high").alias("confidence"),
        F.when(k % 12 == 0, "security").otherwise("god_hook").alias("kind"), F.when(k % 7 == 0, "informational").otherwise("actionable").alias("category"),
    )
    return findings.capped(rows).groupBy("project", "kind", "priority").agg(F.count("*").alias("findings"))


TEXTS = [(0, "0 B", "just now", "CASE-1970-0007"), (1536, "1.5 KB", "25m ago", "CASE-1970-0007"), (5_242_880, "5.0 MB", "60d ago", "CASE-1970-0007"), (1_700_000_000, "1.6 GB", "19675d ago", "CASE-2023-0007")]


@query(f"SELECT * FROM (VALUES {_values(*TEXTS)}) t(n, bytes, ago, number)")
def formats(spark, d):
    rows = spark.createDataFrame([(n,) for n, *_ in TEXTS], "n long")
    return rows.select("n", t.bytes_text(F.col("n")).alias("bytes"), t.time_ago(F.col("n")).alias("ago"), t.case_number("CASE", F.col("n"), F.lit(7)).alias("number"))


from . import more_queries  # noqa: E402, F401  registers its queries here
from . import source_queries  # noqa: E402, F401
