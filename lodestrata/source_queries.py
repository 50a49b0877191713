"""Queries of the sources: what is ignored, what exists, functions of large files."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import rules
from .functions import text as t
from .functions.tokens import ROLES
from .more_queries import FOREIGN, NOW, ORDERS, _by, _orders, _sized, num
from .operators import evidence, files, functions, git, imports
from .plans import findings, wording
from .queries import CHANGES, FUNCTIONS, RENDERED, _values, query
from .scratch import stored
from .sources import tables, tree

# Each customer's project has rules of its own; each order is a path, whose folder and name follow from its keys.
PATH_SQL = ORDERS + """, p AS (SELECT k, c, 'c' || c AS project, concat_ws('/', CASE k % 4 WHEN 0 THEN 'logs' WHEN 1 THEN 'sub/logs' WHEN 2 THEN 'sub' END, CASE WHEN k % 3 = 0 THEN 'd' || (c % 3) END,
  CASE k % 5 WHEN 0 THEN 'keep.ts' WHEN 1 THEN 'f' || k || '.gen.ts' ELSE 'f' || k || '.ts' END) AS path FROM o)"""


@query(PATH_SQL + """SELECT k, path FROM p
WHERE NOT CASE c % 4 WHEN 0 THEN starts_with(path, 'logs/')
                     WHEN 1 THEN starts_with(path, 'logs/') OR (path LIKE '%.gen.ts' AND NOT regexp_matches(path, '^sub/.*1\\.gen\\.ts$'))
                     WHEN 2 THEN regexp_matches(path, '(^|/)d[01]/') OR regexp_matches(path, '^sub/([^/]+/)*keep\\.ts$')
                     ELSE false END""")  # fmt: skip
def paths_not_ignored(spark, d):
    """Folders ignored as a whole, rules taken back below them in vain and elsewhere with effect, and nested rules."""
    own = ["logs/\n!logs/keep.ts\n!keep.ts", "/logs/\n*.gen.ts", "d[!2-9]/\n!d0/keep.ts", "# none\n\n"]
    nested = ["!logs/", "!*1.gen.ts", "keep.ts", ""]
    folder = F.concat_ws("/", F.when(num() % 4 == 0, "logs").when(num() % 4 == 1, "sub/logs").when(num() % 4 == 2, "sub"), F.when(num() % 3 == 0, F.concat(F.lit("d"), (F.col("c") % 3).cast("string"))))
    name = F.when(num() % 5 == 0, "keep.ts").otherwise(F.concat(F.lit("f"), num().cast("string"), F.when(num() % 5 == 1, ".gen.ts").otherwise(".ts")))
    o = _orders(spark, d).withColumn("project", F.concat(F.lit("c"), F.col("c").cast("string")))
    paths = o.select("k", "project", F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name)).alias("path"))
    kind = F.col("c") % 4
    rules_ = o.select("project", "c").distinct()
    rules_ = rules_.select("project", F.lit(".gitignore").alias("path"), _by(kind, own).alias("content")).unionByName(rules_.select("project", F.lit("sub/.gitignore").alias("path"), _by(kind, nested).alias("content")))
    return paths.join(tree.not_ignored(paths.select("project", "path").distinct(), tree.ignored_by(rules_)), ["project", "path"], "left_semi").select("k", "path")


@query(CHANGES + f"""SELECT path, count(*)::BIGINT AS commits, count(DISTINCT author)::BIGINT AS authors, greatest(0, ({NOW} - max(ts)) // 86400)::BIGINT AS last_touched_days
FROM c JOIN o USING (commit) JOIN (SELECT DISTINCT printf('src/%05d', p_partkey) AS path FROM part WHERE p_size % 2 = 0) USING (path) GROUP BY path""")  # fmt: skip
def git_files_that_exist(spark, d):
    """Paths of the log that the inventory holds: parts of an even size."""
    held = tables.table(spark, d, "part").where("p_size % 2 = 0").select(F.lit("p").alias("project"), F.format_string("src/%05d", F.col("p_partkey")).alias("path"))
    parsed = tables.changes(spark, d).withColumn("is_header", F.lit(False))
    stats = git.file_stats(git.changes_of(parsed, held), tables.commits(spark, d), NOW)
    return stats.select("path", "commits", "authors", "last_touched_days")


LONG_SQL = """
WITH o AS (SELECT o_custkey::BIGINT AS c, o_orderkey::BIGINT AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders),
f AS (SELECT c, k, n, 3 + k % 7 AS own, CASE WHEN k % 7 > 0 THEN 1 + k % 7 ELSE 1 END AS decisions FROM o),
s AS (SELECT *, coalesce(sum(own) OVER (PARTITION BY c ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS start FROM f),
t AS (SELECT c, sum(own)::BIGINT AS lines, sum(decisions - 1)::BIGINT AS decisions FROM f GROUP BY c)
"""


@query(LONG_SQL + """SELECT c, 'f' || k AS name, start, own AS length, decisions AS complexity FROM s UNION ALL SELECT c, 'outer', 0, lines + 2, decisions + 1 FROM t""")
def functions_of_large_files(spark, d):
    """A file for each customer: all orders as functions inside one."""
    body = F.concat(F.lit("  fn f"), num().cast("string"), F.lit("() {\n"), F.repeat(F.lit("    if a { b(); }\n"), (num() % 7).cast("int")), F.lit("    // if while\n  }\n"))
    inner = _orders(spark, d).groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", body.alias("body")))), lambda x: x["body"]), "").alias("inner"))
    raw = inner.select(F.lit("p").alias("project"), F.format_string("f%d.rs", F.col("c")).alias("path"), F.concat(F.lit("fn outer() {\n"), F.col("inner"), F.lit("}\n")).alias("content"))
    rows = functions.functions(files.as_files(raw))
    whole = lambda c: F.col(c).cast("long").alias(c)
    return rows.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("c"), "name", whole("start"), whole("length"), whole("complexity"))


ROLE_ROWS = _values(*((n, k, e, label, token, not k.startswith("fivem_")) for n, (k, e, label, token) in enumerate(ROLES)))
ROLE_SQL = ORDERS + f""", r AS (SELECT *, dense_rank() OVER (ORDER BY first) AS place FROM (SELECT *, min(n) OVER (PARTITION BY kind) AS first FROM (VALUES {ROLE_ROWS}) t(n, kind, evidence, label, token, script))),
x AS (SELECT n AS shape, script, CASE WHEN script THEN regexp_replace(token, '''[^'']*''|"[^"]*"', '""', 'g') ELSE token END AS view FROM r),
h AS (SELECT shape, r.n, r.kind, r.evidence, r.label, r.place FROM x JOIN r ON r.script <= x.script AND contains(x.view, r.token)
      AND regexp_matches(' ' || x.view || ' ', CASE WHEN regexp_matches(r.token, '^[A-Za-z0-9_$]') THEN '[^A-Za-z0-9_$]' ELSE '' END || regexp_escape(r.token) || CASE WHEN regexp_matches(r.token, '[A-Za-z0-9_$]$') THEN '[^A-Za-z0-9_$]' ELSE '' END)),
b AS (SELECT shape, kind, place, arg_min(evidence || ':' || label, n) AS best FROM h GROUP BY ALL)
"""


def _token_files(spark, d):
    """A file for each order that holds the token of one role in code and that of the next in a comment."""
    role, next_ = num() % len(ROLES), (num() + 1) % len(ROLES)
    script = _by(role, [not k.startswith("fivem_") for k, *_ in ROLES])
    tokens = [token for *_, token in ROLES]
    comment = F.concat(F.when(script, "// ").otherwise("-- "), _by(next_, tokens), F.lit("\n"))
    content = F.concat(comment, F.repeat(F.lit("\n"), (num() % 3).cast("int")), F.lit("  "), _by(role, tokens), F.lit(" \n"))
    path = F.concat(F.lit("x/f"), num().cast("string"), F.when(script, ".ts").otherwise(".lua"))
    return _orders(spark, d).select("project", path.alias("path"), content.alias("content"))


@query(ROLE_SQL + f"""SELECT k, coalesce(string_agg(kind || ':' || best || ':' || (2 + k % 3), ' ' ORDER BY place), '') AS does FROM o LEFT JOIN b ON shape = k % {len(ROLES)} GROUP BY k""")
def responsibilities_of_tokens(spark, d):
    rows = evidence.classified(files.as_files(_token_files(spark, d)))
    one = lambda r: F.concat_ws(":", r["kind"], r["evidence"], r["label"], r["line"].cast("string"))
    return rows.select(F.regexp_extract("path", r"f(\d+)\.", 1).cast("long").alias("k"), F.array_join(F.transform("responsibilities", one), " ").alias("does"))


FORMAT_SQL = ORDERS + """, n AS (SELECT k, k * k * 37 % 5000000000 AS n, 1577836800 + k * 9001 AS since, k * k % 900000 AS ago FROM o),
v AS (SELECT *, CASE WHEN n < 1024 THEN NULL WHEN n < 1048576 THEN n / 1024.0::DOUBLE WHEN n < 1073741824 THEN n / 1048576.0::DOUBLE ELSE n / 1073741824.0::DOUBLE END AS v,
  CASE WHEN n < 1048576 THEN ' KB' WHEN n < 1073741824 THEN ' MB' ELSE ' GB' END AS unit FROM n)
"""


@query(FORMAT_SQL + r"""SELECT k, CASE WHEN v IS NULL THEN n || ' B' WHEN v >= 100 THEN floor(v + 0.5)::BIGINT || unit ELSE printf('%.1f', floor(v * 10 + 0.5) / 10) || unit END AS bytes,
CASE WHEN ago < 60 THEN 'just now' WHEN ago < 3600 THEN ago // 60 || 'm ago' WHEN ago < 86400 THEN ago // 3600 || 'h ago' WHEN ago < 604800 THEN ago // 86400 || 'd ago' ELSE strftime(make_timestamp(since * 1000000), '%b %d, %Y, %I:%M %p') END AS ago,
strftime(make_timestamp(since * 1000000), '%b %d, %Y, %I:%M %p') AS date, 'CASE-' || strftime(make_timestamp(since * 1000000), '%Y') || '-' || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS number,
n::VARCHAR AS plain FROM v""")  # fmt: skip
def formats_of_orders(spark, d):
    """Sizes, ages, dates and numbers of reports, from the keys of orders."""
    n, at, ago = num() * num() * 37 % 5_000_000_000, F.lit(1_577_836_800) + num() * 9001, num() * num() % 900_000
    rows = _orders(spark, d).select("k", t.bytes_text(n).alias("bytes"), t.time_ago(ago, at).alias("ago"), t.date_text(at).alias("date"), t.case_number("CASE", at, num()).alias("number"), t.number(n).alias("n"))
    return rows.select("k", "bytes", "ago", "date", "number", F.replace("n", F.lit(","), F.lit("")).alias("plain"))


@query(ORDERS + FOREIGN + """SELECT project, path, lines || ' Zeilen' AS first, 'Left out as generated' AS second FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY lines DESC, path) AS rank FROM f WHERE noise) WHERE rank <= 8""")
def worded_noise(spark, d):
    """Messages worded by a dictionary that has one of their keys."""
    rows = _sized(spark, d)
    ignored = files.top_of_project(rows.where("noise_reason is not null"), rules.TOP["ignored"], F.col("lines").desc(), F.col("path"))
    found = findings.noise_findings(ignored).withColumn("text", wording.worded(F.col("said"), {"ev.lines": "{lines} Zeilen"}))
    return found.select("project", F.col("file").alias("path"), F.get("text", F.lit(0)).alias("first"), F.get("text", F.lit(1)).alias("second"))


@query(ROLE_SQL + f"""SELECT k, coalesce(string_agg('seen ' || evidence || ' ' || label, '; ' ORDER BY place), '') AS said
FROM o LEFT JOIN (SELECT shape, place, split_part(best, ':', 1) AS evidence, split_part(best, ':', 2) AS label FROM b) ON shape = k % {len(ROLES)} GROUP BY k""")
def worded_evidence(spark, d):
    """What files do, in words of a dictionary for all of it."""
    rows = evidence.classified(files.as_files(_token_files(spark, d)))
    said = F.transform("responsibilities", lambda r: wording.message("ev.found", resp=F.concat(F.lit("resp."), r["label"]), how=F.concat(F.lit("ev."), r["evidence"])))
    words = {"ev.found": "seen {how} {resp}"} | {f"ev.{e}": e for e in ("direct", "indirect", "supporting")} | {f"resp.{label}": label for *_, label, _ in ROLES}
    return rows.select(F.regexp_extract("path", r"f(\d+)\.", 1).cast("long").alias("k"), F.array_join(wording.worded(said, words), "; ").alias("said"))


LUA_SQL = ORDERS + """, f AS (SELECT project, k, 'm/' || CASE WHEN k % 3 = 0 THEN 'd' || k || '/init.lua' ELSE 'd' || k || '.lua' END AS path FROM o)"""


@query(LUA_SQL + " SELECT f.project, f.path AS src, g.path AS dst FROM f JOIN f g ON g.project = f.project AND g.k = f.k - 1")
def resolved_lua_imports(spark, d):
    """Modules by dotted names, as files of their own or as folders."""
    name = F.concat(F.lit("m/d"), num().cast("string"), F.when(num() % 3 == 0, "/init.lua").otherwise(".lua"))
    content = F.concat(F.lit("local x = require('m.d"), (num() - 1).cast("string"), F.lit("')\nrequire 'none.such'\n"))
    rows = files.as_files(_orders(spark, d).select("project", name.alias("path"), content.alias("content")))
    return imports.resolved_imports(imports.imports(rows), rows).select("project", "src", "dst")


LANGUAGE_SQL = ORDERS + """, n AS (SELECT *, k % 7 AS n, k % 5 AS shape FROM o)"""


@query(LANGUAGE_SQL + """SELECT k, 'f' || k AS name, CASE shape WHEN 3 THEN 1 ELSE 0 END::BIGINT AS start, CASE shape WHEN 0 THEN 2 + 2 * n WHEN 1 THEN 3 + 2 * n WHEN 2 THEN 2 + n WHEN 3 THEN 3 + n ELSE 2 + 2 * n END AS length,
CASE shape WHEN 2 THEN 1 ELSE 1 + 2 * n END AS complexity FROM n""")  # fmt: skip
def functions_of_languages(spark, d):
    """A function for each order in Python, Lua, TypeScript, Java or Go: by indentation, keywords, expression and braces, with comments and literals that count for nothing."""
    many = lambda text: F.repeat(F.lit(text), (num() % 7).cast("int"))
    named = lambda before, after: F.concat(F.lit(before), num().cast("string"), F.lit(after))
    bodies = [
        F.concat(named("def f", "(a):\n"), many("    if a and b:\n        c('if')\n"), F.lit("    return 1\n\n# if\nx = 1\n")),
        F.concat(named("local function f", "(a)\n"), many("  if a then b() end\n  for i = 1, 2 do c('end') end\n"), F.lit("  -- end if\nend\nlocal x = 1\n")),
        F.concat(named("const f", " = (x) =>\n  x"), many("\n    .map((y) => y)"), F.lit(";\nlet z;\n")),
        F.concat(F.lit("class A {\n"), named("  public int f", "(int x) {\n"), many("    if (x > 1 || x < 0) { return 1; } // if\n"), F.lit("    return 2;\n  }\n}\n")),
        F.concat(named("func f", "() {\n"), many('  for a && b {\n  } // for\n'), F.lit("}\n")),
    ]
    path = F.concat(F.lit("f"), num().cast("string"), F.lit("."), _by(num() % 5, ["py", "lua", "ts", "java", "go"]))
    rows = functions.functions(files.as_files(_orders(spark, d).select("project", path.alias("path"), _by(num() % 5, bodies).alias("content"))))
    whole = lambda c: F.col(c).cast("long").alias(c)
    return rows.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("k"), "name", whole("start"), whole("length"), whole("complexity"))


SCRIPTS = ["typecheck", "type-check", "tsc", "build", "lint", "test"]
SCRIPT_SQL = ORDERS + """, b AS (SELECT k, list_filter(['typecheck', 'type-check', 'tsc', 'build', 'lint', 'test'], lambda x, i: (k >> (i - 1)) % 2 = 1) AS s FROM o),
c AS (SELECT k, s, list_filter([list_filter(['typecheck', 'type-check', 'tsc'], lambda x: list_contains(s, x))[1], CASE WHEN list_contains(s, 'build') THEN 'build' END], lambda x: x IS NOT NULL) AS main,
  list_filter(['lint', 'test'], lambda x: list_contains(s, x)) AS rest FROM b)"""


@query(SCRIPT_SQL + """SELECT k, array_to_string(list_transform(CASE WHEN len(main) > 0 THEN main WHEN len(rest) > 0 THEN rest ELSE ['build'] END, lambda x: 'npm run ' || x), ' && ') AS commands FROM c""")
def commands_of_packages(spark, d):
    """A package file for each order, with the scripts that the bits of its key name, and one further down that does not count."""
    scripts = F.array_join(F.array_compact(F.array(*(F.when(F.shiftright(num(), i) % 2 == 1, F.lit(f'"{x}": "x"')) for i, x in enumerate(SCRIPTS)))), ", ")
    top = F.concat(F.lit('{"scripts": {'), scripts, F.lit("}}"))
    project = F.concat(F.lit("p"), num().cast("string")).alias("project")
    raw = _orders(spark, d).select(project, F.lit("package.json").alias("path"), top.alias("content")).unionByName(_orders(spark, d).select(project, F.lit("a/package.json").alias("path"), F.lit('{"scripts": {"tsc": "x"}}').alias("content")))
    rows = imports.verify_commands(files.as_files(raw))
    return rows.select(F.substring("project", 2, 20).cast("long").alias("k"), F.array_join("commands", " && ").alias("commands"))


@query(ORDERS + """SELECT k, CASE k % 6 WHEN 0 THEN 'b' || k || ' c D' WHEN 1 THEN 'ns' || k WHEN 2 THEN 'T' || k WHEN 3 THEN 'b' || k || ' c' WHEN 4 THEN 'q' || k || ' os' ELSE '' END AS names,
CASE k % 6 WHEN 4 THEN 'a.b as q' || k WHEN 3 THEN 'm' ELSE './x' END AS source, CASE WHEN k % 6 IN (3, 4) THEN 1 ELSE 1 + k % 3 END::INTEGER AS line, k % 6 NOT IN (3, 4) AS relative FROM o WHERE k % 6 <> 5""")  # fmt: skip
def bindings_of_imports(spark, d):
    """Names bound by six shapes of imports; the last binds none and is listed nowhere. In Python blank lines before an import belong to it."""
    key = num().cast("string")
    shapes = [
        F.concat(F.lit("import D, { a as b"), key, F.lit(", c } from './x';")), F.concat(F.lit("import * as ns"), key, F.lit(" from \"./x\";")), F.concat(F.lit("import type { T"), key, F.lit(" } from './x';")),
        F.concat(F.lit("from m import a as b"), key, F.lit(", c")), F.concat(F.lit("import a.b as q"), key, F.lit(", os.path")), F.lit("from m import *"),
    ]
    path = F.concat(F.lit("f"), key, F.when(num() % 6 < 3, ".ts").otherwise(".py"))
    content = F.concat(F.repeat(F.lit("\n"), (num() % 3).cast("int")), _by(num() % 6, shapes))
    rows = imports.imports(files.as_files(_orders(spark, d).select("project", path.alias("path"), content.alias("content"))))
    first = rows.groupBy("path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "names"))), lambda x: x["names"])).alias("names"), F.min_by("source", "ord").alias("source"), F.min("line").alias("line"), F.min("relative").alias("relative"))
    return first.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("k"), F.array_join("names", " ").alias("names"), "source", "line", "relative")


@query(ORDERS + """SELECT k, concat_ws('/', CASE WHEN k % 5 < 3 THEN array_to_string(list_slice(['a', 'b' || c, 'd'], 1, 3 - k % 5), '/') END, 'x' || k) AS joined FROM o""")
def joined_sources(spark, d):
    """Sources that climb none to four folders from a file three folders deep, over empty and single dots."""
    path = F.concat(F.lit("a/b"), F.col("c").cast("string"), F.lit("/d/f.ts"))
    source = F.concat(F.lit("./"), F.repeat(F.lit("../"), (num() % 5).cast("int")), F.lit(".//x"), num().cast("string"))
    return _orders(spark, d).select("k", imports.joined_path(path, source).alias("joined"))


@query(RENDERED + FUNCTIONS + """ SELECT project, 'complex' AS list, least(count(*), 30)::BIGINT AS shown, count(*)::BIGINT AS total FROM f WHERE complexity >= 8 GROUP BY 1
UNION ALL SELECT project, 'long', least(count(*), 30)::BIGINT, count(*)::BIGINT FROM f WHERE length > 50 GROUP BY 1
UNION ALL SELECT project, 'unused', least(count(*), 60)::BIGINT, count(*)::BIGINT FROM r GROUP BY 1
UNION ALL SELECT r.project, 'dependencies', least(count(*), 600)::BIGINT, count(*)::BIGINT FROM r JOIN r p ON p.project = r.project AND p.k = r.k - 1 GROUP BY 1""")  # fmt: skip
def totals_of_lists(spark, d):
    """Lists of a project say how many rows they were cut from."""
    rows = tables.rendered(spark, d)
    found = stored(functions.functions(rows), "functions")
    lists = {
        "complex": functions.complex_functions(found), "long": functions.long_functions(found), "unused": imports.top_unused(imports.unused_imports(rows)),
        "dependencies": imports.listed(imports.resolved_imports(imports.imports(rows), rows)),
    }
    parts = [x.groupBy("project").agg(F.lit(name).alias("list"), F.count("*").alias("shown"), F.max("total").alias("total")) for name, x in lists.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).select("project", "list", "shown", "total")


NAME_SQL = ORDERS + r""", t AS (SELECT k, c, '/srv/r' || (c % 3) || CASE WHEN k % 2 = 0 THEN '\a\' ELSE '/a/' END || CASE k % 4 WHEN 0 THEN 'Möbel x.' WHEN 1 THEN 'plain.' WHEN 2 THEN 'a.b.' ELSE '' END || 'n' || k || CASE WHEN k % 5 = 0 THEN '' ELSE '.d.ts' END AS path,
  CASE k % 3 WHEN 0 THEN ' sk-' WHEN 1 THEN chr(160) || 'é key' || chr(9) ELSE '' END || k || chr(8195) AS key FROM o),
p AS (SELECT *, replace(path, '\', '/') AS slashed FROM t), b AS (SELECT *, regexp_extract(slashed, '[^/]*$') AS base FROM p)
"""


@query(NAME_SQL + r"""SELECT k, regexp_replace(key, '[^\x21-\x7E]', '', 'g') AS printable, regexp_replace(key, '[^A-Za-z0-9_.-]+', '_', 'g') AS file_name, trim(key, chr(160) || chr(8195) || chr(9) || ' ') AS trimmed,
length(regexp_replace(key, '[^\p{L}\p{N}]', '', 'g'))::INTEGER AS letters, CASE WHEN starts_with(slashed, '/srv/r1/') THEN substr(slashed, 9) ELSE slashed END AS normal,
CASE WHEN contains(base, '.') THEN regexp_replace(base, '\.[^.]*$', '') ELSE base END AS stem, split_part(base, '.', 1) AS first, regexp_replace(slashed, '/[^/]*$', '') AS folder, upper(left(base, 1)) || substr(base, 2) AS capital FROM b""")  # fmt: skip
def names_of_orders(spark, d):
    """Names, stems, folders and keys of paths and texts that hold other scripts, blanks of all kinds and backslashes."""
    path = F.concat(
        F.lit("/srv/r"), (F.col("c") % 3).cast("string"), F.when(num() % 2 == 0, "\\a\\").otherwise("/a/"), F.when(num() % 4 == 0, "Möbel x.").when(num() % 4 == 1, "plain.").when(num() % 4 == 2, "a.b.").otherwise(""),
        F.lit("n"), num().cast("string"), F.when(num() % 5 == 0, "").otherwise(".d.ts"),
    )
    key = F.concat(F.when(num() % 3 == 0, " sk-").when(num() % 3 == 1, "\xa0é key\t").otherwise(""), num().cast("string"), F.lit(" "))
    slashed = files.normal_path(path)
    return _orders(spark, d).select(
        "k", t.printable(key).alias("printable"), t.file_name(key).alias("file_name"), t.trimmed(key).alias("trimmed"), t.alphanumerics(key).alias("letters"), files.normal_path(path, "/srv/r1/").alias("normal"),
        t.stem(slashed).alias("stem"), t.first_name(slashed).alias("first"), t.directory(slashed).alias("folder"), t.capitalized(t.base_name(slashed)).alias("capital"),
    )
