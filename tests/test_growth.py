"""What a query does once for each row of a table that grows."""

from pyspark.sql import functions as F

from lodestrata import rules
from lodestrata.functions.views import occurs_again
from lodestrata.operators import evidence, files, functions, git, graph, imports, secrets
from lodestrata.sources import tables


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_each_text_is_read_once(spark, folder):
    rows = tables.rendered(spark, folder)
    for found in (functions.functions(rows), imports.imports(rows), imports.unused_imports(rows)):
        assert _plan(found).count("ArrowEvalPython [") == 1


def test_a_symbol_is_found_without_a_join(spark, folder):
    """A file's longest function and its symbol come from its own row."""
    raw = [("p", "a.ts", "function b() {\n}\nfunction a() {\n}\n"), ("p", "useX.ts", "// const useX\nlet useX = 1;\nconst useX$ = 2;\n"), ("p", "n.lock.ts", "let x;\n"), ("p", "x.min.js", "function g() {}\n"), ("p", "F.tsx", "function aF() {}\n")]
    rows = files.as_files(spark.createDataFrame(raw, "project string, path string, content string")).unionByName(tables.rendered(spark, folder).coalesce(2))
    apart, own = evidence.classified(rows, functions.longest_of_file(functions.functions(rows))), evidence.classified(functions.with_longest(rows))
    assert _plan(apart).count("Join") > 0 and _plan(own).count("Join") == 0
    columns = ["project", "path", "symbol", "symbol_line", "file_type", "runtime"]
    got = own.select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, apart.select(columns).collect()))
    assert {(r.path, r.symbol, r.symbol_line) for r in got if r.project == "p"} == {("a.ts", "b", 1), ("useX.ts", "useX", 2), ("n.lock.ts", "n.lock", 0), ("x.min.js", "x.min", 0), ("F.tsx", "F", 1)}


def test_a_list_and_its_total_are_made_of_one_reading(spark, folder):
    listed = functions.complex_functions(functions.functions(tables.rendered(spark, folder)))
    assert "ArrowEvalPython [" not in _plan(listed) and listed.count() > 0


def test_rendered_texts_are_dealt_over_tasks(spark):
    keys = spark.range(2 * tables.ROWS_OF_TASK + 1).withColumnRenamed("id", "k").coalesce(1)
    assert tables.dealt(keys, "k").rdd.getNumPartitions() == 3
    assert tables.dealt(keys.limit(0), "k").rdd.getNumPartitions() == 1
    assert tables.dealt(keys, "k").agg(F.countDistinct("k")).first()[0] == 2 * tables.ROWS_OF_TASK + 1


def test_imports_meet_one_reading_and_numbers(spark, folder):
    """Few tasks read the table: they do not render, and do so once; stems are aggregated by hash, and a place is joined once."""
    rows = tables.rendered(spark, folder)
    edges = imports.resolved_imports(imports.imports(rows), rows)
    assert "SortAggregate" not in _plan(imports.fan_in(edges, rows))
    below = _plan(rows).split("Exchange")[1]
    assert "map(" not in below and "RLIKE" not in below
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_places_beside_a_file_are_those_that_folding_gives(spark):
    cases = {
        ("src/a/x.ts", "./y"): "src/a/y", ("x.ts", "./y"): "y", ("/a/x.ts", "./y"): "a/y", ("a//b/x.ts", "./y"): "a/b/y", ("a/x.ts", "./.."): "", ("a/x.ts", "./."): "a",
        ("a/x.ts", "./"): "a", ("a/x.ts", ".//y"): "a/y", ("a/x.ts", "./..y"): "a/..y", ("a/x.ts", "./b/../y"): "a/y", ("a/b", "./.x"): "a/.x", ("a/x.ts", "y"): "a/y",
    }
    rows = spark.createDataFrame(list(cases), "path string, source string")
    assert {(r.path, r.source): r.joined for r in rows.select("path", "source", imports.joined_path(F.col("path"), F.col("source")).alias("joined")).collect()} == cases


def test_lists_keep_their_order_and_totals(spark):
    rows = spark.createDataFrame([("p", i) for i in range(50)] + [("q", 3)], "project string, n int")
    got = files.list_of_project(rows, 2, F.col("n").desc()).orderBy("project", "rank").select("project", "n", "rank", "total").collect()
    assert [tuple(r) for r in got] == [("p", 49, 1, 50), ("p", 48, 2, 50), ("q", 3, 1, 1)]


def test_names_that_occur_again():
    for text, name, again in [("a a", "a", True), ("a ab $a a_", "a", False), ("b", "a", False), ("aa", "a", False), ("a.a", "a", True), ("\u00e9a a", "a", True), ("a", "a", False), ("x$ x$", "x$", True)]:
        assert occurs_again(text, name) is again, text


def test_unused_names_leave_the_text_behind(spark, folder):
    assert "regexp_extract_all" not in _plan(imports.unused_imports(tables.rendered(spark, folder)))


def test_lines_meet_the_rules_for_secrets_once(spark, folder):
    plan = secrets.secrets(tables.documents(spark, folder))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(rules.PLACEHOLDER) == 1


def test_a_log_is_cut_before_it_is_written(spark, monkeypatch):
    """A header counts for the blocks behind it; lines that say nothing are not written."""
    head = "a" * 40 + "\tme\t1700000000"
    rows = [("p", n, x) for n, x in [(1, head), (2, "rubbish"), (3, "-\t-\tlogo.png"), (3 * git.PLACES_OF_BLOCK, "1\t2\tx"), (9 * git.PLACES_OF_BLOCK, "3\t4\t{a => b}/y\r")]]
    written, stored = [], git.stored
    monkeypatch.setattr(git, "stored", lambda df, name: (written.append(df.count()), stored(df, name))[1])
    got = git.parsed_log(spark.createDataFrame(rows, "project string, line_no long, value string")).where("not is_header").select("commit", "path", "deletions").collect()
    assert written == [3] and sorted(map(tuple, got)) == [(1, "b/y", 4), (1, "x", 2)]


def test_pairs_are_made_of_numbers(spark):
    changes = spark.createDataFrame([("p", c, f"f{x}", 1, 1) for c in range(4) for x in (10, 9)], "project string, commit long, path string, additions long, deletions long")
    assert git.pair_sets(changes).schema["paths"].dataType.elementType.typeName() == "long"
    assert [(r.a, r.b, r["count"]) for r in git.cochanges(changes).collect()] == [("f10", "f9", 4)]


def test_rounds_of_cycles_meet_numbers_in_the_order_of_names(spark, monkeypatch):
    kinds, spread = [], graph._spread
    monkeypatch.setattr(graph, "_spread", lambda nodes, edges: (kinds.extend([nodes.dtypes, edges.dtypes]), spread(nodes, edges))[1])
    rows = spark.createDataFrame([(p, f"n{a}", f"n{b}") for p in "qp" for a, b in [(3, 1), (1, 2), (2, 3), (3, 5), (5, 4), (4, 5)]], "project string, src string, dst string")
    names, edges = graph._numbered(rows)
    assert [(r.project, r.node) for r in names.orderBy("id").collect()] == [(p, f"n{n}") for p in "pq" for n in range(1, 6)] and edges.count() == 12
    want = {(p, f"n{c}", f"n{n}") for p in "pq" for c, own in ((1, (1, 2, 3)), (4, (4, 5))) for n in own}
    assert {tuple(r) for r in graph.cycles_of(rows).collect()} == want
    assert {kind for columns in kinds for _, kind in columns} == {"bigint"}
