"""Joins that prune first: pairs of frequent paths, fingerprints confirmed on the text, stems, messages and words."""

import itertools
import random
import re

from pyspark.sql import functions as F

from lodestrata import rules
from lodestrata.operators import duplication, git, imports
from lodestrata.plans import wording


def test_pairs_are_made_of_frequent_paths_only(spark):
    r = random.Random(2)
    commits = [sorted(set(r.choices(range(40), [1 / (n + 1) for n in range(40)], k=r.randint(1, 12)))) for _ in range(60)] + [list(range(31))] * 3
    rows = [("p", n, f"f{x}", 1, 1) for n, paths in enumerate(commits) for x in paths]
    changes = spark.createDataFrame(rows, "project string, commit long, path string, additions long, deletions long")
    usable = [paths for paths in commits if 2 <= len(paths) <= 30]
    counts = {x: sum(x in p for p in usable) for x in range(40)}
    want, made = {}, 0
    for paths in usable:
        made += len(list(itertools.combinations([x for x in paths if counts[x] >= 3], 2)))
        for a, b in itertools.combinations(sorted(f"f{x}" for x in paths), 2):
            want[a, b] = want.get((a, b), 0) + 1
    got = {(x.a, x.b): x["count"] for x in git.cochanges(changes, n=10_000).collect()}
    assert got == {k: n for k, n in want.items() if n >= 3}
    sizes = [len(x.paths) for x in git.pair_sets(changes).collect()]
    assert sum(n * (n - 1) // 2 for n in sizes) == made < sum(want.values())


def test_equal_fingerprints_of_different_texts_part(spark):
    """All windows get one fingerprint; the texts tell them apart."""
    lines = [("p", f"{n}.ts", [f"a line of file {n % 2} number {k}" for k in range(8)]) for n in range(4)] + [("p", "x.ts", [f"other line {k} of it" for k in range(6)])]
    table = spark.createDataFrame(lines, "project string, path string, lines array<string>")
    forced = duplication.windows(table, mix=lambda *h: F.lit(7).cast("long"))
    key = lambda rows: sorted((r.path, r.start, r.occurrences, r.canonical) for r in rows.collect())
    assert key(duplication.repeated(forced, table)) == key(duplication.repeated(duplication.windows(table), table)) == key(duplication.repeated(duplication.windows(table)))
    assert key(duplication.repeated(forced, table)) == sorted((f"{n}.ts", s, 2, n < 2) for n in range(4) for s in range(3))


def test_stems_equal_a_search_for_each_ending(spark):
    paths = ["a", "a.ts", "a.js", "a/index.ts", "a/index.js", "b/index.jsx", "b.vue", "c.lua", "c/init.lua", "d/init.lua", "e.ts.ts", "index.ts", "f.mjs", "f/index.tsx"]
    asked = ["a", "b", "c", "d", "e", "e.ts", "f", "", "a.ts", "c.lua", "none"]
    index = {(r.lua, r.stem): r.dst for r in imports.stem_index(spark.createDataFrame([("p", x) for x in paths], "project string, path string")).collect()}
    for lua, endings in ((False, imports.ENDINGS), (True, imports.LUA_ENDINGS)):
        for x in asked:
            assert index.get((lua, x)) == next((x + e for e in endings if x + e in paths), None)


def test_words_of_messages(spark):
    text = spark.createDataFrame([("a {how} `$1`", None, 4)], "snippet string, none string, n int")
    m = F.array(
        wording.message("ev.found", resp=F.lit("resp.routes"), how=F.lit("ev.direct"), token=F.lit("app.get("), place=F.lit(":3"), snippet=F.col("snippet")),
        wording.message("ev.lines", lines=F.col("n")), wording.message("no.key"), wording.message("ev.startsAt", name=F.col("none"), n=F.lit(2)), wording.message("x {n} {m}", n=F.col("n")),
    )
    own = {"resp.routes": "Routen", "ev.lines": "{lines} Zeilen"}
    got = text.select(wording.worded(m, own).alias("w")).first().w
    assert got == ["Routen, seen at work (app.get():3a {how} `$1`", "4 Zeilen", "no.key", " begins on line 2", "x 4 {m}"]
    say = wording.speaker(own)
    assert say("ev.found", resp="resp.routes", how="ev.direct", token="app.get(", place=":3", snippet="a {how} `$1`") == got[0]


def test_every_key_has_words():
    keys = {f"resp.{label}" for _, tiers in rules.RESPONSIBILITIES for _, label, _ in tiers} | {f"ev.{e}" for _, tiers in rules.RESPONSIBILITIES for e, *_ in tiers}
    keys |= {f"rstep.{n}" for rows in rules.REFACTOR.values() for _, n, _ in rows} | {f"pr.{n}" for rows in rules.PULL_REQUESTS.values() for n, _ in rows}
    assert keys <= set(wording.ENGLISH)
    assert not [v for v in wording.ENGLISH.values() if re.search(r"\b(ev|resp|rstep|pr|why|next|vrf)\.\w", v)]


def test_ways_without_cycles_go_before_colors(spark):
    """A tree into a ring and a tree out of it: what is colored is the ring."""
    from lodestrata.operators import graph

    tree = [(f"t{n}", f"t{n // 3}") for n in range(1, 200)] + [("t0", "r0")] + [("r1", "o1")] + [(f"o{n // 3}", f"o{n}") for n in range(3, 200)]
    edges = spark.createDataFrame([("p", a, b) for a, b in tree + [("r0", "r1"), ("r1", "r2"), ("r2", "r0")]], "project string, src string, dst string")
    kept, colored = graph.stored, []
    graph.stored = lambda df, name: (lambda out: (name == "colored" and colored.append(out.count()), out)[1])(kept(df, name))
    try:
        got = {(x.component, x.node) for x in graph.cycles_of(edges).collect()}
    finally:
        graph.stored = kept
    assert got == {("r0", "r0"), ("r0", "r1"), ("r0", "r2")} and max(colored) < 30
    long = spark.createDataFrame([("p", f"{n:04d}", f"{n + 1:04d}") for n in range(300)], "project string, src string, dst string")
    assert graph.cycles_of(long).collect() == []
