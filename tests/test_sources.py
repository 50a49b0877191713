import datetime as dt
import subprocess

from lodestrata.operators import git
from lodestrata.sources import gitlog, tree
from lodestrata.streaming import rescan


def write(root, path, data):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_tree(spark, tmp_path):
    write(tmp_path, "src/a.ts", "let a;\n")
    write(tmp_path, "src/b.bin", b"\0")
    write(tmp_path, "src/bad.ts", b"\xff\xfe")
    write(tmp_path, "src/large.ts", "x" * 2_000_001)
    write(tmp_path, "node_modules/x.js", "x")
    write(tmp_path, ".next/x.js", "x")
    write(tmp_path, ".gitignore", "# c\n*.gen.ts\n/logs/\n!keep.gen.ts\n")
    write(tmp_path, "sub/.gitignore", "deep.ts\n")
    write(tmp_path, ".git/HEAD", "ref: refs/heads/main\n")
    write(tmp_path, ".git/info/exclude", "local[0-9].ts\n\\#odd.ts\n")
    for p in ("local1.ts", "sub/local2.ts", "localx.ts", "#odd.ts", "a.gen.ts", "keep.gen.ts", "logs/l.ts", "sub/logs/l.ts", "sub/x/deep.ts", "deep.ts"):
        write(tmp_path, p, "let x;\n")
    spark.dataSource.register(tree.SourceTree)
    found, counts = tree.scan(spark.read.format("sourcetree").option("path", str(tmp_path)).option("project", "p").load())
    assert {r.path for r in found.collect()} == {"src/a.ts", "keep.gen.ts", "sub/logs/l.ts", "deep.ts", "localx.ts"}
    # Skipped: b.bin and two .gitignore of no known language, bad.ts that is not UTF-8, large.ts.
    c = counts.first()
    assert (c.seen, c.recognised, c.skipped, c.kept) == (10, 7, 5, 5)
    (tmp_path / ".git/HEAD").unlink()  # rules count in a work tree only
    found, _ = tree.scan(spark.read.format("sourcetree").option("path", str(tmp_path)).option("project", "p").load())
    assert {"a.gen.ts", "logs/l.ts", "sub/x/deep.ts", "local1.ts"} <= {r.path for r in found.collect()}
    plain = tree.raw_tree(spark, str(tmp_path), "p").where("length < 100")
    assert {"src/a.ts", "logs/l.ts"} <= {r.path for r in plain.collect()}


def test_git_source(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", tmp_path, "-c", "user.name=Ann", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init")
    write(tmp_path, "a.py", "x = 1\n")
    run("add", ".")
    run("commit", "-m", "one")
    spark.dataSource.register(gitlog.GitLog)
    log = spark.read.format("gitlog").option("path", f"{tmp_path},{tmp_path}/none").load()
    parsed = git.parsed_log(log)
    assert [r.author for r in git.commits_of(parsed).collect()] == ["Ann"]
    assert [(r.path, r.additions) for r in git.changes_of(parsed).collect()] == [("a.py", 1)]
    projects = log.select("project").distinct()
    told = {r.project: (r.available, r.reason) for r in git.status(git.commits_of(parsed), projects, log).collect()}
    assert told == {str(tmp_path): (True, None), f"{tmp_path}/none": (False, "not a git work tree")}


def test_captured_log(spark, tmp_path):
    write(tmp_path, "log.txt", f"{'a' * 40}\tAnn\t5\n1\t2\tx.py\n")
    parsed = git.parsed_log(gitlog.captured_log(spark, str(tmp_path / "log.txt"), "p"))
    assert [(r.path, r.commit) for r in git.changes_of(parsed).collect()] == [("x.py", 1)]


def test_stream(spark, tmp_path):
    ddl = "project string, path string, content string, changed_at timestamp"
    at = dt.datetime(2024, 1, 1)
    for n, text in enumerate(["a\n", "a\n", "a\nb\n"]):
        spark.createDataFrame([("p", "x.ts", text, at)], ddl).coalesce(1).write.mode("append").json(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(ddl).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    rescan.keep_up(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "out"))
    assert table.count() == 2
    assert rescan.latest(table).count() == 1
    assert rescan.activity(stream).isStreaming


PATTERNS = {
    ".gitignore": [
        "logs/", "!logs/keep.ts", "*.gen.ts", "!keep.gen.ts", "/top", "mid/**/deep.ts", "**/any.ts", "all/**", "!all/in.ts", "q?.ts", "[ab]c.ts", "[!x]d.ts", r"\!odd.ts", r"\#odd.ts", r"star\*.ts", "trail.ts   ", r"space\ ",
        "a.b+c(d)$.ts", "[", "[]].ts", "folder/", "!folder", "one/two", r"[\]z]e.ts", "*", "!*", "!*/", "ü*.ts",
    ],
    "sub/.gitignore": ["deep.ts", "!logs", "/only.ts", "in/"], "sub/in/.gitignore": ["!x.ts", "*"], "mid/.gitignore": ["!deep.ts", "!c/deep.ts"],
}
PATHS = """logs/l.ts logs/keep.ts logs/in/x.ts sub/logs/l.ts a.gen.ts keep.gen.ts sub/keep.gen.ts top sub/top mid/deep.ts mid/c/deep.ts mid/c/d/deep.ts any.ts x/any.ts all/in.ts all/b/c.ts q1.ts q12.ts ac.ts bc.ts cc.ts
xd.ts yd.ts !odd.ts #odd.ts star*.ts star1.ts trail.ts a.b+c(d)$.ts [ ].ts folder/x.ts sub/folder sub/deep.ts sub/x/deep.ts sub/only.ts sub/x/only.ts sub/in/x.ts sub/in/y.ts one/two/x.ts sub/one/two plain.ts ]e.ts ze.ts üa.ts""".split()


def test_ignored_as_git_does(spark, tmp_path):
    """What git itself lists as untracked, for each pattern alone and for several together."""
    import random

    r, rows, want = random.Random(3), [], set()
    trials = [{f: [p]} for f, ps in PATTERNS.items() for p in ps] + [{f: r.sample(ps, min(len(ps), r.randint(1, 6))) for f, ps in PATTERNS.items()} for _ in range(25)]
    for n, trial in enumerate(trials):
        root = tmp_path / str(n)
        root.mkdir()
        subprocess.run(["git", "init", "-q", root], check=True)
        for path in PATHS:
            write(root, path, "x")
        for path, patterns in trial.items():
            write(root, path, "\n".join(patterns) + "\n")
        listed = subprocess.run(["git", "-C", root, "ls-files", "-z", "--others", "--exclude-standard"], check=True, capture_output=True).stdout.decode().split("\0")
        want |= {(str(n), p) for p in listed if p and not p.endswith(".gitignore")}
        rows += [(str(n), p, "x") for p in PATHS] + [(str(n), p, "\n".join(ps)) for p, ps in trial.items()]
    table = spark.createDataFrame(rows, "project string, path string, content string")
    rules = tree.ignored_by(table.where("endswith(path, '.gitignore')"))
    got = tree.not_ignored(table.where("not endswith(path, '.gitignore')"), rules)
    assert {(x.project, x.path) for x in got.collect()} == want


def test_ignored_folders_are_never_entered(spark, tmp_path):
    for path in ("logs/a.ts", "logs/keep.ts", "src/a.ts"):
        write(tmp_path, path, "x")
    write(tmp_path, ".gitignore", "logs/\n!logs/keep.ts\n")
    write(tmp_path, ".git", "gitdir: /elsewhere\n")  # as in a work tree or a submodule
    spark.dataSource.register(tree.SourceTree)
    found, _ = tree.scan(spark.read.format("sourcetree").option("path", str(tmp_path)).option("project", "p").load())
    assert {x.path for x in found.collect()} == {"src/a.ts"}


def test_history_of_all_that_exists(spark, tmp_path):
    """A file without an ending, a picture, a large file and a folder of links keep their history; what is gone does not."""
    from lodestrata.plans.analysis import forensics

    for path in ("Dockerfile", "img/a.png", "big.ts", "node_modules/x.js", ".ci/run", "src/a.ts"):
        write(tmp_path, path, "x" * (2_000_001 if path == "big.ts" else 9))
    (tmp_path / "link").symlink_to(tmp_path / "src")
    (tmp_path / "broken").symlink_to(tmp_path / "nowhere")
    write(tmp_path, ".git/HEAD", "ref: x\n")
    for source in (tree.SourceTree, tree.TreeListing):
        spark.dataSource.register(source)
    load = lambda kind: spark.read.format(kind).option("path", str(tmp_path)).option("project", "p").load()
    listed = load("treelisting")
    assert sorted(x.path for x in listed.collect()) == sorted("Dockerfile img img/a.png big.ts node_modules node_modules/x.js .ci .ci/run src src/a.ts link".split())
    lines = [f"{'a' * 40}\tAnn\t5", *(f"1\t2\t{p}" for p in ("Dockerfile", "img/a.png", "big.ts", "gone.ts", "link", "broken", "src/a.ts"))]
    log = spark.createDataFrame([("p", n, x) for n, x in enumerate(lines, 1)], "project string, line_no bigint, value string")
    assert {x.path for x in forensics(log, listed, 10)["git_files"].collect()} == {"Dockerfile", "img/a.png", "big.ts", "link", "src/a.ts"}


def test_a_log_that_grows(spark, tmp_path):
    """Two runs over a growing repository give what one run over all of it gives; the newest commits are kept."""
    from lodestrata.streaming import history

    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=Ann", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)

    def commit(n):
        write(repo, f"f{n % 3}.py", f"x = {n}\n" * n)
        run("add", ".")
        run("commit", "-m", str(n), "--date", f"2024-01-0{n}T00:00:00Z")

    run("init")
    spark.dataSource.register(gitlog.GitLog)
    none = str(tmp_path / "none")
    for first, last in ((1, 3), (4, 5), (6, 5)):  # the last batch has nothing new
        for n in range(first, last + 1):
            commit(n)
        stream = spark.readStream.format("gitlog").option("path", f"{repo},{none}").load()
        history.keep_log(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    key = lambda rows: sorted((r.author or "", r.ts or 0, r.path or "", r.additions or 0, r.deletions or 0) for r in rows)
    for n in (4, 100):
        whole = git.parsed_log(spark.read.format("gitlog").option("path", str(repo)).option("commits", n).load())
        kept = history.newest_log(spark, str(tmp_path / "out"), n)
        assert key(kept.collect()) == key(whole.collect())
        assert git.totals(git.commits_of(kept)).first().commits == min(n, 5)
    assert [r.commit for r in git.commits_of(history.newest_log(spark, str(tmp_path / "out"), 2)).orderBy("ts").collect()] == [2, 1]
