"""Resampling, byte-level BPE and the prefix trie against brute force, on odd rows too."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lodestrata.llm import byte_bpe, prefix_trie, registry, target_resampling
from lodestrata.llm.byte_bpe import ByteBPE

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, rank int, weight string, ids string, `a.b` int"
TALK = "conv_id long, turn long, role string, text string, key string, depth int, `a.b` int"


def documents(spark, *rows):
    return spark.createDataFrame([(i, t, 1, "w", "x", 2) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd_texts():
    r = np.random.default_rng(5)
    names = "Alpha beta GAMMA delta épsilon zeta η theta x1 2 42 kappa".split()
    rows = [(n, " ".join(r.choice(names, int(r.integers(0, 60))))) for n in range(80)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, rows[3][1]), (3, rows[3][1]), (3, "the same id, other words " * 9), (None, "no name here " * 12), (None, None)]
    return [*rows, (2**60 + 1, "a long id " * 8), (105, "word " * 30_000), (106, "don't  stop_me--now\r\n\r\n  ½ x² \x1c a  " * 20)]


def resampled(rows, target, longest=1, buckets=10_000, percent=10, least=20):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def features(t):
        w = words(t)
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in rows for f in features(t))
    t_ = collections.Counter(bucket(f) for t in target for f in features(t))
    total_s, total_t = sum(s.values()), sum(t_.values())
    gain = lambda b: math.floor(1000 * math.log((t_[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for i, t in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in features(t))
        out.append([i, len(features(t)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(t))])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, -x[2], x[1]))
    for n, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = n
    return collections.Counter(tuple(x[:5]) for x in out)


@pytest.mark.parametrize(("longest", "block_words"), [(1, 2_000_000), (1, 100), (2, 500)])
def test_resampling(spark, odd_texts, longest, block_words):
    target = ["Alpha kappa 42 alpha", None, "", "theta x1 kappa " * 10]
    docs = documents(spark, *odd_texts).repartition(3)
    got = target_resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=30, longest=longest, block_words=block_words)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert collections.Counter(map(tuple, got.collect())) == resampled(odd_texts, target, longest, percent=30)


def test_resampling_of_nothing(spark):
    none, some = documents(spark), documents(spark, (1, "one two"))
    assert target_resampling.resample(none, some).collect() == []
    assert [tuple(r) for r in target_resampling.resample(some, none).collect()] == list(resampled([(1, "one two")], []))


def test_ranks_follow_the_order_over_partitions(spark):
    rows = spark.range(5000).selectExpr("id", "id * 7919 % 1000 AS x").repartition(7)
    got = target_resampling.ranked(rows, [rows["x"].desc(), rows["id"].asc()]).collect()
    want = sorted(((r.x, r.id) for r in got), key=lambda r: (-r[0], r[1]))
    assert [(r.x, r.id) for r in sorted(got, key=lambda r: r["rank"])] == want and {r["rank"] for r in got} == set(range(1, 5001))


@pytest.fixture(scope="module")
def model():
    return ByteBPE(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(model):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})


LONG = {
    "one letter": "a" * 30_000, "a rank below its parts": "e" * 30_000, "spaces": " " * 9_000 + "x", "lines": "\n" * 5_000 + " \t", "dashes": "-" * 30_000 + "=" * 70, "two letters": "ab" * 10_000,
    "letters": "".join(np.random.default_rng(1).choice(list("etaoinshrdlu"), 3_000)), "thai": "".join(np.random.default_rng(2).choice(list("กขคงจชซญดตถ"), 3_000)),
    "any": "".join(map(chr, np.random.default_rng(3).integers(32, 0x3000, 5_000))),
}


@pytest.mark.parametrize("name", LONG)
def test_bpe_of_long_words(model, reference, name):
    ids = model.encode([LONG[name]])[0]
    assert ids.tolist() == reference.encode_ordinary(LONG[name])
    assert model.decode([ids])[0] == LONG[name].encode()


def test_bpe_of_every_character(model, reference):
    """Each character before, after and between others, in pieces that end as the library's do."""
    for start in range(0, 0x110000, 0x8000):
        codes = [c for c in range(start, start + 0x8000) if not 0xD800 <= c < 0xE000]
        text = "".join(f"{chr(c)} a{chr(c)}" for c in codes)
        assert model.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_bpe_at_once_is_bpe_pair_by_pair(model, reference, monkeypatch):
    words = [w for t in ("unbelievable tokenization of internationalization", "aaaaa eeeee lllll", "the quick brown fox") for w in t.split()]
    words = ["".join(np.random.default_rng(n).choice(list("abcdehilnorst"), 25)) for n in range(300)] + words
    want = [reference.encode_ordinary(w) for w in words]
    for short in (0, 32):
        monkeypatch.setattr(byte_bpe, "SHORT", short)
        parts = [w.encode() for w in words if w.encode() not in model.ranks]
        got = model._contracted(list(set(parts)))
        assert all(np.frombuffer(got[w.encode()], np.int32).tolist() == x for w, x in zip(words, want, strict=True) if w.encode() not in model.ranks)


def test_bpe_memory_is_bounded(reference):
    small = ByteBPE(RANKS, public_tokenizers.PATTERN, most=50)
    for n in range(0, 600, 100):
        text = " ".join(f"word{k} thing{k % 7}, and\nmore" for k in range(n, n + 100))
        assert small.encode([text, "", text])[2].tolist() == reference.encode_ordinary(text)
    assert len(small.chunks) < 600


def test_bpe_over_documents(spark, odd_texts, reference):
    docs = documents(spark, *odd_texts)
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    want = collections.Counter((i, tuple(reference.encode_ordinary(t or ""))) for i, t in odd_texts)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == want
    decoded = byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)
    assert collections.Counter((r.doc_id, bytes(r.bytes)) for r in decoded.collect()) == collections.Counter((i, (t or "").encode()) for i, t in odd_texts)
    assert byte_bpe.encode(docs.where("false"), RANKS, public_tokenizers.PATTERN).collect() == []
    assert byte_bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), RANKS, public_tokenizers.PATTERN).select("bytes").distinct().count() == 1


def test_bpe_refuses_unknown_ids(model):
    for ids in ([50_256], [-1], [10**6]):
        with pytest.raises(ValueError, match="vocabulary"):
            model.decode([np.array(ids)])


def test_bpe_query(spark, folder, reference):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    code = lambda data: hashlib.sha256(data).hexdigest()
    rows = registry.QUERIES["op12_recursive_bpe"](spark, folder).collect()
    ids = {i: reference.encode_ordinary(t) for i, t in texts.items()}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {(i, len(ids[i]), code(" ".join(map(str, ids[i])).encode()), code(t.encode())) for i, t in texts.items()}
    assert len(rows) == len(texts)


def nodes(rows):
    """The trie of (conv_id, turn, role, text), by whole prefixes."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [x for _, x in sorted(t, key=lambda x: x[0])] for c, t in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        turns = (*own.get(c - c % 20, [])[:h], *own[c][h:])
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(cs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    code = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    return collections.Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], code(ends[k])) for k, m in members.items())


@pytest.fixture(scope="module")
def talk():
    r = np.random.default_rng(9)
    rows = [(c, t, ["system", "user", None][int(r.integers(0, 3))], ["hello there", "what now", "", None, "so it\tgoes on"][int(r.integers(0, 5))]) for c in range(150) for t in range(int(r.integers(0, 6)))]
    rows += [(c, t, "user", f"the same turn {t}") for c in range(200, 300) for t in range(6)]  # copies
    rows += [(c, t, "user", f"prompt {t}" if t < 3 else f"own {c}") for c in range(300, 380) for t in range(5)]  # one head, many tails
    rows += [(400, t, "user", f"turn {t % 3}") for t in range(300)] + [(401, None, "user", "x"), (401, None, "user", "x"), (401, 3, "a", "y"), (401, 3, "b", "y"), (403, 1, None, None)]
    return [*rows, (None, 1, "user", "nobody"), (2**60 + 3, 1, "user", "a long id"), (421, 0, "user", "no first of its family")]


@pytest.mark.parametrize(("most", "bucket"), [(200, 2_000), (3, 10), (1, 50)])
def test_prefix_trie(spark, talk, most, bucket):
    table = spark.createDataFrame([(*row, "k", 7, 1) for row in talk], TALK).repartition(5)
    got = prefix_trie.prefix_trie(table, most=most, bucket=bucket)
    assert got.columns == prefix_trie.COLUMNS
    assert collections.Counter(map(tuple, got.collect())) == nodes(talk)


def test_prefix_trie_of_odd_tables(spark):
    table = lambda *rows: spark.createDataFrame([(*row, "k", 7, 1) for row in rows], TALK)
    assert prefix_trie.prefix_trie(table()).collect() == []
    turnless = [(c, 0, "user", "x") for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    assert collections.Counter(map(tuple, prefix_trie.prefix_trie(table(*turnless)).collect())) == nodes(turnless)


def test_digests_of_many_ids(spark):
    ids = [("a", n * 37 % 1009) for n in range(1009)] + [("b", 5), ("c", 10), ("c", 9)] + [("d", n) for n in range(150)]
    got = prefix_trie.ids_digests(spark.createDataFrame(ids, "sequence string, conv_id long").repartition(6), most=100).collect()
    want = collections.defaultdict(list)
    for s, i in ids:
        want[s].append(i)
    assert {r.sequence: r.ends_sha256 for r in got} == {s: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest() for s, x in want.items()}
    assert len(got) == len(want)


# Odd tables of the earlier operators


def test_archives_of_shuffled_pages(spark):
    """Rows that are dealt anew each time they are read keep their names."""
    from lodestrata.llm import warc

    html = lambda n: f"<p>{n % 7}</p>" * 300
    pages = spark.range(400).selectExpr("id AS page_id", "concat('u', id) AS url").toPandas().assign(html=[html(n) for n in range(400)])
    got = warc.read_archives(spark, warc.write_archives(spark.createDataFrame(pages).repartition(7))).collect()
    last = {n % 7: n for n in range(400)}
    want = {(n, "response", None) if last[n % 7] == n else (n, "revisit", last[n % 7]) for n in range(400)}
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == want and len(got) == 400


def test_mixing_of_one_text_in_several_sources(spark):
    from lodestrata.llm import mixing

    rows = [(1, "a b c", s, n) for s in ("x", "y", None) for n in range(40)] + [(n, "w " * (n % 5), "z", 0) for n in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int")
    plans, mixes = set(), set()
    for n in (1, 3, 5):
        table = docs.repartition(n)
        plans.add(tuple(sorted(map(str, mixing.mix_plan(table).collect()))))
        mixes.add(tuple(sorted(map(str, mixing.mix(table).collect()))))
        assert mixing.mix(table).columns == docs.columns
    assert len(plans) == len(mixes) == 1


@pytest.mark.parametrize("op", ["op6", "op10"])
def test_neighbours_of_repeated_ids(spark, op):
    """One list for a query with several vectors, one row for a candidate with several."""
    from lodestrata.llm import ann_curves, topk

    r = np.random.default_rng(8)
    rows = [(n, [float(x) for x in r.normal(size=6)]) for n in range(0, 60)] + [(n, [float(x) for x in r.normal(size=6)]) for n in (0, 0, 7, 7, 20)]
    search, whole = (ann_curves.search, lambda v: np.array(v)) if op == "op6" else (topk.search, lambda v: np.floor(1024 * np.array(v)))
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 20).collect()
    want = set()
    for q in (0, 20, 40):
        best = {}
        for c, v in rows:
            for i, x in rows:
                if i == q and c != q:
                    best[c] = max(best.get(c, -np.inf), float(whole(x) @ whole(v)))
        want |= {(q, n, c) for n, (c, _) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5], 1)}
    assert {(x.query_id, x["rank"], x.vec_id) for x in got} == want and len(got) == len(want)


def test_training_passes_over_a_giant_text(spark):
    from lodestrata.llm import quality

    rows = [(n, "word " * 30 if n % 2 else "%% && " * 30) for n in range(60)] + [(60, "giant " * 50_000), (61, "giant " * 50_000)]
    labels = spark.createDataFrame([(n, n % 2) for n in range(62)], "doc_id long, quality int")
    assert quality.train_quality(documents(spark, *rows), labels, sample_bytes=100_000) is not None
    fit = lambda *sizes: [r["id"] for r in quality._fitting([{"id": n, "size": s, "place": n, "y": n % 2} for n, s in enumerate(sizes)], 100)]
    assert fit(90, 3, 5, 4, 6) == [1, 2, 3, 4] and fit(50, 40, 70) == [1, 0] and fit(200, 1) == [1] and fit() == []


def test_groups_of_long_texts_are_bounded_in_bytes(spark):
    """Near copies of long texts, which fill many slots each, against brute force."""
    from lodestrata.llm import near_dedup

    from .test_operators import classes

    r, rows = np.random.default_rng(2), []
    base = [f"w{k}" for k in range(3000)]
    for n in range(12):
        words = list(base)
        for at in r.integers(0, 3000, 30 * (n % 6)):
            words[at] = f"x{n}_{at}"
        rows.append((n, " ".join(words)))
    got = near_dedup.near_duplicates(documents(spark, *rows), most=4).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == classes(rows)


def test_stages_keep_columns_of_any_name(spark, folder):
    import corpus_pipeline
    from lodestrata.llm import quality

    rows = [(n, f"some words of a text {n} " * 5 + "\nA line that is common and long enough to be dropped", f"s{n % 2}", n, "x") for n in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, `a.b ``c` string")
    outs = [stage(spark, docs, folder) for _, stage in corpus_pipeline.STAGES[1:-1]] + [quality.score_quality(docs, quality.Network()).drop("score")]
    for out in outs:
        assert out.columns == docs.columns
        assert all(x[4] == "x" for x in out.collect())


def test_line_runs_go_on_another_day(spark, tmp_path):
    """Runs that were saved, closed and opened again meet later batches as if nothing had happened."""
    from lodestrata.llm.line_dedup import LineRuns

    r = np.random.default_rng(4)
    batches = [spark.createDataFrame([(int(d), int(h), int(h) + 1) for d, h in r.integers(0, 90, (120, 2))], "doc_id long, h1 long, h2 long") for _ in range(5)]
    whole, fresh = LineRuns(spark, 2), []
    for b in batches:
        fresh.append(sorted(map(tuple, whole.ingest(b).collect())))
    want = sorted(map(tuple, whole.totals().collect()))
    whole.close()
    runs = LineRuns(spark, 2)
    for n, b in enumerate(batches):
        if n in (1, 3):
            runs.save(path := (tmp_path / str(n)).as_uri())
            runs.close()
            runs = LineRuns.opened(spark, path)
        assert sorted(map(tuple, runs.ingest(b).collect())) == fresh[n]
    assert sorted(map(tuple, runs.totals().collect())) == want and len(runs.levels) > 1
    runs.close()


def test_sets_of_queries_are_no_part_of_the_result(spark):
    from lodestrata.llm import ann_curves

    r = np.random.default_rng(1)
    table = spark.createDataFrame([(n, [float(x) for x in r.normal(size=8)]) for n in range(400)], "vec_id long, embedding array<double>")
    key = lambda **law: sorted(map(tuple, ann_curves.search(table, 5, 10, window=40, curves=3, **law).collect()))
    assert key(query_set=3) == key() and len(key()) == 200
