"""Brute force and odd inputs: repeats, clashing columns, long texts, shuffled rows, no rows."""

import collections
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata import scratch
from lodestrata.llm import ann_curves, line_dedup, lm_scoring, mixing, near_dedup, packing, quality, registry, sharding, topk, warc
from lodestrata.llm.line_dedup import line_key

from .test_operators import TOKENIZER, ascii_words, classes, documents, sentence

EDGE = "doc_id long, text string, lang string, source string, n_chars long, _kept string, _drops array<int>, row string, score double, size long, n int"


def edge_rows():
    line = "A common line that is long enough to count for sure"
    rows = [(n, f"own line {n} " + sentence(n, 40) + f"\n{line}", f"s{n % 3}") for n in range(12)]
    rows += [(3, "another text of the same name " + sentence(99, 30), "s0"), (4, rows[4][1], "s1"), (4, rows[4][1], None), (None, None, None), (None, "", "s0"), (None, "", "s0"), (20, None, "s1")]
    rows += [(21, "word " * 30_000, "s2"), (22, "x\n" * 3_000, "s2"), (None, rows[5][1], "s0")]
    return rows


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, "en", s, len(t or ""), "k", [1], "r", 0.5, 7, 1) for i, t, s in edge_rows()]
    return spark.createDataFrame(rows, EDGE)


def likeliest(ratios, x=0.5):
    """The weight by expectation-maximisation over the ratios themselves."""
    ratios = np.array(ratios, float)
    for _ in range(3000 if len(ratios) else 0):
        new = ((x * ratios / (x * ratios + 1 - x)).sum() + 0.5) / (len(ratios) + 1)
        if abs(new - x) < 1e-10:
            break
        x = new
    return x


def interpolated(rows):
    """(doc_id, score) of each row, by counting and mixing as the module's docstring says."""
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    texts = [(i, fold(i), [*ascii_words(t), b"\n"]) for i, t in rows]

    def grams(words):
        before = [b"\n", *words]
        older = [b"", *before]
        return list(zip(older, before, words))

    def counted(folds):
        c = collections.Counter()
        for _, f, words in texts:
            if folds(f):
                for u, v, w in grams(words):
                    c[1, w] += 1
                    c[2, v, w] += 1
                    c[3, u, v, w] += 1
                    c[2, "history", v] += 1
                    c[3, "history", u, v] += 1
        return c, sum(n for k, n in c.items() if k[0] == 1), sum(k[0] == 1 for k in c)

    level = lambda n: int(np.frexp(float(n))[1])

    def estimate(c, n, v, weights, order, u, h, w):
        if order == 1:
            return weights[1] * c[1, w] / max(n, 1) + (1 - weights[1]) / (v + 1)
        past = c[2, "history", h] if order == 2 else c[3, "history", u, h]
        here = c[2, h, w] if order == 2 else c[3, u, h, w]
        x = weights[order].get(level(past), 0.0)
        return x * here / max(past, 1) + (1 - x) * estimate(c, n, v, weights, order - 1, u, h, w)

    c, n, v = counted(lambda f: f not in (2, 3))
    deleted = [g for _, f, words in texts if f == 3 for g in grams(words)]
    weights = {1: likeliest([c[1, w] / max(n, 1) * (v + 1) for _, _, w in deleted]), 2: {}, 3: {}}
    for order in (2, 3):
        ratios = collections.defaultdict(list)
        for u, h, w in deleted:
            past = c[2, "history", h] if order == 2 else c[3, "history", u, h]
            here = c[2, h, w] if order == 2 else c[3, u, h, w]
            ratios[level(past)].append(here / max(past, 1) / estimate(c, n, v, weights, order - 1, u, h, w))
        weights[order] = {k: likeliest(ratios.get(k, [])) for k in range(1, 40)}
    c, n, v = counted(lambda f: f != 2)
    return [(i, sum(np.log10(estimate(c, n, v, weights, 3, *g)) for g in grams(words))) for i, _, words in texts]


def test_lm_score_by_brute_force(spark):
    rows = [(n, sentence(n, 3 + n % 60)) for n in range(120)] + [(None, "alpha beta"), (None, "alpha beta"), (None, ""), (None, None), (7, sentence(7, 10)), (7, sentence(7, 10)), (300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = lm_scoring.score_documents(docs, block_tokens=700, bucket_bytes=64).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want, have = sorted(interpolated(rows), key=key), sorted(((r.doc_id, r.score) for r in got), key=key)
    assert [i for i, _ in want] == [i for i, _ in have]
    assert [s for _, s in have] == pytest.approx([s for _, s in want], rel=2e-3)


def test_lm_blocks_are_small_and_come_back():
    r = np.random.default_rng(5)
    places = np.minimum(r.zipf(1.3, 300_000), 90_000)
    block = lm_scoring.Block.of(lm_scoring.REST, [1, 2], [*np.split(np.append(places, np.arange(90_000)).astype(np.uint64) * lm_scoring.A, [1000])])
    packed = block.packed()
    assert len(packed[4]) < 2 * len(block.word_at)  # places of so many words took four bytes each
    again = lm_scoring.Block.unpacked(*packed)
    for name in ("ids", "lengths", "words", "word_at", "starts"):
        assert (getattr(again, name) == getattr(block, name)).all()


def test_lm_drops_what_it_shuffled_for_a_table(spark, monkeypatch):
    """N-grams asked for are not on disk any more when the next are."""
    asked, dropped = [], []
    ask, store = lm_scoring._asked, lm_scoring.stored
    monkeypatch.setattr(lm_scoring, "_asked", lambda blocks, bits, orders: (asked.append(orders), ask(blocks, bits, orders))[1])
    monkeypatch.setattr(lm_scoring, "stored", lambda df, name, drop_shuffles=False: (dropped.append((name, drop_shuffles)), store(df, name, drop_shuffles))[1])
    docs = spark.createDataFrame([(n, f"a b {n}") for n in range(40)], "doc_id long, text string")
    assert lm_scoring.score_documents(docs).count() == 40
    assert asked == [(1, 2), (3,)] and dropped == [("lm-blocks", False), ("lm-counts", True), ("lm-counts", True), ("lm-deleted", True)]


def test_shuffles_of_a_stored_table_are_dropped(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        blocks = disk.getAllBlocks()
        return {b.name() for b in map(blocks.apply, range(blocks.size())) if b.isShuffle()}

    rows, before = spark.range(1000).repartition(3, "id"), shuffled()
    assert scratch.stored(rows, "kept").count() == 1000 and shuffled() - before
    before, end = shuffled(), time.time() + 20
    again = scratch.stored(rows, "dropped", drop_shuffles=True)
    while shuffled() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffled() - before and sorted(r.id for r in again.collect()) == list(range(1000))
    assert spark.conf.get(scratch.DROP_SHUFFLES) == "false"


def test_lm_of_repeats_in_other_partitions_and_of_a_long_text(spark):
    rows = [(1, "same text here")] * 40 + [(None, "")] * 40 + [(2, sentence(5, 300_000))]
    got = lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), block_tokens=50_000).collect()
    assert len(got) == 81 and max(r.n_tokens for r in got) == 300_001
    assert len({r.score for r in got if r.doc_id == 1}) == 1


def boilerplate(n, seed=3):
    """Texts of which a third is the same and the rest their own; some have a near copy."""
    r = np.random.default_rng(seed)
    shared = " ".join(f"shared{k}" for k in range(60))
    rows = []
    for i in range(n):
        own = [f"o{i}_{k}" for k in range(int(r.integers(80, 140)))]
        rows.append((2 * i, f"{shared} {' '.join(own)}"))
        if i % 10 == 0:
            own[5] = "changed"
            rows.append((2 * i + 1, f"{shared} {' '.join(own)}"))
    return rows


def test_near_duplicates_that_share_boilerplate(spark):
    """Families beyond the bound of a task: buckets are compared apart and dealt anew."""
    rows = boilerplate(250)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, most=8).collect()}
    assert got == classes(rows)


def test_large_buckets_are_dealt_anew_in_few_rows(spark, monkeypatch):
    """By rare shingles and once, not by further bands and level by level."""
    made, stored = [], near_dedup.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "buckets":
            made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "stored", counted)
    rows = boilerplate(250, seed=4)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most=8)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == classes(rows)
    assert len(made) == 2 and made[1] < made[0]


def test_a_group_compares_few_of_its_pairs():
    """2,000 sets that share 70 of 100 shingles, similar to half and never enough; five have a near copy."""
    r = np.random.default_rng(6)
    draw = lambda n: r.integers(0, 1 << 63, n, dtype=np.uint64)
    shared = draw(70)
    sets = [np.concatenate([shared, draw(30)]) for _ in range(2_000)]
    sets += [np.concatenate([x[:95], draw(5)]) for x in sets[:5]]
    sets, ids = [np.sort(x) for x in sets], range(len(sets))
    group = pd.DataFrame({"key": 1, "node": ids, "component": ids, "minima": [near_dedup.minima(x).tobytes() for x in sets], "shingles": [x.tobytes() for x in sets]})
    began = time.process_time()
    got = near_dedup._compare(group, 75, False)
    assert {(int(a), int(b)) for a, b in zip(got["a"], got["b"], strict=True)} == {(i, 2_000 + i) for i in range(5)}
    assert time.process_time() - began < 5


def test_block_links_miss_no_pair(spark):
    rows = boilerplate(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = near_dedup.signatures(docs)
    sets = near_dedup._sets(docs, signed.select(F.col("row").alias("node"), "doc_id", "h1", "h2"))
    members = signed.select(F.lit(1).cast("long").alias("key"), F.col("row").alias("node"), F.col("row").alias("component"), F.lit(len(rows)).alias("size"))
    name = {r.row: r.doc_id for r in signed.collect()}
    got = {frozenset((name[r.a], name[r.b])) for r in near_dedup._block_links(members, sets, 75, most=7).collect()}
    assert got == {frozenset((i, i + 1)) for i in range(0, 80, 20)}


def test_near_duplicates_of_repeated_ids(edges):
    rows = near_dedup.near_duplicates(edges).collect()
    assert len(rows) == len(edge_rows())
    three = [r for r in rows if r.doc_id == 3]
    assert len(three) == 2 and all(r.kept and r.stays and r.component_id == 3 for r in three)
    assert sorted(r.stays for r in rows if r.doc_id == 4) == [False, False, True]
    # A row without doc_id joins the class of its text; one without words stands for itself.
    assert sorted((r.n_shingles > 0, r.component_id, r.kept, r.stays) for r in rows if r.doc_id is None) == [(False, None, True, True)] * 3 + [(True, 5, False, False)]


def test_line_dedup_with_clashing_columns(edges):
    out = line_dedup.drop_common_lines(edges)
    assert out.columns == [c for c in edges.columns if c != "_kept"] + ["_n_lines", "_n_dropped", "_kept"]
    got = out.collect()
    assert len(got) == len(edge_rows()) and {r["_drops"][0] for r in got} == {1}
    assert sum(r["_n_dropped"] for r in got) == sum("A common line" in (t or "") for _, t, _ in edge_rows()) - 1
    assert [r["_n_lines"] for r in got if r.doc_id == 22] == [3001]


def test_lines_leave_no_tables(spark, edges):
    before = {t.name for t in spark.catalog.listTables()}
    line_dedup.drop_common_lines(edges).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_text_of_many_common_lines(spark):
    lines = [f"line number {n} which is surely longer than forty code points" for n in range(4_000)]
    rows = [(d, "\n".join([f"own {d}", *lines, lines[0], "end"])) for d in range(6)]
    got = {r.doc_id: r for r in line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=2).collect()}
    assert {d: r["_n_dropped"] for d, r in got.items()} == dict.fromkeys(range(5), 4001) | {5: 0}
    assert got[2]["_kept"] == "own 2\nend" and got[5]["_kept"] == rows[5][1]


def test_line_key(spark):
    r = spark.createDataFrame([(" \t A É b\x0b\r",), ("",)], "t string").select(line_key(F.col("t")).alias("k")).collect()
    assert [x.k for x in r] == ["a É b", ""]


def test_mixing_of_repeated_rows(spark):
    rows = [(1, "four words in here", "a")] * 300 + [(2, "two words", "b")] * 100
    docs = documents(spark, *rows).repartition(7)
    plan = mixing.mix_plan(docs).collect()
    for source, size in (("a", 1200), ("b", 200)):
        own = [r for r in plan if r.source_size == size]
        taken = sum(r["size"] * r.copies for r in own)
        assert taken == pytest.approx(own[0].target, rel=0.12), source
    again = mixing.mix_plan(docs.repartition(3)).collect()
    assert collections.Counter(plan) == collections.Counter(again)
    assert mixing.mix(docs).count() == sum(r.copies for r in plan)


def test_sharding_by_brute_force(spark, edges):
    rows = [(n, sentence(n % 50, 5 + n % 50), "s") for n in range(500)] + [(1000 + n, "hot text " * 30, "s") for n in range(400)]
    for docs in (documents(spark, *rows), edges):
        got = sharding.shard_by_bytes(docs, shards=7, ranges=64).collect()
        total, at, slots = sum(r["size"] for r in got), 0, collections.defaultdict(list)
        text = collections.defaultdict(set)
        for r in sorted(got, key=lambda r: (r.shard, r.slot)):
            # The order of shard and slot is one order of all; the middle of a record's bytes tells its shard.
            assert r.shard == min(6, (2 * at + r["size"]) * 7 // (2 * total))
            at += r["size"]
            slots[r.shard].append(r.slot)
            text[r.text_crc32].add(r.shard)
        assert all(s == list(range(len(s))) for s in slots.values())
        want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert want == collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got)
    assert sum(len(s) > 2 for s in text.values()) <= 1


def test_network_by_a_naive_convolution():
    r = np.random.default_rng(1)
    net = quality.Network()
    texts = [bytes(r.integers(32, 127, n).astype("u1")) for n in (0, 3, 700, 1024, 2500)]
    for text, odds in zip(texts, net._odds(texts), strict=True):
        rows, sizes = quality.chunks_of(text)
        top = []
        for row in rows:
            e = net.p["embed"][row]
            z = [[(e[p : p + 8].ravel() * net.p["filters"][:, f]).sum() for f in range(quality.FILTERS)] for p in range(0, quality.CHUNK - 7, quality.STRIDE)]
            top.append(np.max(z, axis=0) + net.p["bias"])
        full = [t for t, n in zip(top, sizes, strict=True) if n >= quality.CHUNK // 2 or len(top) == 1]
        pooled = np.concatenate([np.max(top, axis=0), np.average(top, axis=0, weights=sizes), np.min(full, axis=0), [np.log2(sizes.sum()) / 10 - 1]])
        assert odds == pytest.approx(float(np.tanh(pooled @ net.p["hidden"] + net.p["shift"]) @ net.p["out"] + net.p["base"][0]), abs=2e-4)


def test_gradients_by_differences():
    r = np.random.default_rng(2)
    net = quality.Network()
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    texts = [bytes(r.integers(32, 127, n).astype("u1")) for n in (5, 900, 3000)]
    cut = [quality.chunks_of(t) for t in texts]
    rows, sizes, starts = np.concatenate([c[0] for c in cut]), np.concatenate([c[1] for c in cut]), np.cumsum([0, *(len(c[0]) for c in cut[:-1])])
    y, w = np.array([0, 1, 1]), np.array([0.2, 0.3, 0.5])
    grads, _ = net.gradients(rows, sizes, starts, y, w)

    def loss():
        odds = net.gradients(rows, sizes, starts, y, w)[1]
        return float((w * (np.log1p(np.exp(odds)) - y * odds)).sum() / w.sum())

    for name, g in grads.items():
        for at in zip(*(r.integers(0, n, 4) for n in g.shape), strict=True):
            at, step, was = at if name != "embed" else (int(r.integers(97, 123)), at[1]), 3e-4, None
            was = net.p[name][at]
            net.p[name][at] = was + step
            up = loss()
            net.p[name][at] = was - step
            down = loss()
            net.p[name][at] = was
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=2e-3), name


def test_training_reads_whole_texts(spark):
    """What tells the labels apart stands at the end of texts of many chunks only; the sample is bounded in rows and bytes."""
    body = sentence(1, 300)
    rows = [(n, f"{sentence(n, 200)} {body} {'!!##$$ ' * 40 if n % 2 else sentence(n, 60)}", "s") for n in range(160)]
    labels = spark.createDataFrame([(n, 1 - n % 2) for n in range(160)], "doc_id long, quality int")
    docs = documents(spark, *rows)
    model = quality.train_quality(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score_quality(docs.select("doc_id", "text"), model).collect()}
    assert np.mean([(scores[n] >= 0.5) == (n % 2 == 0) for n in range(160)]) > 0.9
    assert quality.train_quality(docs, labels, sample_bytes=100) is None


def test_scores_of_odd_rows(edges):
    out = quality.score_quality(edges, quality.Network())
    assert sorted(out.columns) == sorted(edges.columns)
    by_text = collections.defaultdict(set)
    for r in out.collect():
        by_text[r.text or ""].add(r.score)
    assert all(max(s) - min(s) < 1e-4 for s in by_text.values())


def test_neighbours_tie_by_id_and_doubles_are_exact(spark):
    r = np.random.default_rng(4)
    rows = [(n, [float(v) for v in r.normal(size=8)]) for n in range(60)] + [(n, [3.0] * 8) for n in range(100, 130)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for row in sorted(ann_curves.search(table, 5, 10).collect(), key=lambda x: (x.query_id, x.rank)):
        got[row.query_id].append((row.vec_id, row.score))
    data = {i: np.array(v) for i, v in rows}
    for q in range(0, 60, 10):
        want = sorted((-float((data[q] * data[c]).sum()), c) for c in data if c != q)[:5]
        assert [c for c, _ in got[q]] == [c for _, c in want]
        assert [s for _, s in got[q]] == pytest.approx([-s for s, _ in want], rel=1e-14)
    assert [c for c, _ in got[100]] == [101, 102, 103, 104, 105] and [c for c, _ in got[120]] == [100, 101, 102, 103, 104]


def test_top_k_over_many_blocks(spark):
    r = np.random.default_rng(6)
    rows = [(n, [float(v) for v in r.normal(size=int(r.integers(0, 9)))]) for n in range(0, 900)] + [(3, rows) for rows in ([1.0], [1.0])]
    rows = [*rows[:900], (1000, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    data = {i: [int(np.floor(1024 * v)) for v in x] for i, x in rows}
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.search(table, 10, 100, block=100, query_block=3).collect()}
    want = {}
    for q in [*range(0, 900, 100), 1000]:
        best = sorted((-sum(a * b for a, b in zip(data[q], data[c], strict=False)), c) for c in data if c != q)[:10]
        want |= {(q, k): (c, -s) for k, (s, c) in enumerate(best, 1)}
    assert got == want


def test_packing_fills_its_windows(spark):
    rows = [(n, sentence(n, int(x)), "s") for n, x in enumerate(np.random.default_rng(8).lognormal(5, 1.2, 900))]
    used = collections.Counter()
    for r in packing.pack(documents(spark, *rows), TOKENIZER).collect():
        used[r.sequence_id] += r.length
    assert sum(used.values()) / (2048 * len(used)) > 0.97


def test_warc_of_repeated_pages(spark):
    same = "<p>" * 400
    pages = spark.createDataFrame([(1, "u", same), (5, "u", same), (5, "v", same), (None, "u", same), (None, "u", "<q>" * 400), (None, "u", "<q>" * 400)], "page_id long, url string, html string")
    got = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, warc.write_archives(pages)).collect())
    assert got == {(1, "revisit", 5): 1, (5, "response", None): 1, (5, "revisit", 5): 1, (None, "revisit", 5): 1, (None, "response", None): 1, (None, "revisit", None): 1}


def test_pipeline_of_odd_rows(spark, folder, edges):
    docs = edges
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), edges.schema)
        assert docs.columns == edges.columns
        assert name != "line dedup" or docs.count() == before
        if name.startswith("minhash"):
            texts = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in (3, 4)]
            assert len([x for x in texts if x[0] == 3]) >= len({t for i, t in texts if i == 3}) > 0
    assert corpus_pipeline.packing(spark, docs, folder).count() >= docs.count()


def test_pipeline_of_nothing(spark, folder, edges):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, edges.where("false"), folder).collect() == []


CONTRACT = {
    "op1": "doc_id held_out n_tokens n_known train_tokens base_score score", "op2": "doc_id n_shingles component_id kept",
    "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op4": "doc_id size text_crc32 law shard slot grown_shard",
    "op6": "query_id rank vec_id score", "op8": "doc_id held_out score predicted", "op12": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE_SQL])
def test_registered_query(name, spark, folder):
    """Columns and what follows from the input, for queries without SQL."""
    op = name.split("_")[0]
    out = registry.QUERIES[name](spark, folder)
    assert out.columns[: len(CONTRACT[op].split())] == CONTRACT[op].split()
    rows, docs = out.collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    crc = lambda i, n: zlib.crc32(str(i).encode()) % n
    if op == "op1":
        assert {r.doc_id: r.held_out for r in rows} == {i: crc(i, 7) == 2 for i in docs}
        assert {r.train_tokens for r in rows} == {sum(len(ascii_words(t)) + 1 for i, t in docs.items() if crc(i, 7) != 2)}
    if op == "op2":
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == classes(list(docs.items()))
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    if op == "op3":
        assert all(r.length > 0 and r.offset + r.length <= 2048 for r in rows) and {r.doc_id for r in rows} == set(docs)
    if op == "op4":
        assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None} and {r.shard for r in rows} <= set(range(24))
        assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs.items()}
    if op == "op6":
        assert {r.query_id % 20 for r in rows} == {0} and max(r["rank"] for r in rows) == 20
    if op == "op8":
        assert {r.doc_id: r.held_out for r in rows} == {i: crc(i, 5) == 0 for i in docs}
        assert all(r.predicted == (r.score >= 0.3) for r in rows)
        labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
        held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
        assert np.mean([p == y for p, y in held]) > 0.75  # of about twenty


