"""Each operator on small tables with nulls, ties, repeats and odd columns, against brute force."""

import collections
import hashlib
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import ann_curves, components, line_dedup, lm_scoring, mixing, near_dedup, packing, quality, sharding, tokens, topk, warc
from lodestrata.llm.shingles import WordHashes, shingle_set

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, row string, size long, key string"
WORDS = "alpha Beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


def documents(spark, *rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "k") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    base = sentence(1, 200)
    rows = [(n, sentence(100 + n, 5 + 13 * n), f"s{n % 3}") for n in range(20)]
    rows += [(30, base, "s0"), (31, base.upper(), "s1"), (32, base + " one more word here", None), (33, base.replace("alpha", "changed", 2), "s2")]
    rows += [(40, None, "s0"), (41, "", None), (42, "  \n\t", "s0"), (43, "two words", "s1"), (43, "two words", "s1"), (None, "no name here", "s1"), (50, "long " * 9000, "s2")]
    return documents(spark, *rows)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark)


def ascii_words(text):
    return (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()


def test_lm_scores(docs):
    rows = lm_scoring.score_documents(docs, block_tokens=500, bucket_bytes=64).collect()
    every = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    seen = collections.Counter(w for i, t in every if not held(i) for w in [*ascii_words(t), b"\n"])
    n, v = sum(seen.values()), len(seen)
    want = collections.Counter(
        (i, held(i), len(ascii_words(t)) + 1, sum(seen[w] > 0 for w in [*ascii_words(t), b"\n"]), n, round(sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in [*ascii_words(t), b"\n"]), 6))
        for i, t in every
    )
    assert want == collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    whole = lm_scoring.score_documents(docs).collect()  # blocks and buckets are no part of the result
    key = lambda r: (r.doc_id is None, r.doc_id)
    assert all(a.score == pytest.approx(b.score, rel=1e-9) for a, b in zip(sorted(rows, key=key), sorted(whole, key=key), strict=True))


def test_mixture_weight_is_the_likeliest():
    counts = np.zeros(lm_scoring.BINS + 1)
    counts[0], counts[lm_scoring._bin(np.array([8.0]))[0]] = 60, 40
    ratio = lm_scoring.BIN_RATIO
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax([(counts * np.log(x * ratio + 1 - x)).sum() for x in grid])]
    assert lm_scoring.weight_of(counts) == pytest.approx(best, abs=0.02)


def test_lm_of_nothing(none):
    assert lm_scoring.score_documents(none).collect() == []


def classes(rows):
    sets = {}
    for i, t in rows:
        w = ascii_words(t)
        sets[i] = set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} - {()}
    top = {i: i for i in sets}

    def find(i):
        return i if top[i] == i else find(top[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(docs):
    rows = near_dedup.near_duplicates(docs).collect()
    want = classes([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert len(rows) == docs.count()
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]


def test_near_duplicates_of_families(spark):
    """Families whose members differ by more or less: buckets hold several components."""
    rows, r = [], np.random.default_rng(5)
    for family in range(3):
        base = [f"w{family}_{k}" for k in range(150)]
        for member in range(30):
            words = list(base)
            for at in r.integers(0, 150, member % 8):
                words[at] = f"x{family}_{member}_{at}"
            rows.append((100 * family + member, " ".join(words), "s"))
    got = near_dedup.near_duplicates(documents(spark, *rows)).collect()
    want = classes([(i, t) for i, t, _ in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_of_nothing(none):
    assert near_dedup.near_duplicates(none).collect() == []


def test_components(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 120, (90, 2))] + [(200 + k, 201 + k) for k in range(40)] + [(None, 3)]
    top = {}

    def find(i):
        top.setdefault(i, i)
        return i if top[i] == i else find(top[i])

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in top}


def test_shingles():
    words = WordHashes(most=3)
    assert len(shingle_set(words("A b c d e A B C D E"))) == 5 and len(words(None)) == 0
    assert (shingle_set(words("A b")) == shingle_set(words("a  B\n"))).all() and (shingle_set(words("a b")) != shingle_set(words("b a"))).all()


def test_packing(docs, none):
    rows = packing.pack(docs, TOKENIZER, windows=4, merged_partitions=2, keep_ids=True).collect()
    encoder = tokens.Encoder(TOKENIZER, 1)
    want = collections.Counter((r.doc_id, b) for r in docs.collect() for b in encoder.encode([r.text]))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length * 4 == len(r.ids)
    for (doc_id, ids), n in want.items():
        pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == n * len(ids) // 4
        if n == 1:
            assert b"".join(bytes(r.ids) for r in pieces) == ids
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(none, TOKENIZER).collect() == []


def test_encoder_is_the_tokenizer():
    e = tokens.Encoder(TOKENIZER, most=4)
    odd = ["it's l'été <|endoftext|>ab!<|startoftext|>", "x\x1cy \x1d", "İI ŞΣ don't. Ab's!! 12,3 ﬁ '", "a b\u0085c d﻿ x​z", "´e ́e ǅ ªº", "", " ", "A,. b... -- "]
    assert [bytes(x) for x in e.encode(odd)] == [e._whole(x) for x in odd]


def test_encoder_remembers_words_without_case_and_signs():
    e = tokens.Encoder(TOKENIZER, 1)
    texts = ["Abc, abc ABC!! abc.\nÉté, été", None, "", "a...b, c?!d <|ENDOFTEXT|> A<|endoftext|>.", "J\u030c \u01f0 j\u030c. K\u212a, \u00c5 A\u030a.", "ΑΣ, Σ.Σ ς", "x\x1fY, y"] * 30
    assert [bytes(x) for x in e.encode(texts)] == [(e._whole(x) if x else b"") + e.end for x in texts]
    e = tokens.Encoder(TOKENIZER)
    assert len(list(e.encode(["Abc, abc ABC!! abc.", "Abc! ABC,"]))) == 2 and len(e.known) == 5  # before: seven


def test_encoder_keeps_two_generations():
    made = []
    words = tokens.Remembered(lambda w: made.append(w) or w.encode(), 2)
    assert b"".join(map(words.__getitem__, "abcaabd")) == b"abcaabd" and made == list("abcd") and len(words) <= 2
    assert tokens.encoder(TOKENIZER, 1) is tokens.encoder(TOKENIZER, 1)


def test_sharding(docs, none):
    rows = sharding.shard_by_bytes(docs, shards=5).collect()
    sizes = [len((r.text or "").encode()) + 8 for r in docs.collect()]
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for shard in by.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
    small = [sum(r["size"] for r in s) for s in by.values()]
    assert max(small) <= sum(sizes) / 5 + max(sizes)
    assert sharding.shard_by_bytes(none).collect() == []


def test_sharding_of_a_hot_text(spark):
    rows = [(n, "same text " * 20, "s") for n in range(300)] + [(1000 + n, sentence(n, 30), "s") for n in range(600)]
    by = collections.Counter()
    for r in sharding.shard_by_bytes(documents(spark, *rows)).collect():
        by[r.shard] += r["size"]
    assert set(by) == set(range(24)) and max(by.values()) - min(by.values()) <= 2 * 260


def test_mixing(docs, none):
    rows = mixing.mix_plan(docs).collect()
    sums = collections.Counter()
    for r in docs.collect():
        sums[r.source] += len(ascii_words(r.text))
    weights = {s: n % 3 + 1 for n, s in enumerate(sorted(sums, key=lambda s: (s is None, s or "")))}
    target, total = dict.fromkeys(sums, 0.0), sum(sums.values())
    capped = set()
    while True:
        free = [s for s in sums if s not in capped]
        left = total - sum(3 * sums[s] for s in capped)
        target |= {s: left * weights[s] / sum(weights[x] for x in free) for s in free} | {s: 3.0 * sums[s] for s in capped}
        over = {s for s in free if target[s] > 3 * sums[s]}
        if not over:
            break
        capped |= over
    assert sorted(round(r.target, 6) for r in rows) == sorted(round(target[r.source], 6) for r in docs.collect())
    assert all(0 <= r.copies <= 3 for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_plan(none).collect() == [] and mixing.mix(none).collect() == []


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 16))
    rows = [(n, [float(v) for v in x[n]], "c") for n in range(400)] + [(n, [1.0] * 16, "c") for n in range(400, 460)]
    rows += [(1000, None, "c"), (1010, [0.0] * 16, "c"), (1020, [float("nan")] + [1.0] * 15, "c"), (1030, [None] * 16, "c"), (None, [1.0] * 16, "c"), (5, rows[5][1], "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, class string")
    got = collections.defaultdict(list)
    for row in sorted(ann_curves.search(table, 5, 10, curves=4, window=200).collect(), key=lambda r: (r.query_id, r.rank)):
        got[row.query_id].append((row.vec_id, row.score))
    data = {n: np.array(v, dtype="f4").astype("f8") for n, v, _ in rows[:460]}
    hits = 0
    for q in range(0, 460, 10):
        want = sorted(((-float((data[q] * data[c]).sum()), c) for c in data if c != q))[:5]
        hits += len({c for _, c in want} & {c for c, _ in got[q]})
        assert all(s == pytest.approx(float((data[q] * data[c]).sum()), rel=1e-12) for c, s in got[q])
    assert set(got) == set(range(0, 460, 10)) and hits >= 0.9 * 5 * 46
    assert [c for c, _ in got[400]] == [401, 402, 403, 404, 405] or got[400][0][1] > 16
    assert ann_curves.search(table.where("vec_id < 0"), 5, 10).collect() == []


def _recall(spark, x, k, every, **law):
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for row in ann_curves.search(table, k, every, **law).collect():
        got[row.query_id].add(row.vec_id)
    hits = 0
    for q in range(0, len(x), every):
        s = x[q] @ x.T
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:k]))
    return hits / (k * len(range(0, len(x), every)))


def _units(n, width=64):
    x = np.random.default_rng(5).normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_neighbours_recall_holds_as_the_table_grows(spark):
    assert _recall(spark, _units(3_000), 20, 60, window=250) >= 0.85
    assert _recall(spark, _units(24_000), 20, 480, window=250) >= 0.85


def test_neighbours_with_few_long_vectors(spark):
    x = _units(6_000)
    x[17] *= 1000
    assert _recall(spark, x, 20, 120, window=600) >= 0.85


def test_bands():
    assert ann_curves.bands_of({0: 100}, 8) == {0: 0}
    assert ann_curves.bands_of({20: 1, 9: 3, 0: 100, -1: 5, -2: 3, -3: 1}, 8) == {20: 0, 9: 0, 0: 1, -1: 2, -2: 2, -3: 3}


def test_hilbert():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = ann_curves.hilbert(grid, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(n, [float(v) for v in r.normal(size=12)], 1) for n in range(300)] + [(n, [0.5] * 12, 1) for n in range(300, 350)]
    rows += [(1000, None, 1), (1100, [float("inf")] * 12, 1), (None, [1.0] * 12, 1), (7, rows[7][1], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.search(table, 10, 100, query_block=2, block=64).collect()}
    data = {n: np.floor(1024 * np.array(v, dtype="f4").astype("f8")) for n, v, _ in rows[:350]}
    want = {}
    for q in (0, 100, 200, 300):
        for k, (s, c) in enumerate(sorted((-int(data[q] @ data[c]), c) for c in data if c != q)[:10], 1):
            want[q, k] = (c, -s)
    assert got == want
    few = {(x.query_id, x.rank): x.vec_id for x in topk.search(table.where("vec_id in (0, 1, 2)"), 10, 100).collect()}
    assert set(few) == {(0, 1), (0, 2)}
    assert topk.search(table.where("vec_id < 0"), 10, 100).collect() == []


def test_lines(spark, none):
    common, short = "A common line that is long enough to count for sure", "short"
    rows = [(n, f"{short}\nown line of document number {n} which is long too\n  {common.upper() if n % 2 else common} \t\n{short}", "s") for n in range(6)]
    rows += [(20, None, "s"), (21, "", "s"), (22, common + "\n" + common, "s"), (None, common, "s")]
    docs = documents(spark, *rows)
    for batches, fanout in ((1, 2), (5, 2)):
        got = {r.doc_id: r for r in line_dedup.drop_common_lines(docs, batches=batches, fanout=fanout).collect()}
        assert {i: r["_n_dropped"] for i, r in got.items()} == {None: 1, 22: 0, 20: 0, 21: 0} | dict.fromkeys(range(6), 1)
        assert got[3]["_kept"] == f"{short}\nown line of document number 3 which is long too\n{short}" and got[20]["_n_lines"] == 1
        assert got[22]["_kept"] == rows[8][1] and got[5].source == "s"
    assert line_dedup.drop_common_lines(none).collect() == []


def test_runs_tell_what_is_new(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    batch = lambda *keys: spark.createDataFrame([(d, k, 0) for d, k in keys], "doc_id long, h1 long, h2 long")
    assert {r.h1 for r in runs.ingest(batch((1, 10), (2, 11))).collect()} == {10, 11}
    assert {r.h1 for r in runs.ingest(batch((3, 11), (3, 12))).collect()} == {12}
    assert {r.h1 for r in runs.ingest(batch((4, 10), (4, 12), (5, 13))).collect()} == {13}
    assert [len(level) for level in runs.levels] == [1, 1]
    assert {r.h1: (r.docs, r["last"]) for r in runs.totals().collect()} == {10: (2, 4), 11: (2, 3), 12: (2, 4), 13: (1, 5)}


def test_quality(spark, docs, none):
    junk = [(n, "$$$ ### !!! " * (3 + n % 5), "s") for n in range(200)]
    prose = [(1000 + n, sentence(n, 20 + n % 30), "s") for n in range(200)]
    table = documents(spark, *junk, *prose)
    labels = spark.createDataFrame([(i, int(i >= 1000), 0) for i, _, _ in junk + prose] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, score int")
    model = quality.train_quality(table, labels)
    scores = {r.doc_id: r.score for r in quality.score_quality(table.select("doc_id", "text"), model).collect()}
    held = [i for i in scores if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scores[i] >= 0.3) == (i >= 1000) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, model).collect())
    assert quality.train_quality(table, labels.where("quality = 1")) is None
    assert {r.score for r in quality.score_quality(docs, None).collect()} == {0.5} and quality.score_quality(none, model).collect() == []


def test_chunks_cover_a_text():
    for n in (0, 1, 127, 128, 129, 1023, 1024, 1025, 1920, 1921, 5000):
        data = bytes(k % 251 for k in range(n))
        rows, sizes = quality.chunks_of(data)
        out = np.full((len(rows) - 1) * quality.STEP + quality.CHUNK, -1)
        for k, row in enumerate(rows):
            out[k * quality.STEP : k * quality.STEP + quality.CHUNK] = row
        assert bytes(out[:n].astype("u1")) == data and (out[n:] == quality.PAD).all() and (sizes >= 1).all()


def test_warc(spark):
    same = "<p>" + "é" * 900
    rows = [(1, "http://a/1", same), (2, "http://a/2", same), (9, "http://a/9 b\nc", same), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "x\r\n\r\nWARC/1.1\r\n0\r\n\r\n" * 5000), (None, "u", same)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    path = warc.write_archives(pages, segment=1000, records_per_file=7)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        data, r = (html or "").encode(), got[page_id]
        revisit = html == same and page_id != 9
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == data
    assert got[9].url == "http://a/9%20b%0Ac"
    assert warc.read_archives(spark, warc.write_archives(pages.where("page_id < 0"))).collect() == []


def test_warc_with_a_missing_segment(spark, tmp_path):
    records = list(warc._written(1, 0, "u", b"y" * 5000, hashlib.sha1(b"y" * 5000).hexdigest(), None, 1000, "d"))
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in records[:2] + records[3:]))
    with pytest.raises(Exception, match="missing or repeated"):
        warc.read_archives(spark, str(tmp_path)).select(F.count("*")).collect()
