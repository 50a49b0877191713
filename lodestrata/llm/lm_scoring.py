"""LM scoring by deleted interpolation of trigram, bigram, unigram and uniform estimates.

P1(w)     = m c(w) / N + (1 - m) / (V + 1)
P2(w | v) = l2 c(v w) / c(v) + (1 - l2) P1(w)
P3(w | u v) = l3 c(u v w) / c(u v) + (1 - l3) P2(w | v)

l2 and l3 depend on how frequent the context is, by powers of two; m has one
context, the empty one. They are learned by expectation-maximisation on counts of a
deleted fold of the training documents under estimates from the rest; then all
training documents are counted.

Tokens are never rows. A task turns its documents into blocks of bounded size, which
are stored once under an id of their own. Each block counts its distinct n-grams
and sends them as packed lists of hashes, dealt to buckets by hash. A bucket is
totalled by one call and answers each block with the counts of what the block asked
for, in the block's order. Words and pairs are asked for first, trigrams then, and what
was shuffled for one is dropped before the other, so that disk never holds all n-grams.
Blocks and answers then meet for learning and scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .memory import giving_back
from .shingles import WordHashes, mixed

HELD, DELETED, REST = 2, 3, 0  # remainders of the fold; REST is all others
ORDERS = (1, 2, 3)
PASSES = ((1, 2), (3,))  # orders whose n-grams are on disk together
END = np.frombuffer(xxhash.xxh64_digest(b"\n"), np.uint64)[0]  # no word holds a line end
BEGIN = np.frombuffer(xxhash.xxh64_digest(b"\n\n"), np.uint64)[0]  # stands before the end that stands before a text
KEY_BITS = 56  # of an n-gram's hash
LEVELS = 40  # powers of two of a context's count
BINS, LOW, HIGH = 640, -20.0, 60.0  # of the log2 ratio of an estimate to the next shorter one
NO_ID = np.iinfo(np.int64).min
PACKED = "block long, role int, ids binary, lengths binary, words binary, word_at binary"
ASKED = "order int, bucket int, block long, role int, keys binary, counts binary"
COUNTS = "order int, bucket int, block long, total binary, rest binary, sums array<double>"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
START = mixed(np.array([BEGIN]) * A + END)[0]  # the pair that stands before a text


def fold(doc_id: Column, folds: int = 7) -> Column:
    """CRC-32 of the doc_id as text, modulo folds; of an empty text for null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest, with that number of bytes first."""
    most = int(counts.max(initial=0))
    kind = "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8"
    return kind[-1].encode() + counts.astype(kind).tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[:1].decode()}", offset=1).astype(np.int64)


def _pressed(places: np.ndarray) -> bytes:
    """Places, most of them small, byte by byte of their size, compressed."""
    planes = places.astype("<u4").view("u1").reshape(-1, 4).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpressed(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd", asbytes=True), "u1").reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0]


class Block:
    """Documents of one fold in one task: hashes of their tokens, an end after each."""

    def __init__(self, role: int, ids: np.ndarray, lengths: np.ndarray, words: np.ndarray, word_at: np.ndarray):
        self.role, self.ids, self.lengths, self.words, self.word_at = role, ids, lengths, words, word_at
        self.starts = np.cumsum(lengths) - lengths

    @classmethod
    def of(cls, role: int, ids: list[int], tokens: list[np.ndarray]) -> Block:
        words, word_at = np.unique(np.concatenate(tokens), return_inverse=True)
        return cls(role, np.array(ids, np.int64), np.array([len(t) for t in tokens], np.int64), words, word_at)

    def packed(self) -> tuple:
        """The frequent words come first, so that the places of most tokens are small."""
        frequent = np.argsort(-np.bincount(self.word_at, minlength=len(self.words)), kind="stable")
        place = np.empty_like(frequent)
        place[frequent] = np.arange(len(frequent))
        return self.role, self.ids.tobytes(), self.lengths.astype("<u4").tobytes(), self.words[frequent].tobytes(), _pressed(place[self.word_at])

    @classmethod
    def unpacked(cls, role, ids, lengths, words, word_at) -> Block:
        lengths, frequent = np.frombuffer(lengths, "<u4").astype(np.int64), np.frombuffer(words, np.uint64)
        words, place = np.unique(frequent, return_inverse=True)
        return cls(int(role), np.frombuffer(ids, np.int64), lengths, words, place[_unpressed(word_at, int(lengths.sum()))])

    def context(self) -> np.ndarray:
        """Place of the word before each token; of the end for the first token of a document."""
        out = np.empty_like(self.word_at)
        out[1:] = self.word_at[:-1]
        out[self.starts] = np.searchsorted(self.words, END)
        return out

    def hashes(self) -> Iterator[np.ndarray]:
        """A hash for each token's unigram, bigram and trigram in turn."""
        tokens = self.words[self.word_at]
        yield tokens
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.starts] = END
        pair = mixed(before * A + tokens)
        yield pair
        history = np.empty_like(tokens)  # of the two tokens before
        history[1:] = pair[:-1]
        history[self.starts] = START
        yield mixed(history * B + tokens)


def _blocks(batches: Iterator[pd.DataFrame], most: int) -> Iterator[Block]:
    """Blocks of about ``most`` tokens in the order of the rows, for each fold by itself."""
    hashed, open_ = WordHashes(), {}
    for b in batches:
        for doc_id, role, text in zip(b["doc_id"], b["role"], b["text"], strict=True):
            held = open_.setdefault(role, [[], [], 0])
            held[0].append(NO_ID if pd.isna(doc_id) else int(doc_id))
            held[1].append(np.append(hashed(text), END))
            held[2] += len(held[1][-1])
            if held[2] >= most:
                yield Block.of(role, *open_.pop(role)[:2])
    for role in sorted(open_):
        yield Block.of(role, *open_[role][:2])


def _stored_blocks(docs: DataFrame, most: int) -> DataFrame:
    """The documents as blocks, written once: their ids and order hold from then on."""

    def pack(batches):
        first = TaskContext.get().partitionId() << 32
        for n, block in enumerate(_blocks(batches, most)):
            yield pd.DataFrame([(first + n, *block.packed())], columns=["block", "role", "ids", "lengths", "words", "word_at"])

    role = F.when(F.col("r").isin(HELD, DELETED), F.col("r")).otherwise(REST)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), fold(docs["doc_id"]).cast("int").alias("r"))
    return stored(rows.select("doc_id", role.alias("role"), "text").mapInPandas(giving_back(pack), PACKED), "lm-blocks")


def _unpacked(rows: pd.DataFrame) -> Iterator[tuple[int, Block]]:
    for row in rows.itertuples(index=False):
        yield row.block, Block.unpacked(row.role, row.ids, row.lengths, row.words, row.word_at)


def _asked(blocks: DataFrame, bits: int, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """Each block's distinct n-grams of these orders and their counts, by bucket."""
    width = -(-(KEY_BITS - bits) // 8)

    def ask(batches):
        for name, block in (x for b in batches for x in _unpacked(b)):
            for order, hashes in zip(ORDERS, block.hashes(), strict=True):
                if order not in orders:
                    continue
                keys, counts = np.unique(hashes >> np.uint64(64 - KEY_BITS), return_counts=True)
                counts = counts if block.role != HELD else np.zeros_like(counts)
                buckets = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64)
                found, starts = np.unique(buckets, return_index=True)
                ends = [*starts[1:], len(keys)]
                raw = np.ascontiguousarray(keys.astype(">u8").view("u1").reshape(-1, 8)[:, 8 - width :])
                yield pd.DataFrame(
                    {
                        "order": order,
                        "bucket": found.astype(np.int32),
                        "block": name,
                        "role": block.role,
                        "keys": [raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)],
                        "counts": [_narrow(counts[a:b]) for a, b in zip(starts, ends, strict=True)],
                    }
                )

    return blocks.mapInPandas(giving_back(ask), ASKED)


def _answer(rows: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Totals of a bucket, given back to each block in its order; and, of unigrams, sums for the weights."""
    width = -(-(KEY_BITS - bits) // 8)

    def keys_of(raw: bytes) -> np.ndarray:
        full = np.zeros((len(raw) // width, 8), "u1")
        full[:, 8 - width :] = np.frombuffer(raw, "u1").reshape(-1, width)
        return full.view(">u8")[:, 0].astype(np.uint64)

    counts = [_wide(c) for c in rows["counts"]]
    sizes = [len(c) for c in counts]
    own = np.concatenate(counts)
    of = np.repeat(rows["role"].to_numpy(), sizes)
    distinct, at = np.unique(np.concatenate([keys_of(k) for k in rows["keys"]]), return_inverse=True)
    total = np.bincount(at, own, len(distinct)).astype(np.int64)
    deleted = np.bincount(at[of == DELETED], own[of == DELETED], len(distinct)).astype(np.int64)
    rest, cuts = total - deleted, np.cumsum(sizes)[:-1]
    out = pd.DataFrame(
        {
            "order": rows["order"],
            "bucket": rows["bucket"],
            "block": rows["block"],
            "total": [_narrow(x) for x in np.split(total[at], cuts)],
            "rest": [_narrow(x) if r == DELETED else None for x, r in zip(np.split(rest[at], cuts), rows["role"], strict=True)],
            "sums": None,
        }
    ).reset_index(drop=True)
    if rows["order"].iloc[0] == 1:
        bins = _bin(rest.astype(float))
        out.at[0, "sums"] = np.concatenate(
            [[total.sum(), (total > 0).sum(), rest.sum(), (rest > 0).sum()], np.bincount(bins, deleted, BINS + 1), np.bincount(bins, deleted * rest.astype(float), BINS + 1)]
        )
    return out


def _bin(ratio: np.ndarray) -> np.ndarray:
    """0 for a ratio of nothing, else 1 + the place of its logarithm."""
    with np.errstate(divide="ignore"):
        place = (np.log2(ratio) - LOW) * (BINS / (HIGH - LOW))
    return np.where(ratio > 0, np.clip(np.nan_to_num(place, neginf=0), 0, BINS - 1).astype(int) + 1, 0)


BIN_RATIO = np.concatenate([[0.0], 2.0 ** (LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS)])


def weight_of(counts: np.ndarray, sums: np.ndarray | None = None, start: float = 0.5, rounds: int = 500) -> float:
    """Expectation-maximisation of x in sum of log(x * ratio + 1 - x), over ratios counted and summed in narrow bins.

    A bin stands for its mean ratio, or its middle without sums; its width of an eighth
    of an octave bounds what that can change. One made-up observation is half for and
    half against x.
    """
    total, x = counts.sum(), start
    ratio = BIN_RATIO if sums is None else sums / np.maximum(counts, 1e-300)
    for _ in range(rounds if total else 0):
        share = x * ratio / (x * ratio + 1 - x)
        new = (float(counts @ share) + 0.5) / (total + 1)
        if abs(new - x) < 1e-9:
            break
        x = new
    return x


def level(context: np.ndarray) -> np.ndarray:
    """Bucket of a context by the power of two of its count; 0 if it was not seen."""
    return np.minimum(np.frexp(context.astype(float))[1], LEVELS - 1)


class Mixture:
    """What scoring needs: N, V, the unigram weight, and weights of bigrams and trigrams by level of their context."""

    def __init__(self, n: float, v: float, unigram: float, bigram: np.ndarray | None = None, trigram: np.ndarray | None = None):
        self.n, self.v, self.unigram, self.bigram, self.trigram = n, v, unigram, bigram, trigram

    def estimates(self, seen: Seen, order: int) -> np.ndarray:
        """P1, P2 or P3 of each token."""
        if order == 1:
            return self.unigram * seen.counts[1] / max(self.n, 1) + (1 - self.unigram) / (self.v + 1)
        weight = (self.bigram if order == 2 else self.trigram)[level(seen.contexts[order])]
        return weight * seen.ratio(order) + (1 - weight) * self.estimates(seen, order - 1)


class Seen:
    """Counts of the n-gram of each token, and of its context."""

    def __init__(self, block: Block, answers: pd.DataFrame, column: str):
        self.counts, got = {}, {}
        for order, hashes in zip(ORDERS, block.hashes(), strict=True):
            own = answers[answers["order"] == order].sort_values("bucket")[column]
            got[order] = np.concatenate([_wide(x) for x in own])
            at = np.unique(hashes >> np.uint64(64 - KEY_BITS), return_inverse=True)[1]
            self.counts[order] = got[order][at]
        # The end of a text is as frequent as its begin. A pair is as frequent as what follows it.
        ends = np.searchsorted(np.unique(block.words >> np.uint64(64 - KEY_BITS)), END >> np.uint64(64 - KEY_BITS))
        starts, ends = block.starts, got[1][ends]
        after, pairs = np.empty_like(block.word_at), np.empty_like(block.word_at)
        after[1:], pairs[1:] = self.counts[1][:-1], self.counts[2][:-1]
        after[starts], pairs[starts] = ends, ends
        self.contexts = {2: after, 3: pairs}

    def ratio(self, order: int) -> np.ndarray:
        """The maximum-likelihood estimate; 0 in an unseen context."""
        return self.counts[order] / np.maximum(self.contexts[order], 1)


def _table(rows: list, cells: int) -> tuple[np.ndarray, np.ndarray]:
    counts, sums = np.zeros((cells, BINS + 1)), np.zeros((cells, BINS + 1))
    for r in rows:
        counts[r["level"], r["bin"]], sums[r["level"], r["bin"]] = r["n"], r["x"]
    return counts, sums


def _learned(known: DataFrame, counts: DataFrame) -> tuple[Mixture, int]:
    """The mixture, and the number of training tokens. The driver gets a fixed number of cells."""
    sums = counts.where("sums is not null").select(F.posexplode("sums").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("x"))
    found = {r["place"]: r["x"] for r in sums.collect()}
    total_n, total_v, rest_n, rest_v = (found.get(i, 0.0) for i in range(4))
    seen, weighed = (np.array([found.get(4 + k * (BINS + 1) + i, 0.0) for i in range(BINS + 1)]) for k in range(2))
    mixture = Mixture(rest_n, rest_v, weight_of(seen, weighed / max(rest_n, 1) * (rest_v + 1)))

    for order in (2, 3):

        def expect(batches, order=order):
            """Deleted tokens by the level of their context and the ratio of the estimate to the next shorter one."""
            for block, answers in _met(batches, "rest"):
                got = Seen(block, answers, "rest")
                ratio = got.ratio(order) / mixture.estimates(got, order - 1)
                cell = level(got.contexts[order]) * (BINS + 1) + _bin(ratio)
                n, x = np.bincount(cell), np.bincount(cell, ratio)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"level": at // (BINS + 1), "bin": at % (BINS + 1), "n": n[at].astype(float), "x": x[at]})

        cells = known.mapInPandas(giving_back(expect), "level int, bin int, n double, x double").groupBy("level", "bin").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        weights = np.array([0.0, *(weight_of(n, x) for n, x in zip(*(t[1:] for t in _table(cells.collect(), LEVELS)), strict=True))])
        if order == 2:
            mixture.bigram = weights
        else:
            mixture.trigram = weights
    return Mixture(total_n, total_v, mixture.unigram, mixture.bigram, mixture.trigram), int(total_n)


def _joined(blocks: DataFrame, counts: DataFrame, column: str) -> DataFrame:
    """Each block with its answers in one row."""
    answers = counts.groupBy("block").agg(F.collect_list(F.struct("order", "bucket", column)).alias("answers"))
    return blocks.join(answers, "block")


def _met(batches: Iterator[pd.DataFrame], column: str) -> Iterator[tuple[Block, pd.DataFrame]]:
    for b in batches:
        for (_, block), answers in zip(_unpacked(b), b["answers"], strict=True):
            yield block, pd.DataFrame([(a["order"], a["bucket"], a[column]) for a in answers], columns=["order", "bucket", column])


def score_documents(docs: DataFrame, block_tokens: int = 1_000_000, bucket_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are one end token. A null doc_id has the fold of an empty
    text. Repeated rows are documents of their own. Without training documents all
    estimates are uniform. An empty table gives no rows; other columns are not read,
    and the rows may come in any order. A text longer than ``block_tokens`` is a block
    by itself, so a task holds some 100 bytes for each token of its longest text.
    N-grams are compared by hashes of 56 bits.
    """
    blocks = _stored_blocks(docs, block_tokens)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(20, max(8, int(np.ceil(np.log2(max(size // bucket_bytes, 1))))))
    counts = None
    for orders in PASSES:
        answered = _asked(blocks, bits, orders).groupBy("order", "bucket").applyInPandas(lambda rows: _answer(rows, bits), COUNTS)
        answers = stored(answered, "lm-counts", drop_shuffles=True)
        counts = answers if counts is None else counts.unionByName(answers)
    known = stored(_joined(blocks.where(F.col("role") == DELETED), counts.where("rest is not null"), "rest"), "lm-deleted", drop_shuffles=True)
    mixture, train = _learned(known, counts)

    def score(batches):
        for block, answers in _met(batches, "total"):
            got = Seen(block, answers, "total")
            c = got.counts[1]
            out = pd.DataFrame(
                {
                    "doc_id": pd.array(np.where(block.ids == NO_ID, 0, block.ids), "Int64"),
                    "held_out": block.role == HELD,
                    "n_tokens": block.lengths,
                    "n_known": np.add.reduceat((c > 0).astype(np.int64), block.starts),
                    "train_tokens": train,
                    "base_score": np.add.reduceat(np.log10((c + 1) / (mixture.n + mixture.v + 1)), block.starts),
                    "score": np.add.reduceat(np.log10(mixture.estimates(got, 3)), block.starts),
                }
            )
            out.loc[block.ids == NO_ID, "doc_id"] = pd.NA
            yield out

    return _joined(blocks, counts, "total").mapInPandas(giving_back(score), SCORED)


def op1_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; the fold of remainder 2 is held out."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
