"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes
are embedded, and learned filters of eight bytes slide over each chunk by two. The
maximum of each filter over a chunk is taken; of those, the maximum, the mean by
length and the minimum over all chunks of the text, and its length, go through a
small hidden layer into one probability. The minimum tells of a chunk in which
little happens, such as a word said again and again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import named
from .memory import give_back

CHUNK, STEP, PAD = 256, 192, 256
DIM, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 2, 48, 24
PLACES = (CHUNK - WIDTH) // STRIDE + 1


def chunks_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of a text as rows of byte values (256: none), and how many bytes each has."""
    n = len(data)
    starts = range(0, max(n - (CHUNK - STEP), 1), STEP)
    out = np.full(((len(starts) - 1) * STEP + CHUNK), PAD, np.int16)
    out[:n] = np.frombuffer(data, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(out, CHUNK)[::STEP]
    return rows, np.array([min(CHUNK, max(n - s, 1)) for s in starts], np.float32)


def is_full(sizes: np.ndarray, chunks) -> np.ndarray:
    """Chunks that the minimum looks at: all but a short rest at the end of other chunks."""
    return (sizes >= CHUNK // 2) | (np.asarray(chunks) == 1)


def length_of(total: np.ndarray) -> np.ndarray:
    """The length of texts as one number each."""
    return (np.log2(total) / 10 - 1)[:, None].astype("f4")


def _bytes(text: str | None) -> bytes:
    return (text if isinstance(text, str) else "").encode("utf-8", "surrogatepass")


class Network:
    """Embedding, filters, and the two layers on the pooled filters."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (257, DIM)).astype("f4"),
            "filters": r.normal(0, 0.15, (WIDTH * DIM, FILTERS)).astype("f4"),
            "bias": np.zeros(FILTERS, "f4"),
            "hidden": r.normal(0, 0.03, (3 * FILTERS + 1, HIDDEN)).astype("f4"),
            "shift": np.zeros(HIDDEN, "f4"),
            "out": r.normal(0, 0.3, HIDDEN).astype("f4"),
            "base": np.zeros(1, "f4"),
        }
        self.scale, self.prior = 1.0, 0.0

    def maxima(self, rows: np.ndarray, where: bool = False, piece: int = 64) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's maximum over each chunk, and its place if asked for."""
        tops, places = [], []
        for i in range(0, len(rows), piece):
            some = rows[i : i + piece]
            x = self.p["embed"][some].reshape(len(some) * (CHUNK // STRIDE), STRIDE * DIM)
            z = np.zeros((len(some), PLACES, FILTERS), "f4")
            for k in range(WIDTH // STRIDE):  # a filter in parts of a stride's bytes
                part = self.p["filters"][k * STRIDE * DIM : (k + 1) * STRIDE * DIM]
                z += (x @ part).reshape(len(some), -1, FILTERS)[:, k : k + PLACES]
            tops.append(z.max(axis=1))
            if where:
                places.append(z.argmax(axis=1))
        return np.concatenate(tops), np.concatenate(places) if where else None

    def log_odds(self, pooled: np.ndarray) -> np.ndarray:
        """Of texts, from what is pooled over their chunks."""
        return np.tanh(pooled @ self.p["hidden"] + self.p["shift"]) @ self.p["out"] + self.p["base"]

    def gradients(self, rows: np.ndarray, sizes: np.ndarray, starts: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the weighted logistic loss of texts whose chunks begin at ``starts``; and the log odds. Only maxima pass any back."""
        z, at = self.maxima(rows, where=True)
        c = z + self.p["bias"]
        count = np.diff([*starts, len(rows)])
        owner = np.repeat(np.arange(len(starts)), count)
        total = np.add.reduceat(sizes, starts)
        share = (sizes / total[owner])[:, None].astype("f4")
        full = np.where(is_full(sizes, count[owner])[:, None], c, np.float32(np.inf))
        most, mean, least = np.maximum.reduceat(c, starts), np.add.reduceat(c * share, starts), np.minimum.reduceat(full, starts)
        pooled = np.concatenate([most, mean, least, length_of(total)], 1)
        hidden = np.tanh(pooled @ self.p["hidden"] + self.p["shift"])
        odds = hidden @ self.p["out"] + self.p["base"]
        error = ((1 / (1 + np.exp(-odds)) - labels) * weights / weights.sum()).astype("f4")
        inner = error[:, None] * self.p["out"] * (1 - hidden * hidden)
        back = inner @ self.p["hidden"].T
        top, low = (c == most[owner]).astype("f4"), (full == least[owner]).astype("f4")
        top, low = (x / np.add.reduceat(x, starts)[owner] for x in (top, low))  # equal ones share alike
        own = back[owner]
        flow = own[:, :FILTERS] * top + own[:, FILTERS : 2 * FILTERS] * share + own[:, 2 * FILTERS : 3 * FILTERS] * low
        grads = {"out": hidden.T @ error, "base": error.sum(keepdims=True), "hidden": pooled.T @ inner, "shift": inner.sum(0), "bias": flow.sum(0)}
        n = np.arange(len(rows))[:, None, None]
        bytes_ = rows[n, at[:, :, None] * STRIDE + np.arange(WIDTH)]  # chunk, filter, byte
        patch = self.p["embed"][bytes_].reshape(len(rows), FILTERS, WIDTH * DIM)
        grads["filters"] = np.einsum("cfv,cf->vf", patch, flow)
        spread = (flow[:, :, None] * self.p["filters"].T).reshape(-1, DIM)
        grads["embed"] = np.stack([np.bincount(bytes_.ravel(), spread[:, d], 257) for d in range(DIM)], 1)
        return grads, odds

    def fit(self, texts: list[bytes], labels: np.ndarray, ratio: float, visits: int = 18_000, rate: float = 4e-3, seed: int = 7, batch: int = 96) -> Network:
        """Adam over whole texts, both labels alike. Then a scale and a prior.

        ``ratio``: how many times as frequent label 1 is as label 0 outside the sample.
        Each text is visited as often as makes ``visits`` in all, 2 to 8 times. A step
        takes texts of about ``batch`` chunks together, one text at least.
        """
        epochs = max(2, min(8, round(visits / len(texts))))
        count = np.array([len(range(0, max(len(t) - (CHUNK - STEP), 1), STEP)) for t in texts])
        w = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1))
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            group = np.cumsum(count[order]) // batch
            for pick in np.split(order, np.flatnonzero(np.diff(group)) + 1):
                step += 1
                cut = [chunks_of(texts[i]) for i in pick]
                starts = np.cumsum([0, *(len(c[0]) for c in cut[:-1])])
                grads, _ = self.gradients(np.concatenate([c[0] for c in cut]), np.concatenate([c[1] for c in cut]), starts, labels[pick], w[pick])
                for k, g in grads.items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] -= (rate * 0.5**epoch * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype("f4")
        self._scale_to(self._odds(texts), labels.astype("f8"))
        self.prior += float(np.log(ratio * (labels == 0).sum() / (labels == 1).sum()))
        return self

    def _scale_to(self, odds: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression on one input by Newton steps, held back by a weak prior."""
        a, b = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
            s = p * (1 - p) + 1e-6
            g = np.array([((p - y) * odds).sum() + (a - 1), (p - y).sum() + 0.01 * b])
            h = np.array([[(s * odds * odds).sum() + 1, (s * odds).sum()], [(s * odds).sum(), s.sum() + 0.01]])
            a, b = np.array([a, b]) - np.linalg.solve(h, g)
        self.scale, self.prior = float(a), float(b)

    def _odds(self, texts: Iterable[bytes], batch: int = 512) -> np.ndarray:
        """Log odds of each text. Chunks of many texts go through together, a very long text in parts."""
        pools, waiting, held = [], [], 0

        def flush():
            if waiting:
                c, at = self.maxima(np.concatenate([x[1] for x in waiting]))[0] + self.p["bias"], 0
                for pool, rows, sizes, full in waiting:
                    own, at = c[at : at + len(rows)], at + len(rows)
                    pool[0] = np.maximum(pool[0], own.max(axis=0))
                    pool[1] = pool[1] + sizes @ own
                    pool[2] = np.minimum(pool[2], own[full].min(axis=0, initial=np.inf))
                waiting.clear()

        total = []
        for data in texts:
            pools.append([np.full(FILTERS, -np.inf, "f4"), np.zeros(FILTERS, "f4"), np.full(FILTERS, np.inf, "f4")])
            rows, sizes = chunks_of(data)
            total.append(float(sizes.sum()))
            full = is_full(sizes, len(rows))
            for i in range(0, len(rows), batch):
                waiting.append((pools[-1], rows[i : i + batch], sizes[i : i + batch], full[i : i + batch]))
                held += len(waiting[-1][1])
                if held >= batch:
                    flush()
                    held = 0
        flush()
        if not pools:
            return np.zeros(0)
        total = np.array(total, "f4")
        most, mean, least = (np.stack([p[k] for p in pools]) for k in range(3))
        return self.log_odds(np.concatenate([most, mean / total[:, None], least, length_of(total)], 1))

    def scores(self, texts: Iterator[str | None]) -> list[float]:
        """Probability of each text."""
        z = self.scale * self._odds(_bytes(t) for t in texts) + self.prior
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def fold(doc_id: Column, folds: int) -> Column:
    """CRC-32 of the doc_id as text, modulo folds; null for null."""
    return F.crc32(doc_id.cast("string")) % folds


def _fitting(rows: list, sample_bytes: int, share: int = 16) -> list:
    """Rows in order of place as long as their sizes fit together; one over 1 / ``share`` of the bound is passed over, unless it is the smallest of its label and fits."""
    smallest = {y: min((r["size"], r["place"], r["id"]) for r in rows if r["y"] == y) for y in {r["y"] for r in rows}}
    must = [r for r in rows if (r["size"], r["place"], r["id"]) == smallest[r["y"]]]
    left, out = sample_bytes, []
    for r in sorted(must, key=lambda r: r["size"]) + sorted((r for r in rows if r not in must and r["size"] <= sample_bytes // share), key=lambda r: (r["place"], r["id"])):
        if r["size"] <= left:
            out.append(r)
            left -= r["size"]
    return out


def train_quality(docs: DataFrame, labels: DataFrame, per_label: int = 3000, sample_bytes: int = 96 << 20, skip_fold: tuple[int, int] | None = (5, 0)) -> Network | None:
    """Fits the network to labels.quality on whole texts.

    The sample is bounded: at most ``per_label`` rows of either label, chosen by a
    hash of doc_id; of these, in that order, those that fit into ``sample_bytes`` bytes
    together, a text over a sixteenth of that only if its label has no smaller one. Of
    rows that repeat a doc_id one text is learned from. ``skip_fold`` (folds, remainder) leaves those doc_ids out. Rows with
    null doc_id or label are not used. None if either label is missing.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"))
    if skip_fold:
        usable = usable.where(fold(F.col("id"), skip_fold[0]) != skip_fold[1])
    order = F.xxhash64(F.lit("train"), "id")
    picked = usable.where("y = 0").orderBy(order, "id").limit(per_label).unionByName(usable.where("y = 1").orderBy(order, "id").limit(per_label))
    # One text of each labelled id, told by its hash: at most 2 * per_label narrow rows, of whose texts those that fit are collected.
    text = F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8")
    told = docs.select(docs["doc_id"].alias("id"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("size")).join(F.broadcast(picked), "id")
    one = told.groupBy("id", "y").agg(F.min(F.struct("h", "size")).alias("t")).select("id", "y", "t.h", "t.size", order.alias("place"))
    fits = _fitting(one.collect(), sample_bytes)
    chosen = docs.sparkSession.createDataFrame([(r["id"], r["h"], r["y"]) for r in fits], "id long, h long, y int")
    data = docs.select(docs["doc_id"].alias("id"), F.xxhash64(text).alias("h"), text.alias("data")).join(F.broadcast(chosen), ["id", "h"])
    rows = sorted(data.dropDuplicates(["id", "y"]).select("id", "data", "y").collect(), key=lambda r: (r["id"], r["y"]))
    y = np.array([r["y"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    texts = [bytes(r["data"]) for r in rows]
    del rows
    return Network().fit(texts, y, counts[1] / counts[0])


def score_quality(docs: DataFrame, model: Network | None) -> DataFrame:
    """(…, text) with a column score added; without a model 0.5.

    Null and empty texts are scored as a chunk without bytes. The text is the only
    input. Other columns are kept as they are; one named score is replaced.
    """
    keep = [named(docs, c) for c in docs.columns if c != "score"]
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias("score"))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts), dtype="float64")
        give_back()

    return docs.select(*keep, score(docs["text"]).alias("score"))


def op8_byte_cnn(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of the fold of remainder 0 are not learned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_quality(docs, model)
    return out.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
