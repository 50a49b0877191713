"""Byte-level BPE: recursive DuckDB queries over the distinct words of a partition.

A worker keeps a DuckDB connection with the merge table: each pair of tokens whose
bytes together are a token, and that token's rank. A word's bytes are rows (word,
pos, id). A recursive query joins them with the merge table and contracts the
leftmost pair of minimum rank until none is left. Ids are decoded by joining them
with the tokens and aggregating the bytes in order of their positions. Words that a
worker has met are remembered, within bounds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import giving_back

# Between two other characters a space always opens a new piece (\S here is narrower than the tokenizer's, so this is on the safe side).
GAP = re.compile(r"(?<=\S) (?=\S)")
# Up to so many bytes a part is contracted pair by pair, a longer one by all pairs of a rank at once.
SHORT = 32
BLOCK_CHARS, PART_BYTES, DECODED_AT_ONCE = 4_000_000, 200_000, 1_000_000

# One pair of each word a round. A row knows its right neighbour: (nxt, after) are that one's id and position.
PAIRWISE = """
WITH RECURSIVE t AS (
  SELECT word, pos, id, nxt, after, 0 AS round FROM parts
  UNION ALL
  (WITH least AS (
     SELECT word, min(merged::BIGINT << 32 | pos) AS code FROM t JOIN merges m ON m.l = t.id AND m.r = t.nxt GROUP BY word),
   chosen AS (
     SELECT c.word, (c.code >> 32)::INT AS merged, a.pos, b.pos AS gone, b.nxt, b.after
     FROM least c JOIN t a ON a.pos = c.code & 4294967295 JOIN t b ON b.pos = a.after)
   SELECT t.word, t.pos, CASE WHEN t.pos = c.pos THEN c.merged ELSE t.id END,
          CASE WHEN t.pos = c.pos THEN c.nxt WHEN t.after = c.pos THEN c.merged ELSE t.nxt END,
          CASE WHEN t.pos = c.pos THEN c.after ELSE t.after END, round + 1
   FROM t JOIN chosen c ON c.word = t.word WHERE t.pos <> c.gone))
SELECT word, id FROM t JOIN (SELECT word, max(round) AS round FROM t GROUP BY word) USING (word, round) ORDER BY pos
"""

# All pairs of minimum rank of a word a round, from the left up to the first whose contraction makes a pair
# of lower rank, which must then come first. Equal tokens in a row pair up from the left. Contracted positions
# are overwritten: the state is keyed by position, so memory does not grow with the rounds.
AT_ONCE = """
WITH RECURSIVE t(pos, word, id) USING KEY (pos) AS (
  SELECT pos, word, id FROM parts
  UNION
  (WITH near AS (
     SELECT word, pos, id, row_number() OVER o AS n, lag(id) OVER o AS before, lead(id) OVER o AS nxt, lead(pos) OVER o AS after, lead(id, 2) OVER o AS beyond
     FROM recurring.t WHERE id >= 0 WINDOW o AS (PARTITION BY word ORDER BY pos)),
   able AS (SELECT near.*, m.merged FROM near JOIN merges m ON m.l = near.id AND m.r = near.nxt),
   low AS (SELECT *, n - row_number() OVER (PARTITION BY word ORDER BY pos) AS run FROM able JOIN (SELECT word, min(merged) AS merged FROM able GROUP BY word) USING (word, merged)),
   apart AS (SELECT * FROM low QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1),
   beside AS (SELECT *, CASE WHEN lag(n) OVER (PARTITION BY word ORDER BY pos) = n - 2 THEN merged ELSE before END AS left_id FROM apart),
   judged AS (
     SELECT b.*, coalesce(x.merged < b.merged, false) OR coalesce(y.merged < b.merged, false) AS last
     FROM beside b LEFT JOIN merges x ON x.l = b.left_id AND x.r = b.merged LEFT JOIN merges y ON y.l = b.merged AND y.r = b.beyond),
   taken AS (
     SELECT * FROM judged
     QUALIFY NOT coalesce(bool_or(last) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false))
   SELECT pos, word, merged FROM taken UNION ALL SELECT after, word, -1 FROM taken))
SELECT word, id FROM t WHERE id >= 0 ORDER BY pos
"""

DECODED = "SELECT row, unhex(string_agg(digits, '' ORDER BY pos)) AS bytes FROM ids JOIN tokens USING (id) GROUP BY row"


def _cut(data, at: list[int]) -> list:
    """The slices of ``data`` between each of the places and the next."""
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


class Remembered(dict):
    """Numbers keys as they are asked for; ``values_`` holds what is known of each, ``new`` the keys of which nothing is.

    Two generations of about ``most`` keys are kept.
    """

    def __init__(self, most: int):
        self.most, self.values_, self.old, self.new = most, [], {}, []

    def __missing__(self, key):
        self[key] = number = len(self.values_)
        value = self.old.get(key)
        self.values_.append(value)
        if value is None:
            self.new.append(key)
        return number

    def begin(self) -> None:
        """Before a block, whose keys then stay until the next one."""
        self.new = []
        if len(self) > self.most:
            self.old = {k: v for k, v in zip(self, self.values_, strict=True) if len(k) <= SHORT}
            self.values_ = []
            self.clear()


class ByteBPE:
    """Encodes and decodes by a file of ranks; one for each worker process."""

    def __init__(self, path: str, pattern: str, most: int = 400_000):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.chunks, self.pieces = Remembered(most), Remembered(most)
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.joined = np.zeros((256, 256), bool)  # bytes that follow each other within some token
        rows = []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                self.joined[token[i - 1], token[i]] = True
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    rows.append((left, right, rank))
        top = max(self.ranks.values()) + 1
        self.held, self.names = np.zeros(top, bool), np.arange(top).astype(str).astype(object)
        self.held[list(self.ranks.values())] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        self._table("merges", **dict(zip(("l", "r", "merged"), np.array(rows, np.int32).reshape(-1, 3).T, strict=True)))
        self._table("tokens", id=np.array(list(self.ranks.values()), np.int32), digits=[token.hex() for token in self.ranks])

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _parts(self, word: bytes) -> list[bytes]:
        """A word cut where no token holds both bytes, so that no contraction crosses a cut."""
        if len(word) <= SHORT:
            return [word]
        codes = np.frombuffer(word, np.uint8)
        cuts = [0, *(np.flatnonzero(~self.joined[codes[:-1], codes[1:]]) + 1).tolist(), len(word)]
        return _cut(word, cuts)

    def _contracted(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct parts, as 32-bit numbers."""
        out, block, size = {}, [], 0
        for sql, some in ((PAIRWISE, [p for p in parts if len(p) <= SHORT]), (AT_ONCE, [p for p in parts if len(p) > SHORT])):
            for n, part in enumerate(some, 1):
                block.append(part)
                size += len(part)
                if size >= PART_BYTES or n == len(some):
                    lengths = np.array(list(map(len, block)))
                    ids = self.single[np.frombuffer(b"".join(block), np.uint8)]
                    if (ids < 0).any():
                        raise ValueError("the ranks lack a single byte")
                    pos, ends = np.arange(size, dtype=np.int32), lengths.cumsum() - 1
                    nxt = np.append(ids[1:], np.int32(-1))
                    nxt[ends] = -1
                    self._table("parts", word=np.repeat(np.arange(len(block), dtype=np.int32), lengths), pos=pos, id=ids, nxt=nxt, after=pos + np.int32(1))
                    found = self.db.sql(sql).to_arrow_table()
                    codes, cuts = found["id"].to_numpy().tobytes(), 4 * np.searchsorted(found["word"].to_numpy(), np.arange(len(block) + 1))
                    out.update(zip(block, _cut(codes, cuts.tolist()), strict=True))
                    block, size = [], 0
        return out

    def _learn(self) -> None:
        """Gives the new pieces their ids."""
        words = {p: p.encode() for p in self.pieces.new}
        cut = {w: self._parts(w) for w in words.values() if w not in self.ranks}
        known = self._contracted(list({x for parts in cut.values() for x in parts}))
        for piece, word in words.items():
            parts = cut.get(word)
            ids = struct.pack("=i", self.ranks[word]) if parts is None else known[word] if len(parts) == 1 else b"".join(known[x] for x in parts)
            self.pieces.values_[self.pieces[piece]] = ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Chunks between spaces are looked up; new ones are split into pieces, and those are encoded if new."""
        self.chunks.begin()
        self.pieces.begin()
        number, piece_number = self.chunks.__getitem__, self.pieces.__getitem__
        rows = [GAP.split(text) for text in texts]
        heads = [list(map(piece_number, self.split(row[0]))) for row in rows]
        rows = [list(map(number, row[1:])) for row in rows]
        found = [list(map(piece_number, self.split(f" {chunk}"))) for chunk in self.chunks.new]
        self._learn()
        of_piece, of_chunk = self.pieces.values_.__getitem__, self.chunks.values_
        for chunk, pieces in zip(self.chunks.new, found, strict=True):
            of_chunk[number(chunk)] = b"".join(map(of_piece, pieces)) if len(pieces) > 1 else of_piece(pieces[0])
        return [np.frombuffer(b"".join([*map(of_piece, head), *map(of_chunk.__getitem__, row)]), np.int32) for head, row in zip(heads, rows, strict=True)]

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """Bytes of each row of ids."""
        ids, lengths = np.concatenate([np.empty(0, np.int32), *rows]).astype(np.int32), list(map(len, rows))
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.held) and self.held[ids].all()):
            raise ValueError("an id is not of this vocabulary")
        row, pos, out = np.repeat(np.arange(len(rows), dtype=np.int32), lengths), np.arange(len(ids), dtype=np.int32), [[] for _ in rows]
        for i in range(0, len(ids), DECODED_AT_ONCE):
            part = slice(i, i + DECODED_AT_ONCE)
            self._table("ids", row=row[part], pos=pos[part], id=ids[part])
            found = self.db.sql(DECODED).to_arrow_table()
            for n, data in zip(found["row"].to_pylist(), found["bytes"].to_pylist(), strict=True):
                out[n].append(data)
        return list(map(b"".join, out))


@lru_cache(2)
def _worker(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def _blocks(sizes: Iterable[int], most: int) -> Iterator[slice]:
    """Slices of rows that end where their sizes reach ``most``."""
    start, total, n = 0, 0, 0
    for n, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            yield slice(start, n)
            start, total = n, 0
    if start < n:
        yield slice(start, n)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return ["" if x is None else x.decode("utf-8", "replace") for x in batch.column("text").to_pylist()]


def _named(docs: DataFrame, column: str, kind: str) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[column].cast(kind).alias(column))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids): the ids of each whole text, one row per row, no shuffle.

    Each match of ``pattern`` is encoded by itself by the ranks of the file ``path``,
    which all machines hold; no special tokens. A null text has no ids; bytes that
    are no UTF-8 count as U+FFFD. Repeated rows stay, other columns are not read.
    A task holds about ``BLOCK_CHARS`` characters and one text at a time.
    """

    def run(batches):
        model = _worker(path, pattern)
        for batch in batches:
            texts = _texts(batch)
            for part in _blocks(map(len, texts), BLOCK_CHARS):
                ids = pa.array(model.encode(texts[part]), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], ids], ["doc_id", "ids"])

    return _named(docs, "text", "binary").mapInArrow(giving_back(run), "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, bytes); null ids count as none, an id that the file does not hold is an error."""

    def run(batches):
        model = _worker(path, pattern)
        for batch in batches:
            ids = [np.array(x or [], np.int32) for x in batch.column("ids").to_pylist()]
            for part in _blocks(map(len, ids), BLOCK_CHARS):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], pa.array(model.decode(ids[part]), pa.binary())], ["doc_id", "bytes"])

    return _named(rows, "ids", "array<int>").mapInArrow(giving_back(run), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256), by ``encode`` and ``decode`` in one pass."""

    def run(batches):
        model = _worker(path, pattern)
        code = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            texts = _texts(batch)
            for part in _blocks(map(len, texts), BLOCK_CHARS):
                ids = model.encode(texts[part])
                columns = [pa.array(map(len, ids), pa.int64()), pa.array(code(" ".join(model.names[x]).encode()) for x in ids), pa.array(map(code, model.decode(ids)))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _named(docs, "text", "binary").mapInArrow(giving_back(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_recursive_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents, and of what they decode to."""
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
