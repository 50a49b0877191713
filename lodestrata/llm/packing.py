"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's ids fill whole
windows first; the rest goes to the open window that it fits best. When none
fits, the fullest is emitted and a new one opened. Windows still open at the end
of a partition are merged with those of neighbouring partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .memory import giving_back
from .tokens import encoder

END_ID = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = [c.split()[0] for c in PIECE.split(", ")]


class Packer:
    """Open windows of one partition. A piece is (doc_id, start, ids as bytes, tokens of the document)."""

    def __init__(self, size: int, windows: int):
        self.size, self.windows = size, windows
        self.free: list[tuple[int, int]] = []  # (free ids, window), ascending
        self.pieces: dict[int, list] = {}
        self.next = 0

    def add(self, doc_id, ids: bytes) -> Iterator[list]:
        """Places a document; yields the windows that are closed by it."""
        total, start = len(ids) // 4, 0
        while total - start >= self.size:
            yield [(doc_id, start, ids[4 * start : 4 * (start + self.size)], total)]
            start += self.size
        rest = total - start
        if not rest:
            return
        piece = (doc_id, start, ids[4 * start :], total)
        at = bisect_left(self.free, (rest, -1))
        if at < len(self.free):
            free, window = self.free.pop(at)
        else:
            if len(self.free) >= self.windows:
                yield self.pieces.pop(self.free.pop(0)[1])
            free, window, self.next = self.size, self.next, self.next + 1
            self.pieces[window] = []
        self.pieces[window].append(piece)
        if free == rest:
            yield self.pieces.pop(window)
        else:
            insort(self.free, (free - rest, window))

    def rest(self) -> list[list]:
        """The windows still open, fullest first."""
        return [self.pieces[w] for _, w in self.free]


def _rows(windows, first: int, keep_ids: bool) -> list[tuple]:
    out = []
    for n, pieces in enumerate(windows):
        offset = 0
        for doc_id, start, ids, total in pieces:
            length = len(ids) // 4
            out.append((doc_id, start, length, zlib.crc32(ids), total, first + n, offset, ids if keep_ids else None))
            offset += length
    return out


def pack(
    docs: DataFrame, tokenizer: str, size: int = 2048, windows: int = 64, merged_partitions: int = 64, keep_ids: bool = False
) -> DataFrame:
    """(doc_id, text) -> one row per piece, columns as in ``PIECE``; ``keep_ids`` adds the ids as little-endian bytes.

    ``tokenizer`` is the path of a tokenizer file, the same on every machine.
    Null text counts as empty: one piece with the end id. Null doc_ids and
    repeated rows are packed as rows of their own. A text longer than a window
    is cut. An empty table gives no rows; other columns are not read. Memory: the
    open windows of a partition; a merge reads those of ``merged_partitions``.
    """
    schema = f"{PIECE}, ids binary, part long, open boolean"

    def place(batches):
        part, packer, count = TaskContext.get().partitionId(), Packer(size, windows), 0
        for batch in batches:
            closed = []
            for doc_id, ids in zip(batch["doc_id"], encoder(tokenizer, END_ID).encode(batch["text"]), strict=True):
                closed += packer.add(None if pd.isna(doc_id) else int(doc_id), ids)
            yield _frame(_rows(closed, (part << 32) + count, keep_ids), part, False)
            count += len(closed)
        yield _frame(_rows(packer.rest(), (part << 32) + count, True), part, True)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        # Windows in order, cut where a sequence is full; the last one may stay short.
        rows = rows.sort_values(["sequence_id", "offset"], kind="stable")
        windows_, current, room, first = [], [], size, int(rows["sequence_id"].min())
        for doc_id, start, ids, total in zip(rows["doc_id"], rows["start"], rows["ids"], rows["doc_tokens"], strict=True):
            doc_id, ids, start = None if pd.isna(doc_id) else int(doc_id), bytes(ids), int(start)
            while ids:
                head, ids = ids[: 4 * room], ids[4 * room :]
                current.append((doc_id, start, head, int(total)))
                start, room = start + len(head) // 4, room - len(head) // 4
                if not room:
                    windows_.append(current)
                    current, room = [], size
        return _frame(_rows([*windows_, *([current] if current else [])], first + (1 << 31), keep_ids), 0, False)

    placed = stored(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInPandas(giving_back(place), schema), "packed")
    merged = placed.where("open").groupBy(F.expr(f"part div {merged_partitions}")).applyInPandas(merge, schema)
    return placed.where("not open").unionByName(merged).select(*COLUMNS, *(["ids"] if keep_ids else []))


def _frame(rows: list[tuple], part: int, is_open: bool) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[*COLUMNS, "ids"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out.assign(part=part, open=is_open)


def op3_open_window_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
