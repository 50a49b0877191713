"""Ids of a public tokenizer, word by word, with a bounded memory of words."""

from __future__ import annotations

import os
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import batched

import pyarrow as pa
import pyarrow.compute as pc

# Separators that Python's split() takes for white space and the tokenizer does not.
ODD = "\x1c\x1d\x1e\x1f"
# Signs that a tokenizer of this kind always splits from the letters before them.
TAIL = ".,;:!?|%&*#$"
CUT = f"([A-Za-z])([{TAIL}])"
# Texts that are made ready at once.
GROUP = 64
# A byte-level model names each byte by a printable character: its own, or one from U+0100 on.
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_NAMES = {b: chr(b) for b in _OWN} | {b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if b not in _OWN)}


class Remembered(dict):
    """What ``make`` gives for each key, in two generations of ``most`` each: when the younger is full, it becomes the older one."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def lowered(text: str) -> str:
    """The text in lower case, if a tokenizer that composes and then lower-cases makes the same of both."""
    lower = text.lower()
    composed = text.isascii() or all(unicodedata.is_normalized("NFC", x) for x in (text, lower))
    return lower if composed and "\u03a3" not in text and lower.lower() == lower else text  # a last capital sigma depends on its place


def parted(texts: list[str]) -> list[str]:
    """Texts with the same ids, whose words differ less: in lower case, with signs apart from the letters before them."""
    rows = pa.array(map(lowered, texts), pa.large_string())
    return pc.replace_substring_regex(rows, CUT, r"\1 \2").to_pylist()


class Encoder:
    """Encodes texts with a tokenizer whose ids of a text are those of its words in turn.

    That holds for the file word_bpe_49k.json: white space is dropped and never part
    of a token; letters are composed, lower-cased and named byte by byte before the
    model splits them. A word of letters, and signs after it, goes to the model
    directly, any other word through the whole tokenizer. A text with odd separators
    is encoded whole.

    Words are remembered, about 200 bytes each; before that, case and signs that many
    words share are taken off.
    """

    def __init__(self, path: str, end_id: int | None = None, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.model.tokenize
        self.known, self.tails = Remembered(self._word, most), Remembered(self._whole, 10_000)
        self.end = b"" if end_id is None else struct.pack("<I", end_id)

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        stem = word.rstrip(TAIL)
        tail = word[len(stem) :]
        if stem.isascii():
            letters = named = stem.lower()
        else:
            letters = "".join(map(str.lower, unicodedata.normalize("NFC", stem)))
            named = letters.encode().decode("latin-1").translate(BYTE_NAMES)
        if not letters.isalpha() or not stem.isalpha():
            return self._whole(word)
        ids = self._bytes([t.id for t in self.split(named)])
        return ids + self.tails[tail] if tail else ids

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; null is empty."""
        for group in batched(texts, GROUP):
            # A text with a special token, which is told by its case, is not parted.
            able = [isinstance(x, str) and "<|" not in x and not any(c in x for c in ODD) for x in group]
            ready = iter(parted([x for x, y in zip(group, able, strict=True) if y]))
            for text, is_able in zip(group, able, strict=True):
                if not isinstance(text, str):
                    yield self.end
                elif not is_able and any(c in text for c in ODD):
                    yield self._whole(text) + self.end
                else:
                    yield b"".join(map(self.known.__getitem__, (next(ready) if is_able else text).split())) + self.end


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int | None = None) -> Encoder:
    """An encoder that the worker process keeps from task to task, with the words that it remembers."""
    return Encoder(path, end_id)
