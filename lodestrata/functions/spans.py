"""Spans of functions and the decisions in them, all of a file in one pass.

Depths are summed once along a file. A function ends where the depth is first back
at its own; the answers for all functions come from one walk over the file from its
end, with a stack of the places where the depth falls and a binary search in it.
Decisions are counted once for each line and summed, so that a span's are a
difference. Nested and unfinished functions cost no more than others.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from . import text as t
from .views import INT, TEXT, _fields, each_file, functions_in, view

GIVE_UP = 3000  # lines
NEVER = 1 << 60
FEW = 8  # so many functions look for their ends one by one
_WORD = re.compile(r"[A-Za-z0-9_]+")
_INDENT = re.compile(r"[ \t]*")
_OPENING, _LOOPS, _CLOSING = {"function", "if", "repeat"}, {"for", "while"}, {"end", "until"}
# Each way starts with a letter or a sign of its own, and what may not stand before it is looked at last: a search stops at few places so.
_DECISIONS = {
    language: re.compile("|".join([*(f"{word}(?<!{t.IDENT}{word}){t.NOT_AFTER}" for word in keywords.split()), *([r"&&|\|\|"] if symbols else []), *([r"\?(?<!\?\?)(?![.?:])"] if ternary else [])]))
    for languages, keywords, symbols, ternary in rules.DECISIONS
    for language in languages
}


def first_at_most(values: list[int], asked: list[tuple[int, int]]) -> list[int | None]:
    """For each (start, limit), the first place from ``start`` on whose value is at most ``limit``; None if there is none."""
    if len(asked) <= FEW:
        return [next((n for n, value in enumerate(islice(values, start, None), start) if value <= limit), None) for start, limit in asked]
    out: list[int | None] = [None] * len(asked)
    waiting = sorted(range(len(asked)), key=lambda n: -asked[n][0])
    # From bottom to top places go down and values up: from the top on, each is the next lower value to the right.
    places, heights, next_ = [], [], 0
    for place in range(len(values) - 1, -1, -1):
        while heights and heights[-1] >= values[place]:
            heights.pop()
            places.pop()
        heights.append(values[place])
        places.append(place)
        while next_ < len(waiting) and asked[waiting[next_]][0] >= place:
            start, limit = asked[waiting[next_]]
            at = bisect_right(heights, limit) - 1
            if start == place and at >= 0:
                out[waiting[next_]] = places[at]
            next_ += 1
    return out


def _following(marked: list[bool]) -> list[int]:
    """For each place the first marked one from it on; the length if there is none."""
    out, now = [len(marked)] * len(marked), len(marked)
    for i in range(len(marked) - 1, -1, -1):
        now = out[i] = i if marked[i] else now
    return out


def brace_lengths(lines: list[str], starts: list[int]) -> list[int]:
    """Lines up to the one on which the braces are balanced again; 1 if none within GIVE_UP."""
    return brace_lengths_of("\n".join(lines), starts)


def brace_lengths_of(text: str, starts: list[int]) -> list[int]:
    """The same of a text. Only lines with braces are looked at: no other changes a depth."""
    lines_of, opens, depth, now = [], [], [], 0
    for n, line in enumerate(text.split("\n")):
        opened, closed = line.count("{"), line.count("}")
        if opened or closed:
            now += opened - closed
            lines_of.append(n)
            opens.append(opened > 0)
            depth.append(now)
    opening = [*_following(opens), len(opens)]
    firsts = [bisect_left(lines_of, s) for s in starts]
    ends = first_at_most(depth, [(opening[f], depth[f - 1] if f else 0) for f in firsts])
    return [lines_of[end] - s + 1 if end is not None and lines_of[end] - s < GIVE_UP + 2 else 1 for s, end in zip(starts, ends, strict=True)]


def indent_of(line: str) -> int:
    """A space is one wide, a tab four."""
    return sum(4 if c == "\t" else 1 for c in _INDENT.match(line)[0])


def indent_lengths(lines: list[str], starts: list[int]) -> list[int]:
    """Lines up to the last one that is not blank and deeper than the first."""
    full = [bool(x.strip(t.WHITE)) for x in lines]
    own = [indent_of(lines[s]) for s in starts]
    ends = first_at_most([indent_of(x) if f else NEVER for x, f in zip(lines, full, strict=True)], [(s + 1, o) for s, o in zip(starts, own, strict=True)])
    last = list(accumulate((i if f else -1 for i, f in enumerate(full)), max))
    return [max(last[(len(lines) if end is None else end) - 1] - s, 0) + 1 for s, end in zip(starts, ends, strict=True)]


def keyword_lengths(lines: list[str], starts: list[int]) -> list[int]:
    """Lua: lines until opening and closing keywords are balanced; a loop takes the next ``do`` with it."""
    lines_of, moves, loops, pending = [], [], [], False
    for n, line in enumerate(lines):
        for word in _WORD.findall(line):
            loop, do = word in _LOOPS, word == "do"
            move = 1 if loop or word in _OPENING or do and not pending else -1 if word in _CLOSING else 0
            if move or do:
                lines_of.append(n)
                moves.append(move)
                loops.append(pending)
            pending = loop or pending and not do
    depth = list(accumulate(moves))
    opening = _following([m > 0 for m in moves])
    firsts = [bisect_left(lines_of, s) for s in starts]
    asked = [(opening[f] if f < len(opening) else len(moves), depth[f - 1] if f else 0) for f in firsts]
    ends = first_at_most([d if m < 0 else NEVER for d, m in zip(depth, moves, strict=True)], asked)
    out = []
    for s, f, end in zip(starts, firsts, ends, strict=True):
        if f < len(loops) and loops[f]:  # a loop before the function waits for its ``do``, which the function does not know of
            rest = lines[s : s + GIVE_UP + 2]
            out.append(keyword_lengths(rest, [0])[0])
        else:
            found = end is not None and lines_of[end] - s < GIVE_UP + 2
            out.append(lines_of[end] - s + 1 if found else 1)
    return out


def decision_lines(text: str, language: str) -> list[int]:
    """The line of each decision in a text without comments and literals, in order."""
    out, line, seen = [], 0, 0
    if language in _DECISIONS:
        for m in _DECISIONS[language].finditer(text):
            line, seen = line + text.count("\n", seen, m.start()), m.start()
            out.append(line)
    return out


def decisions_of(text: str, language: str) -> list[int]:
    """How many decisions the lines before each line hold, with one more entry for all of a text."""
    found = decision_lines(text, language)
    return [bisect_left(found, n) for n in range(text.count("\n") + 2)]


def measured(text: str, language: str) -> list[tuple]:
    """(ord, name, start, length, complexity) of each function of a text."""
    blank = view(text, language, True) if language == "Lua" else None
    source = text if blank is None else blank
    found = functions_in(source, language)
    if not found:
        return []
    starts = [f[2] for f in found]
    if language in ("Lua", "Python"):
        lines = [x.removesuffix("\r") for x in source.removesuffix("\n").split("\n")]
        lengths = (keyword_lengths if language == "Lua" else indent_lengths)(lines, starts)
    else:
        lengths = brace_lengths_of(source, starts)
    if blank is None:
        blank = view(text, language, True) if language in _DECISIONS else text
    decisions = decision_lines(blank, language)
    out = []
    for (n, name, start, expression), length in zip(found, lengths, strict=True):
        length = length if expression is None else expression
        out.append((n, name, start, length, 1 + bisect_left(decisions, start + max(length, 1)) - bisect_left(decisions, start)))
    return out


_FUNCTION = _fields(ord=INT, name=TEXT, start=INT, length=INT, complexity=INT)


@F.arrow_udf(T.ArrayType(_FUNCTION))
def functions_of(content: pa.Array, language: pa.Array) -> pa.Array:
    return each_file(measured, _FUNCTION, content, language)


functions_of = functions_of.asNondeterministic()  # or filters on what is found go below it, and each text is read twice
