"""Spans found in one pass against folds line by line, on random and long texts."""

import random
import re
import time

import pytest

from lodestrata.functions import spans
from lodestrata.functions import text as t


def braces(lines, start):
    depth, seen = 0, False
    for n, line in enumerate(lines[start : start + spans.GIVE_UP + 2], 1):
        depth += line.count("{") - line.count("}")
        seen |= "{" in line
        if seen and depth <= 0:
            return n
    return 1


def indents(lines, start):
    own, last = spans.indent_of(lines[start]), 0
    for n, line in enumerate(lines[start + 1 :], 1):
        if line.strip(t.WHITE):
            if spans.indent_of(line) <= own:
                break
            last = n
    return last + 1


def keywords(lines, start):
    depth, seen, loop = 0, False, False
    for n, line in enumerate(lines[start : start + spans.GIVE_UP + 2], 1):
        for word in re.findall(r"[A-Za-z0-9_]+", line):
            opens = word in ("function", "if", "repeat", "for", "while") or (word == "do" and not loop)
            closes = word in ("end", "until")
            loop = word in ("for", "while") or (loop and word != "do")
            depth, seen = depth + opens - closes, seen or opens
            if closes and seen and depth <= 0:
                return n
    return 1


CASES = [
    (braces, spans.brace_lengths, ["{", "}", "a {", "} else {", "{ { }", "} }", "x", "", "{}", "}{"]),
    (indents, spans.indent_lengths, ["a", " b", "  c", "\td", "", "   ", "    e", "\x0b", " \t f", "\u2003"]),
    (keywords, spans.keyword_lengths, ["function f()", "end", "if x then", "for i = 1, 2 do", "while", "do", "end end", "repeat", "until x", "x = 1", "", "send ender 2end", "do end", "else"]),
]


@pytest.mark.parametrize(("slow", "fast", "pieces"), CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_lengths_equal_a_fold(slow, fast, pieces):
    r = random.Random(4)
    for _ in range(300):
        lines = [r.choice(pieces) for _ in range(r.randint(1, 40))]
        starts = [r.randrange(len(lines)) for _ in range(r.randint(1, 8))]
        assert fast(lines, starts) == [slow(lines, s) for s in starts], lines


@pytest.mark.parametrize(("slow", "fast", "opening"), [(braces, spans.brace_lengths, "{"), (keywords, spans.keyword_lengths, "if")])
def test_search_is_given_up(slow, fast, opening):
    for n in (spans.GIVE_UP - 1, spans.GIVE_UP, spans.GIVE_UP + 1):
        lines = [opening, *["x"] * n, "}" if opening == "{" else "end"]
        assert fast(lines, [0]) == [slow(lines, 0)]
    assert fast([opening, *["x"] * spans.GIVE_UP, "}" if opening == "{" else "end"], [0]) == [spans.GIVE_UP + 2]


@pytest.mark.parametrize("language", ["Rust", "Python", "Lua", "TypeScript", "Go", "Java"])
def test_decisions_of_a_span(language):
    text = "if a && b { c ? d : e }\n// if\nwhile x:\n  for y in z and w:\n\nelif match case => q?.r ?? s\nfor i do if or not while"
    view = spans.view(text, language, True)
    before = spans.decisions_of(view, language)
    lines = view.split("\n")
    pattern = spans._DECISIONS.get(language)
    for a in range(len(lines)):
        for b in range(a + 1, len(lines) + 1):
            assert before[b] - before[a] == len(pattern.findall("\n".join(lines[a:b])))


def test_a_file_of_many_functions_is_linear():
    """Open braces that are never closed: each function looks for its end in all that follows."""
    def took(n):
        text = "fn f() { if x {\n" * n
        began = time.perf_counter()
        assert len(spans.measured(text, "Rust")) == n
        return time.perf_counter() - began

    took(100)
    assert took(16_000) < 40 * took(1_000) + 0.2


def test_functions_of_odd_texts():
    assert spans.measured("", "Rust") == [] and spans.measured("fn f", "Markdown") == []
    assert spans.measured("fn f() {}", "Rust") == [(0, "f", 0, 1, 1)]
    assert spans.measured("fn f() {\r\n if a {\r\n}\r\n}\r\n", "Rust") == [(0, "f", 0, 4, 2)]
    assert spans.measured("\n\n  def f(a):\n    if a:\n      pass\nx", "Python") == [(0, "f", 0, 5, 2)]
    assert spans.measured("x = function(a)\n  for i = 1, 2 do y() end\nend", "Lua") == [(0, "x", 0, 3, 2)]
