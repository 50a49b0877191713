"""Functions over whole texts that need places of matches: views, functions, imports.

Each is a vectorised UDF around a small helper; everything that follows from
their rows is expressed in DataFrames.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import rules



def _marked(quotes: str) -> re.Pattern:
    """Comments and literals in quotes, told apart behind their first character: a search stops at few places so."""
    literals = "".join(rf"|(?<={q})[^{q}\\]*(?:\\.[^{q}\\]*)*(?:{q}|\\?\Z)" for q in quotes)
    return re.compile(rf"([/{quotes}])(?:(?<=/)(?:/[^\n]*|\*.*?(?:\*/|\Z)){literals})", re.S)


_JS, _RUST = _marked("'\"`"), _marked('"')
_LUA = re.compile(r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*|(\[\[).*?(?:\]\]|\Z)|(['\"])(?:\\(?:[^\n]|(?=\n)|\Z)|(?!\2)[^\\\n])*(?:\2|\n|\Z)", re.S)
_PYTHON = re.compile(r"#[^\n]*|('''|\"\"\").*?(?:\1|\Z)|(['\"])(?:\\(?:[^\n]|(?=\n)|\Z)|(?!\2)[^\\])*(?:\2|\Z)", re.S)
_NOT_LINE_END = re.compile(r"[^\n]")


def _blank(text: str) -> str:
    return _NOT_LINE_END.sub(" ", text)


def _inside_blank(text: str, opening: str, closing: str) -> str:
    """A literal whose interior is blank; an unfinished one has no closing."""
    ends = len(text) >= len(opening) + len(closing) and text.endswith(closing)
    return opening + _blank(text[len(opening) : len(text) - len(closing) if ends else None]) + (closing if ends else "")


def view(text: str, language: str, strings: bool) -> str:
    """The text with comments blank and, if ``strings``, the interior of literals; line ends stay."""
    if language == "Lua":
        pattern = _LUA
    elif language == "Python":
        pattern = _PYTHON
    else:
        pattern = _RUST if language == "Rust" else _JS

    def blank(m: re.Match) -> str:
        long, quote = (m[1], m[2]) if pattern.groups == 2 else (None, m[1])
        if long and language == "Python":
            return _blank(m[0])
        if long:
            return _inside_blank(m[0], "[[", "]]") if strings else m[0]
        if quote and quote != "/":
            return _inside_blank(m[0], quote, quote) if strings else m[0]
        return _blank(m[0])

    return pattern.sub(blank, text)


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def each_file(read: Callable[[str, str], list[tuple]], fields: T.StructType, content: pa.Array, language: pa.Array) -> pa.Array:
    """The rows that ``read`` makes of each text and its language, as lists; built column by column, so that no row waits as an object of its own."""
    offsets, columns = [0], [[] for _ in fields]
    for text, name in zip(content.to_pylist(), language.to_pylist(), strict=True):
        for row in read(text or "", name or ""):
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        offsets.append(len(columns[0]))
    kinds = [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]
    rows = pa.StructArray.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], fields=kinds)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


# Types as objects: a worker that imports this module has no session to parse text.
TEXT, INT = T.StringType(), T.IntegerType()


# Functions. The patterns are fixed values.
_FUNCTIONS = {
    "Rust": [r"\bfn\s+([A-Za-z_][A-Za-z0-9_]*)"],
    "Python": [r"(?m)^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("],
    "Go": [r"func\s+(?:\([^)]*\)\s*)?([A-Za-z0-9_]+)\s*\("],
    "Lua": [
        r"(?m)^\s*(?:local\s+)?function\s+([A-Za-z_][A-Za-z0-9_.:]*)\s*\(",
        r"(?m)(?:^|\s)(?:local\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*function\s*\(",
    ],
    "js": [
        r"function\s+([A-Za-z0-9_$]+)\s*\(",
        r"(?:const|let|var)\s+([A-Za-z0-9_$]+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>",
    ],
    "brace": [r"(?m)^[ \t]*[A-Za-z_][A-Za-z0-9_<>\[\].,&\*: \t]*?\b([A-Za-z_][A-Za-z0-9_]*)\s*\([^;{}\n]*\)\s*\{"],
}
_PATTERNS = {k: [re.compile(p) for p in v] for k, v in _FUNCTIONS.items()}
_MARKS = re.compile(r"\\.|//|['\"`()\[\]{}]")
# What goes on after a line, and what a line goes on with.
GOES_ON_AFTER, GOES_ON_WITH = tuple("([{.+-*/%&|^<>=?:~!"), (".", "?", ":", "&&", "||", "+", "-", "*", "`")


def _expression_end(lines: list[str], line: int, column: int) -> int:
    """Line on which the expression that starts at a place ends.

    Brackets are balanced over lines, literals skipped; a line ends it when it is
    whole there and neither it nor the next one goes on.
    """
    depth, quote = 0, ""
    for i in range(line, len(lines)):
        text = lines[i][column:] if i == line else lines[i]
        for m in _MARKS.finditer(text):
            mark = m[0]
            if quote:
                quote = "" if mark == quote else quote
            elif mark == "//":
                text = text[: m.start()]
                break
            elif mark in "'\"`":
                quote = mark
            elif mark in "([{":
                depth += 1
            elif mark in ")]}":
                depth -= 1
        quote = quote if quote == "`" else ""
        if depth < 0:
            return i
        if not depth and not quote:
            end = text.rstrip()
            following = next((x for x in map(str.lstrip, lines[i + 1 :]) if x), "")
            if end.endswith((";", ",")) or end and not end.endswith(GOES_ON_AFTER) and not following.startswith(GOES_ON_WITH):
                return i
        if i - line > 400:
            return i
    return len(lines) - 1


def functions_in(text: str, language: str) -> list[tuple]:
    """(ord, name, start, expression_length) of each function; start is 0-based, the length is null for a braced body."""
    family = "js" if language in rules.JS else "brace" if language in rules.BRACE_METHODS else language
    if family not in _PATTERNS:
        return []
    lines, out = None, []
    for n, pattern in enumerate(_PATTERNS[family]):
        start = seen = 0  # line ends are counted from match to match
        for m in pattern.finditer(text):
            if family == "brace" and m[1] in rules.CONTROL_WORDS:
                continue
            start, seen, length = start + text.count("\n", seen, m.start()), m.start(), None
            if family == "js" and n == 1:
                lines = lines or text.split("\n")
                line = start + text.count("\n", m.start(), m.end())
                column = m.end() - (text.rfind("\n", 0, m.end()) + 1)
                body = "\n".join([lines[line][column:], *lines[line + 1 : line + 5]]).lstrip()
                if not body.startswith("{"):
                    length = max(_expression_end(lines, line, column) - start, 0) + 1
            out.append((len(out), m[1], start, length))
    return out


# Imports. The patterns are fixed values.
_TS_IMPORT = re.compile(r"import\s+(?:type\s+)?([\s\S]*?)\s+from\s*['\"]([^'\"]+)['\"]")
_PY_FROM = re.compile(r"(?m)^\s*from\s+(\S+)\s+import\s+(.+)$")
_PY_IMPORT = re.compile(r"(?m)^\s*import\s+(.+)$")
_LUA_REQUIRE = re.compile(r"\brequire\s*\(?\s*['\"]([A-Za-z0-9_./\-]+)['\"]")
_NAME = re.compile(r"[\w$]*")


def _name(text: str) -> str:
    return _NAME.match(text.strip())[0]


def _ts_names(bindings: str) -> list[str]:
    """Local names: those in braces, then the default or the namespace before them."""
    text = bindings.strip()
    before, brace, rest = text.partition("{")
    inner, closes, _ = rest.partition("}")
    named = [p.split()[-1] for p in inner.split(",") if p.strip()] if brace and closes else []
    head = before.strip().rstrip(",").strip() if brace and closes else text
    if head.startswith("*"):
        head = head.split(",")[0].split()[-1] if brace and closes else head.split()[-1]
    else:
        head = head.split(",")[0]
    return [n for n in map(_name, [*named, head]) if n]


def imports_in(text: str, language: str) -> list[tuple]:
    """(ord, names, source, line, relative) of each import."""
    found = []
    line = lambda m: text.count("\n", 0, m.start()) + 1
    if language in rules.JS:
        found = [(_ts_names(m[1]), m[2], line(m), m[2].startswith(".")) for m in _TS_IMPORT.finditer(text)]
    elif language == "Python":
        for m in _PY_FROM.finditer(text):
            if m[2].strip() != "*":
                parts = [p.strip() for p in re.sub(r"[()\\]", " ", m[2]).split(",")]
                names = [_name(p.partition(" as ")[2] or p) for p in parts if p]
                found.append(([n for n in names if n], m[1], line(m), m[1].startswith(".")))
        for m in _PY_IMPORT.finditer(text):
            for part in filter(None, map(str.strip, m[1].split(","))):
                if name := _name(part.partition(" as ")[2] or part.split(".")[0]):
                    found.append(([name], part, line(m), False))
    elif language == "Lua":
        found = [([], m[1].replace("/", "."), line(m), True) for m in _LUA_REQUIRE.finditer(text)]
    return [(n, *x) for n, x in enumerate(found)]


_IDENT = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$")


def occurs_again(text: str, name: str) -> bool:
    """Whether a name stands in a text twice at least, as a whole identifier."""
    seen, at = False, text.find(name)
    while at >= 0:
        end = at + len(name)
        whole = (not at or text[at - 1] not in _IDENT) and (end == len(text) or text[end] not in _IDENT)
        if whole and seen:
            return True
        seen |= whole
        at = text.find(name, end if whole else at + 1)
    return False


def unused_in(text: str, language: str) -> list[tuple]:
    """(ord, pos, name, source, line) of each imported name that occurs once at most."""
    return [(n, pos, name, source, line) for n, names, source, line, _ in imports_in(text, language) for pos, name in enumerate(names) if not occurs_again(text, name)]


_UNUSED = _fields(ord=INT, pos=INT, name=TEXT, source=TEXT, line=INT)
_IMPORT = _fields(ord=INT, names=T.ArrayType(TEXT), source=TEXT, line=INT, relative=T.BooleanType())


@F.arrow_udf(T.ArrayType(_IMPORT))
def imports_of(content: pa.Array, language: pa.Array) -> pa.Array:
    return each_file(imports_in, _IMPORT, content, language)


@F.arrow_udf(T.ArrayType(_UNUSED))
def unused_of(content: pa.Array, language: pa.Array) -> pa.Array:
    return each_file(unused_in, _UNUSED, content, language)


unused_of = unused_of.asNondeterministic()
imports_of = imports_of.asNondeterministic()  # or filters on what is found go below it, and each text is read twice
