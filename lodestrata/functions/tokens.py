"""Many tokens looked for at once: an automaton over a file's views gives the first place of each in one pass."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from . import text as t
from .views import INT, TEXT, _fields, view

# (kind, evidence, label, token) in order; the lowest role of a kind that is found counts.
ROLES = [(kind, evidence, label, token) for kind, tiers in rules.RESPONSIBILITIES for evidence, label, tokens in tiers for token in tokens]
# Groups of tokens that tell where a file runs; those of scripts also count inside identifiers.
RUNTIMES = {"node": rules.NODE_TOKENS, "react": rules.REACT_TOKENS, "lua_server": rules.LUA_SERVER_TOKENS, "lua_client": rules.LUA_CLIENT_TOKENS}
INSIDE = ("node", "react")
_IDENT = re.compile(t.IDENT)


class Finder:
    """First places of tokens that stand by themselves: an end that is part of an identifier must not go on as one."""

    def __init__(self, tokens: list[tuple[object, str]], inside: tuple = ()):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        names: dict[str, list] = {}
        for name, token in tokens:
            names.setdefault(token, []).append((name, name in inside))
        for token, own in names.items():
            self.automaton.add_word(token, (len(token), bool(_IDENT.match(token[0])), bool(_IDENT.match(token[-1])), own))
        self.automaton.make_automaton()

    def first(self, text: str) -> dict:
        """Name -> 0-based place of its first token."""
        found: dict = {}
        for last, (length, opens, closes, own) in self.automaton.iter(text):
            at = last - length + 1
            goes_on = opens and at and _IDENT.match(text[at - 1]) or closes and last + 1 < len(text) and _IDENT.match(text[last + 1])
            for name, inside in own:
                if (inside or not goes_on) and at < found.get(name, len(text)):
                    found[name] = at
        return found


@lru_cache(1)
def _finders() -> tuple[Finder, Finder]:
    """Of roles and of runtimes, made once for each worker."""
    groups = [(name, token) for name, tokens in RUNTIMES.items() for token in tokens]
    return Finder([(n, token) for n, (*_, token) in enumerate(ROLES)]), Finder(groups, INSIDE)


def snippet(line: str) -> str:
    """A trimmed line of at most 100 characters."""
    line = line.strip(t.WHITE)
    return line if len(line) <= 100 else f"{line[:100]}…"


def tokens_in(text: str, language: str) -> tuple[str, list[tuple], list[str]]:
    """(code, roles, runtimes): the text without comments, (role, line, snippet) of each role in it, and the groups of runtime tokens."""
    if language not in rules.JS and language != "Lua":
        return text, [], []
    code = view(text, language, False)
    evidence = code if language == "Lua" else view(text, language, True)
    roles, runtimes = _finders()
    found = []
    for role, at in sorted(roles.first(evidence).items()):
        start, end = evidence.rfind("\n", 0, at) + 1, evidence.find("\n", at)
        found.append((role, evidence.count("\n", 0, at) + 1, snippet(evidence[start : len(evidence) if end < 0 else end])))
    return code, found, sorted(runtimes.first(code))


@F.pandas_udf(_fields(code=TEXT, roles=T.ArrayType(_fields(role=INT, line=INT, snippet=TEXT)), runtimes=T.ArrayType(TEXT)))
def tokens_of(content: pd.Series, language: pd.Series) -> pd.DataFrame:
    rows = [tokens_in(text, name) for text, name in zip(content.fillna(""), language.fillna(""), strict=True)]
    return pd.DataFrame(rows, columns=["code", "roles", "runtimes"])
