"""Tokens found by one automaton against a search for each, and the marks of secrets against their rules."""

import random
import re

from lodestrata import rules
from lodestrata.functions import text as t
from lodestrata.functions import tokens


def by_itself(text, token):
    before = f"(?<!{t.IDENT})" if re.match(t.IDENT, token) else ""
    after = f"(?!{t.IDENT})" if re.search(f"{t.IDENT}$", token) else ""
    m = re.search(before + re.escape(token) + after, text)
    return m and m.start()


def test_first_places_equal_a_search_for_each():
    r = random.Random(6)
    names = [token for *_, token in tokens.ROLES]
    roles, runtimes = tokens._finders()
    for _ in range(200):
        text = "".join(r.choice([r.choice(names), " ", "\n", "x", "$", "(", ".", "new "]) for _ in range(40))
        assert roles.first(text) == {n: at for n, token in enumerate(names) if (at := by_itself(text, token)) is not None}
        for group, own in tokens.RUNTIMES.items():
            at = [text.find(x) for x in own if x in text] if group in tokens.INSIDE else [x for x in (by_itself(text, x) for x in own) if x is not None]
            assert runtimes.first(text).get(group) == (min(at) if at else None)


def test_tokens_of_odd_texts():
    assert tokens.tokens_in("", "TypeScript") == ("", [], [])
    assert tokens.tokens_in("fetch(", "Rust") == ("fetch(", [], [])
    code, found, runtimes = tokens.tokens_in("// ws.on(\n\tfetch(" + "x" * 200 + ") 'ws.on('", "TypeScript")
    assert [(tokens.ROLES[n][0], line, len(shown)) for n, line, shown in found] == [("data_fetching", 2, 101)] and runtimes == [] and "ws.on(" in code


def test_every_secret_holds_a_mark():
    """A line that a rule matches is never left out beforehand: lines made from the rules, and cut by a sign."""
    samples = [
        "-----BEGIN PRIVATE KEY-----", "-----BEGIN PGP PRIVATE KEY-----", "ghp_" + "a" * 36, "gho_" + "a" * 36, "ghs_" + "a" * 36, "ghu_" + "a" * 36, "ghr_" + "a" * 36, "github_pat_" + "a" * 60, "sk_live_" + "a" * 16,
        "rk_live_" + "a" * 16, "AKIA" + "A" * 16, "ASIA" + "A" * 16, "AIza" + "a" * 35, "xoxb-" + "a" * 10, "sk-ant-" + "a" * 24, "npm_" + "a" * 36, "SG." + "a" * 16 + "." + "a" * 16, "12345678:AA" + "a" * 33, "sk-" + "a" * 38,
        "whsec_" + "a" * 24, "https://hooks.slack.com/services/Ta", "SK" + "a" * 32, "eyJ" + "a" * 8 + ".eyJ" + "a" * 8 + "." + "a" * 8, " rcon_password x", "sv_licenseKey x", "steam_webApiKey x",
        *(f'{w}{s}"12345678"' for w in ("api_key", "APIKEY", "secret", "Token", "password", "passwd", "pwd", "access-key", "privateKey", "client_secret") for s in ("=", ": ")),
    ]
    patterns = [p for *_, p in [*rules.SECRETS, *rules.CONFIG_SECRETS]] + [rules.ASSIGNED_SECRET]
    assert all(any(re.search(p, s) for s in samples) for p in patterns)
    cut = [s[:i] + s[i + 1 :] for s in samples for i in range(len(s))]
    for s in samples + cut:
        assert re.search(rules.SECRET_MARKS, s) or not any(re.search(p, s) for p in patterns), s
