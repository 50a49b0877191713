"""Texts for keys, with values put in; a key that a language lacks is worded in English, one that English lacks stays as it is."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ENGLISH = {
    "ftitle.god_server": "Server that does too much", "ftitle.service_module": "Service of several duties", "ftitle.route_handler": "Handler of many routes",
    "ftitle.god_hook": "Hook that does too much", "ftitle.big_hook": "Hook of many lines", "ftitle.root_coordinator": "Root component that coordinates too much",
    "ftitle.feature_component": "Large feature component", "ftitle.dialog": "Large dialog", "ftitle.icon_file": "File of icons", "ftitle.long_component": "Component of many lines",
    "ftitle.long_function": "Function of very many lines", "ftitle.huge_file": "File of many lines", "ftitle.security": "Secret in the source", "ftitle.duplication": "Duplicated lines",
    "ftitle.unused": "Unused imports", "ftitle.noise": "Generated file or lock file",
    "why.node_server": "Transport, routes and rules change together in one file.", "why.service_module": "Several duties share one module.", "why.route_handler": "Many routes share one file.",
    "why.react_hook_direct": "One hook holds connections and state.", "why.react_hook_indirect": "The hook is larger than one duty needs.", "why.react_root": "The root knows too many features.",
    "why.react_feature": "View, data and state are in one component.", "why.react_dialog": "Form, checks and view are in one dialog.", "why.icon": "Drawings are data and need no component each.",
    "why.long_component": "The component is hard to read as a whole.", "why.long_function": "The function is hard to test in parts.", "why.huge_file": "The file is larger than most readers can follow.",
    "why.security": "Whoever reads the source can use it.", "why.duplication": "A change must be made in each copy.", "why.unused": "They mislead readers and tools.",
    "next.split": "Split it along its duties.", "next.extractFn": "Extract functions from it.", "next.icon": "Move the drawings into data.", "next.rotate": "Revoke it and read it from the environment.",
    "next.dedupe": "Move the lines into one shared place.", "next.lint": "Remove them, and let a linter keep them out.", "find.none": "Nothing to do", "find.noiseNote": "Left out of sizes and duplication.",
    "qw.heuristic": "Some findings rest on hints and not on direct evidence.", "qw.template": "Paths of new modules are proposals.", "qw.needsVerify": "Some findings contradict themselves and need a look.",
    "vrf.runtime": "It does not run on a server.", "vrf.iconType": "The file is no icon file by type.", "vrf.token": "The evidence lies outside the file.", "vrf.line": "The symbol lies outside the file.",
    "vrf.clientServer": "A server's module is proposed for a client.", "vrf.iconHook": "A hook is proposed for icons.", "brief.fpWhy": "It rests on hints.",
    "log.unavailable": "No history: {reason}", "log.count": "{commits} commits by {authors} authors", "cycles.none": "None.", "cycles.count": "{n} in all", "complex.none": "No function stands out.",
    "pr.verify": "Check it with {commands}",
    "ev.direct": "seen at work", "ev.indirect": "used through others", "ev.supporting": "named only",
    "ev.lines": "{lines} lines", "ev.startsAt": "{name} begins on line {n}", "ev.longest": "{name}(){place} takes {len} lines", "ev.found": "{resp}, {how} ({token}){place}{snippet}",
    "ev.copies": "{n} copies of {lines} lines", "ev.files": "In {files}", "ev.unused": "{n} names imported and not used", "ev.secret": "{kind}: {snippet}", "ev.reason": "Left out as {reason}",
    "resp.ws_server": "serves web sockets", "resp.ws_client": "opens web sockets", "resp.ws_handler": "answers web sockets", "resp.ws_consumer": "leans on a web socket", "resp.ws_type": "knows web socket types",
    "resp.webrtc_conn": "sets up peer connections", "resp.webrtc_media": "shows peers' media", "resp.webrtc_type": "knows peer connection types", "resp.http_listen": "listens for requests", "resp.http_type": "knows the HTTP module",
    "resp.routes": "declares routes", "resp.validation": "checks input", "resp.validation_type": "knows a checking library", "resp.timer_heartbeat": "keeps a heartbeat", "resp.timer_retry": "tries again after failures",
    "resp.timer_countdown": "counts down", "resp.timer_ui": "times what is shown", "resp.timer_lifecycle": "sets timers", "resp.chat": "sends messages", "resp.chat_consumer": "shows messages", "resp.chat_type": "knows message types",
    "resp.data_fetching": "fetches data", "resp.data_type": "knows a fetching library", "resp.state_machine": "runs a state machine", "resp.state_dispatch": "dispatches to a state", "resp.database": "talks to a database",
    "resp.admin": "guards what administrators may do", "resp.admin_consumer": "shows what administrators see", "resp.firebase_admin": "starts an administration client", "resp.firebase_type": "knows an administration client",
    "resp.token_verify": "verifies tokens", "resp.claims": "manages users' claims", "resp.event_register": "registers events", "resp.event_trigger": "triggers events", "resp.nui": "talks to the page", "resp.thread": "starts threads",
    "resp.command": "registers commands", "resp.db": "queries a game database", "resp.framework": "builds on a game framework",
    "rstep.accessDenied": "what is shown without access", "rstep.actions": "its buttons", "rstep.adminClaims": "granting and taking claims", "rstep.adminRoutes": "routes for administrators", "rstep.card": "one entry",
    "rstep.chat": "the message channel", "rstep.config": "settings and environment", "rstep.dataStore": "what is stored", "rstep.errorMap": "errors and their texts", "rstep.feature": "the component itself", "rstep.featureApi": "its calls",
    "rstep.featureData": "its data", "rstep.fields": "its fields", "rstep.firebaseAdmin": "starting the client", "rstep.form": "the state of the form", "rstep.gates": "who may enter", "rstep.healthRoutes": "routes that tell health",
    "rstep.hooks": "its state and data", "rstep.iconMap": "a table of icons", "rstep.iconSplit": "an icon a file", "rstep.legal": "pages that never change", "rstep.list": "the list of entries", "rstep.lucide": "icons of a library",
    "rstep.machine": "the states and their changes", "rstep.mainscreen": "the main view", "rstep.moderation": "dealing with peers", "rstep.peer": "setting up the peer connection", "rstep.presence": "who is there",
    "rstep.preview": "the preview", "rstep.requeue": "timers and new attempts", "rstep.roomTypes": "types that are shared", "rstep.routes": "the routes", "rstep.screen": "the view", "rstep.signalHandlers": "answers to signals",
    "rstep.signaling": "the signalling socket", "rstep.stateLogic": "rules and state", "rstep.tokenVerify": "verifying tokens", "rstep.unread": "what is unread", "rstep.validation": "checks of input", "rstep.wsServer": "the life of the socket server",
    "pr.admin": "Take the routes for administrators out", "pr.chat": "Take the message channel out", "pr.claims": "Take the claims out", "pr.config": "Take settings and environment out", "pr.featureData": "Take data and its hooks out",
    "pr.fields": "Take fields and buttons out", "pr.firebase": "Take the start of the client out", "pr.form": "Take the state of the form out", "pr.gates": "Take the gates out", "pr.iconMap": "Bring in a table of icons",
    "pr.iconSplit": "Give each icon a file", "pr.machine": "Take the states out", "pr.mainscreen": "Take the main view out", "pr.moderation": "Take dealing with peers out", "pr.peer": "Take the peer connection out",
    "pr.routes": "Take the routes out", "pr.split": "Split into the modules above", "pr.store": "Take the store out", "pr.subviews": "Take lists and entries out", "pr.tests": "Test the outside of it", "pr.token": "Take the tokens out",
    "pr.types": "Take types and plain helpers out, changing nothing", "pr.validation": "Take the checks out", "pr.wsServer": "Take the socket server out", "pr.wsSignaling": "Take the signalling out, keeping what others call",
    "blurb.A": "Little to do here.", "blurb.B": "A few things to tidy.", "blurb.C": "Several files deserve a close look.", "blurb.D": "Debt and copies show in many places.", "blurb.F": "Plan for a long repair.",
}

Say = Callable[..., str]


def interpolated(text: str, values: Mapping[str, object]) -> str:
    """The text with ``{name}`` replaced where a value of that name is given."""
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]) if m[1] in values else m[0], text)


def message(key: str | Column, **values: Column) -> Column:
    """A text that is yet to be worded: its key and what goes into it. A value may be a key itself."""
    pairs = [x for name, value in values.items() for x in (F.lit(name), value.cast("string"))]
    filled = F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(""))
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), filled.alias("values"))


def worded(messages: Column, *dictionaries: Mapping[str, str]) -> Column:
    """An array of messages as texts, by the first of the dictionaries that has a key, English last; without a shuffle.

    A key that none has stays, as does ``{name}`` without a value. A dictionary is a
    constant of the program, so it goes along as a literal.
    """
    texts = {k: v for d in (ENGLISH, *reversed(dictionaries)) for k, v in d.items()}
    table = F.create_map(*(F.lit(x) for pair in texts.items() for x in pair))
    put = lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(table[e["value"]], e["value"], F.lit("")))
    return F.transform(messages, lambda m: F.aggregate(F.map_entries(m["values"]), F.coalesce(table[m["key"]], m["key"]), put))


def speaker(*dictionaries: Mapping[str, str]) -> Say:
    """say(key, **values) by the first of the dictionaries that has the key, English last.

    Of keys such as ``pr.verify: command`` or ``brief.fpWhy:kind`` the part before the colon is worded. A value that is a key is worded too.
    """
    texts = {k: v for d in (ENGLISH, *reversed(dictionaries)) for k, v in d.items()}

    def say(key: str, **values: object) -> str:
        head, colon, rest = key.partition(":")
        if key not in texts and colon and head in texts:
            key, values = head, {"commands": rest.strip()} | values
        return interpolated(texts.get(key, key), {name: "" if value is None else texts.get(str(value), value) for name, value in values.items()})

    return say
