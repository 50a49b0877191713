"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

IDENT = "[A-Za-z0-9_$]"
NOT_BEFORE, NOT_AFTER = f"(?<!{IDENT})", f"(?!{IDENT})"


# The code points of Unicode white space.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(WHITE))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_of(content: Column) -> Column:
    """Lines without their ends; a line end at the very end opens no further line; none for null or empty text."""
    lines = F.split(F.regexp_replace(content, r"\n\z", ""), "\n", -1)
    bare = F.transform(lines, lambda x: F.when(F.endswith(x, F.lit("\r")), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x))
    return F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(bare)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name up to its last dot."""
    return F.regexp_replace(base_name(path), r"(?s)\.[^.]*\z", "")


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit("."))


def first_name(path: Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(base_name(path), ".", 1)


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 20))


def alphanumerics(c: Column) -> Column:
    """Number of letters and digits of any script."""
    return F.length(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}]", ""))


def quoted(token: str) -> str:
    """A pattern of the token; an end that is part of an identifier must not go on as one."""
    import re

    before = NOT_BEFORE if re.match(IDENT, token) else ""
    after = NOT_AFTER if re.search(f"{IDENT}$", token) else ""
    return f"{before}\\Q{token}\\E{after}"


def token_at(content: Column, token: str) -> Column:
    """1-based place of the first occurrence of a token by itself, or 0."""
    return F.when(F.contains(content, F.lit(token)), F.regexp_instr(content, F.lit(quoted(token)))).otherwise(F.lit(0))


def identifier_count(content: Column, name: Column) -> Column:
    """Occurrences of a name as a whole identifier."""
    return F.regexp_count(content, F.concat(F.lit(NOT_BEFORE + "\\Q"), name, F.lit("\\E" + NOT_AFTER)))


def line_of(content: Column, place: Column) -> Column:
    """1-based line of a 1-based place."""
    return F.regexp_count(F.substr(content, F.lit(1), place - 1), F.lit("\n")) + 1


def snippet(line: Column) -> Column:
    """A trimmed line of at most 100 characters."""
    line = trimmed(line)
    return F.when(F.length(line) > 100, F.concat(F.substring(line, 1, 100), F.lit("…"))).otherwise(line)


def any_of(content: Column, tokens: list[str], found=None) -> Column:
    """Whether one of the tokens is contained."""
    out = F.lit(False)
    for t in tokens:
        out = out | (found(content, t) > 0 if found else F.contains(content, F.lit(t)))
    return out


def comment_tokens(language: Column) -> Column:
    """(line, opens, closes) of a language; nulls where it has none."""
    out = F.lit(None).cast("struct<line:string,opens:string,closes:string>")
    for languages, line, opens, closes in rules.COMMENTS:
        row = F.struct(F.lit(line).cast("string").alias("line"), F.lit(opens).cast("string").alias("opens"), F.lit(closes).cast("string").alias("closes"))
        out = F.when(language.isin(*languages.split()), row).otherwise(out)
    return out


def starts_comment(line: Column, tokens: Column) -> Column:
    """Whether a trimmed line starts with a comment token."""
    return F.coalesce(F.startswith(line, tokens["line"]), F.lit(False)) | F.coalesce(F.startswith(line, tokens["opens"]), F.lit(False))


def line_counts(lines: Column, tokens: Column) -> Column:
    """(total, blank, comment) of lines, read in order: a block comment lasts until a line with its closing token.

    A blank line inside a block is blank. The line token is tried before the block's.
    """

    def step(state: Column, line: Column) -> Column:
        blank = line == ""
        inside = state["inside"]
        by_line = F.coalesce(F.startswith(line, tokens["line"]), F.lit(False))
        opens = ~by_line & F.coalesce(F.startswith(line, tokens["opens"]), F.lit(False))
        rest = F.substr(line, F.length(tokens["opens"]) + 1)
        stays = F.when(inside, ~F.coalesce(F.contains(line, tokens["closes"]), F.lit(False))).otherwise(opens & ~F.contains(rest, tokens["closes"]))
        return F.struct(
            (state["total"] + 1).alias("total"),
            (state["blank"] + blank.cast("long")).alias("blank"),
            (state["comment"] + (~blank & (inside | by_line | opens)).cast("long")).alias("comment"),
            F.when(blank, inside).otherwise(F.coalesce(stays, F.lit(False))).alias("inside"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("blank"), zero.alias("comment"), F.lit(False).alias("inside"))
    return F.aggregate(F.transform(lines, trimmed), start, step)


def entropy(c: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars).cast("double")
    share = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def js_round(c: Column) -> Column:
    """Halves go up."""
    return F.floor(c + 0.5)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c.cast("double")))


# Formats of the report


def number(c: Column) -> Column:
    return F.format_number(c.cast("long"), 0)


def bytes_text(c: Column) -> Column:
    """One decimal below a hundred of a unit, none from there on."""

    def unit(n: int, name: str) -> Column:
        v = c / F.lit(float(n))
        return F.concat(F.when(v >= 100, F.format_string("%.0f", v)).otherwise(F.format_string("%.1f", v)), F.lit(f" {name}"))

    return (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1 << 20, unit(1 << 10, "KB"))
        .when(c < 1 << 30, unit(1 << 20, "MB"))
        .otherwise(unit(1 << 30, "GB"))
    )


def date_text(at: Column) -> Column:
    """Unix seconds as a date and time in American English, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(at), "MMM dd, yyyy, hh:mm a")


def time_ago(seconds: Column, at: Column | None = None) -> Column:
    """How long ago; with ``at`` (unix seconds) what is a week old or older is a date."""

    def text(n: int, sign: str) -> Column:
        return F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{sign} ago"))

    out = F.when(seconds < 60, F.lit("just now")).when(seconds < 3600, text(60, "m")).when(seconds < 86400, text(3600, "h"))
    return out.otherwise(text(86400, "d")) if at is None else out.when(seconds < 604800, text(86400, "d")).otherwise(date_text(at))


def case_number(prefix: str, created_at: Column, id_: Column) -> Column:
    """PREFIX-<year>-<id of four digits at least>, from unix seconds."""
    return F.format_string(f"{prefix}-%s-%04d", F.date_format(F.timestamp_seconds(created_at), "yyyy"), id_)


def printable(key: Column) -> Column:
    """Only visible ASCII characters."""
    return F.regexp_replace(key, r"[^\x21-\x7E]", "")


def file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_")
