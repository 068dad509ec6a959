"""Secret scans: assignment-aware lexing of name-literal pairs with constant propagation, over fixed base patterns."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lattica.llm.store import annotate

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Runs are maximal, so asking for the least length in the pattern finds the same spans as filtering afterwards.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}", re.A)
HEX = re.compile(r"[0-9a-f]{32,}", re.A)
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A quoted literal to its own closing quote (tripled, with escapes, or where those do not close it, plain), whatever its length.
QUOTED = r"""[A-Za-z@$]{0,2}(?:(?P<triple>\"{3}|'{3})(?P<long>(?s:.+?))(?P=triple)|"(?P<double>[^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|'(?P<single>[^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'|"(?P<plain>[^"\n]*+)"|'(?P<plain1>[^'\n]*+)')"""
LITERALS = ("long", "double", "single", "plain", "plain1")
SEPARATOR = re.compile(r":=|=>|=(?!=)|:(?![:/])")
VALUE = re.compile(rf"""[ \t]*(?:{QUOTED}|(?P<bare>[^\s"',;(){{}}\[\]]+))""", re.A)
#: A type between a colon and the assignment: an identifier without digits, with brackets, references and alternatives.
TYPED = re.compile(
    r"""[ \t]*(?:[&*?\[\]]+[ \t]*)?(?:'[a-z_]+[ \t]+)?(?:mut[ \t]+)?[A-Za-z_][A-Za-z_.:]*+(?:[\[<(][^=\n"';{}]*[\]>)])?[?!*]*(?:[ \t]*\|[ \t]*[A-Za-z_][A-Za-z_.\[\]]*)*(?P<left>[ \t]*)=(?![=>~])(?=(?P<right>[ \t]*)(?P<quote>[A-Za-z@$]{0,2}["'])?)""",
    re.A,
)
JOINED = re.compile(rf"""[ \t]*\+[ \t]*(?:{QUOTED}|(?P<name>[A-Za-z_][A-Za-z0-9_.]*))""", re.A)
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*", re.A)
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
#: Types and keywords of declarations that put the type behind the name (``const passphrase string = ...``).
TYPES = {"string", "str", "byte", "bytes", "rune", "text", "char", "varchar", "any"}
DECLARES = {"const", "var", "let", "val", "final", "static"}
#: Weights of name parts, fixed values of this scorer.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 2.5, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "api": 1.0, "key": 1.5,
    "auth": 1.5, "credential": 2.5, "credentials": 2.5, "private": 1.5, "access": 1.0, "bearer": 2.0, "signing": 1.0, "encryption": 1.0, "salt": 1.0,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|null|none|true|false|changeme|example|your[-_ ].*|<.*>|\$\{.*\}|%\(.*)$", re.A)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.A)

FIELDS = T.StructType([T.StructField("spans", T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()),
])))])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three fixed patterns, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(x in low for x in HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def name_score(name: str) -> float:
    return sum(SENSITIVE.get(x.lower(), 0.0) for x in PARTS.findall(name))


def literal_score(name: str, value: str) -> float:
    """Sensitivity of the target name times how random the literal looks (0 for placeholders and values under 8 characters)."""
    if len(value) < 8 or " " in value or PLACEHOLDER.match(value):
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return name_score(name) * min(1.0, entropy(value) / 3.0) * (0.5 + 0.25 * kinds)


def word_before(text: str, end: int, low: int) -> int:
    """Start of the longest run of name characters that ends at ``end``."""
    while end > low and text[end - 1] in NAME_CHARS:
        end -= 1
    return end


def blanks_before(text: str, end: int, low: int, others: str = "") -> int:
    while end > low and (text[end - 1] in " \t" or text[end - 1] in others):
        end -= 1
    return end


def names_before(text: str, sep: int, low: int) -> list[str]:
    """The names that an assignment at ``sep`` may define, the likeliest first; ``low`` is the end of what is read already.

    Back from the separator: blanks, a mark of an optional name, array brackets, a quote, the name. Where the word is a
    type, or a declaration may have the type last, the word before it counts.
    """
    end = blanks_before(text, sep, low, "?!" if text[sep] == ":" else "")
    if text[sep] == "=" and end > low and text[end - 1] == "]":
        at = end - 1
        while at > low and text[at - 1].isdigit():
            at -= 1
        if at > low and text[at - 1] == "[":
            end = blanks_before(text, at - 1, low)
    quote = text[end - 1] if end > low and text[end - 1] in "\"'" else ""
    end -= len(quote)
    start = word_before(text, end, low)
    name = text[start:end]
    if not name or not (name[0].isalpha() or name[0] == "_"):
        return []
    if quote:
        opened = start > low and text[start - 1] == quote and not (start - 1 > low and text[start - 2] in NAME_CHARS)
        return [name] if opened else []
    stop = blanks_before(text, start, low, "[]*&")
    if text[sep] != "=" or stop == start or not any(c in " \t" for c in text[stop:start]):
        return [name]
    first = word_before(text, stop, low)
    before = text[first:stop]
    if not before or not (before[0].isalpha() or before[0] == "_"):
        return [name]
    if name.lower() in TYPES:
        return [before] if before.lower() not in DECLARES else [name]
    keyword_end = blanks_before(text, first, low)
    if text[word_before(text, keyword_end, low) : keyword_end].lower() in DECLARES and before.lower() not in DECLARES:
        return sorted((name, before), key=name_score, reverse=True)
    return [name]


def literal_of(m: re.Match) -> str | None:
    """The group of a quoted literal, if the match has one."""
    return next((g for g in LITERALS if m[g] is not None), None)


def assignments(text: str) -> list[tuple[str, str, int, int]]:
    """(name, value, start, end) of each name-literal pair. A name assigned from another known name takes that
    constant, with the span of the literal that defined it; ``+`` joins literals and known names.

    Literals end where they end. What a name carries into a further ``+`` is bounded, as it could double each time.
    """
    known: dict[str, tuple[str, int, int]] = {}
    out = []
    at = 0
    for sep in SEPARATOR.finditer(text):
        if sep.start() < at or not (names := names_before(text, sep.start(), at)):
            continue
        m = None
        if sep[0] == ":" and (typed := TYPED.match(text, sep.end())) is not None and (typed["quote"] or typed["left"] and typed["right"]):
            m = VALUE.match(text, typed.end())
        if m is None and (m := VALUE.match(text, sep.end())) is None:
            continue
        if (quoted := literal_of(m)) is not None:
            value, start, end = m[quoted], *m.span(quoted)
        else:
            value, start, end = m["bare"], *m.span("bare")
            if NAME.fullmatch(value) and value in known:
                value, start, end = known[value]
        at = m.end()
        single = True
        while (more := JOINED.match(text, at)) is not None:
            single, at = False, more.end()
            if (quoted := literal_of(more)) is not None:
                value += more[quoted]
                if start <= more.start(quoted):
                    end = more.end(quoted)
            else:
                value = (value + known.get(more["name"], ("", 0, 0))[0])[: max(4096, len(value))]
        for name in names:
            known[name] = (value if single else value[:4096], start, end)
        out.append((names[0], value, start, end))
    return out


def scan(text: str | None, threshold: float = 2.0) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) by start, then kind. Base spans score 1 or more and always stay; a literal
    span is added where its score reaches ``threshold`` and no base span covers it."""
    text = text or ""
    base = base_spans(text)
    found = {(k, s, e): 1.0 for k, s, e in base}
    starts = sorted((s, e) for _, s, e in base)
    furthest = list(accumulate((e for _, e in starts), max))
    if "=" in text or ":" in text:
        for name, value, start, end in assignments(text):
            score = literal_score(name, value)
            if score >= threshold and not ((i := bisect_right(starts, (start, math.inf))) and furthest[i - 1] >= end):
                found[("literal", start, end)] = max(score, found.get(("literal", start, end), 0.0))
    return sorted(((k, s, e, v) for (k, s, e), v in found.items()), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def scan_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), threshold: float = 2.0) -> DataFrame:
    """``keep`` columns plus ``spans``: array of (kind, start, end, score), code points, end exclusive.

    Null and empty texts give an empty array; repeated rows each give a row. Python per text, no shuffle.
    """
    return annotate(docs, lambda texts: [[[{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in scan(t, threshold)] for t in texts]], FIELDS, keep)


def redact(text: str | None, mark: str = "[REDACTED]", threshold: float = 2.0) -> str | None:
    """The text with every span replaced; overlapping spans merge. A text without spans is returned as it is."""
    if not text or not (spans := scan(text, threshold)):
        return text
    out, at, start, end = [], 0, spans[0][1], spans[0][2]
    for _, s, e, _ in [*spans[1:], ("", len(text) + 1, 0, 0.0)]:
        if s <= end:
            end = max(end, e)
        else:
            out += [text[at:start], mark]
            at, start, end = end, s, e
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, threshold: float = 2.0) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced and ``n_chars`` (if there) renewed for the rows that changed.

    All columns, their order and all rows stay; null texts stay null.
    """
    from pyspark.sql import functions as F

    from lattica.llm.store import fresh

    new = fresh("redacted", docs.columns)
    fields = T.StructType([T.StructField(new, T.StringType())])
    out = annotate(docs, lambda texts: [[redact(t, threshold=threshold) for t in texts]], fields, docs.columns)
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col(new).alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col(new) == F.col("text"), F.col(c)).otherwise(F.coalesce(F.length(new).cast(docs.schema[c].dataType), F.col(c))).alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols)


def contract(docs: DataFrame) -> DataFrame:
    """The digest columns of the secrets query, derived from :func:`scan`'s spans."""
    fields = T.StructType([T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")])

    def fn(texts):
        rows = []
        for t in texts:
            spans = scan(t)
            n = Counter(x[0] for x in spans)
            base = joined([x for x in spans if x[0] != "literal"])
            rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
        return list(zip(*rows, strict=True))

    return annotate(docs, fn, fields, ("doc_id",))
