"""Secret scans: base patterns, and an assignment-aware lexer that reads name-literal pairs and scores them by the name.

The lexer walks every ``=`` and ``:`` (also ``:=``, ``=>``) and every ``<name>text</name>``, reads the name before it and the
expression behind it (string literals, bare configuration values, names, joined by ``+`` or ``.``), and goes on behind that
expression, so a text is read once, whatever its length. A bare value ends at blanks, quotes, brackets, ``, ; & ?``. Names
assigned before are propagated, so ``KEY = "..."`` and a later ``password = KEY`` mark the literal of KEY; what a name
stands for is kept by reference, so chains of concatenations do not grow.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re

from pyspark.sql import DataFrame, functions as F, types as T

from siltstone.llm.common import map_texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of hex digits is one match, so shorter ones need no look
KINDS = ("assign", "access", "hex", "lexed")

#: Parts of names and how strongly they speak for a secret; a pair of parts counts if both are there in this order.
NAME_SCORES = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 0.9, "token": 0.8, "apikey": 0.9, "credential": 0.8, "credentials": 0.8, "bearer": 0.7, "auth": 0.6, "authorization": 0.6, "privatekey": 1.0, "accesskey": 0.9, "passcode": 0.8, "pin": 0.5, "salt": 0.5, "cookie": 0.5, "dsn": 0.5}
PAIR_SCORES = {("api", "key"): 0.9, ("access", "key"): 0.9, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("client", "key"): 0.8, ("session", "key"): 0.8, ("account", "key"): 0.8}
#: Literals that stand for no secret.
PLACEHOLDERS = frozenset("changeme password secret example placeholder redacted none null true false undefined default string".split())
#: Least product of name score and literal score, and least length of a literal.
LEAST_SCORE, LEAST_LENGTH = 0.5, 6

OPERATOR = re.compile(r"[=:]")
SUBWORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
STRING = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`\n]*)`')
PREFIX = re.compile(r"(?:[rRbBuUfF]{1,2})(?=[\"'])")
WORD = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]*")
BARE = re.compile(r"[^\s\"'`,;&?<>(){}\[\]]+")
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*)>([^<>\n]+)</\1>")
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-$")


def name_score(name: str) -> float:
    parts = [p.lower() for p in SUBWORD.findall(name)]
    best = max((NAME_SCORES.get(p, 0.0) for p in parts), default=0.0)
    best = max(best, max((PAIR_SCORES.get(p, 0.0) for p in zip(parts, parts[1:])), default=0.0))
    return best


def literal_score(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret: 0 for placeholders and references, less for plain words, least for bare ones."""
    low = value.lower()
    if len(value) < LEAST_LENGTH or low in PLACEHOLDERS or len(set(value)) < 3 or re.search(r"\$\{|\{\{|%\(", value) or -1 < value.find("<") < value.rfind(">") or low.startswith(("your", "http://", "https://", "/")):
        return 0.0
    if " " in value.strip():
        return 0.4 if quoted else 0.0
    if re.search(r"[0-9]", value) or re.search(r"[a-z][A-Z]|[^A-Za-z0-9]", value.rstrip(".,;:!?")):
        return 1.0
    return 0.7 if quoted else 0.0


def name_before(text: str, at: int) -> tuple[str, int]:
    """The name that ends before position ``at`` (quotes, brackets and blanks skipped), and where it starts."""
    i = at
    while i and text[i - 1] in " \t":
        i -= 1
    while i and text[i - 1] in "\"']":
        i -= 1
    j = i
    while j and text[j - 1] in NAME_CHARS:
        j -= 1
    return text[j:i], j


def expression(text: str, at: int):
    """The parts from ``at``: ``(value, start, end, quoted, is name)``, joined by ``+`` or ``.``; a bare value ends it; and where it ends."""
    parts, n = [], len(text)
    while True:
        while at < n and text[at] in " \t":
            at += 1
        if m := PREFIX.match(text, at):
            at = m.end()
        if m := STRING.match(text, at):
            g = next(k for k in (1, 2, 3) if m.group(k) is not None)
            parts.append((m.group(g), m.start(g), m.end(g), True, False))
        elif m := BARE.match(text, at):
            if text[m.end() : m.end() + 1] == "(":  # a call, not a literal
                return parts, m.end()
            value = m.group().rstrip(".,:!?")
            parts.append((value, m.start(), m.start() + len(value), False, WORD.fullmatch(value) is not None))
        else:
            return parts, at
        at = end = m.end()
        while at < n and text[at] in " \t":
            at += 1
        if at < n and text[at] in "+." and at + 1 < n:
            at += 1
        else:
            return parts, end


class Value:
    """What a name stands for: its own literals, and the values of the names it was put together from."""

    __slots__ = ("literals", "parts", "seen")

    def __init__(self):
        self.literals, self.parts, self.seen = [], [], 0.0


def assignments(text: str):
    """``(name, parts)`` of all assignments in a text, in order; each character is read once."""
    events = []
    for m in OPERATOR.finditer(text):
        i = m.start()
        if i and text[i - 1] in "=!<>:" or text[i] == "=" and text.startswith("=", i + 1) or text.startswith("://", i):
            continue
        after = i + 1
        if text[after : after + 1] in ("=", ">") and (text[i] == ":" or text[after] == ">"):
            after += 1
        events.append((i, after, None))
    if "</" in text:
        events += [(m.start(), m.start(2), m) for m in ELEMENT.finditer(text)]
        events.sort(key=lambda e: e[0])
    read = 0
    for i, after, m in events:
        if m is not None:
            yield m.group(1), [(m.group(2), m.start(2), m.end(2), True, False)]
        elif i >= read:
            name, _ = name_before(text, i)
            if name and WORD.match(name.lstrip("-.")):
                parts, read = expression(text, after)
                yield name.lstrip("-."), parts


def lexed(text: str) -> list[tuple[int, int, str, float]]:
    """``(start, end, name, score)`` of the literals that sensitive names get, by assignment or through other names.

    Of several names the one with the highest score counts, of equal ones the first.
    """
    found: dict[tuple[int, int], tuple[str, float]] = {}
    known: dict[str, Value] = {}
    for name, parts in assignments(text):
        made = Value()
        for value, a, b, quoted, is_name in parts:
            if is_name and not quoted and value in known:
                made.parts.append(known[value])
            else:
                made.literals.append((value, a, b, quoted))
        known[name] = made
        by_name = name_score(name)
        stack = [made]
        while stack:
            some = stack.pop()
            if some.seen >= by_name:  # a name that speaks as strongly has marked all of this
                continue
            some.seen = by_name
            for value, a, b, quoted in some.literals:
                score = by_name * literal_score(value, quoted)
                if score >= LEAST_SCORE and score > found.get((a, b), ("", 0.0))[1]:
                    found[a, b] = (name, score)
            stack += some.parts
    return sorted((a, b, name, score) for (a, b), (name, score) in found.items())


def scan(text: str | None) -> list[tuple[int, int, str, int, int, str, float]]:
    """All spans of a text, ``(start, end, kind, value start, value end, name, score)``, by start, then kind as listed.

    Base spans always stay; a lexed span is added where no base span covers it.
    """
    text = text or ""
    out = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(*m.span(), "assign", *m.span(2), m.group(1), 1.0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access", *m.span(), "", 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), "hex", *m.span(), "", 1.0) for m in HEX.finditer(text)]
    if "=" in text or ":" in text or "</" in text:
        base = sorted((s[0], s[1]) for s in out)
        starts, reach = [a for a, _ in base], list(itertools.accumulate((b for _, b in base), max))
        for a, b, name, score in lexed(text):
            before = bisect.bisect_right(starts, a)
            if not before or reach[before - 1] < b:
                out.append((a, b, "lexed", a, b, name, score))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with the value of every span replaced by ``mark``; overlapping values by one mark."""
    if text is None:
        return None
    merged: list[list[int]] = []
    for a, b in sorted((s[3], s[4]) for s in scan(text)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("value_start", T.LongType()), T.StructField("value_end", T.LongType()), T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())])


def find_secrets(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Add ``found``: an array of spans with kind, value span, target name and score, in code points, ends exclusive.

    Null and empty texts have no span. Whole texts of any length are read, in time in proportion to it; repeated rows have
    equal results; spans of one start come in the order of their kinds. An empty table gives an empty result. A kept column
    named ``found`` gives way.
    """

    def make():
        names = [f.name for f in SPAN.fields]
        return lambda texts: {"found": [[dict(zip(names, s)) for s in scan(t)] for t in texts]}

    return map_texts(docs, keep, text_col, make, T.StructType([T.StructField("found", T.ArrayType(SPAN))]))


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in the text; the length column follows. Rows are never dropped.

    Null texts stay null, empty ones empty; repeated rows get equal texts; an empty table gives an empty result. All other
    columns stay as they are, whatever their names.
    """
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")
    rows = docs.select(row, F.col(f"`{text_col}`").alias("text"))
    out = map_texts(rows, ["row"], "text", lambda: lambda texts: {"left": [redact(t) for t in texts]}, T.StructType([T.StructField("left", T.StringType())]))
    fresh = {text_col: F.col("left"), length_col: F.char_length("left")}
    return out.select(*[fresh[c].cast(docs.schema[c].dataType).alias(c) if c in fresh else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs.select("doc_id", "text"), ["doc_id"])
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != "lexed")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text_of(base).cast("binary"), 256).alias("base_sha256"), text_of(F.col("found")).alias("spans"), count("lexed"))
