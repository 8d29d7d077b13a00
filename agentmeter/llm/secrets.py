"""Secret scans by assignment-aware lexing.

A lexer reads source and configuration syntax: names, quoted and bare literals, the operators that assign (= : := =>) and
the + that joins literals. It yields name-literal pairs, resolves names on the right side to the constants they were
given earlier in the text, and scores each pair by how sensitive the target's name is and how random the literal looks.
Pairs over the threshold become spans of kind 'lexed'. Three fixed patterns ('assign', 'access', 'hex') are always
reported; the lexer adds spans and takes none away.

Scale: one pass over the texts, no shuffle, one text in memory at a time, in time that grows with its length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex", "lexed")

#: Parts of names that point at a secret, with their weights; parts are compared whole after splitting a name.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "authorization": 3, "secret": 3, "secrets": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3,
    "private": 2, "auth": 2, "bearer": 2, "access": 1, "key": 2, "api": 1, "signing": 1, "client": 1, "session": 1, "cookie": 1, "salt": 1, "encryption": 1,
}
#: Parts that say the name is about a secret without holding one.
HARMLESS = {"id", "name", "path", "file", "url", "uri", "type", "length", "len", "count", "size", "limit", "policy", "field", "public", "expiry", "ttl"}
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|change_?me|example.*|your[_-].*|dummy|test|todo|none|null|true|false|undefined|redacted|placeholder|password|secret|token)$")
_BEGINS = re.compile(r"(?i)example|your[_-]")
THRESHOLD = 4.0
LEXED_CHARS = 8

#: Characters at a value's start that can tell a placeholder; longer values are placeholders only by what repeats or by how they begin.
HEAD_CHARS = 64

_PART = r"[A-Za-z_$][A-Za-z0-9_$]*+"
#: Where an assignment can stand: a name, perhaps quoted, and an operator. A name starts where no name goes on, and what was read of it is
#: never given back, so each character is read once or twice whatever the text.
_TARGET = re.compile(
    rf"""(?<![A-Za-z0-9_$])(?<![A-Za-z0-9_$][.-])(?P<name>{_PART}(?:[.-]{_PART})*+)["']?+(?:\[["'](?P<item>[\w.-]++)["']\])?+[ \t]*+"""
    r"""(?::[ \t]*+[A-Za-z_][\w.]*+[ \t]*+(?==))?+(?::=|=>|=(?!=)|:(?!//|:))[ \t]*+(?:(?:[Bb]earer|[Bb]asic)[ \t]++(?=[A-Za-z0-9]))?+""",
    re.ASCII,
)
#: A value: a literal in three quotes or one, a reference, or a bare literal, which ends before & and is neither the target of another assignment nor called or indexed.
_PIECE = re.compile(
    r'''[rbfu]{0,2}(?:"""(?P<ddd>(?:[^"\\]|\\.|"(?!""))*+)"""|\'\'\'(?P<sss>(?:[^\'\\]|\\.|\'(?!\'\'))*+)\'\'\'|"(?P<d>(?:[^"\\\n]|\\.)*+)"|\'(?P<s>(?:[^\'\\\n]|\\.)*+)\')'''
    r"""|\$\{?+(?P<ref>[A-Za-z_][A-Za-z0-9_]*+)\}?+|(?P<bare>[A-Za-z0-9+/_.~!@%^*-]++(?:={1,2}(?![A-Za-z0-9"'=]))?+)(?![ \t]*+=(?!=)|:=|[\[(])""",
    re.ASCII | re.DOTALL,
)
_QUOTED = ("ddd", "sss", "d", "s")
_JOIN = re.compile(r"[ \t]*+\+[ \t]*+\n?+[ \t]*+|[ \t]++(?=[\"'])")
_PAIRED = re.compile(r"\s++value[ \t]*+=")
_SCHEME = re.compile(r"(?i:bearer|basic) ++(?=\S++\Z)")
_FOLD = re.compile(r"[ \t]*+\n\s*+")
_WORD = re.compile(r"[A-Z]++(?![a-z])|[A-Z]?[a-z]++|[0-9]++")


def name_score(name: str) -> float:
    """How much a target's name speaks for a secret."""
    parts = [p.lower() for p in _WORD.findall(name)]
    pairs = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    score = sum(SENSITIVE.get(p, 0) for p in set(parts) | pairs)
    return score if not parts or parts[-1] not in HARMLESS else score / 4


class Value:
    """What scoring needs of a literal, however long: its length, how often each character occurs (those beyond ASCII by the last byte of their code), and how it begins.

    Values that are joined are added up, so a constant of constants costs its characters' kinds and not its length.
    """

    __slots__ = ("counts", "head", "size")

    def __init__(self, text: str = ""):
        self.size, self.head = len(text), text[:HEAD_CHARS]
        self.counts: Counter[str] = Counter(text)
        if not text.isascii():
            for c in [c for c in self.counts if c > "\x7f"]:
                n = self.counts.pop(c)
                self.counts[chr(0x100 + ord(c) % 256)] += n

    def joined(self, other: Value) -> Value:
        if not self.size:
            return other
        out = Value()
        out.size, out.head, out.counts = self.size + other.size, (self.head + other.head)[:HEAD_CHARS], self.counts + other.counts
        return out

    def placeholder(self) -> bool:
        if self.size <= HEAD_CHARS:
            return bool(PLACEHOLDERS.match(self.head))
        return any(set(self.counts) <= set(x) for x in ("xX", "*", ".")) or bool(_BEGINS.match(self.head)) and "\n" not in self.counts


def literal_score(literal: str | Value) -> float:
    """How much a literal looks like a secret: bits of entropy a character, more for mixed classes and length."""
    value = Value(literal) if isinstance(literal, str) else literal
    n, counts = value.size, value.counts
    if n < LEXED_CHARS or " " in counts or value.placeholder():
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    lower, upper, digits = (any(a <= c <= b for c in counts) for a, b in ("az", "AZ", "09"))
    classes = lower + upper + digits + any(not (c.isascii() and c.isalnum()) for c in counts)
    if classes == 1 and not digits:
        return 0.0  # one word
    return min(entropy, 4.0) / 2 + (classes - 1) / 2 + (n >= 20) / 2


def _value(text: str, at: int, constants: dict[str, tuple[int, int, Value]]) -> tuple[int, int, Value, bool, int]:
    """The value that starts at a place: span (-1, -1 without one), what it says, whether a literal is in it, and where it ends."""
    value, start, end, direct = Value(), -1, -1, False
    while p := _PIECE.match(text, at):
        inside = next((q for q in _QUOTED if p[q] is not None), None)
        known = None if inside else constants.get(p["ref"] or p["bare"])
        if inside:
            span, said, direct = p.span(inside), p[inside], True
            if len(inside) == 3:  # lines of one literal
                said = _FOLD.sub("", said).strip()
            if scheme := _SCHEME.match(said):
                said, span = said[scheme.end() :], (span[0] + scheme.end(), span[1])
            piece = Value(said)
        elif known:
            span, piece = known[:2], known[2]
        else:
            span, piece = p.span("bare"), Value(p["bare"] or "")
        if span[0] >= 0:
            start, end = (span if start < 0 else (start, max(end, span[1])) if span[0] >= start else (start, end))
            value = value.joined(piece)
        at = p.end()
        j = _JOIN.match(text, at)
        if not j or (not inside and "+" not in j[0]) or not _PIECE.match(text, j.end()):
            break
        at = j.end()
    return start, end, value, direct, at


def lexed(text: str) -> list[tuple[int, int, float]]:
    """Spans of literals that reach a sensitive name, directly or by way of constants, with their scores.

    Constants have one scope, the text, and the latest assignment counts. What stands in comments is read like code: a secret there is one. A pair of
    attributes key (or name) and value, next to each other, is read as an assignment.
    """
    constants: dict[str, tuple[int, int, Value]] = {}
    out: dict[tuple[int, int], float] = {}
    at, keyed = 0, ""
    while m := _TARGET.search(text, at):
        start, end, value, direct, at = _value(text, m.end(), constants)
        if start < 0:
            continue
        name = m["item"] or m["name"]
        if keyed and name == "value":
            name = keyed
        keyed = value.head if m["name"] in ("key", "name") and value.size <= HEAD_CHARS and _PAIRED.match(text, at) else ""
        if keyed:
            continue
        if direct or value.size >= LEXED_CHARS:
            constants[m["name"]] = (start, end, value)
        score = name_score(name)
        if score >= 2 and (literal := literal_score(value)) and score + literal >= THRESHOLD:
            out.setdefault((start, end), score + literal)
    return [(a, b, s) for (a, b), s in out.items()]


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a whole text in code points, by start, then kind as listed."""
    text = text or ""
    spans: list[tuple[str, int, int]] = []
    operators = "=" in text or ":" in text
    if operators:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if operators:
        spans += [("lexed", a, b) for a, b, _ in lexed(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(x.as_py())] for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end), for each document.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no spans; null ids and repeated rows are
    scanned like any other row. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != "lexed")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """text with every span replaced; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    for _, a, b in scan(text):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]

