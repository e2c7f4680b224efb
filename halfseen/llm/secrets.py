"""Secret scans: base patterns, and weak parts that are linked to complementary parts in the same scope."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halfseen.llm.common import query, small_batches, table
from halfseen.llm.shingles import texts

#: Base kinds in their order; patterns on bytes fold ASCII letters only.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Weak parts: nothing by themselves. An identifier or a password (of any length from 4, so also what the base rule drops) by its name, a key by its shape, an endpoint by its scheme.
IDENT = re.compile(rb"""\b(user(?:name|_id)?|login|account|client_id|key_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I)
SHORT = re.compile(rb"""(?:\b(?:pwd|pass|passphrase|auth)["']?\x20*[:=]\x20*["']?[^\s"']{4,}|(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[^\s"'&,;]{4,})""", re.I)
KEY = re.compile(rb"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(rb"""(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}""", re.I)
IDENT_WORDS = (b"user", b"login", b"account", b"client_id", b"key_id")
SHORT_WORDS = (b"pwd", b"pass", b"auth", *KEYWORDS)
ENDPOINT_WORDS = (b"://", b"host", b"endpoint", b"server")

ORDER = {"assign": 0, "access": 1, "hex": 2, "ident": 3, "secret": 4, "endpoint": 5}
SCOPE = re.compile(rb"\n[\x20\t\r]*\n")        # scopes are parted by blank lines

HEX_MASK = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
KEY_MASK = bytes(120 if chr(c).isalnum() and c < 128 or chr(c) in "+/" else 32 for c in range(256))
Span = tuple[int, int, str]


def spans(pattern: re.Pattern, text: bytes, kind: str) -> list[Span]:
    return [(m.start(), m.end(), kind) for m in pattern.finditer(text)]


def base_spans(text: bytes, low: bytes) -> list[Span]:
    """Leftmost matches that do not overlap, per kind; what is too short is dropped after matching."""
    found: list[Span] = []
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in text:
        found += [s for s in spans(ACCESS, text, "access") if s[1] - s[0] >= 16]
    if b"x" * 32 in text.translate(HEX_MASK):
        found += spans(HEX, text, "hex")
    return found


def weak_spans(text: bytes, low: bytes, base: list[Span]) -> list[Span]:
    """Candidates for parts of a credential, none of them worth a report alone."""
    found: list[Span] = []
    if any(w in low for w in IDENT_WORDS):
        found += spans(IDENT, text, "ident")
    if any(w in low for w in SHORT_WORDS):
        found += spans(SHORT, text, "secret")
    if b"x" * 40 in text.translate(KEY_MASK):
        for a, b, kind in spans(KEY, text, "secret"):
            word = text[a:b]
            if re.search(rb"[a-z]", word) and re.search(rb"[A-Z]", word) and re.search(rb"[0-9]", word):
                found.append((a, b, kind))
    if (found or base) and any(w in low for w in ENDPOINT_WORDS):
        found += spans(ENDPOINT, text, "endpoint")
    return found


def linked(text: bytes, base: list[Span], weak: list[Span]) -> list[Span]:
    """Weak spans whose scope holds what they lack.

    Parts are joined to scopes as intervals: a part belongs to the scope it starts in. An
    identifier needs a secret there, a secret an identifier or endpoint, an endpoint both.
    Access identifiers count as identifiers, assignments and long hex as secrets; a weak
    span that overlaps a base span is that span and adds nothing.
    """
    cuts = np.array([m.start() for m in SCOPE.finditer(text)], np.int64)
    covered = sorted((a, b) for a, b, _ in base)
    starts = np.array([a for a, _ in covered], np.int64)
    reach = np.maximum.accumulate(np.array([b for _, b in covered], np.int64)) if covered else np.empty(0, np.int64)
    own = []
    for a, b, kind in weak:
        k = int(np.searchsorted(starts, b)) - 1         # base spans that start before this one ends
        if k < 0 or reach[k] <= a:
            own.append((a, b, kind))
    role = {"access": "ident", "assign": "secret", "hex": "secret"}
    held: dict[int, set[str]] = {}
    for a, _, kind in base + own:
        held.setdefault(int(np.searchsorted(cuts, a, "right")), set()).add(role.get(kind, kind))

    def complete(a: int, kind: str) -> bool:
        parts = held[int(np.searchsorted(cuts, a, "right"))]
        if kind == "ident":
            return "secret" in parts
        if kind == "secret":
            return "ident" in parts or "endpoint" in parts
        return "ident" in parts and "secret" in parts

    return [s for s in own if complete(s[0], s[2])]


def written(found: list[Span], at) -> str:
    return ",".join(f"{kind}:{at[a]}:{at[b]}" for a, b, kind in sorted(found, key=lambda s: (s[0], ORDER[s[2]], s[1])))


def code_points(text: bytes, offsets: set[int]) -> dict[int, int]:
    """Byte offset -> code point offset, in one pass over the text."""
    if text.isascii():
        return {o: o for o in offsets}
    starts = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return {o: int(starts[o]) for o in offsets}


def scan(text: bytes) -> tuple[int, int, int, str, str]:
    low = text.lower()
    base = base_spans(text, low)
    weak = weak_spans(text, low, base)
    extra = linked(text, base, weak) if weak else []
    at = code_points(text, {o for s in base + extra for o in s[:2]}) if base or extra else {}
    kinds = [kind for _, _, kind in base]
    return (*(kinds.count(k) for k in ("assign", "access", "hex")), hashlib.sha256(written(base, at).encode()).hexdigest(),
            written(base + extra, at))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points).

    All parts of a document are in its own row, so their interval join with the scopes is
    done where the row is, without a shuffle, by binary search in sorted offsets; work is
    linear in the text but for that search. Empty and null texts have no span (the hash is
    that of the empty string). Rows without id and repeated rows are scanned like others.
    Other columns are not read; an empty table gives no rows.
    """
    names = ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(zip(*[scan(t) for t in texts(batch, "body")])) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id")] + [pa.array(c, k) for c, k in zip(out, kinds[1:])], names)

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    found = rows.mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.withColumnRenamed("id", id_col)


@query("op9_secret_scan")
def op9_secret_scan(spark, d):
    return secret_scan(table(spark, d, "documents"))
