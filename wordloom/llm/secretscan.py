"""Secret scan with multipart credential linking.

Strong findings stand by themselves: assignments of a password or key, access
identifiers and long hexadecimal runs.  A credential is often in several parts
that prove nothing alone: an access identifier, a secret value and the
endpoint it is for.  Weak candidates of these three kinds are found too, and
one is reported only if it is linked: an interval join over the document's
parts pairs parts of complementary kinds within one scope (the same
block of lines without an empty line between, at most ``reach`` characters from
end to start).  Strong findings take part in the join as identifiers
(``access``) and secrets (``assign``, ``hex``).  The join is a sweep over parts
sorted by place, once forward and once backward, that keeps the nearest part of each kind, so it is linear in
the parts; each candidate needs only its nearest partner on each side.

Spans are in code points, end exclusive.  A weak span that overlaps a strong
one is not reported again.

Defined cases.  Null and empty texts have no spans.  Equal starts are ordered by kind as listed in ``KINDS``.
Repeated rows are scanned one by one.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import common as cm

REACH = 200
# Kinds in their order; the first three are the base, the others weak.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Weak parts: account names and client ids, opaque values of 20 or more characters with a digit and both cases, host addresses.
IDENTIFIER = re.compile(r"""(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})""", re.ASCII | re.IGNORECASE)
IDENTIFIER_CUES = ("user", "login", "account", "client", "access")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+]*://[^\s"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+)""", re.ASCII | re.IGNORECASE)
ROLE = {"assign": "secret", "hex": "secret", "access": "identifier", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Strong findings: leftmost, not overlapping within a kind."""
    found, lower = [], None
    if "=" in text or ":" in text:
        lower = text.lower()
        if any(c in lower for c in CUES):
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def weak_spans(text: str) -> list[Span]:
    found = []
    if "=" in text or ":" in text:
        lower = text.lower()
        if any(c in lower for c in IDENTIFIER_CUES):
            found += [(m.start(1), m.end(1), "identifier") for m in IDENTIFIER.finditer(text)]
        if "://" in text or any(c in lower for c in ("host", "endpoint", "server")):
            found += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    opaque = (m for m in OPAQUE.finditer(text) if any(c.isdigit() for c in m[0]) and not (m[0].islower() or m[0].isupper()))
    return found + [(m.start(), m.end(), "secret") for m in opaque]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def linked(text: str, base: list[Span], weak: list[Span], reach: int = REACH) -> list[Span]:
    """Weak spans that overlap no strong one and have a part of another role within their scope."""
    strong = sorted((a, b) for a, b, _ in base)
    starts = [a for a, _ in strong]
    ends = np.maximum.accumulate([b for _, b in strong]).tolist() if strong else []

    def free(span: Span) -> bool:
        i = bisect_left(starts, span[1])  # strong spans that begin before this one ends
        return i == 0 or ends[i - 1] <= span[0]

    weak = [s for s in weak if free(s)]
    if not weak or len(base) + len(weak) < 2:
        return []
    breaks = [m.start() for m in BLANK_LINE.finditer(text)]
    scope = lambda at: bisect_left(breaks, at)
    parts = sorted(base + weak)
    kept: set[Span] = set()
    for forward in (True, False):
        edge: dict[str, int] = {}  # of each role in this scope, the nearest end before or start after
        here = -1
        for part in parts if forward else reversed(parts):
            if scope(part[0]) != here:
                here, edge = scope(part[0]), {}
            role = ROLE[part[2]]
            for other, at in edge.items():
                if other != role and (part[0] - at if forward else at - part[1]) <= reach:
                    kept.add(part)
            edge[role] = max(edge.get(role, part[1]), part[1]) if forward else part[0]
    return [s for s in weak if s in kept]


def _text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, n_linked, spans -- a row per input row."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(rows, texts):
        out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "n_linked", "spans")}
        for t in texts.to_pylist():
            base = ordered(base_spans(t))
            more = linked(t, base, weak_spans(t), reach)
            kinds = [k for _, _, k in base]
            for c, v in zip(out, (*map(kinds.count, KINDS[:3]), hashlib.sha256(_text(base).encode()).hexdigest(), len(more), _text(ordered(base + more))), strict=True):
                out[c].append(v)
        return {"id": rows["id"], **{c: pa.array(v) for c, v in out.items()}}

    found = cm.map_texts(docs, run, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, n_linked bigint, spans string")
    return found.withColumnRenamed("id", doc_id)
