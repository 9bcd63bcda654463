"""Secret scan with multipart credential linking.

Every whole text is scanned for strong findings (assignments with a long value, access-key ids, long
hexadecimal runs) and for weak parts: short values assigned to the same words or to others, short access ids, short hexadecimal runs
and endpoints (URLs, host:port, user@host).  A weak part alone is no finding.  The parts are joined by
interval: within a scope (the part widened by ``reach`` characters on either side, cut at blank lines)
a weak part is reported when a part of a complementary role stands there, so an identifier needs a
secret or an endpoint beside a secret, and so on (``COMPLEMENTS``).  The join is a sorted sweep of the
parts, linear in their number; no pairs are formed, and a document is one row, so nothing shuffles.

Offsets are code points, end exclusive.  Defined results: null text counts as empty (no spans); every
row is scanned by itself, repeated rows alike; input columns named like a result give way to it; there
is no limit on text length or number of spans; spans that several kinds share are all reported.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, whole_text, with_results

REACH = 160
#: Fixed values of the base findings: pattern, group that is measured, least length.
BASE = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Weak parts: kind, role, pattern (with its own least length).
WEAK = (
    ("weak_id", "id", r"\b(?:user(?:name)?|login|account|client_?id|access_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}"),
    ("weak_id", "id", r"\bAKIA[A-Z0-9]{4,15}\b"),
    ("weak_secret", "secret", r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{3,5}(?![A-Za-z0-9+/_.=-])"),
    ("weak_secret", "secret", r"\b(?:pwd|pass|auth|key|credential)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{4,}"),
    ("weak_secret", "secret", r"\b(?=[0-9a-f]{0,15}[0-9])(?=[0-9a-f]{0,15}[a-f])[0-9a-f]{16,23}\b"),
    ("endpoint", "endpoint", r"\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqp)://[^\s\"'<>]+"),
    ("endpoint", "endpoint", r"\b(?:host|server|endpoint)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{3,}(?::[0-9]{2,5})?"),
)
#: Roles of the strong findings, and the roles that complete each role.
ROLES = {"assign": "secret", "access": "id", "hex": "secret"}
COMPLEMENTS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}

_ASSIGN, _ACCESS = (re.compile(p, f) for (_, p, _, _), f in zip(BASE, (re.ASCII | re.IGNORECASE, re.ASCII), strict=False))
#: Maximal runs: the same spans as the base pattern's runs that are long enough.
_HEX = re.compile(r"[0-9a-f]{24,}")
_WEAK = tuple((kind, role, re.compile(p, re.ASCII | re.IGNORECASE)) for kind, role, p in WEAK)
_BREAK = re.compile(r"\n\s*\n")
#: Every weak pattern needs one of these bytes somewhere.
_HINT = re.compile(r"[:=]|AKIA|[0-9a-f]{16}")

Span = tuple[int, int, str, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind, role) of the base findings, by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign", "secret") for m in _ASSIGN.finditer(text) if len(m[2]) >= BASE[0][3]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", "id") for m in _ACCESS.finditer(text) if m.end() - m.start() >= BASE[1][3]]
    found += [(m.start(), m.end(), "hex", "secret") for m in _HEX.finditer(text)]
    order = {kind: i for i, (kind, *_) in enumerate(BASE)}
    return sorted(found, key=lambda s: (s[0], order[s[2]]))


def weak_parts(text: str, strong: list[Span]) -> list[Span]:
    """Weak parts that do not lie inside a strong finding."""
    if not _HINT.search(text):
        return []
    found = {(m.start(), m.end(), kind, role) for kind, role, p in _WEAK for m in p.finditer(text)}
    starts, reach = [s[0] for s in strong], []
    for s in strong:
        reach.append(max(s[1], reach[-1] if reach else 0))

    def inside(start: int, end: int) -> bool:
        at = bisect_right(starts, start)
        return at > 0 and reach[at - 1] >= end

    return sorted(s for s in found if not inside(s[0], s[1]))


def link_parts(text: str, strong: list[Span], weak: list[Span], reach: int = REACH) -> list[Span]:
    """The weak parts with a complementary part in scope: an interval semi-join by sweep.

    Per role, starts are sorted and the running largest end is kept, so "does a part of this role meet
    the interval" is one binary search.  A part does not complete itself: roles differ."""
    if not weak or len(strong) + len(weak) < 2:
        return []
    breaks = [0, *(m.end() for m in _BREAK.finditer(text)), len(text) + 1]
    by_role: dict[str, tuple[list[int], list[int]]] = {}
    for start, end, _, role in sorted([*strong, *weak]):
        starts, ends = by_role.setdefault(role, ([], []))
        starts.append(start)
        ends.append(max(end, ends[-1] if ends else 0))
    linked = []
    for start, end, kind, role in weak:
        scope = bisect_right(breaks, start)
        lo, hi = max(start - reach, breaks[scope - 1]), min(end + reach, breaks[scope])
        for other in COMPLEMENTS[role]:
            starts, ends = by_role.get(other, ([], []))
            at = bisect_right(starts, hi - 1)
            if at and ends[at - 1] > lo:
                linked.append((start, end, kind, role))
                break
    return linked


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in spans)


_RESULT = "n_assign bigint, n_access bigint, n_hex bigint, n_linked bigint, base_sha256 string, spans string"


def _scanner(reach: int):
    @F.pandas_udf(_RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            base = base_spans(text)
            linked = link_parts(text, base, weak_parts(text, base), reach)
            kinds = [s[2] for s in base]
            rank = {"assign": 0, "access": 1, "hex": 2, "weak_id": 3, "weak_secret": 4, "endpoint": 5}
            spans = sorted([*base, *linked], key=lambda s: (s[0], rank[s[2]], s[1]))
            out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(linked),
                        hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans)))
        return pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans"])

    return scan


def scan_secrets(docs: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """The input rows and columns plus n_assign, n_access, n_hex, n_linked, base_sha256, spans."""
    text_batches(docs.sparkSession)
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        _scanner(reach)(whole_text(F.col(f"`{text_col}`"))).alias("found"))
    names = [f.split()[0] for f in _RESULT.split(", ")]
    return with_results(found.select("row.*", *[F.col(f"found.{n}").alias(f"found_{n}") for n in names]),
                        **{n: F.col(f"found_{n}") for n in names}).drop(*[f"found_{n}" for n in names])
