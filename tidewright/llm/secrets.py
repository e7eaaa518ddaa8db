"""Secret scans with multipart credential linking.

Strong findings are reported wherever they occur: assigned secrets, access
identifiers and long hexadecimal runs. Weak candidates are reported only where
complementary parts co-occur: an interval join over the positions in a text pairs
identifiers, secrets and endpoints whose gaps are at most ``scope`` code points, and a weak one is
reported if a part of another role is that near (an endpoint needs a
secret, a weak secret an identifier or endpoint, a weak identifier a secret).
Intervals are joined by binary search over sorted starts, so a text full of
candidates costs n log n.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import col, map_arrow

ASSIGN, ACCESS, HEX = "assign", "access", "hex"
WEAK = ("identifier", "candidate", "endpoint")
#: Order of kinds among spans that start together.
KINDS = (ASSIGN, ACCESS, HEX, *WEAK)
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENTIFIER = re.compile(r"""(?ai)\b(?:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"(?ai)\b(?:https?|wss?|ftp|jdbc:\w+|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|\b(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9.-]{4,}")
_ROLE = {ASSIGN: "secret", HEX: "secret", ACCESS: "id", "identifier": "id", "candidate": "secret", "endpoint": "endpoint"}
_NEEDS = {"identifier": ("secret",), "candidate": ("id", "endpoint"), "endpoint": ("secret",)}

Span = tuple[int, int, str]


def _order(s: Span) -> tuple[int, int, int]:
    return s[0], KINDS.index(s[2]), s[1]


def base_spans(text: str) -> list[Span]:
    """Strong findings as (start, end, kind) in code points, leftmost and
    non-overlapping for each kind."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), ASSIGN) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), ACCESS) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), HEX) for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def _random_looking(s: str) -> bool:
    n = len(s)
    bits = -sum(c / n * log2(c / n) for c in (s.count(x) for x in set(s)))
    return bits >= 3.5 and any(x.isdigit() for x in s) and any(x.isupper() for x in s) and any(x.islower() for x in s)


def weak_spans(text: str) -> list[Span]:
    """Candidates that alone say little."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "identifier") for m in _IDENTIFIER.finditer(text)]
        out += [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    out += [(m.start(), m.end(), "candidate") for m in _CANDIDATE.finditer(text) if _random_looking(m[0])]
    return out


def linked(strong: list[Span], weak: list[Span], scope: int) -> list[Span]:
    """The weak spans that have a complementary part within the scope. A weak span that
    overlaps a strong one of its role is that finding and isn't told again."""
    by_role: dict[str, list[tuple[int, int]]] = {}
    for a, b, kind in [*strong, *weak]:
        by_role.setdefault(_ROLE[kind], []).append((a, b))
    starts, ends = {}, {}
    for role, spans in by_role.items():
        starts[role], ends[role] = sorted(a for a, _ in spans), sorted(b for _, b in spans)
    own = {role: sorted((a, b) for a, b, kind in strong if _ROLE[kind] == role) for role in by_role}
    reach = {role: list(accumulate((b for _, b in spans), max)) for role, spans in own.items()}

    def near(a: int, b: int, role: str) -> bool:
        # intervals that meet [a - scope, b + scope]: those that start by its end, less those that end before its start
        return role in starts and bisect_right(starts[role], b + scope) > bisect_left(ends[role], a - scope)

    def told(a: int, b: int, role: str) -> bool:
        at = bisect_left(own[role], (b, 0))  # those that start before b; one of them overlaps if the farthest end is past a
        return at > 0 and reach[role][at - 1] > a

    return [s for s in weak if not told(s[0], s[1], _ROLE[s[2]]) and any(near(s[0], s[1], r) for r in _NEEDS[s[2]])]


def find_secrets(text: str | None, scope: int = 200) -> list[Span]:
    if not text:
        return []
    strong, weak = base_spans(text), weak_spans(text)
    return sorted([*strong, *linked(strong, weak, scope)], key=_order) if weak else strong


def redact(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans becomes one mark that names its first kind."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind} removed]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, scope: int = 200, redacted: str | None = None) -> DataFrame:
    """The kept columns (the id by default), secret_starts, secret_ends and secret_kinds
    (parallel arrays by start, then kind; code points, end exclusive); with ``redacted`` also
    a column of that name with the text in which findings are replaced.

    Null and empty texts have no findings; redaction keeps null as null. Texts are scanned whole;
    repeated rows get equal results; an empty table gives no rows.
    """

    def make():
        def step(texts):
            whole = texts.to_pylist()
            found = [find_secrets(t, scope) for t in whole]
            out = [pa.array([[s[i] for s in x] for x in found], t) for i, t in enumerate([pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())])]
            if redacted:
                out.append(pa.array([redact(t, x) if x else t for t, x in zip(whole, found, strict=True)], pa.string()))
            return out

        return step

    fields = [("secret_starts", T.ArrayType(T.IntegerType())), ("secret_ends", T.ArrayType(T.IntegerType())), ("secret_kinds", T.ArrayType(T.StringType()))]
    return map_arrow(docs, [col(text_col).cast("string")], keep or [id_col], fields + ([(redacted, T.StringType())] if redacted else []), make)


def told_spans(base_only: bool) -> Column:
    """kind:start:end, comma-joined."""
    spans = F.arrays_zip("secret_starts", "secret_ends", "secret_kinds")
    if base_only:
        spans = F.filter(spans, lambda s: s["secret_kinds"].isin(ASSIGN, ACCESS, HEX))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["secret_kinds"], s["secret_starts"].cast("string"), s["secret_ends"].cast("string"))), ",")
