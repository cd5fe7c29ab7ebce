"""Secret scans: certain patterns alone, weak candidates only beside complementary parts."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.scan import map_batches, slices, utf8

# The base kinds in their order and their patterns.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Parts that say nothing alone: an identifier, a secret and an endpoint.
WEAK = ("identifier", "key", "endpoint")
IDENTIFIER = re.compile(r"""(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
KEY = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
KEY_HAS = [re.compile(c) for c in ("[0-9]", "[A-Z]", "[a-z]")]
ENDPOINT = re.compile(r"(?:https?|s3|ftp|ssh|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{3,}", re.I | re.A)
KINDS = (*BASE, *WEAK)

#: Code points between two parts that may belong together.
SCOPE = 400
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_IDENTIFIER_WORDS = ("user", "login", "account", "client", "access")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base kinds, sorted."""
    found = []
    small = text.lower()
    if any(w in small for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def weak_spans(text: str) -> list[Span]:
    found = []
    small = text.lower()
    if any(w in small for w in _IDENTIFIER_WORDS):
        found += [(m.start(1), 3, m.end(1)) for m in IDENTIFIER.finditer(text)]
    if KEY_HAS[0].search(text):
        found += [(m.start(), 4, m.end()) for m in KEY.finditer(text) if all(c.search(m[0]) for c in KEY_HAS)]
    if "://" in text:
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return sorted(found)


#: Kinds that complete a credential with a weak part: an identifier or an endpoint needs something secret near it, and the reverse.
COMPLEMENT = {3: (0, 2, 4), 4: (1, 3, 5), 5: (0, 2, 4)}


def scopes(text: str) -> list[int]:
    """Where paragraphs begin; parts in different paragraphs don't belong together."""
    return [0, *(m.end() for m in re.finditer(r"\n[\x20\t\r]*\n", text))]


def linked(base: list[Span], weak: list[Span], bounds: list[int], scope: int) -> list[tuple[Span, Span]]:
    """Interval join: each weak part with the nearest complementary part of its paragraph within ``scope`` code points.

    Spans of one kind are disjoint, so the nearest before and after a part are found by bisection and a
    document of n parts costs n log n. Parts that overlap are one text and don't complete each other.
    """
    by_kind: dict[int, list[Span]] = {}
    for s in sorted([*base, *weak]):
        by_kind.setdefault(s[1], []).append(s)
    starts = {k: [s[0] for s in v] for k, v in by_kind.items()}
    ends = {k: [s[2] for s in v] for k, v in by_kind.items()}
    found = []
    for part in weak:
        start, kind, end = part
        home, near = bisect_right(bounds, start), []
        for k in COMPLEMENT[kind]:
            if k in by_kind:
                before, after = bisect_right(ends[k], start), bisect_left(starts[k], end)
                near += [(start - o[2], o) for o in by_kind[k][max(0, before - 1) : before]]
                near += [(o[0] - end, o) for o in by_kind[k][after : after + 1]]
        near = [x for x in near if x[0] <= scope and bisect_right(bounds, x[1][0]) == home]
        if near:
            found.append((part, min(near)[1]))
    return found


def _label(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _find(batches, scope: int):
    for batch in slices(batches):
        out: dict[str, list] = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "links")}
        for raw in batch.column(1).to_pylist():
            text = (raw or b"").decode("utf-8", "replace")
            base, weak = base_spans(text), weak_spans(text)
            pairs = linked(base, weak, scopes(text), scope) if weak else []
            for k, n in enumerate(("n_assign", "n_access", "n_hex")):
                out[n].append(sum(s[1] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(_label(base).encode()).hexdigest())
            out["spans"].append(_label(sorted({*base, *(p for p, _ in pairs)})))
            out["links"].append([f"{_label([a])}~{_label([b])}" for a, b in pairs])
        kinds = {"base_sha256": pa.string(), "spans": pa.string(), "links": pa.list_(pa.string())}
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items())], ["id", *out])


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans and links (weak part ~ complementary part).

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then by kind. The base kinds
    always count. Identifiers, keys (20 characters or more with capitals, small letters and digits) and
    endpoints are reported only where a complementary part stands in the same paragraph, within
    ``scope`` code points. A null text is empty and has none. A document's parts never leave its task, so
    one with very many costs its own length. Repeated rows and null ids give a row each.
    """
    schema = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, links array<string>"
    return map_batches(df.select(F.col(id_col).cast("long"), utf8(text_col)), partial(_find, scope=scope), schema)
