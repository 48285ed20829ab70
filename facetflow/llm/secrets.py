"""Secret scans with multipart credential linking.

Single secrets are found by pattern.  Weak parts (an identifier, a secret-like value, an endpoint) say
little alone: they are reported only where an interval join finds complementary parts within one scope.
A scope is a paragraph (text between blank lines); an interval reaches over all of it, however long it is.

- A part never completes itself: a value inside an identifier or an endpoint is no secret of its own, nor
  is a bare hexadecimal run there, and a weak part that a single secret overlaps is not reported again.
- Identifiers and access keys want a secret in their scope, endpoints too; a weak secret wants one of those.
- What only looks like a part is none: an unnamed value must change between small letters, capitals and digits
  as often as random ones do, so names in camel case, dated file names and the like aren't secrets, nor is what
  lies inside an address; an address is an endpoint only with credentials, a port, a service's scheme or a name
  such as host before it, so ordinary links are never reported.

Defined results: null and empty texts have no spans; equal rows get equal results; spans that start at one place
are written in the order of KINDS, then by their ends; spans of one kind never overlap; an empty table gives an empty result; texts of any length are scanned whole;
columns other than doc_id and text, whatever their names, are passed through by redact() and ignored by scan().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from facetflow.llm.common import id_and_text

# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "link_id", "link_secret", "link_endpoint")

# Weak parts: named identifiers, unnamed mixed-case values of 20 characters or more, addresses of services.
WEAK_ID = re.compile(r"\b(?:client_?id|key_?id|account_?id|tenant_?id|user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})", re.IGNORECASE | re.ASCII)
VALUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}")
ADDRESS = re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s\"'<>|]+", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(
    r"\bhttps?://(?:[^\s\"'<>|/@]+@[^\s\"'<>|]+|[a-z0-9.-]+:[0-9]{2,5}\b[^\s\"'<>|]*)|\b(?:postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp|s3)://[^\s\"'<>|]+"
    r"|\b(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?(?:https?://)?[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?",
    re.IGNORECASE | re.ASCII,
)
#: Changes between small letters, capitals and digits, as a share of all neighbours: random letters and digits have
#: 0.62 on average; words set together have about 0.3.
CHANGES = 0.4
#: More small letters, or digits, in a row make a word, or a number; at most this share of a value may be such.
RUN, PLAIN = re.compile(r"[a-z]{4,}|[0-9]{5,}"), 0.35
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
#: Code points around a part in which others count: all of its scope.
REACH = 1 << 40

Span = tuple[str, int, int]


def looks_random(value: str) -> bool:
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "" for c in value.rstrip("=")]
    solid = [k for k in kinds if k]
    changes = sum(x != y for x, y in zip(solid, solid[1:], strict=False))
    plain = sum(m.end() - m.start() for m in RUN.finditer(value))
    return changes >= CHANGES * (len(solid) - 1) and plain <= PLAIN * len(value)


class _Values:
    """Unnamed values that look random and lie in no address."""

    def finditer(self, text: str) -> Iterator[re.Match[str]]:
        found = [m for m in VALUE.finditer(text) if looks_random(m[0])]
        if found and "://" in text:
            within = [m.span() for m in ADDRESS.finditer(text)]
            found = [m for m in found if not any(a < m.end() and m.start() < b for a, b in within)]
        return iter(found)


WEAK_SECRET = _Values()


def base_spans(text: str) -> list[Span]:
    """The single secrets, each kind leftmost and without overlaps; in code points, end exclusive."""
    spans: list[Span] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return spans


Rows = np.ndarray  # (scope, start, end), sorted and disjoint


def _within(left: Rows, right: Rows) -> np.ndarray:
    """Interval join: for each row of left, whether a row of right in its scope comes within REACH of it.
    Two binary searches a row, so linear in the spans."""
    if not len(left) or not len(right):
        return np.zeros(len(left), dtype=bool)
    # ends and starts of right rise; those that may meet an interval form one run
    first = np.searchsorted(right[:, 2], left[:, 1] - REACH)
    last = np.searchsorted(right[:, 1], left[:, 2] + REACH, side="right")
    # ... cut to the scope, which rises too
    low = np.searchsorted(right[:, 0], left[:, 0], side="left")
    high = np.searchsorted(right[:, 0], left[:, 0], side="right")
    return np.minimum(last, high) > np.maximum(first, low)


def _overlaps(left: Rows, right: Rows) -> np.ndarray:
    """For each row of left, whether it shares a code point with a row of right."""
    if not len(left) or not len(right):
        return np.zeros(len(left), dtype=bool)
    k = np.searchsorted(right[:, 2], left[:, 1], side="right")
    return (k < len(right)) & (right[np.minimum(k, len(right) - 1), 1] < left[:, 2])


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts that have a complementary part nearby: identifiers with secrets (single ones too),
    secrets with identifiers, access keys or endpoints, endpoints with secrets."""
    has_sign = ":" in text or "=" in text
    if not has_sign and not base:
        return []
    ids = [m.span(1) for m in WEAK_ID.finditer(text)] if has_sign else []
    points = [m.span() for m in ENDPOINT.finditer(text)] if has_sign else []
    access = [(a, b) for kind, a, b in base if kind == "access"]
    if not ids and not points and not access:
        return []
    cuts = np.array([m.start() for m in PARAGRAPH.finditer(text)], dtype=np.int64)

    def rows(spans: list[tuple[int, int]]) -> Rows:
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out = np.array(merged, dtype=np.int64).reshape(-1, 2)
        return np.column_stack([np.searchsorted(cuts, out[:, 0], side="right"), out])

    names, places, single = rows(ids), rows(points), rows([(a, b) for _, a, b in base])
    carriers = rows(ids + points)  # what is inside one of these is part of it
    values = rows([m.span() for m in WEAK_SECRET.finditer(text)])
    values = values[~_overlaps(values, carriers) & ~_overlaps(values, single)]
    runs = rows([(a, b) for kind, a, b in base if kind == "hex"])
    named = [(a, b) for kind, a, b in base if kind == "assign"]
    secrets = rows(named + [(a, b) for _, a, b in np.concatenate([values, runs[~_overlaps(runs, carriers)]]).tolist()])
    own_names, own_places = names[~_overlaps(names, single)], places[~_overlaps(places, single)]
    found: list[Span] = []
    for kind, own, sides in (("link_id", own_names, (secrets,)), ("link_secret", values, (rows(ids + access), places)), ("link_endpoint", own_places, (secrets,))):
        if len(own):
            hit = np.logical_or.reduce([_within(own, side) for side in sides])
            found += [(kind, int(a), int(b)) for _, a, b in own[hit]]
    return found


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan(docs: DataFrame) -> DataFrame:
    """Per document its spans (array of kind, start, end) and the counts and digest of the single secrets."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base = base_spans(text)
                links = linked_spans(text, base)
                kinds = [k for k, _, _ in base]
                out.append((doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_written(base).encode()).hexdigest(), _written(base + links), len(links)))
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"]
            kinds_ = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds_, strict=True)], names=names)

    return id_and_text(docs).mapInArrow(run, schema)


def redacted(text: str, mark: str = "[secret]") -> str:
    """The text with every span, single or linked, replaced by a mark."""
    base = base_spans(text)
    spans = sorted((a, b) for _, a, b in base + linked_spans(text, base))
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs; secrets in the texts are replaced.  Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = [None if t is None else redacted(t) for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)
