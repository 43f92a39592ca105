"""Secrets in text: plain patterns, and weak candidates linked to their parts."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from xtalframe.llm.common import texts

# The base patterns and the order of kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")

#: Any run long enough to be a key; the hex and weak-secret tests look inside.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ID = re.compile(
    r"""(?<![A-Za-z0-9])(?:(?:access|client|account|application|tenant)[_-]?(?:key[_-]?)?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})""",
    re.IGNORECASE | re.ASCII,
)
_ENDPOINT = re.compile(
    r"""\b(?:https?|ftp|postgres(?:ql)?|mysql|redis|amqp|mongodb|jdbc:[a-z]+)://[^\s"'<>]+|(?<![A-Za-z0-9])host(?:name)?["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+""",
    re.IGNORECASE | re.ASCII,
)
_BLANK = re.compile(r"\n[^\S\n]*\n")
_CLASSES = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))

Span = tuple[int, int, str]

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "n_id long, n_secret long, n_endpoint long"
)


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    for run in _RUN.finditer(text):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, run.start(), run.end())]
    return out


def _weak(text: str, base: list[Span]) -> list[Span]:
    """Candidates too weak to report alone."""
    covered = sorted((a, b) for a, b, _ in base)
    starts = [a for a, _ in covered]
    furthest = list(accumulate((b for _, b in covered), max))  # end of all up to each place

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not k or furthest[k - 1] <= a

    ends = [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    urls = [a for a, _, _ in ends]

    def in_url(a: int) -> bool:
        k = bisect_left(urls, a + 1)
        return bool(k) and ends[k - 1][1] > a

    ids = [(m.start(), m.end(), "id") for m in _ID.finditer(text)]
    keys = [
        (m.start(), m.end(), "secret")
        for m in _RUN.finditer(text)
        if m.end() - m.start() >= 20
        and all(c.search(text, m.start(), m.end()) for c in _CLASSES)
        and free(m.start(), m.end())
        and not in_url(m.start())
    ]
    return ends + [s for s in ids if free(s[0], s[1])] + keys


def linked_spans(text: str, base: list[Span], reach: int | None = None) -> list[Span]:
    """Weak candidates with a complementary part in the same scope.

    A scope is a stretch of text without a blank line; with ``reach`` the parts
    also stand at most so many code points apart. Identifiers and endpoints
    complement secrets, and the other way round. Interval join by nearest
    neighbours: no span crosses a line, so for each candidate the complementary
    spans next to it on either side, and the one that ends last before it,
    decide; the work is n log n and no pairs are built.
    """
    weak = _weak(text, base)
    if not weak:
        return []
    breaks = [m.start() for m in _BLANK.finditer(text)]
    role = {"assign": "secret", "hex": "secret", "secret": "secret", "access": "part", "id": "part", "endpoint": "part"}
    sides: dict[str, list[Span]] = {"secret": [], "part": []}
    for s in sorted(base + weak):
        sides[role[s[2]]].append(s)
    starts = {k: [s[0] for s in v] for k, v in sides.items()}
    reaches = {k: list(accumulate(((b, a) for a, b, _ in v), max)) for k, v in sides.items()}

    def near(a: int, b: int, side: str) -> bool:
        k = bisect_left(starts[side], a)
        found = [s[:2] for s in sides[side][max(0, k - 1) : k + 1]]
        if k:
            found.append(reaches[side][k - 1][::-1])
        return any(
            (reach is None or max(x - b, a - y) <= reach) and bisect_left(breaks, min(a, x)) == bisect_left(breaks, max(a, x))
            for x, y in found
        )

    other = {"secret": "part", "part": "secret"}
    return [s for s in weak if near(s[0], s[1], other[role[s[2]]])]


def _listed(spans: list[Span]) -> str:
    order = {k: n for n, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def scan_text(text: str, reach: int | None = None) -> tuple:
    base = base_spans(text)
    linked = linked_spans(text, base, reach)
    n = {k: 0 for k in KINDS}
    for _, _, k in base + linked:
        n[k] += 1
    listed = _listed(base)
    return (
        n["assign"],
        n["access"],
        n["hex"],
        hashlib.sha256(listed.encode()).hexdigest(),
        _listed(base + linked) if linked else listed,
        n["id"],
        n["secret"],
        n["endpoint"],
    )


def scan_secrets(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """Secrets of every whole text, one row per input row.

    Base patterns report by themselves. Weak candidates (named identifiers,
    endpoints, mixed-class keys of 20 characters or more) are reported only
    where complementary parts stand together, see ``linked_spans``. The join is
    within a text, so it runs beside the scan: no shuffle, nothing to skew.

    Null and empty texts have no spans (``base_sha256`` of the empty string);
    repeated rows and null doc_ids are rows of their own. Spans that start alike
    are listed by kind, then by end. Very long texts take memory in proportion
    to their spans. Columns besides doc_id and text are not looked at. An empty
    table has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            rows = [scan_text(t.as_py(), reach) for t in batch.column(1)]
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names
            )

    return texts(docs).mapInArrow(run, SCHEMA)
