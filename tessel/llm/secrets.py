"""Secret scans with multipart credential linking.

Three base kinds are always reported: ``assign`` (a secret's name and a value of 8 or more characters),
``access`` (an access key id) and ``hex`` (32 or more hex digits). Three weak kinds are candidates only:
``ident`` (a user, login or client id with its value), ``key`` (a long mixed token that no base span covers)
and ``endpoint`` (a URL). Inside a scope, a stretch of text without an empty line, an interval join links
candidates whose spans lie at most ``REACH`` code points apart:

* an ``ident`` is reported with a secret near it (assign, hex or key),
* a ``key`` with an identifier (access or ident) or an endpoint near it,
* an ``endpoint`` with both an identifier and a secret near it.

The join sorts the spans of a scope and looks up the nearest ones on either side, so its work grows with the
spans and never with their pairs, and a document needs no other row: nothing is shuffled.

Defined results: a null or empty text has no spans; invalid UTF-8 reads as replacement characters; offsets are
code points, ends exclusive; equal texts give equal results, repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, id_and_text, utf8

KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
BASE = KINDS[:3]
#: Code points between two spans that still belong together, and bits a character that a key has at least.
REACH, KEY_BITS = 300, 3.5

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
IDENT = re.compile(r"(?<![A-Za-z0-9])(?:user(?:_?name|_?id)?|login|client_?id|account(?:_?id)?|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}", re.I | re.A)
IDENT_HINTS = ("user", "login", "client", "account", "access")
KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s\"'<>]+")
GAP = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """All spans of the base kinds, by kind."""
    out, low = [], text.lower()
    if any(x in low for x in ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _key_like(token: str) -> bool:
    if not (any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)):
        return False
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values()) >= KEY_BITS


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates that no base span overlaps."""
    out, low = [], text.lower()
    if any(x in low for x in IDENT_HINTS):
        out += [("ident", m.start(), m.end()) for m in IDENT.finditer(text)]
    if "://" in text:
        out += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    if out or any(k == "access" for k, _, _ in base):
        out += [("key", m.start(), m.end()) for m in KEY.finditer(text) if _key_like(m.group())]
    taken = sorted((a, b) for _, a, b in base)
    ends, most = [], 0  # the furthest end of all base spans up to each
    for _, b in taken:
        most = max(most, b)
        ends.append(most)
    starts = [a for a, _ in taken]

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i == 0 or ends[i - 1] <= a

    return [(k, a, b) for k, a, b in out if free(a, b)]


class Near:
    """Spans of some kinds in one document, to be asked for the nearest one in reach within a scope."""

    def __init__(self, spans: list[Span], kinds: tuple[str, ...], gaps: list[int]):
        self.spans = sorted((a, b, k) for k, a, b in spans if k in kinds)
        self.starts, self.gaps = [a for a, _, _ in self.spans], gaps
        self.furthest, most = [], 0  # which of the spans up to each has the furthest end
        for j, (_, b, _) in enumerate(self.spans):
            most = j if b >= self.spans[most][1] else most
            self.furthest.append(most)

    def to(self, start: int, end: int) -> tuple[int, int, str] | None:
        i, scope = bisect_left(self.starts, start), bisect_left(self.gaps, start)
        best = None
        for j in (i - 1, self.furthest[i - 1] if i else -1, i, i + 1):
            if 0 <= j < len(self.spans):
                a, b, _ = self.spans[j]
                apart = max(a - end, start - b, 0)
                if (a, b) != (start, end) and apart <= REACH and bisect_left(self.gaps, a) == scope and (best is None or apart < best[0]):
                    best = (apart, self.spans[j])
        return best and best[1]


def linked(text: str, base: list[Span]) -> tuple[list[Span], list[tuple[Span, Span, Span | None]]]:
    """The weak spans to report, and links of an identifier, its nearest secret and its nearest endpoint."""
    weak = weak_spans(text, base)
    if not weak:
        return [], []
    gaps = [m.start() for m in GAP.finditer(text)]
    every = base + weak
    ids, secrets, ends = (Near(every, kinds, gaps) for kinds in (("access", "ident"), ("assign", "hex", "key"), ("endpoint",)))
    out = []
    for k, a, b in weak:
        near_id, near_secret = ids.to(a, b), secrets.to(a, b)
        if (k == "ident" and near_secret) or (k == "key" and (near_id or ends.to(a, b))) or (k == "endpoint" and near_id and near_secret):
            out.append((k, a, b))
    links = []
    for a, b, k in ids.spans:
        if near := secrets.to(a, b):
            end = ends.to(a, b)
            links.append(((k, a, b), (near[2], *near[:2]), end and (end[2], *end[:2])))
    return out, links


def written(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


SCAN = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, links array<string>"


def _scan(raw: bytes) -> tuple:
    text = raw.decode("utf-8", "replace")
    base = base_spans(text)
    weak, links = linked(text, base)
    n = Counter(k for k, _, _ in base)
    said = ["+".join(f"{k}:{a}:{b}" for k, a, b in filter(None, link)) for link in links]
    return n["assign"], n["access"], n["hex"], hashlib.sha256(written(base).encode()).hexdigest(), written(base + weak), said


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and links (an identifier, a secret, maybe an endpoint)."""

    @F.pandas_udf(SCAN)
    def each(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_scan(bytes(x)) for x in texts], columns=[x.split()[0] for x in SCAN.split(", ")])

    return id_and_text(docs).select("doc_id", each(utf8(F.col("text"))).alias("s")).select("doc_id", "s.*")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
