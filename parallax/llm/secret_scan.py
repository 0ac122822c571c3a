"""Secret scans: fixed patterns, plus sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ._common import bound_batches

#: kinds in the order that breaks ties of equal starts
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: a text without any of these (lower case) has no assignment
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STRINGS = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")
#: character classes: candidate strings, window length, least bits a character, what a window must hold, the parts of a
#: candidate that windows lie in (None: anywhere); letters of one case count in runs without separators, which words seldom fill
CLASSES = (
    (re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-F]{32,}|[0-9a-f]{32,})(?![0-9A-Fa-f])"), 32, 3.0, (DIGITS, "abcdefABCDEF"), None),
    (STRINGS, 24, 3.9, (DIGITS, LOWER, UPPER), None),
    (STRINGS, 24, 3.5, (DIGITS, LOWER), re.compile(r"[a-z0-9]{24,}")),
    (STRINGS, 24, 3.5, (DIGITS, UPPER), re.compile(r"[A-Z0-9]{24,}")),
)
#: candidates that are no secrets: UUIDs, integrity hashes, paths that are words throughout, file names
ALLOW = tuple(re.compile(p) for p in (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z",
    r"sha(?:256|384|512)-[A-Za-z0-9+/=_-]{1,88}\Z",
    r"(?:/?[A-Za-z][a-z]*(?:[-_][a-z]+)*/)+(?:[A-Za-z]+(?:[-_][A-Za-z]+)*[-_]?[0-9]{0,4})?\Z",
    r"[A-Za-z]+(?:[-_][A-Za-z]+)*[-_]?[0-9]{0,4}\Z",
))
#: shortest rest of a string beside a base span that is a span of its own
REST = 8
#: text before a candidate that makes it none
ALLOW_BEFORE = re.compile(r"(?:;base64,|\b(?:commit|sha1|sha256|md5|checksum|integrity|etag)[\s:=\"']{1,3})\Z", re.I | re.A)


def hot_windows(s: str, width: int, least: float) -> list[tuple[int, int]]:
    """Merged windows of ``width`` characters with at least ``least`` bits of entropy.

    ``H = log2(width) - sum(c * log2(c)) / width`` over the character counts
    ``c``; moving the window by one changes two counts."""
    if len(s) < width:
        return []
    weight = [c * math.log2(c) if c else 0.0 for c in range(width + 1)]
    counts: dict[str, int] = {}
    for ch in s[:width]:
        counts[ch] = counts.get(ch, 0) + 1
    total = sum(weight[c] for c in counts.values())
    limit = (math.log2(width) - least) * width + 1e-9
    out: list[tuple[int, int]] = []
    for start in range(len(s) - width + 1):
        if start:
            gone, come = s[start - 1], s[start + width - 1]
            if gone != come:
                c = counts[gone]
                total += weight[c - 1] - weight[c]
                counts[gone] = c - 1
                c = counts.get(come, 0)
                total += weight[c + 1] - weight[c]
                counts[come] = c + 1
        if total <= limit:
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], start + width)
            else:
                out.append((start, start + width))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"akia" in low:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _without(a: int, b: int, taken: list[tuple[int, int]], starts: list[int]) -> list[tuple[int, int]]:
    """What is left of ``a`` to ``b`` between the sorted spans ``taken``."""
    out = []
    at = max(bisect_left(starts, a) - 1, 0)
    while a < b and at < len(taken) and taken[at][0] < b:
        low, high = taken[at]
        if high > a:
            out.append((a, low))
            a = high
        at += 1
    out.append((a, b))
    return [(x, y) for x, y in out if y > x]


def entropy_spans(text: str, base: list[tuple[int, int, int]], allow=ALLOW, classes=CLASSES) -> list[tuple[int, int, int]]:
    """Strings that hold a window of high entropy, from the last ``=`` before its middle on, less the base spans; overlapping ones as one.

    A string that an allow rule fits as a whole is left alone.  Beside base
    spans, rests of ``REST`` characters or more stay."""
    found: list[tuple[int, int, int]] = []
    for pattern, width, least, needs, part in classes:
        for m in pattern.finditer(text):
            s, at = m.group(), m.start()
            if not all(any(c in need for c in s) for need in needs):
                continue
            if any(p.match(s) for p in allow) or ALLOW_BEFORE.search(text[max(0, at - 24):at]):
                continue
            for x in part.finditer(text, at, m.end()) if part else (m,):
                s, at = x.group(), x.start()
                if x is not m and any(p.match(s) for p in allow):
                    continue
                for a, b in hot_windows(s, width, least):
                    window = s[a:b]
                    if all(any(c in need for c in window) for need in needs):
                        found.append((text.rfind("=", m.start(), at + a + width // 2) + 1 or m.start(), 3, m.end()))
    taken = _merged(base)
    starts = [a for a, _ in taken]
    whole = [(a, b) for a, b in _merged(found)]
    parts = [(x, y, (a, b)) for a, b in whole for x, y in _without(a, b, taken, starts)]
    return [(x, 3, y) for x, y, all_ in parts if (x, y) == all_ or y - x >= REST]


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """All spans of a whole text as ``(start, kind, end)``, sorted."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + entropy_spans(text, base))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@F.pandas_udf(SPANS)
def find_secrets(texts: pd.Series) -> pd.Series:
    """Column function text -> spans by start, then kind; code points, end exclusive.

    A null or empty text has none.  Base kinds (``assign``, ``access``,
    ``hex``) are found leftmost and non-overlapping per kind; ``entropy``
    spans are strings that hold a window of high entropy, without what base
    spans cover of them."""
    return pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t)] for t in texts], dtype=object)


def scan_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans`` (replacing a column of that name); a row for each row, an empty table stays empty."""
    bound_batches(docs.sparkSession)
    return docs.withColumn("spans", find_secrets(F.col(text)))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span (overlaps merged) replaced by ``mark``."""
    if text is None:
        return None
    out, at = [], 0
    for a, _, b in scan(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
