"""Secrets in texts: fixed patterns, and strings whose characters look drawn at random.

Base kinds are patterns (``assign``, ``access``, ``hex``).  The method adds spans:
candidate strings are the maximal runs of a character class; a window slides over
each, its character counts change by one in and one out, and with them the sum of
``c * log2 c`` (kept in whole numbers, so a window's value does not depend on where
the run began), from which Shannon entropy follows.  Windows at or above the class's
threshold join to spans.  An allow-list suppresses what is known to be harmless:
numbers, words, UUIDs, alphabets, documentation examples, and digests that are
announced as such.  It never suppresses a base span, and an added span inside a base
one is not repeated.

Texts are read as bytes, several at a time in bounded pieces, one narrow pass without
a shuffle: no pattern or class holds a line feed, so texts joined by one never match
across.  Positions are code points of the single text, end exclusive.

Defined results: a null or empty text has no spans; rows that repeat or share an id
are each scanned; a null id is carried; spans are ordered by start, kind as listed in
``KINDS`` and end, so ties are settled; a very long text is one piece of its own and a
very long run costs a step per character; an empty table gives no rows.  All columns
are kept, but one called ``secrets`` gives way to the result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text scanned together.
PIECE_BYTES = 4 << 20

# The base patterns and their least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = b"0123456789abcdef"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = b"0123456789"


@dataclass(frozen=True)
class CharClass:
    """A class of characters, the window over its runs and the least entropy (bits a character) of a hit."""

    kind: str
    members: bytes
    window: int
    least: float


CLASSES = (
    CharClass("entropy_hex", DIGITS + b"ABCDEFabcdef", 16, 3.0),
    CharClass("entropy_alnum", DIGITS + LETTERS, 20, 3.85),
    CharClass("entropy_base64", DIGITS + LETTERS + b"+/_=-", 24, 4.1),
)
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))
BASE = KINDS[:3]

#: Harmless strings: a hit is dropped if its span matches one of these whole.
ALLOWED_SPANS = (
    rb"[0-9]+",  # numbers
    rb"[A-Za-z]+",  # words and camel case
    rb"(?:[A-Za-z]+[-_/=+])+[A-Za-z]*",  # paths and compounds of words
    rb"(?:[A-Za-z]*[-_/])*[A-Za-z]*[0-9]{1,4}",  # numbered names
    rb".*(?:EXAMPLE|example|SAMPLE|sample|0123456789|abcdefghij|ABCDEFGHIJ).*",  # documentation and alphabets
)
#: Harmless strings with what stands around them: a hit inside a match is dropped.
ALLOWED_AROUND = (
    rb"\b[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}\b",  # UUIDs
    rb"(?i:\b(?:sha-?(?:1|224|256|384|512)|md5|crc32|etag|commit|checksum|digest|integrity)\b)[\"']?\x20*[-:=]?\x20*[\"']?[A-Za-z0-9+/=_-]+",  # announced digests
)

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                     T.StructField("entropy", T.DoubleType()), T.StructField("value", T.StringType())])


def runs(data: np.ndarray, members: bytes, least: int) -> list[tuple[int, int]]:
    """Maximal runs of ``members`` in ``data`` of at least ``least`` bytes."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(members, dtype=np.uint8)] = True
    outside = np.concatenate([[-1], np.flatnonzero(~table[data]), [len(data)]])
    at = np.flatnonzero(np.diff(outside) > least)
    return [(int(outside[i]) + 1, int(outside[i + 1])) for i in at]


_UNIT = 1 << 32


def window_hits(run: bytes, window: int, least: float) -> list[tuple[int, int, float]]:
    """Joined windows of ``run`` with entropy >= ``least``: ``(start, end, highest entropy)``."""
    terms = [0, *(round(c * math.log2(c) * _UNIT) for c in range(1, window + 1))]
    most = math.floor(window * (math.log2(window) - least) * _UNIT)
    counts, total, out = [0] * 256, 0, []
    for i, new in enumerate(run):
        c = counts[new]
        total += terms[c + 1] - terms[c]
        counts[new] = c + 1
        if i >= window - 1:
            if total <= most:
                entropy, lo = math.log2(window) - total / _UNIT / window, i - window + 1
                if out and lo <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1, max(out[-1][2], entropy))
                else:
                    out.append((lo, i + 1, entropy))
            old = run[i - window + 1]
            c = counts[old]
            total += terms[c - 1] - terms[c]
            counts[old] = c - 1
    return out


class Scanner:
    """Finds spans ``(start, end, kind number, entropy)`` in joined texts; byte positions."""

    def __init__(self, classes: tuple[CharClass, ...], allowed_spans: tuple[bytes, ...], allowed_around: tuple[bytes, ...]):
        self.classes = classes
        self.whole = re.compile(b"|".join(b"(?:%s)" % p for p in allowed_spans) or rb"(?!)", re.DOTALL)
        self.around = [re.compile(p) for p in allowed_around]

    def base(self, text: bytes, data: np.ndarray) -> list[tuple[int, int, int, float | None]]:
        out = [(m.start(), m.end(), 0, None) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        out += [(m.start(), m.end(), 1, None) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        return out + [(lo, hi, 2, None) for lo, hi in runs(data, HEX, HEX_LEAST)]

    def added(self, text: bytes, data: np.ndarray) -> list[tuple[int, int, int, float | None]]:
        return [(lo + a, lo + b, kind, h) for kind, c in enumerate(self.classes, len(BASE)) for lo, hi in runs(data, c.members, c.window)
                for a, b, h in window_hits(text[lo:hi], c.window, c.least) if not self.whole.fullmatch(text, lo + a, lo + b)]

    def spans(self, text: bytes) -> list[tuple[int, int, int, float | None]]:
        data = np.frombuffer(text, dtype=np.uint8)
        base, added = self.base(text, data), self.added(text, data)
        if added:
            harmless = base + [(m.start(), m.end()) for p in self.around for m in p.finditer(text)]
            added = outside(added, harmless)
        return sorted(base + added, key=lambda s: (s[0], s[2], s[1]))


def outside(spans: list[tuple], covers: list[tuple]) -> list[tuple]:
    """The spans that lie in none of ``covers``."""
    if not covers:
        return spans
    covers = sorted(covers, key=lambda c: c[0])
    starts, reach = np.array([c[0] for c in covers]), np.maximum.accumulate([c[1] for c in covers])
    at = np.searchsorted(starts, [s[0] for s in spans], side="right") - 1
    return [s for s, i in zip(spans, at) if i < 0 or reach[i] < s[1]]


def _piece(scanner: Scanner, texts: list[bytes]) -> list[list[dict]]:
    text = b"\n".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    out: list[list[dict]] = [[] for _ in texts]
    last = (-1, 0, 0)  # text, bytes and code points read in it
    for lo, hi, kind, entropy in scanner.spans(text):
        doc = int(np.searchsorted(ends, lo, side="right"))
        first = int(ends[doc - 1]) if doc else 0
        seen, points = (last[1], last[2]) if last[0] == doc else (first, 0)
        points += len(text[seen:lo].decode("utf-8", "replace"))
        last = (doc, lo, points)
        value = text[lo:hi].decode("ascii")  # every class and pattern is ASCII
        out[doc].append({"kind": KINDS[kind], "start": points, "end": points + hi - lo, "entropy": entropy, "value": value})
    return out


def find_secrets(docs: DataFrame, classes: tuple[CharClass, ...] = CLASSES, allowed_spans: tuple[bytes, ...] = ALLOWED_SPANS,
                 allowed_around: tuple[bytes, ...] = ALLOWED_AROUND) -> DataFrame:
    """``docs`` with ``secrets``, an array of ``(kind, start, end, entropy, value)``; entropy is null for base kinds.

    ``classes`` must be those of ``CLASSES`` in kind and order; windows, thresholds and allow-lists are free.
    """
    own = docs.drop("secrets")
    read = own.withColumn("_ss_text", F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"))
    schema = T.StructType([*own.schema.fields, T.StructField("secrets", T.ArrayType(SPAN))])
    found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("entropy", pa.float64()), ("value", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allowed_spans, allowed_around)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE_BYTES, side="right")) - 1)
                part = batch.slice(lo, hi - lo)
                spans = pa.array(_piece(scanner, part.column(part.num_columns - 1).to_pylist()), type=found)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], spans], names=[*part.schema.names[:-1], "secrets"])
                lo = hi

    return read.mapInArrow(scan, schema)


def digest_columns(found: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, the digest of the base spans and all spans as text."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
