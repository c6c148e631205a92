"""Removal of repeated byte strings by distributed prefix doubling.

Positions are sparse: a text is cut into phrases at *anchors*, the positions whose
byte-gram hash is smallest in some window of neighbours.  Anchors depend on nearby
bytes only, so every string of ``length`` bytes holds, at the same places in each
of its occurrences, an anchor and a whole phrase.  Prefix doubling then runs over
phrases: Spark sorts (rank, position), equal neighbours keep a rank, unique
positions leave; the ranks of ``h`` and of the next ``h`` phrases make the rank of
``2h``, until all are unique or the threshold is passed.  A stretch of ``t``
phrases is ranked by its first and last ``2^k <= t`` phrases.

A start position belongs to the first anchor that its string holds for sure.  If
the phrases around all strings of an anchor repeat as a whole, all its positions
repeat.  If the phrases that all its strings hold do not repeat, or the bytes that they all hold,
none does.  What lies between (the ends of repeats) is decided by the hash of each
string, against those of all anchors whose strings hold the same bytes.

Strings are compared by 64-bit hashes.  Texts that occur in several rows are
removed as a whole if they are long enough, and enter the search once.  Defined
results: null and empty texts, and texts shorter than ``length``, keep all bytes
(null as no bytes); a null id is kept; repeated rows repeat each other; ties
cannot arise; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import written

_FIELD = 12  # bits of each small number in ``meta``
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _ODD = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


@dataclass(frozen=True)
class Shape:
    """Gram and window sizes for strings of ``length`` bytes."""

    length: int
    gram: int
    window: int

    @staticmethod
    def of(length: int) -> Shape:
        if not 8 <= length <= 1500:
            raise ValueError("length must lie between 8 and 1500")
        gram = 1 << max(0, (length // 25).bit_length() - 1)
        return Shape(length, gram, max(1, (length - gram) // 4))

    @property
    def before(self) -> int:
        """An anchor at least so far into a string is an anchor in all its occurrences ..."""
        return self.window - 1

    @property
    def after(self) -> int:
        """... if it also lies so far before the end."""
        return self.window + self.gram - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _ODD
        return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over ``x[i : i + width]`` for each i (the last ones shortened)."""
    out, h = x.copy(), 1
    while 2 * h <= width:
        out[:-h] = pick(out[:-h], out[h:])
        h *= 2
    if rest := width - h:
        out[:-rest] = pick(out[:-rest], out[rest:])
    return out


class Hashes:
    """Hash of any substring of a byte array in constant time."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            values = _TABLE[data]
            power = np.cumprod(np.full(len(data), _BASE, np.uint64), dtype=np.uint64)
            self.back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(data), _INVERSE, np.uint64), dtype=np.uint64)])
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power, dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.back[start]
            return _mixed(h + (end - start).astype(np.uint64) * _ODD)


def anchors(data: np.ndarray, starts: np.ndarray, shape: Shape) -> np.ndarray:
    """Anchor positions in texts that lie one behind the other from ``starts`` on (the last entry is the end)."""
    n = len(data)
    with np.errstate(over="ignore"):
        h, width, odd = _TABLE[data], 1, _ODD
        while width < shape.gram:
            h[:-width] = h[:-width] * odd + h[width:]
            width, odd = 2 * width, odd * _ODD
        h = _mixed(h)
    ends = np.repeat(starts[1:], np.diff(starts))
    at = np.arange(n)
    real = at + shape.gram <= ends
    h[~real] = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = _slide(h, shape.window, np.minimum)
    low[at + shape.window - 1 + shape.gram > ends] = 0  # windows that leave their text
    high = _slide(low[::-1], shape.window, np.maximum)[::-1]
    return np.flatnonzero(real & (high == h))


def _batches(texts: list[bytes], most: int = 4 << 20):
    """Texts in lists of bounded total size."""
    part, size = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def phrase_rows(texts: list[bytes], shape: Shape) -> tuple[np.ndarray, ...]:
    """``(text, j << 32 | x, meta, rank, core)`` of the phrases of texts of at least ``length`` bytes.

    ``meta`` packs, relative to the anchor ``x``: its first and last start position,
    the phrases that all its strings hold, and the stretch around all its strings
    (phrases before the anchor, and in all; 0 if the text has no such stretch).
    ``core`` is the hash of the bytes that all strings of the anchor hold.
    """
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    x = anchors(data, starts, shape)
    doc = np.searchsorted(starts, x, side="right") - 1
    first, last = np.searchsorted(x, starts[:-1]), np.searchsorted(x, starts[1:])
    i = np.arange(len(x))
    has_next = i + 1 < last[doc]
    begin, size = starts[doc], np.diff(starts)[doc]
    own = x - begin
    previous = np.where(i > first[doc], own[np.maximum(i - 1, 0)], -1)
    lo = np.where(i > first[doc], np.maximum(previous - shape.before + 1, 0), 0)
    hi = np.minimum(own - shape.before, size - shape.length)
    some = (hi >= lo) & has_next
    held = np.searchsorted(x, begin + lo + shape.length - shape.after, side="right") - 1 - i
    left = np.searchsorted(x, begin + lo, side="right") - 1
    right = np.searchsorted(x, begin + hi + shape.length, side="left")
    around = some & (left >= first[doc]) & (right < last[doc])
    meta = np.zeros(len(x), np.int64)
    for value, use in ((own - lo, some), (own - hi, some), (held, some), (i - left, around), (right - left, around)):
        meta = meta << _FIELD | np.where(use, value, 0)
    k = np.flatnonzero(has_next)
    hashes = Hashes(data)
    rank = hashes.of(x[k], x[k + 1])
    core = np.zeros(len(x), np.uint64)
    at = np.flatnonzero(some)  # all strings of an anchor hold the bytes from its last start to the end of its first string
    core[at] = hashes.of(x[at] - shape.before, x[at] - shape.before - shape.window + 1 + shape.length)
    return doc[k], ((i - first[doc]) << 32 | own)[k], meta[k], rank.astype(np.int64), core[k].astype(np.int64)


def _repeated(rows: DataFrame, key: str, instance: list[str]) -> DataFrame:
    """Rows whose ``key`` occurs at two different instances at least (each instance once).

    Spark sorts by key and instance; the sorted rows are read as a stream, of
    which one row is carried from batch to batch.
    """
    columns = rows.columns

    def stream(batches):
        left, sent = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks()
            k, own = t.column(key).to_numpy(), [t.column(c).to_numpy() for c in instance]
            new, same = np.ones(len(k), bool), k[1:] == k[:-1]
            new[1:] = ~(same & np.logical_and.reduce([c[1:] == c[:-1] for c in own]))
            t, k = t.filter(pa.array(new)), k[new]
            same = k[1:] == k[:-1]
            many = np.zeros(len(k), bool)
            many[1:] |= same
            many[:-1] |= same
            last_goes = bool(many[-1]) or (len(k) == 1 and sent)
            many[0] = many[0] and not sent
            left, sent = t.slice(len(k) - 1, 1).combine_chunks().to_batches()[0], last_goes
            yield from t.filter(pa.array(many)).to_batches()

    return rows.repartition(key).sortWithinPartitions(key, *instance).mapInArrow(stream, rows.schema).select(*columns)


def _settle(ranks: DataFrame, shape: Shape) -> DataFrame:
    """``(k, lo, hi, core, around)`` of anchors whose sure phrases repeat, from all ranks of their text."""
    mask = (1 << _FIELD) - 1

    def decide(t: pa.Table) -> pa.RecordBatch:
        k, h, jx, meta, r, core = (t.column(c).to_numpy() for c in ("k", "h", "jx", "meta", "r", "core"))
        text = np.unique(k, return_inverse=True)[1]
        log = np.round(np.log2(h)).astype(np.int64)
        name = lambda text, log, j: (text << 6 | log) << 32 | j  # noqa: E731  texts of a batch, so 26 bits do
        names = name(text, log, jx >> 32)
        order = np.argsort(names)
        names, ranks_ = names[order], r[order]

        def rank(text, log, j):
            want = name(text, log, j)
            at = np.minimum(np.searchsorted(names, want), len(names) - 1)
            return names[at] == want, ranks_[at]

        base = np.flatnonzero(log == 0)
        text, j, x, m, core, k = text[base], jx[base] >> 32, jx[base] & 0xFFFFFFFF, meta[base], core[base], k[base]
        all_, before, held, last, lead = ((m >> (_FIELD * f)) & mask for f in range(5))
        use = held > 0
        power = np.floor(np.log2(np.maximum(held, 1))).astype(np.int64)
        use &= rank(text, power, j)[0] & rank(text, power, j + held - (1 << power))[0]
        power = np.floor(np.log2(np.maximum(all_, 1))).astype(np.int64)
        has_a, a = rank(text, power, j - before)
        has_b, b = rank(text, power, j - before + all_ - (1 << power))
        around = use & (all_ > 0) & has_a & has_b
        with np.errstate(over="ignore"):
            key = _mixed(_mixed(a.astype(np.uint64) + all_.astype(np.uint64)) ^ (b.astype(np.uint64) * _ODD)).astype(np.int64)
        out = [k, x - lead, x - last, core]
        return pa.RecordBatch.from_arrays([pa.array(c[use].astype(np.int64)) for c in out] + [pa.array(key[use], mask=~around[use])], ["k", "lo", "hi", "core", "around"])

    def stream(batches):
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            k = t.column("k").to_numpy()
            other = np.flatnonzero(k != k[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            left = t.slice(cut)
            if cut:
                yield decide(t.slice(0, cut))
        if left is not None and left.num_rows:
            yield decide(left)

    return ranks.repartition("k").sortWithinPartitions("k").mapInArrow(stream, "k bigint, lo bigint, hi bigint, core bigint, around bigint")


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """``(k, start, end)`` of repeated stretches of ``texts(k, data binary)``; equal texts share ``k`` and enter once."""
    shape = Shape.of(length)
    long_ = texts.filter(F.octet_length("data") >= length)
    schema = pa.schema([("k", pa.int64()), ("jx", pa.int64()), ("meta", pa.int64()), ("r", pa.int64()), ("core", pa.int64())])

    def cut(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, data = batch.column(0).to_numpy(), batch.column(1)
            fresh = [i for i, k in enumerate(keys.tolist()) if not (k in seen or seen.add(k))]
            own = [data[i].as_py() for i in fresh]
            for part in _batches(own):
                doc, jx, meta, r, core = phrase_rows([own[i] for i in part], shape)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys[[fresh[i] for i in part]][doc], jx, meta, r, core)], schema=schema)

    level = written(_repeated(long_.mapInArrow(cut, "k bigint, jx bigint, meta bigint, r bigint, core bigint"), "r", ["k", "jx"]), "rank-1")
    most = level.agg(F.max(F.col("meta").bitwiseAND((1 << _FIELD) - 1))).first()[0] or 0
    ranks, h = level.withColumn("h", F.lit(1)), 1
    while 2 * h <= most:
        # the rank of 2h phrases is the pair of ranks at offset h
        ahead = level.select(F.col("k").alias("k2"), (F.shiftright("jx", 32) - h).alias("j2"), F.col("r").alias("r2"))
        pair = level.join(ahead, (F.col("k") == F.col("k2")) & (F.shiftright("jx", 32) == F.col("j2"))).select("k", "jx", F.lit(0).cast("bigint").alias("meta"), F.xxhash64("r", "r2").alias("r"), F.lit(0).cast("bigint").alias("core"))
        h *= 2
        level = written(_repeated(pair, "r", ["k", "jx"]), f"rank-{h}")
        if not level.head(1):
            break
        ranks = ranks.unionByName(level.withColumn("h", F.lit(h)))
    settled = written(_repeated(_settle(ranks, shape), "core", ["k", "lo"]), "settled")
    whole = written(_repeated(settled.filter("around IS NOT NULL"), "around", ["k", "lo"]).select("k", "lo", "hi"), "whole")
    marked = written(settled.join(whole.select("k", "lo", F.lit(True).alias("sure")), ["k", "lo"], "left").select("k", "lo", "hi", "core", F.col("sure").isNull().alias("ask")), "marked")
    asked = marked.filter("ask").select("core").distinct()
    ranges = marked.join(asked, "core", "left_semi").groupBy("k").agg(F.collect_list(F.struct("lo", "hi", "ask")).alias("ranges"))

    def strings(batches):
        seen: set[int] = set()
        for batch in batches:
            for k, data, ranges_ in zip(*(c.to_pylist() if n != 1 else c for n, c in enumerate(batch.columns))):
                if k in seen:
                    continue
                seen.add(k)
                start = np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in ranges_])
                ask = np.concatenate([np.full(r["hi"] + 1 - r["lo"], r["ask"]) for r in ranges_])
                bytes_ = np.frombuffer(data.as_py(), dtype=np.uint8)
                h = Hashes(bytes_).of(start, start + length).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), k)), pa.array(start.astype(np.int64)), pa.array(ask)], ["h", "k", "start", "ask"])

    hashed = long_.join(ranges, "k").select("k", "data", "ranges").mapInArrow(strings, "h bigint, k bigint, start bigint, ask boolean")
    ends = _repeated(hashed, "h", ["k", "start"]).filter("ask").select("k", "start", (F.col("start") + length).alias("end"))
    return whole.select("k", F.col("lo").alias("start"), (F.col("hi") + length).alias("end")).unionByName(ends)


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, spans, kept)`` of every row of ``docs(doc_id, text)``.

    ``spans`` lists the maximal removed runs as ``start, end`` pairs in bytes, ``kept`` holds the remaining bytes.
    """
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(data).alias("k"), data.alias("data"))
    spans = repeated_spans(rows.select("k", "data"), length)
    merged = spans.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    copies = rows.filter(F.octet_length("data") >= length).groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k", F.lit(True).alias("copied"))
    known = written(merged.join(copies, "k", "full"), "spans")

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], [], []]
                for data, found, copied in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    runs: list[list[int]] = [[0, len(data)]] if copied else []
                    for f in sorted((f["start"], f["end"]) for f in (found or ())) if not copied else ():
                        if runs and f[0] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], f[1])
                        else:
                            runs.append(list(f))
                    edges = [0, *(e for r in runs for e in r), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    for col, v in zip(out, (len(data), len(data) - len(kept), len(runs), runs, kept)):
                        col.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return rows.join(known, "k", "left").select("doc_id", "data", "found", "copied").mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<array<bigint>>, kept binary")
