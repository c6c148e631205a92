"""Choices of word groups and what is made of them, over the token arrays of whole Arrow batches.

Lists are handled as flat arrays with offsets (``Lists``).  Only the choice itself, which is order
dependent, walks the groups of a sample one by one, and stops when the sample's budget is used up.

No ``from __future__ import annotations`` here: UDF type hints must be real types.
"""

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpuskit.functions import specials as S
from corpuskit.functions.hashing import draw, draws, heads

SPECIALS = (S.CLS, S.SEP, S.PAD)
SOON = 32  # groups of a row, in hash order, whose lengths are drawn at once; later ones are seldom visited


def none_of(dtype) -> int:
    """The value that stands for a null element."""
    return int(np.iinfo(dtype).min)


class Lists:
    """A list column as ``values`` and ``at``, the offsets of its rows; null rows (``gone``) have no values."""

    def __init__(self, at: np.ndarray, values: np.ndarray, gone: np.ndarray | None = None):
        self.at, self.values, self.gone = at, values, gone

    @classmethod
    def of(cls, column: pa.Array) -> "Lists":
        values = column.flatten()
        dtype = values.type.to_pandas_dtype()
        if values.null_count:
            values = pc.fill_null(values, none_of(dtype))
        at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        return cls(at, values.to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None)

    def sizes(self) -> np.ndarray:
        return np.diff(self.at)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.sizes())

    def arrow(self, kind: pa.DataType | None = None) -> pa.Array:
        values = self.values if kind is None else self.values.astype(kind.to_pandas_dtype(), copy=False)
        nulls = values == none_of(values.dtype)
        flat = pa.array(values, mask=nulls if nulls.any() else None)
        return pa.ListArray.from_arrays(pa.array(self.at.astype(np.int32)), flat, mask=None if self.gone is None else pa.array(self.gone))


def ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``lo[0], lo[0] + 1, ...`` of each range, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - size), size)


def struct(**fields: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(fields.values()), list(fields))


def word_groups(tokens: Lists, first_continuation: int) -> tuple[Lists, Lists]:
    """Places of the tokens that are not special, and where among them each word group starts and the last one ends."""
    t = tokens.values
    flat = np.flatnonzero(~np.isin(t, SPECIALS) & (t != none_of(t.dtype)))
    at = np.searchsorted(flat, tokens.at)
    start = t[flat] < first_continuation
    start[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(start)
    k = len(at) - 1
    groups = np.searchsorted(starts, at)
    row = np.repeat(np.arange(k), np.diff(groups))
    bounds = np.empty(len(starts) + k, np.int32)
    bounds[np.arange(len(starts)) + row] = starts - at[row]
    bounds[groups[1:] + np.arange(k)] = np.diff(at)
    cand = Lists(at, (flat - np.repeat(tokens.at[:-1], np.diff(at))).astype(np.int32), tokens.gone)
    return cand, Lists(groups + np.arange(k + 1), bounds)


def words_of(tokens: Lists, first_continuation: int) -> Lists:
    """Of each token its word group, null for a special one."""
    cand, bounds = word_groups(tokens, first_continuation)
    out = np.full(len(tokens.values), none_of(np.int32), np.int32)
    n = bounds.sizes() - 1
    starts = np.delete(np.arange(len(bounds.values)), bounds.at[1:] - 1)  # without the ends
    number = np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n)
    size = bounds.values[starts + 1] - bounds.values[starts]
    out[cand.values + tokens.at[:-1][cand.owner()]] = np.repeat(number, size)
    return Lists(tokens.at, out, tokens.gone)


def choose(bounds: Lists, seed: int, key: pa.Array, salt: str, budget: pa.Array, cuts: list[int], taken: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
    """Runs ``(row, g, hi)`` of word groups, by row and place, within ``budget`` tokens, apart from each other and from ``taken`` runs.

    Groups are visited in hash order; the run of each is as long as drawn (``cuts``), or as the budget leaves.
    """
    n = np.maximum(bounds.sizes() - 1, 0)
    k, ends = len(n), np.cumsum(n)
    row = np.repeat(np.arange(k), n)
    number = np.arange(len(row)) - np.repeat(ends - n, n)
    h = draws(heads(seed, key, salt), row, number)
    order = np.argsort((row.astype(np.uint64) << np.uint64(32)) | h, kind="stable")
    more, length = heads(seed, key, salt + "n"), np.zeros(len(row), np.int64)
    soon = np.flatnonzero(number < SOON)  # by place in the order; a row has as many groups in it
    length[soon] = 1 + np.searchsorted(np.array(cuts, np.uint64), draws(more, row[soon], number[order[soon]]), side="right")
    turn, most, at = number[order].tolist(), length.tolist(), bounds.values.tolist()
    lefts, firsts, begins = pc.fill_null(budget, 0).to_pylist(), bounds.at.tolist(), (ends - n).tolist()
    spoken: dict[int, list] = {}
    if taken is not None:
        for r, g, hi in zip(*(x.tolist() for x in taken)):
            spoken.setdefault(r, []).append((g, hi))
    out: list[tuple[int, int, int]] = []
    for r, m in enumerate(n.tolist()):
        left, b = lefts[r], firsts[r]
        if left <= 0:
            continue
        used, own = bytearray(m), []
        for g, hi in spoken.get(r, ()):
            used[g:hi] = b"\1" * (hi - g)
        for x in range(begins[r], begins[r] + m):
            g = turn[x]
            lo = at[b + g]
            if at[b + g + 1] - lo > left:
                continue
            hi, end = g + 1, min(g + (most[x] or 1 + bisect_right(cuts, draw(more[r], g))), m)
            while hi < end and at[b + hi + 1] - lo <= left:
                hi += 1
            if used.find(1, g, hi) >= 0:
                continue
            used[g:hi] = b"\1" * (hi - g)
            own.append((r, g, hi))
            left -= at[b + hi] - lo
            if not left:
                break
        own.sort()
        out += own
    rows, gs, his = np.array(out, np.int64).reshape(-1, 3).T
    return rows, gs, his


def spans_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, g, hi)`` of an array of runs."""
    flat, n = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), n), *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("g", "hi"))


def spans_arrow(row: np.ndarray, g: np.ndarray, hi: np.ndarray, k: int) -> pa.Array:
    at = np.searchsorted(row, np.arange(k + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), struct(g=pa.array(g.astype(np.int32)), hi=pa.array(hi.astype(np.int32))))


def span_places(cand: Lists, bounds: Lists, row: np.ndarray, g: np.ndarray, hi: np.ndarray) -> tuple[Lists, np.ndarray]:
    """Token places of the runs of each row, and the number of places of each run."""
    lo, end = bounds.values[bounds.at[row] + g].astype(np.int64), bounds.values[bounds.at[row] + hi]
    size = end - lo
    places = cand.values[ranges(cand.at[row] + lo, size)]
    each = np.bincount(row, weights=size, minlength=len(cand.at) - 1).astype(np.int64)
    return Lists(np.concatenate([[0], np.cumsum(each)]), places), size


def masked(key: pa.Array, tokens: pa.Array, budget: pa.Array, seed: int, first_continuation: int, cuts: list[int]) -> pa.Array:
    cand, bounds = word_groups(Lists.of(tokens), first_continuation)
    runs = choose(bounds, seed, key, "m", budget, cuts)
    return struct(cand=cand.arrow(), bounds=bounds.arrow(), spans=spans_arrow(*runs, len(key)), positions=span_places(cand, bounds, *runs)[0].arrow())


def replaced(key: pa.Array, tokens: pa.Array, positions: pa.Array, seed: int, vocab_end: int, style: str) -> pa.Array:
    t, p = Lists.of(tokens), Lists.of(positions)
    row = p.owner()
    flat = t.at[row] + p.values
    out, labels = t.values.copy(), t.values[flat]
    if style == "t5":
        out[flat] = S.MASK
    else:
        u = draws(heads(seed, key, "rep"), row, p.values) % np.uint64(10)
        out[flat[u < 8]] = S.MASK
        other = u == 9
        drawn = draws(heads(seed, key, "rid"), row[other], p.values[other])
        out[flat[other]] = S.FIRST_WORD_ID + (drawn % np.uint64(vocab_end - S.FIRST_WORD_ID)).astype(np.int64)
    return struct(labels=Lists(p.at, labels).arrow(), output=Lists(t.at, out, t.gone).arrow())


def permuted(key, tokens, output, positions, cand, bounds, budget, taken, seed: int, cuts: list[int]) -> pa.Array:
    t, new, p, cand, bounds = (Lists.of(x) for x in (tokens, output, positions, cand, bounds))
    k = len(key)
    runs = choose(bounds, seed, key, "perm", budget, cuts, spans_of(taken))
    moved = span_places(cand, bounds, *runs)[0]
    row = moved.owner()
    order = np.argsort((row.astype(np.uint64) << np.uint64(32)) | draws(heads(seed, key, "pp"), row, moved.values), kind="stable")  # places ascend
    out = new.values.copy()
    out[new.at[row] + moved.values] = t.values[t.at[row] + moved.values[order]]
    rows = np.concatenate([p.owner(), row])
    both = np.sort((rows << 32) | np.concatenate([p.values, moved.values]).astype(np.int64))
    rows, places = both >> 32, both & 0xFFFFFFFF
    at = np.searchsorted(rows, np.arange(k + 1))
    return struct(permuted=moved.arrow(), output=Lists(new.at, out, new.gone).arrow(), positions=Lists(at, places.astype(np.int32)).arrow(),
                  labels=Lists(at, t.values[t.at[rows] + places]).arrow())


def padded(tokens: pa.Array, types: pa.Array, positions: pa.Array, labels: pa.Array, max_len: int, ignore: int) -> pa.Array:
    t, y, p, own = (Lists.of(x) for x in (tokens, types, positions, labels))
    fill = max_len - t.sizes()
    if (fill < 0).any():
        raise ValueError("a sample is longer than its padded length")
    k = len(fill)

    def longer(x: Lists, value: int) -> Lists:
        at = np.concatenate([[0], np.cumsum(x.sizes() + fill)])
        out = np.full(at[-1], value, x.values.dtype)
        out[ranges(at[:-1], x.sizes())] = x.values
        return Lists(at, out, t.gone if x.gone is None else x.gone if t.gone is None else t.gone | x.gone)

    whole = np.arange(k + 1) * max_len
    row = p.owner()
    inside = (p.values >= 0) & (p.values < max_len)
    flat, number = row * max_len + p.values, np.arange(len(row)) - p.at[row]
    has = inside & (number < own.sizes()[row])
    lab, loss = np.full(k * max_len, ignore, own.values.dtype), np.zeros(k * max_len, np.int32)
    lab[flat[inside & ~has]] = none_of(lab.dtype)
    lab[flat[has][::-1]] = own.values[(own.at[row] + number)[has]][::-1]  # the first of equal places counts
    loss[flat[inside]] = 1
    return struct(text=longer(t, S.PAD).arrow(), types=longer(y, 0).arrow(), padding_mask=longer(Lists(t.at, np.ones(t.at[-1], np.int32), t.gone), 0).arrow(),
                  labels=Lists(whole, lab).arrow(), loss_mask=Lists(whole, loss).arrow())


def sentinel_samples(key: pa.Array, tokens: pa.Array, budget: pa.Array, seed: int, first_continuation: int, cuts: list[int], n_sentinels: int) -> pa.Array:
    t = Lists.of(tokens)
    cand, bounds = word_groups(t, first_continuation)
    row, g, hi = choose(bounds, seed, key, "t5", budget, cuts)
    k = len(key)
    n = np.bincount(row, minlength=k)
    if (n > n_sentinels).any():
        raise ValueError("more spans than sentinels")
    places, size = span_places(cand, bounds, row, g, hi)
    flat = t.at[places.owner()] + places.values
    first = np.cumsum(size) - size  # place of each run
    sentinel = S.SENTINEL_TOP - (np.arange(len(row)) - (np.cumsum(n) - n)[row])
    keep, new = np.ones(len(t.values), bool), t.values.copy()
    keep[flat] = False
    keep[flat[first]] = True
    new[flat[first]] = sentinel
    enc = Lists(np.concatenate([[0], np.cumsum(keep)])[t.at], new[keep], t.gone)
    dec = np.insert(t.values[flat], first, sentinel.astype(t.values.dtype))
    at = places.at + np.concatenate([[0], np.cumsum(n)])
    more = at + np.arange(k + 1)
    return struct(n_spans=pa.array(n.astype(np.int32)), encoder_input=enc.arrow(), decoder_input=Lists(more, np.insert(dec, at[:-1], S.BOS)).arrow(),
                  decoder_output=Lists(more, np.insert(dec, at[1:], S.EOD)).arrow())
