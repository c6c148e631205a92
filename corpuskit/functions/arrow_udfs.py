"""Arrow-batched Python helpers (pandas UDFs) for the few steps Spark has no expression for.

No ``from __future__ import annotations`` here: pandas UDF type hints must be
real types.
"""

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType


def _lcs(x, y) -> int:
    """Bit-parallel: bit j of ``row`` is 0 where the LCS of the prefixes grows at ``y[j]``."""
    if x is None or y is None or len(x) == 0 or len(y) == 0:
        return 0
    places: dict = {}
    for j, w in enumerate(y):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for w in x:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(y) - row.bit_count()


def _lcs_rows(x, y) -> list[int]:
    """Bit rows of the LCS table: bit j of row i is 0 where the LCS of ``x[:i]`` and ``y[:j + 1]`` is longer than of ``y[:j]``."""
    places: dict = {}
    for j, w in enumerate(y):
        places[w] = places.get(w, 0) | 1 << j
    row = full = (1 << len(y)) - 1
    rows = [row]
    for w in x:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)
    return rows


def _lcs_places(x, y) -> set[int]:
    """Places in ``x`` of one LCS with ``y``, found backwards: equal ends match, else the longer table entry is followed, up first if equal."""
    rows = _lcs_rows(x, y)

    def length(i, j):
        return j - (rows[i] & (1 << j) - 1).bit_count()

    out, i, j = set(), len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif length(i, j - 1) > length(i - 1, j):
            j -= 1
        else:
            i -= 1
    return out


def _lsum(pred, ref) -> float:
    """Summary-level ROUGE-L F1 of two lists of sentences."""
    pred, ref = [list(s) for s in pred if s is not None], [list(s) for s in ref if s is not None]
    left, there = Counter(w for s in pred for w in s), Counter(w for s in ref for w in s)
    n, m = sum(left.values()), sum(there.values())
    hits = 0
    for sentence in ref:
        for i in sorted(set().union(*(_lcs_places(sentence, p) for p in pred))) if pred else ():
            w = sentence[i]
            if left[w] > 0 and there[w] > 0:
                left[w] -= 1
                there[w] -= 1
                hits += 1
    return 2 * (hits / n) * (hits / m) / (hits / n + hits / m) if hits else 0.0


@F.pandas_udf(DoubleType())
def lsum_f1(pred: pd.Series, ref: pd.Series) -> pd.Series:
    """Summary-level ROUGE-L of two arrays of sentences (arrays of words), a pair per row."""
    return pd.Series([None if p is None or r is None else _lsum(p, r) for p, r in zip(pred, ref)], dtype="float64")


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence length of two word arrays, one pair per row."""
    return pd.Series([_lcs(x, y) for x, y in zip(a, b)], dtype="int32")


def _hashes(words) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)


def word_index(words: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, dict]:
    """Words by the order of their hashes, a few bytes a word: hashes, ids, words, and those whose hash is not their own."""
    h = np.concatenate([_hashes(words.slice(at, 100_000).to_pylist()) for at in range(0, len(words), 100_000)] or [np.zeros(0, np.uint64)])
    order = np.argsort(h, kind="stable")
    h, words, ids = h[order], words.take(pa.array(order)), ids.to_numpy(zero_copy_only=False).astype(np.int32)[order]
    second = np.flatnonzero(h[1:] == h[:-1]) + 1
    return h, ids, words, {words[int(i)].as_py(): int(ids[i]) for i in second}


def _word_ids(words: pa.Array, index, unk: int) -> pa.Array:
    h, ids, known, more = index
    coded = words.flatten().dictionary_encode()
    own = coded.dictionary.to_pylist()
    out = np.full(len(own), unk, np.int32)
    if len(own) and len(h):
        at = np.minimum(np.searchsorted(h, _hashes(own)), len(h) - 1)
        same = pc.equal(known.take(pa.array(at)), coded.dictionary).to_numpy(zero_copy_only=False)
        out[same] = ids[at[same]]
        if more:
            out = np.array([more.get(w, i) for w, i in zip(own, out.tolist())], dtype=np.int32)
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
    values = pa.array(out).take(coded.indices)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=words.is_null() if words.null_count else None)


def word_ids(index_bc, unk: int):
    """Array of words -> array of ids; ``index_bc`` is a broadcast ``word_index``.  Each distinct word of a batch is looked up once."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(words: pa.Array) -> pa.Array:
        return _word_ids(words, index_bc.value, unk)

    return ids


def line_ids(index_bc, unk: int):
    """Like ``word_ids``, of strings of words joined by one blank; an empty string has none."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(lines: pa.Array) -> pa.Array:
        words = pc.split_pattern(lines, " ")
        empty = pc.equal(lines, "")
        if pc.any(empty).as_py():
            words = pc.if_else(empty, pa.scalar([], words.type), words)
        return _word_ids(words, index_bc.value, unk)

    return ids


def id_words(words_bc, unk: str | None):
    """Array of ids -> array of words, ``unk`` for ids without one; ``words_bc`` are broadcast ids in order and their words."""

    @F.arrow_udf(ArrayType(StringType()))
    def words(tokens: pa.Array) -> pa.Array:
        ids, own = words_bc.value
        asked = pc.fill_null(tokens.flatten().cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(ids, asked), max(len(ids) - 1, 0))
        known = ids[at] == asked if len(ids) else np.zeros(len(asked), bool)
        values = own.take(pa.array(at, mask=~known)) if len(ids) else pa.nulls(len(asked), pa.string())
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        values = values if unk is None else pc.fill_null(values, unk)
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=tokens.is_null() if tokens.null_count else None)

    return words


CHUNK = 1 << 20  # bytes of text whose characters are laid out at once, a longer text is one chunk


def _plain_lines(texts: pa.Array, lower: np.ndarray, kind: np.ndarray, split: bool) -> pa.Array:
    """Of each text its sentences, with their words joined by one blank, over the code points of all texts at once."""
    n_chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    edges = np.concatenate([[0], np.cumsum(n_chars)])
    cp = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    cell = np.minimum(cp, len(kind) - 1)
    own, low = kind[cell], lower[cell]
    plain = np.diff(np.searchsorted(np.flatnonzero(own == OTHER), edges)) == 0
    first = np.zeros(len(cp) + 1, bool)  # of a sentence
    first[edges] = True
    if split:
        ends = np.flatnonzero(own[1:] == SPACE)
        first[ends[np.isin(cp[ends], [ord(c) for c in ".!?"])] + 1] = True
    begins = own == MARK
    begins[1:] |= own[1:] != own[:-1]
    begins |= first[:-1]
    kept = np.flatnonzero(own != SPACE)
    opens = np.unique(np.searchsorted(kept, np.flatnonzero(first[:-1])))  # one for sentences without words and the next
    opens = opens[opens < len(kept)]
    blank = begins[kept]
    blank[opens] = False
    blanks = np.flatnonzero(blank)
    out = np.insert(low[kept], blanks, ord(" "))
    data = out.tobytes().decode("utf-32-le").encode("utf-8")
    offsets = np.append(opens + np.searchsorted(blanks, opens), len(out))
    if len(data) > len(out):
        offsets += np.searchsorted(np.flatnonzero(out >= 0x80), offsets) + np.searchsorted(np.flatnonzero(out >= 0x800), offsets)
    lines = pa.StringArray.from_buffers(len(opens), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    lists = np.searchsorted(kept[opens], edges).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), lines, mask=pa.array(~plain))


WORD, SPACE, MARK, OTHER = range(4)  # kinds of characters: of a word, white space, a word by itself, and those of no plain text


def plain_lines(lower: np.ndarray, kind: np.ndarray, split: bool = True):
    """Text -> its sentences as strings of words joined by one blank; null for a text with a character of kind ``OTHER``.

    ``lower`` and ``kind`` are tables by code point, of which the last entry stands for all beyond.  Without ``split``
    a text is one sentence; sentences without words are left out.
    """

    @F.arrow_udf(ArrayType(StringType()))
    def lines(texts: pa.Array) -> pa.Array:
        own = pc.fill_null(texts.cast(pa.string()), "")
        size = np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts, out = [0], []
        while cuts[-1] < len(own):
            done = size[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(size, done + CHUNK, side="right"))))
            part = own.slice(cuts[-2], cuts[-1] - cuts[-2])
            out.append(_plain_lines(part, lower, kind, split))
        whole = pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))
        return pc.if_else(texts.is_null(), pa.scalar(None, whole.type), whole) if texts.null_count else whole

    return lines


def cut_word(word: str, known, longest: int, max_chars: int = 200, rest: int | None = None):
    """Longest known pieces of a word from left to right, or None if a place has none or the word is too long.

    ``longest`` bounds all pieces, ``rest`` those that continue a word, without their mark.
    """
    if len(word) > max_chars:
        return None
    out, s = [], 0
    while s < len(word):
        for e in range(min(len(word), s + (longest if s == 0 or rest is None else rest)), s, -1):
            piece = word[s:e] if s == 0 else "##" + word[s:e]
            if piece in known:
                out.append(piece)
                s = e
                break
        else:
            return None
    return out


def piece_arrays(pieces_bc, longest: int, unk: str):
    """Word -> its pieces; ``pieces_bc`` is a broadcast dictionary of pieces."""

    @F.pandas_udf(ArrayType(StringType()))
    def pieces(words: pd.Series) -> pd.Series:
        known = pieces_bc.value
        cut = [None if w is None else cut_word(w, known, longest) if w else [] for w in words]
        return pd.Series([[unk] if c is None and w is not None else c for c, w in zip(cut, words)], dtype=object)

    return pieces


MEMO = 500_000


def line_piece_ids(ids_bc, longest: int, unk: int):
    """String of words joined by one blank -> array of the ids of all their pieces; words seen before are looked up."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, memo = ids_bc.value, {}
        rest = max((len(p) - 2 for p in known if p.startswith("##")), default=0)
        for lines in batches:
            if len(memo) > MEMO:
                memo = {}
            words = pc.split_pattern(lines, " ")
            coded = words.flatten().dictionary_encode()
            own = []
            for w in coded.dictionary.to_pylist():
                ids = memo.get(w)
                if ids is None:
                    cut = cut_word(w, known, longest, rest=rest)
                    ids = memo[w] = [unk] if cut is None else [known[p] for p in cut]
                own.append(ids)
            at, size = coded.indices.to_numpy(zero_copy_only=False), np.array([len(x) for x in own], np.int64)
            flat, first = np.array([i for x in own for i in x], np.int32), np.cumsum(size) - size
            ends = np.concatenate([[0], np.cumsum(size[at])])
            each = np.arange(ends[-1]) + np.repeat(first[at] - ends[:-1], size[at])
            offsets = ends[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))])]
            yield pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[each]))

    return encode


def _bytes_to_unicode():
    """Byte -> printable character map of byte-level BPE, built by rule: printable
    Latin-1 bytes map to themselves, the other 68 bytes to code points from 256 up."""
    keep = list(range(ord("!"), ord("~") + 1)) + list(range(0xA1, 0xAC + 1)) + list(range(0xAE, 0xFF + 1))
    out, extra = {}, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


_BYTE_MAP = _bytes_to_unicode()


@F.pandas_udf(StringType())
def byte_map(pieces: pd.Series) -> pd.Series:
    """UTF-8 bytes of each piece as byte-level BPE characters."""
    return pieces.apply(lambda s: None if s is None else "".join(_BYTE_MAP[b] for b in s.encode("utf-8")))


def _by_rank(piece: str, ranks: dict) -> list:
    """Symbols of a piece: the pair of the lowest rank is merged, left to right, until none has one."""
    syms = list(piece)
    while len(syms) > 1:
        best = min(zip(syms, syms[1:]), key=lambda pair: ranks.get(pair, float("inf")))
        if best not in ranks:
            break
        out, i = [], 0
        while i < len(syms):
            if tuple(syms[i : i + 2]) == best:
                out.append(best[0] + best[1])
                i += 2
            else:
                out.append(syms[i])
                i += 1
        syms = out
    return syms


def _bpe(piece, left, right):
    """Symbols by merges listed in rank order."""
    return _by_rank(piece, {pair: r for r, pair in reversed(list(enumerate(zip(left, right))))} if left is not None else {})


@F.pandas_udf(ArrayType(StringType()))
def bpe_apply(pieces: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
    """Symbols of each piece by its own list of merges in rank order."""
    return pd.Series([None if p is None else _bpe(p, l, r) for p, l, r in zip(pieces, left, right)], dtype=object)


def text_piece_ids(ranks_bc, ids_bc, unk: int):
    """Array of raw pieces -> ids of all their symbols by broadcast ``(left, right) -> rank`` and ``token -> id``.

    A piece that is itself a whole token of ``ids_bc["whole"]`` (a user symbol) stays one id.
    """

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks, ids, memo = ranks_bc.value, ids_bc.value["ids"], dict(ids_bc.value["whole"])
        for batch in batches:
            if len(memo) > MEMO:
                memo = dict(ids_bc.value["whole"])
            out = []
            for pieces in batch:
                own = []
                for p in pieces if pieces is not None else ():
                    known = memo.get(p)
                    if known is None:
                        syms = _by_rank("".join(_BYTE_MAP[b] for b in p.encode("utf-8")), ranks)
                        known = memo[p] = [ids.get(t, unk) for t in syms]
                    own += known
                out.append(own)
            yield pd.Series(out, dtype=object)

    return encode


def _intact(content) -> bool:
    reader = zlib.decompressobj(31)
    try:
        for at in range(0, len(content), 1 << 20):
            reader.decompress(content[at : at + (1 << 20)])
    except zlib.error:
        return False
    return reader.eof


@F.pandas_udf(BooleanType())
def gzip_intact(contents: pd.Series) -> pd.Series:
    """Whether each gzip file unpacks to its end."""
    return contents.map(lambda c: c is not None and _intact(c))
