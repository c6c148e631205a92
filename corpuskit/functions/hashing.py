"""Hash-based randomness.

The reference draws from sequential generators seeded once; a shared stream
cannot be reproduced in parallel.  Every random choice here is a pure function
of ``(seed, key...)``::

    u(seed, k1, k2, ...) = first 8 hex digits of md5('seed|k1|k2|...') as BIGINT

uniform in [0, 2^32).  Results are deterministic and independent of
partitioning; they follow the reference's distributions but are never
bit-equal to its streams.  ``sql_u`` renders the same function for DuckDB so
oracles can reproduce every draw.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def u(seed, *keys) -> Column:
    """BIGINT in [0, 2^32), a pure function of the seed and keys."""
    parts = [F.lit(str(seed))] + [_col(k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def unit(seed, *keys) -> Column:
    """DOUBLE uniform in [0, 1)."""
    return u(seed, *keys) / F.lit(TWO32)


def sql_u(seed, *exprs: str) -> str:
    """DuckDB text of ``u`` (exprs are SQL expressions)."""
    parts = ", ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8)) AS BIGINT)"


def sql_unit(seed, *exprs: str) -> str:
    return f"({sql_u(seed, *exprs)} / 4294967296.0)"


# --- the same draws in a task -------------------------------------------------

_SHIFTS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_AT_ONCE = 32768  # messages whose scratch arrays stay in a core's cache


def _first_words(words: list) -> np.ndarray:
    """First word of the MD5 of one block per column; ``words`` are its 16 words, None where all are 0."""
    a, b, c, d = (np.full(len(words[14]), x, np.uint32) for x in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn, k = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        if words[k] is not None:
            f += words[k]
        s = _SHIFTS[turn][i % 4]
        np.right_shift(f, np.uint32(32 - s), out=t)
        f <<= np.uint32(s)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return a + _START[0]


def heads(seed, key, *salts: str) -> list[bytes]:
    """What ``u(seed, key, *salts, number)`` hashes before its number, per element of an Arrow array of keys; a null key is left out, as ``concat_ws`` does."""
    return [("|".join([str(seed), *([] if x is None else [x]), *salts]) + "|").encode("utf-8", "surrogatepass") for x in key.to_pylist()]


def draw(head: bytes, number: int) -> int:
    """One of ``draws``."""
    return int.from_bytes(hashlib.md5(head + b"%d" % number).digest()[:4], "big")


def draws(heads: list[bytes], owner: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """``u`` of each number from 0 on in decimal after the head ``heads[owner]``, as uint64; a head holds seed and keys and ends in ``|``.

    MD5 over arrays, a message a column; messages that do not fit one block are hashed one by one.
    """
    numbers, owner = np.asarray(numbers, np.int64), np.asarray(owner, np.int64)
    size = np.array([len(h) for h in heads], np.int64)
    digits = 1 + np.searchsorted(10 ** np.arange(1, 18), numbers, side="right")
    out = np.zeros(len(numbers), np.uint64)
    long = size[owner] + digits > 55 if len(heads) else np.zeros(0, bool)
    for i in np.flatnonzero(long):
        out[i] = draw(heads[owner[i]], numbers[i])
    block = np.frombuffer(b"".join(h[:64].ljust(64, b"\0") for h in heads), np.uint8).reshape(-1, 64)
    short = np.flatnonzero(~long)
    for lo in range(0, len(short), _AT_ONCE):
        at = short[lo : lo + _AT_ONCE]
        own, k, x = owner[at], digits[at], numbers[at]
        n, row = size[own], np.arange(len(at))
        m = block[own, : (int((n + k).max()) // 4 + 1) * 4]  # whole words that hold the messages and their end mark
        for j in range(int(k.max())):  # the last digit first
            some = k > j
            m[row[some], (n + k - 1 - j)[some]] = 48 + x[some] % 10
            x = x // 10
        m[row, n + k] = 0x80
        words = list(np.ascontiguousarray(m.view("<u4").T))
        words += [None] * (14 - len(words)) + [(8 * (n + k)).astype(np.uint32), None]
        out[at] = _first_words(words).byteswap()
    return out
