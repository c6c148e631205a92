"""Subword vocabularies: byte-level BPE training (C10, C12) and encoding.

Training re-aims the reference's single-machine trainer.  Distinct pieces are held in
shards of flat symbol arrays with their piece and its count.  A round merges up to
``per_round`` of the most frequent adjacent pairs that share no symbol, in one pass over
the arrays of every shard; a shard answers with the *changes* of the pair counts in the
pieces it touched, so the pair table is its last state plus small deltas and is never
counted anew.  Both are compacted every few rounds.

User symbols are cut out of the text before anything else and stay one token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.arrow_udfs import _BYTE_MAP, bpe_apply, byte_map, text_piece_ids
from corpuskit.session import written

# Fixed value: the byte-level pre-split pattern (contractions, letters, numbers, other, spaces).
PRESPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RESERVED = ("<pad>", "</s>", "<unk>")

#: Rounds after which shards and pair counts are written anew.
COMPACT = 16
STATE = "sym binary, piece binary, n binary"
PAIRS = "a int, b int, n bigint"


def pre_split(text: str | Column, user_symbols: tuple[str, ...] = ()) -> Column:
    """Pieces of a text in order; a user symbol is a piece (of several that fit, the longest)."""
    c = F.col(text) if isinstance(text, str) else text

    def cut(s):
        return F.regexp_extract_all(s, F.lit(PRESPLIT), 0)

    if not user_symbols:
        return cut(c)
    symbol = "|".join(re.sub(r"([^\w\s])", r"\\\1", s) for s in sorted(user_symbols, key=len, reverse=True))
    found = F.regexp_extract_all(c, F.lit(symbol), 0)
    between = F.split(c, symbol, -1)
    return F.flatten(F.transform(between, lambda s, i: F.when(i < F.size(found), F.concat(cut(s), F.array(F.get(found, i)))).otherwise(cut(s))))


def piece_counts(docs: DataFrame, text: str = "text", user_symbols: tuple[str, ...] = ()) -> DataFrame:
    """``(piece, n)``: byte-mapped pieces that are no user symbols; only *distinct* pieces meet Python."""
    p = docs.select(F.explode(pre_split(text, user_symbols)).alias("piece"))
    if user_symbols:
        p = p.filter(~F.col("piece").isin(*user_symbols))
    c = p.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    return c.select(byte_map("piece").alias("piece"), "n")


# --- training ----------------------------------------------------------------

def _byte_codes() -> np.ndarray:
    codes = np.zeros(512, np.int32)
    for b, ch in _BYTE_MAP.items() if isinstance(_BYTE_MAP, dict) else enumerate(_BYTE_MAP):
        codes[ord(ch)] = b
    return codes


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flat arrays of the pieces of a batch: symbols (bytes first), number of the piece, its count."""
    codes = _byte_codes()
    for batch in batches:
        pieces = [np.frombuffer(p.encode("utf-32-le"), dtype="<u4") for p in batch["piece"].to_pylist() if p]
        if pieces:
            n = np.array([x for x, p in zip(batch["n"].to_pylist(), batch["piece"].to_pylist()) if p], dtype="<i8")
            owner = np.repeat(np.arange(len(pieces), dtype="<i4"), [len(p) for p in pieces])
            yield _state(codes[np.concatenate(pieces)].astype("<i4"), owner, n)


def _state(sym: np.ndarray, owner: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"sym": [sym.tobytes()], "piece": [owner.tobytes()], "n": [n.tobytes()]})


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for s, p, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
        yield np.frombuffer(s, "<i4"), np.frombuffer(p, "<i4"), np.frombuffer(n, "<i8")


def _pair_sums(sym: np.ndarray, owner: np.ndarray, n: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    inside = np.flatnonzero(owner[:-1] == owner[1:])
    return sym[inside].astype(np.int64) << 32 | sym[inside + 1], sign * n[owner[inside]]


def _summed(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    distinct, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, values)
    some = total != 0
    return pa.RecordBatch.from_pydict({"a": pa.array((distinct[some] >> 32).astype(np.int32)), "b": pa.array((distinct[some] & 0xFFFFFFFF).astype(np.int32)), "n": pa.array(total[some])})


def _merged(sym: np.ndarray, owner: np.ndarray, pairs: list[tuple[int, int]], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every pair of a round merged, left to right; pairs share no symbol.  Also the pieces that changed."""
    size = first + len(pairs)
    left, right = np.full(size, -1, np.int32), np.full(size, -2, np.int32)
    for k, (a, b) in enumerate(pairs):
        left[a], right[b] = k, k
    hit = np.flatnonzero((left[sym[:-1]] == right[sym[1:]]) & (owner[:-1] == owner[1:])) if len(sym) > 1 else np.zeros(0, np.int64)
    if len(hit) > 1:  # of a run a a a, whose hits touch, every other one counts
        run = np.concatenate([[0], np.cumsum(np.diff(hit) != 1)])
        start = hit[np.searchsorted(run, run)]
        hit = hit[(hit - start) % 2 == 0]
    out = sym.copy()
    out[hit] = first + left[sym[hit]]
    keep = np.ones(len(sym), bool)
    keep[hit + 1] = False
    return out[keep], owner[keep], np.unique(owner[hit])


def train_bpe(counts: DataFrame, n_merges: int, per_round: int = 32) -> DataFrame:
    """Merges ``(rank, left, right)`` of ``(piece, n)``.

    Each round looks at the ``4 * per_round`` most frequent pairs (ties by symbol: bytes, then
    merges by rank) and takes up to ``per_round`` that share no symbol, the most frequent first.
    """
    spark = counts.sparkSession
    state = written(counts.select("piece", "n").mapInArrow(_shards, STATE), "bpe-shards")

    def all_pairs(batches):
        for batch in batches:
            for sym, owner, n in _arrays(batch):
                yield _summed(*_pair_sums(sym, owner, n, 1))

    def total(parts: list[DataFrame]) -> DataFrame:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 0")

    parts = [written(total([state.mapInArrow(all_pairs, PAIRS)]), "bpe-pairs")]
    merges: list[tuple[int, int]] = []
    rounds: list[tuple[list[tuple[int, int]], int]] = []  # since the shards were written
    while len(merges) < n_merges:
        top = total(parts).orderBy(F.col("n").desc(), "a", "b").limit(per_round * 4).collect()
        chosen = independent([(r["a"], r["b"]) for r in top], min(per_round, n_merges - len(merges)))
        if not chosen:
            break
        rounds.append((chosen, 256 + len(merges)))
        merges += chosen
        parts.append(written(total_deltas(state, rounds), "bpe-deltas"))
        if len(rounds) == COMPACT:
            state = written(state.mapInArrow(_replay(list(rounds)), STATE), "bpe-shards")
            parts, rounds = [written(total(parts), "bpe-pairs")], []
    names = [_BYTE_MAP[b] for b in range(256)]
    rows = []
    for rank, (a, b) in enumerate(merges):
        rows.append((rank, names[a], names[b]))
        names.append(names[a] + names[b])
    return spark.createDataFrame(rows, "rank int, left string, right string")


def independent(pairs: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The first pairs that share no symbol, up to ``most``."""
    used: set[int] = set()
    chosen = []
    for a, b in pairs:
        if len(chosen) < most and a not in used and b not in used:
            chosen.append((a, b))
            used |= {a, b}
    return chosen


def _replay(rounds):
    def apply(batches):
        for batch in batches:
            for sym, owner, n in _arrays(batch):
                for pairs, first in rounds:
                    sym, owner, _ = _merged(sym, owner, pairs, first)
                yield _state(sym, owner, n)

    return apply


def total_deltas(state: DataFrame, rounds) -> DataFrame:
    """Changes of the pair counts by the last of ``rounds``, the others replayed first."""
    earlier, (pairs, first) = list(rounds[:-1]), rounds[-1]

    def deltas(batches):
        for batch in batches:
            for sym, owner, n in _arrays(batch):
                for p, f in earlier:
                    sym, owner, _ = _merged(sym, owner, p, f)
                after, after_owner, changed = _merged(sym, owner, pairs, first)
                before, now = np.isin(owner, changed), np.isin(after_owner, changed)
                old, new = _pair_sums(sym[before], owner[before], n, -1), _pair_sums(after[now], after_owner[now], n, 1)
                yield _summed(np.concatenate([old[0], new[0]]), np.concatenate([old[1], new[1]]))

    return state.mapInArrow(deltas, PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n <> 0")


# --- vocabulary and encoding -------------------------------------------------

def bpe_vocab(counts: DataFrame, merges: DataFrame, user_symbols: tuple[str, ...] = (), multiple: int = 1) -> DataFrame:
    """Vocabulary ``(token, id)``: reserved pad 0 / eos 1 / unk 2, user symbols, base
    characters, then merges in rank order; padded with dummy entries to a multiple (C12)."""
    spark = counts.sparkSession
    chars = counts.select(F.explode(F.split("piece", "")).alias("t")).filter(F.col("t") != "").distinct()
    base = [(t, 0, i) for i, t in enumerate(RESERVED)] + [(t, 1, i) for i, t in enumerate(user_symbols)]
    fixed = spark.createDataFrame(base, "t string, g int, o long")
    ch = chars.select("t", F.lit(2).alias("g"), F.lit(0).cast("long").alias("o"))
    mg = merges.groupBy(F.concat("left", "right").alias("t")).agg(F.lit(3).alias("g"), F.min("rank").cast("long").alias("o"))  # a token once, however it is made
    allv = fixed.unionByName(ch).unionByName(mg.select("t", "g", "o"))
    v = allv.withColumn("id", (F.row_number().over(Window.orderBy("g", "o", "t")) - 1).cast("int")).select(F.col("t").alias("token"), "id")
    return pad_vocab(v, multiple)


def pad_vocab(vocab: DataFrame, multiple: int) -> DataFrame:
    """Dummy entries behind ``(token, id)`` until the size divides ``multiple``."""
    n = vocab.count() if multiple > 1 else 0
    pad = (-n) % multiple
    if not pad:
        return vocab
    dummy = vocab.sparkSession.range(pad).select(F.concat(F.lit("<dummy_"), F.col("id").cast("string"), F.lit(">")).alias("token"), (F.col("id") + n).cast("int").alias("id"))
    return vocab.unionByName(dummy)


def piece_symbols(pieces: DataFrame, merges: DataFrame, piece: str = "piece") -> DataFrame:
    """Distinct byte-mapped pieces with ``syms``, merged lowest rank first until none applies.

    A merge can matter to a piece only if its token is a substring of it, so the substrings
    (no longer than the longest token) meet the merges in a join, and each piece gets the
    few ranks it needs; the merge table itself is never copied to every task.
    """
    made = merges.select(F.concat("left", "right").alias("token"), "left", "right", "rank")
    longest = made.agg(F.max(F.length("token"))).first()[0] or 1
    n = F.length(piece)
    at = pieces.filter(n > 1).select(piece, F.explode(F.sequence(F.lit(1), n - 1)).alias("_s"))
    sub = at.select(piece, F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(longest), n - F.col("_s") + 1))),
                                                 lambda m: F.col(piece).substr(F.col("_s"), m))).alias("token")).distinct()
    ranks = sub.join(made, "token").groupBy(piece).agg(F.sort_array(F.collect_list(F.struct("rank", "left", "right"))).alias("ranks"))
    return pieces.join(ranks, piece, "left").select(piece, bpe_apply(F.col(piece), F.col("ranks.left"), F.col("ranks.right")).alias("syms"))


#: Merges and tokens that are copied to every task as dictionaries; beyond, pieces meet them in joins.
BROADCAST_MERGES = 1_000_000


def bpe_encode(docs: DataFrame, merges: DataFrame, vocab: DataFrame, key: str = "doc_id", text: str = "text", user_symbols: tuple[str, ...] = ()) -> DataFrame:
    """``(key, ids)`` of every text with a piece; unknown id 0.

    With counted merges and tokens that a task can hold, texts are encoded where they lie, without a
    shuffle, and a piece seen before is looked up; else each *distinct* piece is merged once by joins.
    """
    if max(merges.count(), vocab.count()) > BROADCAST_MERGES:
        return _encode_by_joins(docs, merges, vocab, key, text, user_symbols)
    context = docs.sparkSession.sparkContext
    ids = {r["token"]: r["id"] for r in vocab.toLocalIterator()}
    ranks = context.broadcast({(r["left"], r["right"]): r["rank"] for r in merges.orderBy(F.col("rank").desc()).toLocalIterator()})
    known = context.broadcast({"ids": ids, "whole": {s: [ids.get(s, 0)] for s in user_symbols}})
    pieces = docs.select(key, pre_split(text, user_symbols).alias("pieces")).filter(F.size("pieces") > 0)
    return pieces.select(key, text_piece_ids(ranks, known, 0)("pieces").alias("ids"))


def _encode_by_joins(docs: DataFrame, merges: DataFrame, vocab: DataFrame, key: str, text: str, user_symbols: tuple[str, ...]) -> DataFrame:
    pieces = docs.select(key, F.posexplode(pre_split(text, user_symbols)).alias("pp", "raw"))
    distinct = written(pieces.select("raw").distinct().select("raw", byte_map("raw").alias("piece")), "bpe-pieces")
    symbol = F.col("raw").isin(*user_symbols) if user_symbols else F.lit(False)
    cut = piece_symbols(distinct.filter(~symbol).select("piece"), merges).select("piece", F.posexplode("syms").alias("sp", "token"))
    whole = distinct.filter(symbol).select("piece", F.lit(0).alias("sp"), F.col("raw").alias("token"))
    ids = cut.unionByName(whole).join(vocab, "token", "left").groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("sp", F.coalesce("id", F.lit(0)).alias("id")))).alias("_x"))
    coded = distinct.join(ids, "piece").select("raw", F.transform("_x", lambda s: s["id"]).alias("ids"))
    g = pieces.join(coded, "raw").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pp", "ids"))).alias("_x"))
    return g.select(key, F.flatten(F.transform("_x", lambda s: s["ids"])).alias("ids"))
