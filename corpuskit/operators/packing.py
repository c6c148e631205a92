"""Packing token streams and building sentence blocks.

* Packing (E1-E3) has a closed form: sample boundary ``i`` is global token
  ``i*S``.  A prefix sum of document sizes (two-level, no global window) gives
  every document its token range; each document then emits only the boundaries
  and fragments that fall inside it (``explode(sequence)``), so no join and no
  sequential walk is needed, and every sample is rebuilt from at most a few
  fragments.
* Sentence blocks (E4-E7) are a greedy walk over a document's sentences as ordered rows;
  only the open block is kept.  Targets are hash draws of (seed, epoch, document, block number).

No ``from __future__ import annotations`` here: UDF type hints must be real types.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.functions import hashing as H
from corpuskit.functions import prefix as P
from corpuskit.functions import specials as S

LONG_SENTENCE = 512


def doc_streams(tok: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token table -> one token array per document (sentences in order)."""
    g = tok.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sent_pos", "tokens"))).alias("_x"))
    return g.select(key, F.flatten(F.transform("_x", lambda s: s["tokens"])).alias("tokens"))


def dense_bucket(col: str, total: Column, n_buckets: int) -> Column:
    """Range bucket for a dense 0..N-1 position column."""
    width = F.greatest(F.ceil(total / F.lit(n_buckets)), F.lit(1))
    return F.floor(F.col(col) / width).cast("int")


def token_ranges(ordered: DataFrame, ord_col: str, size_col: str, n_buckets: int | None = None) -> DataFrame:
    """Adds ``start`` = tokens of all documents before this one in ``ord_col`` order, and ``_T`` = total."""
    nb = n_buckets or P.default_buckets(ordered.sparkSession)
    tot = ordered.agg(F.count(F.lit(1)).alias("_M"), F.sum(size_col).cast("bigint").alias("_T"))
    d = ordered.crossJoin(F.broadcast(tot))
    out = P.global_positions(d, [F.col(ord_col)], dense_bucket(ord_col, F.col("_M"), nb), rank_col=None,
                             sums={"start": F.col(size_col)})
    return out.drop("_M")


def pack_boundaries(ordered: DataFrame, ord_col: str, size_col: str, seq_len: int, n_buckets: int | None = None) -> DataFrame:
    """``(sample_id, doc_ord, offset)`` for boundaries 0..n, ``n = (T-1)//S``.

    Boundary i sits at global token ``i*S``: the document containing it and the
    offset inside.  Checked against the reference's walk in the golden tests.
    """
    r = token_ranges(ordered, ord_col, size_col, n_buckets).filter(F.col(size_col) > 0)
    S_ = F.lit(seq_len)
    a, b = F.col("start"), F.col("start") + F.col(size_col) - 1
    n = F.floor((F.col("_T") - 1) / S_)
    lo = F.ceil(a / S_)
    hi = F.least(F.floor(b / S_), n)
    e = r.select(ord_col, "start", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array())).alias("sample_id"))
    return e.select(F.col("sample_id").cast("bigint"), F.col(ord_col).alias("doc_ord"),
                    (F.col("sample_id") * S_ - F.col("start")).cast("int").alias("offset"))


def pack_samples(ordered: DataFrame, ord_col: str, tokens: str, seq_len: int, n_buckets: int | None = None) -> DataFrame:
    """``(sample_id, tokens)`` with S+1 tokens each, one shared with the next sample.

    Each document emits one fragment per sample it overlaps; fragments are
    regrouped by sample (one shuffle; each group holds S+1 tokens).
    """
    d = ordered.withColumn("_sz", F.size(tokens))
    r = token_ranges(d, ord_col, "_sz", n_buckets).filter(F.col("_sz") > 0)
    S_ = F.lit(seq_len)
    a, b = F.col("start"), F.col("start") + F.col("_sz") - 1
    n = F.floor((F.col("_T") - 1) / S_)
    lo = F.greatest(F.ceil((a - S_) / S_), F.lit(0))
    hi = F.least(F.floor(b / S_), n - 1)
    # fragments are sliced inside one expression, so each exploded row carries only
    # its own slice (never a copy of the whole document per fragment)
    st, sz = F.col("start"), F.col("_sz")

    def frag(i):
        i0 = F.greatest(i * S_, st)
        i1 = F.least(i * S_ + S_, st + sz - 1)
        return F.struct(i.alias("sample_id"), F.col(ord_col).alias("o"),
                        F.slice(tokens, (i0 - st + 1).cast("int"), (i1 - i0 + 1).cast("int")).alias("t"))

    rng = F.when(hi >= lo, F.sequence(lo.cast("bigint"), hi.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    e = r.select(F.explode(F.transform(rng, frag)).alias("_e"))
    f = e.select(F.col("_e.sample_id").alias("sample_id"), F.struct(F.col("_e.o").alias("o"), F.col("_e.t").alias("t")).alias("_f"))
    g = f.groupBy("sample_id").agg(F.array_sort(F.collect_list("_f")).alias("_x"))
    return g.select("sample_id", F.flatten(F.transform("_x", lambda s: s["t"])).alias("tokens"))


def packed_positions(samples: DataFrame, sample: str = "sample_id", tokens: str = "tokens", eod: int = S.EOD,
                     eod_mask_loss: bool = True) -> DataFrame:
    """E3 (long form): per token ``position_id`` and ``segment_id`` restarting *after* each EOD,
    and ``loss_mask`` 0 at EOD if asked.

    ``samples`` coming out of ``pack_samples`` are already hash-partitioned by
    sample id, so the window below adds no exchange.
    """
    e = samples.select(sample, F.posexplode(tokens).alias("pos", "token"))
    w = Window.partitionBy(sample).orderBy("pos")
    is_eod = (F.col("token") == eod).cast("int")
    e = e.withColumn("segment_id", F.coalesce(F.sum(is_eod).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    w2 = Window.partitionBy(sample, "segment_id").orderBy("pos")
    e = e.withColumn("position_id", (F.row_number().over(w2) - 1).cast("int"))
    mask = F.when(F.lit(eod_mask_loss) & (F.col("token") == eod), 0).otherwise(1)
    return e.withColumn("loss_mask", mask.cast("int"))


# --- sentence blocks ---------------------------------------------------------

def short_target(seed, epoch, key: Column, k: Column, max_len: int, short_prob: float) -> Column:
    """E5: with ``r = round(1/p)``: if ``u % r == 0`` the target is ``2 + u % (max-1)``, else max."""
    if short_prob <= 0:
        return F.lit(max_len)
    r = int(round(1.0 / short_prob))
    u = H.u(seed, F.lit(epoch), key, k)
    return F.when(u % r == 0, F.lit(2) + u % (max_len - 1)).otherwise(F.lit(max_len)).cast("int")


def _target(seed, epoch, key: str | None, k: int, max_len: int, short_prob: float) -> int:
    """``short_target`` of one block, inside a task."""
    if short_prob <= 0:
        return max_len
    parts = [str(seed), str(epoch), *([] if key is None else [key]), str(k)]
    u = int(hashlib.md5("|".join(parts).encode()).hexdigest()[:8], 16)
    return 2 + u % (max_len - 1) if u % int(round(1.0 / short_prob)) == 0 else max_len


def sentence_blocks(sents: DataFrame, key: str, max_len: int, min_sent: int, short_prob: float = 0.0, seed: int = 0,
                    epoch: int = 0, title_len: str | None = None, close_min_remaining: int = 1, long_sentence: int | None = LONG_SENTENCE) -> DataFrame:
    """E4 (and E7 with ``title_len``): greedy blocks per document over ``(key, sent_pos, n_tokens)`` rows.

    Close a block when ``len >= target`` and more than ``close_min_remaining``
    sentences remain and it has ``>= min_sent`` sentences, or at document end.
    Documents with fewer than ``min_sent`` sentences, or (if more than one sentence)
    any sentence longer than ``long_sentence`` tokens, give no block.
    Output ``(key, block, start_sent, end_sent, target)`` with ``[start, end)`` sentence ranges.

    Where a block ends depends on all before it (its number draws its target), so the rows of a
    document are read in order and only the open block is kept: memory does not grow with
    the document.
    """
    size = sents.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("n_tokens").alias("_most"))
    size = size.filter((F.col("_n") >= min_sent) & ((F.col("_n") == 1) | F.lit(long_sentence is None) | (F.col("_most") <= (long_sentence or 0))))
    taken = F.lit(0) if title_len is None else F.col(title_len) + 3
    rows = sents.join(size.select(F.col(key).alias("_key"), "_n"), F.col(key).eqNullSafe(F.col("_key")))
    rows = rows.select(F.col(key).cast("string").alias("key"), "sent_pos", "n_tokens", "_n", taken.alias("taken"))

    def walk(batches):
        at, k, i, start, seq, target = (), 0, 0, 0, 0, 0
        for pdf in batches:
            done = []
            for own, tokens, n, less in zip(pdf["key"], pdf["n_tokens"], pdf["_n"], pdf["taken"]):
                if (own,) != at:
                    at, k, i, start, seq = (own,), 0, 0, 0, 0
                    target = _target(seed, epoch, own, 0, max_len, short_prob) - less
                seq, i = seq + tokens, i + 1
                if (seq >= target and n - i > close_min_remaining and i - start >= min_sent) or i == n:
                    done.append((own, k, start, i, target))
                    k, start, seq = k + 1, i, 0
                    target = _target(seed, epoch, own, k, max_len, short_prob) - less
            yield pd.DataFrame(done, columns=["key", "block", "start_sent", "end_sent", "target"])

    ordered = rows.repartition("key").sortWithinPartitions("key", "sent_pos").select("key", "n_tokens", "_n", "taken")
    out = ordered.mapInPandas(walk, "key string, block int, start_sent int, end_sent int, target int")
    return out.select(F.col("key").cast(sents.schema[key].dataType).alias(key), "block", "start_sent", "end_sent", "target")


def block_sentences(blocks: DataFrame, tok: DataFrame, key: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """Token arrays of the sentences of every block (``[start_sent, end_sent)``, apart from each other), with the columns ``more`` of the block.

    Starts of blocks are read among the sentences of their document in order, so
    token arrays are shuffled once, by document, and not joined sentence by sentence.
    """
    own = F.struct("block", "end_sent", *more).alias("_b")
    starts = blocks.filter(F.col(key).isNotNull()).select(key, F.col("start_sent").cast("bigint").alias("sent_pos"), F.lit(0).alias("_k"), own)
    rows = tok.filter(F.col(key).isNotNull()).select(key, F.col("sent_pos").cast("bigint").alias("sent_pos"), F.lit(1).alias("_k"), "tokens")
    both = rows.unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("sent_pos", "_k").rowsBetween(Window.unboundedPreceding, 0)
    j = both.withColumn("_b", F.last("_b", ignorenulls=True).over(w)).filter((F.col("_k") == 1) & (F.col("sent_pos") < F.col("_b.end_sent")))
    cols = ["block", *more]
    g = j.groupBy(key, *[F.col(f"_b.{c}").alias(c) for c in cols]).agg(F.array_sort(F.collect_list(F.struct("sent_pos", "tokens"))).alias("_x"))
    return g.select(key, "block", F.transform("_x", lambda s: s["tokens"]).alias("sents"), *more)


def epoch_limit(per_epoch: DataFrame, max_samples: int, spark=None) -> DataFrame:
    """Repeat epochs until ``max_samples`` is reached, tested at epoch start only.

    ``per_epoch`` is the one-epoch sample table; epochs needed =
    ``ceil(max_samples / samples_per_epoch)`` (one aggregate row), replicated by
    a cross join with that many epoch ids.
    """
    cnt = per_epoch.agg(F.count(F.lit(1)).alias("_c"))
    e = cnt.select(F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.lit(max_samples) / F.col("_c")) - 1, F.lit(0)))).alias("epoch"))
    return per_epoch.crossJoin(F.broadcast(e)).withColumn("epoch", F.col("epoch").cast("int"))


def segment_pair(blocks: DataFrame, seed: int, key: Column, sents: str = "sents") -> DataFrame:
    """Split a block of n >= 2 sentences at ``a_end`` in [1, n-1]; swap A/B with p = .5.

    ``is_random`` = swapped (sentence order, not a random next sentence).
    """
    n = F.size(sents)
    a_end = F.lit(1) + H.u(seed, key, F.lit("a_end")) % F.greatest(n - 1, F.lit(1))
    swap = H.u(seed, key, F.lit("swap")) % 2 == 1
    a = F.flatten(F.slice(sents, 1, a_end.cast("int")))
    b = F.flatten(F.slice(sents, (a_end + 1).cast("int"), (n - a_end).cast("int")))
    return blocks.filter(n >= 2).withColumn("_a", a).withColumn("_b", b).select(
        "*", F.when(swap, F.col("_b")).otherwise(F.col("_a")).alias("tokens_a"),
        F.when(swap, F.col("_a")).otherwise(F.col("_b")).alias("tokens_b"), swap.alias("is_random")).drop("_a", "_b")


def truncated_lengths(la: Column, lb: Column, max_len: int | Column):
    """E9 final lengths (RNG-free): remove from the longer side, ties from B; ``max_len`` may be a block's target."""
    total = la + lb
    excess = total - max_len
    diff = F.abs(la - lb)
    m = max_len if isinstance(max_len, Column) else F.lit(max_len)
    fa = F.when(excess <= 0, la).when(diff >= excess, F.when(la > lb, la - excess).otherwise(la)).otherwise(F.ceil(m / 2))
    fb = F.when(excess <= 0, lb).when(diff >= excess, F.when(la > lb, lb).otherwise(lb - excess)).otherwise(F.floor(m / 2))
    return fa.cast("int"), fb.cast("int")


def _front_cuts(seed):
    """Tokens removed from the fronts of A and B: one fair hash coin per removed token (binomial)."""
    @F.arrow_udf(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
    def cuts(key: pa.Array, removed_a: pa.Array, removed_b: pa.Array) -> pa.Array:
        def side(name, removed):
            n = np.maximum(pc.fill_null(removed, 0).to_numpy(zero_copy_only=False), 0)
            row = np.repeat(np.arange(len(n)), n)
            coins = H.draws(H.heads(seed, key, name), row, 1 + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) % np.uint64(2)
            return pa.array(np.bincount(row, weights=coins, minlength=len(n)).astype(np.int32))

        return pa.StructArray.from_arrays([side("a", removed_a), side("b", removed_b)], ["a", "b"])

    return cuts


def truncate_pair(df: DataFrame, seed: int, key: Column, max_len: int | Column, a: str = "tokens_a", b: str = "tokens_b") -> DataFrame:
    """Truncate A/B to ``max_len`` together; each removal from front or back with p = .5."""
    la, lb = F.size(a), F.size(b)
    fa, fb = truncated_lengths(la, lb, max_len)
    d = df.withColumn("_cut", _front_cuts(seed)(key.cast("string"), la - fa, lb - fb))
    return d.withColumns({a: F.slice(a, F.col("_cut.a") + 1, fa), b: F.slice(b, F.col("_cut.b") + 1, fb)}).drop("_cut")


def tokens_and_types(df: DataFrame, a: str = "tokens_a", b: str = "tokens_b") -> DataFrame:
    """``[CLS] A [SEP] (B [SEP])`` and token types 0 / 1."""
    cls, sep = F.array(F.lit(S.CLS)), F.array(F.lit(S.SEP))
    has_b = F.size(b) > 0
    toks = F.when(has_b, F.concat(cls, F.col(a), sep, F.col(b), sep)).otherwise(F.concat(cls, F.col(a), sep))
    types = F.when(has_b, F.concat(F.array_repeat(F.lit(0), F.size(a) + 2), F.array_repeat(F.lit(1), F.size(b) + 1))) \
        .otherwise(F.array_repeat(F.lit(0), F.size(a) + 2))
    return df.withColumn("tokens", toks).withColumn("tokentypes", types)
