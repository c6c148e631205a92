"""Training objectives as data transforms (F9-F25; masking is in ``masking``).

Noise masks and their conversions run on columns ``(keys, pos, token, noise)``, in
*long form* (one row per token) or, where no window is needed, with arrays of them
(one row per example: nothing is exploded, sorted and regrouped).  Runs of noise
are gaps-and-islands (``lag`` and a running sum over a window partitioned by
example; examples are small groups), and results are regrouped with an ordered
``collect_list``.  Masks are hash draws
``u(seed, keys, pos)``, never a generator stream.  Items marked [spec] follow the
T5 paper's definitions (the reference only names them).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from corpuskit.functions import hashing as H
from corpuskit.functions import specials as S


def explode_tokens(df: DataFrame, keys: list[str], tokens: str = "tokens", arrays: bool = False) -> DataFrame:
    """``(keys, pos, token, n)``: one row per token, ``n`` = example length; with ``arrays`` one row per example, ``pos`` and ``token`` as arrays."""
    if arrays:
        return df.filter(F.size(tokens) > 0).select(*keys, F.size(tokens).alias("n"), F.transform(tokens, lambda t, i: i).alias("pos"), F.col(tokens).alias("token"))
    return df.select(*keys, F.size(tokens).alias("n"), F.posexplode(tokens).alias("pos", "token"))


def _in_arrays(df: DataFrame) -> bool:
    return isinstance(df.schema["pos"].dataType, ArrayType)


def noise_iid(long: DataFrame, keys: list[str], density: float, seed: int) -> DataFrame:
    """F13 [spec]: each token is noise with probability ``density``."""
    if _in_arrays(long):
        return long.withColumn("noise", F.transform("pos", lambda p: H.u(seed, *keys, p) < F.lit(density * H.TWO32)))
    return long.withColumn("noise", H.u(seed, *keys, "pos") < F.lit(density * H.TWO32))


def noise_regular(long: DataFrame, keys: list[str], min_span: int, max_span: int, density: float, seed: int) -> DataFrame:
    """F15 [spec]: evenly spaced spans; their length is drawn per example from [min, max], the period is
    ``round(span / density)`` and the spans start at a drawn offset."""
    span = F.lit(min_span) + H.u(seed, *keys, F.lit("span")) % F.lit(max_span - min_span + 1)
    d = long.withColumn("_l", span).withColumn("_p", F.greatest(F.col("_l"), F.round(F.col("_l") / F.lit(density)).cast("bigint")))
    shifted = (F.col("pos") + H.u(seed, *keys, F.lit("offset")) % F.col("_p")) % F.col("_p")
    return d.withColumn("noise", shifted < F.col("_l")).drop("_l", "_p")


def noise_prefix(long: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """F16 [spec]: a random cut in [1, n-1]; the suffix is noise (inputs = prefix, targets = suffix)."""
    cut = F.lit(1) + H.u(seed, *keys) % F.greatest(F.col("n") - 1, F.lit(1))
    return long.withColumn("noise", F.col("pos") >= cut)


def _segment(total: Column, parts: Column, seed, key: Column, side: str) -> Column:
    """Cut ``total`` into ``parts`` non-empty lengths at hash-ranked cut points (no nested re-evaluation)."""
    slots = F.transform(F.sequence(F.lit(1), F.greatest(total - 1, F.lit(1))),
                        lambda i: F.struct(H.u(seed, key, F.lit(side), i).alias("h"), i.alias("i")))
    cuts = F.array_sort(F.transform(F.slice(F.array_sort(slots), 1, parts - 1), lambda s: s["i"]))
    bounds = F.concat(F.array(F.lit(0)), F.when(total > 1, cuts).otherwise(F.array().cast("array<int>")), F.array(total))
    return F.zip_with(F.slice(bounds, 2, parts), F.slice(bounds, 1, parts), lambda x, y: x - y)


def noise_random_spans(df: DataFrame, keys: list[str], density: float, mean_span: float, seed: int, tokens: str = "tokens") -> DataFrame:
    """F14 [spec]: ``round(n*density)`` noise tokens in ``round(noise/mean)`` spans that
    alternate with as many non-noise spans (non-noise first); each side's total is cut
    into that many non-empty parts at hash-ranked cut points.  Adds the boolean mask
    array ``noise``.  Intermediate arrays are separate columns, so no lambda
    re-evaluates another array per element.
    """
    key = F.concat_ws(":", *keys)
    n = F.size(tokens)
    d = df.withColumn("_n", n).withColumn("_nn", F.least(F.greatest(F.bround(F.col("_n") * density, 0), F.lit(1)), F.col("_n") - 1).cast("int"))
    d = d.withColumn("_ns", F.least(F.greatest(F.bround(F.col("_nn") / mean_span, 0), F.lit(1)).cast("int"),
                                    F.least(F.col("_nn"), F.col("_n") - F.col("_nn"))))
    d = d.withColumn("_k", _segment(F.col("_n") - F.col("_nn"), F.col("_ns"), seed, key, "keep"))
    d = d.withColumn("_z", _segment(F.col("_nn"), F.col("_ns"), seed, key, "noise"))
    lens = F.flatten(F.zip_with("_k", "_z", lambda a, b: F.array(a, b)))
    mask = F.flatten(F.transform(lens, lambda L, j: F.array_repeat(j % 2 == 1, L)))
    d = d.withColumn("noise", F.when(F.col("_n") >= 2, mask).otherwise(F.array_repeat(F.lit(False), F.col("_n"))))
    return d.drop("_n", "_nn", "_ns", "_k", "_z")


def mark_spans(long: DataFrame, keys: list[str], flag: str = "noise") -> DataFrame:
    """Gaps and islands: ``start`` of each run of ``flag`` and its 0-based ``span`` index."""
    w = Window.partitionBy(*keys).orderBy("pos")
    d = long.withColumn("start", F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False)))
    return d.withColumn("span", F.sum(F.col("start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def _regroup(long: DataFrame, keys: list[str], value: Column, keep: Column, out: str) -> DataFrame:
    item = F.when(keep, F.struct(F.col("pos").alias("p"), value.alias("v")))
    g = long.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_x"))
    return g.select(*keys, F.transform("_x", lambda s: s["v"]).alias(out))


def _examples(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, _x)``: the tokens of an example in order, as structs of pos, token and noise; only long form is regrouped."""
    cols = ("pos", "token", "noise")
    if _in_arrays(df):
        return df.select(*keys, F.arrays_zip(*cols).alias("_x"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("_x"))


def _each(value: Callable[[Column], Column], out: str) -> Column:
    return F.transform("_x", value).alias(out)


def spans_to_sentinels(long: DataFrame, keys: list[str]) -> DataFrame:
    """F17 [spec]: inputs: each noise run -> one unique sentinel; targets: each non-noise run
    -> one sentinel, noise kept (the inverted mask).  One window pass and one regroup
    produce both sides."""
    w = Window.partitionBy(*keys).orderBy("pos")
    prev = F.lag("noise").over(w)
    d = long.withColumn("_st", F.col("noise") & ~F.coalesce(prev, F.lit(False))) \
        .withColumn("_st2", ~F.col("noise") & F.coalesce(prev, F.lit(True)))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_sp", F.sum(F.col("_st").cast("int")).over(run) - 1) \
        .withColumn("_sp2", F.sum(F.col("_st2").cast("int")).over(run) - 1)
    top = F.lit(S.SENTINEL_TOP)
    vin = F.when(F.col("noise"), top - F.col("_sp")).otherwise(F.col("token"))
    vout = F.when(~F.col("noise"), top - F.col("_sp2")).otherwise(F.col("token"))
    item_in = F.when(~F.col("noise") | F.col("_st"), F.struct(F.col("pos").alias("p"), vin.alias("v")))
    item_out = F.when(F.col("noise") | F.col("_st2"), F.struct(F.col("pos").alias("p"), vout.alias("v")))
    g = d.groupBy(*keys).agg(F.array_sort(F.collect_list(item_in)).alias("_i"), F.array_sort(F.collect_list(item_out)).alias("_o"))
    return g.select(*keys, F.transform("_i", lambda x: x["v"]).alias("inputs"), F.transform("_o", lambda x: x["v"]).alias("targets"))


def tokens_to_sentinel(long: DataFrame, keys: list[str]) -> DataFrame:
    """F18 [spec]: every noise token -> the same sentinel; targets = the original tokens."""
    inputs = _each(lambda x: F.when(x["noise"], F.lit(S.SENTINEL_TOP)).otherwise(x["token"]), "inputs")
    return _examples(long, keys).select(*keys, inputs, _each(lambda x: x["token"], "targets"))


def tokens_to_random_or_sentinel(long: DataFrame, keys: list[str], seed: int, vocab_size: int, p_random: float = 0.1) -> DataFrame:
    """F19 [spec]: noise token -> a random id in [FIRST_WORD_ID, vocab_size) with p = .1, else the sentinel."""
    def new(x):
        u1 = H.u(seed, *keys, x["pos"], F.lit("r"))
        u2 = H.u(seed, *keys, x["pos"], F.lit("id"))
        rnd = (F.lit(S.FIRST_WORD_ID) + u2 % F.lit(max(1, vocab_size - S.FIRST_WORD_ID))).cast("int")
        return F.when(x["noise"] & (u1 < F.lit(p_random * H.TWO32)), rnd).when(x["noise"], F.lit(S.SENTINEL_TOP)).otherwise(x["token"])

    return _examples(long, keys).select(*keys, _each(new, "inputs"))


def drop_noise(long: DataFrame, keys: list[str], drop: str = "noise") -> DataFrame:
    """F20 [spec]: delete noise tokens (``drop='noise'``) or non-noise tokens (``'nonnoise'``)."""
    kept = F.filter("_x", lambda x: ~x["noise"] if drop == "noise" else x["noise"])
    return _examples(long, keys).select(*keys, F.transform(kept, lambda x: x["token"]).alias("inputs"))


def permute_noise(long: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """F21 [spec]: tokens at noise positions permuted among themselves (density 1 = full shuffle).

    Noise positions are ranked by position and by hash; the token of hash-rank r
    moves to the position of rank r, inside its example's row.
    """
    d = _examples(long, keys).withColumn("_nz", F.filter("_x", lambda x: x["noise"]))
    drawn = F.array_sort(F.transform("_nz", lambda x: F.struct(H.u(seed, *keys, x["pos"]).alias("h"), x["pos"], x["token"])))
    moved = F.zip_with("_nz", drawn, lambda x, y: F.struct(x["pos"].alias("p"), y["token"].alias("v")))
    stay = F.transform(F.filter("_x", lambda x: ~x["noise"]), lambda x: F.struct(x["pos"].alias("p"), x["token"].alias("v")))
    return d.select(*keys, F.transform(F.array_sort(F.concat(stay, moved)), lambda x: x["v"]).alias("inputs"))


# --- T5 token preprocessors ---------------------------------------------------

def random_chunk(df: DataFrame, keys: list[str], tokens: str, max_length: int, seed: int) -> DataFrame:
    """F9 [spec]: a contiguous chunk of at most ``max_length`` starting at a random multiple of it."""
    n = F.size(tokens)
    n_chunks = F.greatest(F.ceil(n / F.lit(max_length)), F.lit(1))
    start = (H.u(seed, *keys) % n_chunks) * max_length
    return df.withColumn(tokens, F.slice(tokens, (start + 1).cast("int"), F.lit(max_length)))


def concat_groups(ranked: DataFrame, pos: str, tokens: str, group_size: int = 128) -> DataFrame:
    """F10 [spec]: concatenate the tokens of every ``group_size`` consecutive examples."""
    g = ranked.withColumn("group", F.floor(F.col(pos) / group_size).cast("bigint"))
    a = g.groupBy("group").agg(F.array_sort(F.collect_list(F.struct(pos, tokens))).alias("_x"))
    return a.select("group", F.flatten(F.transform("_x", lambda s: s[tokens])).alias(tokens))


def split_fixed(df: DataFrame, keys: list[str], tokens: str, length: int | Column) -> DataFrame:
    """F11 [spec]: cut every example into pieces of ``length`` tokens (last may be shorter)."""
    d = df.withColumn("_len", length if isinstance(length, Column) else F.lit(length))
    k = F.greatest(F.ceil(F.size(tokens) / F.col("_len")), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.slice(tokens, i * F.col("_len") + 1, F.col("_len")))
    return d.select(*keys, F.posexplode(pieces).alias("piece", tokens))


def split_random(df: DataFrame, keys: list[str], tokens: str, min_len: int, max_len: int, seed: int) -> DataFrame:
    """F11 [spec]: pieces of one length per example, drawn log-uniformly from [min, max)."""
    lo, hi = math.log(min_len), math.log(max_len)
    length = F.floor(F.exp(F.lit(lo) + H.unit(seed, *keys, F.lit("split")) * F.lit(hi - lo))).cast("int")
    return split_fixed(df, keys, tokens, F.greatest(length, F.lit(min_len)))


def span_lengths(inputs_length: int, noise_density: float, mean_noise_span_length: float) -> tuple[int, int]:
    """F12 [spec]: the largest raw length whose corrupted input (non-noise + one sentinel per
    span + EOS) fits ``inputs_length``; returns (raw length, target length)."""

    def lengths(t):
        nn = int(round(t * noise_density))
        nspans = int(round(nn / mean_noise_span_length))
        return t - nn + nspans + 1, nn + nspans + 1

    t = inputs_length
    while lengths(t + 1)[0] <= inputs_length:
        t += 1
    return t, lengths(t)[1]


def pad_or_trim(arr: Column, length: int, pad: int = S.PAD) -> Column:
    return F.concat(F.slice(arr, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(arr), F.lit(0))))


def t5_batch_columns(df: DataFrame, inputs: str, targets: str, input_len: int, target_len: int) -> DataFrame:
    """pad/trim inputs and targets; attention masks; padded targets become -100
    (by subtracting 100 where the mask is 0: valid only because the pad id is 0)."""
    ii = pad_or_trim(F.col(inputs), input_len)
    tt = pad_or_trim(F.col(targets), target_len)
    d = df.withColumn("input_ids", ii).withColumn("labels_raw", tt)
    d = d.withColumn("attention_mask", F.transform("input_ids", lambda x: (x != S.PAD).cast("int")))
    d = d.withColumn("decoder_attention_mask", F.transform("labels_raw", lambda x: (x != S.PAD).cast("int")))
    return d.withColumn("labels", F.zip_with("labels_raw", "decoder_attention_mask", lambda x, m: x - 100 * (1 - m))).drop("labels_raw")




# --- retrieval samples (F23-F25) ---------------------------------------------

def concat_and_pad(tokens: Column, max_len: int, title: Column | None = None):
    """``[CLS] (title [SEP]) tokens [SEP]`` padded to ``max_len``; returns (tokens, pad_mask)."""
    cls, sep = F.array(F.lit(S.CLS)), F.array(F.lit(S.SEP))
    t = F.concat(cls, tokens, sep) if title is None else F.concat(cls, title, sep, tokens, sep)
    padn = F.greatest(F.lit(max_len) - F.size(t), F.lit(0))
    return (F.concat(t, F.array_repeat(F.lit(S.PAD), padn)),
            F.concat(F.array_repeat(F.lit(1), F.size(t)), F.array_repeat(F.lit(0), padn)))


def ict_pairs(blocks: DataFrame, key: Column, seed: int, max_len: int, query_in_block_prob: float,
              sents: str = "sents", title: str | None = "title") -> DataFrame:
    """a random sentence of the block is the pseudo-query; it stays in the block with
    probability ``query_in_block_prob``, else it is removed.  Query cut to S-2, block to
    S-(3+len(title)) (or S-2 without titles); both wrapped and padded."""
    n = F.size(sents)
    idx = H.u(seed, key, F.lit("q")) % n
    keep = H.u(seed, key, F.lit("keep")) < F.lit(query_in_block_prob * H.TWO32)
    query = F.slice(F.element_at(sents, (idx + 1).cast("int")), 1, max_len - 2)
    rest = F.when(keep, F.col(sents)).otherwise(F.filter(sents, lambda s, i: i != idx))
    off = (F.size(title) + 3) if title else F.lit(2)
    block = F.slice(F.flatten(rest), F.lit(1), F.lit(max_len) - off)
    qt, qm = concat_and_pad(query, max_len)
    ct, cm = concat_and_pad(block, max_len, F.col(title) if title else None)
    return blocks.select("*", qt.alias("query_tokens"), qm.alias("query_pad_mask"), ct.alias("context_tokens"), cm.alias("context_pad_mask"))


def titled_block_tokens(blocks: DataFrame, max_len: int, tokens: str = "block", title: str = "title") -> DataFrame:
    """``[CLS] title [SEP] block [SEP]`` with the block cut to S-(3+len(title)), padded."""
    block = F.slice(tokens, F.lit(1), F.lit(max_len) - (F.size(title) + 3))
    t, m = concat_and_pad(block, max_len, F.col(title))
    return blocks.select("*", t.alias("block_tokens"), m.alias("block_pad_mask"))


def null_block(spark, max_len: int) -> DataFrame:
    """the empty block (``[CLS] [SEP] [SEP]`` padded)."""
    e = F.array().cast("array<int>")
    t, m = concat_and_pad(e, max_len, e)
    return spark.range(1).select(t.alias("block_tokens"), m.alias("block_pad_mask"))


def evidence_tokens(df: DataFrame, max_len: int, text: str = "text_tokens", title: str = "title") -> DataFrame:
    """``([CLS] title [SEP] text)`` cut to S-1, then ``[SEP]``; padded, with a pad mask."""
    t = F.concat(F.slice(F.concat(F.array(F.lit(S.CLS)), F.col(title), F.array(F.lit(S.SEP)), F.col(text)), 1, max_len - 1),
                 F.array(F.lit(S.SEP)))
    padn = F.greatest(F.lit(max_len) - F.size(t), F.lit(0))
    return df.select("*", F.concat(t, F.array_repeat(F.lit(S.PAD), padn)).alias("evidence_tokens"),
                     F.concat(F.array_repeat(F.lit(1), F.size(t)), F.array_repeat(F.lit(0), padn)).alias("evidence_pad_mask"))
