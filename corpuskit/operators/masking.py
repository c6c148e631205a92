"""Whole-word masking over word pieces: candidates, budget, selection, samples (F1-F8).

Tokens are piece ids of ``numbered_pieces``: pieces that start a word come first,
continuations (``##``) after them, so ``id < first_continuation`` tells a word start and
no table of flags travels with the samples.

The selection visits word groups in hash order, one n-gram of groups at a time, shrinks
it to what the budget leaves and skips it if a group of it is taken.  It is order
dependent but local to a sample, whose length is bounded, so it needs no shuffle: samples go to
Python in Arrow batches, whose draws and token arrays are computed as flat arrays (``span_arrays``).
Draws are hashes of (seed, sample, group), so retries and partitions do not matter.

No ``from __future__ import annotations`` here: UDF type hints must be real types.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpuskit.functions import hashing as H
from corpuskit.functions import prefix
from corpuskit.functions import specials as S
from corpuskit.functions import text as T
from corpuskit.functions import span_arrays as A
from corpuskit.functions.arrow_udfs import line_piece_ids, plain_lines
from corpuskit.operators.tokens import BROADCAST_PIECES, piece_dictionary, piece_sizes, pieces_by_join, sentences_of, wordpiece_vocab
from corpuskit.session import written

SPECIALS = A.SPECIALS
INTS = ST.ArrayType(ST.IntegerType())
SPANS = ST.ArrayType(ST.StructType([ST.StructField("g", ST.IntegerType()), ST.StructField("hi", ST.IntegerType())]))


# --- word pieces -------------------------------------------------------------

def sentence_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, sent_pos, line)`` of every sentence with a word, its words joined by one blank, which no word holds.

    One narrow pass, written: vocabulary and ids both come from it.  Plain texts are cut in whole batches.
    """
    other = F.filter(F.transform(sentences_of(text), lambda s: F.array_join(T.basic_tokens(s), " ")), lambda s: s != "")
    plain = docs.select(key, text, plain_lines(*T.plain_table())(F.col(text).cast("string")).alias("_plain"))
    return written(plain.select(key, F.posexplode(F.coalesce("_plain", other)).alias("sent_pos", "line")), "sentence-words")


def numbered_pieces(pieces: DataFrame) -> DataFrame:
    """``(piece, id)``: word starts in byte order from ``FIRST_WORD_ID``, then continuations."""
    nb = prefix.default_buckets(pieces.sparkSession)
    ranged = pieces.withColumn("_c", F.col("piece").startswith("##")).repartitionByRange(nb, "_c", "piece")
    ranged = written(ranged.withColumn("_b", F.spark_partition_id()), "pieces")
    ranked = prefix.global_positions(ranged, ["_c", "piece"], F.col("_b"), rank_col="_r")
    return ranked.select("piece", (F.col("_r") + S.FIRST_WORD_ID).cast("int").alias("id"))


def piece_bounds(ids: DataFrame) -> tuple[int, int]:
    """First continuation id and one past the last id."""
    r = ids.agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("piece").startswith("##")).cast("int")).alias("starts")).first()
    return S.FIRST_WORD_ID + (r["starts"] or 0), S.FIRST_WORD_ID + r["n"]


def encode_pieces(words: DataFrame, ids: DataFrame, key: str = "doc_id", unk: int = S.UNK) -> DataFrame:
    """``sentence_words`` -> ``(key, sent_pos, n_tokens, tokens)`` of piece ids.

    If the counted pieces allow a dictionary in each task, sentences are encoded where they lie, without
    a shuffle; else distinct words are cut by joins and their ids joined back word by word.
    """
    n, longest = piece_sizes(ids)
    if n <= BROADCAST_PIECES:
        out = words.select(key, "sent_pos", line_piece_ids(piece_dictionary(ids), longest, unk)("line").alias("tokens"))
    else:
        words = words.select(key, "sent_pos", F.split("line", " ").alias("words"))
        cut = pieces_by_join(words.select(F.explode("words").alias("word")).distinct(), ids, longest)
        each = cut.select("word", F.posexplode("pieces").alias("_p", "piece")).join(ids, "piece", "left")
        in_order = F.array_sort(F.collect_list(F.struct("_p", F.coalesce("id", F.lit(unk)).alias("id"))))
        coded = each.groupBy("word").agg(in_order.alias("_x")).select("word", F.transform("_x", lambda x: x["id"]).alias("ids"))
        flat = words.select(key, "sent_pos", F.posexplode("words").alias("_w", "word")).join(coded, "word")
        g = flat.groupBy(key, "sent_pos").agg(F.array_sort(F.collect_list(F.struct("_w", "ids"))).alias("_x"))
        out = g.select(key, "sent_pos", F.flatten(F.transform("_x", lambda x: x["ids"])).alias("tokens"))
    return out.select(key, "sent_pos", F.size("tokens").cast("int").alias("n_tokens"), "tokens")


def piece_table(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, int]:
    """Sentences as piece ids, with the first continuation id and the end of the ids."""
    words = sentence_words(docs, key, text)
    counts = words.select(F.explode(F.split("line", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "word-counts")  # read for the characters and for the most frequent words
    ids = written(numbered_pieces(wordpiece_vocab(counts, size)), "piece-ids")
    first, end = piece_bounds(ids)
    return written(encode_pieces(words, ids, key), "piece-tokens"), first, end


# --- selection ---------------------------------------------------------------

def mlm_budget(n_tokens: Column, p: float, target_len: Column | float | None = None) -> Column:
    """``min(p * target_len, max(1, round_half_even(p * n)))``, as the whole predictions that fit."""
    own = F.greatest(F.lit(1.0), F.bround(n_tokens * F.lit(p), 0))
    if target_len is None:
        return own.cast("int")
    most = (target_len if isinstance(target_len, Column) else F.lit(float(target_len))) * F.lit(p)
    return F.floor(F.least(most, own)).cast("int")


def _fields(df: DataFrame, made: Column, **names: str) -> DataFrame:
    """``df`` with the fields of a struct that a UDF makes, each by the name given for it."""
    d = df.withColumn("_made", made)
    return d.withColumns({new: F.col(f"_made.{old}") for old, new in names.items()}).drop("_made")


def _struct(**fields: ST.DataType) -> ST.StructType:
    return ST.StructType([ST.StructField(n, t) for n, t in fields.items()])


def mlm_candidates(df: DataFrame, keys: list[str], tokens: str, first_continuation: int) -> DataFrame:
    """F1, a row per token: ``(keys, pos, token, word, candidate, token_boundary)``; ``word`` is null for special tokens.

    A special token and a token that starts a word are boundaries.  Words are numbered where the sample lies.
    """
    @F.arrow_udf(INTS)
    def words(own: pa.Array) -> pa.Array:
        return A.words_of(A.Lists.of(own), first_continuation).arrow()

    own = df.select(*keys, F.col(tokens).alias("token"), words(tokens).alias("word"))
    e = own.select(*keys, F.posexplode(F.arrays_zip("token", "word")).alias("pos", "_t"))
    special = F.col("_t.token").isin(*SPECIALS)
    return e.select(*keys, "pos", "_t.token", "_t.word", (~special).alias("candidate"), (special | (F.col("_t.token") < first_continuation)).alias("token_boundary"))


def ngram_cuts(longest: int = 3, favor_longer: bool = False) -> list[int]:
    """Draws from which on n is 2, 3, ..., ``longest``, with p proportional to 1/n (or, reversed, favoring long ones)."""
    cuts, total = [], sum(1.0 / n for n in range(1, longest + 1))
    weights = [1.0 / n / total for n in range(1, longest + 1)]
    for w in reversed(weights) if favor_longer else weights:
        cuts.append((cuts[-1] if cuts else 0.0) + w)
    return [int(c * H.TWO32) for c in cuts[:-1]]


def geometric_cuts(p: float = 0.2, longest: int = 10) -> list[int]:
    """Like :func:`ngram_cuts`, of Geometric(p) on 1, 2, ..., clipped at ``longest`` (by its distribution function)."""
    return [int((1 - (1 - p) ** n) * H.TWO32) for n in range(1, longest)]


def _length(u: Column, cuts: list[int]) -> Column:
    out = F.lit(len(cuts) + 1)
    for n in range(len(cuts), 0, -1):
        out = F.when(u < F.lit(cuts[n - 1]), F.lit(n)).otherwise(out)
    return out


def ngram_length(u: Column, longest: int = 3, favor_longer: bool = False) -> Column:
    """n of a hash draw by ``ngram_cuts``."""
    return _length(u, ngram_cuts(longest, favor_longer))


def geometric_length(u: Column, p: float = 0.2, longest: int = 10) -> Column:
    """n of a hash draw by ``geometric_cuts``."""
    return _length(u, geometric_cuts(p, longest))


def mlm_mask(df: DataFrame, tokens: str, key: Column, seed: int, first_continuation: int, p: float = 0.15, target_len: Column | float | None = None,
             longest: int = 3, favor_longer: bool = False) -> DataFrame:
    """``mask_budget`` and ``masked_positions`` of whole words; keeps the word groups (``_cand``, places of the tokens that are
    not special, and ``_bounds``, where among them each group starts and the last one ends) and the chosen runs for F5.

    F1: a continuation belongs to the group before it, also across a special token.
    """
    cuts = ngram_cuts(longest, favor_longer)

    @F.arrow_udf(_struct(cand=INTS, bounds=INTS, spans=SPANS, positions=INTS))
    def made(key: pa.Array, own: pa.Array, budget: pa.Array) -> pa.Array:
        return A.masked(key, own, budget, seed, first_continuation, cuts)

    d = df.withColumn("mask_budget", mlm_budget(F.size(tokens), p, target_len) if p > 0 else F.lit(0))
    return _fields(d, made(key.cast("string"), tokens, "mask_budget"), cand="_cand", bounds="_bounds", spans="_masked", positions="masked_positions")


def mlm_replace(df: DataFrame, tokens: str, key: Column, seed: int, vocab_end: int, style: str = "bert") -> DataFrame:
    """at masked places 80 % the mask, 10 % the token, 10 % any piece (``bert``), or always the mask (``t5``).

    Adds ``output_tokens`` and ``masked_labels`` (the tokens that were there).
    """
    if style not in ("bert", "t5"):
        raise ValueError(f"unknown masking style {style!r}")
    kind = df.schema[tokens].dataType

    @F.arrow_udf(_struct(labels=kind, output=kind))
    def made(key: pa.Array, own: pa.Array, positions: pa.Array) -> pa.Array:
        return A.replaced(key, own, positions, seed, vocab_end, style)

    return _fields(df, made(key.cast("string"), tokens, "masked_positions"), labels="masked_labels", output="output_tokens")


def mlm_permute(df: DataFrame, tokens: str, key: Column, seed: int, longest: int = 3) -> DataFrame:
    """a second choice within the same budget, apart from the first; its tokens are permuted among its places.

    Permuted places are labelled too: ``masked_positions`` and ``masked_labels`` hold both, in order.
    """
    kind, cuts = df.schema[tokens].dataType, ngram_cuts(longest)

    @F.arrow_udf(_struct(permuted=INTS, output=kind, positions=INTS, labels=kind))
    def made(key: pa.Array, own: pa.Array, output: pa.Array, positions: pa.Array, cand: pa.Array, bounds: pa.Array, budget: pa.Array, taken: pa.Array) -> pa.Array:
        return A.permuted(key, own, output, positions, cand, bounds, budget, taken, seed, cuts)

    new = made(key.cast("string"), tokens, "output_tokens", "masked_positions", "_cand", "_bounds", "mask_budget", "_masked")
    return _fields(df, new, permuted="permuted_positions", output="output_tokens", positions="masked_positions", labels="masked_labels")


def mlm_pad(df: DataFrame, tokens: str, types: str, max_len: int, positions: str = "masked_positions", labels: str = "masked_labels", ignore: int = -1) -> DataFrame:
    """tokens and types padded to ``max_len``, padding mask, labels (``ignore`` elsewhere) and loss mask; a longer sample raises."""
    kinds = {n: df.schema[c].dataType for n, c in (("text", tokens), ("types", types), ("labels", labels))}

    @F.arrow_udf(_struct(**kinds, padding_mask=INTS, loss_mask=INTS))
    def made(own: pa.Array, types: pa.Array, positions: pa.Array, labels: pa.Array) -> pa.Array:
        return A.padded(own, types, positions, labels, max_len, ignore)

    return _fields(df, made(tokens, types, positions, labels), text="text", types="types", padding_mask="padding_mask", labels="labels", loss_mask="loss_mask")


def t5_sentence_samples(df: DataFrame, tokens: str, key: Column, seed: int, first_continuation: int, p: float = 0.15, target_len: float | Column | None = None,
                        longest: int = 10, n_sentinels: int = S.N_SENTINELS) -> DataFrame:
    """F8: whole-word spans with geometric(0.2) lengths, each replaced by a sentinel of its own.

    ``encoder_input`` has the sentinels in place, ``decoder_input`` is BOS + (sentinel, span)...,
    ``decoder_output`` the same + EOD.  Spans that touch stay two; more spans than sentinels raise.
    """
    kind, cuts = df.schema[tokens].dataType, geometric_cuts(longest=longest)

    @F.arrow_udf(_struct(n_spans=ST.IntegerType(), encoder_input=kind, decoder_input=kind, decoder_output=kind))
    def made(key: pa.Array, own: pa.Array, budget: pa.Array) -> pa.Array:
        return A.sentinel_samples(key, own, budget, seed, first_continuation, cuts, n_sentinels)

    names = ("n_spans", "encoder_input", "decoder_input", "decoder_output")
    return _fields(df, made(key.cast("string"), tokens, mlm_budget(F.size(tokens), p, target_len)), **{n: n for n in names})
