"""Queries for subword vocabularies (C6, C10, C12): iterative, so rows-only checks; compared with a plain trainer in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import subword as W
from corpuskit.plans.inputs import dialog_turns, table
from corpuskit.plans.registry import query
from corpuskit.session import written

USER = ("<speaker1>", "<speaker2>")
MERGES = 512
PER_ROUND = 32


def corpus(spark, d):
    """Documents and dialog turns with their speaker symbols: ``(source, id, turn, text)``."""
    docs = table(spark, d, "documents", "doc_id", "text").select(F.lit("doc").alias("source"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"), "text")
    turns = dialog_turns(spark, d).select(F.lit("conv").alias("source"), F.col("conv_id").alias("id"), F.col("turn").cast("bigint").alias("turn"), F.col("utterance").alias("text"))
    return docs.unionByName(turns)


def _trained(spark, d):
    texts = corpus(spark, d)
    counts = written(W.piece_counts(texts, "text", USER), "piece-counts")
    return texts, counts, W.train_bpe(counts, MERGES, PER_ROUND)


@query("train_subword_vocab")
def q_train_subword_vocab(spark, d):
    """BPE vocabulary of documents and dialogs with whole speaker symbols, padded to a multiple of 64."""
    _, counts, merges = _trained(spark, d)
    return W.bpe_vocab(counts, merges, USER, multiple=64)


@query("byte_bpe_encode")
def q_byte_bpe_encode(spark, d):
    """Every text as ids of that vocabulary."""
    texts, counts, merges = _trained(spark, d)
    v = W.bpe_vocab(counts, merges, USER, multiple=64)
    rows = texts.withColumn("key", F.struct("source", "id", "turn"))
    e = W.bpe_encode(rows, merges, v, "key", "text", USER)
    return e.select("key.source", "key.id", "key.turn", F.size("ids").cast("int").alias("n_ids"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))
