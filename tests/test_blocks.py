"""Sentence blocks: a plain walk, one document of a million sentences, odd keys."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.operators import packing as E


def target(seed, epoch, key, k, max_len, p):
    u = int(hashlib.md5(f"{seed}|{epoch}|{key}|{k}".encode()).hexdigest()[:8], 16)
    return 2 + u % (max_len - 1) if p and u % round(1 / p) == 0 else max_len


def plain(sizes, key, max_len, min_sent, p, seed, remaining, less=0):
    out, start, seq = [], 0, 0
    for i, n in enumerate(sizes, 1):
        seq += n
        t = target(seed, 0, key, len(out), max_len, p) - less
        if (seq >= t and len(sizes) - i > remaining and i - start >= min_sent) or i == len(sizes):
            out.append((len(out), start, i, t))
            start, seq = i, 0
    return out


def test_a_million_sentences_of_one_document(spark):
    n = 1_000_000
    rows = spark.range(n, numPartitions=7).select(F.lit(5).cast("bigint").alias("doc_id"), F.col("id").alias("sent_pos"), (1 + F.pmod(F.col("id") * 7919, F.lit(40))).cast("int").alias("n_tokens"))
    sizes = 1 + (np.arange(n) * 7919) % 40
    got = E.sentence_blocks(rows, "doc_id", 128, 2, 0.1, 11).orderBy("block").toPandas()
    assert got[["block", "start_sent", "end_sent", "target"]].to_numpy().tolist() == [list(r) for r in plain(sizes.tolist(), 5, 128, 2, 0.1, 11, 1)]


@pytest.mark.parametrize("min_sent,remaining,less", [(1, 0, 0), (2, 1, 0), (3, 2, 4)])
def test_blocks_equal_plain_walk(spark, min_sent, remaining, less):
    rng = np.random.default_rng(4)
    docs = {str(k): rng.integers(1, 60, int(n)).tolist() for k, n in enumerate(rng.integers(1, 80, 60))}
    docs["long"], docs["single"] = [5, 600, 5, 5], [900]
    rows = [(k, i, s, max(less - 3, 0)) for k, v in docs.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "doc string, sent_pos int, n_tokens int, tl int").repartition(5)
    got = {}
    b = E.sentence_blocks(df, "doc", 100, min_sent, 0.25, 3, title_len="tl" if less else None, close_min_remaining=remaining)
    for r in b.collect():
        got.setdefault(r["doc"], []).append((r["block"], r["start_sent"], r["end_sent"], r["target"]))
    want = {k: plain(v, k, 100, min_sent, 0.25, 3, remaining, max(less - 3, 0) + 3 if less else 0) for k, v in docs.items() if len(v) >= min_sent and (len(v) == 1 or max(v) <= 512)}
    assert {k: sorted(v) for k, v in got.items()} == want
    sents = E.block_sentences(b, df.withColumn("tokens", F.array("sent_pos", "n_tokens")), "doc").collect()
    assert {(r["doc"], r["block"]): [t[0] for t in r["sents"]] for r in sents} == {(k, x[0]): list(range(x[1], x[2])) for k, v in want.items() for x in v}
