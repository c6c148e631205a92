"""Byte-level BPE against a plain trainer, whole user symbols, round trips."""

import collections
import random

import pytest

from corpuskit.functions.arrow_udfs import _BYTE_MAP
from corpuskit.operators import subword as W

from .conftest import SMALL

USER = ("<speaker1>", "<speaker2>", "<speaker1>x")


def plain_trainer(counts, n_merges, per_round):
    """The same rule, all pairs counted anew each round."""
    words = [([c for c in p], n) for p, n in counts]
    order = {ch: b for b, ch in enumerate([_BYTE_MAP[b] for b in range(256)])}
    merges = []
    while len(merges) < n_merges:
        pairs = collections.Counter()
        for s, n in words:
            for x in zip(s, s[1:]):
                pairs[x] += n
        top = sorted(pairs, key=lambda p: (-pairs[p], order[p[0]], order[p[1]]))[: 4 * per_round]
        chosen, used = [], set()
        for a, b in top:
            if len(chosen) < min(per_round, n_merges - len(merges)) and not {a, b} & used:
                chosen.append((a, b))
                used |= {a, b}
        if not chosen:
            return merges
        by_left = dict(chosen)
        for k, p in enumerate(chosen):
            order.setdefault(p[0] + p[1] + "\0" * (p[0] + p[1] in order), 256 + len(merges) + k)
        merges += chosen
        for i, (s, n) in enumerate(words):
            out, j = [], 0
            while j < len(s):
                if j + 1 < len(s) and by_left.get(s[j]) == s[j + 1]:
                    out.append(s[j] + s[j + 1])
                    j += 2
                else:
                    out.append(s[j])
                    j += 1
            words[i] = (out, n)
    return merges


@pytest.mark.parametrize("compact", [2, 16])
def test_merges_equal_plain_trainer(spark, monkeypatch, compact):
    monkeypatch.setattr(W, "COMPACT", compact)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40 if compact == 2 else 200)
    counts = W.piece_counts(docs).persist()
    got = [(r["left"], r["right"]) for r in W.train_bpe(counts, 150 if compact == 2 else 400, 25 if compact == 2 else 64).orderBy("rank").collect()]
    assert got == plain_trainer([tuple(r) for r in counts.collect()], len(got), 25 if compact == 2 else 64) and len(got) > 100
    counts.unpersist()


def test_runs_of_one_symbol(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("ab") for _ in range(rng.randint(1, 30))), rng.randint(1, 9)) for _ in range(50)] + [("a" * n, 1) for n in range(1, 12)]
    rows = list(dict(rows).items())
    counts = spark.createDataFrame(rows, "piece string, n long")
    got = [(r["left"], r["right"]) for r in W.train_bpe(counts, 18, 1).orderBy("rank").collect()]
    assert got == plain_trainer(rows, 18, 1)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_user_symbols_stay_whole(spark, monkeypatch, bound):
    monkeypatch.setattr(W, "BROADCAST_MERGES", bound)
    text = "hi!<speaker1> you<speaker2><speaker1>x, <speaker1"
    (pieces,) = spark.createDataFrame([(text,)], "text string").select(W.pre_split("text", USER)).first()
    assert "".join(pieces) == text and [p for p in pieces if p in USER] == ["<speaker1>", "<speaker2>", "<speaker1>x"]
    docs = spark.createDataFrame([(1, text), (2, "<speaker1>" * 30), (3, ""), (4, None), (5, "tail <speaker2>")], "doc_id long, text string")
    counts = W.piece_counts(docs, "text", USER)
    merges = W.train_bpe(counts, 20, 2)
    vocab = W.bpe_vocab(counts, merges, USER, multiple=16)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    assert len(ids) % 16 == 0 and sorted(ids.values()) == list(range(len(ids))) and [ids[t] for t in W.RESERVED] == [0, 1, 2]
    back = {v: k for k, v in ids.items()}
    chars = {ch: b for b, ch in enumerate([_BYTE_MAP[b] for b in range(256)])}
    got = {r["doc_id"]: r["ids"] for r in W.bpe_encode(docs, merges, vocab, user_symbols=USER).collect()}
    assert got[2] == [ids["<speaker1>"]] * 30 and set(got) == {1, 2, 5}
    for r in docs.collect():
        if r["doc_id"] in got:
            read = b"".join(t.encode() if (t := back[i]) in USER else bytes(chars[c] for c in t) for i in got[r["doc_id"]])
            assert read.decode() == r["text"]


def test_encode_equals_plain_merges(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(10).select("doc_id", "text")
    counts = W.piece_counts(docs)
    merges = W.train_bpe(counts, 120, 16)
    rank = {(r["left"], r["right"]): r["rank"] for r in merges.collect()}
    pieces = [r["piece"] for r in counts.collect()]
    got = {r["piece"]: r["syms"] for r in W.piece_symbols(counts.select("piece"), merges).collect()}
    for p in pieces:
        s = list(p)
        while len(s) > 1 and min(rank.get(x, 10**9) for x in zip(s, s[1:])) < 10**9:
            a, b = min(zip(s, s[1:]), key=lambda x: rank.get(x, 10**9))
            i = 0
            while i + 1 < len(s):
                if (s[i], s[i + 1]) == (a, b):
                    s[i : i + 2] = [a + b]
                i += 1
        assert got[p] == s
