import pytest
"""Invariants for operators without a value oracle, and partition independence."""

from pyspark.sql import functions as F

from corpuskit.functions import specials as S
from corpuskit.operators import metrics as I
from corpuskit.operators import mixtures as G
from corpuskit.operators import objectives as O
from corpuskit.operators import shards as D


def test_shuffle_independent_of_partitioning(spark):
    base = spark.range(500).select(F.col("id").alias("k"))
    res = []
    for n in (1, 7, 64):
        r = D.shuffle_rows(base.repartition(n), "k", 99, n_buckets=16).orderBy("pos").select("k").collect()
        res.append([x[0] for x in r])
    assert res[0] == res[1] == res[2]
    assert sorted(res[0]) == list(range(500))


@pytest.mark.parametrize("sizes", [{"a": 300, "b": 120, "c": 80}, {"a": 40, "b": 400, "c": 60}, {"a": 10, "b": 10, "c": 480}])
def test_blend_follows_the_weights(spark, sizes):
    w = {"a": 0.6, "b": 0.24, "c": 0.16}
    rows = [(s, i, f"{s}{i}") for s, n in sizes.items() for i in range(n)]
    b = G.blend(spark.createDataFrame(rows, "s string, k long, row string"), "s", w)
    got = sorted((r["pos"], r["s"], r["k"], r["row"]) for r in b.collect())
    assert abs(len(got) - 500) <= 2 and [g[0] for g in got] == list(range(len(got)))
    assert all(row == f"{s}{k % sizes[s]}" for _, s, k, row in got)  # past a set's end its rows come again
    assert G.max_prefix_drift(b, "s", w).first()[0] < 2.0


def test_random_spans_mask(spark):
    df = spark.createDataFrame([(i, list(range(100 + i))) for i in range(20)], "doc_id long, tokens array<int>")
    m = O.noise_random_spans(df, ["doc_id"], 0.15, 3.0, 5).collect()
    for r in m:
        mask = r["noise"]
        n = len(r["tokens"])
        assert len(mask) == n
        assert sum(mask) == max(1, min(round(n * 0.15), n - 1))
        assert mask[0] is False  # a non-noise span comes first


def test_t5_batch_lengths(spark):
    df = spark.createDataFrame([(0, [5, 6, 7], [8, 9])], "k long, i array<int>, t array<int>")
    r = O.t5_batch_columns(df, "i", "t", 6, 4).first()
    assert r["input_ids"] == [5, 6, 7, 0, 0, 0]
    assert r["attention_mask"] == [1, 1, 1, 0, 0, 0]
    assert r["labels"] == [8, 9, S.IGNORE_LABEL, S.IGNORE_LABEL]


def _lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


def test_rouge_l_matches_brute_force(spark):
    pairs = [(0, "a b c d e".split(), "a c e f".split()), (1, "x y".split(), "y x".split()), (2, [], ["a"])]
    df = spark.createDataFrame(pairs, "k long, p array<string>, r array<string>")
    got = {r["k"]: r["rougeL"] for r in I.rouge_l(df, "k", "p", "r").collect()}
    for k, p, r in pairs:
        lc = _lcs(p, r)
        exp = 0.0 if lc == 0 else 2 * (lc / len(p)) * (lc / len(r)) / ((lc / len(p)) + (lc / len(r)))
        assert abs(got[k] - exp) < 1e-9


def test_sentinel_round_trip(spark):
    toks = [10 + i for i in range(12)]
    noise = [False, True, True, False, False, True, False, False, False, True, True, True]
    rows = [(0, i, t, len(toks), n) for i, (t, n) in enumerate(zip(toks, noise))]
    long = spark.createDataFrame(rows, "k long, pos int, token int, n int, noise boolean")
    r = O.spans_to_sentinels(long, ["k"]).first()
    assert r["inputs"] == [10, 99, 13, 14, 98, 16, 17, 18, 97]
    assert r["targets"] == [99, 11, 12, 98, 15, 97, 19, 20, 21]


def test_wordpiece_round_trip(spark):
    from corpuskit.operators import tokens as K

    words = spark.createDataFrame([("unaffable",), ("running",), ("run",), ("zzz",), ("x" * 300,)], "word string")
    counts = spark.createDataFrame([("run", 5), ("un", 4), ("aff", 3)], "word string, n long")
    pieces = K.wordpiece_vocab(counts.unionByName(words.selectExpr("word", "1L AS n")).filter("length(word) < 50"), 3)
    got = {r["word"]: r["pieces"] for r in K.wordpiece_encode(words, pieces).collect()}
    assert got["run"] == ["run"]
    assert got["running"][0] == "run" and all(p.startswith("##") for p in got["running"][1:])
    assert got["x" * 300] == ["[UNK]"]
    for w, p in got.items():
        if p != ["[UNK]"]:
            assert p[0] + "".join(x[2:] for x in p[1:]) == w


def test_bpe_round_trip(spark):
    from corpuskit.functions.arrow_udfs import _BYTE_MAP
    from corpuskit.operators import subword as W

    docs = spark.createDataFrame([(0, "the cat sat on the mat"), (1, "the hat, the cat! 42 cats"), (2, "ünïcode text")],
                                 "doc_id long, text string")
    counts = W.piece_counts(docs)
    merges = W.train_bpe(counts, 6, 3)
    assert merges.count() == 6
    vocab = W.bpe_vocab(counts, merges, (), multiple=8)
    rows = vocab.collect()
    assert len(rows) % 8 == 0
    ids = {r["token"]: r["id"] for r in rows}
    assert ids["<pad>"] == 0 and ids["</s>"] == 1 and ids["<unk>"] == 2
    inv = {v: k for k, v in ids.items()}
    for r in W.bpe_encode(docs, merges, vocab).collect():
        text = [t for t in docs.collect() if t["doc_id"] == r["doc_id"]][0]["text"]
        expect = "".join(_BYTE_MAP[b] for b in text.encode("utf-8"))
        assert 0 not in r["ids"]
        assert "".join(inv[i] for i in r["ids"]) == expect


def test_encode_independent_of_partitioning(spark):
    from corpuskit.operators import tokens as K

    texts = ["The cat sat. A dog ran!  Then?", "Één twee. Drie vier vijf.", "no break here", "x. y. z.", "   "]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 4)], "doc_id long, text string")
    vocab = K.build_word_vocab(docs, n_buckets=4)
    outs = []
    for n in (1, 3, 7):
        t = K.encode_corpus(docs.repartition(n), vocab, n_partitions=n + 1)
        outs.append(sorted((r["doc_id"], r["sent_pos"], tuple(r["tokens"])) for r in t.collect()))
    assert outs[0] == outs[1] == outs[2]
    # empty documents vanish, EOD only on each document's last sentence
    assert all(d % 5 != 4 for d, _, _ in outs[0])
    last = {}
    for d, s, toks in outs[0]:
        last[d] = max(last.get(d, -1), s)
    for d, s, toks in outs[0]:
        assert (toks[-1] == 1) == (s == last[d])
