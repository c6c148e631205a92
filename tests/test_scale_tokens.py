"""Token tables and the samples on them: equal results without a row per word, without joins sentence by sentence."""

import random

from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import objectives as O
from corpuskit.operators import packing as E
from corpuskit.operators import tokens as K


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def long_way(c):
    """Every step of C4 over every text."""
    return T.split_ws(T.pad_punctuation(T.strip_accents(F.lower(T.space_cjk(T.clean_text(c))), c)))


def test_plain_texts_take_fewer_passes(spark):
    chars = [*range(1, 0x2200), 0x3000, 0x4E00, 0xAC01, 0xFEFF, 0xFFFD, 0x1F600]
    rows = [(f"Aé{chr(c)}Ö x{chr(c)}",) for c in chars] + [(f"AΣ{chr(c)}",) for c in chars] + [(f"A{chr(c)}b C",) for c in chars] + [("",), (" \t\r\n",), (None,), ("a\x1fb \x00c",), ("İI ß", )]
    df = spark.createDataFrame(rows, "t string")
    assert df.filter(~T.basic_tokens("t").eqNullSafe(long_way(F.col("t")))).count() == 0
    assert df.filter("t = 'Aé~Ö x~'").select(T.basic_tokens("t")).first()[0] == ["ae", "~", "o", "x", "~"]
    plain = df.select("t", F.col("t").rlike(T.PLAIN).alias("p")).filter("p").count()
    assert plain > 1000


def test_only_words_beyond_the_index_are_joined(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(rng.choice(words[: 1 + k % 60]) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    docs = spark.createDataFrame(rows + [(None, "w1 new. w59"), (3, None), (200, "w3. w59"), (200, "w3. w59")], "doc_id bigint, text string")
    vocab = K.build_word_vocab(docs.filter("doc_id < 100"), counts=True).localCheckpoint()
    joined = []
    inner = K.join_rare
    monkeypatch.setattr(K, "join_rare", lambda s, rare, *a: (joined.append(rare.count()), inner(s, rare, *a))[1])
    fast = K.encode_corpus(docs, vocab)
    want = sorted(map(tuple, fast.collect()), key=str)
    assert not joined
    for most in (0, 1, 20, vocab.count() - 1):
        monkeypatch.setattr(K, "BROADCAST_VOCAB_ROWS", most)
        assert sorted(map(tuple, K.encode_corpus(docs, vocab).collect()), key=str) == want
        assert sorted(map(tuple, K.encode_corpus(docs, vocab.select("word", "id")).collect()), key=str) == want
    assert joined[0] == vocab.count() and 0 < joined[-1] < 40


def test_texts_are_tokenized_once(spark, monkeypatch):
    odd = ["One two. Three a\x1fb c! ", "\x1f", "a\x1f", "x. \x1f. Y", "ΟΔΟΣ. ΟΔΟΣ", "\u200b. a", "", None, "same 한. é\x85z", "same 한. é\x85z"]
    docs = spark.createDataFrame(list(enumerate(odd)) + [(None, "null key. b"), (30, "again x.\ny")], "doc_id bigint, text string")
    lines = K.written(K.tokenized(docs), "tokenized")
    want = K.build_word_vocab(docs, counts=True)
    got = K.build_word_vocab(docs, counts=True, lines=lines)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "ab" in {r["word"] for r in got.collect()}  # of the whole text; its sentences have a and b
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    plain = rows(K.encode_corpus(docs, want))
    calls = []
    inner = T.basic_tokens
    monkeypatch.setattr(T, "basic_tokens", lambda *a: (calls.append(a), inner(*a))[1])
    assert rows(K.encode_corpus(docs, got, lines=lines)) == plain
    monkeypatch.setattr(K, "BROADCAST_VOCAB_ROWS", 3)
    assert rows(K.encode_corpus(docs, got, lines=lines)) == plain
    assert not calls


def test_noise_in_arrays_equals_long_form(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, [rng.randint(100, 999) for _ in range(rng.randint(0, 40))]) for k in range(80)] + [(None, [7, 8])], "k int, tokens array<int>")
    for op in (lambda x: O.drop_noise(x, ["k"]), lambda x: O.drop_noise(x, ["k"], "nonnoise"), lambda x: O.tokens_to_sentinel(x, ["k"]),
               lambda x: O.tokens_to_random_or_sentinel(x, ["k"], 5, 900), lambda x: O.permute_noise(x, ["k"], 5)):
        rows, arrays = [op(O.noise_iid(O.explode_tokens(df, ["k"], arrays=a), ["k"], 0.4, 5)) for a in (False, True)]
        assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, arrays.collect()), key=str)
        assert "Exchange" not in plan(arrays) and "Join" not in plan(rows)
    noise = {r["k"]: r for r in O.noise_iid(O.explode_tokens(df, ["k"], arrays=True), ["k"], 0.4, 5).collect()}
    for r in O.permute_noise(O.noise_iid(O.explode_tokens(df, ["k"], arrays=True), ["k"], 0.4, 5), ["k"], 5).collect():
        was = noise[r["k"]]
        assert sorted(r["inputs"]) == sorted(was["token"]) and all(n or a == b for n, a, b in zip(was["noise"], was["token"], r["inputs"]))


def test_block_sentences_shuffle_token_arrays_once(spark):
    rng = random.Random(5)
    rows = [(d, p, [d * 1000 + p] * rng.randint(1, 9)) for d in range(30) for p in range(rng.randint(1, 25))] + [(None, 0, [1]), (None, 1, [2])]
    tok = spark.createDataFrame(rows, "doc_id bigint, sent_pos int, tokens array<int>").withColumn("n_tokens", F.size("tokens"))
    blocks = E.sentence_blocks(tok, "doc_id", 20, 2).localCheckpoint()
    got = E.block_sentences(blocks, tok, more=("target",))
    sents = {(d, p): t for d, p, t in rows}
    want = sorted((b["doc_id"], b["block"], [sents[b["doc_id"], p] for p in range(b["start_sent"], b["end_sent"])], b["target"]) for b in blocks.collect() if b["doc_id"] is not None)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 30
    assert "Join" not in plan(got)


def test_lines_of_plain_texts_are_cut_at_once(spark, monkeypatch):
    rng = random.Random(5)
    parts = [chr(c) for c in [*range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C2)]] + [" ", "\n", "\t", "\r", ". ", "!\n", "? ", "word", "Été", "\x1f", " ", "日", "한"]
    odd = ["", " ", "\n\t", ".", ". ", " . . ", "a.b. c", "A!? B\r\n.C", "İI ŒSS ſ Ⱥ", "end. ", "\x1fa. b", "a\x00b", None, "x" * 3000]
    odd += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(1500)] + [f"a{c}B {c}." for c in parts]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string").repartition(3)
    ready = K.A.plain_lines(*T.plain_table())("text")
    plain = docs.select("doc_id", ready.isNotNull().alias("ready"), F.coalesce(F.col("text").rlike(T.PLAIN), F.lit(False)).alias("plain"))
    assert plain.filter("ready <> plain").count() == 0 and plain.filter("ready").count() > 1000
    sents = docs.select("doc_id", F.posexplode(K.sentences_of("text")).alias("_p", "_sent"))
    want = sorted(map(tuple, sents.select("doc_id", "_p", F.array_join(long_way(F.col("_sent")), " ")).collect()))
    for chunk in (1, 100, 1 << 20):
        monkeypatch.setattr(K.A, "CHUNK", chunk)
        assert sorted(map(tuple, K.tokenized(docs).select("doc_id", "_p", "_line").collect())) == want
    whole = [(i, " ".join(w)) for i, w in docs.select("doc_id", long_way(F.col("text"))).collect() if w]
    assert sorted(r[:2] for r in K.tokenized(docs, split=False).filter("_line <> ''").select("doc_id", "_line").collect()) == sorted(whole)
