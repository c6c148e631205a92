"""Draws and token arrays over whole batches, against the columns and plain programs they stand for."""

import contextlib
import io
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from corpuskit.functions import hashing as H
from corpuskit.functions import span_arrays as A
from corpuskit.functions import text as T
from corpuskit.llm import filter_audit, jaccard
from corpuskit.operators import masking as M
from corpuskit.operators import packing as E
from corpuskit.operators import tokens as K
from tests.test_masking import END, FIRST, SEED, choose, draws, groups_of, samples


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_draws_equal_columns(spark):
    keys = ["1:2", "", "é|x", None, *("k" * n for n in range(30, 64, 3))]
    numbers = [0, 9, 10, 99, 100, 12345, 10**9]
    rows = [(i, k, n) for i, k in enumerate(keys) for n in numbers]
    d = spark.createDataFrame(rows, "i int, k string, n long").select("i", "n", H.u(7, F.col("k"), F.lit("m"), F.col("n")).alias("u"))
    want = {(r["i"], r["n"]): r["u"] for r in d.collect()}
    got = H.draws(H.heads(7, pa.array(keys), "m"), np.repeat(np.arange(len(keys)), len(numbers)), np.tile(numbers, len(keys)))
    assert [want[i, n] for i, _, n in rows] == got.tolist()


def test_choices_take_no_step_per_token_in_expressions(spark):
    df = spark.createDataFrame([(1, list(range(100, 130)))], "k long, tokens array<int>")
    m = M.mlm_permute(M.mlm_replace(M.mlm_mask(df, "tokens", F.col("k"), SEED, FIRST), "tokens", F.col("k"), SEED, END), "tokens", F.col("k"), SEED)
    t5 = M.t5_sentence_samples(df, "tokens", F.col("k"), SEED, FIRST)
    for p in (plan(m), plan(t5)):
        assert "ArrowEvalPython" in p and "lambdafunction" not in p


def test_candidates_do_not_shuffle(spark):
    df = spark.createDataFrame([(1, [3, 510, 101, 4]), (2, []), (3, None)], "k long, tokens array<int>")
    c = M.mlm_candidates(df, ["k"], "tokens", FIRST)
    assert "Exchange" not in plan(c)
    assert [tuple(r) for r in c.orderBy("k", "pos").collect()] == [(1, 0, 3, None, False, True), (1, 1, 510, 0, True, False), (1, 2, 101, 1, True, True), (1, 3, 4, None, False, True)]


def test_choice_beyond_the_lengths_drawn_at_once(spark):
    rows = samples()
    m = M.mlm_mask(spark.createDataFrame(rows, "k long, tokens array<int>, target double"), "tokens", F.col("k"), SEED, FIRST, 0.9)
    one = draws(spark, rows, "m", 3, lambda c: M.ngram_length(c, 3))
    most = 0
    for r in m.collect():
        runs = choose(r["k"], groups_of(r["tokens"]), one, r["mask_budget"])
        assert sorted(r["masked_positions"]) == sorted(i for run in runs for i in run)
        most = max(most, len(runs))
    assert most > A.SOON


def test_lines_are_the_words_of_sentences(spark):
    texts = ["One two. Three, four!  ", "", None, "...", "Ünïted Straße? Ja. ", "日本 word. x​y", "a\u001fb. c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = F.filter(F.transform(K.sentences_of("text"), lambda s: T.basic_tokens(s)), lambda w: F.size(w) > 0)
    want = [(r[0], r[1], " ".join(r[2])) for r in docs.select("doc_id", F.posexplode(words)).collect()]
    assert sorted(want) == sorted(tuple(r) for r in M.sentence_words(docs).collect())


def test_front_cuts_equal_coins(spark):
    df = spark.createDataFrame([(k, list(range(k)), list(range(100, 100 + 2 * k))) for k in range(0, 60, 7)], "k long, tokens_a array<int>, tokens_b array<int>")
    coins = [(k, s, j) for k in range(0, 60, 7) for s in "ab" for j in range(1, 130)]
    u = spark.createDataFrame(coins, "k long, s string, j int").select("k", "s", "j", (H.u(SEED, F.col("k"), F.col("s"), F.col("j")) % 2).alias("u"))
    coin = {(r["k"], r["s"], r["j"]): r["u"] for r in u.collect()}
    for r in E.truncate_pair(df, SEED, F.col("k"), 20).collect():
        for side, own in (("a", list(range(r["k"]))), ("b", list(range(100, 100 + 2 * r["k"])))):
            left = r[f"tokens_{side}"]
            cut = sum(coin[r["k"], side, j] for j in range(1, len(own) - len(left) + 1))
            assert left == own[cut : cut + len(left)]
        assert len(r["tokens_a"]) + len(r["tokens_b"]) == min(20, 3 * r["k"])


def test_words_of_ids_are_looked_up_in_place(spark, monkeypatch):
    vocab = spark.createDataFrame([(100 + i, f"w{i}") for i in range(40)] + [(7, "seven")], "id int, word string")
    rows = [(k, 0, [100 + (k * i * i) % 45 for i in range(k % 13)] + [1, 7, None][: k % 4]) for k in range(60)] + [(None, 1, [101]), (99, 2, None), (98, 0, [])]
    tok = spark.createDataFrame(rows, "doc_id long, sent_pos int, tokens array<int>")
    words = {r["id"]: r["word"] for r in vocab.collect()}
    want = sorted(((k, p, [words.get(t, "[UNK]") for t in ts]) for k, p, ts in rows if ts), key=str)
    got = K.tokens_from_ids(tok, vocab, ["doc_id", "sent_pos"])
    assert "Exchange" not in plan(got) and sorted(map(tuple, got.collect()), key=str) == want
    for most in (0, 3, 40):
        monkeypatch.setattr(K, "BROADCAST_VOCAB_ROWS", most)
        assert sorted(map(tuple, K.tokens_from_ids(tok, vocab, ["doc_id", "sent_pos"]).collect()), key=str) == want


def test_shards_are_held_a_few_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} x x " * 20, "s") for i in range(60)], "doc_id long, text string, source string").coalesce(1)
    made, real = {}, filter_audit.written
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 400)
    monkeypatch.setattr(filter_audit, "written", lambda df, name, **o: made.setdefault(name, (real(df, name, **o), plan(df)))[0])
    flags = filter_audit.document_flags(docs)
    assert sorted((r["words"], r["distinct"]) for r in flags.collect()) == [(60, 2)] * 60
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in made["csr-local"][0].inputFiles()]
    sizes = [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(sizes) > 12 and max(sizes) <= filter_audit.SHARDS_AT_ONCE
    assert made["audit-rows"][1].count("ArrowEvalPython") == 1  # one Python process per task


def test_entries_are_crossed_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "LARGE", 30)
    rng, t = random.Random(5), Fraction(3, 4)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (12, 25, 60, 200)]
    texts = [" ".join(w if rng.random() > 0.02 else f"x{rng.randrange(10**6)}" for w in b) for b in base for _ in range(8)] + ["one two three"]
    owner, h = jaccard.shingle_sets(texts, 5)
    n, ids, _ = jaccard.set_ids(owner, h, len(texts))
    bits, fine = jaccard.set_bits(owner, h, len(texts)), jaccard.fine_counts(owner, h, len(texts))
    at = {}
    for e in range(6):  # entries of 1 to 27 records, the same ones in several entries
        for k in rng.sample(range(len(texts)), [1, 2, 5, 9, 20, 27][e]):
            at.setdefault(int(ids[k]), (k, set()))[1].add(e)
    rows = [(e, len([1 for _, own in at.values() if e in own]), s, k, s % 3 if k % 2 else s, int(n[k]), [int(b) for b in bits[k]], bytearray(fine[k]) if n[k] > 30 else None) for s, (k, es) in at.items() for e in es]
    df = spark.createDataFrame(rows, "entry long, size long, sid long, code long, component long, n long, bits array<long>, fine binary").repartition(5)
    made = jaccard._crossed(df, t)
    assert "Join" not in plan(made)
    got = [tuple(r) for r in made.collect()]
    sets = {int(ids[k]): set(h[owner == k].tolist()) for k in range(len(texts))}
    part = {r[2]: r[4] for r in rows}
    met = {(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and part[a[2]] < part[b[2]]}
    similar = {(a, b) for a, b in met if t <= Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b]))}
    pairs = {(a, b) for a, b, *_ in got}
    assert len(got) == len(pairs) and similar <= pairs <= met and 5 < len(similar) < len(met)
    assert all((p, q) == tuple(sorted((at[a][0], at[b][0]))) for a, b, p, q in got)
    most = {len(sets[a] ^ sets[b]) * 7 <= len(sets[a]) + len(sets[b]) for a, b in similar}
    assert most == {True} and len(pairs) < len(met)
