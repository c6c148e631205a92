"""Whole-word masking against a plain sequential program, and its invariants."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import specials as S
from corpuskit.functions.hashing import u
from corpuskit.operators import masking as M

FIRST, END, SEED = 500, 600, 3  # ids from FIRST on continue a word


def samples():
    rng = random.Random(1)
    rows = []
    for k in range(40):
        n = [0, 1, 2, 5, 30, 60, 120][k % 7]
        body = [rng.choice([rng.randrange(100, 500), rng.randrange(FIRST, END)]) for _ in range(n)]
        cut = rng.randint(0, n)
        rows.append((k, [S.CLS, *body[:cut], S.SEP, *body[cut:], S.SEP], [0.0, 20.0, 128.0][k % 3] or 37.0))
    rows.append((40, [S.CLS, S.SEP], 128.0))
    rows.append((41, [S.CLS, 120, *[FIRST] * 100, S.SEP], 128.0))  # one word longer than any budget
    return rows


def draws(spark, rows, salt, longest, length):
    """``{(k, group): (rank hash, n)}`` as the columns draw them."""
    at = [(k, g) for k, t, _ in rows for g in range(len(t))]
    d = spark.createDataFrame(at, "k long, g int")
    d = d.select("k", "g", u(SEED, F.col("k"), F.lit(salt), F.col("g")).alias("h"), length(u(SEED, F.col("k"), F.lit(salt + "n"), F.col("g"))).alias("n"))
    return {(r["k"], r["g"]): (r["h"], r["n"]) for r in d.collect()}


def groups_of(tokens):
    out = []
    for i, t in enumerate(tokens):
        if t in M.SPECIALS:
            continue
        if out and t >= FIRST:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def choose(k, groups, drawn, budget, taken=()):
    used, count, out = set(taken), 0, []
    for g in sorted(range(len(groups)), key=lambda g: (drawn[k, g][0], g)):
        for n in range(drawn[k, g][1], 0, -1):
            run = [i for w in groups[g : g + n] for i in w]
            if count + len(run) <= budget:
                break
        else:
            continue
        if not used & set(run):
            used |= set(run)
            count += len(run)
            out.append(run)
    return sorted(out)


def budget_of(n, target):
    return int(min(0.15 * target, max(1, round(0.15 * n))))


@pytest.mark.parametrize("favor", [False, True])
def test_choice_equals_sequential_program(spark, favor):
    rows = samples()
    key = F.col("k")
    df = spark.createDataFrame(rows, "k long, tokens array<int>, target double").repartition(3)
    m = M.mlm_mask(df, "tokens", key, SEED, FIRST, 0.15, F.col("target"), favor_longer=favor)
    got = {r["k"]: r for r in M.mlm_permute(M.mlm_replace(m, "tokens", key, SEED, END), "tokens", key, SEED).collect()}
    first = {r["k"]: r["masked_positions"] for r in m.select("k", "masked_positions").collect()}
    one = draws(spark, rows, "m", 3, lambda c: M.ngram_length(c, 3, favor))
    two = draws(spark, rows, "perm", 3, lambda c: M.ngram_length(c, 3))
    for k, tokens, target in rows:
        groups, budget = groups_of(tokens), budget_of(len(tokens), target)
        r = got[k]
        chosen = [i for run in choose(k, groups, one, budget) for i in run]
        assert r["mask_budget"] == budget and sorted(first[k]) == sorted(chosen) and len(chosen) <= budget
        moved = [i for run in choose(k, groups, two, budget, chosen) for i in run]
        assert sorted(r["permuted_positions"]) == sorted(moved)
        assert r["masked_positions"] == sorted(chosen + moved) and r["masked_labels"] == [tokens[i] for i in sorted(chosen + moved)]
        assert sorted(r["output_tokens"][i] for i in moved) == sorted(tokens[i] for i in moved)
        assert all(r["output_tokens"][i] == t for i, t in enumerate(tokens) if i not in set(chosen + moved))
        covered = set(chosen)
        assert all(covered.issuperset(w) or not covered & set(w) for w in groups)  # words are whole


def test_replace_shares(spark):
    rows = [(k, [S.CLS, *range(100, 400), S.SEP]) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, tokens array<int>")
    m = M.mlm_replace(M.mlm_mask(df, "tokens", F.col("k"), 9, FIRST), "tokens", F.col("k"), 9, END)
    new = [(r["tokens"][i], r["output_tokens"][i]) for r in m.collect() for i in r["masked_positions"]]
    masks, kept = sum(n == S.MASK for _, n in new) / len(new), sum(o == n for o, n in new) / len(new)
    assert len(new) > 2000 and abs(masks - 0.8) < 0.03 and abs(kept - 0.1) < 0.03 and all(n == S.MASK or 100 <= n < END for _, n in new)
    t5 = M.mlm_replace(M.mlm_mask(df, "tokens", F.col("k"), 9, FIRST), "tokens", F.col("k"), 9, END, "t5").first()
    assert all(t5["output_tokens"][i] == S.MASK for i in t5["masked_positions"])
    with pytest.raises(ValueError):
        M.mlm_replace(m, "tokens", F.col("k"), 9, END, "other")
    none = M.mlm_mask(df, "tokens", F.col("k"), 9, FIRST, p=0.0).first()
    assert none["masked_positions"] == [] and none["mask_budget"] == 0


def test_pad(spark):
    df = spark.createDataFrame([([3, 5, 101, 4], [0, 0, 0, 0], [1], [100]), ([3, 4], [0, 0], [], [])], "t array<int>, y array<int>, masked_positions array<int>, masked_labels array<int>")
    a, b = M.mlm_pad(df, "t", "y", 6).collect()
    assert a["text"] == [3, 5, 101, 4, 0, 0] and a["labels"] == [-1, 100, -1, -1, -1, -1] and a["loss_mask"] == [0, 1, 0, 0, 0, 0]
    assert a["padding_mask"] == [1, 1, 1, 1, 0, 0] and b["labels"] == [-1] * 6 and b["types"] == [0] * 6
    with pytest.raises(Exception, match="longer than its padded length"):
        M.mlm_pad(df, "t", "y", 3).collect()


def test_candidates(spark):
    df = spark.createDataFrame([(1, [S.CLS, 510, 101, 511, S.SEP, 512, 102, S.SEP])], "k long, tokens array<int>")
    got = [tuple(r)[1:] for r in M.mlm_candidates(df, ["k"], "tokens", FIRST).orderBy("pos").collect()]
    assert [g[2] for g in got] == [None, 0, 1, 1, None, 1, 2, None]  # a continuation after SEP belongs to the word before it
    assert [g[4] for g in got] == [True, False, True, False, True, False, True, True]


def test_t5_spans_have_own_sentinels(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([rng.randrange(100, 500), rng.randrange(FIRST, END)]) for _ in range(rng.randint(1, 128))]) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, tokens array<int>").repartition(2)
    drawn = draws(spark, rows_for(rows), "t5", 10, lambda c: M.geometric_length(c))
    touching = 0
    for r in M.t5_sentence_samples(df, "tokens", F.col("k"), SEED, FIRST, 0.15, 128.0).collect():
        tokens = r["tokens"]
        runs = choose(r["k"], groups_of(tokens), drawn, budget_of(len(tokens), 128.0))
        touching += sum(a[-1] + 1 == b[0] for a, b in zip(runs, runs[1:]))
        inside = {i: j for j, run in enumerate(runs) for i in run}
        want = [99 - inside[i] if i in inside else t for i, t in enumerate(tokens) if i not in inside or runs[inside[i]][0] == i]
        out = [x for j, run in enumerate(runs) for x in [99 - j, *[tokens[i] for i in run]]]
        assert r["n_spans"] == len(runs) and r["encoder_input"] == want
        assert r["decoder_input"] == [S.BOS, *out] and r["decoder_output"] == [*out, S.EOD]
    assert touching > 0
    with pytest.raises(Exception, match="more spans than sentinels"):
        M.t5_sentence_samples(df, "tokens", F.col("k"), SEED, FIRST, 0.15, 128.0, n_sentinels=1).collect()


def rows_for(rows):
    return [(k, t, None) for k, t in rows]


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_pieces(spark, monkeypatch, bound):
    monkeypatch.setattr(M, "BROADCAST_PIECES", bound)
    docs = spark.createDataFrame([(1, "unaffable able. xyz! able?"), (2, ""), (3, None), (4, "Able able")], "doc_id long, text string")
    tok, first, end = M.piece_table(docs, 1)
    rows = {(r["doc_id"], r["sent_pos"]): r["tokens"] for r in tok.collect()}
    assert set(rows) == {(1, 0), (1, 1), (1, 2), (4, 0)} and rows[4, 0] == rows[1, 2][:1] * 2
    assert all(100 <= t < end for v in rows.values() for t in v) and sum(t < first for t in rows[1, 0]) == 3  # unaffable, able, '.'
