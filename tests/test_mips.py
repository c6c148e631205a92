"""Exact search with skipped blocks against the full product."""

import numpy as np
import pytest

from corpuskit.operators.mips import MipsSearch


def data(kind, n=1500, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        c = rng.normal(size=(12, dim)) * 6
        return c[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.4
    if kind == "norms":
        return rng.normal(size=(n, dim)) * rng.lognormal(0, 1.5, (n, 1))
    if kind == "ties":
        return rng.integers(-1, 2, (n, dim)).astype(float) * (rng.random((n, 1)) < 0.5)
    return rng.normal(size=(n, dim))


def frame(spark, x, ids, names):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], f"{names[0]} bigint, {names[1]} array<double>")


@pytest.mark.parametrize("kind,skips", [("clusters", 0.5), ("norms", 0.2), ("ties", None), ("plain", None)])
def test_equals_full_product(spark, kind, skips):
    x = data(kind)
    q = x[::5]
    ids, qids = np.arange(len(x)) * 3 - 50, np.arange(len(q)) + 7
    search = MipsSearch(frame(spark, x, ids, ("vec_id", "embedding")).repartition(4), frame(spark, q, qids, ("query_id", "query")), 7, block_bytes=60 * 16 * 8, query_rows=20)
    got = {}
    for r in search.topk().collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    scores = q @ x.T
    for j, name in enumerate(qids):
        rows = sorted(got[name])
        assert [r[0] for r in rows] == list(range(1, 8))
        want = np.lexsort((ids, -np.round(scores[j], 9)))[:7]
        np.testing.assert_allclose([r[2] for r in rows], scores[j][want], atol=1e-9)
        if kind in ("ties", "clusters"):
            assert [r[1] for r in rows] == ids[want].tolist()
    made = search.products().first()
    assert made["all"] == len(x) * len(q) and made["made"] <= made["all"]
    if skips is not None:
        assert 1 - made["made"] / made["all"] > skips


def test_few_and_null_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (None, [5.0, 5.0])], "vec_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(10, [2.0, 1.0]), (11, None)], "query_id bigint, query array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in MipsSearch(corpus, queries, 5).topk().collect()]
    assert sorted(got) == [(10, 1, 1, 2.0), (10, 2, 3, 0.0)]
    none = corpus.limit(0)
    assert MipsSearch(none, queries, 5).topk().count() == 0 and MipsSearch(corpus, queries.limit(0), 5).topk().count() == 0


def test_many_query_blocks_of_one_block(spark, monkeypatch):
    from corpuskit.operators import mips

    monkeypatch.setattr(mips, "GROUP", 2)
    x = data("plain", 300)
    got = MipsSearch(frame(spark, x, range(300), ("vec_id", "embedding")), frame(spark, x, range(300), ("query_id", "query")), 1, query_rows=10).topk()
    best = (x @ x.T).argmax(axis=1)
    assert {r["query_id"]: r["vec_id"] for r in got.collect()} == dict(enumerate(best.tolist()))
