"""Golden cases (FIXTURES.md section 3)."""

from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import masking as M
from corpuskit.operators import packing as E
from corpuskit.operators import objectives as O
from corpuskit.operators import reports as K
from corpuskit.operators import shards as D


def _bounds(spark, splits, n):
    df = spark.range(1).select(F.lit(n).cast("bigint").alias("_N"))
    return [int(x) for x in df.select(*D.split_bounds_cols(splits)).first()]


def test_split_bounds(spark):
    assert _bounds(spark, "969,30,1", 1000) == [0, 969, 999, 1000]
    assert _bounds(spark, "969,30,1", 333) == [0, 323, 333, 333]
    assert _bounds(spark, "1,1,1", 10) == [0, 4, 7, 10]
    assert _bounds(spark, "949,50,1", 7) == [0, 7, 7, 7]
    assert _bounds(spark, "949/50/1", 7) == [0, 7, 7, 7]


def test_short_valid_shards(spark):
    ranked = spark.range(1000).select(F.col("id").alias("pos"))
    s = D.shard_with_short_valid(ranked, 80, 1, 0.5)
    counts = {r["shard"]: r["count"] for r in s.groupBy("shard").count().collect()}
    assert len(counts) == 77
    assert counts[0] == 13 and counts[76] == 12


def test_pack_boundaries_golden(spark):
    docs = spark.createDataFrame([(0, 3), (1, 5), (2, 2), (3, 7)], "doc_ord long, size long")
    b = E.pack_boundaries(docs, "doc_ord", "size", 4).orderBy("sample_id").collect()
    assert [(r["doc_ord"], r["offset"]) for r in b] == [(0, 0), (1, 1), (2, 0), (3, 2), (3, 6)]


def _laid_out(sizes, S):
    """Boundaries by laying the token stream out: sample i begins at token i * S of it."""
    stream = [(doc, at) for doc, size in enumerate(sizes) for at in range(size)]
    return [stream[i * S] for i in range((len(stream) - 1) // S + 1)]


def test_pack_closed_form_matches_layout(spark):
    import random

    rng = random.Random(7)
    for _ in range(5):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(2, 9))]
        S = rng.randint(2, 6)
        if sum(sizes) - 1 < S:
            continue
        docs = spark.createDataFrame(list(enumerate(sizes)), "doc_ord long, size long")
        got = [(r["doc_ord"], r["offset"]) for r in E.pack_boundaries(docs, "doc_ord", "size", S).orderBy("sample_id").collect()]
        assert got == _laid_out(sizes, S), (sizes, S)


def _blocks(spark, sizes, target, min_sent):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(sizes)], "doc_id long, sent_pos int, n_tokens int").repartition(2)
    return [(r["start_sent"], r["end_sent"]) for r in E.sentence_blocks(df, "doc_id", target, min_sent).orderBy("block").collect()]


def test_sentence_blocks_golden(spark):
    assert _blocks(spark, [5] * 5, 8, 2) == [(0, 2), (2, 5)]
    assert _blocks(spark, [5] * 6, 8, 2) == [(0, 2), (2, 4), (4, 6)]
    assert _blocks(spark, [4] * 7, 8, 1) == [(0, 2), (2, 4), (4, 7)]
    assert _blocks(spark, [3, 600], 8, 2) == []
    assert _blocks(spark, [600], 8, 1) == [(0, 1)]


def test_truncated_lengths(spark):
    df = spark.createDataFrame([(7, 5, 8), (3, 9, 8), (10, 2, 7), (5, 5, 5)], "a int, b int, m int")
    got = []
    for r in df.collect():
        fa, fb = E.truncated_lengths(F.lit(r["a"]), F.lit(r["b"]), r["m"])
        x = spark.range(1).select(fa.alias("fa"), fb.alias("fb")).first()
        got.append((x["fa"], x["fb"]))
    assert got == [(4, 4), (3, 5), (5, 2), (3, 2)]


def test_mlm_budget(spark):
    df = spark.createDataFrame([(3,), (10,), (20,), (30,)], "n int")
    assert [r[0] for r in df.select(M.mlm_budget(F.col("n"), 0.15, 100)).collect()] == [1, 2, 3, 4]
    assert [r[0] for r in df.select(M.mlm_budget(F.col("n"), 0.15, 14.0)).collect()] == [1, 2, 2, 2]


def test_span_lengths():
    assert O.span_lengths(512, 0.15, 3.0) == (568, 114)


def test_normalize_answer(spark):
    df = spark.createDataFrame([("The  Cat, a dog!",)], "t string")
    assert df.select(T.normalize_answer("t")).first()[0] == "cat dog"


def test_name_and_run(spark):
    df = spark.createDataFrame([("glue/rte/bs_32/run_4",), ("glue/mixture/bs_128",)], "p string")
    name, run = K.name_and_run("p")
    assert [(r[0], r[1]) for r in df.select(name, run).collect()] == [("glue/rte/bs_32", 4), ("glue/mixture/bs_128", 0)]


def test_std_one_run_is_null(spark):
    df = spark.createDataFrame([("t", "m", 1.0)], "task string, model string, v double")
    assert K.mean_std_over_runs(df, ["task", "model"], "v").first()["std"] is None


def test_plan_epochs():
    assert D.plan_epochs(100, 10, 25) == 3
    assert D.plan_epochs(1000, 10, 50) == 1
