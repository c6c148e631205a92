"""Half-precision store, summary-level ROUGE, regular and random spans, random splits."""

import collections
import glob
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.functions import arrow_udfs
from corpuskit.operators import metrics as I
from corpuskit.operators import objectives as O
from corpuskit.operators.embedding_store import EmbeddingStore
from corpuskit.session import written


def test_store_is_half_precision_and_detects_conflicts(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(40, 9)) * 10.0 ** rng.integers(-8, 5, (40, 9))).astype(np.float32)
    x[0, :4] = [0.0, 70000.0, 6e-8, 1 + 2**-11]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    store = EmbeddingStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(ValueError, match="nothing"):
        store.read()
    schema = "vec_id bigint, embedding array<float>"
    store.add(spark.createDataFrame(rows[:25], schema))
    store.add(spark.createDataFrame(rows[25:] + [(None, [1.0]), (99, None)], schema))
    with np.errstate(over="ignore"):
        want = x.astype(np.float16)
    got = {r["vec_id"]: r["embedding"] for r in store.read().collect()}
    assert sorted(got) == list(range(40)) and all(np.array_equal(np.float32(got[i]), want[i].astype(np.float32)) for i in range(40))
    raw = {r["vec_id"]: bytes(r["embedding"]) for r in store.read(decoded=False).collect()}
    assert all(raw[i] == want[i].tobytes() for i in range(40))
    with pytest.raises(ValueError, match="already stored"):
        store.add(spark.createDataFrame([(100, [1.0]), (7, [1.0])], schema))
    with pytest.raises(ValueError, match="twice"):
        store.add(spark.createDataFrame([(100, [1.0]), (100, [2.0])], schema), allow_overwrite=True)
    store.add(spark.createDataFrame([(7, [1.0]), (100, [2.0])], schema), allow_overwrite=True)
    store.add(spark.createDataFrame([(101, [3.0])], schema))
    after = {r["vec_id"]: r["embedding"] for r in store.read().collect()}
    assert len(after) == 42 and after[7] == [1.0] and after[100] == [2.0] and after[8] == got[8]


def lcs_table(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
    return t


def plain_lsum(pred, ref):
    left, there = collections.Counter(w for s in pred for w in s), collections.Counter(w for s in ref for w in s)
    n, m, hits = sum(left.values()), sum(there.values()), 0
    for r in ref:
        union = set()
        for p in pred:
            t, i, j = lcs_table(r, p), len(r), len(p)
            while i and j:
                if r[i - 1] == p[j - 1]:
                    union.add(i - 1)
                    i, j = i - 1, j - 1
                elif t[i][j - 1] > t[i - 1][j]:
                    j -= 1
                else:
                    i -= 1
        for i in sorted(union):
            if left[r[i]] and there[r[i]]:
                left[r[i]] -= 1
                there[r[i]] -= 1
                hits += 1
    return 0.0 if not hits else 2 * hits / (n + m)


def test_rouge_lsum(spark):
    rng = random.Random(6)
    pairs = [([["w1", "w2", "w6", "w7", "w8"], ["w1", "w3", "w8", "w9", "w5"]], [["w1", "w2", "w3", "w4", "w5"]])]  # the union of both alignments: w1 w2 w3 w5
    pairs += [([], [["a"]]), ([["a"]], []), ([[]], [[]]), ([["a", "a"]], [["a"], ["a", "a"]])]
    pairs += [tuple([[rng.choice("abcdefg") for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(1, 4))] for _ in range(2)) for _ in range(150)]
    df = spark.createDataFrame([(k, p, r) for k, (p, r) in enumerate(pairs)], "k int, p array<array<string>>, r array<array<string>>")
    got = {r["k"]: r["rougeLsum"] for r in I.rouge_lsum(df, "k", "p", "r").collect()}
    assert abs(got[0] - 2 * 0.8 * 0.4 / 1.2) < 1e-12
    assert all(abs(got[k] - plain_lsum(p, r)) < 1e-9 for k, (p, r) in enumerate(pairs))
    for p, r in pairs:
        for a in r:
            for b in p:
                assert len(arrow_udfs._lcs_places(a, b)) == lcs_table(a, b)[-1][-1]


def test_regular_and_random_spans(spark):
    df = spark.createDataFrame([(k, list(range(200))) for k in range(60)], "k int, tokens array<int>")
    lengths = collections.Counter()
    for r in O._regroup(O.noise_regular(O.explode_tokens(df, ["k"]), ["k"], 2, 4, 0.2, 5), ["k"], F.col("noise").cast("int"), F.lit(True), "m").collect():
        runs = [len(x) for x in "".join(map(str, r["m"])).strip("0").split("0") if x]
        inner = runs[1:-1]
        assert len(set(inner)) == 1 and 2 <= inner[0] <= 4 and abs(sum(r["m"]) / 200 - 0.2) < 0.05
        lengths[inner[0]] += 1
    assert set(lengths) == {2, 3, 4}
    sizes = collections.Counter()
    for r in O.split_random(df, ["k"], "tokens", 5, 50, 3).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("piece", "tokens"))).alias("x")).collect():
        assert [t for p in r["x"] for t in p["tokens"]] == list(range(200)) and len({len(p["tokens"]) for p in r["x"][:-1]}) == 1
        sizes[len(r["x"][0]["tokens"])] += 1
    assert min(sizes) >= 5 and max(sizes) < 50 and len(sizes) > 15


def test_written_leaves_no_shuffle_files(spark):
    """A written table's shuffle files go when the write ends; the setting for it is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, root = spark.conf.get(name), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in root for f in glob.glob(f"{d}/*/shuffle_*.data")}
    old = files()
    t = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k"), "seven")
    for _ in range(100):  # they go in the background
        if not files() - old:
            break
        time.sleep(0.1)
    assert not files() - old and spark.conf.get(name) == before and t.count() == 7


def test_word_index_and_encoding_where_sentences_lie(spark, monkeypatch):
    """Sentences are encoded without a row per word; the result equals the join's, also for unknown words, repeated and null keys."""
    import pyarrow as pa

    from corpuskit.operators import tokens as K

    index = arrow_udfs.word_index(pa.array(["b", "a", "é"]), pa.array([5, 4, 6], pa.int32()))
    words = pa.array([["x"], ["a", "zz", "b"], None, [], ["é", "a"]]).slice(1)
    assert arrow_udfs._word_ids(words, index, 1).to_pylist() == [[4, 1, 5], None, [], [6, 4]]
    twice = (*index[:3], {"zz": 9})  # as a word whose hash another one has
    assert arrow_udfs._word_ids(words, twice, 1).to_pylist() == [[4, 9, 5], None, [], [6, 4]]
    empty = arrow_udfs.word_index(pa.array([], pa.string()), pa.array([], pa.int32()))
    assert arrow_udfs._word_ids(words, empty, 1).to_pylist() == [[1, 1, 1], None, [], [1, 1]]
    rows = [(1, "One two. Three two! "), (2, None), (3, ""), (4, "..  ?"), (None, "two one"), (5, "new word. one"), (5, "new word. one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    vocab = K.build_word_vocab(docs.filter("doc_id < 5 OR doc_id IS NULL"))
    fast = K.encode_corpus(docs, vocab)
    assert "collect_list" not in fast._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(K, "BROADCAST_VOCAB_ROWS", 0)
    slow = K.encode_corpus(docs, vocab)
    assert fast.schema.simpleString() == slow.schema.simpleString()
    key = lambda r: (r["doc_id"] or 0, r["sent_pos"])
    assert sorted(fast.collect(), key=key) == sorted(slow.collect(), key=key)
