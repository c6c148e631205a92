"""Order of arrival, cluster scratch folders, category lines, word pieces and LCS."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpuskit import session
from corpuskit.functions import arrow_udfs
from corpuskit.functions import text as T
from corpuskit.sources.files import scratch_dir

from .conftest import SMALL


def test_stream_patience_orders_late_rows(spark):
    """Rows shuffled over micro-batches, in chunks, with ties in time and missing values: the batch result."""
    from corpuskit.operators import reports
    from corpuskit.plans import q_streaming

    events = spark.read.parquet(f"{SMALL}/events.parquet").limit(600)
    rp = F.concat(F.lit("run_"), F.when(F.col("user_id") % 3 == 0, F.lit("a")).otherwise((F.col("user_id") % 4).cast("string")))
    value = F.when(F.col("event_id") % 11 != 0, F.col("value"))
    log = events.select("event_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), value.alias("value"), rp.alias("run_path"))
    folder = scratch_dir(spark, "shuffled")
    log.repartition(7, F.md5(F.col("event_id").cast("string"))).write.parquet(folder)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = q_streaming.patience_of_arrivals(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    batch = reports.patience(reports.running_best(log, "run_path", ["ts", "event_id"], "value"), "run_path", ["ts", "event_id"], 15)
    want = {r["event_id"]: (r["run_path"], r["since_improvement"], r["stop"]) for r in batch.collect()}
    assert len(got) == 600 and {r["event_id"]: (r["run_path"], r["since_improvement"], r["stop"]) for r in got} == want
    empty = scratch_dir(spark, "no-log")
    log.limit(0).write.parquet(empty)
    assert q_streaming.patience_of_arrivals(spark, empty).count() == 0

def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    fake = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(fake)


def test_category_lines_with_carriage_returns_stay(spark):
    df = spark.createDataFrame([("Category:Foo\nCategory:Foo\r\nx\nCategory:\nnot Category:a\nCategory:a b",)], "t string")
    assert df.select(T.drop_category_lines("t")).first()[0] == "Category:Foo\r\nx\nCategory:\nnot Category:a"


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_word_pieces_and_lcs(spark, monkeypatch, bound):
    from corpuskit.operators import tokens as K

    monkeypatch.setattr(K, "BROADCAST_PIECES", bound)

    pieces = spark.createDataFrame([(p,) for p in ("un", "##aff", "##able", "##a", "a", "##ff", "able")], "piece string")
    words = spark.createDataFrame([("unaffable",), ("able",), ("unx",), ("a" * 300,), (None,), ("affa",), ("",), ("able",)], "word string")
    got = K.wordpiece_encode(words, pieces).collect()
    assert len(got) == 8 and {r["word"]: r["pieces"] for r in got} == {"unaffable": ["un", "##aff", "##able"], "able": ["able"], "unx": ["[UNK]"], "a" * 300: ["[UNK]"],
                                                                     None: None, "affa": ["a", "##ff", "##a"], "": []}
    assert arrow_udfs._lcs("the cat sat on".split(), "cat the sat the on".split()) == 3
    assert arrow_udfs._lcs([], ["a"]) == 0 and arrow_udfs._lcs(list("abcbdab"), list("bdcaba")) == 4


def test_t5_samples_hold_every_token(spark):
    from corpuskit.plans import q_mlm
    from corpuskit.operators.masking import piece_table

    sizes = {1: [3], 2: [600, 5], 3: [100, 100, 100, 7], 4: [40] * 20, 5: [128, 128], 6: [1000]}
    rows = [(k, p, list(range(k * 10_000 + p * 1_000, k * 10_000 + p * 1_000 + n))) for k, v in sizes.items() for p, n in enumerate(v)]
    tok = spark.createDataFrame(rows, "doc_id long, sent_pos int, tokens array<int>").repartition(3)
    got = {}
    for r in sorted(q_mlm.t5_blocks(tok, 128).collect(), key=lambda r: (r["doc_id"], r["block"], r["piece"])):
        assert 0 < len(r["tokens"]) <= 128
        got.setdefault(r["doc_id"], []).extend(r["tokens"])
    assert got == {k: [t for d, _, ts in rows if d == k for t in ts] for k in sizes}

    # a sample's source = its inputs without sentinels + its targets without sentinels and EOS
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    n = piece_table(docs, q_mlm.PIECES)[0].agg(F.sum(F.size("tokens"))).first()[0]
    size = lambda c: F.size(F.split(c, " "))
    q = entry.queries()["t5_sentence_samples"](spark, SMALL)
    assert q.agg(F.sum(size("encoder_input") + size("decoder_output") - 1 - 2 * F.col("n_spans"))).first()[0] == n


@pytest.mark.parametrize("name, shards", [("read_text_shards", 8), ("read_wiki_json", 8), ("read_dialog_json", 4)])
def test_files_of_a_shard_follow_its_size(spark, monkeypatch, name, shards):
    import glob

    from corpuskit.plans import q_sources

    key = lambda r: str(tuple(r))
    want = sorted(map(key, entry.queries()[name](spark, SMALL).collect()))
    folders, make = [], q_sources.A.scratch_dir
    monkeypatch.setattr(q_sources.A, "scratch_dir", lambda *a: folders.append(make(*a)) or folders[-1])
    monkeypatch.setattr(q_sources, "SHARD_BYTES", 2000, raising=False)
    assert sorted(map(key, entry.queries()[name](spark, SMALL).collect())) == want
    assert len(glob.glob(f"{folders[0].removeprefix('file:')}/**/*.txt", recursive=True)) > 2 * shards


def test_cyclic_index_is_not_made_in_one_row(spark):
    from corpuskit.operators import batching as J

    for sharding in (True, False):
        got = J.cyclic_batches(spark.range(1000), 64, 4, 8, 1, data_sharding=sharding)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Range (0," in plan and "sequence(" not in plan
        assert got.count() == got.select("idx").distinct().count() and got.agg(F.max("idx")).first()[0] < 1000
