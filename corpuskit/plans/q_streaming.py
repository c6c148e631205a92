"""Queries for the streaming jobs (S1-S4): each runs its stream to completion
(``availableNow``) over files derived from a given table, then reads the sink."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.plans import q_cleaning, q_reports, q_tokens  # noqa: F401 (registers the oracles reused here)
from corpuskit.plans.inputs import articles_raw, table
from corpuskit.plans.registry import ORACLES, query
from corpuskit.sources.files import scratch_dir
from corpuskit.streaming import jobs as S

ART_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()),
                           T.StructField("text", T.StringType())])


def _article_files(spark, d):
    base = scratch_dir(spark, "stream-src")
    a = articles_raw(spark, d).withColumn("_f", (F.col("doc_id") % 4).cast("int"))
    a.repartition("_f").drop("_f").write.json(base)
    return base


@query("stream_clean_shards", ORACLES["clean_articles"])
def q_stream_clean_shards(spark, d):
    src = _article_files(spark, d)
    out, ck = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-ckpt")
    S.stream_clean_shards(spark, src, out, ck, ART_SCHEMA)
    return spark.read.parquet(out).select("doc_id", "title", "text")


@query("stream_encode", q_tokens.FLAG_SQL.split(", tl AS")[0] + """
SELECT doc_id, sent_pos, CAST(len(tokens) AS INTEGER) AS n_tokens FROM tok""")
def q_stream_encode(spark, d):
    src = _article_files(spark, d)
    out, ck = scratch_dir(spark, "stream-enc"), scratch_dir(spark, "stream-enc-ckpt")
    vocab = q_tokens.vocab(spark, d).checkpoint()
    S.stream_encode(spark, src, out, ck, ART_SCHEMA, vocab)
    return spark.read.parquet(out).select("doc_id", F.col("sent_pos").cast("int"), "n_tokens")


EVENTS_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
                              T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                              T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


@query("throughput_windows", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS docs, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes
FROM events GROUP BY 1""")
def q_throughput_windows(spark, d):
    out, ck = scratch_dir(spark, "tput"), scratch_dir(spark, "tput-ckpt")
    S.throughput_windows(spark, d, "events.parquet", out, ck, EVENTS_SCHEMA)
    return S.latest_windows(spark, out).select("window_start", "docs", "bytes")


PATIENCE_SCHEMA = "event_id long, ts timestamp, value double, run_path string"
#: Files of the shuffled log, and how many of them arrive together.
ARRIVALS, FILES_A_BATCH = 8, 3


@query("stream_patience", ORACLES["patience"])
def q_stream_patience(spark, d):
    """The patience report by a stateful stream over the events log, whose rows arrive shuffled over several micro-batches."""
    rp = F.concat(F.lit("model_"), (F.col("user_id") % 5).cast("string"), F.lit("/run_"), (F.col("user_id") % 3).cast("string"))
    log = table(spark, d, "events", "event_id", "ts", "user_id", "value").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value", rp.alias("run_path"))
    src = scratch_dir(spark, "patience-in")
    log.repartition(ARRIVALS, F.md5(F.col("event_id").cast("string"))).write.parquet(src)
    return patience_of_arrivals(spark, src).select("event_id", "run_path", "since_improvement", "stop")


def patience_of_arrivals(spark, src):
    """All evaluations in ``src``, however disordered: the delay is the log's span, and a heartbeat after it closes the log."""
    span = spark.read.schema(PATIENCE_SCHEMA).parquet(src).agg(F.unix_timestamp(F.min("ts")).alias("lo"), F.unix_timestamp(F.max("ts")).alias("hi")).first()
    out, ck = scratch_dir(spark, "patience"), scratch_dir(spark, "patience-ckpt")
    if span["hi"] is None:
        return spark.createDataFrame([], S.PATIENCE_OUT)
    delay = span["hi"] - span["lo"] + 1

    def run():
        stream = spark.readStream.schema(PATIENCE_SCHEMA).option("maxFilesPerTrigger", FILES_A_BATCH).parquet(src)
        S.stream_patience(stream, out, ck, 15, f"{delay} seconds")

    run()
    S.heartbeat(spark, src, span["hi"] + delay + 2)
    run()  # goes on from the checkpoint
    return spark.read.schema(S.PATIENCE_OUT).parquet(out)
