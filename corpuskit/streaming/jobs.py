"""Structured Streaming forms of the ingest steps.

Sources are file streams with explicit schemas; every query has its own
checkpoint location (under ``spark.checkpoint.dir``) so a restarted or
relocated driver resumes exactly where it stopped.  ``availableNow`` processes
what is there and stops; the same code runs with a processing-time trigger.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuskit.operators import cleaning as C
from corpuskit.operators import tokens as K


def _run(writer, trigger_once: bool = True):
    q = writer.trigger(availableNow=True).start() if trigger_once else writer.start()
    q.awaitTermination()
    return q


def stream_clean_shards(spark: SparkSession, src: str, out: str, ckpt: str, schema: T.StructType,
                        max_files: int = 1) -> None:
    """New JSONL files -> clean_articles (stateless) -> Parquet (append)."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(src)
    cleaned = C.clean_articles(s).select("doc_id", "title", "text")
    _run(cleaned.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", out).outputMode("append"))


def stream_encode(spark: SparkSession, src: str, out: str, ckpt: str, schema: T.StructType, vocab: DataFrame,
                  max_files: int = 1) -> None:
    """S1 + encode_corpus per micro-batch (``foreachBatch``; writes are keyed by batch id,
    so a replayed batch overwrites its own folder instead of duplicating rows)."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(src)
    cleaned = C.clean_articles(s).select("doc_id", "text")

    def per_batch(df: DataFrame, batch_id: int):
        tok = K.encode_corpus(df, vocab)
        tok.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    _run(cleaned.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt))


def throughput_windows(spark: SparkSession, src: str, glob: str, out: str, ckpt: str, schema: T.StructType,
                       window: str = "1 day", delay: str = "1 hour") -> None:
    """S3: documents and MB per event-time window, with a watermark bounding the state.

    Update mode through ``foreachBatch``: each batch writes the windows it changed
    under its batch id; the reader keeps the latest version of every window.
    """
    s = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 1).parquet(src)
    agg = (s.withWatermark("ts", delay)
           .groupBy(F.window("ts", window).alias("w"))
           .agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("props")).alias("bytes")))

    def per_batch(df: DataFrame, batch_id: int):
        df.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "docs", "bytes",
                  F.lit(batch_id).alias("batch_id")).write.mode("overwrite").parquet(os.path.join(out, f"b={batch_id}"))

    _run(agg.writeStream.outputMode("update").foreachBatch(per_batch).option("checkpointLocation", ckpt))


def latest_windows(spark: SparkSession, out: str) -> DataFrame:
    from pyspark.sql import Window

    d = spark.read.parquet(out)
    w = Window.partitionBy("window_start").orderBy(F.col("batch_id").desc())
    return d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "batch_id", "b")


PATIENCE_OUT = "event_id long, run_path string, since_improvement int, stop boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PatienceProcessor(StatefulProcessor):
    """State of a run: evaluations that wait for the watermark, the best value so far and the count since.

    An evaluation is counted when the watermark passes its time, so rows that arrive out of
    order (within the watermark's delay) are counted in order.  One timer a run is set, at
    its earliest waiting row.
    """

    def __init__(self, patience_n: int):
        self.patience_n = patience_n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "best double, since int")
        self.waiting = handle.getListState("waiting", "ms bigint, event_id bigint, value double")

    def handleInputRows(self, key, rows, timerValues):
        earliest = None
        for pdf in rows:
            pdf = pdf[pdf["event_id"].notna()]  # heartbeats only move the watermark
            if len(pdf):
                ms = pdf["ts"].astype("datetime64[ms]").astype("int64")
                self.waiting.appendList([(int(m), int(e), None if pd.isna(v) else float(v)) for m, e, v in zip(ms, pdf["event_id"], pdf["value"])])
                earliest = int(ms.min()) if earliest is None else min(earliest, int(ms.min()))
        if earliest is not None:
            self.handle.registerTimer(max(earliest, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get())
        due = [r for r in rows if r[0] <= until]
        best, since = self.best.get() if self.best.exists() else (None, 0)
        counts = []
        for _, _, v in due:
            if best is None or (v is not None and v > best):  # as long as nothing has a value, every row is the best so far
                best, since = v, 0
            else:
                since += 1
            counts.append(since)
        if due:
            self.best.update((best, since))
        later = rows[len(due):]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0])
        else:
            self.waiting.clear()
        yield pd.DataFrame({"event_id": pd.Series([r[1] for r in due], dtype="int64"), "run_path": pd.Series([key[0]] * len(due), dtype=object),
                            "since_improvement": pd.Series(counts, dtype="int32"), "stop": pd.Series([c > self.patience_n for c in counts], dtype="bool")})

    def close(self) -> None:
        pass


def stream_patience(src: DataFrame, out: str, ckpt: str, patience_n: int, delay: str) -> None:
    """K9/K10 over an arriving metrics log ``(event_id, ts, value, run_path)`` that may be out of order by up to ``delay``.

    ``transformWithStateInPandas`` with event-time timers: an evaluation comes out once the watermark
    has passed it.  A row without ``event_id`` is a heartbeat: it counts nothing, but its time moves the
    watermark, so a last one later than all rows by ``delay`` closes the log.  Rows later than
    ``delay`` are dropped by the watermark.
    """
    src.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    g = src.withWatermark("ts", delay).groupBy("run_path").transformWithStateInPandas(
        PatienceProcessor(patience_n), PATIENCE_OUT, outputMode="Append", timeMode="EventTime")
    _run(g.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", out).outputMode("append"))


def heartbeat(spark: SparkSession, folder: str, seconds: int) -> None:
    """Adds a file with one heartbeat at ``seconds`` since the epoch to the folder of a source."""
    null = F.lit(None)
    row = spark.range(1).select(null.cast("bigint").alias("event_id"), F.timestamp_seconds(F.lit(seconds)).alias("ts"), null.cast("double").alias("value"), null.cast("string").alias("run_path"))
    row.write.mode("append").parquet(folder)
