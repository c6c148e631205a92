"""File sources and sinks (A1-A10).

Readers take explicit schemas (no inference) and let Spark list and split the
files; writers partition by the output key so each shard is written by the
tasks that hold it.  ``scratch_dir`` is a folder under the session's
``spark.checkpoint.dir`` (a shared folder on a cluster).
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.functions import prefix as P
from corpuskit.functions.arrow_udfs import gzip_intact
from corpuskit.session import ensure_checkpoint_dir, written


def scratch_dir(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _records(spark: SparkSession, path: str, sep: str, glob: str) -> DataFrame:
    """``(_p, _range, _at, value)``: the parts of each file between separators, read by byte ranges.

    ``_range`` is the start of the byte range that held the record and ``_at`` grows with the record
    inside it (the scan emits a range's records in order, numbered consecutively within its task).
    """
    df = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("lineSep", sep).text(path)
    return df.select(F.col("_metadata.file_path").alias("_p"), F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_at"), "value")


def read_text_shards(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """A1: ``(shard, line_no, text)``; one document per line; shard = file name.

    A file is read by as many tasks as it has byte ranges.  The lines of each range are counted first
    (one row a range), so a line's number is the lines of earlier ranges of its file and its place in
    its own; lines are not shuffled.
    """
    lines = _records(spark, path, "\n", glob)
    per = lines.groupBy("_p", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = written(per.select("_p", "_range", (before - F.col("_first")).alias("_shift")), "line-ranges")
    if ranges.count() <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    numbered = lines.join(ranges, ["_p", "_range"])
    return numbered.select(F.regexp_extract("_p", r"([^/]+)$", 1).alias("shard"), "_p", (F.col("_at") + F.col("_shift")).cast("int").alias("line_no"), F.col("value").alias("text"))


#: Byte ranges (128 MB each by default) whose counts are broadcast; beyond, they are joined by a shuffle.
BROADCAST_RANGES = 500_000


JSONL_SCHEMA = T.StructType([T.StructField("text", T.StringType())])


def read_jsonl_text(spark: SparkSession, path: str, schema: T.StructType = JSONL_SCHEMA) -> DataFrame:
    """A2: JSONL with the given keys; a directory input takes ``.json`` / ``.jsonl`` files only."""
    a = spark.read.schema(schema).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path)
    b = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").json(path) \
        if _has_files(spark, path, ".jsonl") else None
    return a if b is None else a.unionByName(b)


def _has_files(spark, path: str, ext: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    it = fs.listFiles(p, True)
    while it.hasNext():
        if it.next().getPath().getName().endswith(ext):
            return True
    return False


def json_strings(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Every string of JSON array files: ``(file, nth, opened, commas, text)`` with the ``[`` and ``,`` before it in its file.

    A file is cut at every quote and read by byte ranges.  A quote is escaped if the part before it ends in
    an odd number of backslashes; the parity of the other quotes before a part, a scan over the ranges of
    the file, tells whether the part is inside a string.  So one array of any size is read by many tasks.
    """
    parts = _records(spark, path, '"', glob)
    tail = F.length("value") - F.length(F.regexp_replace("value", r"\\+$", ""))
    d = P.scan(parts, ["_p"], ["_at"], {"_q": ("sum", (tail % 2 == 0).cast("bigint"))}, exclusive=True)
    outside = F.col("_q") % 2 == 0

    def n(mark):
        return F.when(outside, F.length("value") - F.length(F.replace("value", F.lit(mark)))).otherwise(0).cast("bigint")

    d = P.scan(d, ["_p"], ["_at"], {"_opened": ("sum", n("[")), "_commas": ("sum", n(","))})
    pieces = F.array_sort(F.collect_list(F.struct("_range", "_at", "value")))
    g = d.filter(~outside).groupBy("_p", "_q").agg(pieces.alias("_x"), F.max("_opened").alias("opened"), F.max("_commas").alias("commas"))
    raw = F.array_join(F.transform("_x", lambda x: x["value"]), '"')
    text = F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>")[0]
    return g.select(F.col("_p").alias("file"), ((F.col("_q") - 1) / 2).cast("bigint").alias("nth"), "opened", "commas", text.alias("text"))


def read_wiki_json(spark: SparkSession, path: str) -> DataFrame:
    """A3: ``(file, idx, text)``, files that are one JSON array of article strings; the first line is the title.

    Elements that are no strings count in ``idx`` but give no row.
    """
    s = json_strings(spark, path)
    return s.select("file", F.col("commas").cast("int").alias("idx"), "text")


def read_dialog_json(spark: SparkSession, path: str) -> DataFrame:
    """A4: ``(file, idx, turn, utterance)``, files that are one JSON array of dialogs, each an array of strings."""
    s = json_strings(spark, path)
    turn = F.row_number().over(Window.partitionBy("file", "opened").orderBy("nth")) - 1
    return s.select("file", (F.col("opened") - 2).cast("int").alias("idx"), turn.alias("turn"), F.col("text").alias("utterance"))


EVIDENCE_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                                T.StructField("title", T.StringType())])


def read_evidence_tsv(spark: SparkSession, path: str, check_unique: bool = True) -> DataFrame:
    """A5: TSV with a header line, columns ``doc_id, text, title``; a duplicate id is an error."""
    df = spark.read.schema(EVIDENCE_SCHEMA).option("sep", "\t").option("header", "true").option("quote", "\u0000").csv(path)
    if check_unique:
        dup = df.groupBy("doc_id").count().filter("count > 1").limit(1).count()
        if dup:
            raise ValueError("duplicate evidence id")
    return df


def read_labeled_jsonl(spark: SparkSession, path: str, x_field: str = "text", label_field: str = "label") -> DataFrame:
    """``(text, label)`` from any two JSONL fields."""
    schema = T.StructType([T.StructField(x_field, T.StringType()), T.StructField(label_field, T.StringType())])
    return spark.read.schema(schema).json(path).select(F.col(x_field).alias("text"), F.col(label_field).alias("label"))


def readable(extension: Column, content: Column) -> Column:
    """Whether a file's content can be read: texts must be UTF-8, gzip files intact, images start with their format's mark."""
    head = F.hex(F.substring(content, 1, 4))
    image = F.when(extension == "png", head == "89504E47").when(extension.isin("jpg", "jpeg"), head.startswith("FFD8FF")).when(extension == "gif", head == "47494638").when(extension == "bmp", head.startswith("424D"))
    text = F.try_validate_utf8(content.cast("string")).isNotNull()
    ok = F.when(extension == "gz", gzip_intact(content)).when(extension.isin("txt", "json", "jsonl", "csv", "tsv", "html"), text).otherwise(F.coalesce(image, F.lit(True)))
    return ok


def labeled_files(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """``(path, class, bytes, ok)`` of ``root/class/**/file.ext``; every file is opened and checked."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(re.sub(r"^\w+:/+", "/", root).rstrip("/"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    d = df.select("path", F.regexp_extract("path", base + r"/([^/]+)/", 1).alias("class"), ext.alias("_e"), "content")
    d = d.filter(F.col("_e").isin(*[e.lower().lstrip(".") for e in extensions]))
    return d.select("path", "class", F.octet_length("content").alias("bytes"), readable(F.col("_e"), F.col("content")).alias("ok"))


def read_labeled_folder(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``(path, class, class_index, bytes)`` of the readable files, and ``(class, class_index, files, broken)`` counts.

    class_index = rank of the class name among all classes (the reference uses directory order); files that
    cannot be read are dropped and counted.  Files of no bytes are not listed by Spark and not counted.
    """
    files = written(labeled_files(spark, root, extensions), "labeled-files")
    per = files.groupBy("class").agg(F.count(F.lit(1)).alias("files"), F.sum((~F.col("ok")).cast("bigint")).alias("broken"))
    counts = per.select("class", (F.dense_rank().over(Window.orderBy("class")) - 1).cast("int").alias("class_index"), "files", "broken")
    return files.filter("ok").join(counts.select("class", "class_index"), "class").select("path", "class", "class_index", "bytes"), counts


def write_jsonl_shards(df: DataFrame, path: str, shard: str = "shard", cols: list[str] | None = None) -> None:
    """One JSONL folder per shard; rows that fail a JSON round trip are dropped first."""
    from corpuskit.operators.cleaning import json_roundtrip_filter

    cols = cols or [c for c in df.columns if c != shard]
    ok = json_roundtrip_filter(df, cols)
    ok.repartition(shard).write.mode("overwrite").partitionBy(shard).json(path)


def write_token_table(tok: DataFrame, path: str, key: str = "key", level: str = "sentence") -> None:
    """Token table as Parquet partitioned by (key, level), rows range-sorted by document and sentence."""
    out = tok.withColumn("level", F.lit(level))
    if key not in out.columns:
        out = out.withColumn(key, F.lit("text"))
    out.repartitionByRange(key, "doc_id").sortWithinPartitions("doc_id", "sent_pos") \
        .write.mode("overwrite").partitionBy(key, "level").parquet(path)


def write_metrics_report(metrics: DataFrame, path: str, fmt: str = "csv", split: str | None = None) -> None:
    """A10: metrics to CSV (header) or JSON, optionally one folder per split."""
    w = metrics.write.mode("overwrite") if split is None else metrics.repartition(split).write.mode("overwrite").partitionBy(split)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.json(path)
