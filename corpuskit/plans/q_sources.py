"""Queries for file sources and sinks (A1-A10).

Each query first writes files derived from a given table into a scratch folder
under ``spark.checkpoint.dir`` and then reads them back with the source under test.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corpuskit.functions import prefix as P
from corpuskit.operators import cleaning as C
from corpuskit.plans import sql_inputs as Q
from corpuskit.plans.inputs import articles_raw, table
from corpuskit.plans.q_tokens import DOC_TOK, token_table
from corpuskit.plans.registry import query
from corpuskit.sources import files as A


#: Bytes of text in a file, on average.
SHARD_BYTES = 16 << 20


def _n_files(df, text, shards=1):
    """Files for each of ``shards`` shards, so that a file holds about SHARD_BYTES."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, math.ceil(size / shards / SHARD_BYTES))


def _salt(n, *cols):
    return F.pmod(F.xxhash64(*cols), F.lit(n)).alias("salt")


def _text_shards(spark, d):
    """The folder and the lines in each part of a shard; parts are ranges of the shard's lines."""
    base = A.scratch_dir(spark, "text-shards")
    doc = table(spark, d, "documents", "doc_id", "text")
    lines = doc.select((F.col("doc_id") % 8).cast("int").alias("shard"), "doc_id", F.regexp_replace("text", "\n", " ").alias("value"))
    files = _n_files(lines, "value", 8)
    per = max(1, math.ceil(lines.count() / 8 / files))
    ranked = P.global_positions(lines, ["doc_id"], P.range_bucket(lines, "doc_id", files), rank_col="line", partition_by=["shard"], broadcast_offsets=False)
    parts = ranked.withColumn("part", F.floor(F.col("line") / per))
    parts.repartition("shard", "part").sortWithinPartitions("shard", "part", "line").select("shard", "part", "value").write.partitionBy("shard", "part").text(base)
    return base, per


@query("read_text_shards", """
SELECT CAST(doc_id % 8 AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) - 1 AS INTEGER) AS line_no,
       replace(text, chr(10), ' ') AS text FROM documents""")
def q_read_text_shards(spark, d):
    base, per = _text_shards(spark, d)
    r = A.read_text_shards(spark, base, "*.txt")
    shard, part = (F.regexp_extract("_p", rf"{x}=(\d+)", 1) for x in ("shard", "part"))
    return r.select(shard.cast("int").alias("shard"), (part.cast("bigint") * per + F.col("line_no")).cast("int").alias("line_no"), "text")


@query("read_jsonl_text", "SELECT doc_id, text FROM documents")
def q_read_jsonl_text(spark, d):
    base = A.scratch_dir(spark, "jsonl")
    table(spark, d, "documents", "doc_id", "text").write.json(base)
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    return A.read_jsonl_text(spark, base, schema)


@query("read_wiki_json", "WITH " + Q.ARTICLES_CTE + f"""
SELECT doc_id % 8 AS shard, {Q.title_of('text')} AS title, text FROM articles""")
def q_read_wiki_json(spark, d):
    """Articles grouped into one JSON array per file, several files a shard by size, read back; title = first line."""
    base = A.scratch_dir(spark, "wiki-json")
    a = articles_raw(spark, d).withColumn("shard", (F.col("doc_id") % 8).cast("bigint"))
    g = a.groupBy("shard", _salt(_n_files(a, "text", 8), "doc_id", "text")).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda s: s["text"])).alias("value"))
    g.repartition("shard", "salt").write.partitionBy("shard", "salt").text(base)
    r = A.read_wiki_json(spark, base)
    return r.select(F.regexp_extract("file", r"shard=(\d+)", 1).cast("bigint").alias("shard"), F.substring_index("text", "\n", 1).alias("title"), "text")


@query("read_dialog_json", """
SELECT conv_id % 4 AS shard, turn, text AS utterance FROM conversations""")
def q_read_dialog_json(spark, d):
    """Dialogs (arrays of utterances) in one JSON array per file, several files a shard by size, read back."""
    base = A.scratch_dir(spark, "dialog-json")
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    dia = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("u"))
    g = dia.withColumn("shard", F.col("conv_id") % 4).groupBy("shard", _salt(_n_files(c, "text", 4), "conv_id")).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "u"))), lambda s: s["u"])).alias("value"))
    g.repartition("shard", "salt").write.partitionBy("shard", "salt").text(base)
    r = A.read_dialog_json(spark, base)
    return r.select(F.regexp_extract("file", r"shard=(\d+)", 1).cast("bigint").alias("shard"), F.col("turn").cast("bigint"), "utterance")


@query("read_evidence_tsv", """
SELECT doc_id, regexp_replace(text, '[\\t\\n]', ' ', 'g') AS text, split_part(text, chr(10), 1) AS title FROM documents""")
def q_read_evidence_tsv(spark, d):
    base = A.scratch_dir(spark, "evidence-tsv")
    doc = table(spark, d, "documents", "doc_id", "text")
    ev = doc.select("doc_id", F.regexp_replace("text", r"[\t\n]", " ").alias("text"), F.substring_index("text", "\n", 1).alias("title"))
    ev.write.option("sep", "\t").option("header", "true").option("quote", "\u0000").csv(base)
    return A.read_evidence_tsv(spark, base)


@query("read_labeled_jsonl", """
SELECT l.doc_id::VARCHAR || ':' || d.lang AS text, CASE WHEN l.quality = 1 THEN 'true' ELSE 'false' END AS label
FROM labels l JOIN documents d USING (doc_id)""")
def q_read_labeled_jsonl(spark, d):
    base = A.scratch_dir(spark, "labeled-jsonl")
    lab = table(spark, d, "labels", "doc_id", "quality").join(table(spark, d, "documents", "doc_id", "lang"), "doc_id")
    lab.select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "lang").alias("body"),
               F.when(F.col("quality") == 1, "true").otherwise("false").alias("hyperpartisan")).write.json(base)
    return A.read_labeled_jsonl(spark, base, "body", "hyperpartisan")


URL_CLASS = r"^https?://[^/]+/([^/?#]+)"


@query("read_labeled_folder", f"""
WITH p AS (SELECT page_id % 8 AS bucket, regexp_extract(url, '{URL_CLASS}', 1) AS class, octet_length(encode(coalesce(html, ''))) + 1 AS bytes FROM pages),
f AS (SELECT class, bucket, sum(bytes) AS bytes FROM p GROUP BY class, bucket),
n AS (SELECT class, count(*) AS files, sum(CASE WHEN bucket = 3 THEN 1 ELSE 0 END) AS broken, sum(CASE WHEN bucket NOT IN (3, 7) THEN bytes END) AS text_bytes FROM f GROUP BY class)
SELECT class, CAST(dense_rank() OVER (ORDER BY class) - 1 AS INTEGER) AS class_index, files, CAST(broken AS BIGINT) AS broken, CAST(text_bytes AS BIGINT) AS text_bytes FROM n""")
def q_read_labeled_folder(spark, d):
    """Pages as eight files a class, one of them with a byte that is no UTF-8 and one gzipped; the folder is read back and checked."""
    base = A.scratch_dir(spark, "labeled-folder")
    p = table(spark, d, "pages", "page_id", "url", "html").withColumn("bucket", F.col("page_id") % 8)
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    value = F.when(F.col("bucket") == 3, F.concat(html, F.lit(b"\xc3"))).otherwise(html).cast("string")
    p = p.select(F.regexp_extract("url", URL_CLASS, 1).alias("cls"), "bucket", value.alias("value")).repartition("cls", "bucket")
    p.filter("bucket <> 7").write.partitionBy("cls", "bucket").text(base)
    p.filter("bucket = 7").write.mode("append").partitionBy("cls", "bucket").text(base, compression="gzip")
    files, counts = A.read_labeled_folder(spark, base, ("txt", "gz"))
    texts = files.filter(F.col("path").endswith(".txt")).groupBy("class").agg(F.sum("bytes").cast("bigint").alias("text_bytes"))
    return counts.join(texts, "class", "left").withColumn("class", F.regexp_replace("class", "^cls=", ""))


@query("write_jsonl_shards", "WITH " + Q.ARTICLES_CTE + f"""
, c AS (SELECT doc_id, {Q.title_of('text')} AS title, {Q.clean_body('text')} AS text FROM articles)
SELECT CAST(doc_id % 8 AS INTEGER) AS shard, count(*) AS n FROM c
WHERE NOT starts_with(title, 'List of') AND strpos(text, title || ' may refer to:') = 0 GROUP BY 1""")
def q_write_jsonl_shards(spark, d):
    base = A.scratch_dir(spark, "jsonl-shards")
    arts = C.clean_articles(articles_raw(spark, d)).select("doc_id", "title", "text").withColumn("shard", (F.col("doc_id") % 8).cast("int"))
    A.write_jsonl_shards(arts, base, "shard", ["title", "text"])
    back = spark.read.schema("title string, text string, shard int").json(base)
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("write_token_table", DOC_TOK + """
SELECT 'text' AS key, 'sentence' AS level, doc_id, sent_pos, CAST(len(tokens) AS INTEGER) AS n_tokens FROM tok""")
def q_write_token_table(spark, d):
    base = A.scratch_dir(spark, "token-table")
    A.write_token_table(token_table(spark, d), base, "key", "sentence")
    back = spark.read.parquet(base)
    return back.select("key", "level", "doc_id", "sent_pos", "n_tokens")


@query("write_metrics_report", """
SELECT event_type AS split, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY event_type""")
def q_write_metrics_report(spark, d):
    base = A.scratch_dir(spark, "metrics-report")
    m = table(spark, d, "events", "event_type", "value").groupBy(F.col("event_type").alias("split")).agg(
        F.round(F.avg("value"), 6).alias("mean_value"), F.count(F.lit(1)).alias("n"))
    A.write_metrics_report(m, base, "csv", split="split")
    back = spark.read.schema("mean_value double, n bigint, split string").option("header", "true").csv(base)
    return back.select("split", "mean_value", "n")


