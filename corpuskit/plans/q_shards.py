"""Queries for shuffles, shards, splits and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions.hashing import sql_u
from corpuskit.operators import shards as D
from corpuskit.plans.inputs import table
from corpuskit.plans.registry import query

SEED = 1234
URL_CLASS = r"^https?://[^/]+/([^/?#]+)"
U_DOC = sql_u(SEED, "doc_id")
RANKED = f"ranked AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY {U_DOC}, doc_id) - 1 AS BIGINT) AS pos FROM documents)"
NROWS = "(SELECT count(*) FROM documents)"


def ranked_docs(spark, d):
    return D.shuffle_rows(table(spark, d, "documents", "doc_id"), "doc_id", SEED)


def pages_with_class(spark, d):
    p = table(spark, d, "pages", "page_id", "url")
    return p.select("page_id", F.regexp_extract("url", URL_CLASS, 1).alias("class"))


PAGES_CLS = f"pc AS (SELECT page_id, regexp_extract(url, '{URL_CLASS}', 1) AS class FROM pages)"


@query("shuffle_rows", f"WITH {RANKED} SELECT doc_id, pos FROM ranked")
def q_shuffle_rows(spark, d):
    return ranked_docs(spark, d).select("doc_id", "pos")


@query("shard_equal", f"""WITH {RANKED}
SELECT doc_id, CAST(floor(pos / ceil({NROWS} / 8.0)) AS INTEGER) AS shard FROM ranked""")
def q_shard_equal(spark, d):
    return D.shard_equal(ranked_docs(spark, d), 8).select("doc_id", "shard")


SHORT = f"ceil(({NROWS} - ceil({NROWS} / 81.0) * 0.5) / 80.0)"


@query("shard_with_short_valid", f"""WITH {RANKED}
SELECT doc_id, CAST(floor(pos / {SHORT}) AS INTEGER) AS shard FROM ranked""")
def q_shard_with_short_valid(spark, d):
    return D.shard_with_short_valid(ranked_docs(spark, d), 80, 1, 0.5).select("doc_id", "shard")


@query("assign_shards_to_workers", f"""WITH {RANKED},
s AS (SELECT DISTINCT CAST(floor(pos / {SHORT}) AS INTEGER) AS shard FROM ranked),
r AS (SELECT shard, row_number() OVER (ORDER BY shard) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT shard, CAST(floor(i / floor(n / 8)) AS INTEGER) AS worker FROM r WHERE i < floor(n / 8) * 8""")
def q_assign_shards_to_workers(spark, d):
    s = D.shard_with_short_valid(ranked_docs(spark, d), 80, 1, 0.5)
    return D.assign_shards_to_workers(s, 8)


@query("stride_shard", f"WITH {RANKED} SELECT doc_id, CAST(pos % 8 AS INTEGER) AS worker FROM ranked")
def q_stride_shard(spark, d):
    return D.stride_shard(ranked_docs(spark, d), 8).select("doc_id", "worker")


def _split_sql(splits: str) -> str:
    f = D.split_fractions(splits)
    b1 = f"round_even({f[0]!r} * {NROWS}, 0)"
    b2 = f"{b1} + round_even({f[1]!r} * {NROWS}, 0)"
    b3 = f"{b2} + round_even({f[2]!r} * {NROWS}, 0)"
    diff = f"({b3} - {NROWS})"
    return f"""WITH {RANKED}
SELECT doc_id, CASE WHEN pos < {b1} - {diff} THEN 'train' WHEN pos < {b2} - {diff} THEN 'valid' ELSE 'test' END AS split FROM ranked"""


@query("split_train_valid_test", _split_sql("969,30,1"))
def q_split_train_valid_test(spark, d):
    return D.split_train_valid_test(ranked_docs(spark, d), "969,30,1").select("doc_id", "split")


@query("sample_exact_k", f"WITH {RANKED} SELECT doc_id FROM ranked WHERE pos < floor({NROWS} * 0.3)")
def q_sample_exact_k(spark, d):
    return D.sample_exact_k(table(spark, d, "documents", "doc_id"), "doc_id", 0.3, SEED)


@query("take_n", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 64")
def q_take_n(spark, d):
    return D.take_n(table(spark, d, "documents", "doc_id", "lang"), "doc_id", 64)


@query("class_fraction", f"""WITH {PAGES_CLS},
c AS (SELECT class, row_number() OVER (ORDER BY class) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT class FROM pc))
SELECT page_id, class FROM pc WHERE class IN (SELECT class FROM c WHERE r <= floor(n * 0.5))""")
def q_class_fraction(spark, d):
    return D.class_fraction(pages_with_class(spark, d), "class", 0.5)


@query("per_class_fraction", f"""WITH {PAGES_CLS},
r AS (SELECT page_id, class, row_number() OVER (PARTITION BY class ORDER BY page_id) - 1 AS r, count(*) OVER (PARTITION BY class) AS n FROM pc)
SELECT page_id, class FROM r WHERE r < floor(n * 0.5)""")
def q_per_class_fraction(spark, d):
    return D.per_class_fraction(pages_with_class(spark, d), "class", "page_id", 0.5, n_buckets=8)


U_EP = sql_u(SEED, "0", "epoch", "doc_id")


@query("epoch_doc_order", f"""
WITH e AS (SELECT doc_id, CAST(epoch AS INTEGER) AS epoch FROM documents, range(3) t(epoch))
SELECT epoch, doc_id, CAST(row_number() OVER (ORDER BY {U_EP}, epoch, doc_id) - 1 AS BIGINT) AS doc_ord FROM e""")
def q_epoch_doc_order(spark, d):
    return D.epoch_doc_order(table(spark, d, "documents", "doc_id"), "doc_id", 3, SEED).select("epoch", "doc_id", "doc_ord")


U_SS = sql_u(SEED, "doc_id")


@query("shuffle_samples", f"""
WITH g AS (SELECT doc_id, CASE WHEN doc_id < 700 THEN 0 ELSE 1 END AS g FROM documents)
SELECT doc_id, CAST(row_number() OVER (ORDER BY g, {U_SS}, doc_id) - 1 AS BIGINT) AS shuffled_pos FROM g""")
def q_shuffle_samples(spark, d):
    return D.shuffle_samples(table(spark, d, "documents", "doc_id"), "doc_id", 700, SEED).select("doc_id", "shuffled_pos")
