"""Queries for titled blocks and retrieval samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import prefix as P
from corpuskit.functions.hashing import sql_u
from corpuskit.operators import objectives as O
from corpuskit.operators import packing as E
from corpuskit.plans import sql_inputs as Q
from corpuskit.plans.inputs import arr_str
from corpuskit.plans.q_tokens import DOC_TOK, token_table
from corpuskit.plans.registry import query
from corpuskit.session import written

SEED = 1234
MAXL = 64
MIN_SENT = 2
TITLE_LEN = 8


def titles(tok):
    """Derived titles: the first sentence's first 8 tokens."""
    return tok.filter(F.col("sent_pos") == 0).select("doc_id", F.slice("tokens", 1, TITLE_LEN).alias("title"))


TITLED_SQL = DOC_TOK.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, ti AS (SELECT doc_id, tokens[1:{TITLE_LEN}] AS title FROM tok WHERE sent_pos = 0),
sz AS (SELECT doc_id, list(CAST(len(tokens) AS INTEGER) ORDER BY sent_pos) AS s FROM tok GROUP BY doc_id),
el AS (SELECT doc_id, s, len(s) AS n, {MAXL} - 3 - len(title) AS tg FROM sz JOIN ti USING (doc_id)
       WHERE len(s) >= {MIN_SENT} AND NOT (len(s) > 1 AND list_max(s) > 512)),
walk(doc_id, s, n, tg, i, seq, ns, start, k, closed, bs, be) AS (
  SELECT doc_id, s, n, tg, 0, 0, 0, 0, 0, false, 0, 0 FROM el
  UNION ALL
  SELECT doc_id, s, n, tg, i + 1, CASE WHEN c THEN 0 ELSE seq2 END, CASE WHEN c THEN 0 ELSE ns2 END,
         CASE WHEN c THEN i + 1 ELSE start END, CASE WHEN c THEN k + 1 ELSE k END, c, start, i + 1
  FROM (SELECT *, seq + s[i + 1] AS seq2, ns + 1 AS ns2,
               ((seq + s[i + 1] >= tg AND n - (i + 1) >= {MIN_SENT} AND ns + 1 >= {MIN_SENT}) OR n - (i + 1) = 0) AS c
        FROM walk WHERE i < n) w),
tb AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS block, CAST(bs AS INTEGER) AS start_sent, CAST(be AS INTEGER) AS end_sent,
              CAST(tg AS INTEGER) AS target, row_number() OVER (ORDER BY doc_id, k) - 1 AS block_id FROM walk WHERE closed),
bs AS (SELECT b.doc_id, b.block, b.block_id, list(t.tokens ORDER BY t.sent_pos) AS sents FROM tb b JOIN tok t
        ON t.doc_id = b.doc_id AND t.sent_pos >= b.start_sent AND t.sent_pos < b.end_sent GROUP BY ALL),
bt AS (SELECT bs.*, ti.title FROM bs JOIN ti USING (doc_id))
"""


def titled_blocks(spark, d):
    tok = token_table(spark, d)
    sents = tok.join(titles(tok).select("doc_id", F.size("title").alias("tl")), "doc_id")
    b = E.sentence_blocks(sents, "doc_id", MAXL, MIN_SENT, title_len="tl", close_min_remaining=MIN_SENT - 1)
    ranged = written(b.repartitionByRange("doc_id", "block").withColumn("_b", F.spark_partition_id()), "titled-blocks")
    return P.global_positions(ranged, [F.col("doc_id"), F.col("block")], F.col("_b"), rank_col="block_id").drop("_b"), tok


@query("titled_blocks", TITLED_SQL + "SELECT doc_id, block, start_sent, end_sent, target, block_id FROM tb")
def q_titled_blocks(spark, d):
    b, _ = titled_blocks(spark, d)
    return b.select("doc_id", "block", "start_sent", "end_sent", "target", "block_id")


def block_table(spark, d):
    b, tok = titled_blocks(spark, d)
    s = E.block_sentences(b.select("doc_id", "block", "start_sent", "end_sent"), tok)
    return s.join(b.select("doc_id", "block", "block_id"), ["doc_id", "block"]).join(titles(tok), "doc_id")


def _pad_sql(t: str) -> str:
    return f"{t} || list_transform(range(greatest({MAXL} - len({t}), 0)), lambda x: 0)"


@query("titled_block_tokens", TITLED_SQL + f"""
, bb AS (SELECT block_id, [3] || title || [4] || flatten(sents)[1:{MAXL} - (len(title) + 3)] || [4] AS t FROM bt)
SELECT block_id, {Q.arr_str(_pad_sql('t'))} AS block_tokens, CAST(len(t) AS INTEGER) AS n_real FROM bb""")
def q_titled_block_tokens(spark, d):
    b = block_table(spark, d).withColumn("block", F.flatten("sents"))
    t = O.titled_block_tokens(b, MAXL)
    return t.select("block_id", arr_str("block_tokens").alias("block_tokens"),
                    F.aggregate("block_pad_mask", F.lit(0), lambda a, x: a + x).alias("n_real"))


@query("ict_pairs", TITLED_SQL + f"""
, ic AS (SELECT block_id, sents, title, {sql_u(SEED, 'block_id', "'q'")} % len(sents) AS idx,
                {sql_u(SEED, 'block_id', "'keep'")} < 0.1 * 4294967296.0 AS keep FROM bt),
iq AS (SELECT block_id, title, sents[idx + 1][1:{MAXL} - 2] AS q,
              flatten(CASE WHEN keep THEN sents ELSE list_filter(sents, lambda s, i: i <> idx + 1) END)[1:{MAXL} - (len(title) + 3)] AS b FROM ic),
iw AS (SELECT block_id, [3] || q || [4] AS qt, [3] || title || [4] || b || [4] AS ct FROM iq)
SELECT block_id, {Q.arr_str(_pad_sql('qt'))} AS query_tokens, {Q.arr_str(_pad_sql('ct'))} AS context_tokens FROM iw""")
def q_ict_pairs(spark, d):
    b = block_table(spark, d)
    p = O.ict_pairs(b, F.col("block_id"), SEED, MAXL, 0.1)
    return p.select("block_id", arr_str("query_tokens").alias("query_tokens"), arr_str("context_tokens").alias("context_tokens"))


@query("evidence_tokens", DOC_TOK + f"""
, ti AS (SELECT doc_id, tokens[1:{TITLE_LEN}] AS title FROM tok WHERE sent_pos = 0),
ds AS (SELECT doc_id, flatten(list(tokens ORDER BY sent_pos)) AS t FROM tok GROUP BY doc_id),
ev AS (SELECT doc_id, ([3] || title || [4] || t)[1:{MAXL} - 1] || [4] AS e FROM ds JOIN ti USING (doc_id))
SELECT doc_id, {Q.arr_str(_pad_sql('e'))} AS evidence_tokens, CAST(len(e) AS INTEGER) AS n_real FROM ev""")
def q_evidence_tokens(spark, d):
    tok = token_table(spark, d)
    ds = E.doc_streams(tok).withColumnRenamed("tokens", "text_tokens").join(titles(tok), "doc_id")
    e = O.evidence_tokens(ds, MAXL)
    return e.select("doc_id", arr_str("evidence_tokens").alias("evidence_tokens"),
                    F.aggregate("evidence_pad_mask", F.lit(0), lambda a, x: a + x).alias("n_real"))
