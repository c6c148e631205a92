"""Queries for packing and sentence blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions.hashing import sql_u
from corpuskit.operators import packing as E
from corpuskit.operators import shards as D
from corpuskit.plans import sql_inputs as Q
from corpuskit.plans.inputs import arr_str, table
from corpuskit.plans.q_tokens import DOC_TOK, token_table
from corpuskit.plans.registry import query

SEED = 1234
SEQ = 64
MAX_LEN = 128
MIN_SENT = 2
SHORT_P = 0.1

ORDERED_SQL = DOC_TOK + f"""
, ds AS (SELECT doc_id, flatten(list(tokens ORDER BY sent_pos)) AS t FROM tok GROUP BY doc_id),
od AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_u(SEED, '0', '0', 'doc_id')}, doc_id) - 1 AS ord FROM documents),
j AS (SELECT od.ord, ds.t, len(ds.t) AS sz FROM od JOIN ds USING (doc_id)),
r AS (SELECT ord, t, sz, coalesce(sum(sz) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
             sum(sz) OVER () AS total FROM j)
"""


def ordered_streams(spark, d):
    """Documents in one shuffled epoch (D13) with their token streams."""
    tok = token_table(spark, d)
    streams = E.doc_streams(tok)
    order = D.epoch_doc_order(table(spark, d, "documents", "doc_id"), "doc_id", 1, SEED)
    return order.join(streams, "doc_id").select("doc_ord", "tokens").checkpoint()


@query("pack_boundaries", ORDERED_SQL + f"""
SELECT CAST(i AS BIGINT) AS sample_id, ord AS doc_ord, CAST(i * {SEQ} - start AS INTEGER) AS "offset"
FROM r, generate_series(CAST(ceil(start / {SEQ}.0) AS BIGINT),
                        CAST(least(floor((start + sz - 1) / {SEQ}.0), floor((total - 1) / {SEQ}.0)) AS BIGINT)) g(i)
WHERE sz > 0
""")
def q_pack_boundaries(spark, d):
    o = ordered_streams(spark, d).withColumn("size", F.size("tokens"))
    return E.pack_boundaries(o, "doc_ord", "size", SEQ)


PACKED_SQL = ORDERED_SQL + f"""
, f AS (SELECT i AS sample_id, ord, t[greatest(i * {SEQ}, start) - start + 1 : least(i * {SEQ} + {SEQ}, start + sz - 1) - start + 1] AS frag
        FROM r, generate_series(CAST(greatest(ceil((start - {SEQ}) / {SEQ}.0), 0) AS BIGINT),
                                CAST(least(floor((start + sz - 1) / {SEQ}.0), floor((total - 1) / {SEQ}.0) - 1) AS BIGINT)) g(i)
        WHERE sz > 0),
ps AS (SELECT CAST(sample_id AS BIGINT) AS sample_id, flatten(list(frag ORDER BY ord)) AS tokens FROM f GROUP BY sample_id)
"""


@query("pack_samples", PACKED_SQL + f"SELECT sample_id, CAST(len(tokens) AS INTEGER) AS n_tokens, {Q.arr_str('tokens')} AS tokens FROM ps")
def q_pack_samples(spark, d):
    p = E.pack_samples(ordered_streams(spark, d), "doc_ord", "tokens", SEQ)
    return p.select("sample_id", F.size("tokens").cast("int").alias("n_tokens"), arr_str("tokens").alias("tokens"))


@query("packed_positions", PACKED_SQL + """
, e AS (SELECT sample_id, CAST(x.p - 1 AS INTEGER) AS pos, x.tk AS token FROM ps, unnest(ps.tokens) WITH ORDINALITY x(tk, p)),
s AS (SELECT *, CAST(coalesce(sum(CASE WHEN token = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS segment_id FROM e)
SELECT sample_id, pos, token, segment_id,
       CAST(row_number() OVER (PARTITION BY sample_id, segment_id ORDER BY pos) - 1 AS INTEGER) AS position_id,
       CAST(CASE WHEN token = 1 THEN 0 ELSE 1 END AS INTEGER) AS loss_mask
FROM s
""")
def q_packed_positions(spark, d):
    p = E.pack_samples(ordered_streams(spark, d), "doc_ord", "tokens", SEQ)
    return E.packed_positions(p)


def _tgt(k: str) -> str:
    u = sql_u(SEED, "0", "doc_id", k)
    r = int(round(1 / SHORT_P))
    return f"(CASE WHEN {u} % {r} = 0 THEN 2 + {u} % {MAX_LEN - 1} ELSE {MAX_LEN} END)"


BLOCKS_SQL = DOC_TOK.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, sz AS (SELECT doc_id, list(CAST(len(tokens) AS INTEGER) ORDER BY sent_pos) AS s FROM tok GROUP BY doc_id),
el AS (SELECT doc_id, s, len(s) AS n FROM sz WHERE len(s) >= {MIN_SENT} AND NOT (len(s) > 1 AND list_max(s) > 512)),
walk(doc_id, s, n, i, seq, ns, start, k, tgt, closed, bs, be, bt) AS (
  SELECT doc_id, s, n, 0, 0, 0, 0, 0, {_tgt('0')}, false, 0, 0, 0 FROM el
  UNION ALL
  SELECT doc_id, s, n, i + 1,
         CASE WHEN c THEN 0 ELSE seq2 END, CASE WHEN c THEN 0 ELSE ns2 END,
         CASE WHEN c THEN i + 1 ELSE start END, CASE WHEN c THEN k + 1 ELSE k END,
         CASE WHEN c THEN {_tgt('k + 1')} ELSE tgt END, c, start, i + 1, tgt
  FROM (SELECT *, seq + s[i + 1] AS seq2, ns + 1 AS ns2,
               ((seq + s[i + 1] >= tgt AND n - (i + 1) > 1 AND ns + 1 >= {MIN_SENT}) OR n - (i + 1) = 0) AS c
        FROM walk WHERE i < n) w
),
blocks AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS block, CAST(bs AS INTEGER) AS start_sent, CAST(be AS INTEGER) AS end_sent,
                  CAST(bt AS INTEGER) AS target FROM walk WHERE closed)
"""


def blocks(spark, d):
    tok = token_table(spark, d)
    return E.sentence_blocks(tok, "doc_id", MAX_LEN, MIN_SENT, SHORT_P, SEED)


@query("sentence_blocks", BLOCKS_SQL + "SELECT * FROM blocks")
def q_sentence_blocks(spark, d):
    return blocks(spark, d)


@query("short_targets", DOC_TOK + f"""
, k AS (SELECT DISTINCT doc_id, CAST(sent_pos AS INTEGER) AS k FROM tok)
SELECT doc_id, k, CAST({_tgt('k')} AS INTEGER) AS target FROM k
""")
def q_short_targets(spark, d):
    """E5 draws for block numbers 0..(sentences-1) of every document."""
    k = token_table(spark, d).select("doc_id", F.col("sent_pos").cast("int").alias("k")).distinct()
    return k.select("doc_id", "k", E.short_target(SEED, 0, F.col("doc_id"), F.col("k"), MAX_LEN, SHORT_P).alias("target"))


@query("epoch_limit", BLOCKS_SQL + """
, e AS (SELECT CAST(generate_series AS INTEGER) AS epoch FROM generate_series(0, CAST(greatest(ceil(5000.0 / (SELECT count(*) FROM blocks)) - 1, 0) AS BIGINT)))
SELECT doc_id, block, epoch FROM blocks, e
""")
def q_epoch_limit(spark, d):
    return E.epoch_limit(blocks(spark, d), 5000).select("doc_id", "block", "epoch")


PAIRS_SQL = BLOCKS_SQL + f"""
, bs AS (SELECT b.doc_id, b.block, list(t.tokens ORDER BY t.sent_pos) AS sents FROM blocks b JOIN tok t
           ON t.doc_id = b.doc_id AND t.sent_pos >= b.start_sent AND t.sent_pos < b.end_sent GROUP BY b.doc_id, b.block),
kp AS (SELECT *, concat_ws(':', doc_id, block) AS key, len(sents) AS n FROM bs WHERE len(sents) >= 2),
ae AS (SELECT *, 1 + {sql_u(SEED, 'key', "'a_end'")} % greatest(n - 1, 1) AS a_end, {sql_u(SEED, 'key', "'swap'")} % 2 = 1 AS sw FROM kp),
pr AS (SELECT doc_id, block, key, sw AS is_random,
              CASE WHEN sw THEN flatten(sents[a_end + 1:]) ELSE flatten(sents[1:a_end]) END AS ta,
              CASE WHEN sw THEN flatten(sents[1:a_end]) ELSE flatten(sents[a_end + 1:]) END AS tb FROM ae)
"""


def pairs(spark, d):
    tok = token_table(spark, d)
    b = E.block_sentences(blocks(spark, d), tok)
    return E.segment_pair(b, SEED, F.concat_ws(":", "doc_id", "block"))


@query("segment_pair", PAIRS_SQL + f"""
SELECT doc_id, block, is_random, {Q.arr_str('ta')} AS tokens_a, {Q.arr_str('tb')} AS tokens_b FROM pr
""")
def q_segment_pair(spark, d):
    p = pairs(spark, d)
    return p.select("doc_id", "block", "is_random", arr_str("tokens_a").alias("tokens_a"), arr_str("tokens_b").alias("tokens_b"))


TRUNC = MAX_LEN - 3


def trunc_sql(m=TRUNC) -> str:
    """CTEs of E9 over ``pr``; ``m`` is a number or a column of it."""
    la, lb = "len(ta)", "len(tb)"
    ex = f"({la} + {lb} - {m})"
    fa = f"(CASE WHEN {ex} <= 0 THEN {la} WHEN abs({la} - {lb}) >= {ex} THEN (CASE WHEN {la} > {lb} THEN {la} - {ex} ELSE {la} END) ELSE CAST(ceil({m} / 2.0) AS BIGINT) END)"
    fb = f"(CASE WHEN {ex} <= 0 THEN {lb} WHEN abs({la} - {lb}) >= {ex} THEN (CASE WHEN {la} > {lb} THEN {lb} ELSE {lb} - {ex} END) ELSE CAST(floor({m} / 2.0) AS BIGINT) END)"

    def cut(side, removed):
        return (f"coalesce(list_sum(list_transform(range(1, greatest({removed}, 0) + 1), "
                f"lambda j: {sql_u(SEED, 'key', repr(side), 'j')} % 2)), 0)")

    return f"""
, ln AS (SELECT *, {fa} AS fa, {fb} AS fb FROM pr),
ct AS (SELECT *, {cut('a', 'len(ta) - fa')} AS ca, {cut('b', 'len(tb) - fb')} AS cb FROM ln),
tr AS (SELECT doc_id, block, key, is_random, ta[ca + 1 : ca + fa] AS ta, tb[cb + 1 : cb + fb] AS tb FROM ct)
"""


@query("truncate_pair", PAIRS_SQL + trunc_sql() + f"""
SELECT doc_id, block, CAST(len(ta) AS INTEGER) AS len_a, CAST(len(tb) AS INTEGER) AS len_b,
       {Q.arr_str('ta')} AS tokens_a, {Q.arr_str('tb')} AS tokens_b FROM tr
""")
def q_truncate_pair(spark, d):
    t = E.truncate_pair(pairs(spark, d), SEED, F.concat_ws(":", "doc_id", "block"), TRUNC)
    return t.select("doc_id", "block", F.size("tokens_a").cast("int").alias("len_a"), F.size("tokens_b").cast("int").alias("len_b"),
                    arr_str("tokens_a").alias("tokens_a"), arr_str("tokens_b").alias("tokens_b"))


@query("tokens_and_types", PAIRS_SQL + trunc_sql() + f"""
SELECT doc_id, block, {Q.arr_str('[3] || ta || [4] || tb || [4]')} AS tokens,
       {Q.arr_str('list_transform(range(len(ta) + 2), lambda x: 0) || list_transform(range(len(tb) + 1), lambda x: 1)')} AS tokentypes
FROM tr
""")
def q_tokens_and_types(spark, d):
    t = E.truncate_pair(pairs(spark, d), SEED, F.concat_ws(":", "doc_id", "block"), TRUNC)
    x = E.tokens_and_types(t)
    return x.select("doc_id", "block", arr_str("tokens").alias("tokens"), arr_str("tokentypes").alias("tokentypes"))
