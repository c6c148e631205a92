"""Queries for mixtures (G0-G5) and batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions.hashing import sql_u
from corpuskit.operators import batching as J
from corpuskit.operators import mixtures as G
from corpuskit.operators import packing as E
from corpuskit.plans import sql_inputs as Q
from corpuskit.plans.inputs import arr_str, table
from corpuskit.plans.q_shards import RANKED, SEED, ranked_docs
from corpuskit.plans.q_tokens import DOC_TOK, token_table
from corpuskit.plans.registry import query

BLEND_W = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}
MIX_W = {"en": 0.5, "fr": 1.5, "de": 1.0, "es": 2.0}


def _wvalues(w: dict, with_index: bool = True) -> str:
    n = G.normalise_weights(w) if with_index else w
    rows = [f"('{k}', CAST({n[k]!r} AS DOUBLE), {i})" for i, k in enumerate(sorted(n))]
    return "(VALUES " + ", ".join(rows) + ") t(lang, w, si)"


RANK_IN_LANG = "r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents)"


def ranked_in_lang(spark, d):
    return G.rank_within_sets(table(spark, d, "documents", "doc_id", "lang"), "lang", "doc_id", n_buckets=8)


BLEND_SQL = f"""WITH {RANK_IN_LANG},
w AS (SELECT * FROM {_wvalues(BLEND_W)}),
z AS (SELECT lang, w, si, len, CAST(ceil(w * n - 0.5) AS BIGINT) AS slots FROM (SELECT lang, count(*) AS len FROM r GROUP BY lang) JOIN w USING (lang), (SELECT count(*) AS n FROM r JOIN w USING (lang))),
v AS (SELECT doc_id, lang, r.k + j * len AS k, (CAST(r.k + j * len AS DOUBLE) + 0.5) / w AS vt, si FROM r JOIN z USING (lang), generate_series(0, CAST(floor((slots - 1 - r.k) / len) AS BIGINT)) g(j) WHERE r.k < slots),
b AS (SELECT doc_id, lang, k, row_number() OVER (ORDER BY vt, si) - 1 AS pos FROM v)
"""


@query("blend", BLEND_SQL + "SELECT doc_id, lang, k, pos FROM b")
def q_blend(spark, d):
    return G.blend(ranked_in_lang(spark, d), "lang", BLEND_W).select("doc_id", "lang", "k", "pos")


@query("mixture", f"""WITH {RANK_IN_LANG},
s AS (SELECT lang, count(*) AS len FROM documents GROUP BY lang),
w AS (SELECT lang, w FROM {_wvalues(MIX_W, False)}),
z AS (SELECT lang, len, CAST(ceil(w * len) AS BIGINT) AS size FROM s JOIN w USING (lang))
SELECT r.doc_id, r.lang, r.k AS r, r.k + j * z.len AS k
FROM r JOIN z USING (lang), generate_series(0, CAST(floor((size - 1 - r.k) / len) AS BIGINT)) g(j) WHERE r.k < size
""")
def q_mixture(spark, d):
    r = ranked_in_lang(spark, d)
    sizes = table(spark, d, "documents", "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("len"))
    return G.mixture(r, "lang", MIX_W, sizes).select("doc_id", "lang", "r", "k")


@query("mixture_rates", """
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
r AS (SELECT lang, pow(CAST(least(n * 1.0, 300.0) AS DOUBLE), 0.5) AS rate FROM c)
SELECT lang, round(rate, 6) AS rate, round(rate / sum(rate) OVER (), 6) AS share FROM r
""")
def q_mixture_rates(spark, d):
    c = table(spark, d, "documents", "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    r = G.mixture_rates(c, "lang", "n", scale=1.0, maximum=300, temperature=2.0)
    return r.select("lang", F.round("rate", 6).alias("rate"), F.round("share", 6).alias("share"))


@query("achieved_ratios", BLEND_SQL + """
, c AS (SELECT lang, count(*) AS c FROM b GROUP BY lang)
SELECT lang, round(w, 6) AS requested, round(c / sum(c) OVER (), 6) AS achieved FROM (SELECT * FROM (SELECT * FROM """ + _wvalues(BLEND_W) + """)) w LEFT JOIN c USING (lang)
""")
def q_achieved_ratios(spark, d):
    b = G.blend(ranked_in_lang(spark, d), "lang", BLEND_W)
    a = G.achieved_ratios(b, "lang", BLEND_W)
    return a.select("lang", F.round("requested", 6).alias("requested"), F.round("achieved", 6).alias("achieved"))


@query("concat_sets", """
SELECT 'documents' AS source, doc_id AS id, text FROM documents
UNION ALL SELECT 'benchmark', item_id, text FROM benchmark
UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations
""")
def q_concat_sets(spark, d):
    a = table(spark, d, "documents", "doc_id", "text").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    b = table(spark, d, "benchmark", "item_id", "text").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("id"), "text")
    c = table(spark, d, "conversations", "conv_id", "turn", "text").select(
        F.lit("conversations").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return G.concat_sets(a, b, c)


# --- batching ---------------------------------------------------------------

@query("sequential_batches", f"""WITH {RANKED}
SELECT doc_id, CAST(floor((pos - 40) / 32) AS BIGINT) AS batch, CAST(floor(((pos - 40) % 32) / 4) AS INTEGER) AS worker
FROM ranked WHERE pos >= 40 AND (floor((pos - 40) / 32) + 1) * 32 <= (SELECT count(*) FROM documents) - 40
""")
def q_sequential_batches(spark, d):
    return J.sequential_batches(ranked_docs(spark, d), 40, 4, 8).select("doc_id", "batch", "worker")


def _cyclic_sql(sharded: bool) -> str:
    consumed, micro, workers = 64, 4, 8
    mw = micro * workers
    n = "(SELECT count(*) FROM documents)"
    active = f"({n} - {n} % {mw})"
    epoch = f"({consumed} // {active})"
    cur = f"({consumed} % {active})"
    if sharded:
        bsize = f"(({n} // {mw}) * {micro})"
        off = f"({cur} // {workers})"
        return f"""
WITH p AS (SELECT x, row_number() OVER (ORDER BY {sql_u(SEED, epoch, 'x')}, x) - 1 AS rank FROM generate_series(0, {bsize} - 1) t(x)),
ws AS (SELECT CAST(w AS INTEGER) AS worker FROM range({workers}) t(w))
SELECT worker, CAST((rank - {off}) // {micro} AS BIGINT) AS step, worker * {bsize} + x AS idx
FROM p, ws WHERE rank >= {off} AND rank - {off} < floor(({bsize} - {off}) / {micro}) * {micro}
"""
    fsize = f"(({n} // {micro}) * {micro})"
    return f"""
WITH p AS (SELECT x, row_number() OVER (ORDER BY {sql_u(SEED, epoch, 'x')}, x) - 1 AS rank FROM generate_series(0, {fsize} - 1) t(x)),
a AS (SELECT x, rank - {cur} AS a FROM p WHERE rank >= {cur}),
b AS (SELECT x, CAST(a % {workers} AS INTEGER) AS worker, a // {workers} AS j FROM a),
c AS (SELECT *, count(*) OVER (PARTITION BY worker) AS c FROM b)
SELECT worker, CAST(j // {micro} AS BIGINT) AS step, x AS idx FROM c WHERE j < floor(c / {micro}) * {micro}
"""


@query("cyclic_batches_sharded", _cyclic_sql(True))
def q_cyclic_batches_sharded(spark, d):
    return J.cyclic_batches(table(spark, d, "documents", "doc_id"), 64, 4, 8, SEED, data_sharding=True)


@query("cyclic_batches", _cyclic_sql(False))
def q_cyclic_batches(spark, d):
    return J.cyclic_batches(table(spark, d, "documents", "doc_id"), 64, 4, 8, SEED, data_sharding=False)


@query("distributed_order", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_u(SEED, '3', 'doc_id')}, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents),
s AS (SELECT doc_id, r AS s FROM r UNION ALL SELECT doc_id, r + n FROM r WHERE r < ceil(n / 7.0) * 7 - n)
SELECT CAST(s % 7 AS INTEGER) AS worker, CAST(floor(s / 7) AS BIGINT) AS step, doc_id FROM s
""")
def q_distributed_order(spark, d):
    return J.distributed_order(table(spark, d, "documents", "doc_id"), "doc_id", 7, SEED, 3, drop_last=False)


@query("batches_with_remainder", f"WITH {RANKED} SELECT doc_id, CAST(floor(pos / 64) AS BIGINT) AS batch FROM ranked")
def q_batches_with_remainder(spark, d):
    return J.batches_with_remainder(ranked_docs(spark, d), 64).select("doc_id", "batch")


@query("skip_batches", f"WITH {RANKED} SELECT doc_id, CAST(floor(pos / 64) AS BIGINT) AS batch FROM ranked WHERE floor(pos / 64) >= 3")
def q_skip_batches(spark, d):
    return J.skip_batches(J.batches_with_remainder(ranked_docs(spark, d), 64), 3).select("doc_id", "batch")


PAD_SQL = DOC_TOK + f"""
, ds AS (SELECT doc_id, flatten(list(tokens ORDER BY sent_pos)) AS t FROM tok GROUP BY doc_id),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_u(SEED, 'doc_id')}, doc_id) - 1 AS pos FROM documents),
bt AS (SELECT ds.doc_id, CAST(floor(rk.pos / 16) AS BIGINT) AS batch, ds.t[1:512] AS t FROM ds JOIN rk USING (doc_id)),
pd AS (SELECT *, CAST(ceil(max(len(t)) OVER (PARTITION BY batch) / 64.0) * 64 AS INTEGER) AS L FROM bt),
pp AS (SELECT doc_id, batch, t || list_transform(range(L - len(t)), lambda x: 0) AS input_ids,
              list_transform(range(len(t)), lambda x: 1) || list_transform(range(L - len(t)), lambda x: 0) AS attention_mask FROM pd)
"""


def padded(spark, d):
    streams = E.doc_streams(token_table(spark, d))
    r = ranked_docs(spark, d).select("doc_id", "pos")
    b = J.batches_with_remainder(streams.join(r, "doc_id"), 16)
    return J.pad_batch(b, "tokens", "batch", max_len=512, multiple=64)


@query("pad_batch", PAD_SQL + f"""
SELECT doc_id, batch, CAST(len(input_ids) AS INTEGER) AS n_input, CAST(list_sum(attention_mask) AS BIGINT) AS n_attended,
       {Q.arr_str('input_ids')} AS input_ids FROM pp
""")
def q_pad_batch(spark, d):
    p = padded(spark, d)
    return p.select("doc_id", "batch", F.size("input_ids").cast("int").alias("n_input"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_attended"),
                    arr_str("input_ids").alias("input_ids"))


@query("labels_ignore_pad", PAD_SQL + f"""
SELECT doc_id, {Q.arr_str('list_transform(input_ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)')} AS labels FROM pp
""")
def q_labels_ignore_pad(spark, d):
    p = padded(spark, d)
    return p.select("doc_id", arr_str(J.labels_ignore_pad("input_ids")).alias("labels"))


@query("prompt_batch", DOC_TOK + f"""
, pr AS (SELECT doc_id, [1] || tokens AS t FROM tok WHERE sent_pos = 0),
m AS (SELECT max(len(t)) AS m FROM pr)
SELECT doc_id, CAST(len(t) AS INTEGER) AS length, {Q.arr_str('t || list_transform(range(m + 16 - len(t)), lambda x: 1)')} AS tokens FROM pr, m
""")
def q_prompt_batch(spark, d):
    p = token_table(spark, d).filter(F.col("sent_pos") == 0).select("doc_id", "tokens")
    b = J.prompt_batch(p, "tokens", 16, add_leading_eod=True)
    return b.select("doc_id", "length", arr_str("tokens").alias("tokens"))
