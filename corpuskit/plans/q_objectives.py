"""Queries for objectives (F1-F25) over the token table (one sentence = one example)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corpuskit.functions import specials as S
from corpuskit.functions.hashing import sql_u, sql_unit
from corpuskit.operators import objectives as O
from corpuskit.operators import packing as E
from corpuskit.plans import sql_inputs as Q
from corpuskit.plans.inputs import arr_str
from corpuskit.plans.q_shards import ranked_docs
from corpuskit.plans.q_tokens import DOC_TOK, token_table
from corpuskit.plans.registry import query

SEED = 1234
DENS = 0.15
KEYS = ["doc_id", "sent_pos"]
VOCAB = 32100

LONG = DOC_TOK + """
, e AS (SELECT doc_id, sent_pos, CAST(x.p - 1 AS INTEGER) AS pos, x.t AS token, len(tok.tokens) AS n FROM tok, unnest(tok.tokens) WITH ORDINALITY x(t, p))"""
IID = LONG + f""", nz AS (SELECT *, {sql_u(SEED, 'doc_id', 'sent_pos', 'pos')} < {DENS} * 4294967296.0 AS noise FROM e)"""


def long_tokens(spark, d, arrays=False):
    return O.explode_tokens(token_table(spark, d), KEYS, arrays=arrays)


def iid(spark, d, arrays=True):
    return O.noise_iid(long_tokens(spark, d, arrays), KEYS, DENS, SEED)


def _mask_sql(src: str) -> str:
    return f"""SELECT doc_id, sent_pos, string_agg(CASE WHEN noise THEN '1' ELSE '0' END, '' ORDER BY pos) AS mask FROM {src} GROUP BY ALL"""


def _mask(long):
    g = O._regroup(long, KEYS, F.when(F.col("noise"), F.lit("1")).otherwise(F.lit("0")), F.lit(True), "m")
    return g.select(*KEYS, F.array_join("m", "").alias("mask"))


@query("noise_iid", IID + "\n" + _mask_sql("nz"))
def q_noise_iid(spark, d):
    return _mask(iid(spark, d, arrays=False))


REG_SQL = LONG + f"""
, rl AS (SELECT *, 1 + {sql_u(SEED, 'doc_id', 'sent_pos', "'span'")} % 5 AS l FROM e),
rp AS (SELECT *, greatest(l, CAST(round(l / {DENS}) AS BIGINT)) AS per FROM rl),
nz AS (SELECT *, (pos + {sql_u(SEED, 'doc_id', 'sent_pos', "'offset'")} % per) % per < l AS noise FROM rp)
"""


@query("noise_regular", REG_SQL + _mask_sql("nz"))
def q_noise_regular(spark, d):
    return _mask(O.noise_regular(long_tokens(spark, d), KEYS, 1, 5, DENS, SEED))


@query("noise_prefix", LONG + f", nz AS (SELECT *, pos >= 1 + {sql_u(SEED, 'doc_id', 'sent_pos')} % greatest(n - 1, 1) AS noise FROM e)\n" + _mask_sql("nz"))
def q_noise_prefix(spark, d):
    return _mask(O.noise_prefix(long_tokens(spark, d), KEYS, SEED))


def _list(value: str, where: str, src: str, out: str) -> str:
    return (f"{out} AS (SELECT doc_id, sent_pos, coalesce(array_to_string(list(CAST({value} AS VARCHAR) ORDER BY pos) "
            f"FILTER (WHERE {where}), ' '), '') AS {out} FROM {src} GROUP BY ALL)")


SPANS = IID + f"""
, sp AS (SELECT *, noise AND NOT coalesce(lag(noise) OVER (PARTITION BY doc_id, sent_pos ORDER BY pos), false) AS st FROM nz),
sk AS (SELECT *, sum(CAST(st AS INTEGER)) OVER (PARTITION BY doc_id, sent_pos ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS span FROM sp),
kp AS (SELECT *, NOT noise AND NOT coalesce(lag(NOT noise) OVER (PARTITION BY doc_id, sent_pos ORDER BY pos), false) AS st2 FROM nz),
kk AS (SELECT *, sum(CAST(st2 AS INTEGER)) OVER (PARTITION BY doc_id, sent_pos ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS span2 FROM kp),
{_list(f'CASE WHEN noise THEN {S.SENTINEL_TOP} - span ELSE token END', 'NOT noise OR st', 'sk', 'inputs')},
{_list(f'CASE WHEN NOT noise THEN {S.SENTINEL_TOP} - span2 ELSE token END', 'noise OR st2', 'kk', 'targets')}
"""


def _strs(df, *cols):
    return df.select(*KEYS, *[arr_str(c).alias(c) for c in cols])


@query("spans_to_sentinels", SPANS + "SELECT doc_id, sent_pos, inputs, targets FROM inputs JOIN targets USING (doc_id, sent_pos)")
def q_spans_to_sentinels(spark, d):
    return _strs(O.spans_to_sentinels(iid(spark, d, arrays=False), KEYS), "inputs", "targets")


@query("tokens_to_sentinel", IID + f""",
{_list(f'CASE WHEN noise THEN {S.SENTINEL_TOP} ELSE token END', 'true', 'nz', 'inputs')},
{_list('token', 'true', 'nz', 'targets')}
SELECT doc_id, sent_pos, inputs, targets FROM inputs JOIN targets USING (doc_id, sent_pos)""")
def q_tokens_to_sentinel(spark, d):
    return _strs(O.tokens_to_sentinel(iid(spark, d), KEYS), "inputs", "targets")


U_R = sql_u(SEED, "doc_id", "sent_pos", "pos", "'r'")
U_ID = sql_u(SEED, "doc_id", "sent_pos", "pos", "'id'")


@query("tokens_to_random_or_sentinel", IID + f""",
{_list(f'CASE WHEN noise AND {U_R} < 0.1 * 4294967296.0 THEN {S.FIRST_WORD_ID} + {U_ID} % {VOCAB - S.FIRST_WORD_ID} WHEN noise THEN {S.SENTINEL_TOP} ELSE token END', 'true', 'nz', 'inputs')}
SELECT * FROM inputs""")
def q_tokens_to_random_or_sentinel(spark, d):
    return _strs(O.tokens_to_random_or_sentinel(iid(spark, d), KEYS, SEED, VOCAB), "inputs")


@query("drop_noise", IID + f", {_list('token', 'NOT noise', 'nz', 'inputs')} SELECT * FROM inputs")
def q_drop_noise(spark, d):
    return _strs(O.drop_noise(iid(spark, d), KEYS, "noise"), "inputs")


@query("drop_nonnoise", IID + f", {_list('token', 'noise', 'nz', 'inputs')} SELECT * FROM inputs")
def q_drop_nonnoise(spark, d):
    return _strs(O.drop_noise(iid(spark, d), KEYS, "nonnoise"), "inputs")


@query("permute_noise", IID + f"""
, sl AS (SELECT doc_id, sent_pos, pos, row_number() OVER (PARTITION BY doc_id, sent_pos ORDER BY pos) AS r FROM nz WHERE noise),
sr AS (SELECT doc_id, sent_pos, token AS t2, row_number() OVER (PARTITION BY doc_id, sent_pos ORDER BY {sql_u(SEED, 'doc_id', 'sent_pos', 'pos')}, pos) AS r FROM nz WHERE noise),
mv AS (SELECT sl.doc_id, sl.sent_pos, sl.pos, sr.t2 FROM sl JOIN sr USING (doc_id, sent_pos, r)),
j AS (SELECT nz.*, mv.t2 FROM nz LEFT JOIN mv USING (doc_id, sent_pos, pos)),
{_list('coalesce(t2, token)', 'true', 'j', 'inputs')}
SELECT * FROM inputs""")
def q_permute_noise(spark, d):
    return _strs(O.permute_noise(iid(spark, d), KEYS, SEED), "inputs")


@query("random_chunk", DOC_TOK + f"""
, c AS (SELECT doc_id, sent_pos, tokens, ({sql_u(SEED, 'doc_id', 'sent_pos')} % greatest(CAST(ceil(len(tokens) / 8.0) AS BIGINT), 1)) * 8 AS st FROM tok)
SELECT doc_id, sent_pos, {Q.arr_str('tokens[st + 1 : st + 8]')} AS tokens FROM c""")
def q_random_chunk(spark, d):
    return _strs(O.random_chunk(token_table(spark, d), KEYS, "tokens", 8, SEED), "tokens")


@query("concat_groups", DOC_TOK + f"""
, ds AS (SELECT doc_id, flatten(list(tokens ORDER BY sent_pos)) AS t FROM tok GROUP BY doc_id),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_u(SEED, 'doc_id')}, doc_id) - 1 AS pos FROM documents)
SELECT CAST(floor(pos / 128) AS BIGINT) AS "group", CAST(len(flatten(list(t ORDER BY pos))) AS INTEGER) AS n_tokens,
       {Q.arr_str('flatten(list(t ORDER BY pos))')} AS tokens FROM ds JOIN rk USING (doc_id) GROUP BY 1""")
def q_concat_groups(spark, d):
    s = E.doc_streams(token_table(spark, d)).join(ranked_docs(spark, d).select("doc_id", "pos"), "doc_id")
    g = O.concat_groups(s, "pos", "tokens", 128)
    return g.select("group", F.size("tokens").cast("int").alias("n_tokens"), arr_str("tokens").alias("tokens"))


@query("split_fixed", DOC_TOK + f"""
SELECT doc_id, sent_pos, CAST(i AS INTEGER) AS piece, {Q.arr_str('tokens[i * 16 + 1 : i * 16 + 16]')} AS tokens
FROM tok, generate_series(0, CAST(greatest(ceil(len(tokens) / 16.0), 1) AS BIGINT) - 1) g(i)""")
def q_split_fixed(spark, d):
    s = O.split_fixed(token_table(spark, d), KEYS, "tokens", 16)
    return s.select(*KEYS, F.col("piece").cast("int"), arr_str("tokens").alias("tokens"))


SPLIT_LO, SPLIT_HI = 4, 64


@query("split_random", DOC_TOK + f"""
, l AS (SELECT doc_id, sent_pos, tokens, greatest(CAST(floor(exp({math.log(SPLIT_LO)!r} + {sql_unit(SEED, 'doc_id', 'sent_pos', "'split'")} * {math.log(SPLIT_HI) - math.log(SPLIT_LO)!r})) AS INTEGER), {SPLIT_LO}) AS l FROM tok)
SELECT doc_id, sent_pos, CAST(i AS INTEGER) AS piece, {Q.arr_str('tokens[i * l + 1 : i * l + l]')} AS tokens
FROM l, generate_series(0, CAST(greatest(ceil(len(tokens) / CAST(l AS DOUBLE)), 1) AS BIGINT) - 1) g(i)""")
def q_split_random(spark, d):
    s = O.split_random(token_table(spark, d), KEYS, "tokens", SPLIT_LO, SPLIT_HI, SEED)
    return s.select(*KEYS, F.col("piece").cast("int"), arr_str("tokens").alias("tokens"))


@query("noise_random_spans", DOC_TOK + f"""
, b0 AS (SELECT doc_id, sent_pos, concat_ws(':', doc_id, sent_pos) AS key, len(tokens) AS n FROM tok),
b1 AS (SELECT *, CAST(least(greatest(round_even(n * {DENS}, 0), 1), n - 1) AS BIGINT) AS nn FROM b0),
b2 AS (SELECT *, least(CAST(greatest(round_even(nn / 3.0, 0), 1) AS BIGINT), nn, n - nn) AS ns FROM b1),
sd AS (SELECT key, 'keep' AS side, n - nn AS total, ns FROM b2 WHERE n >= 2 UNION ALL SELECT key, 'noise', nn, ns FROM b2 WHERE n >= 2),
ct AS (SELECT key, side, ns, i, row_number() OVER (PARTITION BY key, side ORDER BY {sql_u(SEED, 'key', 'side', 'i')}, i) AS r FROM (SELECT *, unnest(range(1, total)) AS i FROM sd) x),
cl AS (SELECT key, side, list(i) AS cuts FROM ct WHERE r < ns GROUP BY key, side),
sg AS (SELECT key, side, list_sort([0, total] || coalesce(cuts, [])) AS bd FROM sd LEFT JOIN cl USING (key, side)),
ln AS (SELECT key, side, list_transform(range(1, len(bd)), lambda j: bd[j + 1] - bd[j]) AS lens FROM sg),
mk AS (SELECT k.key, array_to_string(list_transform(range(1, len(k.lens) + 1), lambda j: repeat('0', k.lens[j]) || repeat('1', z.lens[j])), '') AS mask
       FROM ln k JOIN ln z ON z.key = k.key AND z.side = 'noise' WHERE k.side = 'keep')
SELECT doc_id, sent_pos, coalesce(mask, repeat('0', n)) AS mask FROM b2 LEFT JOIN mk USING (key)""")
def q_noise_random_spans(spark, d):
    """F14 masks."""
    m = O.noise_random_spans(token_table(spark, d), KEYS, DENS, 3.0, SEED)
    return m.select(*KEYS, F.array_join(F.transform("noise", lambda x: F.when(x, "1").otherwise("0")), "").alias("mask"))


@query("t5_pretraining_batches", SPANS + f"""
, io AS (SELECT doc_id, sent_pos, string_split(inputs || ' {S.EOD}', ' ') AS i, string_split(targets || ' {S.EOD}', ' ') AS t
         FROM inputs JOIN targets USING (doc_id, sent_pos)),
pt AS (SELECT doc_id, sent_pos, list_transform(i, lambda x: CAST(x AS INTEGER)) AS i, list_transform(t, lambda x: CAST(x AS INTEGER)) AS t FROM io),
pp AS (SELECT doc_id, sent_pos, i[1:64] || list_transform(range(greatest(64 - len(i), 0)), lambda x: 0) AS ii,
              t[1:16] || list_transform(range(greatest(16 - len(t), 0)), lambda x: 0) AS tt FROM pt)
SELECT doc_id, sent_pos, {Q.arr_str('ii')} AS input_ids,
       {Q.arr_str('list_transform(ii, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)')} AS attention_mask,
       {Q.arr_str('list_transform(tt, lambda x: CASE WHEN x <> 0 THEN x ELSE -100 END)')} AS labels FROM pp""")
def q_t5_pretraining_batches(spark, d):
    s = O.spans_to_sentinels(iid(spark, d, arrays=False), KEYS)
    s = s.withColumn("inputs", F.concat("inputs", F.array(F.lit(S.EOD)))).withColumn("targets", F.concat("targets", F.array(F.lit(S.EOD))))
    b = O.t5_batch_columns(s, "inputs", "targets", 64, 16)
    return _strs(b, "input_ids", "attention_mask", "labels")
