"""Queries for sentences, words, vocabulary and token tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import specials as S
from corpuskit.functions import text as T
from corpuskit.operators import cleaning as C
from corpuskit.operators import tokens as K
from corpuskit.plans import sql_inputs as Q
from corpuskit.plans.inputs import arr_str, articles_raw, dialog_turns, table
from corpuskit.plans.registry import query
from corpuskit.session import written


def encode_cte(src: str, key: str = "doc_id", text: str = "text", name: str = "tok") -> str:
    """DuckDB text of ``encode_corpus`` over CTE ``src`` (needs ``vocab``)."""
    return f"""
{name}_s AS (SELECT {key}, list_filter(list_transform({Q.sentences_of(text)}, lambda s: {Q.basic_tokens('s')}), lambda ws: len(ws) > 0) AS ss FROM {src}),
{name}_e AS (SELECT {key}, len(ss) AS ns, CAST(u.i - 1 AS INTEGER) AS sent_pos, u.w FROM {name}_s, unnest({name}_s.ss) WITH ORDINALITY AS u(w, i)),
{name}_w AS (SELECT {key}, sent_pos, sent_pos = ns - 1 AS is_last, x.word, x.wp FROM {name}_e, unnest({name}_e.w) WITH ORDINALITY AS x(word, wp)),
{name}_g AS (SELECT {key}, sent_pos, is_last, list(coalesce(v.id, {S.UNK}) ORDER BY wp) AS t
             FROM {name}_w LEFT JOIN vocab v USING (word) GROUP BY {key}, sent_pos, is_last),
{name} AS (SELECT {key}, sent_pos, CASE WHEN is_last THEN list_append(t, {S.EOD}) ELSE t END AS tokens FROM {name}_g)
"""


def vocab(spark, d, counts=False):
    return K.build_word_vocab(table(spark, d, "documents", "text"), counts=counts)


def token_table(spark, d):
    """The encoded corpus, written: queries built on it branch (totals, prefix
    offsets, joins), and without a cut each branch would re-run vocabulary and encoding.
    Texts are tokenized once, for the vocabulary and for their ids."""
    return written(encoded(spark, d)[0], "token-table")


def encoded(spark, d):
    """Token table and vocabulary of the documents, from one pass over their texts."""
    docs = table(spark, d, "documents", "doc_id", "text")
    lines = written(K.tokenized(docs), "tokenized")
    v = K.build_word_vocab(docs, counts=True, lines=lines)
    return K.encode_corpus(docs, v, lines=lines), v


DOC_TOK = "WITH " + Q.VOCAB_CTE + "," + encode_cte("documents")


@query("split_sentences", f"""
SELECT doc_id, CAST(u.i - 1 AS INTEGER) AS sent_pos, u.s AS sentence
FROM documents, unnest({Q.sentences_of('text')}) WITH ORDINALITY AS u(s, i)
""")
def q_split_sentences(spark, d):
    return K.split_sentences(table(spark, d, "documents", "doc_id", "text")).withColumn("sent_pos", F.col("sent_pos").cast("int"))


@query("split_sentences_keep_newlines", f"""
SELECT doc_id, CAST(u.i - 1 AS INTEGER) AS sent_pos, u.s AS sentence
FROM documents, unnest({Q.sentences_keep_ws('text')}) WITH ORDINALITY AS u(s, i)
""")
def q_split_sentences_keep_newlines(spark, d):
    df = K.split_sentences(table(spark, d, "documents", "doc_id", "text"), keep_ws=True)
    return df.withColumn("sent_pos", F.col("sent_pos").cast("int"))


@query("sentence_lines", "WITH " + Q.TURNS_CTE + f"""
, j AS (SELECT conv_id, replace(replace(string_agg(utterance, ' ' ORDER BY turn), '<speaker1>', '<speaker1> '), '<speaker2>', '<speaker2> ') AS text
        FROM turns GROUP BY conv_id)
SELECT conv_id, CAST(u.i - 1 AS INTEGER) AS sent_pos, u.s AS sentence
FROM j, unnest({Q.sentences_of('text')}) WITH ORDINALITY AS u(s, i) WHERE length(j.text) > 0
""")
def q_sentence_lines(spark, d):
    dia = C.flatten_dialogs(dialog_turns(spark, d))
    return K.sentence_lines(dia).withColumn("sent_pos", F.col("sent_pos").cast("int"))


@query("basic_tokenize", f"""
SELECT item_id, array_to_string({Q.basic_tokens('text')}, ' ') AS tokens FROM benchmark
""")
def q_basic_tokenize(spark, d):
    b = table(spark, d, "benchmark", "item_id", "text")
    return b.select("item_id", F.array_join(T.basic_tokens("text"), " ").alias("tokens"))


@query("word_counts", f"""
SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({Q.basic_tokens('text')}) AS word FROM documents) GROUP BY word
""")
def q_word_counts(spark, d):
    return K.word_counts(table(spark, d, "documents", "doc_id", "text"))


@query("ids_from_tokens", "WITH " + Q.VOCAB_CTE + " SELECT word, id FROM vocab")
def q_ids_from_tokens(spark, d):
    return vocab(spark, d)


@query("tokens_from_ids", DOC_TOK + """
, e AS (SELECT doc_id, sent_pos, x.id, x.p FROM tok, unnest(tok.tokens) WITH ORDINALITY AS x(id, p))
SELECT doc_id, sent_pos, array_to_string(list(coalesce(v.word, '[UNK]') ORDER BY p), ' ') AS words
FROM e LEFT JOIN vocab v USING (id) GROUP BY doc_id, sent_pos
""")
def q_tokens_from_ids(spark, d):
    tok, v = encoded(spark, d)
    back = K.tokens_from_ids(tok, v, ["doc_id", "sent_pos"])
    return back.select("doc_id", "sent_pos", F.array_join("words", " ").alias("words"))


@query("encode_corpus", DOC_TOK + f"""
SELECT doc_id, sent_pos, CAST(len(tokens) AS INTEGER) AS n_tokens, {Q.arr_str('tokens')} AS tokens FROM tok
""")
def q_encode_corpus(spark, d):
    t = token_table(spark, d)
    return t.select("doc_id", "sent_pos", "n_tokens", arr_str("tokens").alias("tokens"))


_STATS_SQL = """
, pd AS (SELECT doc_id, {g} count(*) AS ns, sum(len(tokens)) AS nt, max(len(tokens)) AS mx FROM {t} GROUP BY ALL)
SELECT {g} CAST(count(*) AS BIGINT) AS documents, CAST(sum(ns) AS BIGINT) AS sentences, CAST(sum(nt) AS BIGINT) AS tokens,
       CAST(sum(CASE WHEN ns = 1 THEN 1 ELSE 0 END) AS BIGINT) AS one_sentence_docs,
       CAST(sum(CASE WHEN mx > 512 THEN 1 ELSE 0 END) AS BIGINT) AS long_sentence_docs
FROM pd GROUP BY ALL
"""


@query("token_stats", DOC_TOK + _STATS_SQL.format(g="", t="tok"))
def q_token_stats(spark, d):
    return K.token_stats(token_table(spark, d))


FLAG_SQL = ("WITH " + Q.ARTICLES_CTE + ", " + Q.VOCAB_CTE + f"""
, clean AS (SELECT doc_id, lang, {Q.clean_body('text')} AS text, {Q.title_of('text')} AS title FROM articles),
kept AS (SELECT doc_id, lang, text FROM clean WHERE NOT starts_with(title, 'List of') AND strpos(text, title || ' may refer to:') = 0),
""" + encode_cte("kept") + """
, tl AS (SELECT tok.*, kept.lang FROM tok JOIN kept USING (doc_id))
""" + _STATS_SQL.format(g="lang,", t="tl"))


def flagship(spark, d):
    """clean_articles -> split_sentences -> encode_corpus -> token_stats by language."""
    arts = C.clean_articles(articles_raw(spark, d)).select("doc_id", "lang", "text")
    v = vocab(spark, d, counts=True)
    tok = K.encode_corpus(arts, v)
    langs = arts.select("doc_id", "lang")
    return K.token_stats(tok.join(langs, "doc_id"), group=["lang"])


query("flagship_token_stats", FLAG_SQL)(flagship)


@query("length_profile", """
SELECT lang, CAST(min(n_chars) AS BIGINT) AS min_len, CAST(max(n_chars) AS BIGINT) AS max_len, round(avg(n_chars), 6) AS mean_len,
       round(quantile_cont(n_chars, 0.5), 6) AS median_len, round(quantile_cont(n_chars, 0.9), 6) AS q90_len,
       round(avg(CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0.0 END), 6) AS share_above
FROM documents GROUP BY lang
""")
def q_length_profile(spark, d):
    return K.length_profile(table(spark, d, "documents", "lang", "n_chars"), "n_chars", 2000, ["lang"])


@query("vocab_consistency", """
WITH a AS (SELECT * FROM (VALUES ('pad', 0), ('eos', 1), ('unk', 2)) t(token, id)),
b AS (SELECT token, CAST(CASE WHEN token = 'unk' THEN (SELECT count(DISTINCT lang) FROM documents) ELSE id END AS INTEGER) AS id FROM a)
SELECT token, a.id AS id_a, b.id AS id_b FROM a FULL OUTER JOIN b USING (token) WHERE a.id IS DISTINCT FROM b.id
""")
def q_vocab_consistency(spark, d):
    """Reserved ids of our vocabulary vs a second vocabulary whose unk id is derived from the data."""
    a = spark.createDataFrame([("pad", S.PAD), ("eos", S.EOD), ("unk", S.UNK)], "token string, id int")
    nl = table(spark, d, "documents", "lang").agg(F.countDistinct("lang").cast("int").alias("nl"))
    b = a.crossJoin(nl).select("token", F.when(F.col("token") == "unk", F.col("nl")).otherwise(F.col("id")).alias("id"))
    return K.vocab_consistency(a, b).select("token", "id_a", "id_b")


@query("token_slice", DOC_TOK + f"""
SELECT doc_id, sent_pos, {Q.arr_str('tokens[2:4]')} AS tokens FROM tok
""")
def q_token_slice(spark, d):
    t = K.token_slice(token_table(spark, d), offset=1, length=3)
    return t.select("doc_id", "sent_pos", arr_str("tokens").alias("tokens"))


@query("sentence_range", DOC_TOK + f"""
SELECT doc_id, {Q.arr_str('flatten(list(tokens ORDER BY sent_pos))')} AS tokens FROM tok WHERE sent_pos >= 1 AND sent_pos < 3 GROUP BY doc_id
""")
def q_sentence_range(spark, d):
    t = K.sentence_range(token_table(spark, d), "doc_id", 1, 3)
    return t.select("doc_id", arr_str("tokens").alias("tokens"))


@query("merge_token_tables", DOC_TOK + """
, a AS (SELECT doc_id, sent_pos, tokens FROM tok),
b AS (SELECT doc_id, sent_pos, tokens FROM tok),
m AS (SELECT * FROM a UNION ALL SELECT doc_id + (SELECT coalesce(max(doc_id), -1) + 1 FROM a), sent_pos, tokens FROM b)
SELECT doc_id, sent_pos, CAST(len(tokens) AS INTEGER) AS n_tokens FROM m
""")
def q_merge_token_tables(spark, d):
    """The token table appended to itself: the second copy's ids are re-based."""
    t = token_table(spark, d).select("doc_id", "sent_pos", "tokens")
    m = K.merge_token_tables(t, t)
    return m.select("doc_id", "sent_pos", F.size("tokens").cast("int").alias("n_tokens"))


@query("cut_at_eod", DOC_TOK + f"""
, dt AS (SELECT doc_id, flatten(list(tokens ORDER BY sent_pos)) AS t FROM tok GROUP BY doc_id),
p AS (SELECT doc_id, t, list_position(t[3:], {S.EOD}) AS pos FROM dt)
SELECT doc_id, CAST(len(CASE WHEN pos IS NOT NULL AND pos > 0 THEN t[1:2 + pos] ELSE t END) AS INTEGER) AS n_kept FROM p
""")
def q_cut_at_eod(spark, d):
    """Document token streams (EOD at the end) cut at the first EOD after a 2-token prompt."""
    t = token_table(spark, d)
    g = t.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sent_pos", "tokens"))), lambda s: s["tokens"])).alias("t"))
    return g.select("doc_id", F.size(T.cut_at_eod("t", 2, S.EOD)).cast("int").alias("n_kept"))


@query("trim_padding", DOC_TOK + f"""
, p AS (SELECT doc_id, sent_pos, tokens || list_transform(range(8), lambda i: {S.PAD}) AS t FROM tok)
SELECT doc_id, sent_pos, {Q.arr_str('t[1:list_position(t, 0) - 1]')} AS tokens FROM p
""")
def q_trim_padding(spark, d):
    t = token_table(spark, d)
    padded = F.concat("tokens", F.array_repeat(F.lit(S.PAD), 8))
    return t.select("doc_id", "sent_pos", arr_str(T.trim_padding(padded, S.PAD)).alias("tokens"))
