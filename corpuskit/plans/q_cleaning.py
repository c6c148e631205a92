"""Queries for cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import cleaning as C
from corpuskit.plans import sql_inputs as Q
from corpuskit.plans.inputs import articles_raw, dialog_turns, table
from corpuskit.plans.registry import query

W = "WITH " + Q.ARTICLES_CTE


@query("clean_articles", W + f"""
SELECT doc_id, {Q.title_of('text')} AS title, {Q.clean_body('text')} AS text
FROM articles
WHERE NOT starts_with({Q.title_of('text')}, 'List of')
  AND strpos({Q.clean_body('text')}, {Q.title_of('text')} || ' may refer to:') = 0
""")
def q_clean_articles(spark, d):
    return C.clean_articles(articles_raw(spark, d)).select("doc_id", "title", "text")


@query("clean_report", W + f"""
, c AS (SELECT starts_with({Q.title_of('text')}, 'List of') AS is_list,
               strpos({Q.clean_body('text')}, {Q.title_of('text')} || ' may refer to:') > 0 AS is_dis FROM articles)
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(sum(CASE WHEN is_list OR is_dis THEN 1 ELSE 0 END) AS BIGINT) AS filtered,
       CAST(sum(CASE WHEN is_list OR is_dis THEN 0 ELSE 1 END) AS BIGINT) AS kept
FROM c
""")
def q_clean_report(spark, d):
    return C.clean_report(articles_raw(spark, d))


@query("split_title_body", f"""
SELECT doc_id, {Q.title_of('text')} AS title, {Q.body_of('text')} AS body FROM documents
""")
def q_split_title_body(spark, d):
    return C.split_title_body(table(spark, d, "documents", "doc_id", "text")).select("doc_id", "title", "body")


@query("drop_category_lines", W + f"""
SELECT doc_id, {Q.drop_category_lines(Q.body_of('text'))} AS body FROM articles
""")
def q_drop_category_lines(spark, d):
    a = articles_raw(spark, d)
    return a.select("doc_id", T.drop_category_lines(T.body_of("text")).alias("body"))


@query("cut_at_tail_section", W + f"""
SELECT doc_id, {Q.cut_at_tail_section(Q.body_of('text'))} AS body FROM articles
""")
def q_cut_at_tail_section(spark, d):
    a = articles_raw(spark, d)
    return a.select("doc_id", T.cut_at_tail_section(T.body_of("text")).alias("body"))


@query("filter_list_articles", W + f"""
SELECT doc_id, {Q.title_of('text')} AS title FROM articles WHERE NOT starts_with({Q.title_of('text')}, 'List of')
""")
def q_filter_list_articles(spark, d):
    a = articles_raw(spark, d).select("doc_id", T.title_of("text").alias("title"))
    return a.filter(~T.is_list_title("title"))


@query("filter_disambiguation", W + f"""
SELECT doc_id FROM articles WHERE strpos({Q.clean_body('text')}, {Q.title_of('text')} || ' may refer to:') = 0
""")
def q_filter_disambiguation(spark, d):
    a = C.clean_article_columns(articles_raw(spark, d))
    return a.filter(~T.is_disambiguation("title", "text")).select("doc_id")


@query("flatten_dialogs", "WITH " + Q.TURNS_CTE + """
, j AS (SELECT conv_id, string_agg(utterance, ' ' ORDER BY turn) AS t FROM turns GROUP BY conv_id)
SELECT conv_id, replace(replace(t, '<speaker1>', '<speaker1> '), '<speaker2>', '<speaker2> ') AS text
FROM j WHERE length(t) > 0
""")
def q_flatten_dialogs(spark, d):
    return C.flatten_dialogs(dialog_turns(spark, d))


@query("json_roundtrip_filter", W + f"""
SELECT doc_id, {Q.title_of('text')} AS title, {Q.clean_body('text')} AS text FROM articles
""")
def q_json_roundtrip_filter(spark, d):
    a = C.clean_article_columns(articles_raw(spark, d)).select("doc_id", "title", "text")
    return C.json_roundtrip_filter(a, ["title", "text"])


@query("clean_text", f"SELECT doc_id, {Q.clean_text('text')} AS text FROM documents")
def q_clean_text(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.clean_text("text").alias("text"))


@query("space_cjk", f"SELECT page_id, {Q.space_cjk('html')} AS html FROM pages")
def q_space_cjk(spark, d):
    return table(spark, d, "pages", "page_id", "html").select("page_id", T.space_cjk("html").alias("html"))


@query("strip_accents", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def q_strip_accents(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.strip_accents("text").alias("text"))


@query("split_punctuation", f"SELECT doc_id, {Q.pad_punctuation('text')} AS text FROM documents")
def q_split_punctuation(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.pad_punctuation("text").alias("text"))


def _sql_normalize(x: str) -> str:
    """RE2 has no look-around: borders are captured, and a second pass takes the articles whose border the first one used."""
    t = "translate(lower(%s), '%s', '')" % (x, T.ASCII_PUNCTUATION.replace("'", "''"))
    for _ in range(2):
        t = f"regexp_replace({t}, '(^|{T.WORD.replace('[', '[^')})({'|'.join(T.ANSWER_ARTICLES)})($|{T.WORD.replace('[', '[^')})', '\\1 \\3', 'g')"
    return f"array_to_string({Q.split_ws(t)}, ' ')"


@query("normalize_answer", f"SELECT item_id, {_sql_normalize('text')} AS answer FROM benchmark")
def q_normalize_answer(spark, d):
    return table(spark, d, "benchmark", "item_id", "text").select("item_id", T.normalize_answer("text").alias("answer"))


@query("map_labels", """
WITH m AS (SELECT * FROM (VALUES (0, 'false', 0), (1, 'true', 1)) AS t(quality, label, label_id))
SELECT l.doc_id, m.label, CAST(coalesce(m.label_id, 0) AS INTEGER) AS label_id FROM labels l LEFT JOIN m USING (quality)
""")
def q_map_labels(spark, d):
    from corpuskit.operators.metrics import map_labels

    lab = table(spark, d, "labels", "doc_id", "quality").withColumn("label", F.when(F.col("quality") == 1, "true").otherwise("false"))
    return map_labels(lab, "label", {"false": 0, "true": 1}, strict=True).select("doc_id", "label", "label_id")


@query("clean_prediction", f"""
SELECT item_id, {Q.strip_ws("replace(replace('<pad> ' || text || '</s>', '<pad>', ''), '</s>', '')")} AS prediction FROM benchmark
""")
def q_clean_prediction(spark, d):
    b = table(spark, d, "benchmark", "item_id", "text")
    raw = F.concat(F.lit("<pad> "), "text", F.lit("</s>"))
    return b.select("item_id", T.clean_prediction(raw).alias("prediction"))


def _sql_pieces(x: str) -> str:
    """Word pieces derived from words: words over 4 chars split as ``abcd ##rest``."""
    toks = Q.basic_tokens(x)
    return (f"flatten(list_transform({toks}, lambda w: CASE WHEN length(w) > 4 "
            f"THEN [substr(w, 1, 4), '##' || substr(w, 5)] ELSE [w] END))")


def _pieces(c):
    toks = T.basic_tokens(c)
    return F.flatten(F.transform(toks, lambda w: F.when(F.length(w) > 4, F.array(F.substring(w, 1, 4), F.concat(F.lit("##"), F.substring(w, 5, 2147483647)))).otherwise(F.array(w))))


@query("detokenize_pieces", f"""
SELECT item_id, array_to_string(list_transform(list_filter(['[CLS]'] || {_sql_pieces('text')} || ['[PAD]'], lambda p: p NOT IN ('[PAD]', '[CLS]')),
        lambda p: CASE WHEN starts_with(p, '##') THEN substr(p, 3) ELSE ' ' || p END), '') AS text
FROM benchmark
""")
def q_detokenize_pieces(spark, d):
    b = table(spark, d, "benchmark", "item_id", "text")
    pieces = F.concat(F.array(F.lit("[CLS]")), _pieces("text"), F.array(F.lit("[PAD]")))
    return b.select("item_id", T.detokenize_pieces(pieces).alias("text"))


def _sql_tidy(x: str) -> str:
    t = Q.strip_ws(f"replace(array_to_string({x}, ' '), ' ##', '')")
    for a, b in T.TIDY_REPLACEMENTS:
        t = "replace(%s, '%s', '%s')" % (t, a.replace("'", "''"), b.replace("'", "''"))
    return t


@query("tidy_spaces", f"SELECT item_id, {_sql_tidy(_sql_pieces('text'))} AS text FROM benchmark")
def q_tidy_spaces(spark, d):
    b = table(spark, d, "benchmark", "item_id", "text")
    return b.select("item_id", T.tidy_spaces(_pieces("text")).alias("text"))


@query("add_task_prefix", "SELECT item_id, 'summarize: ' || text AS input FROM benchmark")
def q_add_task_prefix(spark, d):
    b = table(spark, d, "benchmark", "item_id", "text")
    return b.select("item_id", T.add_prefix("text", "summarize: ").alias("input"))


@query("precut_strings", "SELECT doc_id, substr(text, 1, 1280) AS input, substr(source, 1, 160) AS target FROM documents")
def q_precut_strings(spark, d):
    b = table(spark, d, "documents", "doc_id", "text", "source")
    return b.select("doc_id", T.precut("text", 128).alias("input"), T.precut("source", 16).alias("target"))
