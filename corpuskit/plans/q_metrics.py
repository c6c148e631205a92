"""Queries for evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import hashing as H
from corpuskit.functions import text as T
from corpuskit.functions.hashing import sql_u
from corpuskit.operators import metrics as I
from corpuskit.operators import shards as D
from corpuskit.operators.tokens import sentences_of
from corpuskit.plans import sql_inputs as Q
from corpuskit.plans.inputs import table
from corpuskit.plans.q_tokens import DOC_TOK, token_table
from corpuskit.plans.registry import query

SEED = 1234
U = sql_u(SEED, "doc_id")
PRED_SQL = f"(CASE WHEN {U} % 10 < 8 THEN quality ELSE 1 - quality END)"
LAB = f"lab AS (SELECT doc_id, quality AS truth, {PRED_SQL} AS pred, toxic FROM labels)"


def labelled(spark, d):
    lab = table(spark, d, "labels", "doc_id", "quality", "toxic")
    pred = F.when(H.u(SEED, "doc_id") % 10 < 8, F.col("quality")).otherwise(1 - F.col("quality"))
    return lab.select("doc_id", F.col("quality").alias("truth"), pred.alias("pred"), "toxic")


def r6(c, name):
    return F.round(F.col(c), 6).alias(name)


@query("accuracy", f"WITH {LAB} SELECT round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lab")
def q_accuracy(spark, d):
    return I.accuracy(labelled(spark, d), "truth", "pred").select(r6("accuracy", "accuracy"))


PRF = """
, c AS (SELECT sum(CASE WHEN t = 1 AND p = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN t <> 1 AND p = 1 THEN 1 ELSE 0 END) AS fp,
               sum(CASE WHEN t = 1 AND p <> 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN t <> 1 AND p <> 1 THEN 1 ELSE 0 END) AS tn FROM x)
"""


def _div(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / CAST(({b}) AS DOUBLE) END)"


@query("precision_recall_f1", f"WITH {LAB}, x AS (SELECT truth AS t, pred AS p FROM lab)" + PRF + f"""
SELECT round({_div('tp', 'tp + fp')}, 6) AS precision, round({_div('tp', 'tp + fn')}, 6) AS recall,
       round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM c""")
def q_precision_recall_f1(spark, d):
    r = I.precision_recall_f1(labelled(spark, d), "truth", "pred")
    return r.select(r6("precision", "precision"), r6("recall", "recall"), r6("f1", "f1"))


U4 = sql_u(SEED, "'m'", "doc_id")
MULTI_SQL = f"mc AS (SELECT quality + 2 * toxic AS t, CASE WHEN {U4} % 4 = 0 THEN (quality + 2 * toxic + 1) % 4 ELSE quality + 2 * toxic END AS p FROM labels)"


@query("f1_micro", f"WITH {MULTI_SQL} SELECT round({_div('2 * sum(CASE WHEN t = p THEN 1 ELSE 0 END)', '2 * count(*)')}, 6) AS f1_micro FROM mc")
def q_f1_micro(spark, d):
    lab = table(spark, d, "labels", "doc_id", "quality", "toxic")
    t = F.col("quality") + 2 * F.col("toxic")
    p = F.when(H.u(SEED, F.lit("m"), "doc_id") % 4 == 0, (t + 1) % 4).otherwise(t)
    return I.f1_micro(lab.select(t.alias("t"), p.alias("p")), "t", "p").select(r6("f1_micro", "f1_micro"))


U17 = sql_u(SEED, "'inv'", "doc_id")


@query("f1_with_invalid", f"""WITH {LAB},
x AS (SELECT truth AS t, CASE WHEN p2 IN (0, 1) THEN p2 ELSE 1 - truth END AS p
      FROM (SELECT truth, CASE WHEN {U17} % 17 = 0 THEN 2 ELSE pred END AS p2 FROM lab))""" + PRF + f"""
SELECT round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM c""")
def q_f1_with_invalid(spark, d):
    lab = labelled(spark, d)
    lab = lab.withColumn("pred", F.when(H.u(SEED, F.lit("inv"), "doc_id") % 17 == 0, F.lit(2)).otherwise(F.col("pred")))
    return I.f1_with_invalid(lab, "truth", "pred").select(r6("f1", "f1"))


@query("matthews_corr", f"WITH {LAB}, x AS (SELECT truth AS t, pred AS p FROM lab)" + PRF + """
SELECT round(CASE WHEN d = 0 THEN 0.0 ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / d END, 6) AS mcc
FROM (SELECT *, sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) AS d FROM c)""")
def q_matthews_corr(spark, d):
    return I.matthews_corr(labelled(spark, d), "truth", "pred").select(r6("mcc", "mcc"))


UE = sql_u(SEED, "event_id")
EV = f"ev AS (SELECT event_id, value AS x, value + (({UE} % 1000) / 100.0 - 5.0) AS y FROM events)"


def scored_events(spark, d):
    e = table(spark, d, "events", "event_id", "value")
    return e.select("event_id", F.col("value").alias("x"), (F.col("value") + ((H.u(SEED, "event_id") % 1000) / 100.0 - 5.0)).alias("y"))


@query("pearson", f"WITH {EV} SELECT round(corr(x, y), 6) AS pearson FROM ev")
def q_pearson(spark, d):
    return I.pearson(scored_events(spark, d), "x", "y").select(r6("pearson", "pearson"))


@query("spearman", f"""WITH {EV},
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM ev)
SELECT round(corr(rx, ry), 6) AS spearman FROM r""")
def q_spearman(spark, d):
    return I.spearman(scored_events(spark, d), "x", "y").select(r6("spearman", "spearman"))


# --- text metrics over `benchmark` (reference = text, prediction = derived edit) ----

def pred_text(c):
    """Prediction: the text itself for item_id % 3 = 0, else every 4th word (from the 2nd) dropped."""
    words = F.split(c, " ")
    edited = F.array_join(F.filter(words, lambda w, i: i % 4 != 1), " ")
    return F.when(F.col("item_id") % 3 == 0, c).otherwise(edited)


PRED_TEXT_SQL = "(CASE WHEN item_id % 3 = 0 THEN text ELSE array_to_string(list_filter(string_split(text, ' '), lambda w, i: (i - 1) % 4 <> 1), ' ') END)"
REFS_SQL = f"""refs AS (SELECT item_id, 0 AS ref, text AS r FROM benchmark
  UNION ALL SELECT item_id, 1, ({Q.sentences_of('text')})[1] FROM benchmark),
preds AS (SELECT item_id, {PRED_TEXT_SQL} AS p FROM benchmark)"""


def preds_refs(spark, d):
    from corpuskit.operators.tokens import sentences_of

    b = table(spark, d, "benchmark", "item_id", "text")
    preds = b.select("item_id", pred_text(F.col("text")).alias("p"))
    refs = b.select("item_id", F.lit(0).alias("ref"), F.col("text").alias("r")).unionByName(
        b.select("item_id", F.lit(1).alias("ref"), F.element_at(sentences_of("text"), 1).alias("r")))
    return preds, refs


def _sql_norm(x: str) -> str:
    tr = "translate(lower(%s), '%s', '')" % (x, T.ASCII_PUNCTUATION.replace("'", "''"))
    return f"list_filter({Q.split_ws(tr)}, lambda w: w NOT IN ('a', 'an', 'the'))"


@query("exact_match", f"""WITH {REFS_SQL},
em AS (SELECT item_id, max(CASE WHEN array_to_string({_sql_norm('p')}, ' ') = array_to_string({_sql_norm('r')}, ' ') THEN 1.0 ELSE 0.0 END) AS em
       FROM preds JOIN refs USING (item_id) GROUP BY item_id)
SELECT round(avg(em), 6) AS exact_match FROM em""")
def q_exact_match(spark, d):
    preds, refs = preds_refs(spark, d)
    j = preds.join(refs, "item_id")
    em = j.select("item_id", (T.normalize_answer("p") == T.normalize_answer("r")).cast("double").alias("em"))
    return I.best_over_references(em, ["item_id"], "em").agg(F.round(F.avg("em"), 6).alias("exact_match"))


@query("token_f1", f"""WITH {REFS_SQL},
pt AS (SELECT item_id, unnest({_sql_norm('p')}) AS tok FROM preds),
rt AS (SELECT item_id, ref, unnest({_sql_norm('r')}) AS tok FROM refs),
pc AS (SELECT item_id, tok, count(*) AS c FROM pt GROUP BY ALL),
rc AS (SELECT item_id, ref, tok, count(*) AS c FROM rt GROUP BY ALL),
cm AS (SELECT rc.item_id, rc.ref, sum(least(pc.c, rc.c)) AS c FROM rc JOIN pc USING (item_id, tok) GROUP BY ALL),
lp AS (SELECT item_id, count(*) AS lp FROM pt GROUP BY item_id),
lr AS (SELECT item_id, ref, count(*) AS lr FROM rt GROUP BY ALL),
f AS (SELECT lr.item_id, lr.ref, coalesce(cm.c, 0) AS c, coalesce(lp.lp, 0) AS lp, lr.lr FROM lr LEFT JOIN lp USING (item_id)
      LEFT JOIN cm ON cm.item_id = lr.item_id AND cm.ref = lr.ref),
s AS (SELECT item_id, max(CASE WHEN c = 0 THEN 0.0 ELSE 2.0 * (c / lp) * (c / lr) / ((c / lp) + (c / lr)) END) AS f1 FROM f GROUP BY item_id)
SELECT round(avg(f1), 6) AS token_f1 FROM s""")
def q_token_f1(spark, d):
    preds, refs = preds_refs(spark, d)
    pt = preds.select("item_id", F.explode(F.split(T.normalize_answer("p"), " ")).alias("tok")).filter(F.col("tok") != "")
    rt = refs.select("item_id", "ref", F.explode(F.split(T.normalize_answer("r"), " ")).alias("tok")).filter(F.col("tok") != "")
    f = I.bag_f1(pt, rt, "item_id", "ref")
    best = I.best_over_references(f, ["item_id"], "f1")
    return best.agg(F.round(F.avg("f1"), 6).alias("token_f1"))


def rouge_words(c):
    return T.split_ws(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


RW = "list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), '\\s+'), lambda w: w <> '')"


def _sql_rouge(n: int) -> str:
    def grams(src, col):
        return (f"SELECT item_id, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT item_id, {RW.format(x=col)} AS w FROM {src}) s, "
                f"generate_series(1, len(w) - {n - 1}) t(i) WHERE len(w) >= {n}")
    return f"""
pg{n} AS ({grams('preds', 'p')}), rg{n} AS ({grams('rr', 'r')}),
pc{n} AS (SELECT item_id, g, count(*) AS c FROM pg{n} GROUP BY ALL), rc{n} AS (SELECT item_id, g, count(*) AS c FROM rg{n} GROUP BY ALL),
cm{n} AS (SELECT item_id, sum(least(pc{n}.c, rc{n}.c)) AS c FROM rc{n} JOIN pc{n} USING (item_id, g) GROUP BY item_id),
lp{n} AS (SELECT item_id, count(*) AS lp FROM pg{n} GROUP BY item_id), lr{n} AS (SELECT item_id, count(*) AS lr FROM rg{n} GROUP BY item_id),
f{n} AS (SELECT lr{n}.item_id, coalesce(c, 0) AS c, coalesce(lp, 0) AS lp, lr FROM lr{n} LEFT JOIN lp{n} USING (item_id) LEFT JOIN cm{n} USING (item_id)),
s{n} AS (SELECT item_id, CASE WHEN c = 0 THEN 0.0 ELSE 2.0 * (c / lp) * (c / lr) / ((c / lp) + (c / lr)) END AS f FROM f{n})"""


@query("rouge_n", f"""WITH {REFS_SQL}, rr AS (SELECT item_id, r FROM refs WHERE ref = 0), {_sql_rouge(1)}, {_sql_rouge(2)}
SELECT round((SELECT avg(f) FROM s1), 6) AS rouge1, round((SELECT avg(f) FROM s2), 6) AS rouge2""")
def q_rouge_n(spark, d):
    preds, refs = preds_refs(spark, d)
    p = preds.select("item_id", rouge_words("p").alias("w"))
    r = refs.filter(F.col("ref") == 0).select("item_id", rouge_words("r").alias("w"))
    r1 = I.rouge_n(p, r, "item_id", "w", 1).agg(F.round(F.avg("rouge1"), 6).alias("rouge1"))
    r2 = I.rouge_n(p, r, "item_id", "w", 2).agg(F.round(F.avg("rouge2"), 6).alias("rouge2"))
    return r1.crossJoin(r2)


def _rouge_pairs(spark, d):
    preds, refs = preds_refs(spark, d)
    r = refs.filter(F.col("ref") == 0).select("item_id", "r")
    return preds.join(r, "item_id").select("item_id", rouge_words("p").alias("pw"), rouge_words("r").alias("rw"))


LCS_SQL = f"""
lw AS (SELECT item_id, {RW.format(x='p')} AS pw, {RW.format(x='r')} AS rw FROM preds JOIN rr USING (item_id)),
lcs(item_id, i, best) AS (SELECT item_id, 0::BIGINT, list_transform(range(0, len(pw) + 1), lambda j: 0::BIGINT) FROM lw
  UNION ALL SELECT item_id, i + 1, [0::BIGINT] || list_transform(range(1, len(t) + 1), lambda j: list_max(t[1:j])) FROM (
    SELECT l.item_id, l.i, list_transform(range(1, len(w.pw) + 1), lambda j: greatest(l.best[j + 1], l.best[j] + CASE WHEN w.pw[j] = w.rw[l.i + 1] THEN 1 ELSE 0 END)) AS t
    FROM lcs l JOIN lw w ON w.item_id = l.item_id AND l.i < len(w.rw)) x),
ll AS (SELECT w.item_id, l.best[-1] AS l, len(w.pw) AS lp, len(w.rw) AS lr FROM lw w JOIN lcs l ON l.item_id = w.item_id AND l.i = len(w.rw)),
sl AS (SELECT item_id, CASE WHEN coalesce(l, 0) = 0 THEN 0.0 ELSE 2.0 * (l / lp) * (l / lr) / ((l / lp) + (l / lr)) END AS f FROM ll)"""


@query("rouge_l", f"WITH RECURSIVE {REFS_SQL}, rr AS (SELECT item_id, r FROM refs WHERE ref = 0), {LCS_SQL} SELECT item_id, round(f, 6) AS \"rougeL\" FROM sl")
def q_rouge_l(spark, d):
    """ROUGE-L F1 per item (Arrow UDF for the LCS)."""
    return I.rouge_l(_rouge_pairs(spark, d), "item_id", "pw", "rw").select("item_id", r6("rougeL", "rougeL"))


@query("rouge_lsum")
def q_rouge_lsum(spark, d):
    """Summary-level ROUGE-L per item over its sentences; a union of alignments, so rows-only, compared with a plain table in tests."""
    preds, refs = preds_refs(spark, d)
    lines = lambda c: F.transform(sentences_of(c), lambda s: rouge_words(s))
    pair = preds.join(refs.filter(F.col("ref") == 0).select("item_id", "r"), "item_id")
    return I.rouge_lsum(pair.select("item_id", lines("p").alias("pl"), lines("r").alias("rl")), "item_id", "pl", "rl").select("item_id", r6("rougeLsum", "rougeLsum"))


@query("rouge_geomean", f"""WITH RECURSIVE {REFS_SQL}, rr AS (SELECT item_id, r FROM refs WHERE ref = 0), {LCS_SQL}, {_sql_rouge(1)}, {_sql_rouge(2)},
a AS (SELECT (SELECT avg(f) FROM s1) AS r1, (SELECT avg(f) FROM s2) AS r2, (SELECT avg(f) FROM sl) AS rl)
SELECT round(r1, 6) AS rouge1, round(r2, 6) AS rouge2, round(rl, 6) AS "rougeL", round(exp((ln(r1) + ln(r2) + ln(rl)) / 3), 6) AS geomean FROM a""")
def q_rouge_geomean(spark, d):
    """Geometric mean of corpus ROUGE-1, ROUGE-2 and ROUGE-L."""
    pr = _rouge_pairs(spark, d)
    p, r = pr.select("item_id", F.col("pw").alias("w")), pr.select("item_id", F.col("rw").alias("w"))
    r1 = I.rouge_n(p, r, "item_id", "w", 1).agg(F.avg("rouge1").alias("rouge1"))
    r2 = I.rouge_n(p, r, "item_id", "w", 2).agg(F.avg("rouge2").alias("rouge2"))
    rl = I.rouge_l(pr, "item_id", "pw", "rw").agg(F.avg("rougeL").alias("rougeL"))
    g = I.geomean(r1.crossJoin(r2).crossJoin(rl), ["rouge1", "rouge2", "rougeL"])
    return g.select(*[r6(c, c) for c in ("rouge1", "rouge2", "rougeL", "geomean")])


BW = "list_filter(string_split_regex(" + Q.pad_punctuation("@X@") + ", '\\s+'), lambda w: w <> '')"


def _sql_bleu() -> str:
    parts = []
    for n in range(1, 5):
        def grams(src, col, n=n):
            return (f"SELECT item_id, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT item_id, {BW.replace('@X@', col)} AS w FROM {src}) s, "
                    f"generate_series(1, len(w) - {n - 1}) t(i) WHERE len(w) >= {n}")
        parts.append(f"""
pg{n} AS ({grams('preds', 'p')}), rg{n} AS ({grams('rr', 'r')}),
pc{n} AS (SELECT item_id, g, count(*) AS c FROM pg{n} GROUP BY ALL), rc{n} AS (SELECT item_id, g, count(*) AS c FROM rg{n} GROUP BY ALL),
m{n} AS (SELECT {n} AS n, sum(least(pc{n}.c, coalesce(rc{n}.c, 0))) AS match, sum(pc{n}.c) AS total FROM pc{n} LEFT JOIN rc{n} USING (item_id, g))""")
    return ",".join(parts)


@query("corpus_bleu", f"""WITH {REFS_SQL}, rr AS (SELECT item_id, r FROM refs WHERE ref = 0), {_sql_bleu()},
m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4),
lens AS (SELECT (SELECT sum(len({BW.replace('@X@', 'p')})) FROM preds) AS c, (SELECT sum(len({BW.replace('@X@', 'r')})) FROM rr) AS r),
pr AS (SELECT sum(ln(match / total)) AS lp, min(match) AS mm FROM m),
bp AS (SELECT CASE WHEN c > r THEN 1.0 ELSE exp(1 - r / c) END AS bp, c, r FROM lens)
SELECT round(CASE WHEN mm = 0 THEN 0.0 ELSE bp * exp(lp / 4) END, 6) AS bleu, round(bp, 6) AS brevity_penalty,
       CAST(c AS BIGINT) AS sys_len, CAST(r AS BIGINT) AS ref_len FROM pr, bp""")
def q_corpus_bleu(spark, d):
    preds, refs = preds_refs(spark, d)

    def w(c):
        return T.split_ws(T.pad_punctuation(c))
    p = preds.select("item_id", w("p").alias("words"))
    r = refs.filter(F.col("ref") == 0).select("item_id", w("r").alias("words"))
    b = I.corpus_bleu(p, r, "item_id")
    return b.select(r6("bleu", "bleu"), r6("brevity_penalty", "brevity_penalty"), F.col("sys_len").cast("bigint"), F.col("ref_len").cast("bigint"))


UL = sql_u(SEED, "'l'", "doc_id", "sent_pos", "p")
UC = sql_u(SEED, "'c'", "doc_id", "sent_pos", "p")


@query("mlm_accuracy", DOC_TOK + f"""
, e AS (SELECT doc_id, sent_pos, x.p - 1 AS p FROM tok, unnest(tok.tokens) WITH ORDINALITY x(t, p)),
f AS (SELECT doc_id // 16 AS batch, {UL} % 7 = 0 AS lab, {UC} % 4 <> 0 AS ok FROM e),
b AS (SELECT batch, sum(CASE WHEN lab THEN 1 ELSE 0 END) AS n, sum(CASE WHEN lab AND ok THEN 1 ELSE 0 END) AS c FROM f GROUP BY batch)
SELECT round(avg(CASE WHEN n = 0 THEN 0.0 ELSE c / n END), 6) AS mlm_accuracy FROM b""")
def q_mlm_accuracy(spark, d):
    e = token_table(spark, d).select("doc_id", "sent_pos", F.posexplode("tokens").alias("p", "t"))
    f = e.select((F.col("doc_id") / 16).cast("bigint").alias("batch"),
                 (H.u(SEED, F.lit("l"), "doc_id", "sent_pos", "p") % 7 == 0).alias("lab"),
                 (H.u(SEED, F.lit("c"), "doc_id", "sent_pos", "p") % 4 != 0).alias("ok"))
    return I.mlm_accuracy(f, "batch", "lab", "ok").select(r6("mlm_accuracy", "mlm_accuracy"))


@query("batch_mean_vs_pooled", f"""WITH {LAB},
b AS (SELECT doc_id // 16 AS batch, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS a FROM lab GROUP BY batch)
SELECT round((SELECT avg(a) FROM b), 6) AS batch_mean,
       round((SELECT avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) FROM lab), 6) AS pooled""")
def q_batch_mean_vs_pooled(spark, d):
    lab = labelled(spark, d).withColumn("batch", (F.col("doc_id") / 16).cast("bigint"))
    r = I.batch_mean_vs_pooled(lab, "batch", "truth", "pred")
    return r.select(r6("batch_mean", "batch_mean"), r6("pooled", "pooled"))


@query("nsp_accuracy", f"""WITH {LAB}
SELECT round(avg(CASE WHEN (truth = 1) = ({sql_u(SEED, "'nsp'", 'doc_id')} % 3 <> 0) THEN 1.0 ELSE 0.0 END), 6) AS nsp_accuracy FROM lab""")
def q_nsp_accuracy(spark, d):
    """Pooled accuracy of a binary order label (truth = quality) against a hashed prediction."""
    lab = labelled(spark, d)
    ok = (F.col("truth") == 1) == (H.u(SEED, F.lit("nsp"), "doc_id") % 3 != 0)
    return lab.agg(F.round(F.avg(ok.cast("double")), 6).alias("nsp_accuracy"))


@query("metrics_by_split", f"""WITH {LAB},
rk AS (SELECT doc_id, row_number() OVER (ORDER BY {U}, doc_id) - 1 AS pos, count(*) OVER () AS n FROM labels),
sp AS (SELECT doc_id, CASE WHEN pos < round_even(0.8 * n, 0) THEN 'train' WHEN pos < round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'valid' ELSE 'test' END AS split FROM rk),
m AS (SELECT split, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS acc,
             {_div('2 * sum(CASE WHEN truth = 1 AND pred = 1 THEN 1 ELSE 0 END)', '2 * sum(CASE WHEN truth = 1 AND pred = 1 THEN 1 ELSE 0 END) + sum(CASE WHEN truth <> pred THEN 1 ELSE 0 END)')} AS f1
      FROM lab JOIN sp USING (doc_id) GROUP BY split)
SELECT round((SELECT acc FROM m WHERE split = 'train'), 6) AS train_accuracy, round((SELECT f1 FROM m WHERE split = 'train'), 6) AS train_f1,
       round((SELECT acc FROM m WHERE split = 'valid'), 6) AS valid_accuracy, round((SELECT f1 FROM m WHERE split = 'valid'), 6) AS valid_f1,
       round((SELECT acc FROM m WHERE split = 'test'), 6) AS test_accuracy, round((SELECT f1 FROM m WHERE split = 'test'), 6) AS test_f1""")
def q_metrics_by_split(spark, d):
    lab = labelled(spark, d)
    ranked = D.shuffle_rows(lab.select("doc_id"), "doc_id", SEED)
    sp = D.split_train_valid_test(ranked, "8,1,1").select("doc_id", "split")
    j = lab.join(sp, "doc_id")
    acc = I.accuracy(j, "truth", "pred", ["split"])
    f1 = I.precision_recall_f1(j, "truth", "pred", group=["split"]).select("split", "f1")
    m = acc.join(f1, "split")
    w = I.metrics_by_split(m, "split", ["accuracy", "f1"], ["train", "valid", "test"])
    return w.select(*[F.round(c, 6).alias(c) for c in w.columns])


@query("postprocess_then_score", f"""
WITH x AS (SELECT CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS t,
                  CASE WHEN {U} % 10 = 0 THEN 'maybe' WHEN {U} % 10 < 8 THEN CASE WHEN quality = 1 THEN 'true' ELSE 'false' END
                       ELSE CASE WHEN quality = 1 THEN 'false' ELSE 'true' END END AS p FROM labels),
m AS (SELECT * FROM (VALUES ('false', 0), ('true', 1)) v(k, id))
SELECT round(avg(CASE WHEN coalesce(mt.id, 0) = coalesce(mp.id, 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM x LEFT JOIN m mt ON mt.k = x.t LEFT JOIN m mp ON mp.k = x.p""")
def q_postprocess_then_score(spark, d):
    lab = table(spark, d, "labels", "doc_id", "quality")
    u = H.u(SEED, "doc_id")
    t = F.when(F.col("quality") == 1, "true").otherwise("false")
    flip = F.when(F.col("quality") == 1, "false").otherwise("true")
    p = F.when(u % 10 == 0, "maybe").when(u % 10 < 8, t).otherwise(flip)
    x = lab.select(t.alias("t"), p.alias("p"))
    mp = {"false": 0, "true": 1}
    x = I.map_labels(x, "t", mp, strict=False, out="ti")
    x = I.map_labels(x, "p", mp, strict=False, out="pi")
    return I.accuracy(x, "ti", "pi").select(r6("accuracy", "accuracy"))
