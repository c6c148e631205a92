"""Queries for masked-LM and T5 span samples over word pieces.

The oracles walk the same choices one group at a time in recursive CTEs.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuskit.functions import specials as S
from corpuskit.functions.hashing import TWO32, sql_u
from corpuskit.operators import masking as M
from corpuskit.operators import objectives as O
from corpuskit.operators import packing as E
from corpuskit.operators import tokens as K
from corpuskit.plans import sql_inputs as Q
from corpuskit.plans.inputs import arr_str, table
from corpuskit.plans.q_packing import trunc_sql
from corpuskit.plans.registry import query
from corpuskit.session import written

SEED = 1234
PIECES = 2000  # most frequent words in the piece vocabulary
MAX_LEN = 128  # padded length; blocks leave room for CLS and two SEP
TARGET = MAX_LEN - 3
MIN_SENT = 2
SHORT_P = 0.1
P = 0.15
DOC = ["doc_id", "block"]


# --- word pieces in SQL --------------------------------------------------------

PIECE_CTE = f"""
wc AS (SELECT word, count(*) AS n FROM (SELECT unnest({Q.basic_tokens('text')}) AS word FROM documents) GROUP BY word),
chars AS (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM wc),
pieces AS (SELECT c AS piece FROM chars WHERE c <> '' UNION SELECT '##' || c FROM chars WHERE c <> ''
           UNION SELECT word FROM (SELECT word FROM wc ORDER BY n DESC, word LIMIT {PIECES})),
pid AS (SELECT piece, CAST({S.FIRST_WORD_ID} - 1 + row_number() OVER (ORDER BY starts_with(piece, '##'), piece) AS INTEGER) AS id FROM pieces),
bound AS (SELECT {S.FIRST_WORD_ID} + count(*) FILTER (WHERE NOT starts_with(piece, '##')) AS fc, {S.FIRST_WORD_ID} + count(*) AS pend FROM pieces),
cut1 AS (SELECT word, unnest(range(1, length(word) + 1)) AS s FROM wc WHERE length(word) <= 200),
cut2 AS (SELECT word, s, unnest(range(1, length(word) - s + 2)) AS l FROM cut1),
fit AS (SELECT word, s, max(l) AS l, arg_max(id, l) AS id FROM cut2 JOIN pid ON piece = (CASE WHEN s > 1 THEN '##' ELSE '' END) || substr(word, s, l) GROUP BY word, s),
cuts(word, s, ids) AS (SELECT word, 1::BIGINT, []::INTEGER[] FROM wc WHERE length(word) <= 200
  UNION ALL SELECT c.word, c.s + f.l, list_append(c.ids, f.id) FROM cuts c JOIN fit f ON f.word = c.word AND f.s = c.s),
coded AS (SELECT wc.word, coalesce(c.ids, [{S.UNK}]) AS ids FROM wc LEFT JOIN cuts c ON c.word = wc.word AND c.s = length(wc.word) + 1),
sw0 AS (SELECT doc_id, list_filter(list_transform({Q.sentences_of('text')}, lambda s: {Q.basic_tokens('s')}), lambda ws: len(ws) > 0) AS ss FROM documents),
sw1 AS (SELECT doc_id, CAST(u.i - 1 AS INTEGER) AS sent_pos, u.w FROM sw0, unnest(sw0.ss) WITH ORDINALITY AS u(w, i)),
sw2 AS (SELECT doc_id, sent_pos, x.word, x.wp FROM sw1, unnest(sw1.w) WITH ORDINALITY AS x(word, wp)),
tok AS (SELECT doc_id, sent_pos, flatten(list(ids ORDER BY wp)) AS tokens FROM sw2 JOIN coded USING (word) GROUP BY doc_id, sent_pos)
"""


def _tgt(k: str) -> str:
    u = sql_u(SEED, "0", "doc_id", k)
    r = int(round(1 / SHORT_P))
    return f"(CASE WHEN {u} % {r} = 0 THEN 2 + {u} % {TARGET - 1} ELSE {TARGET} END)"


SAMPLES_CTE = "WITH RECURSIVE " + PIECE_CTE + f"""
, sz AS (SELECT doc_id, list(CAST(len(tokens) AS INTEGER) ORDER BY sent_pos) AS s FROM tok GROUP BY doc_id),
el AS (SELECT doc_id, s, len(s) AS n FROM sz WHERE len(s) >= {MIN_SENT} AND NOT (len(s) > 1 AND list_max(s) > 512)),
walk(doc_id, s, n, i, seq, ns, start, k, tgt, closed, bs, be, bt) AS (
  SELECT doc_id, s, n, 0, 0, 0, 0, 0, {_tgt('0')}, false, 0, 0, 0 FROM el
  UNION ALL
  SELECT doc_id, s, n, i + 1, CASE WHEN c THEN 0 ELSE seq2 END, CASE WHEN c THEN 0 ELSE ns2 END, CASE WHEN c THEN i + 1 ELSE start END,
         CASE WHEN c THEN k + 1 ELSE k END, CASE WHEN c THEN {_tgt('k + 1')} ELSE tgt END, c, start, i + 1, tgt
  FROM (SELECT *, seq + s[i + 1] AS seq2, ns + 1 AS ns2,
               ((seq + s[i + 1] >= tgt AND n - (i + 1) > 1 AND ns + 1 >= {MIN_SENT}) OR n - (i + 1) = 0) AS c FROM walk WHERE i < n) w),
blocks AS (SELECT doc_id, k - 1 AS block, bs AS start_sent, be AS end_sent, bt AS target FROM walk WHERE closed),
bsn AS (SELECT b.doc_id, b.block, b.target, list(t.tokens ORDER BY t.sent_pos) AS sents FROM blocks b JOIN tok t
          ON t.doc_id = b.doc_id AND t.sent_pos >= b.start_sent AND t.sent_pos < b.end_sent GROUP BY ALL),
kp AS (SELECT *, concat_ws(':', doc_id, block) AS key, len(sents) AS n FROM bsn WHERE len(sents) >= 2),
ae AS (SELECT *, 1 + {sql_u(SEED, 'key', "'a_end'")} % greatest(n - 1, 1) AS a_end, {sql_u(SEED, 'key', "'swap'")} % 2 = 1 AS sw FROM kp),
pr AS (SELECT doc_id, block, key, target, sw AS is_random, CASE WHEN sw THEN flatten(sents[a_end + 1:]) ELSE flatten(sents[1:a_end]) END AS ta,
              CASE WHEN sw THEN flatten(sents[1:a_end]) ELSE flatten(sents[a_end + 1:]) END AS tb FROM ae)
""" + trunc_sql("target").replace("is_random,", "is_random, target,") + f"""
, smp AS (SELECT doc_id, block, key, is_random, CAST(floor(least({P} * target, greatest(1, round_even({P} * len(toks), 0)))) AS INTEGER) AS budget, toks, types
  FROM (SELECT *, CASE WHEN len(tb) > 0 THEN [{S.CLS}] || ta || [{S.SEP}] || tb || [{S.SEP}] ELSE [{S.CLS}] || ta || [{S.SEP}] END AS toks,
               list_transform(range(len(ta) + 2), lambda x: 0) || CASE WHEN len(tb) > 0 THEN list_transform(range(len(tb) + 1), lambda x: 1) ELSE [] END AS types FROM tr) y)
"""


def groups_sql(src: str = "smp") -> str:
    """``gr``: a row per candidate with its word group; ``gz``: groups with their sizes."""
    return f"""
, tk AS (SELECT key, token, pos - 1 AS pos FROM (SELECT key, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM {src}) z),
cd AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS ci FROM tk WHERE token NOT IN ({S.CLS}, {S.SEP}, {S.PAD})),
gr AS (SELECT *, CAST(sum(CASE WHEN ci = 0 OR token < (SELECT fc FROM bound) THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ci) - 1 AS INTEGER) AS g FROM cd),
gz AS (SELECT key, g, count(*) AS sz FROM gr GROUP BY key, g)
"""


def _cases(u: str, cuts: list[int]) -> str:
    return "(CASE " + " ".join(f"WHEN {u} < {c} THEN {n}" for n, c in enumerate(cuts, 1)) + f" ELSE {len(cuts) + 1} END)"


def ngram_sql(u: str, longest: int = 3) -> str:
    total, cuts, at = sum(1.0 / n for n in range(1, longest + 1)), [], 0.0
    for n in range(1, longest):
        at += 1.0 / n / total
        cuts.append(int(at * TWO32))
    return _cases(u, cuts)


def geometric_sql(u: str, p: float = 0.2, longest: int = 10) -> str:
    return _cases(u, [int((1 - (1 - p) ** n) * TWO32) for n in range(1, longest)])


def choose_sql(out: str, src: str, salt: str, longest: int, length, banned: str = "") -> str:
    """``out(key, spans)``: chosen runs of groups, each as ``1000 * first + end``."""
    sizes = ", ".join(f"sum(sz) OVER (PARTITION BY key ORDER BY g ROWS BETWEEN CURRENT ROW AND {m} FOLLOWING)" for m in range(longest))
    taken = f"coalesce((SELECT spans FROM {banned} b WHERE b.key = s.key), [])" if banned else "[]::INTEGER[]"
    return f"""
, {out}_o AS (SELECT key, g, [{sizes}] AS sizes, count(*) OVER (PARTITION BY key) AS ng, {length(sql_u(SEED, 'key', repr(salt + 'n'), 'g'))} AS l,
                row_number() OVER (PARTITION BY key ORDER BY {sql_u(SEED, 'key', repr(salt), 'g')}, g) - 1 AS i FROM gz),
{out}_w(key, budget, banned, i, cnt, spans) AS (
  SELECT key, budget, {taken}, 0::BIGINT, 0::BIGINT, []::INTEGER[] FROM {src} s
  UNION ALL
  SELECT key, budget, banned, i + 1, CASE WHEN ok THEN cnt + sizes[n] ELSE cnt END, CASE WHEN ok THEN list_append(spans, CAST(g * 1000 + hi AS INTEGER)) ELSE spans END
  FROM (SELECT *, n > 0 AND len(list_filter(spans || banned, lambda x: x // 1000 < hi AND x % 1000 > g)) = 0 AS ok
        FROM (SELECT *, least(g + n, ng) AS hi
              FROM (SELECT w.*, o.g, o.sizes, o.ng, len(list_filter(o.sizes[1:o.l], lambda x: w.cnt + x <= w.budget)) AS n
                    FROM {out}_w w JOIN {out}_o o ON o.key = w.key AND o.i = w.i) q1) q2) q3),
{out} AS (SELECT key, arg_max(spans, i) AS spans FROM {out}_w GROUP BY key)
"""


def _in(spans: str, g: str = "g") -> str:
    return f"len(list_filter({spans}, lambda x: x // 1000 <= {g} AND x % 1000 > {g})) > 0"


MASK_CTE = SAMPLES_CTE + groups_sql() + choose_sql("ch", "smp", "m", 3, ngram_sql) + f"""
, mt AS (SELECT gr.key, gr.pos, gr.token FROM gr JOIN ch USING (key) WHERE {_in('spans')}),
mp AS (SELECT key, list(pos ORDER BY pos) AS pos FROM mt GROUP BY key)
"""
REPLACE_CTE = MASK_CTE + f"""
, rt AS (SELECT tk.key, tk.pos, tk.token, mt.pos IS NOT NULL AS masked, {sql_u(SEED, 'tk.key', "'rep'", 'tk.pos')} % 10 AS u,
           CAST({S.FIRST_WORD_ID} + {sql_u(SEED, 'tk.key', "'rid'", 'tk.pos')} % ((SELECT pend FROM bound) - {S.FIRST_WORD_ID}) AS INTEGER) AS other
         FROM tk LEFT JOIN mt ON mt.key = tk.key AND mt.pos = tk.pos),
ot AS (SELECT key, pos, token, masked, CASE WHEN NOT masked THEN token WHEN u < 8 THEN {S.MASK} WHEN u < 9 THEN token ELSE other END AS new FROM rt)
"""


def samples(spark, d):
    """E4 -> E8 -> E9 (to the block's target) -> E10 over word pieces, written: the masks read it many times."""
    tok, first, end = M.piece_table(table(spark, d, "documents", "doc_id", "text"), PIECES)
    blocks = E.sentence_blocks(tok, "doc_id", TARGET, MIN_SENT, SHORT_P, SEED)
    sents = E.block_sentences(blocks, tok, more=("target",))
    key = F.concat_ws(":", *DOC)
    pair = E.truncate_pair(E.segment_pair(sents, SEED, key), SEED, key, F.col("target"))
    x = E.tokens_and_types(pair).select(*DOC, "is_random", "target", "tokens", "tokentypes")
    return written(x, "mlm-samples"), key, first, end


def masked(spark, d):
    x, key, first, end = samples(spark, d)
    m = M.mlm_mask(x, "tokens", key, SEED, first, P, F.col("target"))
    return M.mlm_replace(m, "tokens", key, SEED, end), key


@query("wordpiece_encode", "WITH RECURSIVE " + PIECE_CTE + """
, each AS (SELECT word, unnest(ids) AS id, generate_subscripts(ids, 1) AS place FROM coded)
SELECT word, string_agg(coalesce(piece, '[UNK]'), ' ' ORDER BY place) AS pieces FROM each LEFT JOIN pid USING (id) GROUP BY word""")
def q_wordpiece_encode(spark, d):
    """Distinct words of the corpus as word pieces."""
    counts = K.word_counts(table(spark, d, "documents", "doc_id", "text"))
    e = K.wordpiece_encode(counts.select("word"), K.wordpiece_vocab(counts, PIECES))
    return e.select("word", F.array_join("pieces", " ").alias("pieces"))


@query("mlm_candidates", SAMPLES_CTE + groups_sql() + """
SELECT s.doc_id, CAST(s.block AS INTEGER) AS block, CAST(tk.pos AS INTEGER) AS pos, gr.g AS word, gr.g IS NOT NULL AS candidate,
       gr.g IS NULL OR tk.token < (SELECT fc FROM bound) AS token_boundary
FROM tk JOIN smp s USING (key) LEFT JOIN gr ON gr.key = tk.key AND gr.pos = tk.pos""")
def q_mlm_candidates(spark, d):
    x, _, first, _ = samples(spark, d)
    return M.mlm_candidates(x, DOC, "tokens", first).drop("token")


@query("mlm_budget", SAMPLES_CTE + "SELECT doc_id, CAST(block AS INTEGER) AS block, budget FROM smp")
def q_mlm_budget(spark, d):
    x, _, _, _ = samples(spark, d)
    return x.select(*DOC, M.mlm_budget(F.size("tokens"), P, F.col("target")).alias("budget"))


@query("mlm_mask", MASK_CTE + f"""
SELECT s.doc_id, CAST(s.block AS INTEGER) AS block, s.budget AS mask_budget, coalesce({Q.arr_str('mp.pos')}, '') AS masked_positions FROM smp s LEFT JOIN mp USING (key)""")
def q_mlm_mask(spark, d):
    x, key, first, _ = samples(spark, d)
    m = M.mlm_mask(x, "tokens", key, SEED, first, P, F.col("target"))
    return m.select(*DOC, "mask_budget", arr_str("masked_positions").alias("masked_positions"))


@query("mlm_replace", REPLACE_CTE + f"""
, o AS (SELECT key, list(new ORDER BY pos) AS t, list(token ORDER BY pos) FILTER (WHERE masked) AS lab FROM ot GROUP BY key)
SELECT doc_id, CAST(block AS INTEGER) AS block, {Q.arr_str('t')} AS tokens, coalesce({Q.arr_str('lab')}, '') AS labels FROM smp JOIN o USING (key)""")
def q_mlm_replace(spark, d):
    m, _ = masked(spark, d)
    return m.select(*DOC, arr_str("output_tokens").alias("tokens"), arr_str("masked_labels").alias("labels"))


def _padded_sql(src: str) -> str:
    """F6 over ``src(key, pos, new, labelled, token)``."""
    pad = f"list_transform(range({MAX_LEN} - len(t)), lambda x: 0)"
    return f"""
, o AS (SELECT key, list(new ORDER BY pos) AS t, list(CASE WHEN labelled THEN token ELSE -1 END ORDER BY pos) AS lab, list(CASE WHEN labelled THEN 1 ELSE 0 END ORDER BY pos) AS loss FROM {src} GROUP BY key)
SELECT doc_id, CAST(block AS INTEGER) AS block, is_random, {Q.arr_str('t || ' + pad)} AS tokens, {Q.arr_str('types || ' + pad)} AS types,
       {Q.arr_str('lab || list_transform(range(' + str(MAX_LEN) + ' - len(t)), lambda x: -1)')} AS labels, {Q.arr_str('loss || ' + pad)} AS loss_mask,
       {Q.arr_str('list_transform(t, lambda x: 1) || ' + pad)} AS padding_mask
FROM smp JOIN o USING (key)"""


def padded(m):
    p = M.mlm_pad(m.drop("labels"), "output_tokens", "tokentypes", MAX_LEN)
    return p.select(*DOC, "is_random", arr_str("text").alias("tokens"), *[arr_str(c).alias(c) for c in ("types", "labels", "loss_mask", "padding_mask")])


@query("bert_samples", REPLACE_CTE + _padded_sql("(SELECT *, masked AS labelled FROM ot)"))
def q_bert_samples(spark, d):
    """E4 -> E8 -> E9 -> E10 -> F1-F4 -> F6: padded samples with whole-word masks."""
    m, _ = masked(spark, d)
    return padded(m)


PERMUTE_CTE = REPLACE_CTE + choose_sql("pm", "smp", "perm", 3, ngram_sql, "ch") + f"""
, pt AS (SELECT gr.key, gr.pos, gr.token, row_number() OVER (PARTITION BY gr.key ORDER BY gr.pos) AS k,
           row_number() OVER (PARTITION BY gr.key ORDER BY {sql_u(SEED, 'gr.key', "'pp'", 'gr.pos')}, gr.pos) AS r FROM gr JOIN pm USING (key) WHERE {_in('spans')}),
mv AS (SELECT a.key, a.pos, b.token AS moved FROM pt a JOIN pt b ON a.key = b.key AND a.k = b.r),
pt2 AS (SELECT ot.key, ot.pos, ot.token, coalesce(mv.moved, ot.new) AS new, ot.masked OR mv.pos IS NOT NULL AS labelled, mv.pos IS NOT NULL AS was_moved FROM ot LEFT JOIN mv ON mv.key = ot.key AND mv.pos = ot.pos)
"""


@query("mlm_permute", PERMUTE_CTE + f"""
, o AS (SELECT key, list(new ORDER BY pos) AS t, list(pos ORDER BY pos) FILTER (WHERE was_moved) AS mp, list(pos ORDER BY pos) FILTER (WHERE labelled) AS lp,
          list(token ORDER BY pos) FILTER (WHERE labelled) AS lab FROM pt2 GROUP BY key)
SELECT doc_id, CAST(block AS INTEGER) AS block, {Q.arr_str('t')} AS tokens, coalesce({Q.arr_str('mp')}, '') AS permuted_positions,
       coalesce({Q.arr_str('lp')}, '') AS label_positions, coalesce({Q.arr_str('lab')}, '') AS labels FROM smp JOIN o USING (key)""")
def q_mlm_permute(spark, d):
    m, key = masked(spark, d)
    p = M.mlm_permute(m, "tokens", key, SEED)
    return p.select(*DOC, arr_str("output_tokens").alias("tokens"), arr_str("permuted_positions").alias("permuted_positions"),
                    arr_str("masked_positions").alias("label_positions"), arr_str("masked_labels").alias("labels"))


@query("mlm_pad", PERMUTE_CTE + _padded_sql("pt2"))
def q_mlm_pad(spark, d):
    """Samples with masks and permuted words, both labelled, padded."""
    m, key = masked(spark, d)
    return padded(M.mlm_permute(m, "tokens", key, SEED))


# --- T5 ------------------------------------------------------------------------

def t5_blocks(tok, max_len):
    """``(doc_id, block, piece, tokens)``: every token of every document, in pieces of at most ``max_len``.

    Sentences longer than that are cut first, so that no document is left out for
    one; blocks may exceed their target by a sentence and are cut likewise.
    """
    short = O.split_fixed(tok, ["doc_id", "sent_pos"], "tokens", max_len)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_pos", "piece")) - 1
    short = written(short.select("doc_id", place.alias("sent_pos"), F.size("tokens").alias("n_tokens"), "tokens"), "t5-sentences")
    b = E.sentence_blocks(short, "doc_id", max_len, 1, close_min_remaining=0, long_sentence=None)
    whole = E.block_sentences(b, short).select("doc_id", "block", F.flatten("sents").alias("tokens"))
    return O.split_fixed(whole, ["doc_id", "block"], "tokens", max_len)


T5_CTE = "WITH RECURSIVE " + PIECE_CTE + f"""
, sh AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_pos, j) - 1 AS i, tokens[j * {MAX_LEN} + 1 : (j + 1) * {MAX_LEN}] AS t
         FROM (SELECT doc_id, sent_pos, tokens, unnest(range(0, CAST(ceil(len(tokens) / {MAX_LEN}.0) AS BIGINT))) AS j FROM tok) x),
wk(doc_id, i, seq, k) AS (SELECT doc_id, i, len(t), 0 FROM sh WHERE i = 0
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN w.seq >= {MAX_LEN} THEN 0 ELSE w.seq END + len(s.t), CASE WHEN w.seq >= {MAX_LEN} THEN w.k + 1 ELSE w.k END
  FROM wk w JOIN sh s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
bl AS (SELECT doc_id, k AS block, flatten(list(t ORDER BY i)) AS t FROM wk JOIN sh USING (doc_id, i) GROUP BY doc_id, k),
smp AS (SELECT doc_id, block, piece, concat_ws(':', doc_id, block, piece) AS key, toks, CAST(floor(least({P} * {float(MAX_LEN)}, greatest(1, round_even({P} * len(toks), 0)))) AS INTEGER) AS budget
        FROM (SELECT doc_id, block, j AS piece, t[j * {MAX_LEN} + 1 : (j + 1) * {MAX_LEN}] AS toks FROM (SELECT *, unnest(range(0, CAST(ceil(len(t) / {MAX_LEN}.0) AS BIGINT))) AS j FROM bl) x) y)
""" + groups_sql() + choose_sql("ch", "smp", "t5", 10, geometric_sql) + f"""
, sp AS (SELECT key, span, row_number() OVER (PARTITION BY key ORDER BY span) - 1 AS j FROM (SELECT key, unnest(spans) AS span FROM ch) x),
st AS (SELECT gr.key, gr.pos, gr.token, sp.j, row_number() OVER (PARTITION BY gr.key, sp.j ORDER BY gr.pos) AS w FROM gr JOIN sp ON sp.key = gr.key AND sp.span // 1000 <= gr.g AND sp.span % 1000 > gr.g),
en AS (SELECT tk.key, list(CASE WHEN st.j IS NULL THEN tk.token ELSE {S.SENTINEL_TOP} - st.j END ORDER BY tk.pos) AS e
       FROM tk LEFT JOIN st ON st.key = tk.key AND st.pos = tk.pos WHERE st.w IS NULL OR st.w = 1 GROUP BY tk.key),
de AS (SELECT key, flatten(list(CASE WHEN w = 1 THEN [{S.SENTINEL_TOP} - j, token] ELSE [token] END ORDER BY pos)) AS t, max(j) + 1 AS n FROM st GROUP BY key)
"""


@query("t5_sentence_samples", T5_CTE + f"""
SELECT doc_id, CAST(block AS INTEGER) AS block, CAST(piece AS INTEGER) AS piece, CAST(coalesce(n, 0) AS INTEGER) AS n_spans, {Q.arr_str('e')} AS encoder_input,
       {Q.arr_str(f'[{S.BOS}] || coalesce(t, [])')} AS decoder_input, {Q.arr_str(f'coalesce(t, []) || [{S.EOD}]')} AS decoder_output
FROM smp JOIN en USING (key) LEFT JOIN de USING (key)""")
def q_t5_sentence_samples(spark, d):
    """Every block of every document in pieces of at most 128 tokens; each span of whole words has a sentinel of its own."""
    tok, first, _ = M.piece_table(table(spark, d, "documents", "doc_id", "text"), PIECES)
    x = written(t5_blocks(tok, MAX_LEN), "t5-samples")
    t = M.t5_sentence_samples(x, "tokens", F.concat_ws(":", "doc_id", "block", "piece"), SEED, first, P, float(MAX_LEN))
    return t.select("doc_id", "block", "piece", "n_spans", arr_str("encoder_input").alias("encoder_input"),
                    arr_str("decoder_input").alias("decoder_input"), arr_str("decoder_output").alias("decoder_output"))
