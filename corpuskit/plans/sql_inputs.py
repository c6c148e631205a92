"""DuckDB text of the derived inputs and column functions used by the oracles.

Each helper returns SQL text; together they mirror ``inputs`` and
``corpuskit.functions.text`` expression by expression.
"""

from __future__ import annotations

from corpuskit.functions import text as T

NL = "chr(10)"

ARTICLES_CTE = f"""
a1 AS (SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN 'List of ' || text ELSE text END AS t FROM documents),
a2 AS (SELECT doc_id, lang, CASE WHEN doc_id % 11 = 0 THEN t || {NL} || split_part(t, {NL}, 1) || ' may refer to:' ELSE t END AS t FROM a1),
a3 AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 AND strpos(t, {NL}) > 0
        THEN substr(t, 1, length(t) - length(split_part(t, {NL}, -1)) - 1) || {NL} || 'References' || {NL} || split_part(t, {NL}, -1)
        ELSE t END AS t FROM a2),
articles AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN t || {NL} || 'Category:' || lang ELSE t END AS text FROM a3)
"""

TURNS_CTE = """
turns AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN '<speaker1>' WHEN 'assistant' THEN '<speaker2>' ELSE '' END || text AS utterance
          FROM conversations)
"""


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{T.WS}+|{T.WS}+$', '', 'g')"


def title_of(x: str) -> str:
    return f"split_part({x}, {NL}, 1)"


def body_of(x: str) -> str:
    return f"(CASE WHEN strpos({x}, {NL}) > 0 THEN substr({x}, strpos({x}, {NL}) + 1) ELSE '' END)"


def drop_category_lines(x: str) -> str:
    return (f"array_to_string(list_filter(string_split({x}, {NL}), lambda l: NOT regexp_matches(l, '{T.CATEGORY_LINE}')), {NL})")


def cut_at_tail_section(x: str) -> str:
    return strip_ws(f"regexp_replace({x}, '\\n(References|See also|External Links)\\s?\\n.*', '', 's')")


def clean_body(x: str) -> str:
    return cut_at_tail_section(drop_category_lines(body_of(x)))


def clean_text(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[\\t\\n\\r\\p{{Zs}}]', ' ', 'g'), '[\\x00\\x{{FFFD}}\\p{{Cc}}\\p{{Cf}}]', '', 'g')"


def space_cjk(x: str) -> str:
    cls = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in T.CJK_RANGES) + "]"
    return f"regexp_replace({x}, '({cls})', ' \\1 ', 'g')"


def pad_punctuation(x: str) -> str:
    return f"regexp_replace({x}, '([!-/:-@\\[-`{{-~\\p{{P}}])', ' \\1 ', 'g')"


def split_ws(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{T.WS}+'), lambda w: w <> '')"


def basic_tokens(x: str) -> str:
    return split_ws(pad_punctuation(f"strip_accents(lower({space_cjk(clean_text(x))}))"))


def sentences_of(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(31), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(31)), lambda s: {strip_ws('s')}), lambda s: s <> '')"


def sentences_keep_ws(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?][ \\t\\n\\r]+)', '\\1' || chr(31), 'g')"
    return f"list_filter(string_split({marked}, chr(31)), lambda s: s <> '')"


def arr_str(x: str, sep: str = " ") -> str:
    return f"array_to_string(list_transform({x}, lambda v: CAST(v AS VARCHAR)), '{sep}')"


VOCAB_CTE = f"""
vocab_words AS (SELECT DISTINCT unnest({basic_tokens('text')}) AS word FROM documents),
vocab AS (SELECT word, CAST(dense_rank() OVER (ORDER BY word) + 99 AS INTEGER) AS id FROM vocab_words)
"""
