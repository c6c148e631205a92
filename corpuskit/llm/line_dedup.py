"""Line deduplication by a log-template tree, in DataFrame functions only.

A line is parsed as a fixed-depth template tree parses a log message: its leaf is
the number of its tokens and its first ``depth`` tokens, where a token with a
digit is the wildcard.  Within a leaf a token that fewer than ``min_docs``
documents have at its position is a variable field and becomes the wildcard too;
if more than ``1 - min_constant`` of the template would be wildcards, the line
stays its own template.  Lines of a template that recurs across documents are
dropped.

Copies of one document must not look like recurrence, or they would lose all
their lines.  So texts, not rows, are counted, and a template recurs if the texts
that hold it have at least ``min_docs`` different identities and at least half as
many identities as texts; the identity of a text, as seen from a line, is the
smallest ``md5`` among the leaves of its other lines, which near copies mostly share.

Defined results: a null text stays null, an empty one empty; lines of fewer than
``min_tokens`` tokens (blank ones too) always stay; white space within a line
does not matter to its template; repeated rows and rows with a null id are cut
alike; ties cannot arise, since counts decide; a text that loses all lines
becomes empty, its row stays; an empty table gives no rows.  All other columns
of ``docs`` are kept as they are, except that names starting with ``_ld_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import written

MOST_BROADCAST = 2_000_000  # texts, a number each


def line_tokens(line: Column) -> Column:
    """Tokens between blanks, tabs and carriage returns."""
    return F.array_remove(F.split(F.translate(line, "\t\r", "  "), " "), "")


def masked_line(line: Column) -> Column:
    """The line's tokens joined by one blank, those with a digit as the wildcard."""
    uneven = line.contains("  ") | line.contains("\t") | line.contains("\r") | line.startswith(" ") | line.endswith(" ")
    joined = F.when(uneven, F.array_join(line_tokens(line), " ")).otherwise(line)
    return F.when(joined.rlike("[0-9]"), F.regexp_replace(joined, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(joined)


def _parsed(docs: DataFrame, min_tokens: int) -> DataFrame:
    """``(k, mask, n)`` of the lines that take part; ``k`` stands for the text, ``n`` counts tokens."""
    text = F.col("text").cast("string")
    lines = docs.filter(text.isNotNull()).select(F.xxhash64(text).alias("k"), F.explode(F.split(text, "\n")).alias("line"))
    blanks = F.octet_length("mask") - F.octet_length(F.replace("mask", F.lit(" ")))
    return lines.select("k", masked_line(F.col("line")).alias("mask")).withColumn("n", blanks + 1).filter(F.col("n") >= min_tokens)


def dropped_lines(docs: DataFrame, depth: int, min_docs: int, min_tokens: int, min_constant: float) -> tuple[DataFrame, DataFrame]:
    """``(line, template)`` of the dropped lines and ``(k, line)`` of the texts that hold them."""
    parsed = _parsed(docs, min_tokens)
    leaf = F.md5(F.concat_ws(" ", F.col("n").cast("string"), F.substring_index("mask", " ", depth)))
    lines = written(parsed.select("k", leaf.alias("leaf"), F.xxhash64("mask").alias("line")).distinct(), "lines")
    two = lines.groupBy("k").agg(F.slice(F.array_sort(F.collect_set("leaf")), 1, 2).alias("m"))
    other = F.when(F.col("leaf") != F.col("m")[0], F.col("m")[0]).otherwise(F.coalesce(F.get("m", F.lit(1)), F.col("leaf")))
    known = written(lines.join(two, "k").select("k", "leaf", "line", other.alias("id")), "lines-id")
    hot = known.groupBy("leaf").agg(F.count_distinct("id").alias("n")).filter(F.col("n") >= min_docs).select("leaf")
    held = written(known.join(hot, "leaf", "left_semi"), "lines-hot")

    distinct = written(held.groupBy("leaf", "line").agg(F.count_distinct("k").alias("docs"), F.min("k").alias("k")), "lines-distinct")
    # one text of each line gives its mask, so a line that very many texts share does not meet in one task
    givers = distinct.select(F.col("k").alias("_ld_k")).distinct()
    if distinct.count() <= MOST_BROADCAST:  # only the texts that give a mask are parsed again; else all, and a shuffle join picks
        docs = docs.join(F.broadcast(givers), F.xxhash64(F.col("text").cast("string")) == F.col("_ld_k"), "left_semi")
    masks = _parsed(docs, min_tokens).select("k", F.xxhash64("mask").alias("line"), "mask").join(distinct.select("k", "line"), ["k", "line"], "left_semi").groupBy("line").agg(F.min("mask").alias("mask"))
    whole = written(distinct.drop("k").join(masks, "line"), "line-masks")
    at = whole.select("leaf", "line", "docs", F.posexplode(F.split("mask", " ")).alias("pos", "token"))
    rare = at.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("n"))
    fixed = F.when(F.col("n") >= min_docs, F.col("token")).otherwise("<*>")
    general = (at.join(rare, ["leaf", "pos", "token"]).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("pos", fixed.alias("token")))).alias("t"))
               .select("line", F.col("t.token").alias("t")))
    constant = F.size(F.filter("t", lambda x: x != "<*>")) >= F.lit(min_constant) * F.size("t")
    templates = whole.join(general, "line").select("leaf", "line", F.concat_ws(" ", "leaf", F.when(constant, F.array_join("t", " ")).otherwise(F.col("mask"))).alias("template"))
    templates = written(templates, "line-templates")
    uses = held.join(templates, ["leaf", "line"])
    per = uses.groupBy("template").agg(F.count_distinct("id").alias("ids"), F.count_distinct("k").alias("docs"))
    recurring = per.filter((F.col("ids") >= min_docs) & (2 * F.col("ids") >= F.col("docs"))).select("template")
    gone = written(uses.join(recurring, "template", "left_semi").select("k", "line", "template"), "line-drops")
    return gone.select("line", "template").distinct(), gone.select("k", "line").distinct()


def drop_recurring_lines(docs: DataFrame, depth: int = 3, min_docs: int = 5, min_tokens: int = 5, min_constant: float = 0.7, counts: bool = True) -> DataFrame:
    """``docs`` with recurring lines cut from ``text``, and ``n_lines`` / ``n_dropped`` of each row if ``counts``.

    With ``counts``, columns of those two names in ``docs``, in any case, give way to them.
    """
    _, by_text = dropped_lines(docs, depth, min_docs, min_tokens, min_constant)
    drops = by_text.groupBy("k").agg(F.collect_set("line").alias("_ld_drop")).withColumnRenamed("k", "_ld_k")
    text = F.col("text").cast("string")
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    kept = F.filter(F.col("_ld_lines"), lambda x: ~F.array_contains(F.col("_ld_drop"), F.xxhash64(masked_line(x))))
    # one way of joining at all sizes, so the disk taken grows as the texts do
    out = docs.withColumn("_ld_k", F.xxhash64(text)).join(drops.hint("merge"), "_ld_k", "left").withColumn("_ld_lines", lines)
    out = out.withColumn("_ld_kept", F.when(F.col("_ld_drop").isNull(), F.col("_ld_lines")).otherwise(kept))
    cut = F.when(F.col("_ld_drop").isNull(), text).otherwise(F.array_join("_ld_kept", "\n"))
    more = [F.size("_ld_lines").alias("n_lines"), (F.size("_ld_lines") - F.size("_ld_kept")).alias("n_dropped")] if counts else []
    own = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*[cut.alias("text") if c == "text" else F.col(f"`{c}`") for c in own], *more)


ORACLE = """
WITH d AS (SELECT doc_id, text, md5(text) AS k FROM documents),
l0 AS (SELECT DISTINCT k, unnest(string_split(text, chr(10))) AS raw FROM d WHERE text IS NOT NULL),
l1 AS (SELECT k, raw, regexp_replace(array_to_string(list_filter(string_split(translate(raw, chr(9) || chr(13), '  '), ' '), lambda x: x <> ''), ' '),
       '[^ ]*[0-9][^ ]*', '<*>', 'g') AS mask FROM l0),
l2 AS (SELECT k, raw, mask, string_split(mask, ' ') AS t FROM l1),
l3 AS (SELECT DISTINCT k, mask, md5(len(t)::VARCHAR || ' ' || array_to_string(t[1:3], ' ')) AS leaf FROM l2 WHERE len(t) >= 5),
ident AS (SELECT k, list_sort(list(DISTINCT leaf)) AS m FROM l3 GROUP BY k),
known AS (SELECT l3.*, CASE WHEN leaf <> m[1] THEN m[1] ELSE coalesce(m[2], leaf) END AS id FROM l3 JOIN ident USING (k)),
hot AS (SELECT leaf FROM known GROUP BY leaf HAVING count(DISTINCT id) >= 5),
held AS (SELECT * FROM known WHERE leaf IN (SELECT leaf FROM hot)),
distinct_lines AS (SELECT leaf, mask, count(DISTINCT k) AS docs, string_split(mask, ' ') AS t FROM held GROUP BY leaf, mask),
toks AS (SELECT leaf, mask, docs, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM distinct_lines),
rare AS (SELECT leaf, pos, token, sum(docs) AS n FROM toks GROUP BY ALL),
general AS (SELECT leaf, mask, list(CASE WHEN n >= 5 THEN token ELSE '<*>' END ORDER BY pos) AS t FROM toks JOIN rare USING (leaf, pos, token) GROUP BY leaf, mask),
templates AS (SELECT leaf, mask, leaf || ' ' || CASE WHEN len(list_filter(t, lambda x: x <> '<*>')) >= 0.7 * len(t) THEN array_to_string(t, ' ') ELSE mask END AS template FROM general),
uses AS (SELECT held.*, template FROM held JOIN templates USING (leaf, mask)),
gone AS (SELECT DISTINCT mask FROM uses WHERE template IN (SELECT template FROM uses GROUP BY template HAVING count(DISTINCT id) >= 5 AND 2 * count(DISTINCT id) >= count(DISTINCT k))),
parts AS (SELECT doc_id, text, k, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM d),
marked AS (SELECT p.doc_id, p.text, p.raw, p.pos, g.mask IS NOT NULL AS drop FROM parts p LEFT JOIN (SELECT DISTINCT k, raw, mask FROM l1) l ON p.k = l.k AND p.raw = l.raw LEFT JOIN gone g ON l.mask = g.mask)
SELECT doc_id, count(*)::INT AS n_lines, sum(drop::INT)::INT AS n_dropped,
       CASE WHEN any_value(text) IS NULL THEN NULL ELSE coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT drop), '') END AS text
FROM marked GROUP BY doc_id
"""
