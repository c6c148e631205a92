"""Inputs for registered queries, read from the given tables.

The test tables carry no wiki markup, speaker tags or tokens, so a few columns
are *derived* from them (every row kept, only the text altered) with the same
expression here and in ``sql_inputs`` (DuckDB):

* articles: ``doc_id % 7 = 0`` -> title prefixed ``List of``; ``% 11 = 0`` ->
  a last line ``{title} may refer to:``; ``% 5 = 0`` -> ``References`` heading
  inserted before the last line; ``% 3 = 0`` -> last line ``Category:{lang}``.
* dialog utterances: ``<speaker1>`` for user turns, ``<speaker2>`` for assistant
  turns, nothing for system turns.
* tokens: words of ``basic_tokens``, id = rank in the sorted vocabulary + 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.sources.tables import read_table

NL = "\n"


def table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    """Pruned scan of a given table, spread to the default parallelism if it is one split."""
    return read_table(spark, d, name, *cols)


def articles_raw(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, lang, text)`` article text with derived wiki markup."""
    doc = table(spark, d, "documents", "doc_id", "lang", "text")
    t1 = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("List of "), "text")).otherwise(F.col("text"))
    doc = doc.withColumn("t", t1)
    title = F.substring_index("t", NL, 1)
    doc = doc.withColumn("t", F.when(F.col("doc_id") % 11 == 0, F.concat("t", F.lit(NL), title, F.lit(" may refer to:"))).otherwise(F.col("t")))
    last = F.substring_index("t", NL, -1)
    before = F.col("t").substr(F.lit(1), F.length("t") - F.length(last) - 1)
    refs = F.concat(before, F.lit(NL + "References" + NL), last)
    doc = doc.withColumn("t", F.when((F.col("doc_id") % 5 == 0) & (F.instr("t", NL) > 0), refs).otherwise(F.col("t")))
    doc = doc.withColumn("t", F.when(F.col("doc_id") % 3 == 0, F.concat("t", F.lit(NL + "Category:"), "lang")).otherwise(F.col("t")))
    return doc.select("doc_id", "lang", F.col("t").alias("text"))


def dialog_turns(spark: SparkSession, d: str) -> DataFrame:
    """``(conv_id, turn, utterance)`` with derived speaker tokens."""
    c = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    tag = F.when(F.col("role") == "user", "<speaker1>").when(F.col("role") == "assistant", "<speaker2>").otherwise("")
    return c.select("conv_id", "turn", F.concat(tag, "text").alias("utterance"))


def arr_str(c, sep: str = " ") -> "F.Column":
    """Array -> string for comparable output (oracles return strings, not arrays)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.array_join(col.cast("array<string>"), sep)
