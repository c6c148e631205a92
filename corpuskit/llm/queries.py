"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.llm import conv_trie, decontam, embed_dedup, filter_audit, jaccard, line_dedup, lm, packing, quality, secret_scan, suffix_dedup, toxicity, warc
from corpuskit.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def tokenizer_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_power_of_two_packing(spark, sf_dir):
    packed = packing.pack_power_of_two(table(spark, sf_dir, "documents"), tokenizer_file())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


@query
def op6_dictionary_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_fourier_quality(spark, sf_dir):
    scores = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op10_noisy_or_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(docs, model).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op5_template_line_dedup(spark, sf_dir):
    return line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


ORACLES["op5_template_line_dedup"] = line_dedup.ORACLE


@query
def op9_template_decontamination(spark, sf_dir):
    return decontam.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_itq_embedding_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op3_backoff_automaton(spark, sf_dir):
    return lm.score_texts(table(spark, sf_dir, "documents"))


@query
def op4_universe_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op7_prefix_doubling_dedup(spark, sf_dir):
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_filter_interaction_audit(spark, sf_dir):
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_interaction_audit"] = filter_audit.ORACLE


@query
def op12_secret_entropy_scan(spark, sf_dir):
    return secret_scan.digest_columns(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


@query
def op11_conversation_trie(spark, sf_dir):
    return conv_trie.conversation_trie(table(spark, sf_dir, "conversations"))


ORACLES["op11_conversation_trie"] = conv_trie.ORACLE
