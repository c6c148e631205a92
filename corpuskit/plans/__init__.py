"""Registered queries: each reads the given tables and returns a DataFrame."""

from corpuskit.plans import q_cleaning, q_metrics, q_mix_batch, q_mlm, q_objectives, q_packing, q_reports, q_retrieval, q_retrieval_samples, q_shards, q_sources, q_streaming, q_subword, q_tokens  # noqa: F401
from corpuskit.plans.registry import ORACLES, QUERIES  # noqa: F401
