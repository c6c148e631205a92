"""A sample of registered queries against their DuckDB oracles on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from corpuskit.session import TABLES

from .conftest import SMALL

SAMPLE = ["clean_articles", "clean_report", "flatten_dialogs", "split_sentences", "encode_corpus", "token_stats",
          "shard_with_short_valid", "split_train_valid_test", "pack_boundaries", "sentence_blocks", "blend",
          "cyclic_batches", "precision_recall_f1", "spearman", "token_f1", "corpus_bleu", "best_per_run",
          "patience", "mips_topk", "nucleus_filter", "spans_to_sentinels", "permute_noise", "read_text_shards"]


def _norm(df):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(round(x, 6) if isinstance(x, float) else x for x in rec))
    return cols, sorted(map(repr, out))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    exp = con.execute(entry.oracle_sql()[name]).df()
    assert _norm(got) == _norm(exp)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "documents" in df.columns
