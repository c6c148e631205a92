"""The pipeline's stages on the smallest tables: each stage's own decision, and the packed result."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from corpuskit.llm.common import written
from corpuskit.llm.queries import tokenizer_file

from ..conftest import SMALL
from .test_operators import _jaccard_classes


def test_stages_in_order_and_packed_texts(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, states = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), "test-stage")
        assert docs.columns == columns
        states.append(docs)
    raw, good, lined, single, clean = [[tuple(r) for r in s.select("doc_id", "text").orderBy("doc_id").collect()] for s in states]
    assert len(raw) > len(good) > 0 and {i for i, _ in lined} == {i for i, _ in good}
    assert all(len(b) <= len(a) for (_, a), (_, b) in zip(good, lined))
    _, root = _jaccard_classes(lined)
    assert [i for i, _ in single] == sorted({min(lined[j][0] for j in range(len(lined)) if root[j] == r) for r in root})
    assert {i for i, _ in clean} < {i for i, _ in single}
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).toPandas()
    whole = Tokenizer.from_file(tokenizer_file())
    for i, text in clean:
        own = got[got.doc_id == i].sort_values("start")
        assert np.frombuffer(b"".join(own.ids), dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids + [0]
    assert set(got.doc_id) == {i for i, _ in clean}


def test_odd_and_empty_documents(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (None, "Some few words here.", None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SMALL), "test-odd")
        assert docs.count() >= 0
