"""Toxicity by multiple-instance learning.

Only documents carry labels; sentences do not.  A sentence's probability is a
logistic function of its hashed words, a document's is the noisy-or of its
sentences, ``1 - (1 - leak) * prod(1 - p)``; the leak takes up labels that no
sentence explains.  Weights are learned from document labels by gradient steps
through the noisy-or.  The fitted sentence scores then point to the offending
sentences.

The fit uses a bounded sample: at most ``max_docs`` labelled rows in the order
of a hash of their id.  Everything else reads all rows and whole texts.

Defined results: a null or empty text has no sentence and scores as the noisy-or
of none, 0; a null id is held out and scored; repeated rows score alike; labels
other than 0 and 1 are not learned from; without labelled rows of both kinds
every score is 0; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import fold

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")
N_HASH = 1 << 20


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.findall(text or "") if not s.isspace()]


def sentence_words(sentence: str, cache: dict) -> list[int]:
    """Hashes of a sentence's distinct words."""
    out = []
    for w in set(_WORD.findall(sentence.lower())):
        h = cache.get(w)
        if h is None:
            if len(cache) > 300_000:
                cache.clear()
            h = cache[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % N_HASH
        out.append(h)
    return out


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def sentence_scores(self, words: list[list[int]]) -> np.ndarray:
        """Probability of each sentence."""
        if not words:
            return np.zeros(0)
        flat = np.fromiter((h for s in words for h in s), dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), [len(s) for s in words])
        return 1 / (1 + np.exp(-(self.bias + np.bincount(owner, self.weights[flat], minlength=len(words)))))

    def score(self, text: str | None, cache: dict) -> float:
        p = self.sentence_scores([sentence_words(s, cache) for s in sentences(text)])
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def _fit(word: np.ndarray, sentence_words_: np.ndarray, doc_sentences: np.ndarray, y: np.ndarray, steps: int, rate: float, l2: float, min_docs: int, min_lift: float) -> ToxicityModel:
    """Full-batch Adam on the noisy-or likelihood, from flat word hashes, words per sentence and sentences per document.

    Words of at least ``min_docs`` documents take part whose share of toxic
    documents is ``min_lift`` standard errors from the overall share.
    """
    if not len(word) or not 0 < y.sum() < len(y):
        return ToxicityModel(np.zeros(N_HASH), -30.0)
    word = word.astype(np.int64)
    sent = np.repeat(np.arange(len(sentence_words_)), sentence_words_)
    doc = np.repeat(np.arange(len(doc_sentences)), doc_sentences)
    seen = np.unique(doc[sent] * N_HASH + word)
    n_docs, n_toxic = np.bincount(seen % N_HASH, minlength=N_HASH), np.bincount(seen % N_HASH, y[seen // N_HASH], minlength=N_HASH)
    prior = y.mean()
    lift = (n_toxic - n_docs * prior) / np.sqrt(np.maximum(n_docs, 1) * prior * (1 - prior))
    keep = np.flatnonzero((n_docs >= min_docs) & (np.abs(lift) >= min_lift))
    index = np.full(N_HASH, -1)
    index[keep] = np.arange(len(keep))
    use = index[word] >= 0
    sent, word, n = sent[use], index[word[use]], len(keep)
    theta = np.zeros(n + 2)
    theta[n], theta[n + 1] = -7.0, -2.0  # bias, leak
    m, v, n_sent, n_doc = np.zeros(n + 2), np.zeros(n + 2), len(doc), len(y)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(theta[n] + np.bincount(sent, theta[word], minlength=n_sent), -30, 30)))
        leak = 1 / (1 + np.exp(-theta[n + 1]))
        log_none = np.bincount(doc, np.log1p(-p), minlength=n_doc) + np.log1p(-leak)
        prob = np.clip(-np.expm1(log_none), 1e-9, 1)
        g = np.where(y == 1, np.exp(log_none) / prob, -1.0)  # slope of the loss along log_none
        by_sent = -g[doc] * p
        grad = np.empty(n + 2)
        grad[:n] = np.bincount(word, by_sent[sent], minlength=n) + l2 * theta[:n]
        grad[n], grad[n + 1] = by_sent.sum(), -(g * leak).sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(N_HASH)
    weights[keep] = theta[:n]
    return ToxicityModel(weights, float(theta[n]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out_mod: int = 3, held_out: int = 1, max_docs: int = 6000,
                 steps: int = 150, rate: float = 0.1, l2: float = 0.05, min_docs: int = 5, min_lift: float = 4.0) -> ToxicityModel:
    """Model from at most ``max_docs`` labelled rows outside the held-out fold, first in hash order."""
    marked = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
              .filter(F.col("y").isin(0, 1) & (fold("doc_id", held_out_mod) != held_out)))
    sample = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_docs))  # at most max_docs narrow rows

    @F.pandas_udf("array<array<int>>")
    def words(text: pd.Series) -> pd.Series:
        cache: dict = {}
        return text.map(lambda t: [sentence_words(s, cache) for s in sentences(t)])

    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")
            .orderBy(F.xxhash64("doc_id", "text")).limit(max_docs).select("doc_id", "y", words("text").alias("s")).toArrow())
    table = rows.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    bags = table.column("s").combine_chunks()
    parts = bags.flatten()
    return _fit(parts.flatten().to_numpy(), parts.value_lengths().to_numpy(), bags.value_lengths().to_numpy(), table.column("y").to_numpy().astype(np.int64), steps, rate, l2, min_docs, min_lift)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, held_out_mod: int = 3, held_out: int = 1) -> DataFrame:
    """``(doc_id, held_out, score)`` for every row, from its whole text, in one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # 4 MB, of fixed size

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        own, cache = ToxicityModel(*shared.value), {}
        return text.map(lambda t: own.score(t, cache)).astype("float64")

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold("doc_id", held_out_mod) == held_out, F.lit(True)).alias("held_out"), score(F.col("text").cast("string")).alias("score"))


def locate_sentences(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, sentence_no, start, sentence, score)`` of the sentences that score at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def located(parts):
        own, cache = ToxicityModel(*shared.value), {}
        for pdf in parts:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                found = [x for x in _SENTENCE.finditer(text or "") if not x.group().isspace()]
                p = own.sentence_scores([sentence_words(x.group(), cache) for x in found])
                rows += [(doc_id, k, x.start(), x.group().strip(), float(p[k])) for k, x in enumerate(found) if p[k] >= threshold]
            yield pd.DataFrame(rows, columns=["doc_id", "sentence_no", "start", "sentence", "score"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(located, "doc_id string, sentence_no bigint, start bigint, sentence string, score double").withColumn("doc_id", F.col("doc_id").cast("bigint"))
