"""Language-model scores from a weighted backoff automaton over smoothed bigrams.

States are the words seen in training plus a root; the arc of state ``h`` on word
``w`` weighs ``(c(hw) + mu * p(w)) / (c(h) + mu)``, the failure arc of ``h`` weighs
``mu / (c(h) + mu)`` and leads to the root, whose arc on ``w`` weighs
``p(w) = (c(w) + 1) / (N + V + 1)``.  So every state's weights add up to 1 over the
training words and one unknown word.  A text is read once from left to right:
the state is the last word, an arc or the failure arc gives each step's weight,
and their logarithms are summed.

The model is as large as the corpus and never in one place.  Texts are dealt into
chunks of bounded bytes; a chunk asks for the counts of its distinct n-grams
(with its own training counts), the requests meet by ranges of the n-gram's hash,
and each chunk gets back the totals of just its n-grams, from which it builds the
part of the automaton that its texts can reach.

Defined results: a null or empty text is one end token; a null id is held out;
repeated rows are learned from and scored each; ties do not matter; without
training rows every probability is 1 for the one unknown word; an empty table
gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import byte_words, fold, written

END = b"\n"  # no word holds white space
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class TokenRuns:
    """Tokens of several texts in a row: hash of each token, of its bigram, and its text."""

    token: np.ndarray
    previous: np.ndarray
    bigram: np.ndarray
    owner: np.ndarray


def token_runs(texts) -> TokenRuns:
    words, lengths = [], []
    for t in texts:
        own = byte_words(t)
        words += own
        words.append(END)
        lengths.append(len(own) + 1)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    token = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], dtype=np.uint64)[codes]
    end = np.uint64(xxhash.xxh3_64_intdigest(END))
    previous = np.concatenate([[end], token[:-1]]).astype(np.uint64)  # a text begins in the state of the end token
    with np.errstate(over="ignore"):
        bigram = (previous ^ (previous >> np.uint64(31))) * _ODD + token
        bigram = (bigram ^ (bigram >> np.uint64(29))) * _ODD
        bigram ^= bigram >> np.uint64(32)
    return TokenRuns(token, previous, bigram, np.repeat(np.arange(len(lengths)), lengths))


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the hash ranges begin in sorted keys."""
    bounds = np.array([(p << 64) // parts for p in range(parts)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


@dataclass
class BackoffAutomaton:
    """Arc and failure weights for the n-grams of some texts, aligned with sorted n-gram hashes."""

    words: np.ndarray
    word_counts: np.ndarray
    bigrams: np.ndarray
    bigram_counts: np.ndarray
    n: int
    v: int
    mu: float

    def traverse(self, runs: TokenRuns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each step: log10 weight of the step, log10 weight at the root, whether the word is known."""
        count = self.word_counts[np.searchsorted(self.words, runs.token)].astype(float)
        root = (count + 1) / (self.n + self.v + 1)
        state = self.word_counts[np.searchsorted(self.words, runs.previous)].astype(float)  # 0: the state is the root
        arc = self.bigram_counts[np.searchsorted(self.bigrams, runs.bigram)].astype(float)
        failure = self.mu / (state + self.mu)
        weight = np.where(arc > 0, (arc + self.mu * root) / (state + self.mu), failure * root)
        return np.log10(weight), np.log10(root), count > 0


def score_texts(docs: DataFrame, held_out_mod: int = 7, held_out: int = 2, mu: float = 50.0, chunk_bytes: int = 8 << 20, part_keys: int = 1_500_000) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1), F.count(F.lit(1))).first()
    total = (size[0] or 0) + size[1]
    chunks, parts = max(1, -(-total // chunk_bytes)), max(1, -(-total // (4 * part_keys)))
    rows = rows.withColumn("out", F.coalesce(fold("doc_id", held_out_mod) == held_out, F.lit(True)))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def ask(pdf):
        runs = token_runs(pdf["text"])
        learn = (~pdf["out"].to_numpy(bool))[runs.owner]
        found = []
        for order, keys in ((1, runs.token), (2, runs.bigram)):
            distinct, where = np.unique(keys, return_inverse=True)
            counts = np.bincount(where, learn, minlength=len(distinct)).astype("<u4")
            cuts = _cuts(distinct, parts)
            found += [(pdf["chunk"].iloc[0], order, p, distinct[a:b].tobytes(), counts[a:b].tobytes()) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return pd.DataFrame(found, columns=["chunk", "ngram", "part", "keys", "counts"])

    def answer(pdf):
        keys = [np.frombuffer(k, dtype=np.uint64) for k in pdf["keys"]]
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(where, np.concatenate([np.frombuffer(c, dtype="<u4") for c in pdf["counts"]]), minlength=len(distinct)).astype("<u8")
        ends = np.cumsum([len(k) for k in keys])
        out = pd.DataFrame({"chunk": pdf["chunk"], "ngram": pdf["ngram"], "part": pdf["part"], "counts": [totals[w].tobytes() for w in np.split(where, ends[:-1])]})
        own = pd.DataFrame({"chunk": [-1], "ngram": pdf["ngram"].iloc[:1], "part": pdf["part"].iloc[:1], "n": [int(totals.sum())], "v": [int((totals > 0).sum())]})
        return pd.concat([out, own], ignore_index=True)[["chunk", "ngram", "part", "counts", "n", "v"]].astype({"n": "Int64", "v": "Int64"})

    asked = dealt.groupBy("chunk").applyInPandas(ask, "chunk bigint, ngram int, part int, keys binary, counts binary")
    answers = written(asked.groupBy("ngram", "part").applyInPandas(answer, "chunk bigint, ngram int, part int, counts binary, n bigint, v bigint"), "lm-counts")
    whole = answers.filter("chunk = -1 AND ngram = 1").agg(F.sum("n"), F.sum("v")).first()
    n, v = int(whole[0] or 0), int(whole[1] or 0)

    def score(pdf, got):
        runs = token_runs(pdf["text"])

        def totals(order):
            own = got[got["ngram"] == order].sort_values("part")
            return np.concatenate([np.frombuffer(c, dtype="<u8") for c in own["counts"]])

        automaton = BackoffAutomaton(np.unique(runs.token), totals(1), np.unique(runs.bigram), totals(2), n, v, mu)
        step, root, known = automaton.traverse(runs)
        k = len(pdf)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["out"], "n_tokens": np.bincount(runs.owner, minlength=k), "n_known": np.bincount(runs.owner, known, minlength=k).astype(np.int64),
                             "train_tokens": n, "base_score": np.bincount(runs.owner, root, minlength=k), "score": np.bincount(runs.owner, step, minlength=k)})

    back = answers.filter("chunk >= 0").select("chunk", "ngram", "part", "counts")
    return dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
