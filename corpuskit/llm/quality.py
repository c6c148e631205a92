"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics of a text's shape (never its id, source, language or label) are
standardised, mapped to ``cos(Wx + b)`` features that approximate a Gaussian
kernel, and fitted by ridge regression: each task sums its rows' normal equations
and Spark adds those sums row by row, so any number of labelled rows is used.
The sums are kept by fold; scores of left-out folds are calibrated by isotonic
regression over score bins.

Defined results: a null text counts as empty, and empty texts are scored; a null
id is held out and scored; repeated rows are scored alike and each counts in the
fit; labels other than 0 and 1 and null labels are not learned from, and where a
document has several labels each counts; without labelled rows every score is
0.5; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from corpuskit.llm.common import fold, written

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t", "line": b"\n\r",
    "stop": b".!?", "comma": b",;:", "quote": b"'\"", "bracket": b"()[]{}", "pipe": b"|", "symbol": b"#$%&*@^~<>=+/\\_`", "dash": b"-",
}
_CLASS_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _k, _v in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_v)] = _k
N_STATS = len(_CLASSES) + 1 + 12


def text_stats(text: str | None) -> list[float]:
    """Shape of a whole text: shares of character classes, word, line and repetition statistics."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    shares = np.bincount(_CLASS_OF[np.frombuffer(raw, dtype=np.uint8)], minlength=len(_CLASSES) + 1) / max(n, 1)
    words = raw.split()
    k = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=k) if k else np.zeros(1)
    ends = sum(1 for w in counts if not w[-1:].isalnum() and w[-1] < 128)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:])) if k > 1 else 0
    top = max(counts.values(), default=0)
    once = sum(1 for v in counts.values() if v == 1)
    return [*shares.tolist(), np.log1p(n), np.log1p(k), float(lengths.mean()), float(lengths.std()), float(lengths.max()) ** 0.5, len(counts) / max(k, 1) ** 0.9,
            once / max(len(counts), 1), top / max(k, 1), same / max(k, 1), ends / max(len(counts), 1), np.log1p(k / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1)]


@F.pandas_udf(ArrayType(DoubleType()))  # no session is needed to import this module
def stats_udf(text: pd.Series) -> pd.Series:
    return text.map(text_stats)


@dataclass
class QualityModel:
    """Standardisation, random features, ridge weights and calibration knots; a few kilobytes."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    weights: np.ndarray = None
    knots_x: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    knots_y: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, self.knots_x, self.knots_y)


def _matrix(col) -> np.ndarray:
    return np.array(col.to_list(), dtype=np.float64).reshape(len(col), N_STATS)


def _fourier_sums(train: DataFrame, model: QualityModel, folds: int) -> list:
    """Normal equations ``[Z'Z | Z'y]`` by fold: a row per fold and feature, added up by Spark."""
    d = len(model.b) + 1

    def partial(parts):
        total = np.zeros((folds, d, d + 1))
        for pdf in parts:
            z, y, f = model.features(_matrix(pdf["x"])), pdf["y"].to_numpy(np.float64), pdf["f"].to_numpy()
            for k in range(folds):
                if (m := f == k).any():
                    total[k] += z[m].T @ np.hstack([z[m], y[m, None]])
        yield pd.DataFrame({"k": np.arange(folds * d), "v": list(total.reshape(folds * d, d + 1))})

    def added(pdf):
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})

    return train.mapInPandas(partial, "k int, v array<double>").groupBy("k").applyInPandas(added, "k int, v array<double>").collect()


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted ``x``; the fitted steps as interpolation knots."""
    blocks: list[list[float]] = []  # sum of y, weight, first x, last x
    for xi, yi, wi in zip(x, y, w):
        blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    kx = np.array([v for s, n, lo, hi in blocks for v in ((lo, hi) if hi > lo else (lo,))])
    ky = np.array([s / n for s, n, lo, hi in blocks for _ in range(2 if hi > lo else 1)])
    return kx, ky


def fit_quality(train: DataFrame, n_features: int = 256, ridge: float = 1e-3, width: float = 1.0, folds: int = 5, bins: int = 512, seed: int = 7) -> QualityModel:
    """Model from ``train(x array<double>, y 0/1, f fold number)``; only sums of bounded size reach the driver."""
    cols = [F.col("x")[i] for i in range(N_STATS)]
    row = train.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(N_STATS, n_features)) / (width * np.sqrt(N_STATS)), rng.uniform(0, 2 * np.pi, n_features)
    if not row[0]:
        return QualityModel(np.zeros(N_STATS), np.ones(N_STATS), w, b, np.zeros(n_features + 1))
    mean, scale = np.array(row[1:N_STATS + 1], float), np.maximum(np.array(row[N_STATS + 1:], float), 1e-6)
    model, d = QualityModel(mean, scale, w, b), n_features + 1
    sums = np.zeros((folds * d, d + 1))
    for r in _fourier_sums(train, model, folds):
        sums[r["k"]] = r["v"]
    sums = sums.reshape(folds, d, d + 1)

    def solve(s):
        penalty = np.diag([ridge * s[-1, -2]] * n_features + [1e-9])
        return np.linalg.solve(s[:, :-1] + penalty, s[:, -1])

    whole = sums.sum(axis=0)
    model.weights = solve(whole)
    left_out = np.stack([solve(whole - s) if (whole - s)[-1, -2] > 0 else model.weights for s in sums])
    lo, hi = -0.5, 1.5

    def binned(parts):
        for pdf in parts:
            raw = np.einsum("ij,ij->i", model.features(_matrix(pdf["x"])), left_out[pdf["f"].to_numpy()])
            yield pd.DataFrame({"bin": ((np.clip(raw, lo, hi) - lo) / (hi - lo) * (bins - 1)).round().astype(np.int64), "y": pdf["y"].astype(np.int64)})

    rows = train.mapInPandas(binned, "bin bigint, y bigint").groupBy("bin").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    x = np.array([r["bin"] for r in rows]) / (bins - 1) * (hi - lo) + lo
    prior = whole[-1, -1] / whole[-1, -2]
    model.knots_x, model.knots_y = isotonic(x, np.array([r["s"] for r in rows]) + 1e-3 * prior, np.array([r["n"] for r in rows], float) + 1e-3)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, held_out_mod: int = 5, **fit) -> DataFrame:
    """``(doc_id, held_out, score)`` for every row of ``docs(doc_id, text)``.

    One pass over the texts writes their statistics; the fit and the scores read
    only those.  Rows whose ``crc32(doc_id) mod held_out_mod`` is 0 are not learned from.
    """
    at = fold("doc_id", held_out_mod)
    stats = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), stats_udf(F.col("text").cast("string")).alias("x"))
                    .withColumn("held_out", F.coalesce(at == 0, F.lit(True))), "quality-stats")
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y IN (0, 1)")
    train = written(stats.filter(~F.col("held_out")).join(marked, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int").alias("f")), "quality-train")
    model = fit_quality(train, folds=5, **fit)

    def scored(parts):
        for pdf in parts:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": np.clip(model.score(_matrix(pdf["x"])), 0, 1)})

    return stats.mapInPandas(scored, "doc_id bigint, held_out boolean, score double")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out_mod: int = 5, **fit) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns kept."""
    ids = docs.select("doc_id", "text")
    at = fold("doc_id", held_out_mod)
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y IN (0, 1)")
    stats = ids.filter(at != 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), stats_udf(F.col("text").cast("string")).alias("x"))
    train = written(stats.join(marked, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int").alias("f")), "quality-train")
    model = fit_quality(train, folds=5, **fit)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(text.map(text_stats))) if len(text) else [], dtype="float64")

    return docs.filter(score(F.col("text").cast("string")) >= threshold)
