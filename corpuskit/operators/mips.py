"""Exact inner-product search with pruning (H5).

Vectors are dealt to clusters (centers fitted on a bounded sample; any centers give right
results), ordered by cluster and norm, and stored as *blocks* of bounded bytes, each
with its center ``c``, radius ``r`` and largest norm ``M``.  For a query ``q`` no vector of a
block scores above ``min(q.c + |q| r, |q| M)``.

1. Each query block is multiplied with the few corpus blocks that look best to it, which gives
   every query a k-th score so far.
2. Blocks whose bound is below that for all queries of a query block are skipped; the others are
   multiplied, and only with the queries they can matter to.

The bounds are conservative (a relative slack covers rounding), so the result equals the full
product; ``MipsSearch.products`` reports how much of it was made.  Every cell is one numpy product
of two bounded blocks, and a corpus block that very many query blocks need is dealt over salts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.session import written

#: Bytes of a corpus block's matrix, rows of a query block, query blocks in one task's group, blocks in a row of bounds.
BLOCK_BYTES = 8 << 20
QUERY_ROWS = 512
GROUP = 32
BOUNDS = 512
#: Vectors from which the centers are fitted, and the most centers.
SAMPLE, CENTERS = 8192, 256
SLACK = 1e-9

BLOCK = "block string, ids binary, matrix binary, n int, dim int, center array<double>, radius double, norm double"
PAIRS = "query_id long, vec_id long, score double, qblock string"


def _centers(df: DataFrame, vid: str, vec: str, n_centers: int) -> np.ndarray:
    """A few rounds of k-means on at most ``SAMPLE`` vectors (by hash order)."""
    rows = df.select(vec).orderBy(F.xxhash64(vid), vid).limit(SAMPLE).collect()
    x = np.array([r[0] for r in rows], dtype=np.float64)
    c = x[:: max(1, len(x) // n_centers)][:n_centers].copy()
    for _ in range(5):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - (c * c).sum(axis=1) / 2, axis=1)


def _block_row(name: str, ids: np.ndarray, x: np.ndarray) -> dict:
    center = x.mean(axis=0)
    return {"block": name, "ids": ids.astype("<i8").tobytes(), "matrix": x.astype("<f8").tobytes(), "n": len(ids), "dim": x.shape[1], "center": center.tolist(),
            "radius": float(np.sqrt(((x - center) ** 2).sum(axis=1).max())), "norm": float(np.sqrt((x**2).sum(axis=1).max()))}


def vector_blocks(df: DataFrame, vid: str, vec: str, rows: int, centers: np.ndarray | None, name: str) -> DataFrame:
    """Blocks of up to ``rows`` vectors, near ones together; null vectors are left out."""
    d = df.select(F.col(vid).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))

    @F.pandas_udf("int")
    def cluster(v: pd.Series) -> pd.Series:
        return pd.Series(_nearest(np.stack(v.to_numpy()), centers) if len(v) else [], dtype="int32")

    d = d.withColumn("cluster", cluster("v") if centers is not None and len(centers) > 1 else F.lit(0)).withColumn("norm", norm)
    d = d.repartitionByRange("cluster", "norm", "id").sortWithinPartitions("cluster", "norm", "id").withColumn("task", F.spark_partition_id())

    def cut(batches):
        made, waiting, task, kind = 0, [], 0, None

        def block():
            pdf = pd.concat(waiting)
            return pd.DataFrame([_block_row(f"{name}{task}-{made}", pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()))])

        for pdf in batches:
            task = int(pdf["task"].iloc[0]) if len(pdf) else task
            edges = np.flatnonzero(np.diff(pdf["cluster"].to_numpy())) + 1
            for lo, hi in zip([0, *edges], [*edges, len(pdf)]):
                part = pdf.iloc[lo:hi]
                while len(part):
                    if waiting and part["cluster"].iloc[0] != kind:
                        yield block()
                        waiting, made = [], made + 1
                    kind = part["cluster"].iloc[0]
                    room = rows - sum(len(w) for w in waiting)
                    waiting.append(part.iloc[:room])
                    part = part.iloc[room:]
                    if sum(len(w) for w in waiting) == rows:
                        yield block()
                        waiting, made = [], made + 1
        if waiting:
            yield block()

    return written(d.mapInPandas(cut, BLOCK), "vector-blocks")


def _matrix(row) -> np.ndarray:
    return np.frombuffer(row["matrix"], "<f8").reshape(row["n"], row["dim"])


def _bounds(q: np.ndarray, centers: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Upper bounds of each query on each block."""
    size = np.sqrt((q**2).sum(axis=1))[:, None]
    ball, whole = q @ centers.T + size * radius, size * norm
    return np.minimum(ball, whole) + SLACK * (size * norm + 1)


def _top(scores: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None) -> pd.DataFrame:
    """Per row the k best and all that tie with the last of them."""
    if scores.shape[1] > k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        least = kth if least is None else np.maximum(kth, least)
    rows, cols = np.nonzero(scores >= least[:, None]) if least is not None else np.nonzero(np.ones_like(scores, dtype=bool))
    return pd.DataFrame({"query_id": queries[rows], "vec_id": ids[cols], "score": scores[rows, cols]})


@dataclass
class MipsSearch:
    """``topk()`` of every query over ``corpus`` by inner product; ties go to the smaller vector id."""

    corpus: DataFrame
    queries: DataFrame
    k: int
    vid: str = "vec_id"
    vvec: str = "embedding"
    qid: str = "query_id"
    qvec: str = "query"
    block_bytes: int = BLOCK_BYTES
    query_rows: int = QUERY_ROWS
    probes: int = 4
    _cells: list[DataFrame] = field(default_factory=list)

    def _blocks(self) -> tuple[DataFrame, DataFrame, int]:
        some = self.corpus.filter(F.col(self.vvec).isNotNull())
        size = some.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(self.vvec)).alias("dim")).first()
        rows = max(1, self.block_bytes // (8 * max(1, size["dim"] or 1)))
        wanted = math.ceil(size["n"] / rows)
        centers = _centers(some, self.vid, self.vvec, min(CENTERS, wanted)) if wanted > 1 else None
        blocks = vector_blocks(self.corpus, self.vid, self.vvec, rows, centers, "c")
        return blocks, vector_blocks(self.queries, self.qid, self.qvec, self.query_rows, centers, "q"), wanted

    def _multiplied(self, cells: DataFrame, queries: DataFrame, blocks: DataFrame) -> DataFrame:
        """Candidates of the cells ``(qblock, block)``; ``queries`` may carry ``least``, the k-th scores so far."""
        k = self.k
        salt = F.pmod(F.xxhash64("qblock"), F.col("salts")).cast("int")
        dealt = cells.join(cells.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("salts")), "block").withColumn("salt", salt)
        dealt = written(dealt.select("block", "salt", "qblock"), "mips-dealt")
        right = dealt.join(queries, "qblock").withColumnsRenamed({"block": "q_of", "salt": "q_salt"})
        left = dealt.select("block", "salt").distinct().join(blocks, "block")

        def cell(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "qblock": pd.Series(dtype=object)})]
            for _, b in own.iterrows():
                x, ids = _matrix(b), np.frombuffer(b["ids"], "<i8")
                for _, q in others.iterrows():
                    queries, names, least = _matrix(q), np.frombuffer(q["ids"], "<i8"), None
                    if q["least"] is not None and len(q["least"]):
                        least = np.asarray(q["least"], dtype=np.float64)
                        can = _bounds(queries, np.array([b["center"]]), np.array([b["radius"]]), np.array([b["norm"]]))[:, 0] >= least
                        queries, names, least = queries[can], names[can], least[can]
                    if len(names):
                        out.append(_top(queries @ x.T, ids, names, k, least).assign(qblock=q["block_q"]))
            return pd.concat(out)

        return left.groupBy("block", "salt").cogroup(right.groupBy("q_of", "q_salt")).applyInPandas(cell, PAIRS)

    def _bound_rows(self, blocks: DataFrame, queries: DataFrame, out: str, fn) -> DataFrame:
        """``fn`` on every query block with rows of up to ``BOUNDS`` blocks' bounds: a product of two tables of blocks."""
        spread = F.pmod(F.xxhash64("block"), F.lit(max(1, math.ceil(self._n_blocks / BOUNDS))))
        bounds = blocks.select(spread.alias("s"), "block", "center", "radius", "norm", "n").groupBy("s").agg(F.collect_list(F.struct("block", "center", "radius", "norm", "n")).alias("bounds"))
        both = queries.crossJoin(bounds.select("bounds"))

        def each(batches):
            for pdf in batches:
                for _, r in pdf.iterrows():
                    b = r["bounds"]
                    yield fn(r, [x["block"] for x in b], np.array([x["center"] for x in b]), np.array([x["radius"] for x in b]), np.array([x["norm"] for x in b]), np.array([x["n"] for x in b]))

        return both.mapInPandas(each, out)

    def topk(self) -> DataFrame:
        """``(query_id, rank, vec_id, score)``, ``rank`` from 1."""
        blocks, qblocks, self._n_blocks = self._blocks()
        q = qblocks.select(F.col("block").alias("qblock"), F.col("block").alias("block_q"), "ids", "matrix", "n", "dim")
        none = F.lit(None).cast("array<double>").alias("least")
        if self._n_blocks <= 1:  # nothing to prune
            cells = q.select("qblock").crossJoin(blocks.select("block"))
            self._cells = [cells.join(q.select("qblock", F.col("n").alias("queries")), "qblock")]
            return self._ranked(self._multiplied(cells, q.select("*", none), blocks))

        probes = self.probes

        def promising(r, names, centers, radius, norm, n):
            mean = (_matrix(r) @ centers.T).mean(axis=0)
            best = np.argsort(-mean)[:probes]
            return pd.DataFrame({"qblock": r["qblock"], "block": [names[i] for i in best], "mean": mean[best]})

        w = Window.partitionBy("qblock").orderBy(F.col("mean").desc(), "block")
        first = self._bound_rows(blocks, q, "qblock string, block string, mean double", promising).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= probes)
        first = written(first.select("qblock", "block"), "mips-probes")
        seen = written(self._multiplied(first, q.select("*", none), blocks), "mips-candidates")

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        kth = seen.withColumn("rank", rank).filter(F.col("rank") == self.k).groupBy("qblock").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "score"))).alias("kth"))

        @F.pandas_udf("array<double>")
        def in_order(ids: pd.Series, kth: pd.Series) -> pd.Series:
            return pd.Series([[(k or {}).get(int(i), -np.inf) for i in np.frombuffer(b, "<i8")] for b, k in zip(ids, kth)])

        q = written(q.join(kth, "qblock", "left").select(*q.columns, in_order("ids", F.coalesce("kth", F.create_map().cast("map<bigint,double>"))).alias("least")), "mips-queries")

        def needed(r, names, centers, radius, norm, n):
            can = (_bounds(_matrix(r), centers, radius, norm) >= np.asarray(r["least"])[:, None]).sum(axis=0)
            at = np.flatnonzero(can)
            return pd.DataFrame({"qblock": r["qblock"], "block": [names[i] for i in at], "queries": can[at].astype("int32")})

        second = self._bound_rows(blocks, q, "qblock string, block string, queries int", needed).join(first, ["qblock", "block"], "left_anti")
        second = written(second, "mips-cells")
        self._cells = [first.join(q.select("qblock", F.col("n").alias("queries")), "qblock"), second]
        more = self._multiplied(second.select("qblock", "block"), q, blocks)
        self._all_blocks, self._all_queries = blocks, q
        return self._ranked(seen.unionByName(more))

    def products(self) -> DataFrame:
        """``(made, all)``: products of a query with a vector that the last ``topk()`` made, and those of the full product."""
        blocks, q = self._all_blocks, self._all_queries
        cells = self._cells[0].select("block", "queries").unionByName(self._cells[1].select("block", "queries"))
        made = cells.join(blocks.select("block", "n"), "block").agg(F.sum(F.col("queries").cast("bigint") * F.col("n")).alias("made"))
        return made.crossJoin(blocks.agg(F.sum("n").alias("v"))).crossJoin(q.agg(F.sum("n").alias("q"))).select("made", (F.col("v") * F.col("q")).alias("all"))

    def _ranked(self, found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
        r = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= self.k)
        return r.select(F.col("query_id").alias(self.qid), F.col("rank").cast("int"), F.col("vec_id").alias(self.vid), "score")
