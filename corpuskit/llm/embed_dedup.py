"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Fit: principal directions of a bounded sample of unit vectors, then a rotation
learned by alternating sign codes and orthogonal Procrustes steps, so that the
bits are balanced and lose little.  Index: every vector's code is cut into
``tables`` substrings; two vectors meet in a table if their substrings differ in
at most one bit, because each substring is entered once per masked bit.
Candidates within ``max_hamming`` bits are compared by the cosine of the original
vectors in double precision, each pair in one place only.

Equal vectors are one class from the start.  A bucket is split into blocks of
bounded size, and pairs of blocks are compared by different tasks, so neither a
hot bucket nor a large group of near copies meets in one task; pairs are counted
in place and only a star of links per block leaves it.

Defined results: null, zero or non-finite vectors, vectors with a null component
and vectors of another than the most frequent length link with nothing; a
repeated row is another vector that equals it; a null ``vec_id`` counts as a
neighbour but names no component (a component of null ids only is null) and is
never kept; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import connected_components, written


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 40, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of unit vectors to ``bits`` balanced directions."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    _, vectors = np.linalg.eigh(np.cov((unit - mean).T, bias=True).reshape(unit.shape[1], unit.shape[1]))
    base = vectors[:, ::-1][:, :bits]
    projected = (unit - mean) @ base
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(base.shape[1], base.shape[1])))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(projected @ rotation >= 0, 1.0, -1.0).T @ projected)
        rotation = (u @ vt).T
    return mean, base @ rotation


def substrings(bits: int, tables: int) -> list[tuple[int, int]]:
    """First bit and length of each table's substring."""
    cuts = [round(k * bits / tables) for k in range(tables + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def table_keys(codes: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """A row of keys per code: table, masked bit and the substring without that bit."""
    keys = []
    for t, (at, size) in enumerate(parts):
        sub = (codes >> np.uint64(at)) & np.uint64((1 << size) - 1)
        for bit in range(size):
            keys.append((np.uint64(t << 6 | bit) << np.uint64(32)) | (sub & ~np.uint64(1 << bit)))
    return np.stack(keys, axis=1).astype(np.int64)


def first_meeting(x: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """Of differing bits ``x``: ``table << 6 | masked bit`` of the first key that a pair shares, -1 for none."""
    out = np.full(x.shape, -1, dtype=np.int64)
    for t in range(len(parts) - 1, -1, -1):
        at, size = parts[t]
        sub = (x >> np.uint64(at)) & np.uint64((1 << size) - 1)
        near = np.bitwise_count(sub) <= 1
        bit = np.where(sub == 0, 0, np.bitwise_count(np.maximum(sub, np.uint64(1)) - np.uint64(1)).astype(np.int64))
        out = np.where(near, t << 6 | bit, out)
    return out


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """``rows(key, v, ...)`` of keys with two rows at least, copied to each pair ``lo <= hi`` of its key's blocks."""
    n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = F.pmod(F.xxhash64("v", "key"), F.ceil(F.col("n") / block)).cast("int")
    pairs = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int")))
    out = rows.join(n, "key").withColumn("b", own).withColumn("o", pairs)
    return out.select("key", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", *[c for c in rows.columns if c != "key"])


def _in_runs(rows: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(pdf)`` over whole runs of ``(key, lo, hi)`` in sorted partitions; a run is at most two blocks."""

    def stream(parts):
        left = None
        for pdf in parts:
            pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            k = pdf[["key", "lo", "hi"]].to_numpy()
            last = np.flatnonzero((k != k[-1]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            left = pdf.iloc[cut:]
            if cut:
                yield fn(pdf.iloc[:cut].reset_index(drop=True))
        if left is not None and len(left):
            yield fn(left.reset_index(drop=True))

    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "v").mapInPandas(stream, schema)


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, bits: int = 64, tables: int = 5, max_hamming: int = 18, sample_rows: int = 20_000, block: int = 1024) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``embeddings(vec_id, embedding)``.

    The rotation is fitted on at most ``sample_rows`` vectors (fewer if they exceed
    64 MB), first in hash order.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("e"))
    fine = F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0), F.lit(False))
    good = rows.filter(fine)
    size = good.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.coalesce(F.col("vec_id").isNotNull(), F.lit(False)).alias("kept"))
    dim = size["d"]
    bits = min(bits, dim)
    parts = substrings(bits, min(tables, bits))
    most = max(2, min(sample_rows, (64 << 20) // (8 * dim)))
    sample = good.filter(F.size("e") == dim).orderBy(F.xxhash64("e", "vec_id")).limit(most).select("e").toArrow().column("e")
    flat = np.array(sample.to_pylist(), dtype=np.float64).reshape(-1, dim)
    mean, projection = learn_rotation(flat, bits)
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)

    def coded(parts_):
        for pdf in parts_:
            x = np.array(pdf["e"].to_list(), dtype=np.float64).reshape(len(pdf), dim) + 0.0
            unit = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
            codes = ((unit - mean) @ projection >= 0) @ weights
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "code": codes.astype(np.uint64).astype(np.int64), "vector": [r.tobytes() for r in unit]})

    vectors = good.filter(F.size("e") == dim).mapInPandas(coded, "vec_id bigint, code bigint, vector binary").withColumn("v", F.xxhash64("vector"))
    classes = written(vectors.groupBy("v").agg(F.count(F.lit(1)).alias("rows"), F.min("vec_id").alias("least"), F.min("code").alias("code"), F.min("vector").alias("vector")), "classes")
    members = written(vectors.select("vec_id", "v"), "members")

    @F.pandas_udf("array<bigint>")
    def keys(code: pd.Series) -> pd.Series:
        return pd.Series(list(table_keys(code.to_numpy().astype(np.uint64), parts)))

    def close(pdf):
        """Rows with a partner within ``max_hamming`` bits whose first meeting is this key."""
        key, lo, hi, b = (pdf[c].to_numpy() for c in ("key", "lo", "hi", "b"))
        code, found = pdf["code"].to_numpy().astype(np.uint64), np.zeros(len(pdf), bool)
        for d in range(1, len(pdf)):
            same = (key[d:] == key[:-d]) & (lo[d:] == lo[:-d]) & (hi[d:] == hi[:-d])
            if not same.any():
                break
            at = np.flatnonzero(same & ((lo[d:] == hi[d:]) | (b[d:] != b[:-d])))
            x = code[at + d] ^ code[at]
            ok = at[(np.bitwise_count(x) <= max_hamming) & (first_meeting(x, parts) == key[at] >> 32)]
            found[ok] = found[ok + d] = True
        return pdf.loc[found, ["key", "v"]]

    entered = classes.select("v", "code", F.explode(keys("code")).alias("key"))
    candidates = written(_in_runs(_blocks(entered, block), close, "key bigint, v bigint").distinct(), "candidates")

    def linked(pdf):
        """Links of each row within its run, and the smallest vector that they connect it to."""
        out = []
        edges = np.flatnonzero((pdf[["key", "lo", "hi"]].diff().fillna(1) != 0).any(axis=1).to_numpy())
        all_x = np.frombuffer(b"".join(pdf["vector"]), dtype=np.float64).reshape(len(pdf), dim)
        code, b, v, weight, key = pdf["code"].to_numpy().astype(np.uint64), pdf["b"].to_numpy(), pdf["v"].to_numpy(), pdf["rows"].to_numpy(), pdf["key"].to_numpy()
        across = (pdf["lo"] != pdf["hi"]).to_numpy()
        for s, e in zip(edges, np.append(edges[1:], len(pdf))):
            x = code[s:e, None] ^ code[None, s:e]
            hit = (all_x[s:e] @ all_x[s:e].T >= threshold) & (np.bitwise_count(x) <= max_hamming) & (first_meeting(x, parts) == key[s] >> 32)
            np.fill_diagonal(hit, False)
            if across[s]:
                hit &= b[s:e, None] != b[None, s:e]
            if not hit.any():
                continue
            root = np.arange(e - s)  # rows are sorted by v: the smallest reachable index is the smallest vector
            while True:
                low = np.minimum(root, np.where(hit, root[None, :], e - s).min(axis=1))
                low = low[low]
                if (low == root).all():
                    break
                root = low
            some = np.flatnonzero(hit.any(axis=1))
            out.append(pd.DataFrame({"v": v[s:e][some], "links": (hit @ weight[s:e])[some], "root": v[s:e][root[some]]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"v": [], "links": [], "root": []}, dtype="int64")

    pairs = _blocks(candidates.join(classes.select("v", "code", "vector", "rows"), "v").select("key", "v", "code", "vector", "rows"), block)
    links = written(_in_runs(pairs, linked, "v bigint, links bigint, root bigint"), "links")
    named = connected_components(links.select("v", "root"), "v", "root")
    count = links.groupBy("v").agg(F.sum("links").alias("links"))
    known = classes.select("v", "rows", "least").join(count, "v", "left").join(named.withColumnRenamed("node", "v"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    known = written(known, "known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    result = members.join(known.select("v", "component", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links")), "v").join(least, "component")
    linked_rows = result.select("vec_id", "n_links", "component_id")
    alone = rows.filter(~fine | (F.size("e") != dim)).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
