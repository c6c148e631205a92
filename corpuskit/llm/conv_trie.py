"""A prefix trie of conversations, its nodes in minimal-perfect-hash tables.

Conversations are rebuilt (a head shared by each hundred, then their own turns), and
every prefix gets a 128-bit digest: the exclusive or of digests of (depth, turn) up to
it.  That is associative, so a conversation of very many turns is cut into ranges whose
digests are combined, and no task walks it alone.  Digests are verified: all rows of a
digest must agree on depth, parent digest and last turn, which by induction makes it
stand for one sequence; if not, the digests are made anew from another seed.

Equal conversations become one class before anything is expanded.  Nodes are the
distinct digests with their counts, and the nodes' weight (class rows at or below them)
bounds their subtree.  Subtrees under the weight limit are dealt over shards; in a
shard a minimal perfect hash gives each digest a slot of its own, verified by the
stored digest, counts are scattered into flat arrays by slot, parents become slots, and
sums run from the deepest level up through the parent slots.  The few nodes above the
limit do the same afterwards in bands of depths, with what the shards hand them.

Defined results: a null role or text is empty; rows without a ``conv_id`` belong to no
conversation; a null turn comes first, equal turns are ordered by role and text, repeated
rows are turns of their own; an empty table has no root and gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import written

#: Conversations share the head of the first one of their block.
BLOCK, HEAD = 100, 6
#: Turns of one conversation that a task orders and digests together (by range of the turn number, or of the depth).
RANGE = 4096
#: Most nodes of a subtree in a shard, of a band, and of a table that is broadcast.
MOST_NODES = 200_000
#: A subtree holds at most this share of all nodes (if that is less), so that shards are even.
SHARE = 256

NODE = ["k1", "k2", "p1", "p2"]


# --- rebuilt conversations ---------------------------------------------------

def turn_positions(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn_digest, points)``: 1-based positions; the order within a conversation by ranges of turns."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    t = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        F.coalesce(F.floor(F.col("turn").cast("double") / RANGE), F.lit(-(1 << 62))).cast("bigint").alias("range"))
    per = t.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = (F.sum("n").over(Window.partitionBy("conv_id").orderBy("range")) - F.col("n")).alias("before")
    at = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    placed = t.join(per.select("conv_id", "range", before), ["conv_id", "range"]).withColumn("pos", (F.col("before") + at).cast("bigint"))
    return placed.select("conv_id", "pos", digest.alias("turn_digest"), F.length("text").cast("bigint").alias("points"))


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, depth, turn_digest, points)`` of every rebuilt conversation, its root row of depth 0 included."""
    turns = written(turn_positions(conversations), "trie-turns")
    head = F.array_sort(F.collect_list(F.struct("pos", "turn_digest", "points"))).alias("head")  # at most HEAD - 1 turns
    heads = turns.filter((F.col("conv_id") % BLOCK == 0) & (F.col("pos") < HEAD)).groupBy(F.col("conv_id").alias("base")).agg(head)
    ids = turns.select("conv_id").distinct().withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % HEAD).cast("int"))
    with_head = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "base", "left")
    shared = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h")))
    plan = written(with_head.select("conv_id", "h", shared.alias("shared")), "trie-heads")
    n = F.coalesce(F.size("shared"), F.lit(0))
    own = turns.join(plan.select("conv_id", "h", n.alias("n")), "conv_id").filter(F.col("pos") > F.col("h"))
    own = own.select("conv_id", (F.col("n") + F.col("pos") - F.col("h")).alias("depth"), "turn_digest", "points")
    taken = plan.select("conv_id", F.explode("shared").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.turn_digest", "t.points")
    root = plan.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(b"").alias("turn_digest"), F.lit(0).cast("bigint").alias("points"))
    return root.unionByName(taken).unionByName(own)


def prefixes(rebuilt: DataFrame, seed: int) -> DataFrame:
    """``rebuilt`` with the digest ``(k1, k2)`` of each prefix and ``(p1, p2)`` of its parent; the root's are 0."""
    def mixed(lane: int) -> Column:
        return F.when(F.col("depth") == 0, F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.lit(2 * seed + lane), "depth", "turn_digest"))

    r = rebuilt.withColumn("range", F.floor(F.col("depth") / RANGE)).withColumn("z1", mixed(0)).withColumn("z2", mixed(1))
    per = r.groupBy("conv_id", "range").agg(F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0).cast("bigint")).alias(f"o{i}") for i in (1, 2)]
    so_far = Window.partitionBy("conv_id", "range").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    r = r.join(per.select("conv_id", "range", *before), ["conv_id", "range"])
    for i in (1, 2):
        r = r.withColumn(f"k{i}", F.col(f"o{i}").bitwiseXOR(F.bit_xor(f"z{i}").over(so_far)))
    return r.select("conv_id", "depth", "turn_digest", "points", "k1", "k2", F.col("k1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("z2")).alias("p2"))


# --- node tables -------------------------------------------------------------

def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    for part in (b, np.uint64(0)):
        x = (x ^ part) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
    return x


class SlotTable:
    """Minimal perfect hash of distinct 128-bit keys: key -> slot in 0..n-1.

    Level by level, keys alone in their cell take it (its rank among taken cells is
    the slot), the others go to the next level.  A looked-up key must equal the one stored.
    """

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        a, b = k1.astype(np.int64).view(np.uint64), k2.astype(np.int64).view(np.uint64)
        self.levels, left, n = [], np.arange(len(a)), 0
        self.k1, self.k2 = np.empty(len(a), np.uint64), np.empty(len(a), np.uint64)
        self.slots = np.empty(len(a), np.int64)
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("keys of a slot table are not distinct")
            cell = (_mix(a[left], b[left], len(self.levels)) % np.uint64(2 * len(left))).astype(np.int64)
            alone = np.bincount(cell, minlength=2 * len(left)) == 1
            rank = np.cumsum(alone) - 1 + n
            self.levels.append((alone, rank))
            placed = alone[cell]
            self.slots[left[placed]] = rank[cell[placed]]
            left, n = left[~placed], n + int(alone.sum())
        self.k1[self.slots], self.k2[self.slots] = a, b

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for a key that is not in the table."""
        a, b = k1.astype(np.int64).view(np.uint64), k2.astype(np.int64).view(np.uint64)
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            cell = (_mix(a[left], b[left], level) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[cell]
            slot = rank[cell[hit]]
            same = (self.k1[slot] == a[left[hit]]) & (self.k2[slot] == b[left[hit]])
            out[left[hit][same]] = slot[same]
            left = left[~hit]
        return out


SUMS = "k1 long, k2 long, p1 long, p2 long, conv_id long, depth long, n_convs long, parent_conv long, outer boolean, n_children long, n_leaves long, saved_tokens long"


def accumulate(nodes: pd.DataFrame) -> pd.DataFrame:
    """Subtree sums of the nodes of a shard or band (``SUMS``); ``outer`` nodes have their parent elsewhere.

    ``children``, ``leaves`` and ``saved`` are what nodes of other tables below hand up.
    """
    table = SlotTable(nodes["k1"].to_numpy(), nodes["k2"].to_numpy())

    def by_slot(values) -> np.ndarray:
        flat = np.empty(len(nodes), np.int64)
        flat[table.slots] = values
        return flat

    depth, conv, n_convs = by_slot(nodes["depth"]), by_slot(nodes["conv_id"]), by_slot(nodes["n_convs"])
    p1, p2 = by_slot(nodes["p1"]), by_slot(nodes["p2"])
    parent = np.where(depth > 0, table.find(p1, p2), -1)
    children = by_slot(nodes["children"])
    np.add.at(children, parent[parent >= 0], 1)
    leaves = by_slot(nodes["leaves"]) + (children == 0)
    saved = by_slot(nodes["saved"]) + (n_convs - 1) * by_slot(nodes["points"])
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        inner = level[parent[level] >= 0]
        np.add.at(leaves, parent[inner], leaves[inner])
        np.add.at(saved, parent[inner], saved[inner])
    return pd.DataFrame({"k1": table.k1.view(np.int64), "k2": table.k2.view(np.int64), "p1": p1, "p2": p2, "conv_id": conv, "depth": depth, "n_convs": n_convs,
                         "parent_conv": conv[parent], "outer": parent < 0, "n_children": children, "n_leaves": leaves, "saved_tokens": saved})


def _handed_up(*sums: DataFrame) -> DataFrame:
    """What the outer nodes of these tables hand to their parents."""
    outer = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])
    up = outer.filter("outer AND depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    return up.agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def _with_handed(nodes: DataFrame, handed: DataFrame | None) -> DataFrame:
    if handed is None:
        return nodes.withColumns({c: F.lit(0).cast("bigint") for c in ("children", "leaves", "saved")})
    return nodes.join(handed, ["k1", "k2"], "left").fillna(0, ["children", "leaves", "saved"])


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if its counted rows allow."""
    return F.broadcast(df) if rows <= MOST_NODES else df


def _end_digests(ends: DataFrame) -> DataFrame:
    """``(k1, k2, ends_sha256)``: ids in blocks of one range first, the blocks of a node streamed in order through one hash."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy("k1", "k2", F.floor(F.col("conv_id") / RANGE).alias("range")).agg(ids.alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (k1, k2) == key:
                    state.update(b"," + ids.encode())
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "ends_sha256"), d)) for d in done], schema=out)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "ends_sha256"), (*key, state.hexdigest())))], schema=out)

    out = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    ordered = blocks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "range").select("k1", "k2", "ids")
    return ordered.mapInArrow(digests, "k1 long, k2 long, ends_sha256 string")


def _verified_nodes(rebuilt: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prefix rows of one conversation a class, nodes, and ``(conv_id, k1, k2)`` of every conversation's end."""
    for seed in range(8):
        rows = written(prefixes(rebuilt, seed), "trie-prefixes")
        ends = rows.groupBy("conv_id").agg(F.max_by(F.struct("k1", "k2"), "depth").alias("k"), F.max("depth").alias("turns"))
        ends = written(ends.select("conv_id", "k.k1", "k.k2", "turns"), "trie-ends")
        classes = ends.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"), F.max("turns").alias("turns"))
        paths = written(rows.join(classes.drop("k1", "k2"), "conv_id"), "trie-paths")
        same = F.struct("depth", "p1", "p2", "turn_digest")
        weight = F.sum(F.col("turns") - F.col("depth") + 1).alias("weight")
        nodes = paths.groupBy("k1", "k2").agg(F.sum("copies").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("points").alias("points"), weight, F.min(same).alias("same"), F.max(same).alias("other"))
        nodes = written(nodes.select("k1", "k2", "same.depth", "same.p1", "same.p2", "conv_id", "n_convs", "points", "weight", (F.col("same") == F.col("other")).alias("one")), "trie-nodes")
        if not nodes.filter("NOT one").head(1):
            return paths, nodes, ends
    raise RuntimeError("prefix digests collide under every seed")


def conversation_trie(conversations: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """One row per trie node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (code points that sharing the node's subtree saves) and ``ends_sha256``."""
    spark = conversations.sparkSession
    paths, nodes, ends = _verified_nodes(written(rebuilt_turns(conversations), "trie-rebuilt"))
    root = nodes.filter("depth = 0").first()
    total = root["weight"] if root else 0
    limit = max(1, min(most_nodes, total // SHARE))
    tall = nodes.filter(F.col("weight") > limit)
    deep = tall.groupBy("depth").count().agg(F.sum("count").alias("n"), F.max("count").alias("widest"), F.max("depth").alias("depth")).first()

    # the shallowest node of a path within the limit names the path's subtree
    marked = paths.join(_sized(tall.select("k1", "k2", F.lit(True).alias("tall")), deep["n"] or 0), ["k1", "k2"], "left")
    top = F.min(F.when(F.col("tall").isNull(), F.struct("depth", "k1", "k2"))).alias("top")
    subtree = marked.groupBy("conv_id").agg(top).filter("top IS NOT NULL")
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(total / most_nodes))
    shard = F.pmod(F.xxhash64("top.k1", "top.k2"), F.lit(n_shards)).alias("shard")
    low = nodes.filter(F.col("weight") <= limit).join(subtree.select("conv_id", shard), "conv_id")
    sums = written(_with_handed(low, None).groupBy("shard").applyInPandas(lambda own: accumulate(own), SUMS), "trie-shards")

    handed, parts = _handed_up(sums), [sums]
    height = max(1, most_nodes // max(deep["widest"] or 1, 1)) if (deep["n"] or 0) > most_nodes else (deep["depth"] or 0) + 1
    for lo in reversed(range(0, (deep["depth"] or 0) + 1, height)):
        band = _with_handed(tall.filter(F.col("depth").between(lo, lo + height - 1)), handed)
        done = written(band.withColumn("band", F.lit(0)).groupBy("band").applyInPandas(lambda own: accumulate(own), SUMS), "trie-band")
        handed = _handed_up(sums, done)
        parts.append(done)

    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    above = _sized(tall.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above")), deep["n"] or 0)
    outer = every.filter("outer").join(above, ["p1", "p2"], "left").withColumn("parent_conv", F.when(F.col("depth") > 0, F.col("above"))).drop("above")
    every = every.filter("NOT outer").unionByName(outer).join(_end_digests(ends), ["k1", "k2"], "left")
    return every.select("conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


ORACLE = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
             md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS item, length(coalesce(text, '')) AS points
           FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT DISTINCT c, c - c % 100 AS base, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS bytes FROM t),
h AS (SELECT c, base, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
        lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) % 6 AS h FROM b),
k AS (SELECT h.c, h.base, h.h, count(t.c) AS k FROM h LEFT JOIN t ON t.c = h.base AND t.pos <= h.h GROUP BY ALL),
r AS (SELECT k.c, t.pos AS d, t.item, t.points FROM k JOIN t ON t.c = k.base AND t.pos <= k.h
      UNION ALL SELECT k.c, k.k + t.pos - k.h, t.item, t.points FROM k JOIN t ON t.c = k.c AND t.pos > k.h),
p AS (SELECT c, d, points, string_agg(item, '') OVER (PARTITION BY c ORDER BY d) AS path FROM r UNION ALL SELECT c, 0, 0, '' FROM h),
l AS (SELECT c, max(d) AS turns FROM p GROUP BY c),
n AS (SELECT path, d AS depth, count(*) AS n_convs, min(p.c) AS conv_id, min(points) AS points,
        sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE d = turns), '')) AS ends_sha256 FROM p JOIN l USING (c) GROUP BY path, d),
ch AS (SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch ON n.path = ch.path),
up AS (SELECT path, n_convs, points, n_children, unnest(range(0, depth + 1)) AS upto FROM v),
s AS (SELECT substr(path, 1, 32 * upto) AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * points) AS saved_tokens FROM up GROUP BY 1)
SELECT v.conv_id, v.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN s ON v.path = s.path LEFT JOIN n q ON v.depth > 0 AND q.path = substr(v.path, 1, 32 * (v.depth - 1))
"""
