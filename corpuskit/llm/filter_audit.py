"""How five document filters interact, decided from a sparse document-term matrix.

Texts become CSR shards: each task cuts its rows into shards of a bounded number
of bytes, splits words, encodes them by a dictionary of the shard and writes row
pointers, word numbers and counts.  A shard's dictionary is dealt into parts by a hash
of the word; a part of all shards together numbers its words, parts follow each other,
so every word of the table has one global number and no task sees all of them.  What
travels is a block of words per shard and part and its numbers back, not a row per word;
then every shard gets global columns.  Row sums are the words of a document, nonzero
entries its distinct words; they decide filters A and B.  The flags of C and D are
counted in the same pass over the bytes, E by the smallest id of each text.

Defined results: a null text is an empty one (no words, and it equals other empty
texts); a null id is never a copy and has no labels; a null or missing source is the
empty part; rows that repeat an id count each, and only smaller ids make a text a
copy; of several labels of one id any 1 counts; a text longer than a shard is a shard
of its own; an empty table has no parts and gives no rows.  Columns beyond
``doc_id``, ``text`` and ``source`` are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm.common import written
from corpuskit.session import with_conf

#: Bytes of text in one shard; bounds a task's memory and the length of a shard's arrays.
SHARD_BYTES = 4 << 20
SHARD_ROWS = 1 << 18
#: Bytes of text for each part of the dictionary; bounds the words that one task numbers, whatever the input's size.
PART_BYTES = 16 << 20
#: Shards that go to Python at once.
SHARDS_AT_ONCE = 4
#: Bytes of texts that go to Python at once.
BATCH_BYTES = 32 << 20

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]

META = "shard string, doc_id array<bigint>, part array<string>, digest array<binary>, c array<boolean>, d array<boolean>, indptr array<int>, counts array<int>"
#: A shard with its own word numbers, and its words by part of the dictionary, each joined by line feeds.
LOCAL = META + ", indices array<int>, blocks array<binary>"
NUMBERED = "shard string, part int, ranks binary, distinct int"


def _row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a byte mask between consecutive offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def _buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a string or binary array without nulls."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def _shard(name: str, ids: pa.Array, parts: pa.Array, texts: pa.Array, parts_of_dictionary: int) -> dict:
    offsets, data = _buffers(texts)
    upper, points = _row_sums((data >= 65) & (data <= 90), offsets), _row_sums((data & 0xC0) != 0x80, offsets)
    marks = _row_sums(np.isin(data, np.frombuffer(b"#$%&*|", dtype=np.uint8)), offsets)
    digest = [hashlib.md5(data[a:b]).digest() for a, b in zip(offsets, offsets[1:])]

    split = pc.ascii_split_whitespace(texts)  # at \x20 and \x09-\x0D, with empty strings at the ends
    rows = np.repeat(np.arange(len(texts), dtype=np.int64), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    words = split.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    rows, words = rows[some.to_numpy(zero_copy_only=False)], words.filter(some).dictionary_encode()
    blocks, place = _dealt(words.dictionary, parts_of_dictionary)
    n = max(len(place), 1)
    cells, counts = np.unique(rows * n + place[words.indices.to_numpy(zero_copy_only=False)], return_counts=True)
    rows, columns = np.divmod(cells, n)
    return {"shard": name, "doc_id": ids, "part": parts, "digest": digest, "c": 100 * upper > 2 * points, "d": marks > 0,
            "indptr": np.searchsorted(rows, np.arange(len(texts) + 1)), "counts": counts, "indices": columns, "blocks": blocks}


#: Odd multipliers of the word hash by place in the word; longer words use them again.
_WEIGHTS = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _dealt(words: pa.Array, parts: int) -> tuple[list[bytes], np.ndarray]:
    """Words by part, joined by line feeds, and each word's place in that order.  No word is empty or holds a line feed."""
    if not len(words):
        return [b""] * parts, np.zeros(0, np.int64)
    offsets, data = _buffers(words)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    mixed = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _WEIGHTS[at % len(_WEIGHTS)], offsets[:-1])
    part = ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    dealt = words.cast(pa.binary()).take(pa.array(order))
    joined = [dealt.slice(a, b - a).to_pylist() for a, b in zip(cuts, cuts[1:])]
    return [b"\n".join(j) for j in joined], place


def _local_shards(parts_of_dictionary: int):
    """Shards of consecutive rows with their own dictionaries; a shard ends where its bytes exceed the bound."""
    kinds = [("shard", pa.string()), ("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("c", pa.bool_()), ("d", pa.bool_()),
             ("indptr", pa.int32()), ("counts", pa.int32()), ("indices", pa.int32()), ("blocks", pa.binary())]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, made = context.partitionId() if context else 0, 0
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                before = size[lo - 1] if lo else 0
                hi = min(max(lo + 1, int(np.searchsorted(size, before + SHARD_BYTES, side="right"))), lo + SHARD_ROWS)
                own = batch.slice(lo, hi - lo)
                shard = _shard(f"{task}-{made}", own["doc_id"], own["part"], own["text"], parts_of_dictionary)
                columns = [pa.array([shard["shard"]])]
                for name, kind in kinds[1:]:
                    values = shard[name] if isinstance(shard[name], pa.Array) else pa.array(shard[name], type=kind)
                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], type=pa.int32()), values))
                out = pa.RecordBatch.from_arrays(columns, [k for k, _ in kinds])
                del shard, columns, values
                yield out
                del out
                pa.default_memory_pool().release_unused()
                lo, made = hi, made + 1

    return shards


def _numbered(blocks: pa.Table) -> pa.Table:
    """Numbers the words of one part over all shards, by first use in the order of the shards."""
    blocks = blocks.sort_by("shard")
    split = pc.split_pattern(blocks["words"].combine_chunks(), "\n")  # no object per word
    cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    words = split.flatten().dictionary_encode()
    ranks = words.indices.to_numpy(zero_copy_only=False).astype("<i4")
    n = len(words.dictionary)
    return pa.table({"shard": blocks["shard"], "part": blocks["part"], "ranks": pa.array([ranks[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], type=pa.binary()),
                     "distinct": pa.array([n] * blocks.num_rows, type=pa.int32())})


def _coded_shards(docs: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Shards with their own word numbers (``META`` and ``indices``), the parts of the dictionary ``used`` and the ``ranks`` of
    their words in each, and how many words are in the parts before each part."""
    spark = docs.sparkSession
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(source, F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(size / PART_BYTES))
    few = {"parquet.block.row.count.limit": SHARDS_AT_ONCE}  # writers and readers hold a row group at once
    with with_conf(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES)):
        local = written(rows.mapInArrow(_local_shards(parts), LOCAL), "csr-local", **few)
    blocks = local.select("shard", F.posexplode("blocks").alias("part", "words")).filter(F.octet_length("words") > 0)
    numbered = written(blocks.groupBy("part").applyInArrow(lambda own: _numbered(own), NUMBERED), "csr-numbers")
    before, n = {}, 0
    for r in numbered.groupBy("part").agg(F.max("distinct").alias("n")).orderBy("part").collect():  # as many rows as shuffle partitions
        before[r["part"]], n = n, n + r["n"]
    back = numbered.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("part", "ranks"))).alias("x"))
    back = back.select("shard", F.col("x.part").alias("used"), F.col("x.ranks").alias("ranks"))
    return local.drop("blocks").join(back, "shard", "left"), before


def _global_columns(own, used, ranks, before: dict[int, int]) -> np.ndarray:
    """A shard's word numbers as numbers of the whole table."""
    if own is None or not len(own):
        return np.empty(0, np.int64)
    return np.concatenate([np.frombuffer(r, dtype="<i4").astype(np.int64) + before[p] for p, r in zip(used, ranks)])[np.asarray(own)]


def document_term_shards(docs: DataFrame) -> DataFrame:
    """CSR shards of the document-term matrix: ``META`` and ``indices array<bigint>``, columns numbered over the whole table."""
    shards, before = _coded_shards(docs)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def global_columns(indices: pd.Series, used: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series([_global_columns(*x, before) for x in zip(indices, used, ranks)])

    return shards.select(*[c.split()[0] for c in META.split(", ")], global_columns("indices", "used", "ranks").alias("indices"))


def _row_totals(ptr, columns: np.ndarray, values) -> list[dict]:
    """Per row of a shard the sum of its entries and its number of different global columns (below 2^44; a shard has fewer than 2^19 rows)."""
    ptr = np.asarray(ptr, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(np.asarray(values, dtype=np.int64))])
    cells = np.sort(np.repeat(np.arange(len(ptr) - 1) << 44, np.diff(ptr)) | columns)
    first = np.ones(len(cells), dtype=bool)
    first[1:] = np.diff(cells) != 0
    nonzero = np.bincount(cells[first] >> 44, minlength=len(ptr) - 1)
    return [{"words": int(w), "distinct": int(d)} for w, d in zip(np.diff(total[ptr]), nonzero)]


def document_flags(docs: DataFrame, min_words: int = 200, min_distinct: int = 50, max_upper: int = 2) -> DataFrame:
    """``(doc_id, part, digest, words, distinct, a, b, c, d)`` of every row, A and B from its row of the matrix.

    A shard's global columns are made and summed in the same Python process, so they do not travel and a task needs one.
    """
    shards, before = _coded_shards(docs)

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("words", T.LongType()), T.StructField("distinct", T.LongType())])))
    def totals(indptr: pd.Series, counts: pd.Series, indices: pd.Series, used: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series([_row_totals(p, _global_columns(*x, before), c) for p, c, *x in zip(indptr, counts, indices, used, ranks)])

    cells = F.explode(F.arrays_zip("doc_id", "part", "digest", "c", "d", "m")).alias("r")
    r = shards.withColumn("m", totals("indptr", "counts", "indices", "used", "ranks")).select(cells)
    r = r.select("r.doc_id", "r.part", "r.digest", "r.m.words", "r.m.distinct", "r.c", "r.d")
    with with_conf(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(SHARDS_AT_ONCE)):
        r = written(r, "audit-rows")
    return r.select("doc_id", "part", "digest", "words", "distinct", (F.col("words") < min_words).alias("a"),
                    (100 * F.col("distinct") < min_distinct * F.col("words")).alias("b"), "c", "d")


def failure_cells(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, good, toxic, n)``: documents by the filters they fail (bit of A is 1, of E 16) and their labels.

    Copies are counted before they are compared: rows of one text are summed by id, part
    and labels, so a text that a third of all rows share is a few rows when its smallest id is looked up.
    """
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    mask = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate("abcd")), F.lit(0))
    rows = flags.select("doc_id", "part", "digest", mask.alias("mask")).join(said, "doc_id", "left").fillna(0, ["good", "toxic"])
    group = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *group).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    free = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free")
    texts = written(by_id.groupBy(*group).agg(F.sum("n").alias("n"), first.alias("first"), free), "audit-texts")
    least = texts.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    alone = F.col("free") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = texts.join(least, "digest").select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), alone.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - alone).alias("n")))).alias("x"))
    return both.select("part", "good", "toxic", "x.*").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def interaction_table(cells: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what the step keeps, removes and costs; see ``audit_filters``."""
    prior = [[sum(1 << FILTERS.index(o[j]) for j in range(s)) for s in range(5)] for o in ORDERS]
    own = [[1 << FILTERS.index(o[s]) for s in range(5)] for o in ORDERS]
    k = F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1)))
    d = cells.select("*", k.alias("k")).select("*", F.element_at(F.lit(ORDERS), F.col("k") + 1).alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    at = F.col("k") * 5 + F.col("step")
    d = d.withColumn("own", F.element_at(F.lit([x for o in own for x in o]), at)).withColumn("prior", F.element_at(F.lit([x for o in prior for x in o]), at))
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("prior")) != 0
    share = F.element_at(F.lit([len(ORDERS) // n for n in range(1, 6)]), F.greatest(F.bit_count("mask"), F.lit(1)))  # orders in which one of n comes first

    def total(when: Column, name: str, n: Column = F.col("n")) -> Column:
        return F.sum(F.when(when, n).otherwise(F.lit(0).cast("bigint"))).cast("bigint").alias(name)

    removed = fails & ~earlier
    return d.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier, "kept"), total(removed, "removed"), total(fails & earlier, "redundant"), total(F.col("mask") == F.col("own"), "unique_fails"),
        total(removed & (F.col("good") == 1), "good_lost"), total(removed & (F.col("toxic") == 1), "toxic_lost"), total(fails, "shapley", F.col("n") * share))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of filters A (short), B (few distinct words), C (upper case), D (marks), E (copy) per part of ``docs``.

    ``kept`` after the step, ``removed`` by it, ``redundant`` failing its filter but removed
    earlier, ``unique_fails`` failing no other filter, ``good_lost`` / ``toxic_lost`` removed
    with that label, ``shapley`` the filter's removals summed over all 120 orders.
    """
    return interaction_table(failure_cells(document_flags(docs), labels))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(words) < 200) AS a, (100 * len(list_distinct(words)) < 50 * len(words)) AS b,
        (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text)) AS c, regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) AS e
      FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) a(x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) b(x),
      (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) c(x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) d(x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) e(x)
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS prior FROM o, range(1, 6) r(step)),
g AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS mask,
        count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT part, filter_order, step, own, mask, n, good, toxic, contains(mask, own) AS fails, length(translate(mask, prior, '')) < length(mask) AS earlier FROM g, s),
t AS (SELECT part, filter_order, step, own,
        sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN fails AND earlier THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM t
"""
