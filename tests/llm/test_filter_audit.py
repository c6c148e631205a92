"""The filter audit against plain Python, and its matrix against word counts."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

from corpuskit.llm import filter_audit

LONG = "word " * 150_000 + "Ä" * 500_000
DOCS = "doc_id bigint, text string, source string, mask int, shard string, m double"
ROWS = [
    (5, "one two two", "s", 1, "x", 1.0), (5, "one two two", "s", 1, "x", 1.0), (3, "one two two", None, None, None, None), (9, "one two two", "t", None, None, None),
    (None, "one two two", "s", None, None, None), (1, None, "s", None, None, None), (2, "", "", None, None, None), (4, "A" * 30 + " b", "t", None, None, None),
    (6, LONG, "t", None, None, None), (7, LONG, "t", None, None, None), (8, " ".join(f"w{i}" for i in range(300)), "s", None, None, None),
    (10, "a\x1cb\x0bc\x0cd e 日本語 $", "t", None, None, None), (None, None, None, None, None, None), (11, "x | y " * 300, "s", None, None, None),
]
LABELS = [(5, 1, 0), (5, 0, 1), (3, None, None), (9, 1, 1), (None, 1, 1), (77, 1, 1), (8, 1, 0)]


def brute(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    docs = collections.defaultdict(list)
    for i, t, s, *_ in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": re.search(r"[#$%&*|]", t) is not None, "E": i is not None and least[t] < i}
        docs[s or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    for part, own in docs.items():
        shapley = collections.Counter()
        for o in orders:
            for step, f in enumerate(o, 1):
                prior = set(o[: step - 1])
                gone = [d for d in own if f in d[0] and not d[0] & prior]
                shapley[f] += len(gone)
                out[part, o, step] = [sum(not d[0] & (prior | {f}) for d in own), len(gone), sum(f in d[0] and bool(d[0] & prior) for d in own),
                                      sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for o in orders:
            for step, f in enumerate(o, 1):
                out[part, o, step].append(shapley[f])
    return out


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("parts", [1, 5])
def test_audit_equals_brute_force(spark, parts):
    docs, labels = spark.createDataFrame(ROWS, DOCS).repartition(parts), spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in NAMES] for r in filter_audit.audit_filters(docs, labels).collect()}
    assert got == brute(ROWS, LABELS)


def test_matrix_counts_words(spark):
    shards = filter_audit.document_term_shards(spark.createDataFrame(ROWS, DOCS).repartition(3)).collect()
    assert sum(len(s["doc_id"]) for s in shards) == len(ROWS) and len(shards) > 1
    rows = collections.Counter()
    columns = set()
    for s in shards:
        assert len(s["indptr"]) == len(s["doc_id"]) + 1 and s["indptr"][-1] == len(s["indices"]) == len(s["counts"])
        for k, i in enumerate(s["doc_id"]):
            lo, hi = s["indptr"][k], s["indptr"][k + 1]
            assert len(set(s["indices"][lo:hi])) == hi - lo
            columns |= set(s["indices"][lo:hi])
            rows[i, tuple(sorted(s["counts"][lo:hi]))] += 1
    want = collections.Counter((i, tuple(sorted(collections.Counter(re.findall("[^\x20\x09-\x0D]+", t or "")).values()))) for i, t, *_ in ROWS)
    vocabulary = {w for _, t, *_ in ROWS for w in re.findall("[^\x20\x09-\x0D]+", t or "")}
    assert rows == want and columns == set(range(len(vocabulary)))


def test_empty_and_missing_columns(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_filters(spark.createDataFrame([], DOCS), labels).count() == 0
    bare = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    out = filter_audit.audit_filters(bare, labels)
    assert out.count() == 600 and out.select(F.max("part")).first()[0] == ""


def test_parts_of_the_dictionary_grow_with_the_input(spark, monkeypatch):
    """A task numbers the words of a bounded part, however few the shuffle partitions; flags do not depend on it."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(60)), "s") for i in range(40)], "doc_id bigint, text string, source string").repartition(2)
    keys = lambda d: sorted((r["doc_id"], r["words"], r["distinct"], r["a"], r["b"]) for r in d.collect())
    one = keys(filter_audit.document_flags(docs))
    monkeypatch.setattr(filter_audit, "PART_BYTES", 256)
    seen, real = [], filter_audit._local_shards
    monkeypatch.setattr(filter_audit, "_local_shards", lambda parts: seen.append(parts) or real(parts))
    assert keys(filter_audit.document_flags(docs)) == one and seen[0] > 20
    assert [r[1] for r in one] == [60] * 40 and [r[2] for r in one] == [len({(i * j) % 97 for j in range(60)}) for i in range(40)]
