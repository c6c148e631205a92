"""The conversation trie against a plain tree, and its slot table."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from corpuskit.llm import conv_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, k1 string, shard double"


def rows():
    rng = random.Random(11)
    out = []
    for c in [*range(0, 40), *range(100, 160, 3), 205, 230, 301, -5, -130, 10**15, 10**15 + 1]:
        if c in (7, 230):
            continue
        n = rng.randint(1, 7)
        out += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "日本𝄞", f"x{c % 4}"])) for t in range(n)]
    for c in range(500, 560):  # a large group of copies
        out += [(c, t, "user", f"same {t}") for t in range(4)]
    out += [(600, 3, "user", "tie b"), (600, 3, "user", "tie a"), (600, 3, "assistant", "tie a"), (600, None, "user", "first"), (601, 1, "u", "x"), (601, 1, "u", "x")]
    out += [(None, 1, "user", "nobody"), (None, None, None, None)]
    out += [(700, t, "u", f"t{t % 50}") for t in range(150)] + [(701, t, "u", f"t{t % 50}" if t < 100 else "other") for t in range(130)]
    return [(*r, 1, "clash", 0.5) for r in out]


def brute(table):
    turns = {}
    for c, t, role, text, *_ in table:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    root = {"kids": {}, "members": [], "ends": [], "len": 0, "depth": 0, "parent": None}
    nodes = [root] if turns else []
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        at = root
        at["members"].append(c)
        for role, text in turns.get(base, [])[:h] + turns[c][h:]:
            if (role, text) not in at["kids"]:
                at["kids"][role, text] = {"kids": {}, "members": [], "ends": [], "len": len(text), "depth": at["depth"] + 1, "parent": at}
                nodes.append(at["kids"][role, text])
            at = at["kids"][role, text]
            at["members"].append(c)
        at["ends"].append(c)
    for n in sorted(nodes, key=lambda n: -n["depth"]):
        n["leaves"] = sum(k["leaves"] for k in n["kids"].values()) or 1
        n["saved"] = (len(n["members"]) - 1) * n["len"] + sum(k["saved"] for k in n["kids"].values())
    return sorted((min(n["members"]), n["depth"], min(n["parent"]["members"]) if n["parent"] else None, len(n["members"]), len(n["kids"]), n["leaves"], n["saved"],
                   hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()) for n in nodes)


@pytest.mark.parametrize("most,span", [(200_000, 4096), (40, 16)])
def test_trie_equals_brute_force(spark, monkeypatch, most, span):
    monkeypatch.setattr(conv_trie, "RANGE", span)
    table = rows()
    got = conv_trie.conversation_trie(spark.createDataFrame(table, SCHEMA).repartition(5), most_nodes=most)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == brute(table)


def test_empty(spark):
    assert conv_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conv_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "", 0.0)], SCHEMA)).count() == 0


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(2)
    k1, k2 = rng.integers(-(2**62), 2**62, 5000), rng.integers(-3, 3, 5000)
    table = conv_trie.SlotTable(k1, k2)
    assert sorted(table.slots) == list(range(5000)) and (table.find(k1, k2) == table.slots).all()
    assert (table.find(k1, k2 + 10) == -1).all() and len(conv_trie.SlotTable(k1[:0], k2[:0]).find(k1, k2)) == 5000
    with pytest.raises(ValueError):
        conv_trie.SlotTable(np.array([1, 1]), np.array([2, 2]))


def test_collisions_are_seen(spark, monkeypatch):
    """With digests of a few bits every seed collides, and that is noticed."""
    whole = conv_trie.prefixes

    def narrow(rebuilt, seed):
        cut = whole(rebuilt, seed)
        return cut.withColumns({c: cut[c].bitwiseAND(3) for c in conv_trie.NODE})

    monkeypatch.setattr(conv_trie, "prefixes", narrow)
    few = [(c, t, "u", f"{c}-{t}", 1, "", 0.0) for c in range(20) for t in range(3)]
    with pytest.raises(RuntimeError):
        conv_trie.conversation_trie(spark.createDataFrame(few, SCHEMA)).count()
