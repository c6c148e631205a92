"""Associative scans: one run of all rows, any number of ranges and partitions, against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import prefix as P
from corpuskit.operators import reports as K


def rows():
    rng = random.Random(8)
    out = [("one", rng.randrange(40), i, None if rng.random() < 0.05 else float(rng.randrange(60) + i // 50)) for i in range(900)]
    out += [(f"r{i % 7}", rng.randrange(5), 1000 + i, float(rng.randrange(10))) for i in range(60)] + [(None, 1, 2000 + i, float(i % 3)) for i in range(5)]
    rng.shuffle(out)
    return out


def plain(table, mode):
    out = {}
    for run in {r[0] for r in table}:
        best, since, first = None, 0, True
        for _, ts, i, v in sorted((r for r in table if r[0] == run), key=lambda r: (r[1], r[2])):
            improved = best is None or (v is not None and (v > best if mode == "max" else v < best))
            since = 0 if improved or first else since + 1
            out[i] = (best, improved, since, since > 3)
            first = False
            if v is not None and (best is None or (v > best if mode == "max" else v < best)):
                best = v
    return out


@pytest.mark.parametrize("mode", ["max", "min"])
@pytest.mark.parametrize("partitions,n_ranges", [(1, 1), (7, 7), (64, 64)])
def test_patience_does_not_depend_on_ranges(spark, mode, partitions, n_ranges):
    table = rows()
    df = spark.createDataFrame(table, "run string, ts int, event_id int, value double").repartition(partitions)
    best = K.running_best(df, "run", ["ts", "event_id"], "value", mode, n_ranges, keep_ranges=True)
    if n_ranges == 64:
        assert best.filter("run = 'one'").select("_range").distinct().count() > 20  # a run is spread over many ranges
    got = K.patience(best, "run", ["ts", "event_id"], 3)
    assert {r["event_id"]: (r["best_before"], bool(r["improved"]), r["since_improvement"], r["stop"]) for r in got.collect()} == plain(table, mode)


def test_scan_kinds(spark):
    df = spark.createDataFrame([("a", i, (i * 7) % 11) for i in range(50)] + [("b", 1, 5)], "g string, i int, v int")
    d = P.scan(P.ranges(df, ["g"], ["i"], 6), ["g"], ["i"], {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))})
    got = {(r["g"], r["i"]): (r["s"], r["lo"], r["hi"]) for r in d.collect()}
    for i in range(50):
        v = [(j * 7) % 11 for j in range(i + 1)]
        assert got["a", i] == (sum(v), min(v), max(v))
    assert got["b", 1] == (5, 5, 5)
    x = P.scan(P.ranges(df, ["g"], ["i"], 6), ["g"], ["i"], {"s": ("sum", F.col("v"))}, exclusive=True).filter("i = 0 OR g = 'b'").collect()
    assert all(r["s"] == 0 for r in x)
