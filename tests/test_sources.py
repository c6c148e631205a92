"""Readers that cut files by byte ranges, and folders with broken files."""

import gzip
import json
import os
import random

from corpuskit.sources import files as A


def small_splits(spark, n):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    return before


def restore(spark, before):
    for k, v in before.items():
        spark.conf.set(k, v)


def test_line_numbers_over_byte_ranges(spark, tmp_path):
    rng = random.Random(1)
    want = set()
    for name in ("a", "b", "c"):
        lines = ["é" * rng.randint(0, 40) + f"{name}{i}" if rng.random() < 0.9 else "" for i in range(700)]
        ending = {"a": "\n", "b": "", "c": "\n"}[name]
        lines[-1] = "end"
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + ending, newline="")
        want |= {(f"{name}.txt", i, t) for i, t in enumerate(lines)}
    (tmp_path / "none.txt").write_text("")
    before = small_splits(spark, 997)
    try:
        got = A.read_text_shards(spark, f"file://{tmp_path}")
        assert got.rdd.getNumPartitions() > 20
        rows = got.select("shard", "line_no", "text").collect()
    finally:
        restore(spark, before)
    assert len(rows) == 2100 and {tuple(r) for r in rows} == want


def test_json_arrays_over_byte_ranges(spark, tmp_path):
    rng = random.Random(2)
    odd = ['plain', 'with "quotes"', 'back\\slash', 'ends in \\', '\\"', '[not, a] list', 'line\nbreak', '日本 é 𝄞', '', '""', 'tab\t', '\\\\"']
    wiki = {f"w{k}": ["".join(rng.choice(odd) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 90))] for k in range(3)}
    dialogs = {f"d{k}": [[rng.choice(odd) * rng.randint(1, 3) for _ in range(rng.randint(0, 6))] for _ in range(60)] for k in range(2)}
    os.mkdir(tmp_path / "w"), os.mkdir(tmp_path / "d")
    for k, v in wiki.items():
        (tmp_path / "w" / f"{k}.json").write_text(json.dumps(v, ensure_ascii=k == "w0", indent=1 if k == "w1" else None))
    for k, v in dialogs.items():
        (tmp_path / "d" / f"{k}.json").write_text(json.dumps(v, ensure_ascii=False) + "\n")
    name = lambda f: f.rsplit("/", 1)[1][:2]
    before = small_splits(spark, 211)
    try:
        got = {(name(r["file"]), r["idx"], r["text"]) for r in A.read_wiki_json(spark, f"file://{tmp_path}/w").collect()}
        turns = {(name(r["file"]), r["idx"], r["turn"], r["utterance"]) for r in A.read_dialog_json(spark, f"file://{tmp_path}/d").collect()}
    finally:
        restore(spark, before)
    assert got == {(k, i, t) for k, v in wiki.items() for i, t in enumerate(v)}
    assert turns == {(k, i, j, t) for k, v in dialogs.items() for i, dia in enumerate(v) for j, t in enumerate(dia)}


def test_broken_files_are_dropped_and_counted(spark, tmp_path):
    packed = gzip.compress(b"some text" * 50)
    files = {"cat/a.txt": b"fine \xc3\xa9", "cat/b.txt": b"cut \xc3", "cat/deep/c.TXT": b"x", "cat/e.gz": packed, "cat/f.gz": packed[:-5], "dog/a.png": b"\x89PNG1234", "dog/b.png": b"GIF8",
             "dog/c.jpg": b"\xff\xd8\xff\xe0", "dog/d.txt": b"", "dog/skip.bin": b"1", "eel/x.gz": b"no gzip"}
    for path, content in files.items():
        os.makedirs(tmp_path / "root" / os.path.dirname(path), exist_ok=True)
        (tmp_path / "root" / path).write_bytes(content)
    kept, counts = A.read_labeled_folder(spark, f"file://{tmp_path}/root", ("txt", ".gz", "PNG", "jpg"))
    assert {r["path"].split("/root/")[1]: (r["class_index"], r["bytes"]) for r in kept.collect()} == {
        "cat/a.txt": (0, 7), "cat/deep/c.TXT": (0, 1), "cat/e.gz": (0, len(packed)), "dog/a.png": (1, 8), "dog/c.jpg": (1, 4)}
    assert sorted(tuple(r) for r in counts.collect()) == [("cat", 0, 5, 2), ("dog", 1, 3, 1), ("eel", 2, 1, 1)]
