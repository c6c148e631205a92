"""Every operator against brute force on small tables, and on odd rows and empty tables."""

import collections
import hashlib
import math
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import decontam, embed_dedup, jaccard, line_dedup, lm, packing, quality, suffix_dedup, toxicity, warc
from corpuskit.llm.common import connected_components
from corpuskit.llm.queries import ORACLES, QUERIES, tokenizer_file

from ..conftest import SMALL

DOCS = "doc_id bigint, text string, lang string, score double, k bigint, n int, h string"
LONG = " ".join(f"word{i % 977} and" for i in range(20_000))
BASE = " ".join(f"w{i}" for i in range(80))
ODD = [
    (1, BASE, "en", 1.0, 1, 1, "x"), (1, BASE, "en", 1.0, 1, 1, "x"), (2, BASE.replace("w40 ", "other "), None, None, None, None, None),
    (3, None, None, None, None, None, None), (4, "", None, None, None, None, None), (None, "Two words", None, None, None, None, None),
    (None, None, None, None, None, None, None), (5, LONG, "en", 0.0, 2, 2, "y"), (6, "two WORDS", None, None, None, None, None), (7, " \t\n ", None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").df()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 8)] + [(None, 1, 1), (2, None, None), (5, 7, 7)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(1, 1), (None, 3)]
    root = {}
    for a, b in pairs:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(100):
        for a, b in pairs:
            if a is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = connected_components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == root and len(got) == len(root)


def test_packing(spark, documents, odd, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file())
    more = ["a  b \n c", "x<|endoftext|> y  <|endoftext|>", "it's don't 'll \x1c z", "日本語 ½ ١٢ é", "   ", "\n\n x "]
    docs = pd.concat([documents, pd.DataFrame({"doc_id": range(10_000, 10_000 + len(more)), "text": more})])
    got = packing.pack_power_of_two(spark.createDataFrame(docs), tokenizer_file()).toPandas()
    assert got.sequence_id.is_unique and (got.offset == 0).all() and (got.length == 2**got.bucket).all() and got.length.max() <= 1024
    for doc_id, own in got.sort_values("start").groupby("doc_id"):
        ids = np.frombuffer(b"".join(own.ids), dtype="<u4").tolist()
        assert ids == whole.encode(docs.text[docs.doc_id == doc_id].iloc[0], add_special_tokens=False).ids + [0]
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]] and set(own.doc_tokens) == {len(ids)}
    small = packing.pack_power_of_two(odd, tokenizer_file(), seq_len=8, most_units=10).toPandas()
    assert small.length.max() <= 8 and (small[small.doc_id.isin([3, 4])].length == 1).all()
    assert small[small.doc_id == 1].length.sum() == 2 * small[small.doc_id == 1].doc_tokens.iloc[0]
    assert packing.pack_power_of_two(none, tokenizer_file()).count() == 0
    with pytest.raises(ValueError):
        packing.pack_power_of_two(odd, tokenizer_file(), seq_len=100)


def _linked(unit, ok, threshold):
    near = unit @ unit.T >= threshold
    near &= ok[:, None] & ok[None, :]
    np.fill_diagonal(near, False)
    return near


def test_embeddings_recall_and_components(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 64))
    x = np.vstack([base, *(base + rng.normal(size=base.shape) * s for s in (0.1, 0.2, 0.3, 0.4)), base[:20]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = _linked(unit, np.ones(len(x), bool), 0.9)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = embed_dedup.near_duplicates(df, block=16).toPandas().sort_values("vec_id")
    assert (got.n_links.to_numpy() <= near.sum(axis=1)).all()
    assert got.n_links.sum() >= 0.9 * near.sum()
    assert (got.kept == (got.vec_id == got.component_id)).all()
    assert (embed_dedup.near_duplicates(df, block=4096).toPandas().sort_values("vec_id").n_links.to_numpy() == got.n_links.to_numpy()).all()


def test_embeddings_odd_rows(spark):
    rows = [(5, [1.0, 2.0, 3.0], 1), (4, [1.0, 2.0, 3.0], 1), (4, [2.0, 4.0, 6.0], 1), (1, None, 1), (2, [0.0, 0.0, 0.0], 1), (3, [1.0, None, 0.0], 1), (6, [1.0, float("nan"), 0.0], 1),
            (7, [float("inf"), 1.0, 0.0], 1), (8, [1.0], 1), (None, [3.0, 2.0, 1.0], 1), (9, [-1.0, 2.0, 0.5], 1)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, v int")).collect()
    assert len(got) == len(rows)
    assert all(r["n_links"] == 2 and r["component_id"] == 4 and r["kept"] == (r["vec_id"] == 4) for r in got if r["vec_id"] in (4, 5))
    assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] for r in got if r["vec_id"] in (1, 2, 3, 6, 7, 8, 9, None))
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def _language_model(docs, mu):
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for _, t in docs]
    out = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    one, two = collections.Counter(), collections.Counter()
    for t, o in zip(tokens, out):
        if not o:
            one.update(t)
            two.update(zip([b"\n", *t], t))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 1) / (n + v + 1)
    return n, [(i, o, len(t), sum(one[w] > 0 for w in t), sum(math.log10(p(w)) for w in t),
                sum(math.log10((two[h, w] + mu * p(w)) / (one[h] + mu)) for h, w in zip([b"\n", *t], t))) for (i, _), o, t in zip(docs, out, tokens)]


def test_language_model(spark, documents, odd, none):
    for df, docs, chunk in ((spark.createDataFrame(documents), documents.to_numpy().tolist(), 100_000), (odd, [r[:2] for r in ODD], 500)):
        n, want = _language_model(docs, 50.0)
        got = lm.score_texts(df, chunk_bytes=chunk, part_keys=5_000).collect()
        key = lambda r: tuple((x is None, x) if not isinstance(x, float) else round(x, 6) for x in r)
        assert {r["train_tokens"] for r in got} == {n}
        assert sorted(key((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"])) for r in got) == sorted(map(key, want))
    assert lm.score_texts(none).count() == 0


def _shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _jaccard_classes(docs):
    sets = [_shingles(t) for _, t in docs]
    root = list(range(len(sets)))
    for _ in range(3):
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and min(len(a), len(b)) * 4 >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                    root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return sets, root


def test_jaccard_verification_sends_texts_to_hubs_in_parts(spark, monkeypatch):
    """The end in more pairs is the hub, its partners meet it in bounded parts, and pairs below the threshold go."""
    monkeypatch.setattr(jaccard, "MOST_LEAVES", 4)
    text = lambda i: " ".join(f"x{i}" if j == 20 else f"w{j}" for j in range(60))
    texts = {i: text(i) for i in range(40)} | {99: " ".join(f"v{j}" for j in range(60))}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()] * 2, "k bigint, text string")
    pairs = [(0, i) for i in range(1, 20)] + [(i, 0) for i in range(20, 40)] + [(99, 0), (1, 2), (99, 3)]
    pairs = spark.createDataFrame([(a, b, a, b) for a, b in pairs], "a bigint, b bigint, ka bigint, kb bigint")
    rows = jaccard._grouped(pairs).collect()
    of = collections.Counter((r["hub"], r["part"]) for r in rows if r["leaf"])
    assert sum(of.values()) == 42 and max(of.values()) < 16 and len({p for h, p in of if h == 0}) > 4
    assert all(sum(not r["leaf"] for r in rows if (r["hub"], r["part"]) == at) == 1 for at in of)
    got = jaccard._verified(pairs, docs, 5, Fraction(3, 4)).collect()
    assert sorted((min(r), max(r)) for r in got) == sorted([(0, i) for i in range(1, 40)] + [(1, 2)])


def test_jaccard_join(spark, documents, odd, none):
    rng = np.random.default_rng(2)
    made = []
    for g, n in enumerate((6, 8, 9, 12, 30, 70, 150)):
        words = [f"g{g}w{i}" for i in range(n)]
        for _ in range(12):
            own = list(words)
            for i in rng.integers(0, n, rng.integers(0, 1 + n // 15)):
                own[i] = f"e{rng.integers(1000)}"
            made.append(" ".join(own[: n - rng.integers(0, 2)]))
    docs = documents.to_numpy().tolist() + [[10_000 + i, t] for i, t in enumerate(made)]
    sets, root = _jaccard_classes(docs)
    least = {r: min(docs[i][0] for i in range(len(docs)) if root[i] == r) for r in set(root)}
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert len(got) == len(docs)
    assert [(got[d]["n_shingles"], got[d]["component_id"]) for d, _ in docs] == [(len(s), least[r]) for s, r in zip(sets, root)]
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == len(ODD)
    assert sorted(r["component_id"] for r in rows if r["doc_id"] in (1, 2)) == [1, 1, 1 if 100 * len(_shingles(ODD[0][1]) & _shingles(ODD[2][1])) >= 75 * len(_shingles(ODD[0][1]) | _shingles(ODD[2][1])) else 2]
    assert [r["component_id"] for r in rows if r["doc_id"] == 6] == [6] and all(r["n_shingles"] == 0 for r in rows if r["doc_id"] in (3, 4, 7))
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()).count(1) == 1
    assert {3, 4, 5, 6, 7} <= {r["doc_id"] for r in kept.collect()}
    assert jaccard.jaccard_components(none).count() == 0 and jaccard.keep_one(none).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_similar_sets_share_an_entry(share):
    from fractions import Fraction

    rng = np.random.default_rng(int(10 * share))
    plan = jaccard.Bands(Fraction(3, 4))
    plan.mixes = {k: share for k in range(30)}
    for n in (3, 4, 5, 8, 13, 21, 40, 90, 300):
        for _ in range(25):
            a = rng.integers(1, 1 << 63, n, dtype=np.uint64)
            common = a[: math.ceil(0.75 * n)] if rng.random() < 0.5 else a[: math.ceil(6 * n / 7)]
            room = math.floor(len(common) / 0.75 - n)  # union of at most |common| / t
            b = np.concatenate([common, rng.integers(1, 1 << 63, max(0, room), dtype=np.uint64)])
            if len(common) < 0.75 * (n + len(b) - len(common)):
                continue
            owner, h = np.repeat([0, 1], [n, len(b)]), np.concatenate([np.sort(a), np.sort(b)])
            e, who = jaccard.all_entries(owner, h, np.array([n, len(b)]), plan)
            assert set(e[who == 0]) & set(e[who == 1])


def test_line_dedup(spark, odd, none):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(ORACLES["op5_template_line_dedup"]).df().sort_values("doc_id")[["doc_id", "n_lines", "n_dropped", "text"]]
    got = QUERIES["op5_template_line_dedup"](spark, SMALL).toPandas().sort_values("doc_id")[["doc_id", "n_lines", "n_dropped", "text"]]
    assert got.to_numpy().tolist() == want.to_numpy().tolist() and got.n_dropped.sum() > 0
    notes = [(i, f"Own line {'abcdefgh'[i]} of this text here\nPage {i} of 90 printed on {i} May\nShort 1\n{'hgfedcba'[i]} closes this text for good", i) for i in range(8)]
    cut = line_dedup.drop_recurring_lines(spark.createDataFrame(notes, "doc_id bigint, text string, n_lines int")).collect()
    assert all(r["n_dropped"] == 1 and "printed" not in r["text"] and "Short 1" in r["text"] for r in cut)
    copies = spark.createDataFrame([(i, BASE + "\n" + BASE[::-1]) for i in range(20)], "doc_id bigint, text string")
    assert all(r["n_dropped"] == 0 for r in line_dedup.drop_recurring_lines(copies).collect())
    got = line_dedup.drop_recurring_lines(odd, counts=False)
    key = lambda r: str(tuple(r))
    assert got.columns == odd.columns and sorted(map(key, got.collect())) == sorted(map(key, odd.collect()))
    assert line_dedup.drop_recurring_lines(none).count() == 0


def test_line_dedup_parses_only_texts_that_give_a_mask_again(spark, monkeypatch):
    notes = [(i, f"Own line {'abcdefgh'[i % 8]}{'xyz'[i % 3]} of this text here\nPage {i} of 90 printed on {i} May", None) for i in range(40)]
    docs = spark.createDataFrame(notes + [(50, None, 1), (51, "", 1), (None, notes[3][1], 1)], "doc_id bigint, text string, k int")
    seen, inner = [], line_dedup._parsed
    monkeypatch.setattr(line_dedup, "_parsed", lambda d, n: (seen.append(d.count()), inner(d, n))[1])
    out = line_dedup.drop_recurring_lines(docs)
    few = sorted(map(str, out.collect()))
    assert seen[0] == 43 and 0 < seen[1] < 20
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", 0)
    assert sorted(map(str, line_dedup.drop_recurring_lines(docs).collect())) == few and seen[3] == 43
    assert sum("n_dropped=1" in x for x in few) == 41


def test_warc_round_trip(spark, none):
    pages = [(1, "http://a", "<p>same</p>"), (9, "http://b", "<p>same</p>"), (9, "http://b", "<p>same</p>"), (2, None, None), (3, "u\r\nv", ""), (None, "x", "<p>same</p>"), (4, "long", "é" * 300_000),
             (5, "crlf", "a\r\n\r\nb\nWARC/1.1\r\n\r\n")] + [(i, f"http://h/{i}", f"<html>page {i} {'body ' * (i % 50)}</html>") for i in range(100, 400)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id bigint, url string, html string, payload int")
    got = warc.archive_pages(df, archive_bytes=50_000).collect()
    assert len(got) == len(pages)
    last = {}
    for i, _, html in pages:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in pages:
        raw, refers = (html or "").encode(), None if last[html or ""] == i else last[html or ""]
        import base64

        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers, raw if refers is None else b""))
    key = lambda r: str(r)
    assert sorted(map(key, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in got))) == sorted(map(key, want))
    assert warc.archive_pages(df.limit(0)).count() == 0
    assert all(r["record_type"] == "response" for r in warc.archive_pages(df, min_bytes=1_000_000).collect())


def _without_repeats(texts, length):
    seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("length", [8, 20, 57])
def test_prefix_doubling(spark, length):
    rng = np.random.default_rng(length)
    shared = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (length - 1, length, length + 3, 3 * length, 200)]
    texts = ["ab" * 150, "a" * 200, "", "é" * 100, None]
    for _ in range(40):
        parts = [shared[rng.integers(5)] if rng.random() < 0.5 else bytes(rng.integers(97, 123, rng.integers(1, 60), dtype=np.uint8)) for _ in range(6)]
        texts.append(b"".join(parts).decode())
    texts.append(texts[-1])
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3), length).collect()
    want = _without_repeats([(t or "").encode() for t in texts], length)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == dict(enumerate(want))


def test_prefix_doubling_on_documents(spark, documents, odd, none):
    got = QUERIES["op7_prefix_doubling_dedup"](spark, SMALL).toPandas().set_index("doc_id")
    want = _without_repeats([t.encode() for t in documents.text], 400)
    assert [tuple(got.loc[i, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]]) for i in documents.doc_id] == [(a, b, c, hashlib.sha256(d).hexdigest()) for a, b, c, d in want]
    assert suffix_dedup.remove_repeats(odd).count() == len(ODD) and suffix_dedup.remove_repeats(none).count() == 0


def _auc(score, y):
    rank = pd.Series(score).rank().to_numpy()
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("name, label, least", [("op8_fourier_quality", "quality", 0.97), ("op10_noisy_or_toxicity", "toxic", 0.8)])
def test_classifiers_on_the_held_out_fold(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    both = got.merge(duckdb.sql(f"SELECT doc_id, {label} AS y FROM '{sf}/labels.parquet'").df(), on="doc_id")
    held = both[both.held_out]
    assert _auc(held.score, held.y.to_numpy()) > least
    assert (held[held.y == (1 if label == "quality" else 0)].predicted == (label == "quality")).mean() > 0.97


def test_classifiers_on_odd_rows(spark, odd, none, labels):
    scores = quality.quality_scores(odd, labels).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores) and all(r["held_out"] for r in scores if r["doc_id"] is None)
    assert {r["score"] for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0 and quality.keep_quality(none, labels).count() == 0
    assert quality.keep_quality(odd, labels, threshold=0.0).count() == len(ODD)
    model = toxicity.fit_toxicity(odd, labels, min_docs=1, min_lift=0.0)
    assert toxicity.toxicity_scores(odd, model).count() == len(ODD)
    empty = toxicity.fit_toxicity(odd, labels.limit(0))
    assert all(r["score"] < 1e-6 for r in toxicity.toxicity_scores(odd, empty).filter("doc_id IN (3, 4)").collect())
    assert toxicity.toxicity_scores(none, model).count() == 0


def test_toxic_sentences_are_located(spark):
    clean = ["the day was long and warm", "we walked along the river", "a train left the town", "they read the paper"]
    docs = [(i, ". ".join([clean[(i + j) % 4] for j in range(5)] + (["you utter snork of a man"] if i % 3 == 0 else [])) + ".") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = toxicity.fit_toxicity(df, df.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    found = toxicity.locate_sentences(df, model).collect()
    assert {r["doc_id"] for r in found} == {i for i, _ in docs if i % 3 == 0} and all("snork" in r["sentence"] for r in found)


def test_isotonic_is_monotone():
    x, y, w = np.arange(6.0), np.array([1, 0, 2, 1, 5, 9.0]), np.array([2, 2, 4, 4, 6, 9.0])
    kx, ky = quality.isotonic(x, y, w)
    assert (np.diff(ky) >= 0).all() and (np.diff(kx) > 0).all() and np.interp(0, kx, ky) == 0.25 and np.interp(5, kx, ky) == 1


def test_decontamination(spark, odd, none):
    item = "On Monday morning Alice bought 12 apples for 30 dollars and then walked back with Carol to the old market where 5 more apples were given away to children"
    again = item.replace("Alice", "Bruno").replace("Carol", "Dora").replace("12", "47").replace("30", "88").replace(" 5 ", " 9 ")
    mixed = item.replace("and then walked back with Carol", "or Peter ran off").replace("12 apples", "12 stones").replace("30 dollars", "many coins").replace("market where 5 more apples", "hut as 2 old pears")
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (None, "", 1), (9, "Short item text", 1)], "item_id bigint, text string, k int")
    docs = spark.createDataFrame([(1, f"Some words first. {item}. And after."), (2, f"Intro here.\n{again}"), (3, mixed), (4, "Short item text"), (5, None), (6, BASE), (1, f"Some words first. {item}. And after.")], "doc_id bigint, text string")
    got = [(r["doc_id"], r["contaminated"], list(r["item_ids"])) for r in decontam.judge_documents(docs, bench).collect()]
    assert sorted(got) == [(1, True, [7]), (1, True, [7]), (2, True, [7]), (3, False, []), (4, True, [9]), (5, False, []), (6, False, [])]
    shuffled = decontam.judge_documents(docs, bench, max_broadcast=0).collect()
    assert sorted((r["doc_id"], r["contaminated"], list(r["item_ids"])) for r in shuffled) == sorted(got)
    assert decontam.keep_clean(odd, bench).count() == len(ODD) and decontam.keep_clean(odd, bench).columns == odd.columns
    assert decontam.judge_documents(none, bench).count() == 0 and decontam.judge_documents(odd, bench.limit(0)).filter("contaminated").count() == 0
    # one slot value cannot stand for two
    pair = lambda p, d: {"doc_pos": p, "item_pos": p, "item_slots": ["alice"], "doc_slots": [d]}
    assert decontam._consistent([pair(0, "b"), pair(1, "b"), pair(2, "c")], 3) == pytest.approx(2 / 3)


def test_short_items_are_found_inside_documents(spark):
    texts = {1: "What is the capital city of France?", 2: "12 + 30 = 42 and 7", 3: "法国的首都是哪个城市", 4: "Anna 12 Ben 30 likes Carl 5 Dora 9 meets Emil 4 Finn 8 gives Gina 2 Hugo 1 sees", 5: "Short item text"}
    bench = spark.createDataFrame(list(texts.items()), "item_id bigint, text string")
    docs = [(i, f"{BASE}. Question: {t} Some words follow here. {BASE}") for i, t in texts.items()]
    docs += [(11, BASE), (12, "We saw 3 + 4 = 9 and 8 in it"), (13, "the capital city of what is France"), (14, None), (15, "a short item of text"), (16, "Say: what is the capital city of Spain"), (17, "今天的问题法国的首都是哪个城市请回答")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for how in ({}, {"max_broadcast": 0}):
        got = {r["doc_id"]: list(r["item_ids"]) for r in decontam.judge_documents(df, bench, **how).collect()}
        assert got == {i: [i] for i in texts} | {11: [], 12: [], 13: [], 14: [], 15: [], 16: [1], 17: [3]}


def test_questions_that_begin_with_names(spark):
    item = "Alice has 12 red apples in her basket. Bob takes 5 of them home. Alice buys 8 more from the shop. How many apples does Alice have now? Bob gives 3 back to her."
    again = item.replace("Alice", "Walter").replace("Bob", "Nina").replace("12", "40").replace("5", "9").replace("8", "17").replace("3 ", "6 ")
    longer = again.replace("Walter", "Mary Ann Smith")
    swapped = again.replace("Nina takes", "Walter takes").replace("Walter buys", "Otto buys").replace("does Walter", "does Peter").replace("Nina gives", "Hugo gives")
    trip = "A train leaves Boston at 9 for Denver while a second train leaves Denver for Boston at 11 on the same line of track"
    moved = trip.replace("Boston", "New York").replace("9", "4").replace("11", "7").replace("Denver", "San Diego")
    other = "Alice met 12 old friends near the river. Bob sang 5 songs there. Alice danced 8 times until dawn."
    bench = spark.createDataFrame([(1, item), (2, trip)], "item_id bigint, text string")
    docs = [(1, item), (2, f"{BASE}. {again}"), (3, f"{BASE}\n{longer} {BASE}"), (4, trip), (5, f"Intro here. {moved}. {BASE}"), (6, other), (7, swapped), (8, f"Text: {item}")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: (list(r["item_ids"]), r["share"]) for r in decontam.judge_documents(df, bench).collect()}
    assert {i: v[0] for i, v in got.items()} == {1: [1], 2: [1], 3: [1], 4: [2], 5: [2], 6: [], 7: [1], 8: [1]}
    assert all(got[i][1] == 1.0 for i in (1, 2, 3, 4, 5)) and got[7][1] < 1.0  # one name for two people


def test_clashing_names_and_repeated_ids(spark):
    """Unrelated texts under one id all stay, and columns named like helpers come back as they were."""
    other = " ".join(f"z{i}" for i in range(60))
    third = " ".join(f"y{i}" for i in range(60))
    rows = [(1, BASE, "a", 5, 7), (1, other, "b", 5, 7), (2, BASE.replace("w40 ", ""), "c", 5, 7), (2, third, "d", 5, 7), (None, third + " more", "e", 5, 7), (None, "only " * 9, "f", 5, 7), (3, "", "g", 5, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _nj_k string, N_LINES int, _dc_k int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["_nj_k"] for r in kept.collect()) == ["a", "b", "d", "f", "g"]
    bench = spark.createDataFrame([(1, other)], "item_id bigint, text string")
    clean = decontam.keep_clean(docs, bench)
    assert clean.columns == docs.columns and sorted(r["_nj_k"] for r in clean.collect()) == ["a", "c", "d", "e", "f", "g"] and {r["_dc_k"] for r in clean.collect()} == {7}
    lines = line_dedup.drop_recurring_lines(docs)
    assert lines.columns == ["doc_id", "text", "_nj_k", "_dc_k", "n_lines", "n_dropped"] and lines.count() == len(rows)
