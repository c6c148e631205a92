"""Benchmark decontamination by canonical templates.

Tokens of documents and benchmark items become templates: numbers, names and
units turn into typed placeholders, all other words into their lower-case form.
Windows of ``window`` template tokens are hash-joined between documents and
items.  A placeholder match only counts if the slots agree: along one alignment
of document and item each item value must stand for one document value and back,
so a question asked again with other numbers and names is caught, while windows
that share only a pattern are not.  A document is contaminated by an item if
consistent windows cover at least ``min_share`` of the item's windows.

Windows of a document that match no item are left out before the shuffle, by a
hash set of the item windows, where that set has at most ``max_broadcast``
entries; a larger set takes the plain shuffle join, with the same result.

Every text is read in two views, each judged for itself, and the larger share
counts.  In the first a capitalised word is a name unless it starts a sentence.
In the second it is one there too, unless it is a common function word, and a run
of names is one name, so questions that begin with names and names of another
number of words are found as well.

An item without a usable window, because it is shorter or has too few plain
words, is one window as a whole: as a template if it has ``min_literal`` plain
words or nothing else, and always word by word.  Documents are cut at every
length that such items have, so an item is found at any place of a text.

Defined results: null and empty texts (of either side) have no windows and are
clean; windows with fewer than ``min_literal`` words that are no placeholders are
not used; an item of one or two words matches wherever these stand; null item ids
are kept as an item of their own; repeated rows are judged alike; empty tables
are clean or empty.  Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import free_name, written

#: Scripts without spaces between words (Thai to Lao, Burmese, Khmer, kana, Han): a letter is a token.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[^\W\d_{_UNSPACED}]+|\d+(?:[.,:/]\d+)*|[.!?\n]|(?=[^\W\d_])[{_UNSPACED}]")
NUMBER, NAME, UNIT = 1, 2, 3
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half third quarter".split())
UNITS = frozenset("mm cm km mg kg g lb lbs oz ml l mph kmh hz khz mhz ghz kw mw gb mb tb kb usd eur gbp inch inches foot feet yard yards mile miles meter meters metre metres centimeter centimeters kilometer kilometers gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit".split())


#: Capitalised words that are no names wherever they stand.
FUNCTION_WORDS = frozenset("a about above after again against all also although am among an and another any are as at be because been before being below between both but by can cannot could did do does doing during each either every few find for from further give given had has have having he hence her here hers him his how however if in into is it its let many may me might mine more most much must my neither no nor not now of off often on once only or other otherwise our ours out over own per perhaps same shall she should since so some such than that the their theirs them then there therefore these they this those though through thus to too under until up upon us very was we were what when where whether which while who whom whose why will with within without would yes yet you your yours der die das den dem des ein eine einen einem einer und oder aber wenn weil dass wie was wer wo warum ist sind war er sie es wir ihr ich nicht mit von zu auf für le la les un une des du et ou mais si quand que qui quoi comment pourquoi est sont il elle ils elles nous vous je ne pas avec dans pour el los las una y o pero cuando quien como por qué es son con para en".split())
_BASE = 0x9E3779B97F4A7C15
#: Ways to write a text as tokens: sentence starts as words, as names with runs of names in one, every token as its word.
PLAIN, NAMED, EXACT = 0, 1, 2
_SCHEMA = pa.schema([("k", pa.int64()), ("view", pa.int32()), ("pos", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("h", pa.int64()), ("slots", pa.list_(pa.string()))])


_TITLE, _NAME, _STOP = 4, 8, 16
_FLAGS = {w: NUMBER for w in NUMBER_WORDS} | {w: UNIT for w in UNITS} | {w: _STOP for w in ".!?\n"}


class Vocabulary(dict):
    """Number of each token seen, and by that number its word hash and flags: kind of placeholder, written like a name, a name at a sentence start too, sentence end."""

    def __init__(self) -> None:
        self.word, self.flag = np.zeros(4096, np.uint64), np.zeros(4096, np.uint8)

    def __missing__(self, w: str) -> int:
        i = len(self)
        if i == len(self.word):
            self.word, self.flag = np.resize(self.word, 2 * i), np.resize(self.flag, 2 * i)
        low = w.lower()
        self.word[i] = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass"))
        flag = _FLAGS.get(low, 0) or (NUMBER if w[0].isdigit() else 0)
        if not flag and low != w and len(w) > 1 and w[0].isupper() and not w.isupper():
            flag = _TITLE if low in FUNCTION_WORDS else _TITLE | _NAME
        self.flag[i] = flag
        self[w] = i
        return i


class Tokens:
    """A text's tokens and, for each view, template hashes (1 number, 2 name, 3 unit) with the range of tokens behind each."""

    def __init__(self, text: str | None, known: Vocabulary) -> None:
        if len(known) > 300_000:
            known.clear()
        self.raw = _TOKEN.findall(text or "")
        row = np.fromiter(map(known.__getitem__, self.raw), np.int64, len(self.raw))
        flag = known.flag[row]
        stop = flag == _STOP
        at = np.flatnonzero(~stop)
        first = np.concatenate([[True], stop])[at]
        flag, word = flag[at], known.word[row[at]]
        kind, name = flag & 3, flag >= _TITLE + _NAME
        code = np.where(kind > 0, kind, word)
        new = np.flatnonzero(~name | first | ~np.concatenate([[False], name[:-1]])[:len(name)])  # a run of names within a sentence is one
        named = np.where(name, np.uint64(NAME), code)[new]
        plain = np.where((flag >= _TITLE) & ~first, np.uint64(NAME), code)
        self.views = {PLAIN: (plain, at, at + 1), NAMED: (named, at[new], np.append(at[new[1:] - 1], at[-1:]) + 1), EXACT: (word, at, at + 1)}

    def slots(self, view: int, pos: int, size: int) -> list[str]:
        """Values of the placeholders of a window."""
        if view == EXACT:
            return []
        codes, start, end = self.views[view]
        return [" ".join(self.raw[start[j]:end[j]]).lower() for j in range(pos, pos + size) if codes[j] <= UNIT]


_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def size_hashes(codes: np.ndarray, sizes: list[int], view: int):
    """``(size, hashes of all windows of that size)``: one pass for a size, however large."""
    n = len(codes)
    if n > len(_POWERS[0]):
        _POWERS[:] = [np.cumprod(np.full(2 * n, x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * _POWERS[1][:n], out=total[1:])
    for size in sizes:
        if 0 < size <= n:
            h = ((total[size:] - total[:-size]) * _POWERS[0][:n - size + 1] ^ np.uint64(size * 4 + view)) * np.uint64(_BASE)
            yield size, (h ^ h >> np.uint64(29)).astype(np.int64)


def window_hashes(codes: np.ndarray, window: int, min_literal: int, view: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the usable windows."""
    for _, h in size_hashes(codes, [window], view):
        literal = np.concatenate([[0], np.cumsum(codes > UNIT)])
        at = np.flatnonzero(literal[window:] - literal[:-window] >= min(min_literal, window))
        return at, h[at]
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def _item_windows(text: str | None, known: Vocabulary, window: int, min_literal: int):
    """``(view, pos, n, size, h, slots)`` of an item; ``size`` is 0 for ordinary windows."""
    tokens, whole = Tokens(text, known), False
    for view, (codes, _, _) in tokens.views.items():
        at, h = window_hashes(codes, window, min_literal, view) if view != EXACT else ((), ())
        for p, v in zip(at, h):
            yield view, int(p), len(h), 0, int(v), tokens.slots(view, p, window)
        whole |= view != EXACT and not len(h)
        n = len(codes)
        if whole if view == EXACT else not len(h) and np.sum(codes > UNIT) >= min(min_literal, n):
            for _, one in size_hashes(codes, [n], view):
                yield view, 0, 1, n, int(one[0]), tokens.slots(view, 0, n)


def _text_windows(text: str | None, known: Vocabulary, window: int, min_literal: int, only: np.ndarray | None, sizes: dict):
    """``(view, pos, n, size, h, slots)`` of a document's windows, those in ``only`` if given."""
    tokens = Tokens(text, known)
    for view, (codes, _, _) in tokens.views.items():
        cuts = [] if view == EXACT else [(0, *window_hashes(codes, window, min_literal, view))]
        if sizes.get(view):
            cuts += [(size, np.arange(len(h)), h) for size, h in size_hashes(codes, sizes[view], view)]
        for size, at, h in cuts:
            if only is not None and len(h):
                hit = only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h if len(only) else np.zeros(len(h), bool)
                at, h = at[hit], h[hit]
            if view == EXACT:  # without slots one place is as good as any
                h, places = np.unique(h, return_index=True)
                at = at[places]
            for p, v in zip(at.tolist(), h.tolist()):
                yield view, p, 0, size, v, tokens.slots(view, p, size or window)


def _windows(rows: DataFrame, cut) -> DataFrame:
    """``(k, view, pos, n, size, h, slots)`` of ``rows(k, text)`` by ``cut(text, vocabulary)``."""

    def run(batches):
        known = Vocabulary()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[] for _ in _SCHEMA]
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for row in cut(text, known):
                        for col, x in zip(out, (key, *row)):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _SCHEMA.types)], schema=_SCHEMA)

    return rows.mapInArrow(run, "k bigint, view int, pos int, n int, size int, h bigint, slots array<string>")


def _consistent(pairs: list, n: int) -> float:
    """Share of the item's ``n`` windows that one slot mapping per alignment explains."""
    by_offset: dict[int, list] = {}
    for p in pairs:
        by_offset.setdefault(p["doc_pos"] - p["item_pos"], []).append(p)
    covered: set[int] = set()
    for group in by_offset.values():
        votes: dict[tuple, int] = {}
        for p in group:
            for v in zip(p["item_slots"], p["doc_slots"]):
                votes[v] = votes.get(v, 0) + 1
        there, back = {}, {}
        for (i, d), _ in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
            if i not in there and d not in back:
                there[i], back[d] = d, i
        covered.update(p["item_pos"] for p in group if all(there.get(i) == d for i, d in zip(p["item_slots"], p["doc_slots"])))
    return len(covered) / max(n, 1)


def contaminations(docs: DataFrame, benchmark: DataFrame, window: int = 10, min_literal: int = 5, min_share: float = 0.25, max_broadcast: int = 2_000_000) -> DataFrame:
    """``(k, item_ids, share)`` for the texts that hold a benchmark item; ``k`` is ``xxhash64(text)``."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("k"), F.col("text").cast("string").alias("text"))
    of_items = written(_windows(items, lambda text, known: _item_windows(text, known, window, min_literal)), "item-windows")
    sizes: dict[int, list[int]] = {}
    for r in of_items.filter("size > 0").select("view", "size").distinct().collect():
        sizes.setdefault(r["view"], []).append(r["size"])
    hashes = of_items.select("h").distinct()
    n = hashes.count()
    only = spark.sparkContext.broadcast(np.sort(hashes.toArrow().column("h").to_numpy())) if n <= max_broadcast else None
    texts = docs.select(F.xxhash64(F.col("text").cast("string")).alias("k"), F.col("text").cast("string").alias("text"))
    found = _windows(texts, lambda text, known: _text_windows(text, known, window, min_literal, None if only is None else only.value, sizes)).dropDuplicates(["k", "pos", "h"])
    both = found.alias("d").join(of_items.alias("i"), F.col("d.h") == F.col("i.h")).select(
        F.col("d.k").alias("k"), F.col("i.k").alias("item_id"), F.col("i.view").alias("view"), F.col("i.n").alias("n"),
        F.struct(F.col("d.pos").alias("doc_pos"), F.col("i.pos").alias("item_pos"), F.col("d.slots").alias("doc_slots"), F.col("i.slots").alias("item_slots")).alias("p"))
    pairs = both.groupBy("k", "item_id", "view", "n").agg(F.collect_list("p").alias("pairs"))

    @F.pandas_udf("double")
    def share(pairs: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_consistent(p, m) for p, m in zip(pairs, n)], dtype="float64")

    hit = pairs.select("k", "item_id", share("pairs", "n").alias("share")).filter(F.col("share") >= min_share)
    return hit.groupBy("k").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"))


def judge_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``(doc_id, contaminated, item_ids, share)`` for every row of ``docs``."""
    found = contaminations(docs, benchmark, **how)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("k")).join(found, "k", "left")
    return rows.select("doc_id", F.col("share").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns kept."""
    k = free_name("_dc_k", docs.columns)
    found = written(contaminations(docs, benchmark, **how).select(F.col("k").alias(k)), "contaminated")
    return docs.withColumn(k, F.xxhash64(F.col("text").cast("string"))).join(found, k, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
