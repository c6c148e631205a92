"""White space, accents and word borders beyond ASCII, against Python's own."""

import re
import string
import unicodedata

from pyspark.sql import functions as F

from corpuskit.functions import text as T

ODD = ["\u00a0x\u3000", "\u2028 a\u2009b \x1c", "\x85\u202f", "\u200b x \u200b", "a\u00a0b\u1680c\x0bd", "\ufeffx ", "", "\n\t é \r"]


def test_strip_and_split(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    for r in df.select("t", T.strip_ws("t").alias("s"), T.split_ws("t").alias("w")).collect():
        assert r["s"] == r["t"].strip() and r["w"] == r["t"].split()
    assert {chr(c) for c in range(0x110000) if chr(c).isspace()} == {chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and re.fullmatch(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), T.WS), chr(c))}


def test_strip_accents_is_nfd_without_marks(spark):
    chars = [chr(c) for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.decomposition(chr(c)) or unicodedata.category(chr(c)) == "Mn" or 0xAC00 <= c < 0xD7A4)]
    words = ["\u05e9\u05c1\u05b8\u05dc\u05d5\u05b9\u05dd", "\u0e40\u0e02\u0e49\u0e32", "\u1ea4\u0323 \ud55c\uad6d\uc5b4 \uac00\uac01", "e\u0301\u0327", "\u092b\u093c \u0cca", "plain", "\U0001d15e"]
    rows = ["|".join(chars[i : i + 50]) for i in range(0, len(chars), 50)] + words
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", T.strip_accents("t")).collect()]
    want = lambda t: "".join(ch for ch in unicodedata.normalize("NFD", t) if unicodedata.category(ch) != "Mn")
    # text by text NFD also reorders marks, which are all dropped
    assert len(got) == len(rows) and all(s == want(t) for t, s in got)


def plain_normalize(t):
    t = "".join(ch for ch in t.lower() if ch not in set(string.punctuation))
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", t).split())


def test_normalize_answer(spark):
    rows = ["\u201cThe cat\u201d, an apple", "the\u00a0end of a\u2009day", "The the a An x", "an_a the1 \u00e9the theatre a\u00e9", "the-an", "\u2014the\u2014", "\u5341a\u5341 a\u3002", "A"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[1] for r in df.select("t", T.normalize_answer("t")).collect()] == [plain_normalize(t) for t in rows]


def test_basic_tokens_of_hangul_and_hebrew(spark):
    text = "\ud55c\uad6d \u05e9\u05c1\u05b8\u05dc\u05d5\u05b9\u05dd! \u00c9t\u00e9"
    (w,) = spark.createDataFrame([(text,)], "t string").select(T.basic_tokens("t")).first()
    assert w == [unicodedata.normalize("NFD", "\ud55c\uad6d"), "\u05e9\u05dc\u05d5\u05dd", "!", "ete"]
    (n,) = spark.createDataFrame([([text] * 3,)], "x array<string>").select(F.transform("x", lambda x: T.basic_tokens(x))).first()
    assert n == [w] * 3


def test_special_characters_are_looked_for_after_a_plain_range(spark):
    """Every character from the first special one on passes the cheap test; the result is that of ``unicodedata``."""
    texts = ["plain", "café naïve", "˿", "̈́", "각x", "aक़b", "\U0001d15e", "ẛ̣", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    col = T.strip_accents("t")
    first = min(map(ord, T._accent_table()[2]))
    assert rf"[^\x00-\x{{{first - 1:X}}}]" in d.select(col)._jdf.queryExecution().analyzed().toString()
    got = {r["i"]: r["x"] for r in d.select("i", col.alias("x")).collect()}
    want = [None if t is None else "".join(x for x in unicodedata.normalize("NFD", t) if unicodedata.category(x) != "Mn") for t in texts]
    assert [got[i] for i in range(len(texts))] == want
