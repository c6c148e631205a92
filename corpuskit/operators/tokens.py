"""Sentences, words, vocabulary and token tables.

Per-row tokenisers are re-aimed as corpus jobs: documents are split into
sentences and words with JVM expressions, every *distinct* word is numbered
once (the vocabulary), and ids are attached where the sentences lie by an index of
at most ``BROADCAST_VOCAB_ROWS`` words (checked with a count), or by a join: a
broadcast one below that count, else a shuffle join and AQE splits hot words.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions import arrow_udfs as A
from corpuskit.functions import prefix
from corpuskit.functions import specials as S
from corpuskit.functions import text as T
from corpuskit.operators.cleaning import keep_rows
from corpuskit.session import written

SENT_MARK = "\u001f"
SENT_BREAK = r"([.!?])[ \t\n\r]+"
BROADCAST_VOCAB_ROWS = 2_000_000
ABSENT = -(1 << 31)  # no id: the index lacks the word
UNKNOWN = "[UNK]"


def sentences_of(text) -> "F.Column":
    """C1 rule: break after ``.``, ``!`` or ``?`` followed by whitespace; strip; drop empties.

    (The reference uses a trained Punkt model that is not available; this is our rule.)
    """
    c = F.col(text) if isinstance(text, str) else text
    marked = F.regexp_replace(c, SENT_BREAK, "$1" + SENT_MARK)
    return F.filter(F.transform(F.split(marked, SENT_MARK, -1), T.strip_ws), lambda s: s != "")


def sentences_keep_ws(text) -> "F.Column":
    """Same breaks, trailing whitespace stays with its sentence."""
    c = F.col(text) if isinstance(text, str) else text
    marked = F.regexp_replace(c, r"([.!?][ \t\n\r]+)", "$1" + SENT_MARK)
    return F.filter(F.split(marked, SENT_MARK, -1), lambda s: s != "")


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text", keep_ws: bool = False) -> DataFrame:
    """One row per sentence ``(key, sent_pos, sentence)``; narrow, no shuffle."""
    arr = sentences_keep_ws(text) if keep_ws else sentences_of(text)
    return df.select(key, F.posexplode(arr).alias("sent_pos", "sentence"))


def sentence_lines(dialogs: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    """One sentence per row over flattened dialogs, empties dropped."""
    return split_sentences(dialogs, key, text)


def words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """C4 exploded: ``(key, word_pos, word)``."""
    return df.select(key, F.posexplode(T.basic_tokens(text)).alias("word_pos", "word"))


def word_counts(df: DataFrame, text: str = "text", row_cap: int | None = None, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """Corpus word frequencies (map-side partial count, then one shuffle by word).

    ``row_cap`` is the reference's ``input_sentence_size`` feature: only that many
    rows, chosen by hash order, are counted.
    """
    src = df
    if row_cap is not None:
        from corpuskit.operators.shards import sample_exact_k_rows

        src = sample_exact_k_rows(df, key, row_cap, seed)
    w = src.select(F.explode(T.basic_tokens(text)).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def tokenized(docs: DataFrame, key: str = "doc_id", text: str = "text", split: bool = True) -> DataFrame:
    """``(key, _p, _line, _marked, _whole)``: sentences with their words joined by one blank, which no word holds.

    ``_marked`` texts hold the mark that ends a sentence here, so their words as a whole may differ from those of
    their sentences; they stand in ``_whole`` of the first one.
    """
    own = F.col(text).cast("string")
    marked = F.col(text).contains(SENT_MARK) if split else F.lit(False)
    sents = sentences_of(text) if split else F.array(F.col(text))
    s = docs.withColumn("_src", F.when(marked, own))  # once per text; beside the explode it would be looked for once per sentence
    s = s.withColumn("_plain", A.plain_lines(*T.plain_table(), split)(own))  # ready lines of plain texts, which hold no mark
    s = s.select(key, "_src", F.col("_plain").isNotNull().alias("_ready"), F.posexplode(F.coalesce("_plain", sents)).alias("_p", "_sent"))
    line = F.when(F.col("_ready"), F.col("_sent")).otherwise(F.array_join(T.basic_tokens("_sent"), " "))
    whole = F.when(F.col("_src").isNotNull() & (F.col("_p") == 0), F.array_join(T.basic_tokens("_src"), " "))
    return s.select(key, "_p", line.alias("_line"), F.col("_src").isNotNull().alias("_marked"), whole.alias("_whole"))


def line_words(lines: DataFrame) -> DataFrame:
    """``(word)``, a row each, of the whole texts behind ``tokenized`` ones."""
    own = F.when(F.col("_marked"), F.col("_whole")).otherwise(F.col("_line"))
    return lines.select(F.explode(F.split(own, " ")).alias("word")).filter("word <> ''")


def build_word_vocab(df: DataFrame, text: str = "text", n_buckets: int | None = None, counts: bool = False, lines: DataFrame | None = None) -> DataFrame:
    """Word vocabulary ``(word, id)``: id = rank of the word in byte order + FIRST_WORD_ID; ``counts`` adds ``n``, how often it occurs.

    Distinct words (partial dedup before the shuffle), range-partitioned by word;
    the global rank uses the two-level prefix (partition id is the range bucket).
    The bucketed table is written so both prefix branches see the same rows, and the
    vocabulary is, since it is counted, broadcast and joined.  ``lines`` are the written
    ``tokenized`` rows of ``df``, if at hand, whose words are then not cut again.
    """
    spark = df.sparkSession
    nb = n_buckets or prefix.default_buckets(spark)
    if lines is not None:
        distinct = line_words(lines)
        distinct = distinct.groupBy("word").agg(F.count(F.lit(1)).alias("n")) if counts else distinct.distinct()
    else:
        distinct = word_counts(df, text) if counts else df.select(F.explode(T.basic_tokens(text)).alias("word")).distinct()
    ranged = written(distinct.repartitionByRange(nb, "word").withColumn("_b", F.spark_partition_id()), "words")
    ranked = prefix.global_positions(ranged, ["word"], F.col("_b"), rank_col="_r")
    return written(ranked.select("word", (F.col("_r") + S.FIRST_WORD_ID).cast("int").alias("id"), *(["n"] if counts else [])), "vocab")


def attach_ids(tokens: DataFrame, vocab: DataFrame, word: str = "word", unk: int = S.UNK) -> DataFrame:
    """C7 ids_from_tokens on exploded words: broadcast join if the vocabulary is small."""
    v = vocab.select(F.col("word").alias(word), "id")
    n = v.count()
    if n <= BROADCAST_VOCAB_ROWS:
        v = F.broadcast(v)
    return tokens.join(v, word, "left").withColumn("id", F.coalesce("id", F.lit(unk)))


def encode_corpus(docs: DataFrame, vocab: DataFrame, key: str = "doc_id", text: str = "text", split: bool = True,
                  append_eod: bool = True, n_partitions: int | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Documents -> token table ``(key, sent_pos, n_tokens, tokens)``.

    Empty sentences are dropped (``sent_pos`` stays dense), documents without
    sentences disappear, EOD is appended to the last sentence only.  Sentences are
    encoded where they lie by an index in each task and only their ids are shuffled
    by key.  Beyond ``BROADCAST_VOCAB_ROWS`` words the index holds the most frequent
    ones and only the words that it lacks are joined (``join_rare``).  Sentences and
    words are exploded one level at a time (exploding nested arrays is much slower).
    ``lines`` are the written ``tokenized`` rows of ``docs``, if at hand, which is then not tokenized again.
    """
    spark = docs.sparkSession
    n = n_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    s = (tokenized(docs, key, text, split) if lines is None else lines).select(key, "_p", "_line")
    if vocab.count() <= BROADCAST_VOCAB_ROWS:
        # dropped after the projection: a pushed-down filter would tokenize every sentence twice
        s = keep_rows(s.select(key, "_p", A.line_ids(vocab_index(vocab), S.UNK)("_line").alias("_t")), F.size("_t") > 0)
    else:
        vocab = vocab if "n" in vocab.columns else vocab.join(word_counts(docs, text), "word", "left").na.fill(0, ["n"])
        least = least_count(vocab, BROADCAST_VOCAB_ROWS)
        s = s.select(key, "_p", "_line", A.line_ids(vocab_index(vocab.filter(F.col("n") >= least)), ABSENT)("_line").alias("_t"))
        s = keep_rows(s, F.size("_t") > 0).withColumn("_w", F.split("_line", " "))
        s = join_rare(s, vocab.filter(F.col("n") < least), [key, "_p"])
    s = s.repartition(n, key)
    w = Window.partitionBy(key).orderBy("_p")
    s = s.withColumn("sent_pos", (F.row_number().over(w) - 1).cast("int"))
    s = s.withColumn("_last", F.col("sent_pos") == F.count(F.lit(1)).over(Window.partitionBy(key)) - 1)
    toks = F.col("_t")
    if append_eod:
        toks = F.when(F.col("_last"), F.concat(toks, F.array(F.lit(S.EOD)))).otherwise(toks)
    out = s.select(key, "sent_pos", toks.alias("tokens"))
    return out.select(key, "sent_pos", F.size("tokens").cast("int").alias("n_tokens"), "tokens")


def vocab_index(vocab: DataFrame):
    """A broadcast ``word_index`` of ``(word, id)``; call it for at most ``BROADCAST_VOCAB_ROWS`` words."""
    t = vocab.select(F.col("word").cast("string").alias("word"), F.col("id").cast("int").alias("id")).filter("word IS NOT NULL").toArrow()
    words = pa.concat_arrays(t["word"].chunks) if t.num_rows else pa.array([], pa.string())
    ids = pa.concat_arrays(t["id"].chunks) if t.num_rows else pa.array([], pa.int32())
    return vocab.sparkSession.sparkContext.broadcast(A.word_index(words, ids))


def least_count(vocab: DataFrame, most: int) -> int:
    """The smallest ``n`` such that at most ``most`` words have it or more; a row per distinct count comes to the driver."""
    at, total = None, 0
    for r in sorted(vocab.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["n"]):
        total += r["k"]
        if total > most:
            return r["n"] + 1 if at is None else at
        at = r["n"]
    return 0


def join_rare(sents: DataFrame, rare: DataFrame, cols: list[str], unk: int = S.UNK) -> DataFrame:
    """``(cols, _t)`` of sentences ``(cols, _w, _t)`` whose ids ``_t`` are ``ABSENT`` for the words of ``rare`` and unknown ones.

    Written once, so that sentences keep their row number; those without such a word stay where they are, and of the
    others only these words are exploded, joined and brought back.
    """
    w = F.transform("_w", lambda x, i: F.struct(i.alias("p"), x.alias("word"), F.element_at(F.col("_t"), i + 1).alias("t")))
    none = F.array().cast("array<struct<p:int,word:string>>")
    missing = F.transform(F.filter(w, lambda x: x["t"] == ABSENT), lambda x: F.struct(x["p"], x["word"]))
    s = sents.select(F.monotonically_increasing_id().alias("_row"), *cols, "_t", F.when(F.array_contains("_t", ABSENT), missing).otherwise(none).alias("_m"))
    s = written(s, "coded-sentences")
    open_, done = s.filter(F.size("_m") > 0), s.filter(F.size("_m") == 0).select(*cols, "_t")
    each = open_.select("_row", F.inline("_m")).join(rare.select("word", "id"), "word", "left")
    found = each.groupBy("_row").agg(F.collect_list(F.struct("p", F.coalesce("id", F.lit(unk)).alias("t"))).alias("_f"))
    known = F.filter(F.transform("_t", lambda t, i: F.struct(i.alias("p"), t.alias("t"))), lambda x: x["t"] != ABSENT)
    mended = F.transform(F.array_sort(F.concat(known, "_f")), lambda x: x["t"])
    return done.unionByName(open_.join(found, "_row").select(*cols, mended.alias("_t")))


def word_list(vocab: DataFrame):
    """Broadcast ids in order and their words, of ``(id, word)``; call it for at most ``BROADCAST_VOCAB_ROWS`` words."""
    t = vocab.select("id", F.col("word").cast("string").alias("word")).filter("id IS NOT NULL").toArrow().combine_chunks().sort_by("id")
    words = pa.concat_arrays(t["word"].chunks) if t.num_rows else pa.array([], pa.string())
    return vocab.sparkSession.sparkContext.broadcast((t["id"].to_numpy(), words))


def join_rare_ids(rows: DataFrame, rare: DataFrame, cols: list[str]) -> DataFrame:
    """``(cols, words)`` of rows ``(cols, _t, _w)`` of ids and their words, null for the ids of ``rare`` and unknown ones.

    Written once, so that rows keep their number; of those with such an id only these ids are exploded, joined and
    brought back.  Special ids that ``rare`` does not hold are none of them.
    """
    special = [r["id"] for r in rare.filter(F.col("id") < S.FIRST_WORD_ID).select("id").collect()]  # below 100 values
    at = F.transform("_w", lambda w, i: F.struct(i.alias("p"), F.element_at(F.col("_t"), i + 1).alias("id"), w.alias("w")))
    asked = F.filter(at, lambda x: x["w"].isNull() & ((x["id"] >= S.FIRST_WORD_ID) | x["id"].isin(special)))
    asked = F.transform(asked, lambda x: F.struct(x["p"], x["id"]))
    s = written(rows.select(F.monotonically_increasing_id().alias("_row"), *cols, "_w", asked.alias("_m")), "worded-rows")
    each = s.select("_row", F.inline("_m")).join(rare.select("id", "word"), "id")
    found = each.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("p", "word"))).alias("_f"))
    mended = F.transform("_w", lambda w, i: F.coalesce(w, F.try_element_at("_f", i), F.lit(UNKNOWN)))
    open_, done = s.filter(F.size("_m") > 0), s.filter(F.size("_m") == 0)
    plain = F.transform("_w", lambda w: F.coalesce(w, F.lit(UNKNOWN)))
    return done.select(*cols, plain.alias("words")).unionByName(open_.join(found, "_row", "left").select(*cols, mended.alias("words")))


def tokens_from_ids(tok: DataFrame, vocab: DataFrame, key_cols: list[str], tokens: str = "tokens") -> DataFrame:
    """C7 inverse: id arrays back to word arrays, ``[UNK]`` for an id without a word; rows without ids give none.

    Ids are looked up where the rows lie by an index of words in each task.  Beyond ``BROADCAST_VOCAB_ROWS`` words
    the index holds those that the rows hold most often, and only ids that it lacks are joined (``join_rare_ids``).
    """
    v = vocab.select(F.col("id").cast("int").alias("id"), "word")
    if v.count() <= BROADCAST_VOCAB_ROWS:
        words = A.id_words(word_list(v), UNKNOWN)(tokens)
        return keep_rows(tok.select(*key_cols, words.alias("words")), F.size("words") > 0)
    held = tok.select(F.explode(tokens).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    v = written(v.join(held, "id", "left").na.fill(0, ["n"]), "held-words")
    least = least_count(v, BROADCAST_VOCAB_ROWS)
    words = A.id_words(word_list(v.filter(F.col("n") >= least)), None)(tokens)
    s = keep_rows(tok.select(*key_cols, F.col(tokens).alias("_t"), words.alias("_w")), F.size("_w") > 0)
    return join_rare_ids(s, v.filter(F.col("n") < least), key_cols)


def token_stats(tok: DataFrame, group: list[str] | None = None, key: str = "doc_id", long_sentence: int = 512) -> DataFrame:
    """Documents, sentences, tokens, one-sentence and long-sentence documents.

    Two aggregations: per document (partial agg, shuffle by key) then per group.
    """
    group = group or []
    per_doc = tok.groupBy(key, *group).agg(
        F.count(F.lit(1)).alias("_ns"),
        F.sum("n_tokens").alias("_nt"),
        F.max("n_tokens").alias("_mx"),
    )
    return per_doc.groupBy(*group).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("_ns").cast("bigint").alias("sentences"),
        F.sum("_nt").cast("bigint").alias("tokens"),
        F.sum(F.when(F.col("_ns") == 1, 1).otherwise(0)).cast("bigint").alias("one_sentence_docs"),
        F.sum(F.when(F.col("_mx") > long_sentence, 1).otherwise(0)).cast("bigint").alias("long_sentence_docs"),
    )


def length_profile(df: DataFrame, length: str, limit: int, group: list[str] | None = None, exact: bool = True) -> DataFrame:
    """C14: min, max, mean, median, q0.9 of a length column and the share above ``limit``.

    ``exact`` uses ``percentile`` (linear interpolation, as pandas/DuckDB
    ``quantile_cont``); at scale use ``exact=False`` (``percentile_approx``).
    """
    group = group or []
    L = F.col(length)
    if exact:
        med, q9 = F.percentile(L, 0.5), F.percentile(L, 0.9)
    else:
        med, q9 = F.percentile_approx(L, 0.5, 10000).cast("double"), F.percentile_approx(L, 0.9, 10000).cast("double")
    return df.groupBy(*group).agg(
        F.min(L).cast("bigint").alias("min_len"),
        F.max(L).cast("bigint").alias("max_len"),
        F.round(F.avg(L), 6).alias("mean_len"),
        F.round(med, 6).alias("median_len"),
        F.round(q9, 6).alias("q90_len"),
        F.round(F.avg(F.when(L > limit, 1.0).otherwise(0.0)), 6).alias("share_above"),
    )


def vocab_consistency(a: DataFrame, b: DataFrame, names=("pad", "eos", "unk")) -> DataFrame:
    """C11: special-token ids of two vocabularies ``(token, id)``; rows where they differ."""
    x = a.filter(F.col("token").isin(*names)).select("token", F.col("id").alias("id_a"))
    y = b.filter(F.col("token").isin(*names)).select("token", F.col("id").alias("id_b"))
    return x.join(y, "token", "full_outer").filter(~F.col("id_a").eqNullSafe(F.col("id_b")))


def token_slice(tok: DataFrame, offset: int = 0, length: int | None = None, tokens: str = "tokens") -> DataFrame:
    """A12 ``get(idx, offset, length)``: a slice of each sentence's tokens."""
    n = F.size(tokens) - offset if length is None else F.lit(length)
    return tok.withColumn(tokens, F.slice(tokens, offset + 1, F.greatest(n, F.lit(0))))


def sentence_range(tok: DataFrame, key: str, start: int, end: int, tokens: str = "tokens") -> DataFrame:
    """Concatenated tokens of sentences ``[start, end)`` of every document."""
    r = tok.filter((F.col("sent_pos") >= start) & (F.col("sent_pos") < end))
    g = r.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sent_pos", tokens))).alias("_x"))
    return g.select(key, F.flatten(F.transform("_x", lambda s: s[tokens])).alias(tokens))


def merge_token_tables(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Append ``b`` after ``a`` with document ids re-based past ``a``'s maximum.

    The offset is a one-row aggregate cross-joined (a scalar), not a collect.
    """
    off = a.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).alias("_off"))
    b2 = b.crossJoin(F.broadcast(off)).withColumn(key, F.col(key) + F.col("_off")).drop("_off")
    return a.unionByName(b2)


def doc_index(tok: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with sentence counts (the reference's ``doc_idx``)."""
    return tok.groupBy(key).agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("n_tokens").cast("bigint").alias("n_tokens"))



def wordpiece_vocab(counts: DataFrame, size: int = 30000) -> DataFrame:
    """Piece vocabulary ``(piece)``: every character (alone and as ``##c``) plus the ``size``
    most frequent words (a top-k by count, ties by word)."""
    chars = counts.select(F.explode(F.split("word", "")).alias("c")).filter(F.col("c") != "").distinct()
    pieces = chars.select(F.col("c").alias("piece")).unionByName(chars.select(F.concat(F.lit("##"), "c").alias("piece")))
    top = counts.orderBy(F.col("n").desc(), F.col("word")).limit(size).select(F.col("word").alias("piece"))
    return pieces.unionByName(top).distinct()


def wordpiece_encode(words: DataFrame, pieces: DataFrame, word: str = "word", unk: str = "[UNK]", max_chars: int = 200) -> DataFrame:
    """Adds ``pieces``, at each place of a word the longest known piece (``##`` marks a continuation).

    A word with a place that no piece fits, or of more than ``max_chars`` characters, is ``unk``.
    Every *distinct* word is cut once: by a dictionary of the pieces in each task if their counted number
    allows, else by ``pieces_by_join``.
    """
    n, longest = piece_sizes(pieces)
    distinct = words.select(word).filter(F.col(word).isNotNull()).distinct()
    if n <= BROADCAST_PIECES:
        enc = distinct.select(word, A.piece_arrays(piece_dictionary(pieces), longest, unk)(word).alias("pieces"))
    else:
        enc = pieces_by_join(distinct, pieces, longest, word, unk, max_chars)
    return words.join(enc, word, "left")


BROADCAST_PIECES = 1_000_000


def piece_sizes(pieces: DataFrame) -> tuple[int, int]:
    """Number of pieces and characters of the longest."""
    r = pieces.agg(F.count(F.lit(1)).alias("n"), F.max(F.length(F.regexp_replace("piece", "^##", ""))).alias("longest")).first()
    return r["n"], r["longest"] or 1


def piece_dictionary(pieces: DataFrame):
    """A broadcast ``piece -> id`` (None without ids); call it for at most ``BROADCAST_PIECES`` pieces."""
    has = "id" in pieces.columns
    rows = pieces.select("piece", *(["id"] if has else [])).toLocalIterator()
    return pieces.sparkSession.sparkContext.broadcast({r[0]: r[1] if has else None for r in rows})


def pieces_by_join(distinct: DataFrame, pieces: DataFrame, longest: int, word: str = "word", unk: str = "[UNK]", max_chars: int = 200) -> DataFrame:
    """``(word, pieces)`` without a copy of the piece table in any task: the substrings of each word (no longer than
    the longest piece) meet the table in a join, and the longest per place are the steps of a walk over the word."""
    distinct = distinct.withColumn("_n", F.length(word))
    at = distinct.filter(F.col("_n").between(1, max_chars)).select(word, "_n", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_s"))
    sub = at.select(word, "_s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("_n") - F.col("_s") + 1))).alias("_l"))
    text = F.col(word).substr(F.col("_s"), F.col("_l"))
    known = sub.withColumn("piece", F.when(F.col("_s") > 1, F.concat(F.lit("##"), text)).otherwise(text)).join(pieces.select("piece"), "piece", "left_semi")
    steps = known.groupBy(word, "_s").agg(F.max("_l").alias("_l")).groupBy(word).agg(F.map_from_entries(F.collect_list(F.struct("_s", "_l"))).alias("_m"))
    none = F.array().cast("array<struct<s:int,l:int>>")

    def step(acc, s):
        n = F.try_element_at(acc["m"], s)
        on = F.struct((s + n).alias("next"), acc["m"].alias("m"), F.concat(acc["cuts"], F.array(F.struct(s.alias("s"), n.alias("l")))).alias("cuts"))
        return F.when((acc["next"] == s) & n.isNotNull(), on).otherwise(acc)

    walked = distinct.join(steps, word, "left").withColumn("_w", F.when(F.col("_m").isNotNull(), F.aggregate(
        F.sequence(F.lit(1), F.col("_n")), F.struct(F.lit(1).alias("next"), F.col("_m").alias("m"), none.alias("cuts")), step)))
    cut = F.transform("_w.cuts", lambda c: F.concat(F.when(c["s"] > 1, F.lit("##")).otherwise(F.lit("")), F.col(word).substr(c["s"], c["l"])))
    enc = walked.select(word, F.when(F.col("_w.next") == F.col("_n") + 1, cut).when(F.col("_n") == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(unk))).alias("pieces"))
    return enc
