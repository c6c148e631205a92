"""Evaluation metrics (I1-I18) as DataFrame aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_labels(df: DataFrame, col: str, mapping: dict[str, int], strict: bool = True, out: str = "label_id",
               default: int = 0) -> DataFrame:
    """Label string -> id through a broadcast join on the (literal, bounded) map.

    ``strict``: an unknown label raises (encoder data); otherwise it maps to ``default``
    (generated text).
    """
    spark = df.sparkSession
    m = spark.createDataFrame([(k, int(v)) for k, v in mapping.items()], f"{col} string, {out} int")
    j = df.join(F.broadcast(m), col, "left")
    if strict:
        val = F.when(F.col(out).isNull(), F.raise_error(F.concat(F.lit("unknown label: "), F.col(col).cast("string")))).otherwise(F.col(out))
    else:
        val = F.coalesce(F.col(out), F.lit(default))
    return j.withColumn(out, val.cast("int"))


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def accuracy(df: DataFrame, truth: str, pred: str, group: list[str] | None = None) -> DataFrame:
    """Share of equal (partial aggregation; one row per group)."""
    return df.groupBy(*(group or [])).agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, truth: str, pred: str, positive=1, group: list[str] | None = None) -> DataFrame:
    t, p = F.col(truth) == positive, F.col(pred) == positive
    return df.groupBy(*(group or [])).agg(
        F.sum((t & p).cast("long")).alias("tp"), F.sum((~t & p).cast("long")).alias("fp"),
        F.sum((t & ~p).cast("long")).alias("fn"), F.sum((~t & ~p).cast("long")).alias("tn"))


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def precision_recall_f1(df: DataFrame, truth: str, pred: str, positive=1, group: list[str] | None = None) -> DataFrame:
    """Binary precision, recall, F1 for the positive class; zero denominators give 0 [spec]."""
    c = confusion(df, truth, pred, positive, group)
    prec = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = _safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.select(*(group or []), prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def f1_micro(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Micro F1 over classes = 2*sum(tp) / (2*sum(tp) + sum(fp) + sum(fn)) over all labels."""
    tp = F.sum((F.col(truth) == F.col(pred)).cast("long"))
    n = F.count(F.lit(1))
    # every wrong prediction is one fp (for the predicted class) and one fn (for the true class)
    return df.agg(_safe_div(2 * tp, 2 * tp + 2 * (n - tp)).alias("f1_micro"))


def f1_with_invalid(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """I4 [spec]: predictions outside {0,1} count as wrong (flipped from the truth); F1 in 0..1."""
    fixed = F.when(F.col(pred).isin(0, 1), F.col(pred)).otherwise(1 - F.col(truth))
    return precision_recall_f1(df.withColumn("_p", fixed), truth, "_p").select("f1")


def matthews_corr(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Matthews correlation from the confusion sums (0 when undefined)."""
    c = confusion(df, truth, pred)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(F.when(den == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / den).alias("mcc"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """I6."""
    return df.agg(F.corr(x, y).alias("pearson"))


def average_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """Rank with ties averaged: (number of smaller values) + (ties + 1) / 2.

    Counts per distinct value, then a prefix over distinct values (two-level,
    no global window over rows), joined back on the value.
    """
    from corpuskit.functions import prefix as P

    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_t"))
    b = P.range_bucket(counts, col, 16)
    pos = P.global_positions(counts, [F.col(col)], b, rank_col=None, sums={"_below": F.col("_t")})
    r = pos.select(col, (F.col("_below") + (F.col("_t") + 1) / 2.0).alias(out))
    return df.join(r, col)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of tie-averaged ranks."""
    r = average_rank(average_rank(df, x, "_rx"), y, "_ry")
    return r.agg(F.corr("_rx", "_ry").alias("spearman"))


def best_over_references(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    return scores.groupBy(*keys).agg(F.max(score).alias(score))


def bag_f1(pred_tokens: DataFrame, ref_tokens: DataFrame, key: str, ref: str, token: str = "tok") -> DataFrame:
    """I9 per (key, ref): clipped bag-of-words overlap -> F1 (0 if no overlap).

    Token rows are counted per (key, ref, token) and joined on (key, token):
    a shuffle keyed by example, never by token alone (hot tokens cannot skew it).
    """
    pc = pred_tokens.groupBy(key, token).agg(F.count(F.lit(1)).alias("_p"))
    rc = ref_tokens.groupBy(key, ref, token).agg(F.count(F.lit(1)).alias("_r"))
    common = rc.join(pc, [key, token]).groupBy(key, ref).agg(F.sum(F.least("_p", "_r")).alias("_c"))
    lp = pred_tokens.groupBy(key).agg(F.count(F.lit(1)).alias("_lp"))
    lr = ref_tokens.groupBy(key, ref).agg(F.count(F.lit(1)).alias("_lr"))
    j = lr.join(lp, key, "left").join(common, [key, ref], "left").fillna(0, ["_c", "_lp"])
    prec = _safe_div(F.col("_c"), F.col("_lp"))
    rec = _safe_div(F.col("_c"), F.col("_lr"))
    f1 = F.when(F.col("_c") == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))
    return j.select(key, ref, f1.alias("f1"), prec.alias("precision"), rec.alias("recall"))


def ngram_rows(df: DataFrame, keys: list[str], words: str, n: int) -> DataFrame:
    w = F.col(words)
    k = F.size(w) - n + 1
    g = F.when(k > 0, F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array())
    return df.select(*keys, F.explode(g).alias("tok"))


def corpus_bleu(pred: DataFrame, ref: DataFrame, key: str, words: str = "words", max_n: int = 4) -> DataFrame:
    """I13 [spec]: clipped 1..4-gram precisions over the corpus x brevity penalty; one row."""
    parts = []
    for n in range(1, max_n + 1):
        pc = ngram_rows(pred, [key], words, n).groupBy(key, "tok").agg(F.count(F.lit(1)).alias("_p"))
        rc = ngram_rows(ref, [key], words, n).groupBy(key, "tok").agg(F.count(F.lit(1)).alias("_r"))
        m = pc.join(rc, [key, "tok"], "left").fillna(0, ["_r"])
        parts.append(m.agg(F.sum(F.least("_p", "_r")).alias("match"), F.sum("_p").alias("total")).withColumn("n", F.lit(n)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    lens = pred.agg(F.sum(F.size(words)).alias("c")).crossJoin(ref.agg(F.sum(F.size(words)).alias("r")))
    prec = out.agg(F.sum(F.log(F.col("match") / F.col("total"))).alias("_lp"), F.min("match").alias("_mm"))
    j = prec.crossJoin(lens)
    bp = F.when(F.col("c") > F.col("r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    return j.select(F.when(F.col("_mm") == 0, F.lit(0.0)).otherwise(bp * F.exp(F.col("_lp") / max_n)).alias("bleu"),
                    bp.alias("brevity_penalty"), F.col("c").alias("sys_len"), F.col("r").alias("ref_len"))


def rouge_n(pred: DataFrame, ref: DataFrame, key: str, words: str, n: int) -> DataFrame:
    """I10 [spec]: per example ROUGE-n F1 from clipped n-gram overlap."""
    p = ngram_rows(pred, [key], words, n)
    r = ngram_rows(ref, [key], words, n).withColumn("_ref", F.lit(0))
    return bag_f1(p, r, key, "_ref").select(key, F.col("f1").alias(f"rouge{n}"))


def lcs_len_udf():
    """Arrow UDF: LCS length of two word arrays (dynamic programming per pair)."""
    from corpuskit.functions.arrow_udfs import lcs_length

    return lcs_length


def rouge_l(df: DataFrame, key: str, pred_words: str, ref_words: str) -> DataFrame:
    """I11 [spec]: LCS F1."""
    d = df.select(key, lcs_len_udf()(F.col(pred_words), F.col(ref_words)).alias("_l"), F.size(pred_words).alias("_lp"), F.size(ref_words).alias("_lr"))
    p, r = _safe_div(F.col("_l"), F.col("_lp")), _safe_div(F.col("_l"), F.col("_lr"))
    return d.select(key, F.when(F.col("_l") == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)).alias("rougeL"))


def rouge_lsum(df: DataFrame, key: str, pred_lines: str, ref_lines: str) -> DataFrame:
    """I11 [spec]: summary-level ROUGE-L over arrays of sentences (arrays of words): for each reference sentence the
    union of its LCS with every predicted one, every word counted at most as often as both sides have it."""
    from corpuskit.functions.arrow_udfs import lsum_f1

    return df.select(key, lsum_f1(pred_lines, ref_lines).alias("rougeLsum"))


def geomean(df: DataFrame, cols: list[str], out: str = "geomean") -> DataFrame:
    """I12 [spec]: geometric mean of several scores of one row, ``exp(avg(ln))``."""
    ln = sum(F.log(F.col(c)) for c in cols) / len(cols)
    return df.select("*", F.exp(ln).alias(out))


def mlm_accuracy(df: DataFrame, batch: str, labelled: str, correct: str) -> DataFrame:
    """Per batch correct / labelled (0 if none), then the mean over batches."""
    per = df.groupBy(batch).agg(F.sum(F.col(labelled).cast("long")).alias("_n"),
                                F.sum((F.col(labelled) & F.col(correct)).cast("long")).alias("_c"))
    return per.agg(F.avg(_safe_div(F.col("_c"), F.col("_n"))).alias("mlm_accuracy"))


def batch_mean_vs_pooled(df: DataFrame, batch: str, truth: str, pred: str) -> DataFrame:
    """I16: mean of per-batch accuracies next to the pooled accuracy."""
    eq = (F.col(truth) == F.col(pred)).cast("double")
    per = df.groupBy(batch).agg(F.avg(eq).alias("_a"), F.count(F.lit(1)).alias("_n"), F.sum(eq).alias("_s"))
    return per.agg(F.avg("_a").alias("batch_mean"), (F.sum("_s") / F.sum("_n")).alias("pooled"))


def metrics_by_split(metrics: DataFrame, split: str, names: list[str], splits: list[str]) -> DataFrame:
    """One wide row ``{split}_{metric}`` (pivot over a known split list)."""
    long = None
    for m in names:
        part = metrics.select(split, F.lit(m).alias("_m"), F.col(m).cast("double").alias("_v"))
        long = part if long is None else long.unionByName(part)
    wide = long.withColumn("_k", F.concat(F.col(split), F.lit("_"), F.col("_m")))
    keys = [f"{s}_{m}" for s in splits for m in names]
    return wide.groupBy().pivot("_k", keys).agg(F.first("_v"))
