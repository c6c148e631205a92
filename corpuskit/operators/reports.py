"""Reports over many runs (K1-K11): unions, best rows, running best, patience.

What depends on the evaluations before (running best, patience) is a scan over ranges of
each run; "best" rows use ``row_number`` inside a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions import prefix as P

RUN_RE = r"^(.*)/run_(\d+)"


def union_metrics(frames: list[DataFrame], renames: dict[str, str] | None = None) -> DataFrame:
    """K1: union ragged metric frames by name; legacy column names folded into the new ones."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    for old, new in (renames or {}).items():
        if old in out.columns:
            out = out.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in out.columns else F.col(old)).drop(old)
    return out


def checkpoint_path(model, finetuned, checkpoint):
    """K2: ``model/finetuned/checkpoint`` plus ``.pth.tar`` when it ends with ``model``."""
    p = F.concat_ws("/", model, finetuned, checkpoint)
    return F.when(p.endswith("model"), F.concat(p, F.lit(".pth.tar"))).otherwise(p)


def name_and_run(path):
    """K3: ``(.*)/run_(\\d+)`` -> (name, run), else (whole path, 0)."""
    c = F.col(path) if isinstance(path, str) else path
    m = c.rlike(RUN_RE)
    name = F.when(m, F.regexp_extract(c, RUN_RE, 1)).otherwise(c)
    run = F.when(m, F.regexp_extract(c, RUN_RE, 2).cast("int")).otherwise(F.lit(0))
    return name, run


def best_rows(df: DataFrame, keys: list[str], metrics: list[str], tiebreak: str) -> DataFrame:
    """K4/K6: the best row per group by ``metrics`` (in the given order) descending."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(m).desc() for m in metrics], F.col(tiebreak))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def mean_std_over_runs(best: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """K5: mean and sample std over runs (one run -> null std)."""
    return best.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"),
                                   F.count(F.lit(1)).alias("n_runs"))


def retention_plan(ckpts: DataFrame, best: DataFrame, key: str, path: str) -> DataFrame:
    """K7: keep the best checkpoints, skip paths that are not model files, delete the rest (report only)."""
    b = best.select(key).withColumn("_best", F.lit(True))
    j = ckpts.join(b, key, "left")
    action = F.when(F.col("_best"), "keep").when(~F.col(path).endswith(".pth.tar"), "skip").otherwise("delete")
    return j.select("*", action.alias("action")).drop("_best")


def replicas_disagree(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """K8: groups whose replicas report more than one value."""
    return df.groupBy(*keys).agg(F.countDistinct(metric).alias("n_values")).filter(F.col("n_values") > 1)


def running_best(df: DataFrame, run: str, order: list[str], metric: str, mode: str = "max", n_ranges: int | None = None, keep_ranges: bool = False) -> DataFrame:
    """K9: best metric before this evaluation, and whether this one improves on it.

    A scan over ranges of each run, so a run with very many evaluations is spread over tasks;
    ``keep_ranges`` leaves the column ``_range`` for ``patience``.
    """
    d = P.scan(P.ranges(df, [run], order, n_ranges), [run], order, {"best_before": (mode, F.col(metric))}, exclusive=True)
    better = F.col(metric) > F.col("best_before") if mode == "max" else F.col(metric) < F.col("best_before")
    d = d.withColumn("improved", F.col("best_before").isNull() | better)
    return d if keep_ranges else d.drop("_range")


def patience(df: DataFrame, run: str, order: list[str], patience_n: int, n_ranges: int | None = None) -> DataFrame:
    """Evaluations since the last improvement; ``stop`` when it exceeds ``patience_n``.

    The count restarts at an improvement: the position minus the largest position so far that improved.
    """
    d = df if "_range" in df.columns else P.ranges(df, [run], order, n_ranges)
    d = P.scan(d, [run], order, {"_at": ("sum", F.lit(1))})
    d = P.scan(d, [run], order, {"_last": ("max", F.when(F.col("improved"), F.col("_at")))})
    d = d.withColumn("since_improvement", (F.col("_at") - F.coalesce("_last", F.lit(1))).cast("int"))
    return d.withColumn("stop", F.col("since_improvement") > patience_n).drop("_at", "_last", "_range")


HP_RE = r"lr_([^_/]+)_sched_([^_/]+)_wd_([^_/]+)_len_(\d+)_it_(\d+)/run_(\d+)"


def parse_hyperparams(path):
    c = F.col(path) if isinstance(path, str) else path
    names = ["lr", "scheduler", "decay", "length", "iterations", "run"]
    return [F.regexp_extract(c, HP_RE, i + 1).alias(n) for i, n in enumerate(names)]


def best_hyperparams(runs: DataFrame, path: str, metric: str) -> DataFrame:
    """Parse settings from run paths; mean and std over runs per setting; best setting per length."""
    p = runs.select(*parse_hyperparams(path), F.col(metric))
    setting = ["lr", "scheduler", "decay", "length", "iterations"]
    s = p.groupBy(*setting).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(F.lit(1)).alias("n_runs"))
    return best_rows(s, ["length"], ["mean"], "lr")
