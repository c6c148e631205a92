"""Queries for run reports (K1-K11) over `events` (user = run, value = metric)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import reports as K
from corpuskit.plans.inputs import table
from corpuskit.plans.registry import query

RUN_PATH = "concat('model_', CAST(user_id % 5 AS VARCHAR), '/run_', CAST(user_id % 3 AS VARCHAR))"
EV = f"""ev AS (SELECT event_id, ts, user_id, event_type AS task, value, {RUN_PATH} AS run_path,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
NAMED = EV + """, nm AS (SELECT *, regexp_extract(run_path, '^(.*)/run_(\\d+)', 1) AS model,
  CAST(regexp_extract(run_path, '^(.*)/run_(\\d+)', 2) AS INTEGER) AS run FROM ev)"""


def events(spark, d):
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    rp = F.concat(F.lit("model_"), (F.col("user_id") % 5).cast("string"), F.lit("/run_"), (F.col("user_id") % 3).cast("string"))
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("task"), "value", rp.alias("run_path"), k.alias("k"))


def named(spark, d):
    e = events(spark, d)
    name, run = K.name_and_run("run_path")
    return e.withColumn("model", name).withColumn("run", run)


@query("union_metrics", f"""WITH {EV}
SELECT event_id, run_path, task, value AS valid_accuracy, CAST(NULL AS VARCHAR) AS is_mixture FROM ev WHERE task IN ('click', 'view')
UNION ALL
SELECT event_id, run_path, task, value, CAST(task = 'purchase' AS VARCHAR) FROM ev WHERE task NOT IN ('click', 'view')""")
def q_union_metrics(spark, d):
    e = events(spark, d)
    a = e.filter(F.col("task").isin("click", "view")).select("event_id", "run_path", "task", F.col("value").alias("valid_acc"))
    b = e.filter(~F.col("task").isin("click", "view")).select("event_id", "run_path", "task", F.col("value").alias("valid_accuracy"),
                                                               (F.col("task") == "purchase").alias("is_mixture"))
    u = K.union_metrics([a, b], {"valid_acc": "valid_accuracy"})
    return u.select("event_id", "run_path", "task", "valid_accuracy", F.col("is_mixture").cast("string").alias("is_mixture"))


CKPT_SQL = ("concat_ws('/', 'model_' || CAST(user_id % 5 AS VARCHAR), 'finetuned', "
            "CASE WHEN event_id % 4 = 0 THEN 'model' ELSE 'model_' || CAST(event_id AS VARCHAR) END)")


def _ckpt(e):
    chk = F.when(F.col("event_id") % 4 == 0, F.lit("model")).otherwise(F.concat(F.lit("model_"), F.col("event_id").cast("string")))
    return K.checkpoint_path(F.concat(F.lit("model_"), (F.col("user_id") % 5).cast("string")), F.lit("finetuned"), chk)


@query("checkpoint_path", f"""SELECT event_id, CASE WHEN ends_with({CKPT_SQL}, 'model') THEN {CKPT_SQL} || '.pth.tar' ELSE {CKPT_SQL} END AS path FROM events""")
def q_checkpoint_path(spark, d):
    e = table(spark, d, "events", "event_id", "user_id")
    return e.select("event_id", _ckpt(e).alias("path"))


@query("name_and_run", f"""WITH p AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'model_' || CAST(user_id % 5 AS VARCHAR) || '/mixture' ELSE {RUN_PATH} END AS path FROM events)
SELECT event_id, CASE WHEN regexp_matches(path, '^(.*)/run_(\\d+)') THEN regexp_extract(path, '^(.*)/run_(\\d+)', 1) ELSE path END AS name,
       CAST(CASE WHEN regexp_matches(path, '^(.*)/run_(\\d+)') THEN CAST(regexp_extract(path, '^(.*)/run_(\\d+)', 2) AS INTEGER) ELSE 0 END AS INTEGER) AS run FROM p""")
def q_name_and_run(spark, d):
    e = table(spark, d, "events", "event_id", "user_id")
    rp = F.concat(F.lit("model_"), (F.col("user_id") % 5).cast("string"), F.lit("/run_"), (F.col("user_id") % 3).cast("string"))
    mix = F.concat(F.lit("model_"), (F.col("user_id") % 5).cast("string"), F.lit("/mixture"))
    p = e.select("event_id", F.when(F.col("user_id") % 7 == 0, mix).otherwise(rp).alias("path"))
    name, run = K.name_and_run("path")
    return p.select("event_id", name.alias("name"), run.alias("run"))


BEST_RUN = NAMED + """, br AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task, model, run ORDER BY value DESC, k DESC, event_id) AS rn FROM nm) WHERE rn = 1)"""


def best_per_run(spark, d):
    return K.best_rows(named(spark, d), ["task", "model", "run"], ["value", "k"], "event_id")


@query("best_per_run", "WITH " + BEST_RUN + " SELECT task, model, run, event_id, value FROM br")
def q_best_per_run(spark, d):
    return best_per_run(spark, d).select("task", "model", "run", "event_id", "value")


@query("mean_std_over_runs", "WITH " + BEST_RUN + """
SELECT task, model, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n_runs FROM br GROUP BY task, model""")
def q_mean_std_over_runs(spark, d):
    m = K.mean_std_over_runs(best_per_run(spark, d), ["task", "model"], "value")
    return m.select("task", "model", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n_runs")


@query("best_checkpoint", "WITH " + NAMED + """
SELECT task, event_id, run_path, value FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY value DESC, k DESC, event_id) AS rn FROM nm) WHERE rn = 1""")
def q_best_checkpoint(spark, d):
    return K.best_rows(named(spark, d), ["task"], ["value", "k"], "event_id").select("task", "event_id", "run_path", "value")


@query("retention_plan", "WITH " + NAMED + f""", bt AS (SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY task ORDER BY value DESC, k DESC, event_id) AS rn FROM nm) WHERE rn = 1),
ck AS (SELECT event_id, CASE WHEN ends_with({CKPT_SQL}, 'model') THEN {CKPT_SQL} || '.pth.tar' ELSE {CKPT_SQL} END AS path FROM events)
SELECT ck.event_id, ck.path, CASE WHEN bt.event_id IS NOT NULL THEN 'keep' WHEN NOT ends_with(ck.path, '.pth.tar') THEN 'skip' ELSE 'delete' END AS action
FROM ck LEFT JOIN bt USING (event_id)""")
def q_retention_plan(spark, d):
    e = table(spark, d, "events", "event_id", "user_id")
    ck = e.select("event_id", _ckpt(e).alias("path"))
    best = K.best_rows(named(spark, d), ["task"], ["value", "k"], "event_id")
    return K.retention_plan(ck, best, "event_id", "path").select("event_id", "path", "action")


@query("replicas_agree", """
SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT value) AS n_values FROM events GROUP BY ALL HAVING count(DISTINCT value) > 1""")
def q_replicas_agree(spark, d):
    e = table(spark, d, "events", "user_id", "event_type", "ts", "value").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return K.replicas_disagree(e, ["user_id", "event_type", "day"], "value")


RB = EV + """, rb AS (SELECT event_id, run_path, value, max(value) OVER (PARTITION BY run_path ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM ev),
rbi AS (SELECT *, best_before IS NULL OR value > best_before AS improved FROM rb)"""


def running(spark, d):
    return K.running_best(events(spark, d), "run_path", ["ts", "event_id"], "value", keep_ranges=True)


@query("running_best", "WITH " + RB + " SELECT event_id, run_path, best_before, improved FROM rbi")
def q_running_best(spark, d):
    return running(spark, d).select("event_id", "run_path", "best_before", "improved")


@query("patience", "WITH " + RB + """, pg AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (PARTITION BY run_path ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM rbi
  JOIN (SELECT event_id, ts FROM events) USING (event_id))
SELECT event_id, run_path, CAST(row_number() OVER (PARTITION BY run_path, g ORDER BY ts, event_id) - 1 AS INTEGER) AS since_improvement,
       row_number() OVER (PARTITION BY run_path, g ORDER BY ts, event_id) - 1 > 15 AS stop FROM pg""")
def q_patience(spark, d):
    p = K.patience(running(spark, d), "run_path", ["ts", "event_id"], 15)
    return p.select("event_id", "run_path", "since_improvement", "stop")


HP_PATH = ("concat('lr_', ['1e-4', '5e-5', '2e-5'][user_id % 3 + 1], '_sched_', ['linear', 'constant'][user_id % 2 + 1], '_wd_1e-3_len_', "
           "CAST([256, 512, 1024][(user_id // 3) % 3 + 1] AS VARCHAR), '_it_9000/run_', CAST(user_id % 4 AS VARCHAR))")


@query("best_hyperparams", f"""
WITH r AS (SELECT {HP_PATH} AS path, max(value) AS score FROM events GROUP BY user_id),
p AS (SELECT regexp_extract(path, '{K.HP_RE}', 1) AS lr, regexp_extract(path, '{K.HP_RE}', 2) AS scheduler,
             regexp_extract(path, '{K.HP_RE}', 3) AS decay, regexp_extract(path, '{K.HP_RE}', 4) AS length,
             regexp_extract(path, '{K.HP_RE}', 5) AS iterations, score FROM r),
s AS (SELECT lr, scheduler, decay, length, iterations, avg(score) AS mean, stddev_samp(score) AS std, count(*) AS n_runs FROM p GROUP BY ALL)
SELECT length, lr, scheduler, decay, iterations, round(mean, 6) AS mean, round(std, 6) AS std, n_runs
FROM (SELECT *, row_number() OVER (PARTITION BY length ORDER BY mean DESC, lr) AS rn FROM s) WHERE rn = 1""")
def q_best_hyperparams(spark, d):
    e = table(spark, d, "events", "user_id", "value")
    lr = F.element_at(F.array(F.lit("1e-4"), F.lit("5e-5"), F.lit("2e-5")), (F.col("user_id") % 3 + 1).cast("int"))
    sch = F.element_at(F.array(F.lit("linear"), F.lit("constant")), (F.col("user_id") % 2 + 1).cast("int"))
    ln = F.element_at(F.array(F.lit(256), F.lit(512), F.lit(1024)), (F.floor(F.col("user_id") / 3) % 3 + 1).cast("int"))
    path = F.concat(F.lit("lr_"), lr, F.lit("_sched_"), sch, F.lit("_wd_1e-3_len_"), ln.cast("string"), F.lit("_it_9000/run_"),
                    (F.col("user_id") % 4).cast("string"))
    runs = e.groupBy("user_id").agg(F.max("value").alias("score"), F.first(path).alias("path"))
    b = K.best_hyperparams(runs, "path", "score")
    return b.select("length", "lr", "scheduler", "decay", "iterations", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n_runs")
