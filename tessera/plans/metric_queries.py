"""Metric queries (M3-M18) over ``embeddings`` (logits + gold, mean and
log-variance halves) and ``events`` (run history: epoch = date, step =
order inside the day, loss = value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics as mt
from tessera.operators.ids import with_row_index
from tessera.plans.registry import query, table

N_CLASSES = 64
BATCH = 32
LATENT = 32


def r6(c) -> F.Column:
    return F.round(c, 6)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("logits"),
                    F.col("label").cast("int").alias("gold"))


def batched_predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf)
    return with_row_index(p, ["vec_id"], col="position") \
        .withColumn("batch_id", F.floor(F.col("position") / BATCH).cast("bigint"))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, epoch, step, loss): step = 0-based order inside the day,
    from a global range-sorted index minus the day's first index."""
    ev = table(spark, sf, "events").select("event_id", "ts", F.col("value").alias("loss"),
                                           F.to_date("ts").alias("epoch"))
    idx = with_row_index(ev, ["epoch", "ts", "event_id"], col="g")
    starts = idx.groupBy("epoch").agg(F.min("g").alias("g0"))
    return idx.join(starts, "epoch").select("event_id", "epoch", (F.col("g") - F.col("g0"))
                                            .alias("step"), "loss", "g")


_LSE = "(list_max(e) + ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))))"
_PRED = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS INT) AS gold FROM embeddings)"
_ARGMAX = "(list_position(e, list_max(e)) - 1)"


def _token_sql(smoothing: bool) -> str:
    if smoothing:
        loss = (f"-((1 - 0.1) * (e[gold + 1] - {_LSE}) + 0.1 / (len(e) - 1) * "
                f"((list_sum(e) - len(e) * {_LSE}) - (e[gold + 1] - {_LSE})))")
    else:
        loss = f"({_LSE} - e[gold + 1])"
    return f"""
WITH p AS {_PRED},
  a AS (SELECT sum({loss}) AS loss_sum, count(*) AS n_word,
               sum(CASE WHEN {_ARGMAX} = gold THEN 1 ELSE 0 END) AS n_correct
        FROM p WHERE gold <> 3)
SELECT round(loss_sum, 6) AS loss_sum, CAST(n_word AS BIGINT) AS n_word,
       CAST(n_correct AS BIGINT) AS n_correct, round(n_correct / n_word, 6) AS accuracy,
       round(loss_sum / n_word, 6) AS loss_per_word,
       round(loss_sum / (n_word + 1), 6) AS loss_per_word_train,
       round(exp(loss_sum / n_word), 6) AS perplexity FROM a"""


def _token_query(smoothing: bool):
    def run(spark, sf):
        m = mt.token_metrics(predictions(spark, sf), "logits", "gold", smoothing=smoothing)
        return m.select(r6("loss_sum").alias("loss_sum"), F.col("n_word").cast("bigint"),
                        F.col("n_correct").cast("bigint"), r6("accuracy").alias("accuracy"),
                        r6("loss_per_word").alias("loss_per_word"),
                        r6("loss_per_word_train").alias("loss_per_word_train"),
                        r6("perplexity").alias("perplexity"))
    return run


query("token_metrics", _token_sql(False))(_token_query(False))
query("token_metrics_smoothed", _token_sql(True))(_token_query(True))


_KL_ROW = (f"(-0.5 * list_sum(list_transform(range({LATENT}), lambda i: 1 + e[{LATENT} + i + 1] "
           f"- e[i + 1] * e[i + 1] - exp(e[{LATENT} + i + 1]))))")
_BATCHED = f"""
  p AS {_PRED},
  pb AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) // {BATCH} AS batch_id FROM p)"""


@query("batch_kl", f"""
WITH {_BATCHED}
SELECT CAST(batch_id AS BIGINT) AS batch_id, round(sum({_KL_ROW}) / count(*), 6) AS kl
FROM pb GROUP BY batch_id""")
def batch_kl(spark, sf):
    p = batched_predictions(spark, sf)
    p = p.select("batch_id", F.slice("logits", 1, LATENT).alias("mean"),
                 F.slice("logits", LATENT + 1, LATENT).alias("logvar"))
    return mt.batch_kl(p, "mean", "logvar", "batch_id").select("batch_id", r6("kl").alias("kl"))


@query("batch_objective", f"""
WITH {_BATCHED},
  b AS (SELECT batch_id, sum({_KL_ROW}) / count(*) AS kl,
               sum(CASE WHEN gold <> 3 THEN {_LSE} - e[gold + 1] ELSE 0 END) AS nll
        FROM pb GROUP BY batch_id)
SELECT CAST(batch_id AS BIGINT) AS batch_id, round(kl, 6) AS kl, round(nll, 6) AS nll,
       round(1 / (1 + exp(-0.0025 * ((batch_id + 1) - 2500))), 6) AS kl_weight,
       round(((1 / (1 + exp(-0.0025 * ((batch_id + 1) - 2500)))) * kl + nll) / 2, 6) AS objective
FROM b""")
def batch_objective(spark, sf):
    """M9 + M10 per batch: annealed KL weight at step batch+1, objective."""
    p = batched_predictions(spark, sf)
    row_kl = mt.kl_unit_gaussian(F.slice("logits", 1, LATENT), F.slice("logits", LATENT + 1, LATENT))
    ce = F.when(F.col("gold") != 3, mt.cross_entropy("logits", "gold")).otherwise(F.lit(0.0))
    b = p.groupBy("batch_id").agg((F.sum(row_kl) / F.count(F.lit(1))).alias("kl"),
                                  F.sum(ce).alias("nll"))
    w = mt.anneal(F.col("batch_id") + 1, "logistic")
    return b.select("batch_id", r6("kl").alias("kl"), r6("nll").alias("nll"),
                    r6(w).alias("kl_weight"),
                    r6(mt.objective(F.col("kl"), F.col("nll"), w)).alias("objective"))


@query("macro_f1", f"""
WITH p AS {_PRED},
  q AS (SELECT {_ARGMAX} AS pred, gold FROM p),
  c AS (SELECT cls, sum(np) AS np, sum(ng) AS ng, sum(tp) AS tp FROM (
          SELECT pred AS cls, 1 AS np, 0 AS ng, 0 AS tp FROM q
          UNION ALL SELECT gold, 0, 1, 0 FROM q
          UNION ALL SELECT gold, 0, 0, 1 FROM q WHERE pred = gold) GROUP BY cls)
SELECT round(sum(2.0 * tp / (np + ng)) / {N_CLASSES}, 6) AS f1_macro,
       round(sum(tp) / sum(ng), 6) AS accuracy FROM c""")
def macro_f1(spark, sf):
    p = predictions(spark, sf).select(mt.argmax("logits").alias("pred"), "gold")
    m = mt.macro_f1(p, "pred", "gold", N_CLASSES)
    return m.select(r6("f1_macro").alias("f1_macro"), r6("accuracy").alias("accuracy"))


@query("argmax_onehot", f"""
WITH p AS {_PRED}
SELECT vec_id, CAST({_ARGMAX} AS BIGINT) AS pred,
       array_to_string(list_transform(range(10), lambda j: CAST(CAST(j = gold AS INT) AS VARCHAR)), ' ')
         AS gold_onehot
FROM p""")
def argmax_onehot(spark, sf):
    p = predictions(spark, sf)
    oh = mt.one_hot(F.col("gold"), 10)
    return p.select("vec_id", mt.argmax("logits").cast("bigint").alias("pred"),
                    F.array_join(F.transform(oh, lambda x: x.cast("string")), " ").alias("gold_onehot"))


@query("eval_loss", f"""
WITH {_BATCHED},
  b AS (SELECT batch_id, avg({_LSE} - e[gold + 1]) AS l FROM pb GROUP BY batch_id)
SELECT round(avg(l), 6) AS eval_loss, CAST(count(*) AS BIGINT) AS n_batches FROM b""")
def eval_loss(spark, sf):
    """Mean over batches of the batch-mean cross-entropy."""
    p = batched_predictions(spark, sf)
    b = p.groupBy("batch_id").agg(F.avg(mt.cross_entropy("logits", "gold")).alias("l"))
    return b.agg(r6(F.avg("l")).alias("eval_loss"), F.count(F.lit(1)).cast("bigint").alias("n_batches"))


# ------------------------------------------------------------------ histories
_HIST = """
  h AS (SELECT event_id, CAST(ts AS DATE) AS epoch, value AS loss,
               row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS step,
               row_number() OVER (ORDER BY CAST(ts AS DATE), ts, event_id) AS g1
        FROM events)"""


@query("anneal_schedule", f"""
WITH {_HIST}
SELECT event_id, CAST(g1 AS BIGINT) AS step,
       round(1 / (1 + exp(-0.0025 * (g1 - 2500))), 6) AS w_logistic,
       round(least(1.0, g1 / 2500.0), 6) AS w_linear FROM h""")
def anneal_schedule(spark, sf):
    """M9 over the global training step (1-based) of every history row."""
    h = history(spark, sf)
    s = F.col("g") + 1
    return h.select("event_id", s.cast("bigint").alias("step"),
                    r6(mt.anneal(s, "logistic")).alias("w_logistic"),
                    r6(mt.anneal(s, "linear")).alias("w_linear"))


@query("epoch_totals", """
SELECT CAST(ts AS DATE) AS epoch, CAST(count(*) AS BIGINT) AS n_batches,
       round(sum(value), 6) AS loss_sum, round(avg(value), 6) AS loss_mean
FROM events GROUP BY 1""")
def epoch_totals(spark, sf):
    ev = table(spark, sf, "events").select(F.to_date("ts").alias("epoch"), F.col("value").alias("loss"))
    t = mt.epoch_totals(ev, "epoch", "loss")
    return t.select("epoch", F.col("n_batches").cast("bigint"), r6("loss_sum").alias("loss_sum"),
                    r6("loss_mean").alias("loss_mean"))


@query("every_nth_epoch", """
WITH t AS (SELECT CAST(ts AS DATE) AS epoch, count(*) AS n, sum(value) AS s FROM events GROUP BY 1),
  i AS (SELECT *, row_number() OVER (ORDER BY epoch) - 1 AS epoch_idx FROM t)
SELECT epoch, CAST(epoch_idx AS BIGINT) AS epoch_idx, round(s / (n + 1), 6) AS loss_per_word_train
FROM i WHERE (epoch_idx + 1) % 3 = 0""")
def every_nth_epoch(spark, sf):
    """M11 + M12: per-epoch totals, kept every 3rd epoch (training
    denominator n + 1)."""
    ev = table(spark, sf, "events").select(F.to_date("ts").alias("epoch"), F.col("value").alias("loss"))
    t = ev.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("s"))
    t = with_row_index(t, ["epoch"], col="epoch_idx")
    kept = mt.every_nth_epoch(t, "epoch_idx", 3)
    return kept.select("epoch", F.col("epoch_idx").cast("bigint"),
                       r6(F.col("s") / (F.col("n") + 1)).alias("loss_per_word_train"))


@query("running_loss", f"""
WITH {_HIST},
  r AS (SELECT epoch, step, sum(loss) OVER (PARTITION BY epoch ORDER BY step
                                            ROWS UNBOUNDED PRECEDING) / (step + 1) AS rl FROM h)
SELECT epoch, CAST(step AS BIGINT) AS step, round(rl, 6) AS running_loss FROM r
WHERE (step + 2) % 10 = 0""")
def running_loss(spark, sf):
    """Running mean loss inside each epoch, reported every 10 steps."""
    h = history(spark, sf)
    rep = mt.running_mean_reports(h, "epoch", "step", "loss", 10)
    return rep.select("epoch", F.col("step").cast("bigint"), r6("running_loss").alias("running_loss"))


@query("best_epoch", """
WITH t AS (SELECT CAST(ts AS DATE) AS epoch, avg(value) AS metric FROM events GROUP BY 1)
SELECT epoch, round(metric, 6) AS metric,
       metric = max(metric) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS is_best FROM t""")
def best_epoch(spark, sf):
    """M17 on the per-epoch table (one row per epoch)."""
    ev = table(spark, sf, "events").select(F.to_date("ts").alias("epoch"), "value")
    t = ev.groupBy("epoch").agg(F.avg("value").alias("metric"))
    b = mt.best_so_far(t, "epoch", "metric")
    return b.select("epoch", r6("metric").alias("metric"), "is_best")
