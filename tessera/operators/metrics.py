"""Token, class and run-history metrics as Spark aggregations.

Predictions are ``logits ARRAY<DOUBLE>`` + ``gold INT`` per position; a
position whose gold equals the pad id is ignored (P10). Run histories are
``(epoch, step, loss)`` rows. Everything is a column expression or a
partially-aggregated ``groupBy``; lambdas touch only their own variables.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.constants import PAD

# Annealing defaults (k, x0) and the smoothing weight.
ANNEAL_K = 0.0025
ANNEAL_X0 = 2500
SMOOTHING_EPS = 0.1


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------ row level
def argmax(logits) -> Column:
    """Index of the first maximum."""
    a = _c(logits)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def one_hot(idx, n_classes: int) -> Column:
    """One-hot vector of an id."""
    i = _c(idx)
    z = F.arrays_zip(F.sequence(F.lit(0), F.lit(n_classes - 1)).alias("j"),
                     F.array_repeat(i, n_classes).alias("i"))
    return F.transform(z, lambda s: (s["j"] == s["i"]).cast("int"))


def logsumexp(logits) -> Column:
    """Max-shifted log-sum-exp of an array."""
    a = _c(logits)
    m = F.array_max(a)
    z = F.arrays_zip(a.alias("x"), F.array_repeat(m, F.size(a)).alias("m"))
    return m + F.log(F.aggregate(z, F.lit(0.0), lambda acc, s: acc + F.exp(s["x"] - s["m"])))


def cross_entropy(logits, gold) -> Column:
    """M4 per position: -log softmax(logits)[gold]."""
    a = _c(logits)
    return logsumexp(a) - F.element_at(a, _c(gold) + 1)


def smoothed_cross_entropy(logits, gold, eps: float = SMOOTHING_EPS) -> Column:
    """M5 per position: gold weight 1-eps, every other class eps/(K-1)."""
    a = _c(logits)
    k = F.size(a)
    lse = logsumexp(a)
    lp_g = F.element_at(a, _c(gold) + 1) - lse
    sum_lp = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) - k * lse
    return -((1 - eps) * lp_g + F.lit(eps) / (k - 1) * (sum_lp - lp_g))


def kl_unit_gaussian(mean, logvar) -> Column:
    """M8 per row: -0.5 * sum(1 + s - m^2 - exp(s))."""
    z = F.arrays_zip(_c(mean).alias("m"), _c(logvar).alias("s"))
    return F.lit(-0.5) * F.aggregate(
        z, F.lit(0.0), lambda acc, t: acc + 1 + t["s"] - t["m"] * t["m"] - F.exp(t["s"]))


def anneal(step, kind: str = "logistic", k: float = ANNEAL_K, x0: float = ANNEAL_X0) -> Column:
    """M9: KL annealing weight."""
    s = _c(step).cast("double")
    if kind == "logistic":
        return 1 / (1 + F.exp(-F.lit(k) * (s - F.lit(x0))))
    if kind == "linear":
        return F.least(F.lit(1.0), s / F.lit(float(x0)))
    raise ValueError(f"unknown anneal function {kind!r}")


def objective(kl: Column, nll: Column, weight: Column | float = 1.0) -> Column:
    """(w * KL + NLL) / 2."""
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return (w * kl + nll) / 2


# ------------------------------------------------------------ aggregates
def token_metrics(df: DataFrame, logits: str, gold: str, group_cols: list[str] | None = None,
                  pad_id: int = PAD, smoothing: bool = False,
                  eps: float = SMOOTHING_EPS) -> DataFrame:
    """M3, M4/M5, M6, M7: per group (or overall) summed loss, words,
    correct, accuracy, loss per word (eval and training denominators) and
    perplexity, over non-pad positions."""
    group_cols = group_cols or []
    real = df.filter(F.col(gold) != pad_id)
    loss = (smoothed_cross_entropy(logits, gold, eps) if smoothing
            else cross_entropy(logits, gold))
    agg = real.groupBy(*group_cols).agg(
        F.sum(loss).alias("loss_sum"),
        F.count(F.lit(1)).alias("n_word"),
        F.sum((argmax(logits) == F.col(gold)).cast("long")).alias("n_correct"))
    return agg.select(
        *group_cols, "loss_sum", "n_word", "n_correct",
        (F.col("n_correct") / F.col("n_word")).alias("accuracy"),
        (F.col("loss_sum") / F.col("n_word")).alias("loss_per_word"),
        (F.col("loss_sum") / (F.col("n_word") + 1)).alias("loss_per_word_train"),
        F.exp(F.col("loss_sum") / F.col("n_word")).alias("perplexity"))


def batch_kl(df: DataFrame, mean: str, logvar: str, batch_col: str) -> DataFrame:
    """M8: KL summed over a batch divided by the batch size."""
    return df.groupBy(batch_col).agg(
        (F.sum(kl_unit_gaussian(mean, logvar)) / F.count(F.lit(1))).alias("kl"))


def macro_f1(df: DataFrame, pred: str, gold: str, n_classes: int) -> DataFrame:
    """Macro F1 over ``n_classes`` one-hot columns (a class never
    predicted nor present scores 0) and accuracy. Every row contributes a
    predicted-class and a gold-class count (and a hit when they agree) to
    one partially aggregated ``groupBy(class)``; no class x row expansion.
    Accuracy = sum(tp) / rows (one-hot rows are equal exactly when the
    argmax equals the gold)."""
    hit = (F.col(pred) == F.col(gold)).cast("long")
    parts = df.select(F.explode(F.array(
        F.struct(F.col(pred).alias("cls"), F.lit(1).cast("long").alias("np"),
                 F.lit(0).cast("long").alias("ng"), F.lit(0).cast("long").alias("tp")),
        F.struct(F.col(gold).alias("cls"), F.lit(0).cast("long").alias("np"),
                 F.lit(1).cast("long").alias("ng"), hit.alias("tp")))).alias("v"))
    per = parts.groupBy(F.col("v.cls").alias("cls")).agg(
        F.sum("v.np").alias("n_pred"), F.sum("v.ng").alias("n_gold"), F.sum("v.tp").alias("tp"))
    f1 = 2 * F.col("tp") / (F.col("n_pred") + F.col("n_gold"))
    return per.agg((F.sum(f1) / F.lit(n_classes)).alias("f1_macro"),
                   (F.sum("tp") / F.sum("n_gold")).alias("accuracy"))


# ------------------------------------------------------------ histories
def epoch_totals(hist: DataFrame, epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """Per epoch batch count, summed loss and mean loss."""
    return hist.groupBy(epoch).agg(F.count(F.lit(1)).alias("n_batches"),
                                   F.sum(loss).alias("loss_sum"),
                                   F.avg(loss).alias("loss_mean"))


def training_totals(hist: DataFrame, epoch: str = "epoch", nll: str = "nll", kl: str = "kl",
                    words: str = "words", correct: str = "correct") -> DataFrame:
    """Per epoch the totals of every reported figure and what is
    derived from them: NLL and KL, words, correct tokens, NLL per word and
    accuracy (null where an epoch has no words)."""
    t = hist.groupBy(epoch).agg(F.count(F.lit(1)).alias("n_batches"), *[
        F.sum(c).alias(f"{name}_sum") for name, c in (("nll", nll), ("kl", kl), ("words", words), ("correct", correct))])
    some = F.when(F.col("words_sum") > 0, F.col("words_sum"))
    return t.withColumn("nll_per_word", F.col("nll_sum") / some).withColumn("accuracy", F.col("correct_sum") / some)


def every_nth_epoch(epochs: DataFrame, epoch_idx: str, n: int) -> DataFrame:
    """Keep epochs with (epoch + 1) % n == 0."""
    return epochs.filter((F.col(epoch_idx) + 1) % n == 0)


def running_mean_reports(hist: DataFrame, epoch: str, step: str, loss: str,
                         every: int) -> DataFrame:
    """Mean loss so far inside an epoch, reported when
    ``(count + 1) % every == 0`` (count = step + 1). Reports fall exactly on
    block ends of ``every`` steps, so steps are first summed per block
    (map-side partial aggregation) and only the block table, ``every`` times
    smaller, is windowed."""
    cnt = F.col(step) + 1
    blocks = hist.groupBy(epoch, F.floor(cnt / every).alias("block")).agg(
        F.sum(loss).alias("s"), F.max(cnt).alias("c_max"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(epoch).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    run = blocks.select(epoch, "block", "c_max", F.sum("s").over(w).alias("run_sum"))
    rep = run.filter((F.col("c_max") + 1) % every == 0)
    return rep.select(epoch, (F.col("c_max") - 1).alias(step),
                      (F.col("run_sum") / F.col("c_max")).alias("running_loss"))


def best_so_far(per_epoch: DataFrame, epoch: str, metric: str) -> DataFrame:
    """An epoch is 'best' when its value equals the maximum so far
    (ties count). ``per_epoch`` has one row per epoch."""
    w = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    return per_epoch.withColumn("is_best", F.col(metric) == F.max(metric).over(w))
