import math

from pyspark.sql import functions as F

from tessera.operators import metrics as mt


def test_argmax_tie(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7],)], "a array<double>")
    assert df.select(mt.argmax("a").alias("m")).first().m == 1


def test_anneal_column(spark):
    df = spark.createDataFrame([(2500,), (500,), (5000,)], "s int")
    got = df.select(mt.anneal("s", "logistic").alias("l"), mt.anneal("s", "linear").alias("n")).collect()
    assert got[0].l == 0.5 and abs(got[1].n - 0.2) < 1e-12 and got[2].n == 1


def test_macro_f1(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "pred int, gold int")
    r = mt.macro_f1(df, "pred", "gold", 3).first()
    assert abs(r.f1_macro - (2 / 3 + 2 / 3 + 0) / 3) < 1e-12
    assert abs(r.accuracy - 2 / 3) < 1e-12


def test_best_so_far(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.6), (3, 0.7)], "epoch int, m double")
    got = [r.is_best for r in mt.best_so_far(df, "epoch", "m").orderBy("epoch").collect()]
    assert got == [True, True, False, True]


def test_cross_entropy_and_smoothing(spark):
    logits = [1.0, 2.0, 0.5]
    df = spark.createDataFrame([(logits, 1)], "a array<double>, g int")
    r = df.select(mt.cross_entropy("a", "g").alias("ce"),
                  mt.smoothed_cross_entropy("a", "g", 0.1).alias("sm")).first()
    lse = math.log(sum(math.exp(x) for x in logits))
    lp = [x - lse for x in logits]
    assert abs(r.ce + lp[1]) < 1e-12
    assert abs(r.sm + (0.9 * lp[1] + 0.05 * (lp[0] + lp[2]))) < 1e-12


def test_running_mean_reports(spark):
    rows = [(0, s, float(s)) for s in range(25)]
    df = spark.createDataFrame(rows, "epoch int, step long, loss double")
    got = [(r.step, r.running_loss) for r in
           mt.running_mean_reports(df, "epoch", "step", "loss", 10).orderBy("step").collect()]
    # reported when (count + 1) % 10 == 0, count = step + 1
    exp = [(s, sum(range(s + 1)) / (s + 1)) for s in range(25) if (s + 2) % 10 == 0]
    assert got == exp


def test_one_hot(spark):
    df = spark.createDataFrame([(2,)], "i int")
    assert df.select(mt.one_hot(F.col("i"), 4).alias("o")).first().o == [0, 0, 1, 0]
