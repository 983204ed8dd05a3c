from pyspark.sql import functions as F

from tessera.functions import noise as nz


def test_noise_count_half_even(spark):
    df = spark.createDataFrame([(10,), (30,)], "n int")
    got = [r.k for r in df.select(nz.noise_count(F.col("n"), 15).alias("k")).collect()]
    assert got == [2, 4]


def test_rotate_expr(spark):
    df = spark.createDataFrame([([5, 6, 7, 8],)], "a array<int>")
    assert df.select(nz.rotate_expr(F.col("a"), F.lit(1)).alias("r")).first().r == [6, 7, 8, 5]


def test_powerset_order(spark):
    got = {r.subset: r.kinds for r in nz.powerset_table(spark).collect()}
    assert got == {0: [], 1: ["mask"], 2: ["rotate"], 3: ["mask", "rotate"], 4: ["delete"],
                   5: ["mask", "delete"], 6: ["rotate", "delete"], 7: ["mask", "rotate", "delete"]}


def _rows(spark):
    rows = []
    for i in range(60):
        n = 3 + i % 40
        body = list(range(5, 5 + n))
        rows.append((i, [1] + body + [2] + [3] * 5))
    return spark.createDataFrame(rows, "row_id long, ids array<int>")


def test_noise_properties(spark):
    df = _rows(spark)
    for sub in range(8):
        out = nz.add_noise(df, "ids", "row_id", "nz", 15, 15, subset=sub).collect()
        for r in out:
            body = r.ids[1:r.ids.index(2)]
            n = len(body)
            assert len(r.nz) == len(r.ids) and r.nz[0] == 1
            got = r.nz[1:r.nz.index(2)]
            k_del = round(n * 15 / 100) if sub & 4 else 0
            assert len(got) == n - k_del
            if sub == 1:
                assert sum(1 for a, b in zip(body, got) if a != b) == round(n * 15 / 100)
            if sub == 2:
                j = body.index(got[0])
                assert got == body[j:] + body[:j]
            if sub == 4:
                it = iter(body)
                assert all(x in it for x in got)


def test_noise_independent_of_partitioning(spark):
    df = _rows(spark)
    base = {r.row_id: r.nz for r in nz.add_noise(df, "ids", "row_id", "nz").collect()}
    for p in (1, 7, 64):
        again = {r.row_id: r.nz for r in nz.add_noise(df.repartition(p), "ids", "row_id", "nz").collect()}
        assert again == base


def test_epoch_changes_noise(spark):
    df = _rows(spark)
    a = {r.row_id: r.nz for r in nz.add_noise(df, "ids", "row_id", "nz", epoch=0).collect()}
    b = {r.row_id: r.nz for r in nz.add_noise(df, "ids", "row_id", "nz", epoch=1).collect()}
    assert a != b
