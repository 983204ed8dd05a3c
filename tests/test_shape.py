import pytest
from pyspark.sql import functions as F

from tessera.operators import shape as sh

A = list(range(10, 20))  # ids a..j


def _corpus(spark, ids, split=3):
    rows = [(k, ids[i:i + split]) for k, i in enumerate(range(0, len(ids), split))]
    return spark.createDataFrame(rows, "r long, body array<int>")


def _segs(spark, ids, M, mode):
    out = sh.segments(_corpus(spark, ids), "body", ["r"], M, mode).collect()
    return [r.segment for r in sorted(out, key=lambda r: r.segment_id)]


def test_segments_literal(spark):
    got = _segs(spark, [99] + A + [98], 5, "literal")
    assert got == [[1, 10, 11, 12, 13, 2], [1, 13, 14, 15, 16, 17, 18, 2]]


def test_segments_strict(spark):
    got = _segs(spark, A, 5, "strict")
    assert got == [[1, 10, 11, 12, 13, 2], [1, 13, 14, 15, 16, 2], [1, 16, 17, 18, 19, 2]]


def test_segments_strict_short(spark):
    assert _segs(spark, [10, 11], 5, "strict") == [[1, 10, 11, 2, 3, 3]]


def test_segments_literal_too_short(spark):
    with pytest.raises(ValueError):
        _segs(spark, A[:7], 5, "literal")


@pytest.mark.parametrize("length, rows", [
    # worked by hand for M = 5 over ids 101, 102, ... (the first and last id are trimmed)
    (10, [[1, 101, 102, 103, 104, 2], [1, 104, 105, 106, 107, 2]]),
    (12, [[1, 101, 102, 103, 104, 2], [1, 104, 105, 106, 107, 108, 109, 2]]),
    (13, [[1, 101, 102, 103, 104, 2], [1, 104, 105, 106, 107, 2], [1, 107, 108, 109, 110, 2]]),
])
def test_segments_literal_golden(spark, length, rows):
    assert _segs(spark, list(range(100, 100 + length)), 5, "literal") == rows


def test_segments_strict_properties(spark):
    """Every id is covered in order, neighbours share exactly one id, all
    rows are as long as M + 1."""
    for length in (5, 8, 13, 21):
        ids = list(range(100, 100 + length))
        got = _segs(spark, ids, 5, "strict")
        bodies = [[x for x in row if x > 3] for row in got]
        assert all(len(row) == 6 and row[0] == 1 and 2 in row for row in got)
        assert all(a[-1] == b[0] for a, b in zip(bodies, bodies[1:]))
        assert bodies[0] + [x for b in bodies[1:] for x in b[1:]] == ids


def test_segments_null_and_tied_order(spark):
    """Rows whose order is null or tied are laid in the stream once, too."""
    parts = {None: [[10, 11, 12]], 1: [[13, 14], [15, 16, 17]], 2: [[18], [19, 20]]}
    rows = [(r, body) for r, bodies in parts.items() for body in bodies]
    corpus = spark.createDataFrame(rows, "r long, body array<int>")
    streams = [[10, 11, 12] + a + b for a in ([13, 14, 15, 16, 17], [15, 16, 17, 13, 14])
               for b in ([18, 19, 20], [19, 20, 18])]
    for mode in ("strict", "literal"):
        out = sorted(sh.segments(corpus, "body", ["r"], 5, mode).collect(), key=lambda r: r.segment_id)
        assert [r.segment for r in out] in [_segs(spark, s, 5, mode) for s in streams]


def test_shift(spark):
    df = spark.createDataFrame([([1, 5, 6, 2, 3],)], "a array<int>")
    i, g = sh.shift("a")
    r = df.select(i.alias("i"), g.alias("g")).first()
    assert r.i == [1, 5, 6, 2] and r.g == [5, 6, 2, 3]


def test_batches_sequential(spark):
    df = spark.range(70).withColumnRenamed("id", "row_id")
    out = sh.batches(df, "row_id", 32, shuffle=False).collect()
    assert sorted((r.row_id, r.position, r.batch_id) for r in out) == \
        [(i, i, i // 32) for i in range(70)]


def test_batches_shuffled_is_permutation(spark):
    df = spark.range(70).withColumnRenamed("id", "row_id")
    out = sh.batches(df, "row_id", 32, shuffle=True).collect()
    assert sorted(r.position for r in out) == list(range(70))
    assert [r.row_id for r in sorted(out, key=lambda r: r.position)] != list(range(70))


def test_permutation_is_a_bijection(spark):
    """Every size from 1 to 400 and some larger ones, by epoch; null stays null."""
    from tessera.functions.keyed import half_bits, permuted
    sizes = [*range(1, 40), 63, 64, 65, 256, 257, 1000, 1024, 1025, 2000]
    top = max(sizes)
    df = spark.range(top).coalesce(1).select("id", *[permuted(F.when(F.col("id") < n, F.col("id")), n, 3, e, "order").alias(f"p{n}_{e}")
                                                     for n in sizes for e in (0, 1)])
    rows = df.collect()
    for n in sizes:
        for e in (0, 1):
            got = [r[f"p{n}_{e}"] for r in rows]
            assert sorted(got[:n]) == list(range(n)) and got[n:] == [None] * (top - n)
    assert [r["p1000_0"] for r in rows[:1000]] != [r["p1000_1"] for r in rows[:1000]]
    assert [half_bits(n) for n in (1, 4, 5, 16, 17, 4 ** 20)] == [1, 1, 2, 2, 3, 20]


def test_shuffled_batches_plan(spark):
    """Rows are sorted by their id once, by no drawn key."""
    from tessera.operators import shape as sh
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    out = sh.batches(df, "doc_id", 32, shuffle=True, epoch=2)
    rows = out.collect()
    assert sorted(r.position for r in rows) == list(range(500)) and all(r.batch_id == r.position // 32 for r in rows)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.position for r in sorted(rows, key=lambda r: r.doc_id)] != list(range(500))
    assert sh.batches(df.limit(0), "doc_id", shuffle=True).count() == 0
