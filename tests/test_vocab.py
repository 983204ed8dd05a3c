from pyspark.sql import functions as F

from tessera.operators import vocab as vc


def _vocab(spark, rows, kind="word", n=3):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    return df, vc.fit_vocab(df, "text", ["doc_id"], kind=kind, n=n)


def test_word_vocab_first_occurrence(spark):
    _, v = _vocab(spark, ["b a b", "c a [PAD]"])
    got = {r.token: r.id for r in v.table.collect()}
    assert got["b"] == 5 and got["a"] == 6 and got["c"] == 7 and got["[PAD]"] == 3
    assert v.size == 8


def _encode(spark, v, text, M):
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    return vc.encode(df, v, "text", ["doc_id"], max_len=M).first().ids


def test_word_encode_cases(spark):
    _, v = _vocab(spark, ["b a b", "c a [PAD]"])
    assert _encode(spark, v, "b a zz", 6) == [1, 5, 6, 0, 2, 3]
    assert _encode(spark, v, "b a c b", 6) == [1, 5, 6, 7, 2, 3]
    assert _encode(spark, v, "b a", None) == [1, 5, 6, 2]
    assert _encode(spark, v, "", 4) == [1, 2, 3, 3]
    assert _encode(spark, v, None, 4) == [1, 2, 3, 3]
    # M <= 3 never truncates
    assert _encode(spark, v, "b a c", 3) == [1, 5, 6, 7, 2]


def test_encode_lengths_around_limit(spark):
    _, v = _vocab(spark, ["w"])
    for M in (4, 5, 8):
        for W in range(max(0, M - 4), M + 3):
            ids = _encode(spark, v, " ".join(["w"] * W), M)
            kept = min(W, M - 3)
            assert ids == [1] + [5] * kept + [2] + [3] * max(0, M - 2 - kept)


def test_char_ngrams(spark):
    df = spark.createDataFrame([("cat",)], "w string")
    assert df.select(vc.char_ngrams(F.col("w"), 3).alias("g")).first().g == ["#ca", "cat", "at+"]


def test_ngram_decode_inverts(spark):
    words = "cat a of house b ab"
    for n in (2, 3, 4, 5):
        df, v = _vocab(spark, [words], kind="ngram", n=n)
        enc = vc.encode(df, v, "text", ["doc_id"], max_len=None)
        dec = vc.decode_ngrams(enc, "ids", v, ["doc_id"], remove_special=True).first().text
        expect = " ".join(w for w in words.split() if len(w) + 3 - n >= 1)
        assert dec == expect, (n, dec)


def test_word_decode_roundtrip(spark):
    df, v = _vocab(spark, ["x y z", "y q"])
    enc = vc.encode(df, v, "text", ["doc_id"], max_len=None)
    dec = vc.decode_words(enc, "ids", v, ["doc_id"], remove_special=True)
    assert {r.doc_id: r.tokens for r in dec.collect()} == {0: ["x", "y", "z"], 1: ["y", "q"]}


def test_vocab_plan_has_no_single_partition(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    v = vc.fit_vocab(df, "text", ["doc_id"])
    plan = v.table._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_repeated_keys_stay_rows(spark):
    """Rows with equal or null keys are not merged; null and empty texts stay."""
    _, v = _vocab(spark, ["a b c d e f"])
    df = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (1, "d e f"), (None, "f"), (2, None), (3, "")], "doc_id long, text string")
    want = [(0, ["f"]), (1, ["a", "b", "c"]), (1, ["d", "e", "f"]), (1, ["d", "e", "f"]), (2, []), (3, [])]
    for kind, n in (("word", 3), ("ngram", 2)):
        v = vc.fit_vocab(df, "text", ["doc_id"], kind=kind, n=n)
        enc = vc.encode(df, v, "text", ["doc_id"], max_len=None)
        if kind == "word":
            got = vc.decode_words(enc, "ids", v, ["doc_id"], remove_special=True)
            assert sorted((r.doc_id or 0, r.tokens) for r in got.collect()) == want
        else:
            got = vc.decode_ngrams(enc, "ids", v, ["doc_id"], remove_special=True)
            assert sorted((r.doc_id or 0, r.text.split()) for r in got.collect()) == want


def test_lookup_beyond_the_broadcast_limit(spark, monkeypatch):
    """Hot words are looked up by broadcast, so a word in every row fills no task; same rows either way."""
    rng = __import__("random").Random(3)
    rows = [(k % 40, " ".join(["hot"] * 30 + [f"w{rng.randrange(900)}" for _ in range(6)])) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    v = vc.fit_vocab(df, "text", ["doc_id", "text"])
    collect = lambda: sorted(map(repr, vc.encode(df, v, "text", ["doc_id"], max_len=20).collect()))
    want = collect()
    monkeypatch.setattr(vc, "BROADCAST_MAX_ROWS", 10)
    assert collect() == want
    enc = vc.encode(df, v, "text", ["doc_id"], max_len=None)
    assert sorted(" ".join(r.tokens) for r in vc.decode_words(enc, "ids", v, ["doc_id"], remove_special=True).collect()) == sorted(t for _, t in rows)
    ex = vc._exploded(df, vc.split_ws(F.col("text")), v, ["doc_id"], "token")
    plan = vc._matched(ex, "token", v)
    cold = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in cold and "hint=(strategy=broadcast)" in cold.replace("rightHint", "hint") or "broadcast" in cold
    # the shuffled side holds no hot word
    hot = ex.groupBy("token").count().where(F.col("count") * vc.HOT_SHARE > ex.count()).count()
    assert 1 <= hot <= vc.HOT_SHARE


def test_json_vocabulary_forms(spark, tmp_path):
    import json

    import pytest
    from tessera.sources import corpus as src
    want = {"a": 5, "token": 6, "id": 7, "b\n\"x": 8, "\u65e5": 9}
    forms = {"one": json.dumps(want), "indented": json.dumps(want, indent=4, ensure_ascii=False),
             "lines": "\n".join(json.dumps({"token": t, "id": i}) for t, i in want.items()) + "\n"}
    for name, text in forms.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
        v = src.read_json_vocab(spark, str(tmp_path / f"{name}.json"))
        assert {r.token: r.id for r in v.table.collect()} == want and v.size == 5
    for bad in ('["a", 5]', '{"a": "x"}', '{"token": "a"}\n{"token": "b"}', "plain words"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception):
            src.read_json_vocab(spark, str(tmp_path / "bad.json"))


def test_fit_keeps_places_by_a_hash_aggregate(spark, monkeypatch):
    """The first place of a token is one number, so no sort of all tokens;
    null and negative rows come in their order."""
    df = spark.createDataFrame([(3, "d a"), (-(2 ** 62), "b c"), (None, "a b"), (-1, "e c")], "doc_id long, text string")
    kept = []
    monkeypatch.setattr(vc, "with_row_index", lambda f, *a, **k: kept.append(f) or with_row_index(f, *a, **k))
    from tessera.operators.ids import with_row_index
    v = vc.fit_vocab(df, "text", ["doc_id"])
    assert "SortAggregate" not in kept[0]._jdf.queryExecution().executedPlan().toString()
    assert {r.token: r.id for r in v.table.where("id >= 5").collect()} == {"a": 5, "b": 6, "c": 7, "e": 8, "d": 9}


def test_lookup_does_not_explode(spark, monkeypatch):
    """Decoded rows stay where they are with a broadcast vocabulary; beyond it no
    position is shuffled, only a block's different values."""
    df, v = _vocab(spark, ["x y z x", "y q"])
    enc = vc.encode(df, v, "text", ["doc_id"], max_len=None)
    ids = spark.createDataFrame(enc.collect(), enc.schema)
    plan = vc.decode_words(ids, "ids", v, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "MapInArrow" in plan
    want = sorted((r.doc_id, r.ids) for r in enc.collect())
    monkeypatch.setattr(vc, "BROADCAST_MAX_ROWS", 1)
    monkeypatch.setattr(vc, "BLOCK_ROWS", 1)
    far = vc.encode(df, v, "text", ["doc_id"], max_len=None)
    assert "FlatMapCoGroupsInArrow" in far._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.ids) for r in far.collect()) == want
    import pytest
    odd = spark.createDataFrame([(1, [5, 99])], "doc_id long, ids array<long>")
    with pytest.raises(Exception, match="unknown id 99"):
        vc.decode_words(odd, "ids", v, ["doc_id"]).collect()


def test_vocabulary_object_is_read_by_lines(spark, tmp_path):
    """A file with one entry a line is read by lines, in as many tasks as it
    has splits; other forms, and tokens named twice, as a whole."""
    import json

    from tessera.sources import corpus as src
    df = spark.createDataFrame([(k, f'w{k} "q{k}\\ , {{ }}') for k in range(300)], "doc_id long, text string")
    v = vc.fit_vocab(df, "text", ["doc_id"])
    path = str(tmp_path / "object.json")
    src.save_vocab_object(v, path)
    want = {r.token: r.id for r in v.table.collect()}
    assert src._vocab_lines(spark, path) is not None
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        back = src.read_json_vocab(spark, path)
        assert back.table.rdd.getNumPartitions() > 3
        assert {r.token: r.id for r in back.table.collect()} == want and back.size == v.size
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "one.json").write_text(json.dumps(want))
    (tmp_path / "twice.json").write_text('{\n"a": 5,\n"a": 6\n}')
    (tmp_path / "comma.json").write_text('{\n"a": 5\n"b": 6\n}')
    assert all(src._vocab_lines(spark, str(tmp_path / f"{n}.json")) is None for n in ("one", "twice", "comma"))
    assert [tuple(r) for r in src.read_json_vocab(spark, str(tmp_path / "twice.json")).table.collect()] == [("a", 6)]
