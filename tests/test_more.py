import os
import re

from pyspark.sql import functions as F

from tessera.operators import augment as au
from tessera.operators import vocab as vc
from tessera.session import scratch_dir
from tessera.sources import corpus as src


def test_resample_order_and_draws(spark):
    df = spark.createDataFrame([(i, f"s{i}", float(i % 2)) for i in range(5)],
                               "k long, sentence string, target double")
    out = au.resample(df, ["k"], 12, cols=["sentence", "target"]).orderBy("aug_id").collect()
    assert [r.sentence for r in out[:5]] == [f"s{i}" for i in range(5)]
    assert len(out) == 12 and all(r.sentence in {f"s{i}" for i in range(5)} for r in out[5:])


def test_contextual_insert(spark):
    corpus = spark.createDataFrame([(0, "a x b"), (1, "a x b"), (2, "a y b")], "k long, text string")
    model = au.gap_model(corpus, "text")
    got = {(r.prev, r.next): r.mid for r in model.collect()}
    assert got == {("a", "b"): "x"}
    df = spark.createDataFrame([(7, "a b c")], "k long, text string")
    r = au.contextual_insert(df, "k", "text", model).first()
    assert r.sentence == "a x b c"


def test_synonym_replace(spark):
    corpus = spark.createDataFrame([(0, "Été ete été x")], "k long, text string")
    groups = au.variant_groups(corpus, "text")
    df = spark.createDataFrame([(1, "été y")], "k long, text string")
    r = au.synonym_replace(df, "k", "text", groups).first()
    assert r.sentence.split()[1] == "y" and r.sentence.split()[0] in {"Été", "ete"}


def test_generate_grid_and_absorbing_end(spark):
    df = spark.createDataFrame([(0, "a b", 0), (1, "c d", 1)], "k long, text string, cls int")
    m = au.bigram_model(df, "text", "cls")
    gen = au.generated_sentences(au.generate(m, 2, 3, 8)).collect()
    assert len(gen) == 6
    assert {r.sentence for r in gen if r.target == 0} == {"a b"}
    assert {r.sentence for r in gen if r.target == 1} == {"c d"}


def test_generate_walk_equals_joins(spark):
    """A model held by tasks and one beyond that bound draw the same words."""
    rows = [(k, " ".join(f"w{(k * 7 + j * j) % 23}" for j in range(k % 9)), k % 2) for k in range(40)]
    m = au.bigram_model(spark.createDataFrame(rows, "k long, text string, cls int"), "text", "cls")
    walked = sorted(map(tuple, au.generated_sentences(au.generate(m, 3, 8, 6)).collect()))
    joined = sorted(map(tuple, au.generated_sentences(au.generate(m, 3, 8, 6, max_rows=0)).collect()))
    assert walked == joined and len(walked) == 24 and {s for t, _, s in walked if t == 2} == {""}


def test_csv_and_vocab_roundtrip(spark):
    df = spark.createDataFrame([(0, 'he said "hi",\nthen left ', 1.0)], "doc_id long, sentence string, target double")
    path = scratch_dir(spark, "t-csv")
    src.write_csv(df.select("sentence", "target"), path)
    back = src.read_labelled_csv(spark, path, schema="sentence string, target double").first()
    assert back.sentence == 'he said "hi",\nthen left ' and back.target == 1.0
    v = vc.fit_vocab(df.withColumnRenamed("sentence", "text"), "text", ["doc_id"], kind="ngram", n=4)
    p2 = scratch_dir(spark, "t-vocab")
    src.save_vocab(v, p2)
    v2 = src.load_vocab(spark, p2)
    assert (v2.kind, v2.n, v2.size) == ("ngram", 4, v.size)


def test_pick_columns(spark):
    df = spark.createDataFrame([("x", 1)], "a string, b int")
    assert src.pick_columns(df).first() == ("x", 1.0)


def test_entry_smoke(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    assert df.count() > 0 and df.columns == ["doc_id", "target", "ids"]
    assert set(se.oracle_sql()) <= set(se.queries())


def test_streaming_encode(spark):
    from tessera.streaming.encode import clean_stream, encode_batches
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    v = vc.fit_vocab(docs, "text", ["doc_id"])
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet") \
        .parquet("/root/testdata/sf0.001/")
    out = scratch_dir(spark, "t-stream")
    q = encode_batches(clean_stream(stream, "text", "none"), v, out, scratch_dir(spark, "t-ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == docs.count()


def test_read_corpus_dispatch_and_benchmark_sink(spark):
    df = spark.createDataFrame([(i, f"t {i}", i % 2) for i in range(20)],
                               "doc_id long, text string, label int")
    split = src.keyed_split(df, "doc_id", {"train": 0.5, "test": 0.5})
    norm = src.normalize_benchmark(split, "ag_news", keep=["split"])
    out = scratch_dir(spark, "t-bench")
    src.write_benchmark(norm, "ag_news", out)
    train = spark.read.options(**src.CSV_OPTIONS).csv(f"{out}/ag_news/split=train")
    test = spark.read.options(**src.CSV_OPTIONS).csv(f"{out}/ag_news/split=test")
    assert train.columns == ["sentence", "target"] and train.count() + test.count() == 20
    lines = scratch_dir(spark, "t-lines")
    src.write_lines(df, "text", lines)
    got = src.read_corpus(spark, lines)
    assert set(got.columns) >= {"file", "block", "line_id", "text"} and got.count() == 20
    pq = scratch_dir(spark, "t-pq") + ".parquet"
    df.write.parquet(pq)
    assert src.read_corpus(spark, pq).count() == 20


def test_unconditional_generation_length(spark):
    from tessera.operators import augment as au
    from tessera.operators import vocab as vc
    docs = spark.createDataFrame([(k, "a b c a b c a b c a b c a b c") for k in range(4)], "doc_id long, text string")
    v = vc.fit_vocab(docs)
    gen = au.generate(au.bigram_model(docs, "text", None), 1, 5, 10, first_words=v.table, first_words_size=v.size)
    assert {len(r.tokens) for r in gen.collect()} == {10}


def test_vocabulary_from_json(spark, tmp_path):
    from tessera.operators import vocab as vc
    from tessera.sources.corpus import read_json_vocab, save_vocab
    docs = spark.createDataFrame([(1, "b a b"), (2, "c a")], "doc_id long, text string")
    v = vc.fit_vocab(docs)
    save_vocab(v, str(tmp_path / "v"))
    want = {(r.token, r.id) for r in v.table.collect()}
    assert {(r.token, r.id) for r in read_json_vocab(spark, str(tmp_path / "v" / "vocab.json")).table.collect()} == want
    (tmp_path / "one.json").write_text('{"[UNK]": 0, "b": 5, "token": 6}')
    got = read_json_vocab(spark, str(tmp_path / "one.json"))
    assert {(r.token, r.id) for r in got.table.collect()} == {("[UNK]", 0), ("b", 5), ("token", 6)} and got.size == 3


def test_encode_needs_no_shuffle_after_the_explode(spark):
    from tessera.operators import vocab as vc
    docs = spark.createDataFrame([(k, f"a b c {k}") for k in range(20)], "doc_id long, text string")
    plan = vc.encode(docs, vc.fit_vocab(docs), max_len=8)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate")]
    assert "Exchange hashpartitioning" not in above


def test_generate_steps_leave_the_model_where_it_is(spark, monkeypatch):
    """Beyond the arrays' bound the model is dealt once: a step's join shuffles
    the requests alone, and no block of places has more than BLOCK rows."""
    rows = [(k, " ".join(f"w{(k * 7 + j * j) % 23}" for j in range(k % 9)), 0) for k in range(60)]
    m = au.bigram_model(spark.createDataFrame(rows, "k long, text string, cls int"), "text", "cls")
    guide, words = au.guide_table(m, 1)
    assert guide.groupBy("block").count().agg({"count": "max"}).first()[0] <= au.BLOCK
    assert {t for _, t in guide.dtypes} == {"bigint"}
    plans, cut = [], au.cut_lineage
    monkeypatch.setattr(au, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = au.generate(m, 1, 5, 9, max_rows=0).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    steps = [p for p in plans if "InMemoryTableScan" in p and "drawn" in p]
    assert steps and len(got) == 5 and {len(r.tokens) for r in got} == {8}
    for p in steps:  # the requests are dealt for each step's join, the guide is not
        assert "ENSURE_REQUIREMENTS" in p and not re.search(r"hashpartitioning\(b#\d+L?, \d+\), ENSURE", p)


def _augment_rows(spark):
    words = "a b A c b a C d e E a".split()
    rows = [(k, " ".join(words[(k * 7 + j * j) % len(words)] for j in range(k % 23)), float(k % 2)) for k in range(60)]
    return rows, spark.createDataFrame(rows + [rows[3], (None, "a c b", 0.0), (90, None, 0.0)], "k long, text string, target double")


def test_insertion_leaves_texts_whole(spark):
    """Texts are not regrouped from their words; pairs travel as numbers once."""
    rows, df = _augment_rows(spark)
    model = au.gap_model(df, "text", names=False)
    assert model._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    once = spark.createDataFrame(rows, "k long, text string, target double")
    out = au.contextual_insert(once, "k", "text", model, carry=["target"])
    assert "slot" not in out._jdf.queryExecution().optimizedPlan().toString()
    names = au.gap_model(df, "text")
    regrouped = au._insert_repeated(df, "k", "text", names, ["target"], 0, 0, au.AUG_P, au.AUG_MIN, au.AUG_MAX, "sentence")
    got = au.contextual_insert(df, "k", "text", model, carry=["target"])
    assert sorted(map(str, got.collect())) == sorted(map(str, regrouped.collect()))
    assert set(map(str, out.where("k <> 3").collect())) <= set(map(str, got.collect()))


def test_synonym_replacement_leaves_texts_whole(spark):
    rows, df = _augment_rows(spark)
    groups = au.variant_groups(df, "text")
    once = spark.createDataFrame(rows, "k long, text string, target double")
    out = au.synonym_replace(once, "k", "text", groups, carry=["target"])
    assert "slot" not in out._jdf.queryExecution().optimizedPlan().toString()
    regrouped = au._synonym_replace_repeated(df, "k", "text", groups, au.fold_key, ["target"], 0, 0,
                                             au.AUG_P, au.AUG_MIN, au.AUG_MAX, "sentence")
    got = au.synonym_replace(df, "k", "text", groups, carry=["target"])
    assert sorted(map(str, got.collect())) == sorted(map(str, regrouped.collect()))
    assert set(map(str, out.where("k <> 3").collect())) <= set(map(str, got.collect()))
