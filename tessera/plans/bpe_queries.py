"""Byte-pair queries (K11-K15) over ``documents``.

They learn up to the operator's default number of tokens (500,000: at small
sizes every word becomes one token before that). The queries of one session
share a model trained once per state of the input files (names, sizes and
times of change), so files that change are learned anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import bpe
from tessera.plans import sqlparts as q
from tessera.plans.corpus_queries import ids_string
from tessera.plans.registry import query, table
from tessera.session import scratch_dir
from tessera.sources import corpus as src

_MODELS: dict = {}


def _state(spark, df) -> tuple:
    """(name, size, time of change) of the files that ``df`` reads."""
    out, conf = [], spark.sparkContext._jsc.hadoopConfiguration()
    for name in sorted(df.inputFiles()):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def model(spark, sf: str, vocab_size: int = bpe.DEFAULT_VOCAB_SIZE) -> bpe.BpeModel:
    docs = table(spark, sf, "documents")
    key = (spark.sparkContext.applicationId, _state(spark, docs), vocab_size)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = bpe.train(docs, "text", vocab_size=vocab_size)
    return _MODELS[key]


@query("bpe_word_counts", f"""
SELECT word, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT unnest({q.split_tokens('text')}) AS word FROM documents) GROUP BY word""")
def bpe_word_counts(spark, sf):
    wc = bpe.word_counts(table(spark, sf, "documents"), "text")
    return wc.select("word", F.col("cnt").cast("bigint"))


@query("bpe_vocab")
def bpe_vocab(spark, sf):
    """Trained vocabulary (library-checked in tests)."""
    m = model(spark, sf)
    return m.vocab.select("token", F.col("id").cast("bigint").alias("id"))


@query("bpe_merges")
def bpe_merges(spark, sf):
    m = model(spark, sf)
    return m.merges.select(F.col("rank").cast("bigint"), F.col("left").cast("bigint"),
                           F.col("right").cast("bigint"), F.col("merged").cast("bigint"), "token")


@query("bpe_encode")
def bpe_encode(spark, sf):
    """Every document encoded, max_len 512 (cut ends in END, no pad)."""
    m = model(spark, sf)
    enc = bpe.encode(table(spark, sf, "documents"), m, "text", ["doc_id"], max_len=512)
    return enc.select("doc_id", ids_string(F.col("ids")).alias("ids"))


@query("bpe_decode")
def bpe_decode(spark, sf):
    """decode(encode(text)) without specials, tokens joined by one space."""
    m = model(spark, sf)
    enc = bpe.encode(table(spark, sf, "conversations").withColumnRenamed("text", "t")
                     .select(F.concat_ws(":", "conv_id", "turn").alias("k"), "t"),
                     m, "t", ["k"], max_len=None)
    return bpe.decode(enc, m, "ids", ["k"], skip_special=True)


@query("bpe_specials", """
SELECT conv_id, turn, 1 AS first_id, 2 AS last_id, 0 AS inner_marks FROM conversations""")
def bpe_specials(spark, sf):
    """After training the special tokens keep their fixed ids: every
    encoded turn begins with START, ends with END, and holds neither inside."""
    m = model(spark, sf)
    turns = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("k"), "text")
    enc = bpe.encode(turns, m, "text", ["k"], max_len=None)
    inner = F.filter(F.slice("ids", F.lit(2), F.size("ids") - 2), lambda x: x.isin(1, 2))
    key = F.split("k", ":")
    return enc.select(key[0].cast("bigint").alias("conv_id"), key[1].cast("bigint").alias("turn"),
                      F.get("ids", F.lit(0)).cast("int").alias("first_id"),
                      F.element_at("ids", -1).cast("int").alias("last_id"), F.size(inner).alias("inner_marks"))


@query("bpe_json")
def bpe_json(spark, sf):
    """The model through the library's one JSON file (byte-compared with
    the library's own file in tests)."""
    path = scratch_dir(spark, "bpe") + ".json"
    src.save_bpe_json(model(spark, sf), path)
    back = src.read_bpe_json(spark, path)
    return back.merges.select(F.col("rank").cast("bigint"), F.col("left").cast("bigint"),
                              F.col("right").cast("bigint"), F.col("merged").cast("bigint"), "token")
