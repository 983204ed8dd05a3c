"""Source / sink round trips (S1-S11) over the driver tables; written to a
scratch folder under the shared checkpoint folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.keyed import sql_u32
from tessera.operators import vocab as vc
from tessera.plans import sqlparts as q
from tessera.plans.corpus_queries import labelled_docs
from tessera.plans.registry import query, table
from tessera.session import scratch_dir
from tessera.sources import corpus as src


@query("csv_roundtrip", """
SELECT text AS sentence, CAST(quality AS DOUBLE) AS target FROM documents JOIN labels USING (doc_id)""")
def csv_roundtrip(spark, sf):
    """S1 + S6: labelled rows through a headed, quoted, multi-line CSV."""
    path = scratch_dir(spark, "csv")
    lab = labelled_docs(spark, sf).select(F.col("text").alias("sentence"), "target")
    src.write_csv(lab, path)
    return src.read_labelled_csv(spark, path, schema="sentence string, target double")


@query("named_csv_roundtrip", """
SELECT text AS sentence, CAST(CAST(quality AS DOUBLE) AS VARCHAR) AS target
FROM documents JOIN labels USING (doc_id)""")
def named_csv_roundtrip(spark, sf):
    """The same file read with forced names, header skipped."""
    path = scratch_dir(spark, "csv-named")
    lab = labelled_docs(spark, sf).select(F.col("text").alias("s"), F.col("target").alias("t"))
    src.write_csv(lab, path)
    return src.read_named_csv(spark, path)


@query("text_corpus_roundtrip", r"""
SELECT regexp_replace(text, '[\r\n]+', ' ', 'g') AS text FROM conversations""")
def text_corpus_roundtrip(spark, sf):
    """S7 + S3 + S4: one line per turn, read back as an ordered line corpus."""
    path = scratch_dir(spark, "lines")
    src.write_lines(table(spark, sf, "conversations"), "text", path)
    return src.read_corpus(spark, path).select("text")


@query("vocab_roundtrip", f"""
WITH dw AS (SELECT doc_id, {q.words('text')} AS w FROM documents),
  dt AS (SELECT doc_id AS ord1, generate_subscripts(w, 1) AS ord2, unnest(w) AS token FROM dw)
{q.first_occurrence_vocab('dt')}""")
def vocab_roundtrip(spark, sf):
    """S8 + S9 + S10: fitted vocabulary saved and loaded with its params."""
    v = vc.fit_vocab(table(spark, sf, "documents"), "text", ["doc_id"])
    path = scratch_dir(spark, "vocab")
    src.save_vocab(v, path)
    back = src.load_vocab(spark, path)
    assert back.size == v.size and back.kind == v.kind and back.n == v.n
    return back.table.select("token", F.col("id").cast("bigint").alias("id"))


@query("benchmark_normalize", f"""
SELECT text AS sentence, CAST(quality AS INT) AS "label-coarse", CAST(toxic AS INT) AS "label-fine",
       CASE WHEN {sql_u32(0, 0, 'split', 'doc_id', '0')} / 4294967296.0 < 0.8 THEN 'train' ELSE 'test' END
         AS split
FROM documents JOIN labels USING (doc_id)""")
def benchmark_normalize(spark, sf):
    """S5 (two-label config): labelled documents as a coarse/fine set with
    a keyed 80/20 train/test split."""
    lab = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id") \
        .select("doc_id", "text", F.col("quality").alias("label-coarse"),
                F.col("toxic").alias("label-fine"))
    split = src.keyed_split(lab, "doc_id", {"train": 0.8, "test": 0.2})
    return src.normalize_benchmark(split, "trec", keep=["split"])
