"""The corpus pipeline: documents in, encoded documents out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written and read again as the next one's
``docs``. All but the last return the columns of documents.

Cases, in every stage: null text counts as empty; empty and very long texts
pass through like any other (a text without words is neither toxic nor a
copy of a passage; empty texts are near copies of each other); repeated rows
get the same verdict, and of near copies the rows with the smallest id stay;
rows without an id pass the filters that name rows by id; an empty table
gives an empty table. A stage hands on every given column as it was, also one
that is named like a column of its operator; only line dedup changes
``text``, and with it ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, simhash, toxicity
from tessera.llm.common import stored
from tessera.llm.label_queries import toxicity_model
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.text_queries import tokenizer

#: columns that operators work on; all others travel in one struct
WORKED_ON, REST = ("doc_id", "text", "lang"), "_given"


def _packed(docs: DataFrame) -> DataFrame:
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in WORKED_ON]
    return docs.select(*[F.col(c) for c in WORKED_ON if c in map(str.lower, docs.columns)],
                       (F.struct(*rest) if rest else F.lit(0)).alias(REST))


def _unpacked(out: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of ``docs`` in their order."""
    return out.select(*[new[c].alias(c) if c in new else F.col(c).alias(c) if c.lower() in WORKED_ON
                        else F.col(REST)[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    judged = toxicity.score(_packed(docs), toxicity_model(spark, sf_dir, docs), threshold=0.7)
    return _unpacked(judged.where("predicted = 0"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that other documents hold too stay in one of them. A document
    that loses all its lines stays, with what is left of its text."""
    out = dedup_lines(_packed(docs))
    return _unpacked(out, docs, **({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return _unpacked(simhash.keep_one(_packed(docs), shingle=4, max_bits=4), docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _unpacked(decontaminate.clean(_packed(docs), items, complete=True), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their digests; the text is not carried on."""
    bpe = tokenizer(spark)
    out = bpe.decode(bpe.encode(docs))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("encode", encode),
]

#: SQL has neither XXH64 nor the classifier nor the tokenizer; the stages are
#: tested one by one against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
