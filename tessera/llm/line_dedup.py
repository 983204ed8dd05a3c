"""Line dedup: drop lines that several documents hold, but in one of them.

Lines are exploded as (128-bit key hash, document id), the hashes are counted
by distinct document with partial aggregation before the shuffle, and the
hashes over the threshold are joined back to find each document's dropped
hashes; the text itself moves once, to meet that list.

Cases: null or empty text is one empty line, which is too short to be
dropped; rows of one id are one document (they drop and keep the same
lines); a row without an id takes no part: it is not counted and keeps its
lines; an empty table gives an empty table; other columns are kept, and one
with the name of an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, SPACES, UPPER, bind, checkpointed, fresh


def _line_hashes(text: Column, min_length: int) -> Column:
    """For each line its key's hash (two 64-bit halves), or null if the key
    is too short. Lower-casing comes first, over the whole text at once."""
    def of(line: Column) -> Column:
        key = F.trim(line, F.lit(SPACES))
        return F.when(F.length(key) >= min_length,
                      F.struct(F.xxhash64(key).alias("h1"),
                               F.xxhash64(F.lit(1), key).alias("h2")))

    return F.transform(F.split(F.translate(text, UPPER, LOWER), "\n", -1), of)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_length: int = 10, min_docs: int = 2, out: str = "text") -> DataFrame:
    """``docs`` with ``out`` (the lines that stay, joined by newlines),
    ``n_lines`` and ``n_dropped``. A key of at least ``min_length`` code
    points in at least ``min_docs`` documents stays in the smallest id."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ident = F.col(f"`{id_col}`")
    lines = (docs.where(ident.isNotNull())
             .select(ident.alias("d"),
                     F.explode(F.array_distinct(F.array_compact(_line_hashes(text, min_length)))).alias("h"))
             .select("d", "h.h1", "h.h2"))
    keeper = [F.min("d").alias("keeper")]
    if min_docs <= 2:  # two documents hold it iff its smallest and largest id differ
        shared = (lines.groupBy("h1", "h2").agg(*keeper, F.max("d").alias("top"))
                  .where(F.col("keeper") != F.col("top") if min_docs == 2 else F.lit(True)))
    else:
        shared = (lines.distinct().groupBy("h1", "h2").agg(*keeper, F.count("*").alias("n"))
                  .where(F.col("n") >= min_docs))
    # cut off, so that the join's own exchanges can split a line that very many documents hold
    shared = checkpointed(shared.select("h1", "h2", "keeper"))
    dropped = (lines.join(shared, ["h1", "h2"])
               .where(F.col("d") != F.col("keeper"))
               .groupBy("d").agg(F.collect_set(F.struct("h1", "h2")).alias("gone")))
    gone, mark = fresh(docs, "gone"), fresh(docs, "mark")
    joined = docs.join(dropped.select(F.col("d").alias(mark), F.col("gone").alias(gone)),
                       ident == F.col(mark), "left").drop(mark)

    def stays(pair: Column, gone_set: Column) -> Column:
        return ~F.coalesce(F.array_contains(gone_set, pair["h"]), F.lit(False))

    def split_kept(b: Column) -> Column:
        pairs = F.arrays_zip(F.split(b["t"], "\n", -1).alias("line"),
                             _line_hashes(b["t"], min_length).alias("h"))
        return F.transform(F.filter(pairs, lambda p: F.when(p["h"].isNull(), True).otherwise(stays(p, b["g"]))),
                           lambda p: p["line"])

    n = F.size(F.split(text, "\n", -1)).cast("long")
    kept = F.when(F.col(gone).isNull(), F.split(text, "\n", -1)).otherwise(
        bind(F.struct(text.alias("t"), F.col(gone).alias("g")), split_kept))
    k = fresh(docs, "kept")
    return (joined.withColumn("n_lines", n).withColumn(k, kept)
            .withColumn("n_dropped", F.col("n_lines") - F.size(k))
            .withColumn(out, F.concat_ws("\n", k)).drop(k, gone))
