"""Queries of the operators on single texts and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm.byte_bpe import ByteBpe
from tessera.llm.common import table
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.registry import query


@query("op3_line_dedup", sql=r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
  FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""")
def op3_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def tokenizer(spark, file: str = "byte_bpe_multi_50k.tiktoken") -> ByteBpe:
    import public_tokenizers
    return ByteBpe(spark, public_tokenizers.path(file), public_tokenizers.PATTERN)


@query("op10_byte_bpe")
def op10_byte_bpe(spark, sf_dir):
    """Tested against the tokenizer's own library and by exact round trip."""
    bpe = tokenizer(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.decode(bpe.encode(docs)).drop("text")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
