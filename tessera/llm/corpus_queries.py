"""Queries of fill-in-the-middle, quality rules and tokenizer alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import cross_tokens, fill_middle, perplexity
from tessera.llm.common import stored, table
from tessera.llm.registry import query


@query("op11_fill_middle", sql=r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         sha256('42:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents
), d AS (
  SELECT doc_id, text, w, len(w) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(w) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), p AS (
  SELECT doc_id, text, n, form, array_to_string(w[1:least(a, b)], '') AS prefix,
         array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(w[greatest(a, b) + 1:], '') AS suffix
  FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
""")
def op11_fill_middle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fill_middle.transform(docs)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


@query("op12_quality_rules")
def op12_quality_rules(spark, sf_dir):
    """Tested against plain rules and a plain Kneser-Ney model: SQL could
    give the rules but not the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = perplexity.probabilities(perplexity.counts(docs))
    scored = stored(perplexity.score(docs, model).drop("text"), "perplexity")
    out = perplexity.judge(scored, perplexity.bands(scored))
    return out.select("doc_id", *perplexity.MEASURES, "base_failed", "kept", "log_perplexity")


def tokenizer_pair(spark):
    import public_tokenizers as p
    return cross_tokens.CrossTokens(spark, p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"), p.PATTERN)


@query("op13_cross_tokens")
def op13_cross_tokens(spark, sf_dir):
    """Tested against the tokenizers' libraries and plain loops."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tokenizer_pair(spark).align(docs, groups="sha256")
    return out.select("doc_id", *cross_tokens.MEASURES, F.col("groups").alias("groups_sha256"))
