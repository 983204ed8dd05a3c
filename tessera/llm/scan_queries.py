"""Queries of the native scans: secrets, benchmark passages, licences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import decontaminate, licenses, secrets
from tessera.llm.common import table
from tessera.llm.registry import query


@query("op1_secrets")
def op1_secrets(spark, sf_dir):
    """Tested against Python's ``re`` and a plain Markov model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secrets.scan(docs, secrets.train(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
                      secrets.joined(F.col("found")).alias("spans"))


@query("op7_decontaminate", sql=r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS s
           FROM documents),
b AS (SELECT item_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS s
      FROM benchmark),
dw AS (SELECT doc_id, string_split(s, ' ') AS w FROM d WHERE s <> '' AND doc_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, string_split(s, ' ') AS w FROM b WHERE s <> '' AND item_id IS NOT NULL),
dp AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS pos FROM dw),
bp AS (SELECT item_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS pos FROM bw),
hits AS (SELECT doc_id, item_id, dp.pos - bp.pos AS start
         FROM dp JOIN bp USING (x) GROUP BY ALL HAVING count(*) >= ceil(least(13, any_value(n)) * 0.8)),
aligned AS (
  SELECT h.doc_id, h.item_id, h.start, len(bw.w) AS n_words,
         list_transform(range(greatest(0, -h.start), least(len(bw.w), len(dw.w) - h.start)),
                        lambda q: CASE WHEN bw.w[q + 1] = dw.w[q + h.start + 1] THEN 1 ELSE 0 END) AS same
  FROM hits h JOIN dw USING (doc_id) JOIN bw USING (item_id)),
judged AS (
  SELECT doc_id, item_id, start, n_words, list_sum(same) AS n_match,
         list_max(list_transform(range(1, greatest(len(same) - 13 + 1, 1) + 1),
                                 lambda i: list_sum(list_slice(same, i, i + 12)))) AS best
  FROM aligned)
SELECT doc_id, item_id, CAST(n_match AS BIGINT) AS n_match, n_words, CAST(best AS BIGINT) AS best, start
FROM judged WHERE best >= ceil(least(13, n_words) * 0.8)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best DESC, n_match DESC, start) = 1
""")
def op7_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), complete=True)


@query("op8_licenses")
def op8_licenses(spark, sf_dir):
    """Tested against a word-by-word version."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word",
                                      "base_labels", "labels", "score")
