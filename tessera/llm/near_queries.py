"""Queries of the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.cover_tree import near_duplicates
from tessera.llm.registry import query
from tessera.llm.repeats import remove_repeats
from tessera.llm.simhash import document_groups


@query("op4_simhash")
def op4_simhash(spark, sf_dir):
    """Tested against a brute-force version: SQL has no XXH64."""
    docs = table(spark, sf_dir, "documents")
    found = document_groups(docs, shingle=4, max_bits=4)
    return found.select(F.col("id").alias("doc_id"),
                        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op5_cover_tree", sql="""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM low LEFT JOIN n USING (vec_id)
""")
def op5_cover_tree(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "embeddings"), min_cosine=0.9)
    return found.select("vec_id", "n_links", "component_id", "kept")


@query("op9_repeats")
def op9_repeats(spark, sf_dir):
    """Tested against a brute-force version."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs, window=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
