"""Queries of the trained classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import quality, toxicity
from tessera.llm.common import table
from tessera.llm.registry import query


def toxicity_model(spark, sf_dir, docs):
    """Trained on labelled rows that are not held out."""
    labels = table(spark, sf_dir, "labels").where(toxicity.remainder() != 1)
    return toxicity.fit(docs, labels)


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    """Tested by held-out accuracy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = toxicity.score(docs, toxicity_model(spark, sf_dir, docs), threshold=0.7)
    return out.select("doc_id", (toxicity.remainder() == 1).alias("held_out"), "score",
                      "predicted", "flagged")


@query("op2_quality")
def op2_quality(spark, sf_dir):
    """One row a document; tested by its agreement with held labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.classify(docs, quality.fit(docs))
    return out.select("doc_id", "posterior", "score", "keep")
