"""Structured Streaming variants of the stateless corpus operators.

Cleaning and keyed noise are per-row expressions, so they run directly on a
streaming DataFrame. Encoding re-assembles each row after a vocabulary
join (an aggregation), so a stream is encoded micro-batch by micro-batch
with ``foreachBatch``, against a fitted (static) vocabulary; the sink is
idempotent per batch id, so a replayed batch overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import denoise
from tessera.operators import vocab as vc


def clean_stream(stream: DataFrame, text_col: str = "text", kind: str = "split") -> DataFrame:
    """T8 on a stream (JVM-side kinds ``split`` / ``none``; ``denoise``
    adds the Arrow-batched HTML step)."""
    return stream.withColumn(text_col, denoise(F.col(text_col), kind))


def encode_batches(stream: DataFrame, vocab: vc.Vocab, out_path: str, checkpoint: str,
                   text_col: str = "text", key_cols: list[str] | None = None,
                   max_len: int | None = 128, trigger_once: bool = True):
    """K5/K9 on a stream: every micro-batch is encoded with the fitted
    vocabulary and written to ``out_path/batch=<id>`` (overwrite, so a
    retried batch is not duplicated). Returns the started query."""
    key_cols = key_cols or ["doc_id"]

    def write(batch: DataFrame, batch_id: int) -> None:
        enc = vc.encode(batch, vocab, text_col, key_cols, max_len=max_len)
        enc.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger_once else writer
    return writer.start()
