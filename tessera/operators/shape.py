"""Corpus shaping: segment packing of a whole id stream (C1), denoising
pairs (C2), teacher-forcing shift (C3-C5), masks (C6, C7), width (C8),
training triples (C9), shuffled / sequential order and batches (C10-C12).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.constants import END, PAD, START
from tessera.functions.keyed import permuted
from tessera.functions.noise import add_noise
from tessera.operators.ids import with_row_index, with_running_total


# ------------------------------------------------------------------ C3-C7
def shift(ids: Column | str) -> tuple[Column, Column]:
    """(input = all but last, gold = all but first)."""
    a = F.col(ids) if isinstance(ids, str) else ids
    n = F.size(a)
    keep = F.greatest(n - 1, F.lit(0))
    return F.slice(a, 1, keep), F.slice(a, 2, keep)


def pad_mask(ids: Column | str, pad_id: int = PAD) -> Column:
    """Boolean mask of non-pad positions."""
    return F.transform(ids, lambda x: x != F.lit(pad_id))


def attention_mask(ids: Column | str, pad_id: int = PAD) -> Column:
    """0/1 attention mask beside fixed-width ids."""
    return F.transform(ids, lambda x: (x != F.lit(pad_id)).cast("int"))


def max_width(df: DataFrame, ids_col: str, cap: int = 512) -> DataFrame:
    """Corpus-wide width = max encoded length, capped."""
    return df.agg(F.least(F.max(F.size(ids_col)), F.lit(cap)).cast("bigint").alias("width"))


# ------------------------------------------------------------------ C1
def segments(df: DataFrame, body_col: str, order_cols: list[str], max_len: int,
             mode: str = "strict") -> DataFrame:
    """Pack the whole corpus id stream (rows in ``order_cols`` order,
    ``body_col`` = ids without START/END) into windows of ``max_len - 1``
    content ids with stride ``max_len - 2`` (neighbours share one id), each
    wrapped in START/END.

    ``strict``: every row is max_len + 1 long, the last one padded; a short
    corpus gives one padded row. ``literal``: the first and last corpus ids
    are dropped first, windows start while ``i < L - max_len - 2`` and the
    tail row keeps the original arithmetic (it can be longer than the
    others); a corpus of ``L <= max_len + 2`` ids is an error.

    The rows are sorted with their arrays, one record a row; the running total
    of the lengths places the row in the stream, the row's array is cut into
    one slice per segment it touches, and each segment is put together from its
    slices (at most ``max_len - 1`` ids; the literal tail at most that and
    ``max_len``). Rows without an order come first, tied ones in any order.
    """
    if max_len < 3:
        raise ValueError("max_len must be at least 3")
    if mode not in ("strict", "literal"):
        raise ValueError(f"unknown mode {mode!r}")
    stride = max_len - 2
    sizes = df.select(*order_cols, F.col(body_col).alias("__body"), F.size(body_col).alias("__n")).where("__n > 0")
    placed, total = with_running_total(sizes, order_cols, "__n", "__start")
    if mode == "strict":
        length, first = total, 0
        last = max(1, -(-(total - 1) // stride)) - 1
        last_stop = last * stride + stride
    else:  # the first and last id are left out
        length, first = total - 2, 1
        if length <= max_len + 2:
            raise ValueError(f"corpus of {length} ids is too short for max_len={max_len}")
        last = -(-(length - max_len - 2) // stride)
        last_stop = length - 2
    start = F.col("__start") - first
    end = F.least(start + F.col("__n"), F.lit(length)) - 1
    low = F.least(F.greatest(F.ceil((start - stride) / stride), F.lit(0)), F.lit(last)).cast("bigint")
    high = F.least(F.floor(end / stride), F.lit(last)).cast("bigint")
    rows = placed.select("__body", start.alias("__s"), end.alias("__e"), low.alias("__low"), high.alias("__high")) \
        .where("__low <= __high")
    cut = rows.select("__body", "__s", "__e", F.explode(F.sequence("__low", "__high")).alias("segment_id"))
    at = F.greatest(F.col("__s"), F.col("segment_id") * stride, F.lit(0))
    stop = F.least(F.col("__e"), F.when(F.col("segment_id") == last, F.lit(last_stop))
                   .otherwise(F.col("segment_id") * stride + stride))
    slices = cut.where(at <= stop).select("segment_id", F.struct(at.alias("at"), F.slice(
        "__body", (at - F.col("__s") + 1).cast("int"), (stop - at + 1).cast("int")).alias("ids")).alias("part"))
    grouped = slices.groupBy("segment_id").agg(F.array_sort(F.collect_list("part")).alias("__p"))
    row = F.concat(F.array(F.lit(START)), F.flatten(F.transform("__p", lambda x: x["ids"])), F.array(F.lit(END)))
    if mode == "strict":
        pad_n = F.lit(max_len + 1) - F.size(row)
    else:
        pad_n = F.when(F.col("segment_id") == last, F.lit(max(0, max_len - (length - last * stride)))).otherwise(F.lit(0))
    return grouped.select("segment_id", F.concat(row, F.array_repeat(F.lit(PAD), pad_n)).alias("segment"))


def denoising_pairs(segs: DataFrame, prob_mask: float = 10, prob_delete: float = 7,
                    seed=0, epoch=0) -> DataFrame:
    """One row per segment with its noised copy."""
    out = add_noise(segs, "segment", "segment_id", "noised_segment", prob_mask,
                    prob_delete, seed, epoch)
    return out.select("segment_id", F.col("segment").alias("original_segment"),
                      "noised_segment")


# ------------------------------------------------------------------ C9
def training_rows(encoded: DataFrame, ids_col: str, row_col: str, label_col: str,
                  noise: bool = True, prob_mask: float = 15, prob_delete: float = 15,
                  seed=0, epoch=0) -> DataFrame:
    """(row, src, trg, label); noised => (noised, clean), otherwise
    (clean, clean). Labels are cast to double."""
    if noise:
        encoded = add_noise(encoded, ids_col, row_col, "__noised", prob_mask, prob_delete,
                            seed, epoch)
        src = F.col("__noised")
    else:
        src = F.col(ids_col)
    return encoded.select(row_col, src.alias("src"), F.col(ids_col).alias("trg"),
                          F.col(label_col).cast("double").alias("label"))


# ------------------------------------------------------------------ C10-C12
def batches(df: DataFrame, row_col: str, batch_size: int = 32, shuffle: bool = True,
            seed=0, epoch=0) -> DataFrame:
    """Global position in a shuffled (train) or sequential (test)
    order, ``batch_id = floor(position / batch_size)``; the last batch may
    be short. Rows are numbered once, in the order of ``row_col`` (range sort
    + partition offsets); a shuffled order is a keyed permutation of these
    numbers, another one each epoch, without a sort by any key."""
    idx, n = with_row_index(df, [row_col], col="position", return_count=True)
    if shuffle and n:
        idx = idx.withColumn("position", permuted(F.col("position"), n, seed, epoch, "order"))
    return idx.withColumn("batch_id", F.floor(F.col("position") / batch_size).cast("bigint"))
