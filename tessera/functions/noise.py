"""Denoising corruption of id arrays: mask, rotate, delete and the random
subset of the three (N1-N7), with keyed (md5) randomness.

These are DataFrame transforms that add one intermediate column per stage:
Catalyst inlines a computed column into a lambda body that references it,
which would re-evaluate it per element. So every lambda below touches only
its own variables; per-row scalars enter lambdas zipped as arrays.

Counts follow Python's ``round`` (half to even): ``bround(n * p / 100)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.constants import END, MASK, PAD
from tessera.functions.keyed import position_key, uniform_index

# The corruption kinds in subset-bit order (bit j = kind j).
NOISE_KINDS = ("mask", "rotate", "delete")
N_SUBSETS = 1 << len(NOISE_KINDS)


def powerset_table(spark):
    """Subset id -> kinds, in bitmask order."""
    rows = [(i, [k for j, k in enumerate(NOISE_KINDS) if i & (1 << j)])
            for i in range(N_SUBSETS)]
    return spark.createDataFrame(rows, "subset int, kinds array<string>")


def noise_count(n: Column, prob: float) -> Column:
    return F.bround(n.cast("double") * F.lit(float(prob)) / F.lit(100.0), 0).cast("int")


def _keys(arr: str, row: str, salt: str, seed, epoch) -> Column:
    return F.transform(arr, lambda x, i: position_key(seed, epoch, salt, F.col(row), i))


def _kth(arr: str, keys: str, prob: float) -> Column:
    k = noise_count(F.size(arr), prob)
    return F.when(k > 0, F.element_at(F.array_sort(keys), k)).otherwise(F.lit(-1).cast("bigint"))


def _zip(arr: str, keys: str, prob: float) -> Column:
    return F.arrays_zip(F.col(arr).alias("x"), F.col(keys).alias("kk"),
                        F.array_repeat(_kth(arr, keys, prob), F.size(arr)).alias("t"))


def mask(df: DataFrame, arr: str, row: str, out: str, prob: float = 15, seed=0, epoch=0,
         mask_id: int = MASK, when: Column | None = None) -> DataFrame:
    """Replace ``round(n*prob/100)`` keyed-sampled positions by mask_id."""
    keys = f"__k_{out}"
    on = F.lit(True) if when is None else when
    df = df.withColumn(keys, F.when(on, _keys(arr, row, "mask", seed, epoch)))
    res = F.transform(_zip(arr, keys, prob),
                      lambda s: F.when(s["kk"] <= s["t"], F.lit(mask_id)).otherwise(s["x"]))
    return df.withColumn(out, F.when(on, res).otherwise(F.col(arr))).drop(keys)


def delete(df: DataFrame, arr: str, row: str, out: str, prob: float = 15, seed=0, epoch=0,
           when: Column | None = None) -> DataFrame:
    """Drop ``round(n*prob/100)`` keyed-sampled positions, order kept."""
    keys = f"__k_{out}"
    on = F.lit(True) if when is None else when
    df = df.withColumn(keys, F.when(on, _keys(arr, row, "delete", seed, epoch)))
    kept = F.transform(F.filter(_zip(arr, keys, prob), lambda s: s["kk"] > s["t"]),
                       lambda s: s["x"])
    return df.withColumn(out, F.when(on, kept).otherwise(F.col(arr))).drop(keys)


def rotate_expr(arr: Column, base: Column) -> Column:
    n = F.size(arr)
    return F.concat(F.slice(arr, base + 1, n - base), F.slice(arr, F.lit(1), base))


def rotate(df: DataFrame, arr: str, row: str, out: str, seed=0, epoch=0,
           when: Column | None = None) -> DataFrame:
    """Cut at a keyed uniform index and swap the halves; empty stays."""
    on = F.lit(True) if when is None else when
    n = F.size(arr)
    base = uniform_index(seed, epoch, "rotate", F.col(row), n)
    res = F.when(n > 0, rotate_expr(F.col(arr), base)).otherwise(F.col(arr))
    return df.withColumn(out, F.when(on, res).otherwise(F.col(arr)))


def subset_id(row: str, seed=0, epoch=0) -> Column:
    """Uniform subset of {mask, rotate, delete}, 0..7."""
    return uniform_index(seed, epoch, "subset", F.col(row), N_SUBSETS).cast("int")


def add_noise(df: DataFrame, col: str, row: str, out: str, prob_mask: float = 15,
              prob_delete: float = 15, seed=0, epoch=0, subset: int | None = None,
              mask_id: int = MASK, end_id: int = END, pad_id: int = PAD) -> DataFrame:
    """Tokens between the first token and the *first* end id are
    corrupted by a keyed subset of mask -> rotate -> delete, then re-wrapped
    and padded back to the input length. ``epoch`` in the key gives dynamic
    (per-epoch) noise; a fixed epoch gives static noise. ``subset`` forces
    one subset id (0..7). A row without an end id yields null."""
    e = F.array_position(col, end_id)
    df = df.withColumn("__c0", F.when(e >= 1, F.slice(col, 2, F.greatest(e - 2, F.lit(0)))))
    df = df.withColumn("__sub", F.lit(subset) if subset is not None else subset_id(row, seed, epoch))
    bit = lambda j: (F.col("__sub").bitwiseAND(1 << j)) != 0
    df = mask(df, "__c0", row, "__c1", prob_mask, seed, epoch, mask_id, when=bit(0))
    df = rotate(df, "__c1", row, "__c2", seed, epoch, when=bit(1))
    df = delete(df, "__c2", row, "__c3", prob_delete, seed, epoch, when=bit(2))
    wrapped = F.concat(F.array(F.element_at(col, 1)), F.col("__c3"), F.array(F.lit(end_id)))
    padded = F.concat(wrapped, F.array_repeat(F.lit(pad_id),
                                              F.greatest(F.size(col) - F.size(wrapped), F.lit(0))))
    return df.withColumn(out, F.when(F.col("__c3").isNotNull(), padded)) \
             .drop("__c0", "__c1", "__c2", "__c3", "__sub")
