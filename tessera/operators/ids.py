"""Dense global row numbers without a single-partition window.

``row_number().over(Window.orderBy(...))`` moves every row into one task.
Here the frame is range-partitioned on the order columns, sorted inside each
partition, tagged with (partition id, position in partition), and written to
the shared checkpoint folder so the layout is frozen; the per-partition row
counts (one small number per partition) then give each partition its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

_PID = "__pid"
_MONO = "__mono"


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_row_index(df: DataFrame, order_cols: list[str | Column], col: str = "row_idx",
                   start: int = 0, num_partitions: int | None = None,
                   return_count: bool = False):
    """Add ``col`` = start + 0-based rank of the row under ``order_cols``
    (which must identify rows uniquely for a deterministic result)."""
    n = _partitions(df, num_partitions)
    ordered = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    tagged = cut_lineage(
        ordered.withColumn(_PID, F.spark_partition_id())
               .withColumn(_MONO, F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in tagged.groupBy(_PID).count().collect()}
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    if offsets:
        off = F.element_at(F.array(*[F.lit(o) for o in offsets]), F.col(_PID) + 1)
    else:
        off = F.lit(0)
    local = F.col(_MONO) - F.shiftleft(F.col(_PID).cast("bigint"), 33)
    out = tagged.withColumn(col, (F.lit(start) + off + local).cast("bigint")).drop(_PID, _MONO)
    return (out, total) if return_count else out


def with_running_total(df: DataFrame, order_cols: list[str], value: str, col: str = "start",
                       num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """Add ``col`` = the sum of ``value`` over all earlier rows under
    ``order_cols``; also returns the whole sum. Rows are summed inside their
    sorted partition; one number per partition comes to the driver."""
    n = _partitions(df, num_partitions)
    tagged = cut_lineage(
        df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
          .withColumn(_PID, F.spark_partition_id()).withColumn(_MONO, F.monotonically_increasing_id()))
    sums = {r[0]: r[1] or 0 for r in tagged.groupBy(_PID).agg(F.sum(value)).collect()}
    offsets, total = [], 0
    for p in range(max(sums, default=-1) + 1):
        offsets.append(total)
        total += sums.get(p, 0)
    off = F.element_at(F.array(*[F.lit(int(o)) for o in offsets]), F.col(_PID) + 1) if offsets else F.lit(0)
    before = Window.partitionBy(_PID).orderBy(_MONO).rowsBetween(Window.unboundedPreceding, -1)
    out = tagged.withColumn(col, (off + F.coalesce(F.sum(value).over(before), F.lit(0))).cast("bigint"))
    return out.drop(_PID, _MONO), int(total)
