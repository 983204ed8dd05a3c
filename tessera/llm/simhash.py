"""SimHash near-duplicates: fingerprints, a segment-popcount grid, components.

A 64-bit fingerprint is embedded as its bit counts in ``64 / WIDTH`` segments.
The Manhattan distance of two such vectors never exceeds the number of
differing bits, so pairs within ``max_bits`` bits are within ``max_bits`` in
that space too. The grid joins on it: the segments are dealt to ``axes``
groups of coordinates, and vectors within distance d differ in at most d of
the groups, so they share a cell of some ``axes - d`` of them. Rows of one
cell are compared in sorted runs: first by Manhattan distance, then exactly.

Equal fingerprints are collapsed before the grid, so copies cost nothing. Of
each run's links only a spanning forest leaves the task, so a large group of
near copies does not turn into all its pairs; a run longer than ``CHUNK`` is
cut into chunk pairs that other tasks compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import checkpointed, fresh
from tessera.llm.graph import components, forest

#: XXH64 seed of the shingle hashes
SEED = 42
#: bits of a segment; a count then has WIDTH + 1 values
WIDTH = 2
#: fingerprints of one cell that one task compares with each other at once
CHUNK = 4096
#: pairs that a block of comparisons holds in memory
BLOCK = 1 << 21


def fingerprint_of(text: str | None, shingle: int) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    line, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    hashes = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in
                          zip(starts[:n].tolist(), ends[k - 1:].tolist())), np.uint64, n)
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1,
                         bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int) -> Column:
    """Fingerprint over ``shingle``-word shingles, repeats included: a bit is
    set iff over half the shingle hashes have it. No words give zero."""
    @F.arrow_udf(T.LongType())
    def run(texts):
        import pyarrow as pa
        return pa.array([fingerprint_of(x.as_py(), shingle) for x in texts], pa.int64())

    return run(text.cast("string"))


def segment_counts(prints: np.ndarray) -> np.ndarray:
    """(n, 64 / WIDTH) bit counts of unsigned fingerprints."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(prints), 64 // WIDTH, WIDTH).sum(axis=2, dtype=np.uint8)


def cells(prints: np.ndarray, axes: int, max_bits: int) -> np.ndarray:
    """(n, choices) cell numbers: one for each choice of axes that may agree."""
    counts = segment_counts(prints).astype(np.uint64)
    groups = np.array_split(np.arange(counts.shape[1]), axes)
    base = np.uint64(WIDTH + 1)
    axis = np.stack([counts[:, g] @ (base ** np.arange(len(g), dtype=np.uint64)) for g in groups], axis=1)
    span = base ** np.uint64(max(map(len, groups)))
    out = []
    for k, chosen in enumerate(combinations(range(axes), axes - max_bits)):
        cell = np.full(len(prints), k, np.uint64)
        for c in chosen:  # wraps for very wide choices, which only makes more candidates
            cell = cell * span + axis[:, c]
        out.append(cell)
    return np.stack(out, axis=1).view(np.int64)


def _links(x: np.ndarray, y: np.ndarray | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs of x (and y): the Manhattan distance of the
    counts first, then the differing bits."""
    other, out = x if y is None else y, []
    cx, co = segment_counts(x), segment_counts(other)
    step = max(1, BLOCK // max(1, len(other)))
    for at in range(0, len(x), step):
        near = np.ones((len(x[at:at + step]), len(other)), bool)
        if y is None:
            near &= np.arange(at, at + near.shape[0])[:, None] < np.arange(len(other))
        total = np.zeros(near.shape, np.uint8)
        for s in range(0, cx.shape[1]):
            a, b = cx[at:at + step, s][:, None], co[:, s]
            total += np.maximum(a, b) - np.minimum(a, b)
        i, j = np.nonzero(near & (total <= max_bits))
        exact = np.bitwise_count(x[at + i] ^ other[j]) <= max_bits
        out.append((at + i[exact], j[exact]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _edges(x: np.ndarray, y: np.ndarray | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links, as pairs of fingerprints."""
    i, j = _links(x, y, max_bits)
    both = x if y is None else np.concatenate((x, y))
    label = forest(i, j if y is None else j + len(x), len(both))
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


def _short_runs(prints: np.ndarray, start: np.ndarray, length: np.ndarray, max_bits: int):
    """Links inside many short runs at once: rows ``gap`` apart."""
    for gap in range(1, int(length.max(initial=1))):
        keep = length > gap
        start, length = start[keep], length[keep]
        n = length - gap
        i = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        x, y = prints[i], prints[i + gap]
        hit = np.bitwise_count(x ^ y) <= max_bits
        yield x[hit], y[hit]


_OUT = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                     T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType())])


def _compare(batches: Iterator, max_bits: int) -> Iterator:
    """Rows (cell, fp) sorted by cell -> links, and chunk pairs of long runs.
    What is held over from one batch to the next is one run."""
    import pyarrow as pa

    def links(a, b):
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.record_batch([pa.array(a), pa.array(b), pa.nulls(len(a), pa.binary()),
                                pa.nulls(len(a), pa.binary())], names=_OUT.names)

    def long_run(x):
        chunks = [x[k:k + CHUNK] for k in range(0, len(x), CHUNK)]
        if len(chunks) == 1:
            a, b = _edges(x, None, max_bits)
            if len(a):
                yield links(a, b)
            return
        for i, c in enumerate(chunks):
            right = [d.tobytes() for d in chunks[i:]]
            for k in range(0, len(right), 64):  # 64 units of two chunks a batch
                part = right[k:k + 64]
                yield pa.record_batch([pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int64()),
                                       pa.array([c.tobytes()] * len(part), pa.binary()),
                                       pa.array(part, pa.binary())], names=_OUT.names)

    def runs(cell, fp):
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        length = np.diff(np.append(first, len(cell)))
        small = (length > 1) & (length <= 24)
        for a, b in _short_runs(fp, first[small], length[small], max_bits):
            if len(a):
                yield links(a, b)
        for s, n in zip(first[length > 24].tolist(), length[length > 24].tolist()):
            yield from long_run(fp[s:s + n])

    held: list[tuple[np.ndarray, np.ndarray]] = []  # parts of the run not ended yet
    for batch in batches:
        cell = batch.column(0).to_numpy()
        fp = batch.column(1).to_numpy().view(np.uint64)
        if not len(cell):
            continue
        if held and cell[-1] == held[-1][0][0] and cell[0] == cell[-1]:
            held.append((cell, fp))
            continue
        cell = np.concatenate([c for c, _ in held] + [cell])
        fp = np.concatenate([f for _, f in held] + [fp])
        cut = int(np.searchsorted(cell != cell[-1], False)) if cell[0] == cell[-1] else \
            len(cell) - int(np.argmax(cell[::-1] != cell[-1]))
        if cut:
            yield from runs(cell[:cut], fp[:cut])
        held = [(cell[cut:], fp[cut:])]
    if held:
        yield from runs(np.concatenate([c for c, _ in held]), np.concatenate([f for _, f in held]))


def fingerprint_links(prints: DataFrame, max_bits: int = 4, axes: int = 7) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column ``fp`` that keep
    every two within ``max_bits`` bits connected; each one is such a pair."""
    if not max_bits < axes <= 64 // WIDTH:
        raise ValueError("axes must be over max_bits and at most the number of segments")
    grid = T.StructType([T.StructField("cell", T.LongType()), T.StructField("fp", T.LongType())])

    def spread(batches):
        import pyarrow as pa
        for batch in batches:
            fp = batch.column(0).to_numpy()
            c = cells(fp.view(np.uint64), axes, max_bits)
            yield pa.record_batch([pa.array(c.ravel()), pa.array(np.repeat(fp, c.shape[1]))],
                                  names=["cell", "fp"])

    rows = prints.select("fp").where("fp is not null").mapInArrow(spread, grid)
    # cell numbers are hashed by Spark, equal ones meet in a partition and stand together
    found = checkpointed(rows.repartition("cell").sortWithinPartitions("cell")
                         .mapInArrow(lambda it: _compare(it, max_bits), _OUT))

    def unit(batches):
        import pyarrow as pa
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                x = np.frombuffer(left.as_py(), np.uint64)
                y = np.frombuffer(right.as_py(), np.uint64)
                a, b = _edges(x, None if left.as_py() == right.as_py() else y, max_bits)
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    units = found.where("left is not null").select("left", "right")
    return found.where("left is null").select("a", "b").unionByName(
        units.repartition(F.xxhash64("left", "right")).mapInArrow(unit, "a long, b long")).distinct()


def groups(rows: DataFrame, max_bits: int = 4, axes: int = 7) -> DataFrame:
    """(fp, component_id, keeper) for rows (id, fp): the smallest id among
    the rows reachable by links, and the (id, fp) that holds it."""
    classes = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("rep")))
    roots = components(fingerprint_links(classes, max_bits, axes))
    placed = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("id"), F.col("fp")))
    least = placed.groupBy("root").agg(first.alias("keeper"))
    return placed.join(least, "root").select(
        "fp", F.col("keeper.id").alias("component_id"),
        F.struct("keeper.id", "keeper.fp").alias("keeper"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 4, max_bits: int = 4, axes: int = 7) -> DataFrame:
    """``docs`` with ``fp`` (signed fingerprint) and ``component_id`` (the
    smallest id among the rows reachable by links of ``max_bits`` bits).

    Cases: null text counts as empty; all texts without words have
    fingerprint zero and are linked; rows of equal text are linked, also
    when they share an id; a row without an id is grouped like any other,
    and a component of such rows only has component_id null; an empty table
    gives an empty table; other columns are kept, and one with the name of
    an output column is replaced."""
    ident = F.col(f"`{id_col}`").alias("id")
    rows = checkpointed(docs.select(ident, fingerprint(F.col(f"`{text_col}`"), shingle).alias("fp")))
    found, key = groups(rows, max_bits, axes), fresh(docs, "key")
    marked = docs.withColumn("fp", fingerprint(F.col(f"`{text_col}`"), shingle)).drop("component_id")
    return marked.join(found.select(F.col("fp").alias(key), "component_id"),
                       F.col("fp") == F.col(key)).drop(key)


def document_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 4, max_bits: int = 4, axes: int = 7) -> DataFrame:
    """One row (id, fp, component_id) for each row of ``docs``, without the
    texts: each text is read and fingerprinted once. Cases as in
    ``near_duplicates``."""
    rows = checkpointed(docs.select(F.col(f"`{id_col}`").alias("id"),
                                    fingerprint(F.col(f"`{text_col}`"), shingle).alias("fp")))
    return rows.join(groups(rows, max_bits, axes).select("fp", "component_id"), "fp").select(
        "id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = 4, max_bits: int = 4, axes: int = 7) -> DataFrame:
    """The row with the smallest id of each component, with the columns of
    ``docs``; of rows equal in id and fingerprint one stays, and a component
    of rows without an id keeps one of them."""
    rows = checkpointed(docs.select(F.col(f"`{id_col}`").alias("id"),
                                    fingerprint(F.col(f"`{text_col}`"), shingle).alias("fp")))
    keep = groups(rows, max_bits, axes).select(F.col("keeper.id").alias("_id"), F.col("keeper.fp").alias("_kfp")).distinct()
    fp, kid, kfp = fresh(docs, "fp"), fresh(docs, "kid"), fresh(docs, "kfp")
    keep = keep.select(F.col("_id").alias(kid), F.col("_kfp").alias(kfp))
    # ids first: only their rows are fingerprinted again
    near = docs.join(keep, F.col(f"`{id_col}`").eqNullSafe(F.col(kid)))
    return (near.withColumn(fp, fingerprint(F.col(f"`{text_col}`"), shingle))
            .where(F.col(fp) == F.col(kfp)).dropDuplicates([id_col, fp]).drop(fp, kid, kfp))
