"""Byte-exact removal of long repeated strings ("suffix-array dedup").

Every 200-byte string (``window``) that also starts anywhere else is found by
sorting sampled suffixes, and the bytes it covers are removed. The scheme is
that of a difference-cover suffix sort with one change: a cover by
positions modulo a number needs a row for every byte or so, since the same
text at another offset is sampled at other places, and does not fit the
limits (README, figures). The cover used here is chosen by content: of each
window the 32-byte gram with the smallest hash (the leftmost one) is its
sample. Equal windows then have equal samples at equal offsets, which is
what a cover is for, and neighbouring windows share a sample, so there is a
row for about 65 windows ("block").

1. Sampled grams are sorted by name. A block whose gram is nowhere else holds
   no repeat; blocks with the same text, sorted next to each other, are
   repeats as a whole, and one of them stands for all.
2. What remains are different texts around one gram. Each is merged with its
   neighbours in cells of ``CELL`` offsets from the gram: the part that all
   windows of a cell share is the sort key, and the windows themselves are
   compared by the few bytes on both sides of it.
3. Each document's repeated windows are united and cut out.

Names are 64-bit hashes (128-bit for cells and documents). Equal blocks of
one batch are combined before anything is shuffled, so the rows of one gram
that meet in a task are its different texts and one row a batch for each of
their copies. Grams with over a thousandth of the
rows are found on a sample of documents and dealt out by the text of their
blocks; the windows of a cell that more than ``RUN_ROWS`` texts share are
passed on and counted by partial aggregation. Both change where the work is
done, not its result.

Cases: null or empty text has no bytes; a text shorter than the window
loses nothing; equal rows repeat each other; rows without an id take part
like any other; an empty table gives an empty table; other columns are kept,
and one with the name of an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import checkpointed, fresh
from tessera.llm.hashed_words import SLICE, _powers, mixed

GRAM, CELL = 32, 16
#: share of documents that is looked at for frequent grams, and the share of
#: its rows that makes a gram frequent (so there are at most 1000)
HOT_SAMPLE, HOT_SHARE = 64, 1000
#: rows of the sample below which no gram is frequent
HOT_LEAST = 20
HOT_PARTS = 64
#: texts of one cell that a task compares itself (some 20 MB); more are passed on
RUN_ROWS = 100_000


def _segments(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts with the end, text of each part, its offset there):
    short texts together, a long one in parts that overlap by a window less
    one byte, so that each window is in one part."""
    part: list[tuple[bytes, int, int]] = []
    size = 0

    def done():
        data = np.frombuffer(b"".join(p for p, _, _ in part), np.uint8)
        starts = np.cumsum([0] + [len(p) for p, _, _ in part])
        return data, starts, np.array([k for _, k, _ in part]), np.array([a for _, _, a in part])

    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), SLICE):
            piece = text[at:at + SLICE + window - 1]
            if len(piece) < window:
                continue
            if part and size + len(piece) > SLICE:
                yield done()
                part, size = [], 0
            part.append((piece, k, at))
            size += len(piece)
    if part:
        yield done()


def _blocks(data: np.ndarray, starts: np.ndarray, window: int):
    """(first window, windows, offset of the gram in the first window, gram's
    name, text's name) of the blocks of some texts laid end to end."""
    n = len(data)
    power, inverse = _powers(n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])))
    name = mixed((total[GRAM:] - total[:-GRAM]) * inverse[:n - GRAM + 1])
    bits = np.uint64(max(20, n.bit_length()))
    # hash above, place below: the minimum is the smallest hash, the leftmost of equal ones
    low = ((name >> bits) << bits) | np.arange(len(name), dtype=np.uint64)
    width, span, windows = window - GRAM + 1, 1, n - window + 1
    while 2 * span <= width:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    low = np.minimum(low[:windows], low[width - span:width - span + windows])
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(text[:windows] == text[window - 1:])
    new = np.concatenate(([True], (place[at][1:] != place[at][:-1]) | (np.diff(at) != 1)))
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    gram = place[first]
    whole = mixed((total[last + window] - total[first]) * inverse[first])
    return first, last - first + 1, gram - first, name[gram], whole, text[first]


_BLOCK = "gram long, whole long, n int, off int, k1 long, k2 long, start int, kind int"
_NAMES = ["gram", "whole", "n", "off", "k1", "k2", "start", "kind"]
#: kinds of a block: there once in its batch; repeated; there once, as far as
#: known; one that stands for several equal ones
SINGLE, REPEATED, OPEN, PARTNER = 0, 1, 2, 3


def _combined(c: list[np.ndarray]) -> list[np.ndarray]:
    """The blocks of a batch: equal ones are REPEATED, and one PARTNER more
    stands for them, so that a passage of very many copies sends a row for
    each batch to the task of its gram. REPEATED blocks need no comparison
    and are dealt by their document instead."""
    gram, whole, n, off = c[:4]
    key = mixed(gram ^ mixed(whole ^ mixed((n.astype(np.uint64) << np.uint64(32)) | off.astype(np.uint64))))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:]] = same
    several = again.copy()
    several[order[:-1]] |= same
    kind = np.where(several, REPEATED, SINGLE).astype(np.int32)
    stands = np.flatnonzero(several & ~again)
    c = [np.concatenate((x, x[stands])) for x in c]
    kind = np.concatenate((kind, np.full(len(stands), PARTNER, np.int32)))
    c[0] = np.where(kind == REPEATED, c[4].view(np.uint64), c[0])
    return [*c, kind]


def blocks(rows: DataFrame, window: int) -> DataFrame:
    """Blocks of rows (k1, k2, t), equal ones of a batch combined."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column("t")]
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            parts = []
            for data, starts, which, base in _segments(texts, window):
                first, n, off, gram, whole, part = _blocks(data, starts, window)
                at = first - starts[part] + base[part]
                parts.append((gram, whole, n.astype(np.int32), off.astype(np.int32), k1[which[part]], k2[which[part]],
                              at.astype(np.int32)))
            if not parts:
                continue
            c = _combined([np.concatenate(x) for x in zip(*parts)])
            c[0], c[1] = c[0].view(np.int64), c[1].view(np.int64)
            yield pa.record_batch([pa.array(x) for x in c], names=_NAMES)

    return rows.select("k1", "k2", F.encode("t", "UTF-8").alias("t")).mapInArrow(run, _BLOCK)


def _judge(batches: Iterator, hot: np.ndarray) -> Iterator:
    """Sorted blocks -> those that repeat as a whole, and one of each of the
    different texts around a gram: OPEN if it is there once, else PARTNER."""
    import pyarrow as pa

    def runs(c: list[np.ndarray]):
        gram_new = np.concatenate(([True], c[0][1:] != c[0][:-1]))
        text_new = gram_new.copy()
        for x in c[1:4]:
            text_new[1:] |= x[1:] != x[:-1]
        text_of = np.cumsum(text_new) - 1
        gram_of = np.cumsum(gram_new)[text_new] - 1  # of each text
        copies = np.bincount(text_of, np.where(c[7] == PARTNER, 2, 1))
        several = (np.bincount(gram_of)[gram_of] > 1) | np.isin(c[0][text_new], hot)
        whole = np.flatnonzero((copies[text_of] > 1) & (c[7] == SINGLE))
        rep = np.flatnonzero(text_new)[several]
        pick = np.concatenate((whole, rep))
        kind = np.concatenate((np.full(len(whole), REPEATED, np.int32),
                               np.where(copies[several] > 1, PARTNER, OPEN).astype(np.int32)))
        return record([*[x[pick] for x in c[:7]], kind])

    def record(c):
        return pa.record_batch([pa.array(x) for x in c], names=_NAMES)

    held = None
    for batch in batches:
        c = [batch.column(k).to_numpy() for k in range(len(_NAMES))]
        known = c[7] == REPEATED
        if known.any():
            yield record([x[known] for x in c])
            c = [x[~known] for x in c]
        if held is not None:
            c = [np.concatenate(x) for x in zip(held, c)]
        if not len(c[0]):
            continue
        cut = len(c[0]) - int(np.argmax(np.append(c[0][::-1] != c[0][-1], True)))
        if cut:
            yield runs([x[:cut] for x in c])
        held = [x[cut:] for x in c]
    if held is not None and len(held[0]):
        yield runs(held)


def _packed(text: Column) -> Column:
    """UTF-8 bytes, compressed for the shuffle."""
    @F.arrow_udf(T.BinaryType())
    def run(column):
        import pyarrow as pa
        import zstandard
        pack = zstandard.ZstdCompressor(level=1).compress
        return pa.array([pack((x.as_py() or "").encode()) for x in column], pa.binary())

    return run(text)


_CELL = "h1 long, h2 long, before binary, after binary, kind int, k1 long, k2 long, at int"


def _cells(joined: DataFrame, window: int) -> DataFrame:
    """The cells of each judged block: (name of the shared part, the bytes
    before and after it, its place)."""
    def run(batches):
        import pyarrow as pa
        import zstandard
        from xxhash import xxh3_128_digest
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for z, k1, k2, c in zip(batch.column("z"), batch.column("k1").to_pylist(),
                                    batch.column("k2").to_pylist(), batch.column("c")):
                text = unpack(z.as_py())
                for b in c.as_py():
                    gram, off, n, kind = b["gram"], b["off"], b["n"], b["kind"]
                    place, head = b["start"] + off, gram.to_bytes(8, "little", signed=True)
                    low = off - n + 1
                    for cell in range(low // CELL, off // CELL + 1):
                        at = place - CELL * cell
                        stop = at + window - CELL + 1
                        a, z_ = max(low, CELL * cell), min(off, CELL * cell + CELL - 1)
                        rows.append((xxh3_128_digest(head + bytes([cell]) + text[at:stop]),
                                     text[place - z_:at], text[stop:place - a + window], kind, k1, k2, at))
                    if len(rows) > 50_000:
                        yield record(rows)
                        rows = []
            yield record(rows)

    def record(rows):
        import pyarrow as pa
        names = np.frombuffer(b"".join(r[0] for r in rows), np.int64).reshape(-1, 2)
        before, after, kind, k1, k2, at = zip(*[r[1:] for r in rows]) if rows else ((),) * 6
        return pa.record_batch([
            pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(before, pa.binary()), pa.array(after, pa.binary()),
            pa.array(kind, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(at, pa.int32())],
            names=["h1", "h2", "before", "after", "kind", "k1", "k2", "at"])

    return joined.select("z", "k1", "k2", "c").mapInArrow(run, _CELL)


_FOUND = "k1 long, k2 long, start int, n int, w1 long, w2 long, weight int"


def _compare(batches: Iterator) -> Iterator:
    """Cells sorted by name -> repeated windows (k1, k2, start, n). The
    windows of a long run are passed on with their names (w1, w2) instead;
    ``weight`` is then 1 for those of an OPEN block, 2 for a PARTNER's."""
    import pyarrow as pa
    from xxhash import xxh3_128_digest

    def windows(before, after):
        for r in range(CELL - 1 - len(after), len(before) + 1):
            yield r, before[len(before) - r:], after[:CELL - 1 - r]

    def found(run: list[tuple]):
        hit = np.zeros((CELL, len(run)), bool)
        for r in range(CELL):  # one place of the window at a time, so that few names are held
            seen: dict[bytes, int] = {}
            names = [b[len(b) - r:] + a[:CELL - 1 - r] if CELL - 1 - len(a) <= r <= len(b) else None
                     for b, a, *_ in run]
            for name, row in zip(names, run):
                if name is not None:
                    seen[name] = seen.get(name, 0) + (2 if row[2] == PARTNER else 1)
            hit[r] = [name is not None and row[2] == OPEN and seen[name] > 1 for name, row in zip(names, run)]
        edge = np.diff(np.concatenate((np.zeros((1, len(run)), np.int8), hit, np.zeros((1, len(run)), np.int8))), axis=0)
        up, down = np.nonzero(edge.T > 0), np.nonzero(edge.T < 0)  # each row's spans, in order
        for i, from_, to in zip(up[0].tolist(), up[1].tolist(), down[1].tolist()):
            _, _, _, k1, k2, at = run[i]
            yield k1, k2, at - to + 1, to - from_, None, None, None

    def passed_on(run: list[tuple], name: tuple[int, int]):
        head = b"".join(x.to_bytes(8, "little", signed=True) for x in name)
        for before, after, kind, k1, k2, at in run:
            for r, b, a in windows(before, after):
                w = xxh3_128_digest(head + bytes([r]) + b + a)
                yield (k1, k2, at - r, 1, int.from_bytes(w[:8], "little", signed=True),
                       int.from_bytes(w[8:], "little", signed=True), 2 if kind == PARTNER else 1)

    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    names = ["k1", "k2", "start", "n", "w1", "w2", "weight"]

    def record(rows):
        columns = zip(*rows) if rows else ((),) * 7
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    run, name, long_run, out = [], None, False, []

    def close():
        if long_run:
            out.extend(passed_on(run, name))
        elif len(run) > 1:
            out.extend(found(run))

    for batch in batches:
        c = [batch.column(k).to_pylist() for k in range(8)]
        for h1, h2, *row in zip(*c):
            if (h1, h2) != name:
                close()
                run, name, long_run = [], (h1, h2), False
            run.append(row)
            if len(run) > RUN_ROWS or long_run and len(run) >= 1000:
                out.extend(passed_on(run, name))
                run, long_run = [], True
                if len(out) > 50_000:
                    yield record(out)
                    out.clear()
        yield record(out)
        out.clear()
    close()
    yield record(out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = 200) -> DataFrame:
    """``docs`` with ``kept`` (the bytes that stay), ``n_bytes``,
    ``n_removed`` and ``n_spans`` (maximal removed runs)."""
    if not GRAM + CELL <= window <= 256:
        raise ValueError("window must be from 48 to 256 bytes")  # offsets are named by one byte
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ident = F.col(f"`{id_col}`")
    k1, k2 = F.xxhash64(ident, text), F.xxhash64(F.lit(1), ident, text)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("t"))
    # frequent grams, from a sample; exactness does not depend on it
    some = blocks(rows.where(F.pmod("k1", F.lit(HOT_SAMPLE)) == 0), window).where(F.col("kind") != REPEATED).groupBy("gram").agg(F.count("*").alias("n"))
    some = checkpointed(some)
    least = max(HOT_LEAST, (some.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot = np.array(sorted(r["gram"] for r in some.where(F.col("n") > least).select("gram").collect()), np.int64)
    is_hot = F.col("gram").isin([int(g) for g in hot]) if len(hot) else F.lit(False)
    salt = F.when(is_hot, F.pmod("whole", F.lit(HOT_PARTS))).otherwise(0)
    judged = checkpointed(
        blocks(rows, window).withColumn("salt", salt).repartition("gram", "salt")
        .sortWithinPartitions("gram", "whole", "n", "off").drop("salt")
        .mapInArrow(lambda it: _judge(it, hot), _BLOCK))
    z, ka, kb = fresh(docs, "z"), fresh(docs, "ka"), fresh(docs, "kb")
    kept_cols = [c for c in docs.columns if c.lower() != text_col.lower()]
    carried = docs.select("*", k1.alias(ka), k2.alias(kb), _packed(text).alias(z)).drop(text_col)
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), _packed(text).alias("z"))

    def with_text(reps: DataFrame) -> DataFrame:
        per_doc = reps.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "off", "n", "kind", "start")).alias("c"))
        return texts.join(per_doc, ["k1", "k2"])

    reps = judged.where(F.col("kind") != REPEATED)
    merged = checkpointed(_cells(with_text(reps), window).repartition("h1", "h2").sortWithinPartitions("h1", "h2")
                          .mapInArrow(_compare, _FOUND))
    named = merged.where("w1 is not null")
    twice = named.groupBy("w1", "w2").agg(F.sum("weight").alias("w")).where("w > 1").select("w1", "w2")
    spans = judged.where(F.col("kind") == REPEATED).select("k1", "k2", "start", "n")
    for more in (merged.where("w1 is null"), named.where("weight = 1").join(twice, ["w1", "w2"], "left_semi")):
        spans = spans.unionByName(more.select("k1", "k2", "start", "n"))
    per_doc = spans.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(
        F.collect_list(F.struct("start", "n")).alias("_c"))
    joined = carried.join(per_doc, (F.col(ka) == F.col("_k1")) & (F.col(kb) == F.col("_k2")), "left")

    @F.arrow_udf(T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()),
                               T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())]))
    def cut(packed, found):
        import pyarrow as pa
        import zstandard
        unpack = zstandard.ZstdDecompressor().decompress
        out = []
        for p, f in zip(packed, found):
            data, spans_ = unpack(p.as_py()), f.values
            if spans_ is None or not len(spans_):
                out.append((data, len(data), 0, 0))
                continue
            start = spans_.field("start").to_numpy()
            stop = start + spans_.field("n").to_numpy() + window - 1
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, start, 1)
            np.add.at(change, stop, -1)
            gone = np.cumsum(change[:-1]) > 0
            edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((np.frombuffer(data, np.uint8)[~gone].tobytes(), len(data), int(gone.sum()), edges))
        kept, *numbers = zip(*out) if out else ((),) * 4
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in numbers]],
                                          names=["kept", "n_bytes", "n_removed", "n_spans"])

    got = fresh(docs, "got")
    done = joined.withColumn(got, cut(F.col(z), F.col("_c")))
    new = ["kept", "n_bytes", "n_removed", "n_spans"]
    return done.select(*[F.col(f"`{c}`") for c in kept_cols if c.lower() not in new],
                       *[F.col(got)[c].alias(c) for c in new])
