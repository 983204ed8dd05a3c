"""Fill-in-the-middle rewriting over a wavelet matrix of character classes.

Each byte of a text gets a class that tells white space, the bytes of a
word, the last byte of a word, bytes that only continue a code point, and the
last byte of white space that ends the text. A wavelet matrix answers how often a class stands before a
place; sums of such ranks count the token borders and the code points up to
any place, and bisection on the ranks finds the byte at which the k-th token
ends. A text is cut twice, at tokens drawn from its id alone, and its three
parts are put into suffix-first or prefix-first order between marks.

A token is a word with the white space before it, or the white space that
ends the text. All texts of an Arrow slice share one matrix.

Cases: null text is the empty text; an empty text, a text that holds one of
the marks, and a row without an id (nothing to draw from) stay plain; rows
with equal id and text get equal results; an empty table gives an empty
table; other columns are kept, and one with the name of an output column is
replaced. A long text is cut like any other, as a slice of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import SPACES, fresh
from tessera.llm.hashed_words import text_slices

MARKS = (b"<P>", b"<S>", b"<M>")
SPACE, INNER, LAST, MORE, MORE_LAST, TAIL = range(6)
LEVELS = 3
#: classes that end a token, and those that are no code point of their own
ENDS, CONTINUED = (LAST, MORE_LAST, TAIL), (MORE, MORE_LAST)
PARTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                      T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                      T.StructField("output", T.BinaryType())])


class WaveletMatrix:
    """Ranks of symbols below ``2 ** LEVELS`` in a sequence: one bit vector a
    level, with the ones before each 64-bit word counted."""

    def __init__(self, symbols: np.ndarray):
        self.levels = []
        for shift in range(LEVELS - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(len(bits) // 64 + 1, "<u8")
            words.view(np.uint8)[:len(packed)] = packed
            ones = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.levels.append((words, ones, len(bits) - int(ones[-1])))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))

    def rank(self, symbol: int, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each place."""
        at, begin = place, np.zeros(1, np.int64)
        for (words, ones, zeros), shift in zip(self.levels, range(LEVELS - 1, -1, -1)):
            up, up_begin = (ones[x >> 6] + np.bitwise_count(
                words[x >> 6] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1))) for x in (at, begin))
            at, begin = (zeros + up, zeros + up_begin) if symbol >> shift & 1 else (at - up, begin - up_begin)
        return at - begin

    def ranks(self, symbols, place: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, place) for s in symbols)

    def reaches(self, symbols, start: np.ndarray, stop: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The smallest place from ``start`` to ``stop`` before which the
        symbols stand ``k`` times, counted from ``start``: by bisection."""
        low, high, want = start.copy(), stop.copy(), self.ranks(symbols, start) + k
        while (low < high).any():
            middle = (low + high) >> 1
            there = self.ranks(symbols, middle) >= want
            low, high = np.where(there, low, np.minimum(middle + 1, high)), np.where(there, middle, high)
        return low


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte of the texts that begin at ``starts``."""
    space = np.isin(data, np.frombuffer(SPACES.encode(), np.uint8))
    more = data & 0xC0 == 0x80
    close = np.zeros(len(data), bool)  # the next byte is white space or another text's
    close[:-1] = space[1:]
    ends = starts[1:][starts[1:] > starts[:-1]] - 1
    close[ends] = True
    out = np.where(more, np.where(close, MORE_LAST, MORE), np.where(close, LAST, INNER)).astype(np.uint8)
    out[space] = SPACE
    out[ends[space[ends]]] = TAIL
    return out


def _cut_slice(data: np.ndarray, starts: np.ndarray, draws: list[np.ndarray], has_id: np.ndarray,
               fim_percent: int, spm_percent: int):
    matrix = WaveletMatrix(classes(data, starts))
    begin, stop = starts[:-1], starts[1:]
    n = matrix.ranks(ENDS, stop) - matrix.ranks(ENDS, begin)
    first, second = draws[0] % (n + 1), draws[1] % (n + 1)
    cuts = [matrix.reaches(ENDS, begin, stop, k) for k in (np.minimum(first, second), np.maximum(first, second))]
    back = [matrix.ranks(CONTINUED, x) for x in (begin, *cuts)]
    prefix = cuts[0] - begin - (back[1] - back[0])
    middle = cuts[1] - cuts[0] - (back[2] - back[1])
    raw, rows = data.tobytes(), []
    for k, (a, b, c, d) in enumerate(zip(begin.tolist(), cuts[0].tolist(), cuts[1].tolist(), stop.tolist())):
        text = raw[a:d]
        if not text or not has_id[k] or draws[2][k] % 100 >= fim_percent or any(m in text for m in MARKS):
            rows.append(("plain", None, None, text))
            continue
        p, m, s = raw[a:b], raw[b:c], raw[c:d]
        spm = draws[3][k] % 100 < spm_percent
        out = b"<S>" + s + b"<P>" + p + b"<M>" + m if spm else b"<P>" + p + b"<S>" + s + b"<M>" + m
        rows.append(("spm" if spm else "psm", int(prefix[k]), int(middle[k]), out))
    return n, rows


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42,
              fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``docs`` with ``n`` (tokens), ``form`` (plain, psm or spm),
    ``prefix_chars``, ``middle_chars`` and ``output``. The four draws are
    the first groups of eight hexadecimal digits of sha256("seed:id")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_col}`").cast("string")), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]

    @F.arrow_udf(PARTS)
    def run(texts, *hashes):
        import pyarrow as pa
        drawn = [h.fill_null(0).to_numpy(zero_copy_only=False) for h in hashes]
        known = ~hashes[0].is_null().to_numpy(zero_copy_only=False)
        counts, rows, at = [], [], 0
        for data, starts in text_slices(texts):
            to = at + len(starts) - 1
            n, more = _cut_slice(data, starts.astype(np.int64), [d[at:to] for d in drawn], known[at:to],
                                 fim_percent, spm_percent)
            counts.append(n)
            rows += more
            at = to
        column = lambda i, kind: pa.array([r[i] for r in rows], kind)
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(counts) if counts else [], pa.int64()), column(0, pa.string()),
             column(1, pa.int64()), column(2, pa.int64()), column(3, pa.binary())], fields=[
                pa.field(f.name, kind) for f, kind in zip(PARTS.fields, (pa.int64(), pa.string(), pa.int64(),
                                                                         pa.int64(), pa.binary()))])

    parts = fresh(docs, "parts")
    cut = docs.withColumn(parts, run(F.col(f"`{text_col}`").cast("string"), *draws))
    names = [f.name for f in PARTS.fields]
    # the struct is computed once; Arrow functions are not evaluated again for each field
    return cut.withColumns({c: F.col(parts)[c].cast("string") if c == "output" else F.col(parts)[c]
                            for c in names}).drop(parts)


def restored(output: Column, form: Column) -> Column:
    """The text from its rewritten form. No mark can begin in one part and
    end in the next (each begins with its only ``<``), so splitting at the
    marks gives back the parts."""
    parts = F.split(output, "<P>|<S>|<M>", -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))
