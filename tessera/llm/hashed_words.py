"""Words of whole texts as 64-bit hashes, over Arrow buffers with numpy.

A word is a run of bytes that are ASCII letters, digits or not ASCII; A-Z
are lower-cased. Hashes are polynomial prefix sums, so a batch costs a fixed
number of vector operations however many words it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: bytes of text that are hashed at once; one longer text is taken alone
SLICE = 1 << 18


def letter_table(keep: str = "") -> np.ndarray:
    """byte -> code of the lower-cased byte, 0 for a separator; ASCII
    characters in ``keep`` belong to words too."""
    out = np.arange(1, 257, dtype=np.uint64)
    for b in range(128):
        c = chr(b)
        if "A" <= c <= "Z":
            out[b] = out[ord(c.lower())]
        elif not (c.isalnum() or c in keep):
            out[b] = 0
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse: one array for
    all slices, a larger one for a longer text."""
    return _powers_of(max(SLICE, 1 << max(0, n - 1).bit_length()))


@lru_cache(maxsize=1)
def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return (np.concatenate((one, np.cumprod(np.full(n, _BASE)))),
            np.concatenate((one, np.cumprod(np.full(n, inverse)))))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of a polynomial hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(data: np.ndarray, starts: np.ndarray, table: np.ndarray,
          prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text); ``starts`` are
    the texts' offsets in ``data``, with the end as one more. With
    ``prefixes`` (numbers of bytes) the hashes have a column for the word
    and one for each of its beginnings."""
    code = table[data]
    inside = code != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    border = starts[:-1][starts[:-1] < len(data)]
    first[border] |= inside[border]
    begin = np.flatnonzero(first)
    if not len(begin):
        none = np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64)
        return none, np.zeros(len(starts) - 1, np.int64)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    end = starts[1:-1][(starts[1:-1] > 0)] - 1
    last[end] |= inside[end]
    stop = np.flatnonzero(last) + 1
    power, inverse = _powers(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * power[:len(data)])))
    hashes = mixed((total[stop] - total[begin]) * inverse[begin])
    if prefixes:
        heads = [mixed((total[np.minimum(stop, begin + k)] - total[begin]) * inverse[begin] + np.uint64(k))
                 for k in prefixes]
        hashes = np.stack((hashes, *heads), axis=1)
    return hashes, np.diff(np.searchsorted(begin, starts))


def text_slices(texts, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of an Arrow string array, some texts at a time; null
    is the empty text."""
    import pyarrow as pa
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to
