"""Character n-grams of batches of texts as arrays of code points.

A gram is a position of the marked text; the different grams of a part of a
batch (some ten thousand) become strings, the positions stay numbers. Texts
are worked on in parts of about ``PART_POINTS`` code points."""

from __future__ import annotations

import numpy as np

PART_POINTS = 1 << 20
#: bits of a gram that a table of places can be indexed by
TABLE_BITS = 24
#: code points that ``str.split()`` splits at
SPACES = (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SPACE = np.zeros(0x3002, bool)
_SPACE[list(SPACES)] = True


def _is_space(points: np.ndarray) -> np.ndarray:
    return _SPACE[np.minimum(points, 0x3001)]


def _word_starts(space: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Code points that are no space and begin a text or follow a space."""
    edge = np.zeros(len(space) + 1, bool)
    edge[begins] = True
    edge[1:] |= np.append(space[:-1], True) if len(space) else True
    return np.flatnonzero(~space & edge[:-1])


def code_points(texts) -> tuple[np.ndarray, np.ndarray]:
    """The code points of an Arrow array of texts, and where each text begins
    (with the end of the last one); a null text has none."""
    import pyarrow as pa
    texts = pa.array(texts.to_pylist(), pa.large_string()) if texts.null_count else texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    raw = raw[ends[0]:ends[-1]].to_pybytes() if raw is not None else b""
    begins = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))[ends - ends[0]]
    return np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32), begins


def to_texts(points: np.ndarray, begins: np.ndarray):
    """The reverse."""
    import pyarrow as pa
    size = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[begins].astype(np.int32)
    raw = points.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    return pa.StringArray.from_buffers(len(begins) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(raw))


def parts(sizes: np.ndarray, most: int = PART_POINTS):
    """(first, last) of runs of rows of about ``most`` together."""
    total, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + most, "right")))
        yield first, last
        first = last


def grams(points: np.ndarray, begins: np.ndarray, n: int, start: str, end: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's words, marked by ``start`` and ``end``: the marked
    text, where its grams begin in it, and each text's number of grams."""
    a, e = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (start, end))
    space = _is_space(points)
    first = _word_starts(space, begins)
    kept = np.flatnonzero(~space)
    rank = np.searchsorted(kept, first)  # of a word's first code point
    size = np.diff(np.append(rank, len(kept))) + len(a) + len(e)
    at = np.concatenate(([0], np.cumsum(size)))
    marked = np.empty(at[-1], np.uint32)
    word = np.repeat(np.arange(len(first)), size - len(a) - len(e))
    marked[np.arange(len(kept)) + word * (len(a) + len(e)) + len(a)] = points[kept]
    for k, c in enumerate(a):
        marked[at[:-1] + k] = c
    for k, c in enumerate(e):
        marked[at[1:] - len(e) + k] = c
    held = np.maximum(size - n + 1, 0)
    whole = np.arange(len(marked)) + n <= np.repeat(at[1:], size)
    total = np.concatenate(([0], np.cumsum(held)))
    return marked, np.flatnonzero(whole), np.diff(total[np.searchsorted(first, begins)])


def different(marked: np.ndarray, places: np.ndarray, n: int, order: np.ndarray | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different grams at ``places``, each one's first place (a position
    in ``places``, or the least of ``order`` if given) and which one each place holds."""
    if not len(places):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(int(marked.max()) + 1, bool)
    seen[marked] = True
    index = (np.cumsum(seen) - 1)[marked]
    letters = int(seen.sum())
    bits = max(1, (letters - 1).bit_length())
    if bits * n <= 63:
        key = np.zeros(len(places), np.int64)
        for k in range(n):
            key = key << bits | index[places + k]
    else:
        key = index[places]
        for k in range(1, n):  # ranks of the beginnings, one code point longer each time
            key = np.unique(key * letters + index[places + k], return_inverse=True)[1].reshape(-1)
    turn = np.arange(len(places)) if order is None else np.argsort(order, kind="stable")
    if bits * n <= TABLE_BITS:
        table = np.full(1 << bits * n, -1, np.int32)
        table[key[turn[::-1]]] = turn[::-1]  # the last one written is the first
        some = np.flatnonzero(table >= 0)
        first = table[some].astype(np.int64)
        table[some] = np.arange(len(some))
        which = table[key]
    else:
        _, first, which = np.unique(key[turn], return_index=True, return_inverse=True)
        first, back = turn[first], np.empty(len(turn), np.int64)
        back[turn] = which.reshape(-1)
        which = back
    text = marked[places[first][:, None] + np.arange(n)].astype(np.uint32).tobytes().decode("utf-32-le")
    return [text[k:k + n] for k in range(0, len(text), n)], first, which


def rebuilt(points: np.ndarray, begins: np.ndarray, n: int, start: str, end: str) -> tuple[np.ndarray, np.ndarray]:
    """Texts of joined grams -> texts of words (see ``rebuild_ngram_words``);
    ``start`` and ``end`` are one character each."""
    keep = points != ord(start)
    begins = np.concatenate(([0], np.cumsum(keep)))[begins]
    points = points[keep]
    points = np.where(points == ord(end), np.uint32(32), points)
    space = _is_space(points)
    first = _word_starts(space, begins)
    at = np.flatnonzero(~space)
    word = np.searchsorted(first, at, "right") - 1
    k = at - first[word]
    stays = (k < n - 1) | ((k >= 2 * n - 2) & ((k - (n - 2)) % n == 0))
    at, word = at[stays], word[stays]
    row = np.searchsorted(begins, first, "right") - 1  # a word's text
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    gap = np.cumsum(~last) - ~last  # spaces before a word
    out = np.full(len(at) + int((~last).sum()), 32, np.uint32)
    out[np.arange(len(at)) + gap[word]] = points[at]
    size = np.bincount(row[word], minlength=len(begins) - 1) + np.bincount(row[~last], minlength=len(begins) - 1)
    return out, np.concatenate(([0], np.cumsum(size)))
