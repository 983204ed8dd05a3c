"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece exactly one token can be the last token of the
prefix's encoding. ``PieceTable`` stores that token for each prefix. A token
ending at byte ``e`` and starting at byte ``s`` is that token iff it may
follow the last token of the prefix ``[:s]``, that is, iff merging the two
tokens' bytes on their own would not cross the border between them. Reading
the table backwards gives the encoding; appending bytes extends the table
and never changes what stands in it, and after an edit only the entries from
the edit on are computed again, until they meet the old ones.

Cases: null text encodes like the empty text (no ids); null ids decode to no
bytes; repeated rows and rows without an id are encoded like any other; an
empty table gives an empty table; other columns are kept, and one with the
name of an output column is replaced.
"""

from __future__ import annotations

import base64
import pickle
import struct
from itertools import accumulate, chain

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import worker_cache
from tessera.llm.hashed_words import _powers, mixed, text_slices

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: stretches whose ids a worker keeps (some 50 bytes each, 25 MB in all), the
#: ids it holds for them, and the longest stretch (in bytes) that it keeps
MEMO_STRETCHES, MEMO_IDS, MEMO_BYTES = 500_000, 2_000_000, 48
#: bytes of texts whose unknown stretches are learnt together
GROUP = 1 << 20
#: pieces that are encoded together (their tables take some 700 bytes each)
PIECES = 1 << 15
#: token pairs whose compatibility a worker keeps
MEMO_PAIRS = 100_000


def read_ranks(spark, path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` rank file (one line per token: base64 and rank)."""
    if "://" in path:
        lines = [r[0] for r in spark.read.text(path).collect()]
    else:
        with open(path, encoding="ascii") as f:
            lines = f.read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _halves(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens whose merge makes ``piece``; None if merging its bytes
    by lower ranks does not end in two tokens (it can't then be made)."""
    own, parts = ranks[piece], [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 2:
        best = min(((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))),
                   default=(own, 0))
        if best[0] >= own:
            return None
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return ranks[parts[0]], ranks[parts[1]]


class Vocabulary:
    """Ranks with each token's halves; plain data, so it can be broadcast."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} single bytes are no tokens")
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.made: dict[tuple[int, int], int] = {}
        #: tokens that merging can reach, by their bytes
        self.reach: dict[bytes, int] = {}
        self.longest = 1
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
            if len(piece) > 1:
                halves = _halves(piece, ranks)
                if halves is None:
                    continue
                self.left[rank], self.right[rank] = halves
                self.made[halves] = rank
            self.reach[piece] = rank
            self.longest = max(self.longest, len(piece))
        self._pairs: dict[int, bool] = {}

    def __getstate__(self):
        return {**self.__dict__, "_pairs": {}}

    def follows(self, a: int, b: int) -> bool:
        """Whether ``b`` may come right after ``a`` in an encoding."""
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._border_holds(a, b)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        """Undo merges on both sides of the border, the latest first, and see
        whether the two parts at the border would have merged before that."""
        left, right, made, limit = self.left, self.right, self.made, len(self.left) + 1
        while True:
            whole = made.get((a, b))
            if whole is not None and whole < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:  # a single byte: only b is left to undo
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True


class PieceTable:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, data, []
        self._extend(0)

    def _last_token(self, end: int) -> int:
        v, data, last = self.vocabulary, self.data, self.last
        reach, follows = v.reach, v.follows
        for start in range(max(0, end - v.longest), end):
            token = reach.get(data[start:end])
            if token is not None and (start == 0 or follows(last[start - 1], token)):
                return token
        raise AssertionError("no token ends here")  # single bytes are tokens

    def _extend(self, start: int) -> None:
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._last_token(end))

    def append(self, more: bytes) -> None:
        """Exact: no earlier entry changes."""
        start, self.data = len(self.data), self.data + more
        self._extend(start)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes ``start:stop``; the number of
        entries computed again. An entry depends on the ``longest`` entries
        before it only, so the old tail is kept once that many agree."""
        old, tail = self.last, len(self.data) - stop
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start]
        agree, need, done = 0, self.vocabulary.longest, 0
        for end in range(start + 1, len(self.data) + 1):
            back = len(self.data) - end  # bytes after this prefix
            token = self._last_token(end)
            self.last.append(token)
            done += 1
            # the entry of the old prefix that ends at the same byte of the tail
            agree = agree + 1 if back < tail and token == old[len(old) - back - 1] else 0
            if agree >= need:
                self.last += old[len(old) - back:] if back else []
                break
        return done

    def ids(self) -> list[int]:
        out, end, bytes_of = [], len(self.data), self.vocabulary.bytes_of
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(bytes_of[token])
        return out[::-1]


class _Table:
    """64-bit keys -> ids, looked up for whole arrays (open addressing)."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray):
        bits = max(4, int(len(keys) * 8).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.probes, left, step = 0, np.arange(len(keys)), 0
        home = (mixed(keys) >> self.shift).astype(np.int64)
        while len(left):
            slot = (home[left] + step) & self.mask
            free = np.flatnonzero(self.ids[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self.keys[slot[take]], self.ids[slot[take]] = keys[left[take]], ids[left[take]]
            left, step = np.delete(left, take), step + 1
        self.probes = step

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = (mixed(keys) >> self.shift).astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            here, at = self.ids[slot], self.keys[slot] == keys[open_]
            hit = at & (here >= 0)
            out[open_[hit]] = here[hit]
            on = ~at & (here >= 0)  # an empty slot ends the search
            open_, slot = open_[on], (slot[on] + 1) & self.mask
            if not len(open_):
                break
        return out


class PieceBatch:
    """The same tables for many pieces at once, column by column in numpy:
    all pieces of one length are extended by one byte together. Substrings
    are looked up by 64-bit polynomial hashes; the vocabulary is checked for
    collisions once, and every token that is found is compared with the
    piece's bytes."""

    #: longer pieces get a table of their own
    LONGEST = 32

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.power = np.cumprod(np.full(self.LONGEST + 1, _BASE))
        tokens = [(t, i) for t, i in vocabulary.reach.items() if len(t) <= self.LONGEST]
        keys = np.array([self._hash(t) for t, _ in tokens], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two tokens share a hash")
        self.tokens = _Table(keys, np.array([i for _, i in tokens], np.int32))
        made = vocabulary.made
        self.made = _Table(np.array([a << 32 | b for a, b in made], np.uint64),
                           np.array(list(made.values()), np.int32))
        self.left, self.right = np.array(vocabulary.left), np.array(vocabulary.right)
        self.length = np.array([len(x) for x in vocabulary.bytes_of])
        self.bytes_of = np.zeros((len(self.length), self.LONGEST), np.uint8)
        for t, i in tokens:
            self.bytes_of[i, :len(t)] = np.frombuffer(t, np.uint8)

    @staticmethod
    def _hash(data: bytes) -> int:
        h = 0
        for b in data:
            h = (h * int(_BASE) + b + 1) & (1 << 64) - 1
        return h

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Vocabulary.follows`` for arrays of pairs."""
        out, at = np.zeros(len(a), bool), np.arange(len(a))
        a, b, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), len(self.left) + 1)
        while len(at):
            whole = self.made.find((a << 32 | b).view(np.uint64))
            on = ~((whole >= 0) & (whole < limit))
            at, a, b, limit = at[on], a[on], b[on], limit[on]
            first = a > b
            # undo the later merge of the two; a single byte has none, then the other's
            ends = np.zeros(len(at), bool)
            for turn in (0, 1):
                left_side = first if turn == 0 else stuck & ~first
                right_side = ~first if turn == 0 else stuck & first
                new_a, new_b = self.right[a], self.left[b]
                stay_a, stay_b = left_side & (new_a == a), right_side & (new_b == b)
                limit = np.where(left_side, a, np.where(right_side, b + 1, limit))
                a, b = np.where(left_side, new_a, a), np.where(right_side, new_b, b)
                stuck = stay_a | stay_b
                if turn:
                    ends = stuck
            out[at[ends]] = True
            at, a, b, limit = at[~ends], a[~ends], b[~ends], limit[~ends]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        short = sorted((k for k, p in enumerate(pieces) if 0 < len(p) <= self.LONGEST), key=pieces.__getitem__)
        for k, p in enumerate(pieces):
            if len(p) > self.LONGEST:
                ids = PieceTable(self.vocabulary, p).ids()
                out[k] = struct.pack(f"<{len(ids)}I", *ids)
        for at in range(0, len(short), PIECES):
            part = short[at:at + PIECES]
            length = np.array([len(pieces[k]) for k in part])
            data = np.zeros((len(part), int(length.max())), np.uint8)
            data[np.arange(data.shape[1]) < length[:, None]] = np.frombuffer(
                b"".join([pieces[k] for k in part]), np.uint8)
            for k, ids in zip(part, self._ids(self._last(data, length), length)):
                out[k] = ids
        return out

    def _last(self, data: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(prefix, piece) last tokens; row 0 is not used. Pieces come in the
        order of their bytes, so pieces with a common prefix stand together,
        and the last token of a prefix is found once for all of them."""
        m, n = data.shape
        last = np.full((n + 1, m), -1, np.int32)
        differ = np.concatenate((data[1:] != data[:-1], np.ones((m - 1, 1), bool)), axis=1)
        shared = np.concatenate(([0], np.minimum(differ.argmax(axis=1), np.minimum(length[1:], length[:-1]))))
        order = np.arange(m)
        ending = np.zeros((n, m), np.uint64)  # hash of bytes start:end, by start
        column = np.ascontiguousarray(data.T).astype(np.uint64) + np.uint64(1)
        for end in range(1, n + 1):
            first = np.maximum.accumulate(np.where(shared < end, order, 0))  # of the pieces with this prefix
            rows = np.flatnonzero((shared < end) & (length >= end))
            # hashes are needed where a later prefix is still looked up
            live = np.flatnonzero(length >= end)
            if len(live) < m:
                ending[:end, live] = ending[:end, live] * _BASE + column[end - 1, live]
            else:
                ending[:end] *= _BASE
                ending[:end] += column[end - 1]
            open_ = rows
            for start in range(max(0, end - self.vocabulary.longest), end):
                token = self.tokens.find(ending[start, open_])
                have = np.flatnonzero(token >= 0)
                if not len(have):
                    continue
                row, token = open_[have], token[have]
                good = (self.length[token] == end - start)
                good &= (self.bytes_of[token, :end - start] == data[row, start:end]).all(axis=1)
                if start:
                    good[good] = self.follows(last[start, row[good]], token[good])
                last[end, row[good]] = token[good]
                open_ = np.delete(open_, have[good])
                if not len(open_):
                    break
            last[end] = np.where(length >= end, last[end, first], -1)
        return last

    def _ids(self, last: np.ndarray, length: np.ndarray) -> list[bytes]:
        """Reads each piece's table backwards, all pieces a token at a time."""
        n, m = last.shape[0] - 1, last.shape[1]
        ids, count = np.zeros((m, n), "<u4"), np.zeros(m, np.int64)
        row, at, k = np.arange(m), length.copy(), 0
        while len(row):
            k += 1
            token = last[at, row]
            ids[row, n - k] = token
            count[row] = k
            at = at - self.length[token]
            row, at = row[at > 0], at[at > 0]
        flat = ids.tobytes()
        return [flat[4 * ((r + 1) * n - c):4 * (r + 1) * n] for r, c in enumerate(count.tolist())]


class _Memo:
    """Ids of stretches under two 64-bit hashes, in flat arrays: an open
    table of the first hash, the second one, and the ids in one pool. When it
    is full, the half that was met most often stays, with its counts halved."""

    def __init__(self):
        self.n, self.slots = 0, np.zeros(1 << 16, np.int32)  # entry + 1
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.met, self.listed = np.zeros(0, np.int32), np.zeros(0, bool)
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0

    def _home(self, first: np.ndarray) -> np.ndarray:
        return (first >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _insert(self, entries: np.ndarray) -> None:
        mask, left, step = len(self.slots) - 1, entries, 0
        home = self._home(self.first[left])
        while len(left):
            slot = (home + step) & mask
            free = np.flatnonzero(self.slots[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            take = free[one]
            self.slots[slot[take]] = left[take] + 1
            left, home, step = np.delete(left, take), np.delete(home, take), step + 1

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The entry of each pair of hashes, -1 if it is not known."""
        out, open_ = np.full(len(first), -1, np.int64), np.arange(len(first))
        slot, mask = self._home(first), len(self.slots) - 1
        while len(open_):
            entry = self.slots[slot].astype(np.int64) - 1
            some = entry >= 0
            open_, slot, entry = open_[some], slot[some], entry[some]
            hit = (self.first[entry] == first[open_]) & (self.second[entry] == second[open_])
            out[open_[hit]] = entry[hit]
            open_, slot = open_[~hit], (slot[~hit] + 1) & mask
        return out

    def _room(self, name: str, used: int, more: int) -> None:
        """Lengthens an array by half when ``more`` entries don't fit, so it
        is seldom copied."""
        old = getattr(self, name)
        if used + more > len(old):
            new = np.zeros(max(used + more, len(old) + len(old) // 2), old.dtype)
            new[:used] = old[:used]
            setattr(self, name, new)

    def add(self, first: np.ndarray, second: np.ndarray, rows: list[bytes], listed: np.ndarray) -> np.ndarray:
        """New entries; those not ``listed`` can't be found later."""
        size = np.array([len(r) // 4 for r in rows], np.int32)
        total, own = int(size.sum()), np.arange(self.n, self.n + len(rows))
        self._room("pool", self.used, total)
        self.pool[self.used:self.used + total] = np.frombuffer(b"".join(rows), "<u4")
        at = self.used + np.cumsum(size) - size
        for name, more in (("first", first), ("second", second), ("start", at), ("size", size),
                           ("met", 1), ("listed", listed)):
            self._room(name, self.n, len(rows))
            getattr(self, name)[self.n:self.n + len(rows)] = more
        self.n, self.used = self.n + len(rows), self.used + total
        if 2 * self.n > len(self.slots):
            self.slots = np.zeros(1 << (4 * self.n).bit_length(), np.int32)
            self._insert(np.flatnonzero(self.listed[:self.n]))
        else:
            self._insert(own[listed])
        return own

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the entries one after the other, how many each has)."""
        size = self.size[entries].astype(np.int64)
        upto = np.cumsum(size)
        return self.pool[np.repeat(self.start[entries] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)], size

    def shrink(self) -> None:
        if self.n <= MEMO_STRETCHES and self.used <= MEMO_IDS:
            return
        order = np.flatnonzero(self.listed[:self.n] & (self.met[:self.n] > 1))
        order = order[np.argsort(-self.met[order], kind="stable")][:MEMO_STRETCHES // 2]
        keep = order[np.cumsum(self.size[order]) <= MEMO_IDS // 2]
        old, (ids, _) = self, self.gather(keep)
        first, second, size, met = old.first[keep], old.second[keep], old.size[keep], old.met[keep] // 2
        self.__init__()
        raw, stop = ids.tobytes(), (4 * np.cumsum(size)).tolist()
        rows = [raw[a:b] for a, b in zip([0, *stop], stop)]
        self.add(first, second, rows, np.ones(len(rows), bool))
        self.met[:self.n] = met


def _white() -> tuple[np.ndarray, dict[bytes, list[tuple[int, int]]]]:
    """ASCII bytes that are white space to some engine, and for the first
    bytes of longer white space the ranges of their last byte."""
    ascii_ = np.zeros(256, bool)
    ascii_[[*range(9, 14), *range(28, 33)]] = True
    wide = {b"\xc2": [(0x85, 0x85), (0xA0, 0xA0)], b"\xe1\x9a": [(0x80, 0x80)], b"\xe1\xa0": [(0x8E, 0x8E)],
            b"\xe2\x80": [(0x80, 0x8F), (0xA8, 0xAF)], b"\xe2\x81": [(0x9F, 0x9F)], b"\xe3\x80": [(0x80, 0x80)]}
    return ascii_, wide


_ASCII_WHITE, _WIDE_WHITE = _white()
_CODES = np.random.default_rng(5).integers(1, 1 << 63, (2, 256)).astype(np.uint64)


def _stretches(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where stretches begin: at each text's start, and at each single space
    between two characters of a text that are not white space."""
    white = _ASCII_WHITE[data]
    for head, ranges in _WIDE_WHITE.items():
        at = np.flatnonzero(data[:len(data) - len(head)] == head[0]) if len(data) > len(head) else np.zeros(0, np.int64)
        if len(head) > 1:
            at = at[data[at + 1] == head[1]]
        tail = data[at + len(head)]
        for low, high in ranges:
            some = at[(tail >= low) & (tail <= high)]
            for k in range(len(head) + 1):
                white[some + k] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    space = np.flatnonzero(data[1:-1] == 32) + 1
    space = space[~(white[space - 1] | white[space + 1] | edge[space] | edge[space + 1])]
    edge[space] = True
    return np.flatnonzero(edge[:-1])


class Encoder:
    """Encodes whole texts: each match of the pattern on its own.

    A single space between two characters that are not white space always
    begins a match, so a text is cut there first and the ids of each stretch
    are kept under two hashes of its bytes; unknown stretches are matched,
    and their pieces are encoded together. Stretches are found, looked up
    and put together for many texts at once, in numpy."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.batch = PieceBatch(vocabulary)
        #: whether the pattern takes letters with the space before them, and marks apart
        self.plain = [self.split(x) for x in (" ab", " ab,", " \xe9.")] == [[" ab"], [" ab", ","], [" \xe9", "."]]
        self.memo = _Memo()

    def _pieces(self, stretch: str) -> list[str]:
        """The pattern's matches; two common shapes need no matching: a space
        and letters, and the same with one mark behind it."""
        word = stretch[1:]
        if self.plain and stretch[:1] == " ":
            if word.isalpha():
                return [stretch]
            if word[-1:] in ",.;:!?" and word[:-1].isalpha():
                return [stretch[:-1], word[-1]]
        return self.split(stretch)

    def _learn(self, stretches: list[str]) -> list[bytes]:
        """The ids of stretches, in their order; some at a time, as the
        pieces of all would take many times the stretches' bytes."""
        return [ids for at in range(0, len(stretches), 2 * PIECES) for ids in self._learn_some(stretches[at:at + 2 * PIECES])]

    def _learn_some(self, stretches: list[str]) -> list[bytes]:
        found = list(map(self._pieces, stretches))
        new = list(set(chain.from_iterable(found)))
        ranks = self.vocabulary.ranks
        data = [p.encode() for p in new]
        whole = [ranks.get(d) for d in data]
        made = iter(self.batch.encode([d for d, w in zip(data, whole) if w is None]))
        known = {p: struct.pack("<I", w) if w is not None else next(made) for p, w in zip(new, whole)}
        return [known[ps[0]] if len(ps) == 1 else b"".join(map(known.__getitem__, ps)) for ps in found]

    def _hashed(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(begin, end, two hashes) of the stretches of one slice."""
        begin = _stretches(data, starts)
        end = np.append(begin[1:], len(data))
        power, inverse = _powers(len(data))
        out = [begin, end]
        for codes in _CODES:
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes[data] * power[:len(data)])))
            out.append(mixed((total[end] - total[begin]) * inverse[begin]))
        return tuple(out)

    def encode_slices(self, slices: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
        """The ids of each text of the slices as little-endian integers."""
        memo = self.memo
        memo.shrink()
        parts = [self._hashed(data, starts) for data, starts in slices]
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        first, second = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64) for k in (2, 3))
        size = np.concatenate([p[1] - p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        entry = memo.find(first, second)
        entry[size > MEMO_BYTES] = -1
        unknown = np.flatnonzero(entry < 0)
        if len(unknown):
            # one of each: equal in both hashes, and never a long one for another
            pair = first[unknown] ^ mixed(second[unknown])
            pair[size[unknown] > MEMO_BYTES] = np.flatnonzero(size[unknown] > MEMO_BYTES)
            _, one, same = np.unique(pair, return_index=True, return_inverse=True)
            chosen = unknown[one]
            texts, of = [], np.searchsorted(base, chosen, "right") - 1
            order = np.argsort(of, kind="stable")  # slice by slice
            for s, ((data, _), (begin, end, *_)) in enumerate(zip(slices, parts)):
                own = chosen[order[np.searchsorted(of[order], s):np.searchsorted(of[order], s, "right")]] - base[s]
                raw = data.tobytes()
                texts += [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin[own].tolist(), end[own].tolist())]
            chosen = chosen[order]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            same = rank[same]
            entry[unknown] = memo.add(first[chosen], second[chosen], self._learn(texts), size[chosen] <= MEMO_BYTES)[same]
        np.add.at(memo.met, entry, 1)
        ids, count = memo.gather(entry)
        raw, upto, out = ids.tobytes(), np.concatenate(([0], np.cumsum(count))), []
        for (data, starts), (begin, *_), at in zip(slices, parts, base.tolist()):
            border = (4 * upto[at + np.searchsorted(begin, starts)]).tolist()
            out += [raw[a:b] for a, b in zip(border, border[1:])]
        return out

    def encode_texts(self, texts) -> list[bytes]:
        """The ids of an Arrow string array, some ``GROUP`` bytes at a time."""
        out, part, size = [], [], 0
        for data, starts in text_slices(texts):
            part.append((data, starts))
            size += len(data)
            if size >= GROUP:
                out += self.encode_slices(part)
                part, size = [], 0
        return out + self.encode_slices(part) if part else out

    def encode(self, text: str | None) -> bytes:
        data = np.frombuffer((text or "").encode(), np.uint8)
        return self.encode_slices([(data, np.array([0, len(data)]))])[0]

    def append(self, text: str, ids: bytes, more: str, keep_back: int = 3) -> bytes:
        """The ids of ``text + more`` from those of ``text``. New text can
        change the extent of the last pieces only (a contraction takes two
        letters after its mark), so all but the last few are kept."""
        pieces = self.split(text)
        kept = pieces[:-keep_back]
        n = sum(map(len, self._learn(kept))) if kept else 0
        return ids[:n] + self.encode("".join(pieces[len(kept):]) + more)

    def decode(self, ids: bytes | None) -> bytes:
        if not ids:
            return b""
        return b"".join(map(self.vocabulary.bytes_of.__getitem__,
                            struct.unpack(f"<{len(ids) // 4}I", ids)))


def _encoder(shared, key: str, pattern: str) -> Encoder:
    """One encoder a Python worker, so its memos serve all its tasks."""
    cache = worker_cache("byte_bpe")
    if (key, pattern) not in cache:
        cache.clear()
        cache[key, pattern] = Encoder(pickle.loads(shared.value), pattern)
    return cache[key, pattern]


def _blocks(rows: list[bytes]):
    """Results as an Arrow array of at most 2 GB of bytes in one buffer."""
    import pyarrow as pa
    total = list(accumulate(map(len, rows), initial=0))
    if total[-1] >= 2 ** 31:
        raise ValueError("a batch has over 2 GB of results: lower maxRecordsPerBatch")
    return pa.array(rows, pa.binary())


class ByteBpe:
    """Encodes and decodes columns with one vocabulary, broadcast once (its
    size is that of the rank file, whatever the data)."""

    def __init__(self, spark, path: str, pattern: str):
        from uuid import uuid4
        self.pattern, self.key = pattern, uuid4().hex
        self.shared = spark.sparkContext.broadcast(cloudpickle.dumps(Vocabulary(read_ranks(spark, path))))

    def encode(self, df: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """``df`` with ``ids``: the text's ids as little-endian unsigned
        32-bit integers."""
        shared, key, pattern = self.shared, self.key, self.pattern

        @F.arrow_udf(T.BinaryType())
        def run(texts):
            e = _encoder(shared, key, pattern)
            return _blocks(e.encode_texts(texts))

        return df.withColumn(ids, run(F.col(f"`{text}`").cast("string")))

    def decode(self, df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
        """``df`` with ``decoded``: the bytes that the ids stand for."""
        shared, key, pattern = self.shared, self.key, self.pattern

        @F.arrow_udf(T.BinaryType())
        def run(column):
            e = _encoder(shared, key, pattern)
            return _blocks([e.decode(x.as_py()) for x in column])

        return df.withColumn(decoded, run(F.col(f"`{ids}`")))
