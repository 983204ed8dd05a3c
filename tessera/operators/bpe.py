"""Byte-pair vocabulary: word counts, training, encode, decode.

Training works on the *distinct word* table ``(cnt, syms ARRAY<INT>)`` —
never the corpus, never one task — in few rounds that accept many merges each:

1. pair counts: each task adds up the adjacent symbol pairs of its words,
   ``groupBy`` sums them, and the ``K + 1`` best by (count desc, left id,
   right id) come to the driver. ``S`` is the first ``K`` of them, ``p`` the
   one left out;
2. every word is cut into runs of symbols whose adjacent pairs are all in
   ``S``; equal runs are added up. ``K`` is halved until at most ``MAX_RUNS``
   different runs remain;
3. the driver merges within these runs, best pair first, as long as the best
   pair comes before ``p``. That is exact: a pair that merging creates stands
   where an adjacent pair of the round's start stood, so it is at most as
   frequent as that one. If that one is not in ``S`` the new pair is not more
   frequent than ``p``, and with an equal count its ids come after those of
   ``p`` (new ids are the largest), so it can't be next before ``p`` is. All
   pairs before ``p`` therefore lie inside runs with their full counts;
4. the accepted merges are applied to all words, which are written to the
   shared checkpoint folder.

Words shrink as training goes on. With room for ``R`` tokens beside the
alphabet, no pair less frequent than the ``R``-th most frequent word (the
floor) is ever merged: before that all those words are one token each, and
the room is used up. So step 4 also cuts the words where a pair under the
floor stands, drops single symbols and adds up equal pieces; by the argument
of step 3 a pair that arises at such a place later is under the floor too.
What a round reads then follows the tokens still to learn, not the words.

A merge that spells an existing token would make old pairs more frequent; it
would end a round and be applied alone. It does not come up: as long as no
merge crosses the edges of a token's place, what happens inside follows from
its characters alone, so a token arises from one pair only. Ids: the five
specials, then the alphabet in code-point order, then merges in order.

Encoding cuts special-token strings out first, pre-tokenises the rest
(``\\w+|[^\\w\\s]+``) and segments the pieces where the row is, with the
merge table broadcast (bounded by ``vocab_size``) and a bounded memo of
pieces; rows are neither exploded nor shuffled.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.constants import END, PAD, SPECIAL_TOKENS, START, UNK
from tessera.functions.text import SPLIT_TOKEN_RE, split_tokens
from tessera.session import cut_lineage

DEFAULT_VOCAB_SIZE = 500_000
WORDS_PER_TASK = 20_000
#: different runs of a round, and pairs of a round, that come to the driver
MAX_RUNS, MAX_PAIRS = 160_000, 1 << 17
#: pairs down to the floor that come to the driver; with more, a round does not cut
MAX_ALIVE = 1 << 20
#: pieces whose ids an encoding task keeps, and the longest of them
MEMO_PIECES, MEMO_CHARS = 200_000, 40


@dataclass
class BpeModel:
    vocab: DataFrame          # token string, id int
    merges: DataFrame         # rank int, left int, right int, merged int, token string
    size: int
    merge_list: list          # [(left, right, merged)] in rank order (bounded by vocab_size)
    alphabet: dict            # char -> id


# ------------------------------------------------------------------ K11
def pre_tokens(text: Column) -> Column:
    """K11 plus special-token extraction: special-token strings are split
    out first and kept whole; the rest is cut into ``\\w+|[^\\w\\s]+``."""
    specials = "|".join(t.replace("[", r"\[").replace("]", r"\]") for t in SPECIAL_TOKENS)
    pieces = F.split(text, f"(?=(?:{specials}))|(?<=(?:{specials}))")
    return F.flatten(F.transform(pieces, lambda p: F.when(
        p.isin(list(SPECIAL_TOKENS)), F.array(p)).otherwise(
        F.regexp_extract_all(p, F.lit(SPLIT_TOKEN_RE), 0))))


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Pre-tokenised word counts: the training input."""
    return df.select(F.explode(split_tokens(F.col(text_col))).alias("word")) \
             .groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


# ------------------------------------------------------------------ K12
def _flat(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols end to end, starts with the end, count) of a batch of words."""
    syms = batch.column("syms")
    starts = syms.offsets.to_numpy()
    return syms.values.to_numpy()[starts[0]:starts[-1]], starts - starts[0], batch.column("cnt").to_numpy()


def _codes(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair that begins at each symbol as one number, whether it is one)."""
    inside = np.ones(len(flat), bool)
    inside[starts[1:][starts[1:] > starts[:-1]] - 1] = False
    after = np.append(flat[1:], 0).astype(np.int64)
    return flat.astype(np.int64) << 32 | after, inside


def _among(code: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``code`` are in ``wanted`` (sorted, not empty)."""
    return wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code


def _pair_counts(words: DataFrame) -> DataFrame:
    """(l, r, c): adjacent symbol pairs of all words, weighted by the words'
    counts; each batch of words is added up before it leaves its task."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            flat, starts, cnt = _flat(batch)
            code, inside = _codes(flat, starts)
            weight = np.repeat(cnt, np.diff(starts))[inside]
            pairs, at = np.unique(code[inside], return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, at, weight)
            yield pa.record_batch([pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(total)], names=["l", "r", "c"])

    return words.mapInArrow(run, "l long, r long, c long").groupBy("l", "r").agg(F.sum("c").alias("c"))


def _top_pairs(words: DataFrame, n: int) -> np.ndarray:
    """The first ``n`` pairs by (count descending, l, r), as rows (count, l,
    r). ``toArrow`` cuts each task's best pairs to ``n`` in a task: the rows
    that come to the driver are ``n``, not ``n`` of every task, as with
    ``collect``."""
    return _ranked(_pair_counts(words).where("c > 0").orderBy(F.desc("c"), "l", "r").limit(n).select("c", "l", "r").toArrow())


def _alive_pairs(words: DataFrame, floor: int) -> np.ndarray | None:
    """All pairs counted ``floor`` times or more, as ``_top_pairs`` gives
    them; None if they are more than ``MAX_ALIVE``."""
    top = _pair_counts(words).where(F.col("c") >= floor).select("c", "l", "r").limit(MAX_ALIVE + 1).toArrow()
    return _ranked(top) if len(top) <= MAX_ALIVE else None


def _ranked(top) -> np.ndarray:
    rows = np.stack([top[c].to_numpy().astype(np.int64) for c in ("c", "l", "r")], axis=1) if len(top) else np.zeros((0, 3), np.int64)
    return rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))]


def _runs(words: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(run, cnt): maximal runs of symbols whose adjacent pairs are all in
    ``pairs`` (sorted numbers), as 32-bit integers, equal ones added up."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            flat, starts, cnt = _flat(batch)
            code, inside = _codes(flat, starts)
            linked = inside & _among(code, pairs)
            before = np.append(False, linked[:-1])
            first = np.flatnonzero(linked & ~before)
            last = np.flatnonzero(before & ~linked)
            raw = flat.astype("<i4").tobytes()
            held: dict[bytes, int] = {}
            for a, b, n in zip((4 * first).tolist(), (4 * last + 4).tolist(), np.repeat(cnt, np.diff(starts))[first].tolist()):
                key = raw[a:b]
                held[key] = held.get(key, 0) + n
            yield pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["run", "cnt"])

    return words.mapInArrow(run, "run binary, cnt long").groupBy("run").agg(F.sum("cnt").alias("cnt"))


def _replaced(syms: list[int], left: int, right: int, new: int) -> list[int]:
    """All occurrences from the left, not overlapping."""
    out, i, n = [], 0, len(syms)
    while i < n:
        if i + 1 < n and syms[i] == left and syms[i + 1] == right:
            out.append(new)
            i += 2
        else:
            out.append(syms[i])
            i += 1
    return out


def _merge_runs(runs: list[tuple[list[int], int]], stop: tuple | None, id2tok: list, tok2id: dict,
                room: int) -> list[tuple[int, int, int]]:
    """The merges that come before ``stop`` (-count, left, right) in the
    ranking, in their order; at most ``room`` new tokens, which are added to
    ``id2tok`` and ``tok2id``."""
    counts: dict[tuple[int, int], int] = {}
    where: dict[tuple[int, int], set[int]] = {}
    for k, (syms, n) in enumerate(runs):
        for p in zip(syms, syms[1:]):
            counts[p] = counts.get(p, 0) + n
            where.setdefault(p, set()).add(k)
    heap = [(-n, *p) for p, n in counts.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int, int]] = []
    while heap and len(merges) < room:
        top = heapq.heappop(heap)
        pair, n = top[1:], counts.get(top[1:], 0)
        if n != -top[0]:
            if n > 0:
                heapq.heappush(heap, (-n, *pair))
            continue
        if stop is not None and top >= stop:
            break
        token = id2tok[pair[0]] + id2tok[pair[1]]
        if token in tok2id:
            if not merges:
                return [(*pair, tok2id[token])]
            break
        new = len(id2tok)
        id2tok.append(token)
        tok2id[token] = new
        merges.append((*pair, new))
        grown = set()
        for k in where.pop(pair):
            syms, times = runs[k]
            if len(syms) == 2:  # the most common case
                counts[pair] -= times
                runs[k] = ([new], times)
                continue
            for p in zip(syms, syms[1:]):
                counts[p] -= times
            syms = _replaced(syms, *pair, new)
            runs[k] = (syms, times)
            for p in zip(syms, syms[1:]):
                counts[p] = counts.get(p, 0) + times
                if new in p:
                    where.setdefault(p, set()).add(k)
                    grown.add(p)
        for p in grown:
            heapq.heappush(heap, (-counts[p], *p))
    return merges


def _applied(words: DataFrame, merges: list[tuple[int, int, int]], alive: np.ndarray | None = None) -> DataFrame:
    """The words after the merges; words of one symbol are done and go. With
    ``alive`` (sorted numbers of pairs, those of ``merges`` among them) words
    are cut where another pair stands."""
    sc = words.sparkSession.sparkContext
    table = sc.broadcast(({(l, r): (k, m) for k, (l, r, m) in enumerate(merges)}, alive))
    wanted = np.sort(np.array([l << 32 | r for l, r, _ in merges], np.int64))

    def run(batches):
        import pyarrow as pa
        ranks, alive = table.value
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, starts, cnt = _flat(batch)
            code, inside = _codes(flat, starts)
            if alive is not None:
                inside &= _among(code, alive)
                cnt = np.repeat(cnt, np.diff(starts))
                starts = np.append(np.flatnonzero(~np.append(False, inside[:-1])), len(flat))
                cnt = cnt[starts[:-1]]
            hit = inside & _among(code, wanted)
            # only words that hold a pair of the round's old symbols can change
            touched = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(hit)))[starts]))
            rows = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.int32()))
            keep = np.diff(starts) >= 2
            new = {}
            for k in touched.tolist():
                syms = merge_symbols(flat[starts[k]:starts[k + 1]].tolist(), ranks)
                new[k], keep[k] = syms, len(syms) >= 2
            same = keep.copy()
            same[touched] = False
            yield pa.record_batch([pa.array(cnt[same], pa.int64()), rows.filter(pa.array(same))], names=["cnt", "syms"])
            own = [k for k in new if keep[k]]
            yield pa.record_batch([pa.array(cnt[own], pa.int64()), pa.array([new[k] for k in own], rows.type)], names=["cnt", "syms"])

    return words.mapInArrow(run, "cnt long, syms array<int>")


def _floor(wc: DataFrame, room: int) -> int:
    """The count of the ``room``-th most frequent word of two or more
    characters (1: there are fewer); the counts' histogram comes to the
    driver."""
    rows = wc.where(F.length("word") >= 2).groupBy("cnt").agg(F.count(F.lit(1)).alias("n")).toArrow()
    for cnt, n in sorted(zip(rows["cnt"].to_pylist(), rows["n"].to_pylist()), reverse=True):
        room -= n
        if room <= 0:
            return cnt
    return 1


def train(df: DataFrame, text_col: str = "text", vocab_size: int = DEFAULT_VOCAB_SIZE,
          max_runs: int = MAX_RUNS) -> BpeModel:
    """Train a byte-pair vocabulary of at most ``vocab_size`` tokens
    (specials included), merging the most frequent adjacent pair, ties to
    the smallest (left id, right id). ``max_runs`` bounds what a round brings
    to the driver, not what is learned."""
    spark = df.sparkSession
    wc = cut_lineage(word_counts(df, text_col))
    letters = F.regexp_extract_all("word", F.lit("(?s)."), 0)
    chars = wc.select(F.explode(letters).alias("c")).distinct().collect()
    alphabet_chars = sorted((r.c for r in chars), key=ord)
    id2tok = list(SPECIAL_TOKENS) + alphabet_chars
    tok2id = {t: i for i, t in enumerate(id2tok)}
    alphabet = {c: tok2id[c] for c in alphabet_chars}
    shared = spark.sparkContext.broadcast({ord(c): i for c, i in alphabet.items()})

    def symbols(batches):
        import pyarrow as pa
        for batch in batches:
            ids = shared.value
            rows = [[ids[ord(c)] for c in w] for w in batch.column("word").to_pylist()]
            yield pa.record_batch([batch.column("cnt"), pa.array(rows, pa.list_(pa.int32()))], names=["cnt", "syms"])

    # about WORDS_PER_TASK distinct words per task, at most one task per
    # core: a small table costs few tasks per round, a large one spreads
    # over the whole cluster
    parts = min(spark.sparkContext.defaultParallelism, max(1, -(-wc.count() // WORDS_PER_TASK)))
    words = cut_lineage(wc.where(F.length("word") >= 2).repartition(parts)
                        .mapInArrow(symbols, "cnt long, syms array<int>"))

    merges: list[tuple[int, int, int]] = []
    floor = _floor(wc, vocab_size - len(id2tok))
    n_pairs = 64
    while len(id2tok) < vocab_size:
        top = alive = _alive_pairs(words, floor) if floor > 1 else None
        if alive is None:
            top = _top_pairs(words, MAX_PAIRS + 1)
        if not len(top):
            break
        while True:
            n_pairs = max(1, min(n_pairs, MAX_PAIRS, len(top)))
            chosen = np.sort(top[:n_pairs, 1] << 32 | top[:n_pairs, 2])
            rows = _runs(words, chosen).limit(max_runs + 1).toArrow()
            if len(rows) <= max_runs or n_pairs == 1:
                break
            n_pairs //= 2
        if len(rows) > max_runs:  # one pair, in very many runs of its own symbol
            rows = _runs(words, chosen).toArrow()
        runs = [(np.frombuffer(b, "<i4").tolist(), n) for b, n in zip(rows["run"].to_pylist(), rows["cnt"].to_pylist())]
        if n_pairs < len(top):
            stop = (-int(top[n_pairs, 0]), int(top[n_pairs, 1]), int(top[n_pairs, 2]))
        else:
            stop = None if alive is None else (1 - floor, -1, -1)  # every pair from the floor on comes before
        n_runs = len(runs)
        found = _merge_runs(runs, stop, id2tok, tok2id, vocab_size - len(id2tok))
        merges += found
        if len(id2tok) < vocab_size:
            if alive is None:
                words = cut_lineage(_applied(words, found))
            else:
                pieces = _applied(words, found, np.sort(alive[:, 1] << 32 | alive[:, 2]))
                words = cut_lineage(pieces.groupBy("syms").agg(F.sum("cnt").alias("cnt")).select("cnt", "syms").repartition(parts))
        for part in (3, 12, 48):
            if n_runs < max_runs // part:
                n_pairs *= 2
    import pyarrow as pa
    vocab = spark.createDataFrame(pa.table([pa.array(id2tok, pa.string()), pa.array(range(len(id2tok)), pa.int32())],
                                           names=["token", "id"]), "token string, id int")
    columns = list(zip(*((k, *m, id2tok[m[2]]) for k, m in enumerate(merges)))) or [()] * 5
    mdf = spark.createDataFrame(pa.table([pa.array(c, pa.string() if k == 4 else pa.int32()) for k, c in enumerate(columns)],
                                         names=["rank", "left", "right", "merged", "token"]),
                                "rank int, left int, right int, merged int, token string")
    return BpeModel(vocab=vocab, merges=mdf, size=len(id2tok), merge_list=merges,
                    alphabet=alphabet)


# ------------------------------------------------------------------ K13
def merge_symbols(syms: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The lowest-ranked applicable merge, all its occurrences left to
    right, until none applies. Short words are scanned; long ones keep their
    pairs in a heap over a linked list."""
    if len(syms) < 24:
        while len(syms) > 1:
            best = min((ranks[p] + p for p in zip(syms, syms[1:]) if p in ranks), default=None)
            if best is None:
                break
            syms = _replaced(syms, best[2], best[3], best[1])
        return syms
    n = len(syms)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    syms, alive = list(syms), [True] * n
    heap = [(ranks[p][0], i) for i, p in enumerate(zip(syms, syms[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ranks.get((syms[i], syms[j]), (-1, 0))[0] != rank:
            continue
        syms[i], alive[j], after[i] = ranks[syms[i], syms[j]][1], False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (p := (syms[a], syms[b])) in ranks:
                heapq.heappush(heap, (ranks[p][0], a))
    return [s for s, here in zip(syms, alive) if here]


def segment_word(word: str, alphabet: dict, ranks: dict) -> list[int]:
    """Characters to ids (unknown -> [UNK], one each), then merges."""
    return merge_symbols([alphabet.get(c, UNK) for c in word], ranks)


def _segmenter(model: BpeModel, spark):
    shared = spark.sparkContext.broadcast((model.alphabet, {(l, r): (k, m) for k, (l, r, m)
                                                            in enumerate(model.merge_list)}))
    specials = dict(SPECIAL_TOKENS)
    memo: dict[str, list[int]] = {}  # of one task

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def seg(rows):
        import pyarrow as pa
        alphabet, ranks = shared.value
        starts = rows.offsets.to_numpy()
        pieces = rows.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
        found = []  # ids of the batch's different pieces
        for w in pieces.dictionary.to_pylist():
            got = memo.get(w)
            if got is None:
                got = [specials[w]] if w in specials else segment_word(w, alphabet, ranks)
                if len(w) <= MEMO_CHARS:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[w] = got
            found.append(got)
        at = pieces.indices.to_numpy()
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, size.sum())
        first, n = (np.cumsum(size) - size)[at], size[at]
        ends = np.append(0, np.cumsum(n))
        ids = flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], n)]
        return pa.ListArray.from_arrays(pa.array(ends[starts - starts[0]], pa.int32()), pa.array(ids, pa.int32()))
    return seg


def encode(df: DataFrame, model: BpeModel, text_col: str = "text",
           key_cols: list[str] | None = None, max_len: int | None = 512,
           out_col: str = "ids") -> DataFrame:
    """START + ids + END; longer than ``max_len`` -> first max_len-1
    ids then END (no pad); otherwise padded to ``max_len``; None = neither.
    Rows stay rows, also with equal keys; a null text has no pieces."""
    key_cols = key_cols or ["doc_id"]
    pieces = pre_tokens(F.col(text_col))
    if max_len is not None:  # every piece gives an id at least
        pieces = F.slice(pieces, 1, max(max_len, 1))
    body = _segmenter(model, df.sparkSession)(F.coalesce(pieces, F.array().cast("array<string>")))

    def wrapped(b: Column) -> Column:
        full = F.concat(F.array(F.lit(START)), b, F.array(F.lit(END)))
        if max_len is None:
            return full
        return F.when(F.size(full) > max_len, F.concat(F.slice(full, 1, max_len - 1), F.array(F.lit(END)))) \
            .otherwise(F.concat(full, F.array_repeat(F.lit(PAD), F.greatest(F.lit(max_len) - F.size(full), F.lit(0)))))

    return df.select(*key_cols, body.alias("__body")).select(*key_cols, wrapped(F.col("__body")).alias(out_col))


# ------------------------------------------------------------------ K14, K15
def decode(df: DataFrame, model: BpeModel, ids_col: str = "ids",
           key_cols: list[str] | None = None, skip_special: bool = False,
           out_col: str = "text") -> DataFrame:
    """Ids -> tokens joined by one space (specials optionally dropped);
    an id that is not in the vocabulary has no token. Rows stay rows; the
    tokens are broadcast (at most ``vocab_size``)."""
    key_cols = key_cols or ["doc_id"]
    vocab = model.vocab.toArrow()
    tokens = dict(zip(vocab["id"].to_pylist(), vocab["token"].to_pylist()))
    if skip_special:
        tokens = {i: t for i, t in tokens.items() if t not in SPECIAL_TOKENS}
    ids = sorted(tokens)
    # the last number is above all ids, so that every search ends on one
    shared = df.sparkSession.sparkContext.broadcast((np.array(ids + [1 << 40], np.int64), [tokens[i] for i in ids] + [""]))

    held: dict = {}  # of one task

    @F.arrow_udf(T.StringType())
    def join(rows):
        import pyarrow as pa
        import pyarrow.compute as pc
        if "tokens" not in held:
            held["tokens"] = pa.array(shared.value[1], pa.string())
        known, starts = shared.value[0], rows.offsets.to_numpy()
        ids = rows.values.slice(starts[0], starts[-1] - starts[0])
        raw = ids.fill_null(0).to_numpy()
        place = np.searchsorted(known, raw)
        there = (known[place] == raw) & ids.is_valid().to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(there))[starts - starts[0]]
        words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held["tokens"].take(pa.array(place[there])))
        return pc.binary_join(words, " ")

    return df.select(*key_cols, join(F.col(ids_col).cast("array<int>")).alias(out_col))


def check_specials(model: BpeModel) -> DataFrame:
    """The special tokens keep their fixed ids (5 rows, all equal)."""
    spark = model.vocab.sparkSession
    sp = spark.createDataFrame(list(SPECIAL_TOKENS.items()), "token string, expected int")
    return sp.join(model.vocab, "token", "left").select(
        "token", "expected", "id", (F.col("id") == F.col("expected")).alias("ok"))
