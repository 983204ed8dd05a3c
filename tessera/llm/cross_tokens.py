"""Alignment of two tokenizers over whole texts, with corpus-wide counts.

Both encodings of a text are cut into groups at the byte offsets where a
token of each ends. Tokens whose byte ranges overlap are linked, and every
pair of ids is counted over the corpus. Most groups are one token on either
side with the same bytes: an array from the first tokenizer's ids to the
second's with the same bytes is computed beforehand, and such groups are
counted in a vector as long as the vocabulary, one for each task. Only pairs
from all other groups are shuffled, added up by block first.

A text is cut into stretches at single spaces between characters that are
not white space, which no token of either tokenizer crosses; a worker
keeps the alignment of stretches it meets again. Texts are taken in blocks of
about ``BLOCK`` characters (one longer text is a block of its own): a block
names each of its stretches and pairs by a number, so that the second step,
after all pairs are counted, gets one row for each pair of a block and needs
no token again.

Cases: null and empty texts, and texts whose joined token bytes differ from
the space and the text, have no tokens: zeros and an empty string; repeated
rows and rows without an id are aligned and counted each; an empty table
gives an empty table; other columns are kept (one with the name of an output
column is replaced), but for the text, which is as large as all the rest.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import stored, worker_cache

#: characters of the texts that are aligned together
BLOCK = 1 << 22
#: stretches a worker keeps in each of two generations (about 400 bytes
#: each), and the longest that it keeps
KEPT, KEPT_CHARS = 100_000, 60
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class ByteLevel:
    """A ``tokenizers`` JSON file of byte-level BPE. Where the merges make
    ids in their order, ids are merge ranks and the ``tiktoken`` engine gives
    the same ids faster; any other file is encoded by its own library."""

    def __init__(self, source: bytes, pattern: str):
        spec = json.loads(source)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in letters}
        byte_of |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(letters)))}
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, t))
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if made == sorted(set(made)) and len(made) + 256 == len(vocab) and spec["normalizer"] is None:
            import tiktoken
            self._one = tiktoken.Encoding("own", pat_str=pattern, special_tokens={}, mergeable_ranks={
                b: i for i, b in enumerate(self.bytes_of)}).encode_ordinary
            self.encode = lambda texts: list(map(self._one, texts))
        else:
            from tokenizers import Tokenizer
            own = Tokenizer.from_str(source.decode())
            own.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """A ``sentencepiece`` model, which puts a space before a text itself."""

    def __init__(self, source: bytes):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_proto=source)
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece goes on over a space")
        self.bytes_of = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode()
                         for i, n in enumerate(names)]
        self.byte_ids = [i for i in range(len(names)) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)]
        self.encode = lambda texts: model.encode(texts, num_threads=1)


def identity_map(a: list[bytes], b: list[bytes], later: list[int] = ()) -> np.ndarray:
    """A id -> B id with the same bytes, -1 without one; of several the
    smallest that is not in ``later``."""
    known: dict[bytes, int] = {}
    second = set(later)
    for i in sorted(range(len(b)), key=lambda i: (i in second, i)):
        known.setdefault(b[i], i)
    return np.array([known.get(x, -1) if x else -1 for x in a], np.int32)


def stretches(text: str) -> list[str]:
    """The text's stretches, each without the space before it."""
    parts = text.split(" ")
    if not any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
        return parts
    out, now = [], parts[0]
    for p in parts[1:]:
        if now and p and not now[-1].isspace() and not p[0].isspace():
            out.append(now)
            now = p
        else:
            now += " " + p
    return [*out, now]


class Aligner:
    """Aligns stretches; keeps those it may meet again, in two generations."""

    def __init__(self, source_a: bytes, source_b: bytes, pattern: str):
        self.a, self.b = ByteLevel(source_a, pattern), Pieces(source_b)
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes_of], np.int64) for t in (self.a, self.b))
        self.same = identity_map(self.a.bytes_of, self.b.bytes_of, self.b.byte_ids)
        text = lambda n, ends: [np.array([f"{i}{e}" for i in range(n)], object) for e in ends]
        self.text_a, self.text_b = text(len(self.size_a), ",|"), text(len(self.size_b), ",;")
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def learn(self, parts: list[str]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, groups, links) of each stretch, None where
        the bytes differ. Links are 64-bit numbers: ``-1 - a`` for a group
        of the identity map, otherwise ``a << 32 | b``."""
        texts = [" " + p for p in parts]
        ids_a, ids_b = self.a.encode(texts), self.b.encode(parts)
        out: list[tuple | None] = [None] * len(parts)
        join = b"".join
        good = [k for k, (t, x, y) in enumerate(zip(texts, ids_a, ids_b))
                if join(map(self.a.bytes_of.__getitem__, x)) == t.encode() == join(map(self.b.bytes_of.__getitem__, y))]
        if not good:
            return out
        count_a, count_b = (np.array([len(ids[k]) for k in good]) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids[k] for k in good), np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        border = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(border, end_a), np.searchsorted(border, end_b)
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        # links: the tokens of B from the first that ends after a token's start to the last that starts before its end
        low = np.searchsorted(end_b, end_a - self.size_a[a], "right")
        high = np.searchsorted(end_b - self.size_b[b], end_a, "left")
        n = high - low
        link_a = np.repeat(a, n)
        link_b = b[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(link_a))]
        single = np.repeat((in_a[group_a] == 1) & (in_b[group_a] == 1), n) & (self.same[link_a] == link_b)
        links = np.where(single, -1 - link_a, link_a << 32 | link_b).tobytes()
        # the groups' text: A's tokens of a group, then B's
        last_a = np.append(group_a[1:] != group_a[:-1], True)
        last_b = np.append(group_b[1:] != group_b[:-1], True)
        words = np.empty(len(a) + len(b), object)
        words[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = np.where(last_a, self.text_a[1][a], self.text_a[0][a])
        words[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = np.where(last_b, self.text_b[1][b], self.text_b[0][b])
        words = words.tolist()
        stop_a, stop_b = np.cumsum(count_a), np.cumsum(count_b)
        groups = np.diff(np.append(-1, group_a[stop_a - 1])).tolist()
        link_stop = (8 * np.cumsum(n)[stop_a - 1]).tolist()
        at, link_at = 0, 0
        for k, x, y, g, to, l_to in zip(good, count_a.tolist(), count_b.tolist(), groups, (stop_a + stop_b).tolist(), link_stop):
            out[k] = (x, y, g, "".join(words[at:to])[:-1], links[link_at:l_to])
            at, link_at = to, l_to
        return out

    def of(self, parts: list[str]) -> list[tuple | None]:
        """``learn`` of distinct stretches by way of what is kept."""
        found, missing = {}, []
        for p in parts:
            e = self.new.get(p, False)
            if e is False:
                e = self.old.get(p, False)
                if e is False:
                    missing.append(p)
                    continue
                self.new[p] = e
            found[p] = e
        for k in range(0, len(missing), 50_000):
            some = missing[k:k + 50_000]
            learnt = dict(zip(some, self.learn(some)))
            found |= learnt
            self.new.update((p, e) for p, e in learnt.items() if len(p) <= KEPT_CHARS)
        if len(self.new) > KEPT:
            self.old, self.new = self.new, {}
        return [found[p] for p in parts]

    def block(self, texts: list[str | None], digest: bool) -> tuple[list[dict], dict, np.ndarray]:
        """(a row for each text, the block's tables, counts by A id of the
        identity map's groups)."""
        cut = [stretches(t) if t else [] for t in texts]
        names = list(set(chain.from_iterable(cut)))
        entries = self.of(names)
        number = dict(zip(names, range(len(names))))
        bad = {number[p] for p, e in zip(names, entries) if e is None}
        empty = (0, 0, 0, "", b"")
        entries = [empty if e is None else e for e in entries]
        sizes = np.array([len(e[4]) // 8 for e in entries], np.int64)
        sums = np.array([(x, y, g) for x, y, g, _, _ in entries] or np.zeros((0, 3)), np.int64).reshape(-1, 3)
        sums = np.concatenate((sums, sizes[:, None]), axis=1)
        label = [e[3] for e in entries]
        rows, times = [], np.zeros(len(names), np.int64)
        for parts in cut:
            ids = [number[p] for p in parts]
            if not ids or (bad and not bad.isdisjoint(ids)):
                rows.append({"sums": (0, 0, 0, 0), "groups": "", "used": b""})
                continue
            groups = ";".join([label[i] for i in ids])
            used, n = np.unique(np.array(ids, np.int32), return_counts=True)
            times[used] += n
            rows.append({"sums": tuple((sums[used] * n[:, None]).sum(axis=0).tolist()), "used": _pack(used, n),
                         "groups": hashlib.sha256(groups.encode()).hexdigest() if digest else groups})
        links = np.frombuffer(b"".join([e[4] for e in entries]), np.int64)
        weight = np.repeat(times, sizes)
        plain = links < 0
        vector = np.bincount(-1 - links[plain], weight[plain], minlength=len(self.size_a)).astype(np.int64)
        pairs, at = np.unique(links[~plain], return_inverse=True)
        refs = links.copy()
        refs[~plain] = at
        return rows, {"sizes": sizes.astype(np.int32).tobytes(), "refs": refs.astype(np.int32).tobytes(), "pairs": pairs,
                      "n": np.bincount(at, weight[~plain], minlength=len(pairs)).astype(np.int64)}, vector


def _pack(used: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers and how often each is used, compressed as steps."""
    import zstandard
    both = np.concatenate((np.diff(used, prepend=0), times)).astype("<i4")
    return zstandard.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)  # high bytes, mostly zero, together


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(raw.T).view("<i4")[:, 0].astype(np.int64)
    return np.cumsum(both[:len(both) // 2]), both[len(both) // 2:]


def _aligner(shared, key: str) -> Aligner:
    cache = worker_cache("cross_tokens")
    if key not in cache:
        cache.clear()
        cache[key] = Aligner(*shared.value)
    return cache[key]


class CrossTokens:
    """A pair of tokenizers; their files are broadcast (fixed sizes)."""

    def __init__(self, spark, json_path: str, model_path: str, pattern: str):
        with open(json_path, "rb") as f, open(model_path, "rb") as g:
            sources = f.read(), g.read()
        one = Aligner(*sources, pattern)
        self.same, self.key = one.same, uuid4().hex
        self.shared = spark.sparkContext.broadcast((*sources, pattern))

    def _aligned(self, docs: DataFrame, text_col: str, digest: bool) -> tuple[DataFrame, list[T.StructField]]:
        """The first step's rows: of texts (kind 0), of blocks (1), and of
        tasks' vectors (2)."""
        shared, key = self.shared, self.key
        taken = {*MEASURES, "groups", text_col.lower()}
        kept = [f for f in docs.schema.fields if f.name.lower() not in taken]
        long, binary, longs = T.LongType(), T.BinaryType(), T.ArrayType(T.LongType())
        own = [("kind", T.IntegerType()), ("block", long), ("n_a", long), ("n_b", long), ("n_groups", long), ("n_links", long),
               ("groups", T.StringType()), ("used", binary), ("sizes", binary), ("refs", binary),
               ("pairs", longs), ("n", longs)]
        schema = T.StructType([T.StructField(n, t) for n, t in own] + [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(kept)])

        def run(batches):
            import pyarrow as pa
            from pyspark import TaskContext
            from pyspark.sql.pandas.types import to_arrow_schema
            aligner, into = _aligner(shared, key), to_arrow_schema(schema)
            block, vector = TaskContext.get().partitionId() << 33, np.zeros(len(aligner.size_a), np.int64)

            def table(size, columns):
                def column(f):
                    x = columns.get(f.name)
                    return pa.nulls(size, f.type) if x is None else x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type)
                return pa.record_batch([column(f) for f in into], schema=into)

            def finished(part, texts):
                rows, tables, counted = aligner.block(texts, digest)
                vector[:] += counted
                yield table(len(rows), {"kind": [0] * len(rows), "block": [block] * len(rows),
                                        **{c: [r["sums"][k] for r in rows] for k, c in enumerate(MEASURES[:4])},
                                        **{c: [r[c] for r in rows] for c in ("groups", "used")},
                                        **{f"c{k}": part.column(k + 1) for k in range(len(kept))}})
                yield table(1, {"kind": [1], "block": [block], **{c: [x] for c, x in tables.items()}})

            for batch in batches:
                texts = batch.column(0).to_pylist()
                total, at = 0, 0
                for k, t in enumerate(texts):
                    total += len(t or "") + 1
                    if total >= BLOCK or k + 1 == len(texts):
                        yield from finished(batch.slice(at, k + 1 - at), texts[at:k + 1])
                        total, at, block = 0, k + 1, block + 1
            some = np.flatnonzero(vector)
            yield table(1, {"kind": [2], "pairs": [some], "n": [vector[some]]})

        inputs = [F.col(f"`{text_col}`").cast("string").alias("t"), *[F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(kept)]]
        return stored(docs.select(*inputs).mapInArrow(run, schema), "cross-tokens"), kept

    def align(self, docs: DataFrame, text_col: str = "text", groups: str = "ids") -> DataFrame:
        """``docs`` without its text and with the MEASURES and ``groups``:
        the ids by group (``a1,a2|b1;a3|b2``), or with ``groups="sha256"``
        their digest alone, which saves carrying several times the text."""
        if groups not in ("ids", "sha256"):
            raise ValueError(f"groups: {groups}")
        spark, same = docs.sparkSession, self.same
        rows, kept = self._aligned(docs, text_col, groups == "sha256")
        listed = rows.where("kind = 1").select("block", F.posexplode(F.arrays_zip("pairs", "n")).alias("idx", "e"))
        pair = F.col("e")["pairs"]
        listed = listed.select("block", "idx", F.shiftright(pair, 32).cast("int").alias("a"),
                               pair.bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), F.col("e")["n"].alias("n"))
        map_ = spark.createDataFrame([(i, int(b)) for i, b in enumerate(same) if b >= 0], "a int, b int")
        plain = (rows.where("kind = 2").select(F.explode(F.arrays_zip("pairs", "n")).alias("e"))
                 .groupBy(F.col("e")["pairs"].cast("int").alias("a")).agg(F.sum(F.col("e")["n"]).alias("n"))
                 .join(F.broadcast(map_), "a").select("a", "b", "n"))  # at most as many rows as the vocabulary
        counted = stored(listed.select("a", "b", "n").unionByName(plain).groupBy("a", "b").agg(F.sum("n").alias("total")), "pairs")
        best = counted.groupBy("b").agg(F.max("total").alias("most"))  # at most as many rows as the vocabulary
        counted = counted.join(F.broadcast(best), "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))
        totals, bests = np.zeros(len(same), np.int64), np.zeros(len(same), bool)
        for r in counted.join(F.broadcast(map_), ["a", "b"]).collect():  # the identity map's pairs only
            totals[r["a"]], bests[r["a"]] = r["total"], r["best"]
        vectors = spark.sparkContext.broadcast((totals, bests))
        found = listed.join(counted, ["a", "b"]).select(F.col("block").alias("of"), "idx", "total", "best")
        schema = T.StructType([*[T.StructField(f"c{k}", f.dataType) for k, f in enumerate(kept)],
                               *[T.StructField(c, T.LongType()) for c in MEASURES], T.StructField("groups", T.StringType())])

        def counts_of(left, right):
            import pyarrow as pa
            import pyarrow.compute as pc
            total_of, best_of = vectors.value
            one = left.filter(pc.equal(left["kind"], 1))
            texts = left.filter(pc.equal(left["kind"], 0))
            sizes, refs = (np.frombuffer(one[c][0].as_py(), np.int32) for c in ("sizes", "refs"))
            total, best = np.zeros(len(right), np.int64), np.zeros(len(right), bool)
            idx = right["idx"].to_numpy()
            total[idx], best[idx] = right["total"].to_numpy(), right["best"].to_numpy()
            plain = refs < 0
            sums, hits = np.zeros(len(refs), np.int64), np.zeros(len(refs), np.int64)
            sums[plain], hits[plain] = total_of[-1 - refs[plain]], best_of[-1 - refs[plain]]
            sums[~plain], hits[~plain] = total[refs[~plain]], best[refs[~plain]]
            border = np.concatenate(([0], np.cumsum(sizes)))
            upto = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[border])
            sums, hits = upto(sums), upto(hits)
            n_best, count_sum = [], []
            for u, n in map(_unpack, texts["used"].to_pylist()):
                n_best.append(int((hits[u] * n).sum()))
                count_sum.append(int((sums[u] * n).sum()))
            columns = {"n_best": pa.chunked_array([pa.array(n_best, pa.int64())]), "count_sum": pa.chunked_array([pa.array(count_sum, pa.int64())])}
            return pa.table({f.name: columns.get(f.name, texts[f.name] if f.name in texts.column_names else None) for f in schema.fields})

        out = (rows.where("kind < 2").groupBy("block").cogroup(found.groupBy("of")).applyInArrow(counts_of, schema))
        return out.select(*[F.col(f"c{k}").alias(f.name) for k, f in enumerate(kept)], *MEASURES, "groups")
