"""Line dedup, byte-level BPE, repeats, pipeline stages: against plain versions."""

import base64
import hashlib
import random
import struct
from collections import Counter

import pytest
from pyspark.sql import types as T

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("Kept", T.StringType()), T.StructField("n_lines", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 9))) for _ in range(n))


# line dedup

def plain_lines(rows):
    space = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(space))
    holders = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 10:
                    holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LINES = [(3, "Some Shared Line\nown line of three\n"), (1, " some shared line \t\nshort\nshort"), (2, None), (4, ""),
         (5, "some shared line\nsome shared line"), (5, "some shared line\nsome shared line"), (None, "some shared line"),
         (6, "\x0bÉcole partagée\x0c\nécole partagée"), (7, "École partagée\r\n\n\n"), (8, "short"), (9, "a" * 50_000)]


def test_line_dedup(spark):
    from tessera.llm.line_dedup import dedup_lines
    got = dedup_lines(frame(spark, LINES)).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_lines(LINES)))
    assert dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_higher_threshold(spark):
    from tessera.llm.line_dedup import dedup_lines
    got = dedup_lines(frame(spark, LINES), min_docs=4).select("n_dropped").collect()
    assert sum(r[0] for r in got) == 0
    got = dedup_lines(frame(spark, LINES), min_docs=3).where("doc_id = 5").select("n_dropped").collect()
    assert [r[0] for r in got] == [2, 2]


# byte-level BPE

@pytest.fixture(scope="module")
def codec():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    from tessera.llm.byte_bpe import Vocabulary
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Vocabulary(ranks), library


def test_bpe_equals_library(codec):
    from tessera.llm.byte_bpe import Encoder
    vocabulary, library = codec
    rng, e = random.Random(3), Encoder(vocabulary, public_tokenizers.PATTERN)
    for _ in range(1500):
        text = "".join(rng.choice("aab  eé\n'tslr日本🙂xABC12..--\t \x1c") for _ in range(rng.randint(0, 60)))
        more = "".join(rng.choice("a 'tl\n日1") for _ in range(rng.randint(0, 8)))
        pack = lambda t: struct.pack(f"<{len(library.encode_ordinary(t))}I", *library.encode_ordinary(t))
        assert e.encode(text) == pack(text)
        assert e.append(text, e.encode(text), more) == pack(text + more)
        assert e.decode(e.encode(text)) == text.encode()


def test_bpe_tables_append_and_edit(codec):
    from tessera.llm.byte_bpe import PieceBatch, PieceTable
    vocabulary, _ = codec
    rng, pieces = random.Random(4), []
    for _ in range(200):
        data = bytes(rng.choice(b"abcdeth ing\xc3\xa9") for _ in range(rng.randint(1, 300)))
        cut, stop = rng.randint(0, len(data)), rng.randint(0, 4)
        table = PieceTable(vocabulary, data[:cut])
        table.append(data[cut:])
        whole = PieceTable(vocabulary, data)
        assert table.last == whole.last
        redone = table.replace(cut, min(len(data), cut + stop), b"xy")
        fresh = PieceTable(vocabulary, data[:cut] + b"xy" + data[cut + stop:])
        assert table.last == fresh.last and table.ids() == fresh.ids() and redone <= len(fresh.last)
        pieces += [data, data[:7]]
    for piece, ids in zip(pieces, PieceBatch(vocabulary).encode(pieces)):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == PieceTable(vocabulary, piece).ids()


def test_bpe_columns(spark, codec):
    from tessera.llm.byte_bpe import ByteBpe
    _, library = codec
    rows = [(1, "Some text, l'été 123"), (1, "Some text, l'été 123"), (2, None), (None, ""), (3, "ab " * 40_000)]
    bpe = ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = bpe.decode(bpe.encode(frame(spark, rows), ids="kept"), ids="kept").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode_ordinary(r["text"] or "")
        assert bytes(r["kept"]) == struct.pack(f"<{len(ids)}I", *ids) and bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.encode(frame(spark, [])).count() == 0


# repeats

def plain_repeats(rows, window=200):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[i:i + window] for b in data for i in range(len(b) - window + 1))
    for (doc, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if count[b[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        yield doc, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


def test_repeats(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.llm import repeats
    rng = random.Random(5)
    shared, edge = words(rng, 120), words(rng, 45)[:200]
    rows = [(1, words(rng, 60) + shared + words(rng, 30)), (2, shared), (3, shared[3:] + words(rng, 200)), (4, None), (5, ""),
            (6, "ab" * 900), (7, words(rng, 20) + edge + words(rng, 20)), (8, edge), (9, edge[:-1]), (None, words(rng, 90)),
            (10, "x" * 200), (11, "x" * 201), (12, shared[:300] + words(rng, 5) + shared[300:]), (13, words(rng, 400)), (13, "y")]
    rows += [(20 + k, words(rng, 50) + shared[100:420] + words(rng, 40)) for k in range(30)] + [rows[0]]
    want = sorted(map(repr, plain_repeats(rows)))
    look = ["doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)]
    got = repeats.remove_repeats(frame(spark, rows)).select(*look).collect()
    assert sorted(map(repr, map(tuple, got))) == want
    # the same with every gram taken for a frequent one, texts cut into short parts and runs passed on
    monkeypatch.setattr(repeats, "HOT_SAMPLE", 1)
    monkeypatch.setattr(repeats, "HOT_SHARE", 10 ** 9)
    monkeypatch.setattr(repeats, "SLICE", 700)
    monkeypatch.setattr(repeats, "RUN_ROWS", 3)
    monkeypatch.setattr(repeats, "HOT_LEAST", 0)
    got = repeats.remove_repeats(frame(spark, rows)).select(*look).collect()
    assert sorted(map(repr, map(tuple, got))) == want
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_byte_bpe_tables_are_bounded(monkeypatch):
    """However many unknown pieces a group of texts has, few share a table."""
    import public_tokenizers
    from tessera.llm import byte_bpe as bb

    ranks = bb.read_ranks(None, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = [" ".join(f"zq{k * 7919:x}vw" for k in range(a, a + 300)) + "." for a in range(0, 6000, 300)]
    expected = [bb.Encoder(bb.Vocabulary(ranks), public_tokenizers.PATTERN).encode(t) for t in texts]
    sizes, last = [], bb.PieceBatch._last
    monkeypatch.setattr(bb, "PIECES", 64, raising=False)
    monkeypatch.setattr(bb.PieceBatch, "_last", lambda self, data, length: sizes.append(len(data)) or last(self, data, length))
    import pyarrow as pa
    e = bb.Encoder(bb.Vocabulary(ranks), public_tokenizers.PATTERN)
    assert e.encode_texts(pa.array(texts)) == expected
    assert max(sizes) <= 64
