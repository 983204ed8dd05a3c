"""SimHash and embedding near-duplicates, decontamination: against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

xxhash = pytest.importorskip("xxhash")

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("FP", T.StringType()), T.StructField("component_id", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], DOCS)


def groups(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_print(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def near_rows():
    rng, rows = random.Random(1), []
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(5)) for _ in range(400)]
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(150)]
        rows.append((10 * k + 5, " ".join(base)))
        for c in range(rng.randint(0, 4)):
            text = list(base)
            text[rng.randrange(150)] = "other"
            rows.append((10 * k + c, "\t".join(text).upper() if c == 2 else " ".join(text)))
    return rows + [(900, None), (901, ""), (902, " \n\x0b"), (903, "one two"), (903, "one two"), (None, "ONE TWO"),
                   (904, "é" * 50_000), (905, "one TWO ")]


def test_simhash_groups(spark):
    from tessera.llm import simhash
    rows = near_rows()
    prints = [plain_print(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = groups(len(rows), links)
    low = {r: min((i for (i, _), q in zip(rows, root) if q == r and i is not None), default=None) for r in root}
    got = simhash.near_duplicates(frame(spark, rows)).select("doc_id", "text", "fp", "component_id").collect()
    want = [(i, t, p - (p >> 63 << 64), low[r]) for (i, t), p, r in zip(rows, prints, root)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "FP", "component_id"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(low.values()))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [8, 4096])
def test_fingerprint_links_dense_groups(spark, chunk, monkeypatch):
    """Chains and balls of fingerprints, also with runs cut into chunks."""
    from tessera.llm import simhash
    from tessera.llm.graph import components
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng, prints = random.Random(2), set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            prints.add(x)
            for b in rng.sample(range(64), rng.choice((1, 3, 4, 5))):
                x ^= 1 << b
    prints |= {0, 1, 15, 31, 2 ** 64 - 1} | {rng.getrandbits(64) for _ in range(300)}
    prints = sorted(prints)
    signed = [p - (p >> 63 << 64) for p in prints]
    root = groups(len(prints), [(a, b) for a in range(len(prints)) for b in range(a)
                                if (prints[a] ^ prints[b]).bit_count() <= 4])
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    assert all(((a ^ b) & 2 ** 64 - 1).bit_count() <= 4 for a, b in links.collect())
    found = {r["node"]: r["root"] for r in components(links).collect()}
    got = [found.get(s, s) for s in signed]
    assert len(set(zip(got, root))) == len(set(got)) == len(set(root))


def test_components(spark):
    from tessera.llm.graph import components
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(70)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    pairs += [(300 + rng.randrange(60), 300 + rng.randrange(60)) for _ in range(40)] + [(None, 4)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups(400, [p for p in pairs if p[0] is not None])
    used = {x for p in pairs if None not in p and p[0] != p[1] for x in p}
    assert got == {x: want[x] for x in used}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                        T.StructField("Kept", T.StringType())])


@pytest.mark.parametrize("block", [16, 4096])
def test_embeddings(spark, block, monkeypatch):
    from tessera.llm import cover_tree
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(25, 8))
    rows = [(k, list(map(float, centres[k % 25] * rng.uniform(0.1, 9) + rng.normal(0, rng.choice([0.02, 0.4]), 8))))
            for k in range(160)]
    rows += [(500, rows[0][1]), (500, rows[0][1]), (501, None), (502, [0.0] * 8), (503, [float("nan")] * 8),
             (504, [1.0, None] * 4), (505, []), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (None, rows[3][1]),
             (508, [1e200] * 8), (509, [1e-200] * 8), (510, [float("inf")] * 8)]

    def usable(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = (np.array(x) / max(map(abs, x)) for x in (a, b))
        return a @ b / np.sqrt((a @ a) * (b @ b))

    links = [(a, b) for a in range(len(rows)) for b in range(a) if usable(rows[a][1]) and usable(rows[b][1])
             and len(rows[a][1]) == len(rows[b][1]) and cosine(rows[a][1], rows[b][1]) >= 0.9]
    root, n = groups(len(rows), links), [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    low = {r: min((i for (i, _), q in zip(rows, root) if q == r and i is not None), default=None) for r in root}
    frame_ = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)
    got = cover_tree.near_duplicates(frame_).select("vec_id", "n_links", "component_id", "kept").collect()
    want = [(i, n[k], low[root[k]], i == low[root[k]]) for k, (i, _) in enumerate(rows)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert cover_tree.near_duplicates(frame_.limit(0)).count() == 0


def test_embedding_blocks_meet_by_rounds(spark, monkeypatch):
    """Many rounds of broadcast blocks find what one finds, and no join or
    exchange carries the blocks: disk would grow with their pairs."""
    from pyspark import SparkContext
    from tessera.llm import cover_tree
    monkeypatch.setattr(cover_tree, "BLOCK", 16)
    monkeypatch.setattr(cover_tree, "CHUNK_BYTES", 20_000, raising=False)
    rng, plans, rounds = np.random.default_rng(5), [], []
    x = np.repeat(rng.normal(size=(60, 8)), 3, axis=0) + rng.normal(0, 0.1, size=(180, 8))
    cut, share = cover_tree.checkpointed, SparkContext.broadcast
    monkeypatch.setattr(cover_tree, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, v: rounds.append(v) or share(self, v))
    frame_ = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(frame_).collect()}
    y = x.astype(np.float32).astype(np.float64)
    y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
    links = np.argwhere(np.triu(y @ y.T >= 0.9, 1))
    root, n = groups(len(x), links.tolist()), np.bincount(links.ravel(), minlength=len(x))
    assert got == {k: (n[k], root[k]) for k in range(len(x))}
    assert not any("Join" in p for p in plans if "load" in p)
    assert len(rounds) > 1 and all(sum(len(load) for _, load in r) <= 20_000 for r in rounds)


def test_decontamination(spark):
    from tessera.llm.decontaminate import clean, contaminated
    rng = random.Random(6)
    vocabulary = ["w%s" % "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(900)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate((30, 50, 13, 9, 5, 40))]
    items += [(6, None), (7, ""), (None, items[0][1]), (8, items[5][1])]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    swapped = items[1][1].split()
    swapped[4::9] = ["changed"] * len(swapped[4::9])
    rows = [(1, text(80) + " " + items[0][1].upper() + "! " + text(50)), (2, text(9) + " " + " ".join(swapped)), (3, text(400)),
            (4, " ".join(items[2][1].split()[:10]) + " " + text(20)), (5, items[3][1]), (6, items[4][1]), (7, None), (8, ""),
            (None, items[0][1]), (9, items[5][1] + " " + items[5][1]), (10, " ".join(items[1][1].split()[20:])),
            (11, text(20_000)), (11, items[2][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(frame(spark, rows), bench).collect()}
    assert got == {(1, 0), (2, 1), (5, 3), (9, 5), (9, 8), (10, 1), (11, 2)}
    kept = clean(frame(spark, rows), bench)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 4, 6, 7, 8]
    assert contaminated(frame(spark, []), bench).count() == 0
    assert contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_covering_masks_leave_a_seed():
    from itertools import combinations
    from tessera.llm.decontaminate import covering
    for share, sizes in ((0.8, range(1, 14)), (0.7, (13, 20)), (1.0, (13,))):
        for n in sizes:
            laid = [{i + o for o, m in enumerate(mask) if m == "1"}
                    for mask in covering(n, share) for i in range(n - len(mask) + 1)]
            for wrong in combinations(range(n), n - math.ceil(n * share)):
                assert any(not ones & set(wrong) for ones in laid), (share, n, wrong)


def test_decontamination_complete(spark, tmp_path):
    """Every accepted place is found: short items, and each pattern of changed words."""
    from itertools import combinations

    import corpus_pipeline
    from tessera.llm.decontaminate import contaminated
    lengths = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 16)
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in lengths}
    rows, want, key = [], set(), 0
    for n, words in items.items():
        size = min(n, 13)
        allowed = size - math.ceil(size * 0.8)
        for count in range(allowed + 2):
            for wrong in combinations(range(size), count):
                if count > allowed and key % 3:  # some of the patterns that are not accepted
                    key += 1
                    continue
                # of a longer item only a window is there
                text = ["changed" if k in wrong else words[k + (n - size) // 2] for k in range(size)]
                rows.append((key, " ".join(["before"] * (key % 4) + text + ["after"] * (key % 3))))
                want |= {(key, n)} if count <= allowed else set()
                key += 1
    bench = spark.createDataFrame([(n, " ".join(w), 1) for n, w in items.items()] + [(99, None, 1), (98, "", 1)],
                                  "item_id long, text string, doc_id int")
    docs = frame(spark, rows)
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench, complete=True).collect()} == want
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.drop_benchmark(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in rows} - {k for k, _ in want}
    assert contaminated(docs, bench.limit(0), complete=True).count() == 0
