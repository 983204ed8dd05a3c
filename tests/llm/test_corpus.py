"""Fill-in-the-middle, quality rules and tokenizer alignment: against plain versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("N", T.StringType()),
                     T.StructField("Output", T.StringType()), T.StructField("_parts", T.IntegerType())])
WORD = r"[^\x20\x09-\x0D]+"


def frame(spark, rows, langs=("en",)):
    return spark.createDataFrame([(i, t, langs[k % len(langs)], "x", "y", k) for k, (i, t) in enumerate(rows)], DOCS)


def sample_texts(seed, n=250):
    rng = random.Random(seed)
    part = ["a", "ab", "é", "日本", "x1", "<P", "<", ">", "<S>", "🎈", " ", "  ", "\n", "\t\x0b", "\x0c\r", " ", "w" * 40, "The", "Haus,"]
    out = ["".join(rng.choice(part[:6] + part[9:] if rng.random() < 0.9 else part) + rng.choice(["", " "])
                   for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return out + [None, "", " ", "one", " one", "one ", "\n", "é ", "日", "long words " * 30_000, "z" * 70_000]


# fill in the middle

def plain_fim(i, text, seed=42, fim=50, spm=80):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(tokens)
    if i is None:
        return n, "plain", None, None, text
    digest = hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (tokens[:low], tokens[low:high], tokens[high:]))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("fim, spm", [(50, 80), (100, 50)])
def test_fill_middle(spark, fim, spm):
    from pyspark.sql import functions as F
    from tessera.llm.fill_middle import restored, transform
    rows = [(k, t) for k, t in enumerate(sample_texts(1))] + [(None, "no id here"), (3, "tied id"), (3, "tied id"), (5000, "a<<M x <M b> <S")]
    out = transform(frame(spark, rows), fim_percent=fim, spm_percent=spm)
    assert {"lang", "_parts"} <= set(out.columns) and len({c.lower() for c in out.columns}) == len(out.columns)
    got = out.withColumn("back", restored(F.col("output"), F.col("form"))).orderBy("_parts").collect()
    for (i, text), r in zip(rows, got):
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(i, text, fim=fim, spm=spm)
        assert r["back"] == (text or "")
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert transform(frame(spark, [])).count() == 0


def test_wavelet_matrix():
    import numpy as np
    from tessera.llm.fill_middle import WaveletMatrix
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 1000):
        s = rng.integers(0, 6, n).astype(np.uint8)
        m, place = WaveletMatrix(s), np.arange(n + 1)
        for c in range(6):
            assert np.array_equal(m.rank(c, place), np.concatenate(([0], np.cumsum(s == c))))
        total = np.concatenate(([0], np.cumsum(np.isin(s, (1, 4)))))
        k = np.arange(total[-1] + 1)
        assert np.array_equal(m.reaches((1, 4), np.zeros(len(k), np.int64), np.full(len(k), n), k),
                              [int(np.flatnonzero(total >= x)[0]) for x in k])


# quality rules

def plain_measures(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    again = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 3)} if len(windows) < 3000 else None
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, None if again is None else len(again)


def plain_model(rows, order):
    """{(lang, n-gram): probability}: modified Kneser-Ney, read from its definition."""
    from collections import Counter
    def codes(text):
        return [ord(" ") if chr(b) in " \t\n\x0b\x0c\r" else ord("0") if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else max(1, b)
                for b in (text or "").encode()]
    def of(text):
        c = [0] * (order - 1) + codes(text)
        return [tuple(c[k:k + order]) for k in range(len(c) - order + 1)]
    models = {}
    for lang in {l for _, _, l in rows}:
        top = Counter(g for _, t, l in rows if l == lang for g in of(t))
        levels = {order: top}
        for k in range(order - 1, 0, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        prob = {(): 1 / 256}
        for k in range(1, order + 1):
            t = [sum(n == r for n in levels[k].values()) for r in range(5)]
            y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0
            d = [0] + [max(0.01, r - (r + 1) * y * t[r + 1] / t[r]) if t[r] and t[r + 1] and t[1] else r / 2 for r in (1, 2, 3)]
            sums, kinds = Counter(), {}
            for g, n in levels[k].items():
                sums[g[:-1]] += n
                kinds.setdefault(g[:-1], [0] * 4)[min(n, 3)] += 1
            new = {}
            for g, n in levels[k].items():
                gamma = sum(d[r] * kinds[g[:-1]][r] for r in (1, 2, 3)) / sums[g[:-1]]
                new[g] = max(0, n - d[min(n, 3)]) / sums[g[:-1]] + gamma * prob[g[1:]]
            prob = new
        models[lang] = prob
    return models, of


def test_measures(spark):
    import numpy as np
    from tessera.llm.perplexity import measures
    rng = random.Random(5)
    texts = [(t or "") for t in sample_texts(2)] + [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(80)]
    texts += ["x y\n x y\nx y\n\n  \n  \nx y", "a b c a b c", "a b c d a b", "same same same same"]
    raw = [t.encode() for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    got = list(zip(*[m.tolist() for m in measures(np.frombuffer(b"".join(raw), np.uint8), starts)]))
    for t, g in zip(texts, got):
        want = plain_measures(t)
        assert g[:4] == want[:4] and (want[4] is None or g[4] == want[4]), t
    alone = [measures(np.frombuffer(r, np.uint8), np.array([0, len(r)])) for r in raw[:100]]
    assert [tuple(int(m[0]) for m in a) for a in alone] == [tuple(g) for g in got[:100]]


def lm_rows():
    rng = random.Random(8)
    syllables = {"en": ["the", "an", "ti", "on", "re"], None: ["qu\u00e9", "la", "do", "es"]}
    make = lambda l, n: " ".join("".join(rng.choice(syllables[l]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(k, make("en" if k % 3 else None, rng.randint(50, 90)), "en" if k % 3 else None) for k in range(90)]
    rows += [(100, "zx9 #@!\u6f22 Wq" * 60 + " x" * 60, "en"), (101, "a b c " * 40, "en"), (102, None, "en"), (103, "", None),
             (104, "lone words of a language", "xx"), (None, rows[1][1], "en"), (105, rows[1][1], "en"), (105, rows[1][1], "en")]
    return rows


def test_quality_rules(spark):
    import math
    from tessera.llm import perplexity as p
    rows = lm_rows()
    docs = spark.createDataFrame([(i, t, l, "mine", 7) for i, t, l in rows],
                                 "doc_id long, text string, lang string, l string, N_Words int").repartition(5)
    plain, of = plain_model(rows, 3)
    scored = p.score(docs, p.probabilities(p.counts(docs, order=3), order=3), order=3)
    assert len({c.lower() for c in scored.columns}) == len(scored.columns)
    got = {(r["doc_id"], r["text"], r["lang"]): r for r in p.judge(scored, p.bands(scored)).collect()}
    assert len(got) == len(rows) - 1  # one row is there twice
    ppl = {}
    for i, t, l in rows:
        r = got[i, t, l]
        assert tuple(r[c] for c in p.MEASURES) == plain_measures(t) and r["l"] == "mine"
        logs = [math.log(plain[l][g]) for g in of(t)] if t else []
        ppl[i, t, l] = -sum(logs) / len(logs) if logs else None
        assert (r["log_perplexity"] is None) == (not logs) and (not logs or abs(r["log_perplexity"] - ppl[i, t, l]) < 1e-5)
        n, rep = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n) and not (r["kept"] and (r["base_failed"] or not r["in_band"]))
    # the bands, from the sorted values
    for lang in ("en", None):
        own = sorted(round(got[k]["log_perplexity"] // p.STEP) for k in got for _ in range(1 + (k[0] == 105)) if k[2] == lang and not got[k]["base_failed"])
        q1, q2, q3 = ((own[math.ceil(q * len(own)) - 1] + 0.5) * p.STEP for q in (0.25, 0.5, 0.75))
        low, high = q2 - p.REACH * max(q2 - q1, p.LEAST), q2 + p.REACH * max(q3 - q2, p.LEAST)
        for k, r in got.items():
            if k[2] == lang and r["log_perplexity"] is not None:
                assert r["in_band"] == (low <= r["log_perplexity"] <= high)
    assert got[100, rows[90][1], "en"]["kept"] is False and got[1, rows[1][1], "en"]["kept"]
    # a model beyond the broadcast bound gives the same by a join
    joined = p.score(docs, p.probabilities(p.counts(docs, order=3), order=3), order=3, max_model=0)
    assert set(joined.columns) == set(scored.columns)
    for r in joined.collect():
        want = got[r["doc_id"], r["text"], r["lang"]]["log_perplexity"]
        assert (r["log_perplexity"] is None) == (want is None) and (want is None or abs(r["log_perplexity"] - want) < 1e-9)


def test_quality_rules_empty(spark):
    from tessera.llm import perplexity as p
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    scored = p.score(docs, p.probabilities(p.counts(docs)))
    assert p.judge(scored, p.bands(scored)).count() == 0


# tokenizer alignment

public_tokenizers = pytest.importorskip("public_tokenizers")


def plain_alignment(texts):
    """Rows of op13 from the two libraries and byte sets, without stretches or blocks."""
    import os
    from collections import Counter
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer
    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in letters}
    for b in range(256):
        if b not in letters:
            byte_of[chr(256 + len(byte_of) - len(letters))] = b
    links, out, total = [], [], Counter()
    for t in texts:
        a = [(i, bytes(byte_of[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(i, bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("\u2581", " ").encode())
             for i in b_lib.encode(t)] if t else []
        if not t or b"".join(x for _, x in a) != (" " + t).encode() or b"".join(x for _, x in b) != (" " + t).encode():
            links.append([])
            out.append((0, 0, 0, 0, ""))
            continue
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        own = []
        j = 0
        for i, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                own.append((i, spans[1][k][0]))
                k += 1
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        parts, p, q = [], 0, 0
        for end in ends:
            x, y = [], []
            while p < len(a) and spans[0][p][2] <= end:
                x.append(str(spans[0][p][0]))
                p += 1
            while q < len(b) and spans[1][q][2] <= end:
                y.append(str(spans[1][q][0]))
                q += 1
            parts.append(",".join(x) + "|" + ",".join(y))
        links.append(own)
        total.update(own)
        out.append((len(a), len(b), len(ends), len(own), ";".join(parts)))
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return [(na, nb, ng, nl, sum(total[x] == most[x[1]] for x in own), sum(total[x] for x in own), g)
            for (na, nb, ng, nl, g), own in zip(out, links)]


def alignment_texts():
    rng = random.Random(11)
    part = ["the", "Water", "tion", "Stra\u00dfe", "\u65e5\u672c\u8a9e", "x1", "3.14", "it's", "\U0001f388", "\u00a0", "  ", "\n", "\t", "\r\n", " \n", "\u3000",
            "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "'re", "\x00", "\x1c", "e\u0301", "\u0e01\u0e33", "aaaa", "''", "--", "#", "\u2028"]
    out = ["".join(rng.choice(part) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    return out + [None, "", " ", "  ", "\n", "a", "has \u2581 inside", "\u2581", "z" * 3000, "word " * 5000, "double  spaces  all  over " * 300] + out[:20]


def test_cross_tokens(spark, monkeypatch):
    from tessera.llm import cross_tokens
    from tessera.llm.corpus_queries import tokenizer_pair
    monkeypatch.setattr(cross_tokens, "BLOCK", 2000)
    monkeypatch.setattr(cross_tokens, "KEPT", 50)
    texts = alignment_texts()
    want = plain_alignment(texts)
    pair = tokenizer_pair(spark)
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)]
    docs = frame(spark, rows).withColumn("n_best", pytest.importorskip("pyspark.sql.functions").lit("old")).repartition(3)
    out = pair.align(docs)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    got = {r["_parts"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for k, w in enumerate(want):
        r = got[k]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) == w, (k, texts[k])
        assert r["doc_id"] == rows[k][0] and r["lang"] == "en"
    digests = {r["_parts"]: r["groups"] for r in pair.align(docs, groups="sha256").collect()}
    assert all(digests[k] == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for k, w in enumerate(want))
    assert sum(w[0] == 0 for w in want) == 4 and pair.align(frame(spark, [])).count() == 0


def test_identity_map():
    from tessera.llm.cross_tokens import identity_map
    assert identity_map([b"a", b"b", b"", b"c"], [b"x", b"a", b"a", b"c"], later=[1]).tolist() == [2, -1, -1, 3]
