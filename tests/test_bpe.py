import random

from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import Whitespace
from tokenizers.trainers import BpeTrainer

from tessera.operators import bpe

SPECIALS = ["[UNK]", "[START]", "[END]", "[PAD]", "[MASK]"]


def test_bpe_fixture(spark):
    df = spark.createDataFrame([(0, "ab ab cd cd ba! zz"), (1, "abab cdcd zz é")],
                               "doc_id long, text string")
    m = bpe.train(df, "text", vocab_size=30)
    got = {r.token: r.id for r in m.vocab.collect()}
    exp = dict(zip(SPECIALS + ["!", "a", "b", "c", "d", "z", "é", "ab", "cd", "zz", "ba",
                               "abab", "cdcd"], range(18)))
    assert got == exp
    q = spark.createDataFrame([(0, "abcd ba!! Q [PAD] QQ")], "doc_id long, text string")
    assert bpe.encode(q, m, "text", ["doc_id"], max_len=None).first().ids == \
        [1, 12, 13, 15, 5, 5, 0, 3, 0, 0, 2]
    assert bpe.encode(q, m, "text", ["doc_id"], max_len=6).first().ids == [1, 12, 13, 15, 5, 2]
    assert bpe.encode(q, m, "text", ["doc_id"], max_len=14).first().ids == \
        [1, 12, 13, 15, 5, 5, 0, 3, 0, 0, 2, 3, 3, 3]
    assert all(r.ok for r in bpe.check_specials(m).collect())


def test_bpe_matches_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    tk = Tokenizer(BPE(unk_token="[UNK]"))
    tk.pre_tokenizer = Whitespace()
    tk.train_from_iterator([r.text for r in rows],
                           BpeTrainer(special_tokens=SPECIALS, vocab_size=300, show_progress=False))
    m = bpe.train(docs, "text", vocab_size=300)
    assert {r.token: r.id for r in m.vocab.collect()} == tk.get_vocab()
    got = {r.doc_id: r.ids for r in bpe.encode(docs, m, "text", ["doc_id"], max_len=None).collect()}
    for r in rows:
        assert got[r.doc_id] == [1] + tk.encode(r.text).ids + [2]
    dec = {r.doc_id: r.text for r in bpe.decode(
        bpe.encode(docs, m, "text", ["doc_id"], max_len=None), m, "ids", ["doc_id"],
        skip_special=True).collect()}
    for r in rows[:20]:
        assert dec[r.doc_id] == tk.decode(tk.encode(r.text).ids, skip_special_tokens=True)


def test_bpe_save_load_roundtrip(spark):
    from tessera.session import scratch_dir
    from tessera.sources import corpus as src
    df = spark.createDataFrame([(0, "ab ab cd cd ba! zz"), (1, "abab cdcd zz é")],
                               "doc_id long, text string")
    m = bpe.train(df, "text", vocab_size=30)
    path = scratch_dir(spark, "t-bpe")
    src.save_bpe(m, path)
    m2 = src.load_bpe(spark, path)
    assert m2.size == m.size and m2.merge_list == m.merge_list and m2.alphabet == m.alphabet
    q = spark.createDataFrame([(0, "abcd ba!! Q [PAD] QQ")], "doc_id long, text string")
    assert bpe.encode(q, m2, "text", ["doc_id"], max_len=None).first().ids == \
        [1, 12, 13, 15, 5, 5, 0, 3, 0, 0, 2]


def test_fit_tokenizer_dispatch(spark):
    import pytest
    from tessera.operators.vocab import fit_tokenizer
    df = spark.createDataFrame([(0, "ab ab")], "doc_id long, text string")
    assert fit_tokenizer(df, "space").kind == "word"
    assert fit_tokenizer(df, "ngram", n=2).n == 2
    assert fit_tokenizer(df, "bpe", vocab_size=8).size == 8
    with pytest.raises(ValueError):
        fit_tokenizer(df, "bogus")


def library(rows, size):
    tk = Tokenizer(BPE(unk_token="[UNK]"))
    tk.pre_tokenizer = Whitespace()
    tk.train_from_iterator(rows, BpeTrainer(special_tokens=SPECIALS, vocab_size=size, show_progress=False))
    return tk


def test_bpe_8000_matches_library(spark):
    """A useful size, and merging to the end, in few rounds."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r.text for r in docs.orderBy("doc_id").collect()]
    m = bpe.train(docs, "text", vocab_size=8000)
    tk = library(rows, 8000)
    assert {r.token: r.id for r in m.vocab.collect()} == tk.get_vocab() and m.size == 8000
    some = docs.limit(300)
    for r in bpe.encode(some.select("doc_id", "text").withColumn("t", F.col("text")), m, "t", ["doc_id", "text"], max_len=None).collect():
        assert r.ids == [1] + tk.encode(r.text).ids + [2]


def test_bpe_small_rounds_match_library(spark):
    """Ties, repeats of one letter, spelled-again tokens, and any bound on a round's runs."""
    rng = random.Random(5)
    for alphabet, longest in (("ab", 12), ("abc", 5), ("aaab", 30), ("abcdefgh", 6)):
        rows = [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(40)) for _ in range(12)]
        tk = library(rows, 400)
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        for max_runs in (3, 100_000):
            m = bpe.train(df, "text", vocab_size=400 if max_runs > 3 else 24, max_runs=max_runs)
            want = tk.get_vocab() if max_runs > 3 else library(rows, 24).get_vocab()
            assert {r.token: r.id for r in m.vocab.collect()} == want, (alphabet, max_runs)


def test_bpe_rows_stay_rows(spark):
    """Equal and null keys, null and empty texts; neither a shuffle nor an explode."""
    m = bpe.train(spark.createDataFrame([(0, "ab ab cd cd ba! zz " + "ab" * 40)], "doc_id long, text string"), "text", vocab_size=40)
    df = spark.createDataFrame([(1, "ab cd"), (1, "zz"), (1, "zz"), (None, "ba"), (2, None), (3, ""), (4, "abcd" * 30)], "doc_id long, text string")
    enc = bpe.encode(df, m, "text", ["doc_id"], max_len=None)
    plan = enc._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan
    got = bpe.decode(enc, m, "ids", ["doc_id"], skip_special=True)
    assert sorted(((r.doc_id or 0), r.text.replace(" ", "")) for r in got.collect()) == sorted(
        [(1, "abcd"), (1, "zz"), (1, "zz"), (0, "ba"), (2, ""), (3, ""), (4, "abcd" * 30)])
    assert {len(r.ids) for r in bpe.encode(df, m, "text", ["doc_id"], max_len=5).collect()} == {5}


def test_merge_symbols_long_words():
    """The heap over a linked list gives what the plain scan gives."""
    rng = random.Random(9)

    def plain(syms, ranks):
        while True:
            best = min((ranks[p] + p for p in zip(syms, syms[1:]) if p in ranks), default=None)
            if best is None:
                return syms
            syms = bpe._replaced(syms, best[2], best[3], best[1])

    for _ in range(300):
        ranks, symbols = {}, [0, 1, 2]
        for k in range(12):
            p = (rng.choice(symbols), rng.choice(symbols))
            if p not in ranks:
                ranks[p] = (len(ranks), 3 + k)
                symbols.append(3 + k)
        word = [rng.choice((0, 0, 1, 2)) for _ in range(rng.randint(20, 90))]
        assert bpe.merge_symbols(word, ranks) == plain(word, ranks)


def test_bpe_json_file(spark, tmp_path):
    """The file is the library's own, byte for byte, and both read the other's."""
    import pytest
    from tessera.sources import corpus as src
    rows = ["ab ab cd cd ba! zz \"q\" \\ \x01x \x7f", "abab cdcd zz \u00e9 \u65e5\u672c \U0001f388"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    m = bpe.train(df, "text", vocab_size=30)
    tk = library(rows, 30)
    src.save_bpe_json(m, f"{tmp_path}/ours.json")
    tk.save(f"{tmp_path}/theirs.json")
    ours, theirs = ((tmp_path / n).read_bytes() for n in ("ours.json", "theirs.json"))
    assert ours.rstrip(b"\n") == theirs.rstrip(b"\n")
    assert Tokenizer.from_file(f"{tmp_path}/ours.json").encode(rows[0]).ids == tk.encode(rows[0]).ids
    back = src.read_bpe_json(spark, f"{tmp_path}/theirs.json")
    assert (back.size, back.merge_list, back.alphabet) == (m.size, m.merge_list, m.alphabet)
    assert sorted(map(tuple, back.vocab.collect())) == sorted(map(tuple, m.vocab.collect()))
    (tmp_path / "bad.json").write_text(theirs.decode().replace('"Whitespace"', '"Metaspace"'))
    with pytest.raises(ValueError):
        src.read_bpe_json(spark, f"{tmp_path}/bad.json")


def test_training_brings_ranked_pairs_once(spark, monkeypatch):
    """A round's best pairs reach the driver as they are, not once a task:
    only the alphabet is collected; ties go to the smaller pair."""
    rows = [(c, [a, b, a]) for a in range(5, 15) for b in range(5, 15) for c in (1, 2)]
    words = spark.createDataFrame(rows, "cnt long, syms array<int>").repartition(8)
    every = sorted((-r.c, r.l, r.r) for r in bpe._pair_counts(words).collect())
    assert [(-c, l, r) for c, l, r in bpe._top_pairs(words, 30).tolist()] == every[:30]
    calls, real = [], type(words).collect
    monkeypatch.setattr(type(words), "collect", lambda self: calls.append(1) or real(self))
    docs = spark.createDataFrame([("ab abc bcd abab cde",), ("abcd cd ab",)], "text string")
    assert bpe.train(docs, "text", vocab_size=40).size > 10 and len(calls) == 1


def test_training_lets_rare_words_go(spark, monkeypatch):
    """Pairs that the room rules out leave the rounds, and the vocabulary stays
    the library's; also with runs of one letter."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = ["".join(rng.choice(letters) for _ in range(7)) for _ in range(1540)]
    rows = [" ".join(words[:40] + [letters])] * 20 + [" ".join(words[k:k + 70]) for k in range(40, 1540, 70)]
    sizes, real = [], bpe.cut_lineage

    def kept(df):
        sizes.append((out := real(df)).count())
        return out

    monkeypatch.setattr(bpe, "cut_lineage", kept)
    m = bpe.train(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "text", vocab_size=107, max_runs=30)
    assert {r.token: r.id for r in m.vocab.collect()} == library(rows, 107).get_vocab()
    assert sizes[1] > 1500 and len(sizes) > 2 and max(sizes[2:]) < 400  # pieces that share a frequent word's pairs stay
    rows = [" ".join("".join(rng.choice("aaab") for _ in range(rng.randint(1, 30))) for _ in range(40)) for _ in range(12)]
    rows += [" ".join("a" * n for n in range(2, 40))] * 3
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert bpe._floor(bpe.word_counts(df, "text"), 30 - 7) > 1
    m = bpe.train(df, "text", vocab_size=30, max_runs=20)
    assert {r.token: r.id for r in m.vocab.collect()} == library(rows, 30).get_vocab()
