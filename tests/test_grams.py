"""N-grams in arrays of code points, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import grams
from tessera.operators import vocab as vc

ODD = [(4, "cat a  housé \U0001f388x　b"), (4, "a cat"), (4, "cat cat zz"), (None, "qu cat\x1cb"), (-9, "  "), (7, None), (8, ""),
       (9, "#a+b ## + ab#"), (10, "[PAD] [UNK]x"), (11, "unseen 日本 日"), (12, "a" * 50 + "\n" + "b" * 3)]


def plain_grams(text, n, start, end):
    return [s[k:k + n] for w in (text or "").split() for s in [start + w + end] for k in range(len(s) - n + 1)]


def plain_words(tokens, n, start, end):
    text = "".join(tokens).replace(start, "").replace(end, " ")
    return " ".join(w if len(w) == 1 or len(w) <= n - 2 else w[:n - 1] + w[2 * n - 2::n] for w in text.split())


@pytest.mark.parametrize("n,marks,part,table", [(3, "#+", 1 << 20, 24), (2, "<>", 5, 24), (3, "#+", 7, 2), (5, "#+", 1 << 20, 24), (1, "#+", 9, 24)])
def test_ngrams_are_cut_in_arrays(spark, n, marks, part, table, monkeypatch):
    """Vocabulary, ids and texts, also in small parts and without the table of places;
    no row of the plans is a gram."""
    rng = random.Random(n)
    rows = ODD + [(rng.randrange(-20, 20), "".join(rng.choice("abc é\n") for _ in range(rng.randrange(60)))) for _ in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    start, end = marks
    monkeypatch.setattr(grams.parts, "__defaults__", (part,))
    monkeypatch.setattr(grams, "PART_POINTS", part)
    monkeypatch.setattr(grams, "TABLE_BITS", table)
    v = vc.fit_vocab(df.where("doc_id is null or doc_id != 11"), "text", ["doc_id"], kind="ngram", n=n, start_char=start, end_char=end)
    first = {}
    for key, text in rows:
        if key != 11:
            for pos, g in enumerate(plain_grams(text, n, start, end)):
                place = (float("-inf") if key is None else key, pos)
                first[g] = min(first.get(g, place), place)
    ids = {r.token: r.id for r in v.table.collect()}
    known = [t for t in ids if ids[t] >= 5]
    assert set(known) == set(first) - set(vc.SPECIAL_TOKENS)
    assert sorted(first[t] for t in known) == [first[t] for t in sorted(known, key=ids.get)]
    for most in (None, 6):
        enc = vc.encode(df, v, "text", ["doc_id"], max_len=most)
        want = [(k, [ids.get(g, 0) for g in plain_grams(t, n, start, end)]) for k, t in rows]
        full = lambda x: [1] + x + [2] if most is None else [1] + x[:most - 3] + [2] + [3] * (most - 2 - len(x[:most - 3]))
        assert sorted(map(repr, map(tuple, enc.collect()))) == sorted(repr((k, full(x))) for k, x in want)
        names = {i: t for t, i in ids.items()}
        for dropped in (True, False):
            dec = vc.decode_ngrams(enc, "ids", v, ["doc_id"], remove_special=dropped)
            told = [(k, [names[i] for i in full(x) if not dropped or names[i] not in vc.SPECIAL_TOKENS]) for k, x in want]
            assert sorted(map(repr, map(tuple, dec.collect()))) == sorted(repr((k, plain_words(x, n, start, end))) for k, x in told)
        plan = dec._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan and "Exchange hashpartitioning" not in plan
    odd = spark.createDataFrame([(1, [5, None]), (2, None)], "doc_id long, ids array<long>")
    got = vc.decode_ngrams(odd, "ids", v, ["doc_id"]).orderBy("doc_id").collect()
    assert [r.text for r in got] == [plain_words([names[5]], n, start, end), ""]
    with pytest.raises(Exception, match="unknown id 99999"):
        vc.decode_ngrams(odd.select("doc_id", F.array(F.lit(99999)).alias("ids")), "ids", v, ["doc_id"]).collect()
