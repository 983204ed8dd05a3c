"""Benchmark decontamination by spaced seeds (DataFrame functions only).

A mask of ones and zeros is laid on every word position of a test item and
of a document; the words under its ones are hashed, those under its zeros
are ignored, so a substituted word there does not hide the match. Equal
hashes give a diagonal (document position minus item position). On each
diagonal the two word sequences are compared word by word, and a document
holds an item if some window of ``window`` item words (all of a shorter
item) agrees in at least ``min_share`` of them.

The items' seed table is broadcast only while it has at most
``MAX_SEED_ROWS`` rows, which are counted first; beyond that the seeds meet
in a shuffle join, whose hot keys adaptive execution splits.

The two ``MASKS`` miss some places that the comparison would accept: items
shorter than a mask, and some patterns of changed words in short ones. With
``complete`` each length of item has masks of its own that leave a seed under
every accepted pattern, so every such place is found.

Cases: null text has no words; without ``complete``, an item with fewer words
than the shortest mask has no seed and is not searched for; rows without an id, on either
side, can't be named in a result and take no part; rows with one id count as
one document (or item) with several texts; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bind

#: two masks of weight six, so that no single substitution period blocks both
MASKS = ("11011011", "111001011")
#: (words of an item or window, words that may differ) -> masks of which one
#: has only agreeing words, wherever the others are
COVERING = {
    (13, 2): ("11101011", "11001111"),
    (12, 2): ("11101011", "101100111", "111111"),
    (11, 2): ("1110111", "111001011", "1011111", "111111"),
    (10, 2): ("111011", "11010011", "11111"),
    (9, 1): ("1111011", "1101111"),
    (8, 1): ("111111", "1111011", "1101111"),
    (7, 1): ("11111", "111011", "110111"),
    (6, 1): ("1111", "11011"),
    (5, 1): ("1111", "11101", "11011", "10111"),
}
#: 16 bytes of key and place each, some 60 MB in a hash table
MAX_SEED_ROWS = 1_000_000

_HASHES = "array<bigint>"


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words (runs of letters and digits)."""
    line = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))),
                                   r"[^\p{L}\p{N}]+", " "))
    return F.when(line == "", F.array().cast(_HASHES)).otherwise(
        F.transform(F.split(line, " ", -1), lambda w: F.xxhash64(w)))


def covering(n: int, min_share: float) -> tuple[str, ...]:
    """Masks that leave a seed in ``n`` words of which ``min_share`` agree."""
    wrong = n - math.ceil(n * min_share)
    # the words that agree make at most wrong + 1 runs
    return COVERING.get((n, wrong)) or ("1" * math.ceil((n - wrong) / (wrong + 1)),)


def seeds(hashes: Column, masks: tuple[str, ...] = MASKS, wanted=None) -> Column:
    """(pos, seed) of every position and mask; ``wanted`` (hashes, mask) tells
    whether the mask is laid on them."""
    def under(a: Column, k: int, mask: str) -> Column:
        ones = [o for o, m in enumerate(mask) if m == "1"]
        enough = F.size(a) >= len(mask)
        return F.when(enough if wanted is None else enough & wanted(a, mask), F.transform(
            F.sequence(F.lit(0), F.size(a) - len(mask)),
            lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(k), *[F.get(a, i + o) for o in ones]).alias("seed"))
        )).otherwise(F.array().cast("array<struct<pos:int,seed:bigint>>"))

    return bind(hashes, lambda a: F.concat(*[under(a, k, mask) for k, mask in enumerate(masks)]))


def _agreement(doc_words: Column, item_words: Column, window: int) -> Column:
    """(most agreeing words of a window, agreeing words in all) of two
    sequences that stand on one diagonal."""
    same = F.zip_with(doc_words, item_words, lambda a, b: (a == b).cast("int"))

    def best(s: Column) -> Column:
        total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        return F.struct(F.array_max(F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(s) - window + 1)),
            lambda i: total(F.slice(s, i, window)))).alias("best"), total(s).alias("n_match"))

    return bind(same, best)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text",
                 window: int = 13, min_share: float = 0.8, complete: bool = False) -> DataFrame:
    """One row (doc_id, item_id, n_match, n_words, best, start) for each
    document and the item it holds: agreeing words, words of the item, the
    best window's agreeing words, and the item's first word's position in
    the document (negative if the document starts inside the item)."""
    ident, item = F.col(f"`{id_col}`"), F.col(f"`{item_id_col}`")
    tests = (items.where(item.isNotNull())
             .select(item.alias("item_id"), word_hashes(F.col(f"`{item_text_col}`")).alias("q"))
             .distinct())
    masks, wanted = MASKS, None
    if complete:
        length = lambda q: F.least(F.size(q), F.lit(window))
        # at most ``window`` lengths; only their masks are laid on the documents
        of = {r["n"]: covering(r["n"], min_share)
              for r in tests.select(length(F.col("q")).alias("n")).where("n > 0").distinct().collect()}
        masks = tuple(sorted({m for ms in of.values() for m in ms})) or MASKS
        wanted = lambda q, mask: length(q).isin([n for n, ms in of.items() if mask in ms])
    places = (tests.select("item_id", F.size("q").alias("n"), F.explode(seeds(F.col("q"), masks, wanted)).alias("s"))
              .select("item_id", "n", F.col("s.pos").alias("at"), "s.seed"))
    if places.count() <= MAX_SEED_ROWS:
        places = F.broadcast(places)
    named = docs.where(ident.isNotNull()).select(ident.alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    hits = (named.select("doc_id", F.explode(seeds(word_hashes(F.col("t")), masks)).alias("s"))
            .select("doc_id", "s.pos", "s.seed").join(places, "seed")
            .groupBy("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.max("n").alias("n"))
            .groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonal", "n")).alias("c")))

    def aligned(b: Column) -> Column:
        return F.transform(b["c"], lambda c: F.struct(
            c["item_id"].alias("item_id"), c["diagonal"].alias("start"),
            F.slice(b["w"], F.greatest(F.lit(1), c["diagonal"] + 1),
                    c["n"] + F.least(F.lit(0), c["diagonal"])).alias("w")))

    found = (named.join(hits, "doc_id")
             .select("doc_id", F.explode(bind(F.struct(word_hashes(F.col("t")).alias("w"), "c"), aligned)).alias("c"))
             .select("doc_id", "c.*"))
    need = F.ceil(F.least(F.lit(window), F.size("q")) * F.lit(min_share))
    item_words = F.slice("q", F.greatest(F.lit(1), 1 - F.col("start")), F.size("w"))
    judged = (found.join(tests, "item_id")
              .select("doc_id", "item_id", F.size("q").alias("n_words"), "start", need.alias("need"),
                      _agreement(F.slice("w", 1, F.size(item_words)), item_words, window).alias("a"))
              .where(F.col("a.best") >= F.col("need")))
    top = F.max(F.struct(F.col("a.best").alias("best"), F.col("a.n_match").alias("n_match"),
                         (-F.col("start")).alias("back"), "n_words"))
    return judged.groupBy("doc_id", "item_id").agg(top.alias("m")).select(
        "doc_id", "item_id", F.col("m.n_match").cast("long").alias("n_match"),
        F.col("m.n_words").cast("long").alias("n_words"), F.col("m.best").cast("long").alias("best"),
        (-F.col("m.back")).cast("long").alias("start"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold an item; a row without an id
    takes no part and stays."""
    from tessera.llm.common import checkpointed, fresh
    key = fresh(docs, "key")
    bad = checkpointed(contaminated(docs, items, id_col, text_col, **how)
                       .select(F.col("doc_id").alias(key)).distinct())
    return docs.join(bad, F.col(f"`{id_col}`") == F.col(key), "left_anti")
