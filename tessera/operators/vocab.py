"""Word and character n-gram vocabularies: fit (first-occurrence ids),
encode to fixed-length id arrays, decode.

Fit is ``explode -> groupBy(token) min(first place) -> dense rank`` with the
rank from ``with_row_index`` (range sort + partition offsets), so the
vocabulary never passes through one task. When the vocabulary's row count
(known from fitting) is under a limit it is broadcast: decode looks ids up
where the row is, encode deals rows before it explodes them. Beyond the limit
rows are dealt in blocks, each block's different values are joined with
the vocabulary once, and meet their block's rows in a cogroup. N-grams are
cut and counted in arrays of code points (see ``grams``): no text is exploded
into its grams.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.constants import (END, FIRST_FREE_ID, NGRAM_END_CHAR, NGRAM_N,
                               NGRAM_START_CHAR, PAD, SPECIAL_TOKENS, START, UNK)
from tessera.functions.text import drop_tokens, split_ws
from tessera.operators import grams
from tessera.operators.ids import with_row_index
from tessera.session import cut_lineage

# Vocabularies up to this many rows are broadcast to the lookup joins
# (~100 bytes a row -> ~200 MB at the limit); larger ones are shuffle-joined.
BROADCAST_MAX_ROWS = 2_000_000
#: rows of a block that share one dictionary beyond that limit (about)
BLOCK_ROWS = 16_384
#: a value is hot when it makes more than this part of all values
HOT_SHARE = 1000


@dataclass
class Vocab:
    """A fitted vocabulary: ``table`` is ``DataFrame<token STRING, id INT>``
    including the five special tokens."""

    table: DataFrame
    size: int
    kind: str = "word"
    cased: bool = True
    n: int = NGRAM_N
    start_char: str = NGRAM_START_CHAR
    end_char: str = NGRAM_END_CHAR
    params: dict = field(default_factory=dict)

    def lookup(self) -> DataFrame:
        t = self.table
        return F.broadcast(t) if self.size <= BROADCAST_MAX_ROWS else t


def specials_table(spark: SparkSession) -> DataFrame:
    """K1: the five special tokens and their fixed ids."""
    return spark.createDataFrame(list(SPECIAL_TOKENS.items()), "token string, id bigint")


def _case(text: Column, cased: bool) -> Column:
    return text if cased else F.lower(text)


# ------------------------------------------------------------------- K7
def char_ngrams(word: Column, n: int = NGRAM_N, start_char: str = NGRAM_START_CHAR,
                end_char: str = NGRAM_END_CHAR) -> Column:
    """K7: windows of ``n`` characters over start_char + word + end_char."""
    s = F.concat(F.lit(start_char), word, F.lit(end_char))
    cnt = F.length(s) - F.lit(n - 1)
    return F.when(cnt >= 1, F.transform(F.sequence(F.lit(1), cnt),
                                        lambda i: F.substring(s, i, n))) \
            .otherwise(F.array().cast("array<string>"))


def word_grams(words: Column, n: int = NGRAM_N, start_char: str = NGRAM_START_CHAR,
               end_char: str = NGRAM_END_CHAR) -> Column:
    """Grams of every word, flattened in (word, gram) order."""
    return F.flatten(F.transform(words, lambda w: char_ngrams(w, n, start_char, end_char)))


def tokens_of(text: Column, kind: str, cased: bool = True, n: int = NGRAM_N,
              start_char: str = NGRAM_START_CHAR, end_char: str = NGRAM_END_CHAR) -> Column:
    """Token array of a sentence for a vocabulary kind (nulls -> empty)."""
    words = F.coalesce(split_ws(_case(text, cased)), F.array().cast("array<string>"))
    if kind == "word":
        return words
    if kind == "ngram":
        return word_grams(words, n, start_char, end_char)
    raise ValueError(f"unknown vocabulary kind {kind!r}")


# ------------------------------------------------------------------- K2 / K8
def _place(row: Column, pos: Column) -> Column:
    """(row, position) as one number in the same order; a null row is first."""
    known = F.coalesce(row.cast("decimal(19,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(19,0)"))
    return known * F.lit(1 << 31).cast("decimal(10,0)") + pos.cast("decimal(10,0)")


def _first_grams(rows: DataFrame, n: int, start_char: str, end_char: str) -> DataFrame:
    """(row, __pos, token): the different n-grams of parts of a task's texts,
    each at its first place there."""
    key = rows.columns[0]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(key), null_placement="at_start"))
            points, begins = grams.code_points(batch.column("__t"))
            for a, b in grams.parts(np.diff(begins)):
                some = begins[a:b + 1] - begins[a]
                marked, places, held = grams.grams(points[begins[a]:begins[b]], some, n, start_char, end_char)
                row = np.repeat(np.arange(b - a), held)
                pos = np.arange(len(places)) - np.repeat(np.cumsum(held) - held, held)
                keys = batch.column(key).slice(a, b - a)
                rank = np.concatenate(([0], np.cumsum(np.diff(pc.rank(keys, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)))))
                # rows that share a key are one row here
                order = rank[row] << 32 | pos if len(rank) > 1 and not np.diff(rank).all() else None
                tokens, first, _ = grams.different(marked, places, n, order)
                yield pa.record_batch([keys.take(pa.array(row[first])), pa.array(pos[first].astype(np.int32)), pa.array(tokens, pa.string())],
                                      names=[key, "__pos", "token"])

    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("__pos", T.IntegerType()), T.StructField("token", T.StringType())]))


def fit_vocab(df: DataFrame, text_col: str = "text", order_cols: list[str] | None = None,
              kind: str = "word", cased: bool = True, n: int = NGRAM_N,
              start_char: str = NGRAM_START_CHAR, end_char: str = NGRAM_END_CHAR) -> Vocab:
    """Ids from 5 in first-occurrence order of the tokens
    under ``order_cols`` (row order) then position; special tokens keep
    their fixed ids."""
    order_cols = order_cols or ["doc_id"]
    number = len(order_cols) == 1 and isinstance(df.schema[order_cols[0]].dataType, T.IntegralType)
    if kind == "ngram" and number:
        toks = _first_grams(df.select(order_cols[0], _case(F.col(text_col), cased).alias("__t")), n, start_char, end_char)
    else:
        toks = df.select(*order_cols, F.posexplode(tokens_of(
            F.col(text_col), kind, cased, n, start_char, end_char)).alias("__pos", "token"))
    toks = toks.filter(~F.col("token").isin(list(SPECIAL_TOKENS)))
    if number:
        # one number a place: its minimum is kept by a hash aggregate, where
        # the minimum of a struct sorts all tokens
        first = toks.groupBy("token").agg(F.min(_place(F.col(order_cols[0]), F.col("__pos"))).alias("__o0"))
        okeys = ["__o0"]
    else:
        first = (toks.groupBy("token")
                     .agg(F.min(F.struct(*[F.col(c) for c in order_cols], F.col("__pos"))).alias("f"))
                     .select("token", *[F.col(f"f.{c}").alias(f"__o{i}") for i, c in
                                        enumerate(order_cols)], F.col("f.__pos").alias("__opos")))
        okeys = [f"__o{i}" for i in range(len(order_cols))] + ["__opos"]
    ranked, count = with_row_index(first, okeys, col="id", start=FIRST_FREE_ID,
                                   return_count=True)
    words = ranked.select("token", F.col("id").cast("bigint").alias("id"))
    table = specials_table(df.sparkSession).unionByName(words)
    return Vocab(table=table, size=count + len(SPECIAL_TOKENS), kind=kind, cased=cased, n=n,
                 start_char=start_char, end_char=end_char)


# ------------------------------------------------------------------- K5 / K9
def _kept(size: Column, max_len: int | None) -> Column:
    if max_len is None or max_len < 4:
        return size
    return F.least(size, F.lit(max_len - 3))


def wrap_ids(ids: Column, max_len: int | None) -> Column:
    """START + ids + END + PAD up to ``max_len`` (no pad when None)."""
    out = F.concat(F.array(F.lit(START)), ids, F.array(F.lit(END)))
    if max_len is None:
        return out
    pad = F.greatest(F.lit(0), F.lit(max_len - 2) - F.size(ids))
    return F.concat(out, F.array_repeat(F.lit(PAD), pad))


def _exploded(df: DataFrame, values: Column, vocab: Vocab, cols: list[str], name: str) -> DataFrame:
    """One row for each position of ``values``, under a number that each row
    of ``df`` has for itself (equal keys stay apart). With a broadcast
    vocabulary, rows are dealt by that number *before* the explode, and the
    regrouping shuffles nothing."""
    rows = df.select(*cols, values.alias("__t"), F.monotonically_increasing_id().alias("__row"))
    rows = rows.repartition("__row") if vocab.size <= BROADCAST_MAX_ROWS else rows
    return rows.select("__row", *cols, F.posexplode_outer("__t").alias("__pos", name))


def _matched(ex: DataFrame, on: str, vocab: Vocab) -> DataFrame:
    """Left join with the vocabulary. Beyond the broadcast limit the values
    that make more than a ``1 / HOT_SHARE`` of all (so at most ``HOT_SHARE``
    of them) are counted and looked up by broadcast, and only the others are
    shuffled: no value fills a task."""
    if vocab.size <= BROADCAST_MAX_ROWS:
        return ex.join(vocab.lookup(), on, "left")
    counts = cut_lineage(ex.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * HOT_SHARE > total).select(on)
    known = hot.join(vocab.table, on, "left").withColumn("__hot", F.lit(True))
    marked = ex.join(F.broadcast(known), on, "left")
    cold = marked.where(F.col("__hot").isNull()).select(ex.columns).join(vocab.table, on, "left")
    return marked.where("__hot").drop("__hot").unionByName(cold)


def _one(column):
    """A column of an Arrow table as one array."""
    import pyarrow as pa
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _replaced(rows, keys, found, default, strict: bool):
    """Arrow lists with each of ``keys`` replaced by its entry of ``found``;
    a null list is empty. Others become ``default`` or, if ``strict``, raise."""
    import pyarrow as pa
    import pyarrow.compute as pc
    flat = rows.flatten()
    at = pc.index_in(flat, value_set=keys)
    if strict:
        lost = flat.filter(pc.and_(pc.is_null(at), pc.is_valid(flat)))
        if len(lost):
            raise ValueError(f"unknown id {lost[0]}")
    got = found.take(at)
    if default is not None:
        got = pc.fill_null(got, pa.scalar(default, got.type))
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(rows), 0))
    starts = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    return pa.ListArray.from_arrays(starts, got)


def _looked_up(df: DataFrame, values: Column, vocab: Vocab, cols: list[str], on: str, to: str, out_col: str,
               default=None, strict: bool = False) -> DataFrame:
    """``cols`` and the array ``values`` (of ``on``) with each value's ``to``."""
    out_type, spark = vocab.table.schema[to].dataType, df.sparkSession
    rows, names = df.select(*cols, values.alias("__t")), [*cols, out_col]
    schema = T.StructType([*rows.select(*cols).schema.fields, T.StructField(out_col, T.ArrayType(out_type))])
    if vocab.size <= BROADCAST_MAX_ROWS:
        entries = vocab.table.where(F.col(on).isNotNull()).select(on, to).toArrow()
        shared = spark.sparkContext.broadcast((_one(entries[on]), _one(entries[to])))

        def find(batches):
            import pyarrow as pa
            for batch in batches:
                got = _replaced(batch.column("__t"), *shared.value, default, strict)
                yield pa.record_batch([*(batch.column(c) for c in cols), got], names=names)

        return rows.mapInArrow(find, schema)
    blocks = max(1, -(-df.count() // BLOCK_ROWS))
    # by the row's own content, so that every reading deals rows alike
    rows = rows.withColumn("__block", F.pmod(F.xxhash64(*cols, "__t"), F.lit(blocks)))
    needs = rows.select("__block", F.explode("__t").alias(on)).distinct()
    known = needs.join(vocab.table.select(on, to), on).select(F.col("__block").alias("__of"), on, to)

    def meet(left, right):
        import pyarrow as pa
        got = _replaced(_one(left["__t"]), _one(right[on]), _one(right[to]), default, strict)
        return pa.table([*(left[c] for c in cols), got], names=names)

    return rows.groupBy("__block").cogroup(known.groupBy("__of")).applyInArrow(meet, schema)


def lookup_ids(df: DataFrame, tokens: Column, vocab: Vocab, key_cols: list[str],
               out_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """Map a token array per row to ids (unknown -> [UNK]), order kept.
    ``key_cols`` and ``carry`` columns ride along; every row stays a row."""
    cols = [*key_cols, *(carry or [])]
    if vocab.size > BROADCAST_MAX_ROWS:
        return _looked_up(df, tokens, vocab, cols, "token", "id", out_col, default=UNK)
    j = _matched(_exploded(df, tokens, vocab, cols, "token"), "token", vocab)
    item = F.when(F.col("__pos").isNotNull(),
                  F.struct(F.col("__pos"), F.coalesce(F.col("id"), F.lit(UNK)).alias("id")))
    g = j.groupBy("__row", *cols).agg(F.array_sort(F.collect_list(item)).alias("__s"))
    return g.select(*cols, F.transform("__s", lambda x: x["id"]).alias(out_col))


def _gram_ids(df: DataFrame, vocab: Vocab, text_col: str, cols: list[str], max_len: int | None) -> DataFrame:
    """``cols`` and the ids ``__body`` of the n-grams that are kept."""
    rows = df.select(*cols, _case(F.col(text_col), vocab.cased).alias("__t"))
    entries = vocab.table.where(F.col("token").isNotNull()).select("token", "id").toArrow()
    shared = df.sparkSession.sparkContext.broadcast((_one(entries["token"]), _one(entries["id"])))
    most = None if max_len is None or max_len < 4 else max_len - 3
    n, start_char, end_char = vocab.n, vocab.start_char, vocab.end_char

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        known, ids = shared.value
        for batch in batches:
            points, begins = grams.code_points(batch.column("__t"))
            for a, b in grams.parts(np.diff(begins)):
                some = begins[a:b + 1] - begins[a]
                marked, places, held = grams.grams(points[begins[a]:begins[b]], some, n, start_char, end_char)
                if most is not None:
                    pos = np.arange(len(places)) - np.repeat(np.cumsum(held) - held, held)
                    places, held = places[pos < most], np.minimum(held, most)
                tokens, _, which = grams.different(marked, places, n)
                found = ids.take(pc.index_in(pa.array(tokens, pa.string()), value_set=known))
                found = pc.fill_null(found, pa.scalar(UNK, ids.type))
                ends = np.concatenate(([0], np.cumsum(held))).astype(np.int32)
                yield pa.record_batch([*(batch.column(c).slice(a, b - a) for c in cols),
                                       pa.ListArray.from_arrays(pa.array(ends), found.take(pa.array(which)))], names=[*cols, "__body"])

    kind = T.ArrayType(vocab.table.schema["id"].dataType)
    return rows.mapInArrow(run, T.StructType([*rows.select(*cols).schema.fields, T.StructField("__body", kind)]))


def encode(df: DataFrame, vocab: Vocab, text_col: str = "text", key_cols: list[str] | None = None,
           max_len: int | None = 512, out_col: str = "ids",
           carry: list[str] | None = None) -> DataFrame:
    """K5 / K9: fixed-length id arrays. Keeps min(W, max_len-3) tokens when
    max_len >= 4, then START .. END and PAD up to max_len; None = no cut,
    no pad."""
    key_cols = key_cols or ["doc_id"]
    if vocab.kind == "ngram" and vocab.size <= BROADCAST_MAX_ROWS:
        body = _gram_ids(df, vocab, text_col, [*key_cols, *(carry or [])], max_len)
        return body.select(*key_cols, *(carry or []), wrap_ids(F.col("__body"), max_len).alias(out_col))
    toks = tokens_of(F.col(text_col), vocab.kind, vocab.cased, vocab.n, vocab.start_char,
                     vocab.end_char)
    kept = F.slice(toks, 1, _kept(F.size(toks), max_len))
    body = lookup_ids(df, kept, vocab, key_cols, "__body", carry)
    return body.select(*key_cols, *(carry or []), wrap_ids(F.col("__body"), max_len).alias(out_col))


# ------------------------------------------------------------------- K6
def ids_to_tokens(df: DataFrame, ids_col: str, vocab: Vocab, key_cols: list[str],
                  out_col: str = "tokens", remove_special: bool = False,
                  carry: list[str] | None = None) -> DataFrame:
    """Id -> token, order kept; an id missing from the vocabulary
    raises, as a dictionary lookup would."""
    cols = [*key_cols, *(carry or [])]
    df = cut_lineage(df) if vocab.size > BROADCAST_MAX_ROWS else df  # read more than once
    got = _looked_up(df, F.col(ids_col).cast("array<bigint>"), vocab, cols, "id", "token", "__toks", strict=True)
    toks = drop_tokens(F.col("__toks")) if remove_special else F.col("__toks")
    return got.select(*cols, toks.alias(out_col))


def decode_words(df: DataFrame, ids_col: str, vocab: Vocab, key_cols: list[str],
                 out_col: str = "tokens", remove_special: bool = False) -> DataFrame:
    """K6: word decode; tokens as an array (join with ' ' for a sentence)."""
    return ids_to_tokens(df, ids_col, vocab, key_cols, out_col, remove_special)


# ------------------------------------------------------------------- K10
def rebuild_ngram_words(text: Column, n: int = NGRAM_N, start_char: str = NGRAM_START_CHAR,
                        end_char: str = NGRAM_END_CHAR) -> Column:
    """K10 string part: joined grams -> words. Drops the start marker, turns
    the end marker into a space, then keeps the first n-1 characters of each
    word and the last character of every following n-character gram."""
    s = F.replace(F.replace(text, F.lit(start_char), F.lit("")), F.lit(end_char), F.lit(" "))

    def one(w):
        ln = F.length(w)
        cnt = F.ceil((ln - F.lit(n - 1)) / F.lit(n)).cast("int")
        tail = F.when(cnt >= 1, F.array_join(F.transform(
            F.sequence(F.lit(0), cnt - 1),
            lambda j: F.substring(w, F.lit(n - 1) + j * F.lit(n) + F.lit(n), 1)), "")) \
                .otherwise(F.lit(""))
        return F.when((ln == 1) | (ln <= n - 2), w) \
                .otherwise(F.concat(F.substring(w, 1, n - 1), tail))

    return F.array_join(F.transform(split_ws(s), one), " ")


def _gram_texts(df: DataFrame, ids_col: str, vocab: Vocab, key_cols: list[str], out_col: str, remove_special: bool) -> DataFrame:
    """The same in arrays, with a broadcast vocabulary."""
    rows = df.select(*key_cols, F.col(ids_col).cast("array<bigint>").alias("__t"))
    known = vocab.table.where(F.col("id").isNotNull()).select(F.col("id").cast("bigint").alias("id"), "token").toArrow()
    shared = df.sparkSession.sparkContext.broadcast((_one(known["id"]), _one(known["token"])))
    n, start_char, end_char = vocab.n, vocab.start_char, vocab.end_char
    drop = list(SPECIAL_TOKENS) if remove_special else []

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        keys, tokens = shared.value
        tokens = pc.if_else(pc.is_in(tokens, value_set=pa.array(drop, pa.string())), "", tokens)
        letters, begin = grams.code_points(tokens)
        size = np.diff(begin)
        by = np.argsort(keys.to_numpy(), kind="stable")
        sorted_ = keys.to_numpy()[by]
        for batch in batches:
            column = batch.column("__t")
            length = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            for a, b in grams.parts(length, grams.PART_POINTS // 2):
                flat = column.slice(a, b - a).flatten()
                there = pc.is_valid(flat).to_numpy(zero_copy_only=False)
                ids = pc.fill_null(flat, 0).to_numpy()
                at = np.minimum(np.searchsorted(sorted_, ids), max(len(sorted_) - 1, 0))
                lost = there & (sorted_[at] != ids if len(sorted_) else True)
                if lost.any():
                    raise ValueError(f"unknown id {ids[lost][0]}")
                which = by[at] if len(sorted_) else at
                held = np.where(there, size[which], 0) if len(sorted_) else np.zeros(len(ids), np.int64)
                ends = np.concatenate(([0], np.cumsum(held)))
                spot = np.arange(ends[-1]) + np.repeat(begin[which] - ends[:-1] if len(sorted_) else ends[:-1], held)
                rows_ = ends[np.concatenate(([0], np.cumsum(length[a:b])))]
                yield pa.record_batch([*(batch.column(c).slice(a, b - a) for c in key_cols), grams.to_texts(
                    *grams.rebuilt(letters[spot], rows_, n, start_char, end_char))], names=[*key_cols, out_col])

    return rows.mapInArrow(run, T.StructType([*rows.select(*key_cols).schema.fields, T.StructField(out_col, T.StringType())]))


def decode_ngrams(df: DataFrame, ids_col: str, vocab: Vocab, key_cols: list[str],
                  out_col: str = "text", remove_special: bool = False) -> DataFrame:
    """N-gram ids -> sentence."""
    if vocab.size <= BROADCAST_MAX_ROWS and len(vocab.start_char) == len(vocab.end_char) == 1:
        return _gram_texts(df, ids_col, vocab, key_cols, out_col, remove_special)
    toks = ids_to_tokens(df, ids_col, vocab, key_cols, "__t", remove_special)
    return toks.select(*key_cols, rebuild_ngram_words(F.array_join("__t", ""), vocab.n,
                                                     vocab.start_char, vocab.end_char)
                       .alias(out_col))


# ------------------------------------------------------------------- K16
def fit_tokenizer(df: DataFrame, kind: str = "space", text_col: str = "text",
                  order_cols: list[str] | None = None, cased: bool = True, n: int = NGRAM_N,
                  vocab_size: int | None = None):
    """Tokenizer choice — ``space`` (words), ``ngram`` (character
    n-grams) or ``bpe`` (byte-pair; ``vocab_size`` required)."""
    if kind == "space":
        return fit_vocab(df, text_col, order_cols, "word", cased)
    if kind == "ngram":
        return fit_vocab(df, text_col, order_cols, "ngram", cased, n)
    if kind == "bpe":
        from tessera.operators import bpe
        if vocab_size is None:
            raise ValueError("bpe needs vocab_size")
        return bpe.train(df, text_col, vocab_size=vocab_size)
    raise ValueError(f"unknown tokenizer {kind!r}")
