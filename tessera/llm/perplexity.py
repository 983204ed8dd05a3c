"""Quality rules with n-gram perplexity.

Fixed rules look at words, symbols, repeated lines and repeated windows of
words. Beside them every text is judged by an n-gram model of its language:
Spark counts all n-grams of ``ORDER`` bytes of all texts (each task adds up
its own before anything is shuffled), interpolated modified Kneser-Ney
probabilities are computed from the counts by joins, and the model is laid
down as an array of sorted 64-bit hashes beside an array of log
probabilities, in which scoring looks up all n-grams of a slice of texts at
once. A text whose perplexity leaves its language's band is rejected: the band
reaches from the median ``REACH`` times the distance to the lower and upper
quartile, taken over all documents of the language that the rules let pass.

The unit is the byte of the UTF-8 text (A-Z lower-cased, digits as 0, white
space as a space): the number of n-grams then follows what the languages
allow more than the length of the corpus. The arrays are broadcast if the
counted model has at most ``max_model`` n-grams; beyond that the n-grams of
each document are joined with the model.

Cases: null or empty text has no words, fails the rules and has no perplexity
(null); a null language is a language of its own; a text that its language
holds alone is its own model; a band needs the quartiles of its language, and
a language without a document that passes the rules has none to judge;
repeated rows get equal results; rows without an id are judged like any other; an
empty table gives an empty table; other columns are kept, and one with the
name of an output column is replaced. Windows and lines are compared by
64-bit hashes within one text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import SPACES, checkpointed, fresh, stored
from tessera.llm.hashed_words import _powers, mixed, text_slices

ORDER, ALPHABET = 5, 256
SYMBOLS = b"#*$%&|<>"
#: n-grams of a broadcast model (12 bytes each)
MAX_MODEL = 4_000_000
#: n-grams a task adds up before it hands them on
PENDING = 1_500_000
#: width of the bands in distances from median to quartile, least such
#: distance, and steps of the histogram, all in log perplexity a byte
REACH, LEAST, STEP = 8.0, 0.01, 0.002
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, text) of the runs of marked bytes;
    no run reaches into the next text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[starts] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    begin, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    return begin, last + 1, np.searchsorted(starts, begin, "right") - 1


def _seen_before(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in its text an equal one comes earlier, an equal one comes at all)."""
    own = mixed(key ^ mixed(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    earlier, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return earlier, any_


def measures(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The MEASURES of the texts that begin at ``starts``."""
    n, starts = len(starts) - 1, starts.astype(np.int64)
    table = np.zeros((4, 256), bool)
    table[0, list(SPACES.encode())] = True
    table[1, list(SYMBOLS)] = True
    table[2, 10] = True
    table[3, 128:192] = True  # bytes that continue a code point
    space, symbol, newline, more = (t[data] for t in table)
    upto = lambda mark: np.concatenate(([0], np.cumsum(mark)))
    per_text = lambda mark: np.diff(upto(mark)[starts])
    power, inverse = _powers(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)])))
    hash_of = lambda a, b: mixed((total[b] - total[a]) * inverse[a])

    begin, stop, text = _runs(~space, starts)
    word = hash_of(begin, stop)
    three = mixed(word[:-2] * np.uint64(3) + mixed(word[1:-1] * np.uint64(5) + mixed(word[2:])))
    inside = text[:-2] == text[2:]
    window = np.flatnonzero(inside)
    again = np.zeros(len(word), bool)
    if len(window):
        hit = window[_seen_before(text[window], three[window])[1]]
        for k in range(3):
            again[hit + k] = True

    a, b, of = _runs(~newline, starts)
    words_before = upto(~space)
    real = words_before[b] > words_before[a]
    dup, _ = _seen_before(of[real], hash_of(a[real], b[real])) if real.any() else (np.zeros(0, bool), None)
    return [np.bincount(text, minlength=n), per_text(~space & ~more), per_text(symbol),
            np.bincount(of[real][dup], minlength=n), np.bincount(text[again], minlength=n)]


def _code_table() -> np.ndarray:
    out = np.maximum(np.arange(256), 1).astype(np.int64)  # 0 stands before a text
    for b in range(128):
        c = chr(b)
        out[b] = ord(" ") if c in SPACES else ord("0") if c.isdigit() else max(1, ord(c.lower()))
    return out


def grams(data: np.ndarray, starts: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram that ends at each byte, its text): codes as one number, the
    last byte in the lowest eight bits; 0 stands for what precedes a text."""
    code = _code_table()[data]
    sizes = np.diff(starts)
    place = np.arange(len(data)) - np.repeat(starts[:-1], sizes)
    out = code.copy()
    for back in range(1, order):
        out[back:] |= np.where(place[back:] >= back, code[:-back], 0) << (8 * back)
    return out, np.repeat(np.arange(len(sizes)), sizes)


def _parts(batch_texts, batch_langs):
    """(n-grams, their texts' language hashes, texts) slice by slice."""
    at = 0
    langs = batch_langs.to_numpy(zero_copy_only=False)
    for data, starts in text_slices(batch_texts):
        starts = starts.astype(np.int64)
        to = at + len(starts) - 1
        yield data, starts, langs[at:to]
        at = to


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often each language holds each n-gram; ``lang``
    is the hash of the language."""
    def run(batches):
        import pyarrow as pa
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def merged(parts):
            lang, gram, n = (np.concatenate(x) for x in zip(*parts))
            at = np.lexsort((gram, lang))
            lang, gram, n = lang[at], gram[at], n[at]
            first = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (lang[1:] != lang[:-1]))))
            return lang[first], gram[first], np.add.reduceat(n, first)

        rows = lambda p: pa.record_batch([pa.array(x) for x in p], names=["lang", "gram", "n"])
        pending, size = [held], 0
        for batch in batches:
            for data, starts, langs in _parts(batch.column("t"), batch.column("l")):
                gram, text = grams(data, starts, order)
                for lang in np.unique(langs):
                    own = gram[(langs == lang)[text]]
                    if len(own):
                        u, n = np.unique(own, return_counts=True)
                        pending.append((np.full(len(u), lang), u, n))
                        size += len(u)
                if size > PENDING:
                    held = merged(pending)
                    pending, size = [held], 0
                    if len(held[0]) > PENDING:
                        yield rows(held)
                        pending = []
        if pending and sum(len(p[0]) for p in pending):
            yield rows(merged(pending))

    return (_inputs(docs, text_col, lang_col).mapInArrow(run, "lang long, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _lang(df: DataFrame, lang_col: str):
    name = F.col(f"`{lang_col}`").cast("string") if lang_col in df.columns else F.lit("")
    return F.xxhash64(F.coalesce(name, F.lit("")), name.isNull())


def _inputs(docs, text_col, lang_col):
    return docs.select(F.col(f"`{text_col}`").cast("string").alias("t"), _lang(docs, lang_col).alias("l"))


def probabilities(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, logp) of every counted n-gram by interpolated modified
    Kneser-Ney. Below the highest order an n-gram counts once for each code
    that stands before it; the lowest order is interpolated with the uniform
    distribution. Groups of a context hold at most ``ALPHABET`` rows. Where a
    language has too few n-grams to estimate a discount, 0.5, 1 and 1.5 are
    taken."""
    tables = {order: checkpointed(counted)}
    for k in range(order - 1, 0, -1):
        tables[k] = checkpointed(tables[k + 1].groupBy(
            "lang", F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count("*").alias("n")))
    lower = None
    for k in range(1, order + 1):
        times = lambda r: F.sum((F.col("n") == r).cast("long")).cast("double")
        met = tables[k].groupBy("lang").agg(*[times(r).alias(f"t{r}") for r in (1, 2, 3, 4)])
        y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
        d = [F.when((F.col(f"t{r}") > 0) & (F.col(f"t{r + 1}") > 0) & (F.col("t1") > 0),
                    F.greatest(F.lit(0.01), r - (r + 1) * y * F.col(f"t{r + 1}") / F.greatest(F.col(f"t{r}"), F.lit(1.0))))
             .otherwise(r / 2).alias(f"d{r}") for r in (1, 2, 3)]
        met = met.select("lang", *d)
        context = Window.partitionBy("lang", F.shiftright("gram", 8))
        number = lambda test: F.sum(test.cast("long")).over(context)
        here = (tables[k].withColumn("s", F.sum("n").over(context)).withColumn("n1", number(F.col("n") == 1))
                .withColumn("n2", number(F.col("n") == 2)).withColumn("n3", number(F.col("n") >= 3)).join(met, "lang"))
        own = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        gamma = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("s")
        rest = F.lit(1 / ALPHABET)
        if lower is not None:
            here = here.withColumn("tail", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(
                lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("rest")), ["lang", "tail"])
            rest = F.col("rest")
        lower = here.select("lang", "gram", (F.greatest(F.lit(0.0), F.col("n") - own) / F.col("s") + gamma * rest).alias("p"))
    return lower.select("lang", "gram", F.log("p").cast("float").alias("logp"))


def score(docs: DataFrame, model: DataFrame, text_col: str = "text", lang_col: str = "lang",
          order: int = ORDER, max_model: int = MAX_MODEL) -> DataFrame:
    """``docs`` with the MEASURES and ``log_perplexity`` (natural logarithm,
    a byte) under ``model``, which must hold every n-gram of ``docs``."""
    model = checkpointed(model)
    shape = T.StructType([T.StructField(c, T.LongType()) for c in MEASURES] + [T.StructField("log_perplexity", T.DoubleType())])
    shared = None
    if model.count() <= max_model:
        rows = model.toArrow()
        key = mixed(rows["gram"].to_numpy().view(np.uint64) ^ rows["lang"].to_numpy().view(np.uint64))
        at = np.argsort(key)
        if (key[at][1:] == key[at][:-1]).any():
            raise ValueError("two n-grams share a hash")
        shared = docs.sparkSession.sparkContext.broadcast((key[at].tobytes(), rows["logp"].to_numpy()[at].tobytes()))

    @F.arrow_udf(shape)
    def run(texts, langs):
        import pyarrow as pa
        got = [[] for _ in range(len(MEASURES) + 1)]
        if shared is not None:
            keys, logs = np.frombuffer(shared.value[0], np.uint64), np.frombuffer(shared.value[1], np.float32)
        for data, starts, lang in _parts(texts, langs):
            for into, values in zip(got, measures(data, starts)):
                into.append(values)
            if shared is not None:
                gram, text = grams(data, starts, order)
                place = np.searchsorted(keys, mixed(gram.view(np.uint64) ^ lang.view(np.uint64)[text]))
                total = np.bincount(text, logs[place], minlength=len(lang))
                with np.errstate(invalid="ignore"):
                    got[-1].append(-total / np.diff(starts))
            else:
                got[-1].append(np.full(len(lang), np.nan))
        columns = [np.concatenate(x) if x else np.zeros(0) for x in got]
        return pa.StructArray.from_arrays(
            [pa.array(c.astype(np.int64)) for c in columns[:-1]] + [pa.array(columns[-1], pa.float64(), from_pandas=True)],
            names=[f.name for f in shape.fields])

    if shared is None:
        docs, number = _numbered(docs)
        docs = docs.drop("log_perplexity").join(_joined(docs, number, model, text_col, lang_col, order), number, "left").drop(number)
    parts = fresh(docs, "measures")
    out = docs.withColumn(parts, run(F.col(f"`{text_col}`").cast("string"), _lang(docs, lang_col)))
    names = list(MEASURES) + (["log_perplexity"] if shared is not None else [])
    return out.withColumns({c: F.col(parts)[c] for c in names}).drop(parts)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, written down so that it holds."""
    number = fresh(docs, "row")
    return stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered"), number


def _joined(docs, number, model, text_col, lang_col, order) -> DataFrame:
    """(number, log_perplexity) by a join: each row's n-grams, counted."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            ids, at = batch.column("i").to_numpy(zero_copy_only=False), 0
            for data, starts, lang in _parts(batch.column("t"), batch.column("l")):
                gram, text = grams(data, starts, order)
                for k, (a, b) in enumerate(zip(starts, starts[1:])):
                    u, n = np.unique(gram[a:b], return_counts=True)
                    if len(u):
                        yield pa.record_batch([pa.array(np.full(len(u), ids[at + k])), pa.array(np.full(len(u), lang[k])),
                                               pa.array(u), pa.array(n)], names=["i", "lang", "gram", "n"])
                at += len(lang)

    rows = (docs.select(F.col(number).alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"), _lang(docs, lang_col).alias("l"))
            .mapInArrow(run, "i long, lang long, gram long, n long"))
    return (rows.join(model, ["lang", "gram"]).groupBy("i")
            .agg((-F.sum(F.col("logp").cast("double") * F.col("n")) / F.sum("n")).alias("log_perplexity"))
            .withColumnRenamed("i", number))


def rules_failed():
    """The fixed rules: under 50 words, or more than half of the words in
    windows of three words that the text holds twice."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(scored: DataFrame, lang_col: str = "lang", reach: float = REACH) -> DataFrame:
    """(language hash, lowest, highest log perplexity) from a histogram of
    all documents that the rules let pass; steps of ``STEP``."""
    bins = (scored.where(~rules_failed() & F.col("log_perplexity").isNotNull())
            .groupBy(_lang(scored, lang_col).alias("l"), F.floor(F.col("log_perplexity") / STEP).alias("bin"))
            .agg(F.count("*").alias("n")))
    w = Window.partitionBy("l").orderBy("bin")
    upto = (bins.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("l"))))
    share = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("bin") + 0.5) * STEP))
    found = upto.groupBy("l").agg(share(0.25).alias("q1"), share(0.5).alias("q2"), share(0.75).alias("q3"))
    down, up = (F.greatest(x, F.lit(LEAST)) for x in (F.col("q2") - F.col("q1"), F.col("q3") - F.col("q2")))
    return found.select("l", (F.col("q2") - reach * down).alias("lowest"), (F.col("q2") + reach * up).alias("highest"))


def judge(scored: DataFrame, limits: DataFrame, lang_col: str = "lang") -> DataFrame:
    """``scored`` with ``base_failed``, ``in_band`` and ``kept``."""
    l, low, high = (fresh(scored, x) for x in ("l", "lowest", "highest"))
    joined = scored.withColumn(l, _lang(scored, lang_col)).join(
        limits.select(F.col("l").alias(l), F.col("lowest").alias(low), F.col("highest").alias(high)), l, "left")
    band = F.coalesce(F.col("log_perplexity").between(F.col(low), F.col(high)), F.lit(False))
    return (joined.withColumn("base_failed", rules_failed()).withColumn("in_band", band)
            .withColumn("kept", ~F.col("base_failed") & F.col("in_band")).drop(l, low, high))
