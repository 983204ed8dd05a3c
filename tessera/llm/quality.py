"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation estimates how often each labeller is right, from
the counts of the vote patterns of all documents (a fixed number of
patterns), and gives each pattern a posterior. The posteriors train a linear
scorer over hashed words, hashed shapes of three characters and the
share of distinct words, on a bounded sample (``MAX_TRAIN`` documents, those
with the smallest hashes of their texts); the scorer then judges every document.

Cases: null or empty text has no words; only the length labeller votes on
it, and its score is that of the bias and the empty share; repeated rows get
equal scores; rows without an id are scored like any other; an empty table
gives an empty table; other columns are kept, and one with the name of an
output column is replaced.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh
from tessera.llm.hashed_words import _powers, letter_table, mixed, text_slices, words
from tessera.llm.perplexity import _runs, _seen_before

MAX_TRAIN = 6000
WORD_BITS, SHAPES, SHARES = 18, 48 ** 3, 12
FEATURES = (1 << WORD_BITS) + SHAPES + SHARES
EPOCHS, SEED = 12, 11
SYMBOLS = "#$%&*|<>{}[]\\^~=_@!+"


LABELLERS = 11
_POWERS = 3 ** np.arange(LABELLERS)


def _byte_table() -> np.ndarray:
    """Rows of flags by byte: white space, continues a code point, ASCII
    capital, ASCII small letter, symbol, end of a sentence, ASCII mark."""
    out = np.zeros((7, 256), bool)
    out[0, [32, *range(9, 14)]] = True
    out[1, 128:192] = True
    out[2, 65:91] = out[3, 97:123] = True
    out[4, list(SYMBOLS.encode())] = True
    out[5, list(b".!?")] = True
    out[6, [b for b in range(33, 127) if not chr(b).isalnum()]] = True
    return out


_BYTES = _byte_table()


def votes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(text, labeller) votes: 1 good, 0 bad, -1 none. Those that look for a
    defect say nothing about a text without it; every defect has more than
    one, so that they overlap. Capitals and small letters are those of ASCII
    and of the two-byte block of accented Latin letters."""
    starts = starts.astype(np.int64)
    n_texts = len(starts) - 1
    space, more, capital, small, symbol, end, mark = (t[data] for t in _BYTES)
    accented = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    tail = data[accented]
    capital[accented[(tail <= 0x9E) & (tail != 0x97)]] = True
    small[accented[(tail >= 0x9F) & (tail != 0xB7)]] = True
    upto = lambda flag: np.concatenate(([0], np.cumsum(flag)))
    of_text = lambda flag: np.diff(upto(flag)[starts])
    length = of_text(~more)
    chars = np.maximum(length, 1)

    begin, stop, text = _runs(~space, starts)
    n = np.bincount(text, minlength=n_texts)
    words_ = np.maximum(n, 1)
    share = lambda flag: np.bincount(text[flag], minlength=n_texts) / words_
    power, inverse = _powers(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)])))
    hash_of = lambda a, b: mixed((total[b] - total[a]) * inverse[a])
    word = hash_of(begin, stop)
    earlier, _ = _seen_before(text, word)
    distinct = share(~earlier)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    again = share(same)
    inside = lambda flag: upto(flag)[stop] - upto(flag)[begin]
    lower, big = share(inside(capital) == 0), share((inside(small) == 0) & (inside(~more) > 1))
    last = stop - 1
    ends = share(end[last]) if len(word) else np.zeros(n_texts)
    marks = share(mark[last] & (mark[np.maximum(last - 1, 0)] | (last == begin))) if len(word) else np.zeros(n_texts)
    capitals, symbols = of_text(capital) / chars, of_text(symbol) / words_

    a, b, of = _runs(data != 10, starts)
    n_lines = of_text(data == 10) + 1
    line_earlier, _ = _seen_before(of, hash_of(a, b))
    full = np.bincount(of, minlength=n_texts)
    distinct_lines = full - np.bincount(of[line_earlier], minlength=n_texts) + (n_lines > full)

    some, long_ = n >= 5, n >= 20
    bad = lambda test: np.where(test, 0, -1)
    between = lambda x, low, high: (x >= low) & (x <= high)
    return np.stack([
        bad(n < 5), bad(some & (length < 25)),
        bad(some & (capitals > 0.4)), bad(some & (big > 0.6)),
        bad(some & (symbols > 0.15)), bad(some & (marks > 0.2)),
        bad((n >= 40) & (distinct < 0.2)), bad(some & (again > 0.15)),
        bad((n_lines >= 4) & (distinct_lines < 0.5 * n_lines)),
        np.where(long_ & between(lower, 0.7, 1) & (symbols < 0.05) & (again < 0.05), 1, bad(some & (lower < 0.4))),
        np.where(long_ & between(ends, 0.01, 0.4) & (distinct > 0.3) & (capitals < 0.15) & (marks < 0.1), 1, -1),
    ], axis=1).astype(np.int8)


def pattern(cast: np.ndarray) -> np.ndarray:
    """Each row of votes as one number: its digits in base 3."""
    return (cast.astype(np.int64) + 1) @ _POWERS


def pattern_votes(number: np.ndarray) -> np.ndarray:
    return (number[:, None] // _POWERS % 3 - 1).astype(np.int8)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200):
    """(posterior of good for each pattern, accuracy of each labeller, prior).
    A labeller is right with its own probability when it votes, and votes
    with one that does not depend on the class; a weak prior holds that
    labellers are better than chance, which tells the classes apart."""
    cast = patterns >= 0
    good = patterns == 1
    accuracy, prior = np.full(patterns.shape[1], 0.8), 0.7
    for _ in range(rounds):
        posterior = posterior_of(patterns, accuracy, prior)
        right = np.where(good, posterior[:, None], 1 - posterior[:, None])
        weight = cast * counts[:, None]
        new = np.clip(((weight * right).sum(axis=0) + 16) / (weight.sum(axis=0) + 20), 0.51, 0.999)
        prior = float(np.clip((posterior * counts).sum() / counts.sum(), 0.02, 0.98))
        if np.abs(new - accuracy).max() < 1e-9:
            break
        accuracy = new
    return posterior, accuracy, prior


def posterior_of(patterns: np.ndarray, accuracy: np.ndarray, prior: float) -> np.ndarray:
    """The probability of good for each row of votes, seen or not."""
    good = patterns == 1
    up = np.where(good, np.log(accuracy), np.log(1 - accuracy))
    down = np.where(good, np.log(1 - accuracy), np.log(accuracy))
    gap = np.log(1 - prior) - np.log(prior) + np.where(patterns >= 0, down - up, 0).sum(axis=1)
    return 1 / (1 + np.exp(np.clip(gap, -50, 50)))


def _shape_table() -> np.ndarray:
    """byte -> one of 48 classes: letters by case, digits, not ASCII, spaces,
    and the ASCII marks one by one."""
    out, marks = np.zeros(256, np.int64), 8
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 1
        elif c.isalnum():
            out[b] = 2 if c.islower() else 3 if c.isupper() else 4
        elif c in " \t\r\x0b\x0c":
            out[b] = 5
        elif c == "\n":
            out[b] = 6
        elif c.isprintable():
            out[b] = marks
            marks += 1
    return out


def features(data: np.ndarray, starts: np.ndarray, letters: np.ndarray, shapes: np.ndarray):
    """(text, feature, share) triples of the texts, as three arrays."""
    n = len(starts) - 1
    hashes, counts = words(data, starts, letters)
    word_text = np.repeat(np.arange(n), counts)
    code = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    c = shapes[data]
    three = c[:-2] * 48 * 48 + c[1:-1] * 48 + c[2:] if len(c) > 2 else np.zeros(0, np.int64)
    size = np.diff(starts)
    byte_text = np.repeat(np.arange(n), size)
    inside = byte_text[:-2] == byte_text[2:] if len(c) > 2 else np.zeros(0, bool)
    three, three_text = three[inside], byte_text[:-2][inside] if len(c) > 2 else np.zeros(0, np.int64)
    # a word once a text: the text's number changes all bits of the hash
    _, first = np.unique(hashes ^ mixed(word_text.astype(np.uint64) + np.uint64(1)), return_index=True)
    distinct = np.bincount(word_text[first], minlength=n)
    share = np.minimum((10 * distinct / np.maximum(counts, 1)).astype(np.int64) + (counts > 0), SHARES - 1)
    text = np.concatenate((word_text, three_text, np.arange(n)))
    feature = np.concatenate((code, three + (1 << WORD_BITS), share + (1 << WORD_BITS) + SHAPES))
    weight = np.concatenate((1 / counts[word_text], 3 / np.maximum(size - 2, 1)[three_text], np.ones(n)))
    return text, feature, weight


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text, feature, weight, n: int) -> np.ndarray:
        raw = np.bincount(text, self.weights[feature] * weight, minlength=n) + self.bias
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> Scorer:
    """``rows``: (features, shares, posterior); Adagrad on the cross-entropy
    with the posterior."""
    rng = np.random.default_rng(SEED)
    w, s, bias, bias_sum = np.zeros(FEATURES), np.full(FEATURES, 1e-4), 0.0, 1e-2
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            f, x, y = rows[k]
            err = 1 / (1 + np.exp(-np.clip(w[f] @ x + bias, -30, 30))) - y
            g = err * x + 1e-6 * w[f]
            s[f] += g * g
            w[f] -= 0.2 * g / np.sqrt(s[f])
            bias_sum += err * err
            bias -= 0.1 * err / np.sqrt(bias_sum)
    return Scorer(w.astype(np.float32), float(bias))


def fit(docs: DataFrame, text_col: str = "text", max_train: int = MAX_TRAIN):
    """(scorer, posterior by vote pattern, accuracies), None without
    documents. The posteriors are those of all ``3 ** LABELLERS`` patterns."""
    text = F.col(f"`{text_col}`").cast("string")

    def cast(batches):
        import pyarrow as pa
        held = np.zeros(3 ** LABELLERS, np.int64)
        for batch in batches:
            for data, starts in text_slices(batch.column("t")):
                held += np.bincount(pattern(votes(data, starts)), minlength=len(held))
        seen = np.flatnonzero(held)
        yield pa.record_batch([pa.array(seen), pa.array(held[seen])], names=["v", "n"])

    seen = (docs.select(text.alias("t")).mapInArrow(cast, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
            .orderBy("v").collect())  # 3 ** 11 at most
    if not seen:
        return None
    patterns, counts = pattern_votes(np.array([r["v"] for r in seen])), np.array([r["n"] for r in seen], float)
    _, accuracy, prior = expectation_maximisation(patterns, counts)
    known = posterior_of(pattern_votes(np.arange(3 ** LABELLERS)), accuracy, prior)
    letters, shapes = letter_table(), _shape_table()

    def compact(batches):
        import pyarrow as pa
        for batch in batches:
            v_out, f_out, x_out = [], [], []
            for data, starts in text_slices(batch.column("t")):
                t, f, x = features(data, starts, letters, shapes)
                u, at = np.unique(t * FEATURES + f, return_inverse=True)
                x = np.bincount(at, x).astype(np.float32)
                cut = np.searchsorted(u, np.arange(len(starts)) * FEATURES)
                for a, b in zip(cut, cut[1:]):
                    f_out.append((u[a:b] % FEATURES).astype(np.int32).tobytes())
                    x_out.append(x[a:b].tobytes())
                v_out += pattern(votes(data, starts)).tolist()
            yield pa.record_batch([pa.array(v_out, pa.int64()), pa.array(f_out, pa.binary()), pa.array(x_out, pa.binary())],
                                  names=["v", "f", "x"])

    chosen = (docs.select(F.xxhash64(text).alias("h")).where("h is not null").distinct().orderBy("h").limit(max_train))
    sample = (docs.select(text.alias("t"), F.xxhash64(text).alias("h")).join(F.broadcast(chosen), "h")
              .dropDuplicates(["h"]).select("t").mapInArrow(compact, "v long, f binary, x binary").collect())
    rows = sorted(((bytes(r["f"]), bytes(r["x"]), float(known[r["v"]])) for r in sample))
    scorer = train([(np.frombuffer(f, np.int32), np.frombuffer(x, np.float32), y) for f, x, y in rows])
    return scorer, known, accuracy


def classify(docs: DataFrame, model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``posterior`` (of the labellers' votes), ``score`` (of
    the linear scorer) and ``keep`` (score at ``threshold`` or over)."""
    if model is None:
        return (docs.withColumn("posterior", F.lit(None).cast("double")).withColumn("score", F.lit(None).cast("double"))
                .withColumn("keep", F.lit(None).cast("boolean")))
    scorer, known, _ = model
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps((scorer, known)))
    letters, shapes = letter_table(), _shape_table()
    shape = T.StructType([T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType())])
    held: list = []  # unpacked once a task

    @F.arrow_udf(shape)
    def run(texts):
        import pyarrow as pa
        if not held:
            held.extend(pickle.loads(shared.value))
        scores, posteriors = [], []
        for data, starts in text_slices(texts):
            scores.append(held[0].score(*features(data, starts, letters, shapes), len(starts) - 1))
            posteriors.append(held[1][pattern(votes(data, starts))])
        columns = [pa.array(np.concatenate(x).astype(float) if x else np.zeros(0)) for x in (posteriors, scores)]
        return pa.StructArray.from_arrays(columns, names=["posterior", "score"])

    parts = fresh(docs, "parts")
    out = docs.withColumn(parts, run(F.col(f"`{text_col}`").cast("string")))
    return out.withColumns({c: F.col(parts)[c] for c in ("posterior", "score")}).withColumn(
        "keep", F.col("score") >= threshold).drop(parts)
