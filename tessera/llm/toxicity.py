"""Toxicity: a convolutional text classifier trained in numpy.

Words, and their beginnings of a few bytes (many words are made from one
stem), are hashed to embeddings that are added up; filters of several widths run over the
words of the whole text, each filter's largest response (max pooling over
the text) is one input of a logistic unit. All labelled documents train:
they are dealt to replicas of some ``REPLICA_DOCS`` documents, tasks that
train from the same weights, which are averaged every ``LOCAL_EPOCHS`` epochs
(iterative parameter mixing); only weights, whose number is fixed, come to the
driver. Scoring runs where the rows are. A fifth of the documents is kept out
of training to calibrate the score and, for each language, the threshold that
separates best.

Cases: null or empty text has no words and gets the score of an empty text;
repeated rows get equal scores; a row without an id is scored and counts as
held out; without labelled rows of both classes nothing can be learned and
every score is 0; an empty table gives an empty table; other columns are
kept, and one with the name of an output column is replaced.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, replace

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import checkpointed
from tessera.llm.hashed_words import letter_table, text_slices, words

#: labelled documents of a replica, and the epochs it trains between two
#: rounds in which the replicas' weights are averaged
REPLICA_DOCS, LOCAL_EPOCHS = 10_000, 3
#: labelled ids that are broadcast to the texts; more are joined by a shuffle
BROADCAST_MARKS = 2_000_000
#: buckets whose changes are added up together, and cells of the calibration's responses
SEGMENT, BINS = 1 << 14, 1 << 16
BUCKET_BITS, DIM, WIDTHS, FILTERS = 20, 8, (1, 2, 3), 8
EPOCHS, BATCH, SEED = 12, 32, 7
PAD = max(WIDTHS)
#: bytes of the beginnings that are hashed beside the word
PREFIXES = (4, 6)
PARTS = 1 + len(PREFIXES)


@dataclass
class Model:
    """Weights of one network; ``embedding`` has a zero row for padding."""
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] | None = None

    def response(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The net's value for each text. Products are added one coordinate
        after the other, in doubles, and not by a matrix product, whose order
        of addition depends on the shape: a text's value is the same to the
        last bit whatever texts stand beside it."""
        ids, start = _padded(buckets, counts)
        x = self.embedding[ids[:, 0]].astype(float)
        for k in range(1, PARTS):
            x += self.embedding[ids[:, k]]
        x = np.ascontiguousarray(x.T)
        value, at, ends = np.full(len(counts), float(self.shift)), 0, start[1:]
        for w, weight, bias in zip(WIDTHS, self.filters, self.bias):
            n = len(ids) - w + 1
            for f in range(weight.shape[2]):
                r = np.zeros(len(ids))
                for o in range(w):
                    for d in range(DIM):
                        r[:n] += x[d, o:o + n] * float(weight[o, d, f])
                r[n:] = -np.inf
                for back in range(1, w):  # windows that would reach into the next text
                    r[ends - back] = -np.inf
                top = np.maximum.reduceat(r, start[:-1]) if len(counts) else np.zeros(0)
                value += np.maximum(top + float(bias[f]), 0) * float(self.out[at])
                at += 1
        return value

    def score(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return _sigmoid(a * self.response(buckets, counts) + b)

    def packed(self) -> bytes:
        """The model without the rows of words that training did not see."""
        live = np.flatnonzero(self.embedding.any(axis=1)).astype(np.int32)
        return cloudpickle.dumps((replace(self, embedding=np.zeros((0, DIM), np.float32)), live, self.embedding[live]))

    @staticmethod
    def unpacked(data: bytes) -> Model:
        model, live, rows = pickle.loads(data)
        place = np.full((1 << BUCKET_BITS) + 1, len(live), np.int32)
        place[live] = np.arange(len(live))
        model.embedding = _Rows(place, np.concatenate((rows, np.zeros((1, DIM), np.float32))))
        return model


class _Rows:
    """An embedding of few rows that are not zero."""

    def __init__(self, place: np.ndarray, rows: np.ndarray):
        self.place, self.rows = place, rows

    def __getitem__(self, ids: np.ndarray) -> np.ndarray:
        return self.rows[self.place[ids]]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def buckets_of(data, starts, table) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = words(data, starts, table, PREFIXES)
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), counts


def _padded(buckets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each with PAD zero rows behind it."""
    length = counts + PAD
    start = np.concatenate(([0], np.cumsum(length)))
    ids = np.full((int(start[-1]), PARTS), 1 << BUCKET_BITS, np.int32)
    ids[np.arange(len(buckets)) + PAD * np.repeat(np.arange(len(counts)), counts)] = buckets
    return ids, start


def _pool(model: Model, ids: np.ndarray, start: np.ndarray, where: bool = False):
    """For each width the largest response of each filter in each text and,
    if asked, the position it starts at."""
    x, out = sum(model.embedding[ids[:, k]] for k in range(PARTS)), []
    for w, weight in zip(WIDTHS, model.filters):
        r = np.full((len(ids), weight.shape[2]), -np.inf, np.float32)
        n = len(ids) - w + 1
        r[:n] = sum(x[o:o + n] @ weight[o] for o in range(w))
        for back in range(1, w):  # windows that would reach into the next text
            r[start[1:] - back] = -np.inf
        top = np.maximum.reduceat(r, start[:-1], axis=0)
        at = None
        if where:
            text = np.repeat(np.arange(len(start) - 1), np.diff(start))
            i, f = np.nonzero(r == top[text])
            at = np.zeros(top.shape, np.int64)
            at[text[i[::-1]], f[::-1]] = i[::-1]  # the first of equal ones stays
        out.append((top, at))
    return out


@dataclass
class State:
    """What training carries on beside the model: Adagrad's sums."""
    params: list[np.ndarray]
    embedding: np.ndarray
    shift: float

    @staticmethod
    def of(model: Model) -> State:
        return State([np.full_like(p, 1e-3) for p in _params(model)], np.full(len(model.embedding), 1e-2, np.float32), 1e-3)


def _params(model: Model) -> list[np.ndarray]:
    return [*model.filters, *model.bias, model.out]


def initial(buckets: np.ndarray, toxic: np.ndarray, clean: np.ndarray, up: tuple[float, float]) -> Model:
    """The net before training. Of each bucket that at least 3 documents
    hold: how far its share of toxic documents stands out, as the first
    coordinate. ``up``: documents of both classes, 1 at least."""
    rng, size = np.random.default_rng(SEED), 1 << BUCKET_BITS
    share = {1: np.zeros(size), 0: np.zeros(size)}
    share[1][buckets], share[0][buckets] = toxic, clean
    both = share[1] + share[0] * up[0] / up[1]
    e = np.zeros((size + 1, DIM), np.float32)
    seen = share[1] + share[0] >= 3
    e[:-1][seen] = rng.normal(0, 0.05, (int(seen.sum()), DIM))
    e[:-1, 0] += np.where(seen, (share[1] - share[0] * up[0] / up[1]) / np.sqrt(both + 20) / 5, 0)
    model = Model(e, [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
                  [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                  rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), -1.0)
    for weight in model.filters:
        weight[0, 0] = np.abs(weight[0, 0]) + 0.3
    model.out[:] = np.abs(model.out)
    return model


def train(model: Model, state: State, docs: list[tuple[np.ndarray, int]], up: tuple[float, float],
          epochs: range, seed: int) -> np.ndarray:
    """``docs``: (buckets, label). Adagrad on the logistic loss, both classes
    with equal weight, in place; the buckets whose rows it changed."""
    size, label = 1 << BUCKET_BITS, np.array([y for _, y in docs], np.float32)
    params, sums, e_sum = _params(model), state.params, state.embedding
    weight_of = np.where(label > 0, 0.5 / up[0], 0.5 / up[1]) * sum(up)
    changed = np.zeros(size, bool)
    for epoch in epochs:
        rate = 0.1 / (1 + epoch / 3)
        order = np.random.default_rng((SEED, seed, epoch)).permutation(len(docs))
        for k in range(0, len(order), BATCH):
            part = order[k:k + BATCH]
            counts = np.array([len(docs[i][0]) for i in part])
            ids, start = _padded(np.concatenate([docs[i][0] for i in part]), counts)
            found = _pool(model, ids, start, where=True)
            pre = [m + b for (m, _), b in zip(found, model.bias)]
            pooled = np.concatenate([np.maximum(p, 0) for p in pre], axis=1)
            err = (_sigmoid(pooled @ model.out + model.shift) - label[part]) * weight_of[part] / len(part)
            grads, back = [], err[:, None] * model.out
            g_filters, g_bias, e_rows, e_grad = [], [], [], []
            for n, (w, weight, p, (_, at)) in enumerate(zip(WIDTHS, model.filters, pre, found)):
                g = np.where(p > 0, back[:, n * FILTERS:(n + 1) * FILTERS], 0).astype(np.float32)
                g_bias.append(g.sum(axis=0))
                gw = np.empty_like(weight)
                for o in range(w):
                    rows = ids[at + o]  # (texts, filters, parts)
                    gw[o] = np.einsum("tfpd,tf->df", model.embedding[rows], g)
                    to_x = (g[:, :, None] * weight[o].T[None]).reshape(-1, DIM)
                    for k in range(PARTS):
                        e_rows.append(rows[:, :, k].ravel())
                        e_grad.append(to_x)
                g_filters.append(gw)
            grads = [*g_filters, *g_bias, pooled.T @ err + 1e-4 * model.out]
            for p, g, s in zip(params, grads, sums):
                s += g * g
                p -= rate * g / np.sqrt(s)
            state.shift += err.sum() ** 2
            model.shift -= rate * err.sum() / np.sqrt(state.shift)
            rows, g = np.concatenate(e_rows), np.concatenate(e_grad)
            live = (rows < size) & (g != 0).any(axis=1)
            rows, g = rows[live], g[live]
            if len(rows):
                changed[rows] = True
                np.add.at(e_sum, rows, (g * g).sum(axis=1))
                np.add.at(model.embedding, rows, -rate * g / np.sqrt(e_sum[rows])[:, None])
    return np.flatnonzero(changed)


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, times: np.ndarray, langs: list[str]) -> Model:
    """Fits score = sigmoid(a * response + b) on documents kept out of
    training (``times`` of them for each response, label and language), both
    classes with equal weight, then each language's threshold: the middle of the best gap by
    balanced accuracy (0.7 where a language lacks a class)."""
    if not len(x):
        return model
    response, spread = x, max(float(np.abs(x).max()), 1.0)
    x = x / spread
    n, toxic = times.sum(), (times * y).sum()
    a, b = 1.0, 0.0
    pull = np.where(y > 0, (toxic + 1) / (toxic + 2), 1 / (n - toxic + 2))
    fair = times * np.where(y > 0, 0.5 / max(1.0, toxic), 0.5 / max(1.0, n - toxic)) * n
    for _ in range(200):
        p = _sigmoid(a * x + b)
        err, h = fair * (p - pull), fair * np.maximum(p * (1 - p), 1e-6)
        m = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, [(err * x).sum(), err.sum()])
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
    model.scale = (max(a, 0.05) / spread, b)
    score, thresholds, langs = _sigmoid(model.scale[0] * response + b), {}, np.array(langs, object)
    for lang in sorted(set(langs)):
        here = langs == lang
        cuts, at = np.unique(score[here], return_inverse=True)
        t = np.bincount(at, (times * y)[here])
        c = np.bincount(at, (times * (1 - y))[here])
        if not (t.sum() and c.sum()):
            continue
        # caught toxic ones above each cut, clean ones left alone below it
        gain = (t.sum() - np.cumsum(t)[:-1]) / t.sum() + np.cumsum(c)[:-1] / c.sum()
        cuts = (cuts[1:] + cuts[:-1]) / 2
        if len(gain):
            best = np.flatnonzero(gain == gain.max())
            thresholds[lang] = float(cuts[best[len(best) // 2]])
    model.thresholds = thresholds
    return model


def _examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str,
              replica_docs: int) -> DataFrame:
    """(replica, y, lang, order, ids): one row for each distinct labelled
    text, dealt to replicas and ordered there by a digest of its words."""
    ident = F.col(f"`{id_col}`")
    marks = labels.where(ident.isNotNull() & F.col(label_col).isin(0, 1)).groupBy(ident.alias("i")).agg(
        F.max(label_col).cast("int").alias("y"))
    n, table = marks.count(), letter_table()

    def hashed(batches):
        import hashlib

        import pyarrow as pa
        seen = set()  # copies are dropped before they could meet in one task
        for batch in batches:
            ids_of, at, order = [], [], []
            labels_, langs = batch.column("y").to_pylist(), batch.column("lang").to_pylist()
            k = 0
            for data, starts in text_slices(batch.column("t")):
                ids, counts = buckets_of(data, starts, table)
                for x in np.split(ids, np.cumsum(counts)[:-1]):
                    raw = x.tobytes()
                    digest = hashlib.blake2b(raw + bytes([labels_[k]]), digest_size=16).digest()
                    if (digest, langs[k]) not in seen:
                        seen.add((digest, langs[k]))
                        ids_of.append(raw)
                        at.append(k)
                        order.append(digest)
                    k += 1
            yield pa.record_batch([batch.column("y").take(pa.array(at, pa.int64())), batch.column("lang").take(pa.array(at, pa.int64())),
                                   pa.array(order, pa.binary()), pa.array(ids_of, pa.binary())], names=["y", "lang", "order", "ids"])

    def numbered(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        replica, last = TaskContext.get().partitionId(), None
        for batch in batches:
            at = []
            for k, digest in enumerate(batch.column("order").to_pylist()):
                if digest != last:
                    at.append(k)
                last = digest
            some = batch.take(pa.array(at, pa.int64()))
            yield pa.record_batch([pa.array(np.full(len(at), replica), pa.int32()), *some.columns],
                                  names=["replica", "y", "lang", "order", "ids"])

    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit("")
    texts = docs.select(ident.alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"),
                        F.coalesce(lang, F.lit("")).alias("lang"))
    return checkpointed(
        texts.join(F.broadcast(marks) if n <= BROADCAST_MARKS else marks, "i").select("y", "lang", "t")
        .mapInArrow(hashed, "y int, lang string, order binary, ids binary")
        .repartition(max(1, -(-n // replica_docs)), "order").sortWithinPartitions("order", "lang")
        .mapInArrow(numbered, "replica int, y int, lang string, order binary, ids binary"))


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32).reshape(-1, PARTS)


def _shares(examples: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each bucket that at least 3 documents hold, how many toxic and clean ones do."""
    def run(batches):
        import pyarrow as pa
        share = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for y, raw in zip(batch.column("y").to_pylist(), batch.column("ids").to_pylist()):
                share[y][np.unique(_ids(raw))] += 1
        some = np.flatnonzero(share.any(axis=0))
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(share[1][some]), pa.array(share[0][some])],
                              names=["bucket", "toxic", "clean"])

    got = (examples.select("y", "ids").mapInArrow(run, "bucket int, toxic long, clean long").groupBy("bucket")
           .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic + clean >= 3").toArrow())
    return tuple(got.column(c).to_numpy() for c in ("bucket", "toxic", "clean"))


def _round(examples: DataFrame, model: Model, state: State, up: tuple[float, float], epochs: range) -> None:
    """Each replica trains on all of its documents from the same model; a
    weight then moves by the mean of its changes (a word's row: among the
    replicas that changed it). Changes are added up by segments of buckets,
    replica by replica, so the result does not depend on the tasks' order."""
    sc = examples.sparkSession.sparkContext
    shared = sc.broadcast(cloudpickle.dumps((model, state)))
    flat = lambda m, s: np.concatenate([p.ravel() for p in [*_params(m), *s.params]] + [[m.shift, s.shift]]).astype(float)

    def run(batches):
        import pyarrow as pa
        docs, replica = [], 0
        for batch in batches:
            for r, y, raw in zip(*(batch.column(c).to_pylist() for c in ("replica", "y", "ids"))):
                docs.append((_ids(raw), y))
                replica = r
        if not docs:
            return
        m, s = pickle.loads(shared.value)
        first = flat(m, s)
        e, e_sum = m.embedding.copy(), s.embedding.copy()
        changed = train(m, s, docs, up, epochs, replica)
        moved = np.concatenate((m.embedding[changed] - e[changed], (s.embedding - e_sum)[changed, None]), axis=1)
        cut = np.searchsorted(changed, np.arange(0, (1 << BUCKET_BITS) + 1, SEGMENT))
        parts = [(-1, (flat(m, s) - first).tobytes(), b"")]
        parts += [(k, moved[a:b].tobytes(), changed[a:b].astype(np.int32).tobytes())
                  for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        yield pa.record_batch([pa.array([p[0] for p in parts], pa.int32()), pa.array([replica] * len(parts), pa.int32()),
                               pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())],
                              names=["segment", "replica", "moved", "at"])

    def summed(batches):
        import pyarrow as pa
        here = total = times = None

        def done():
            live = np.flatnonzero(times)
            mean = total[live] / times[live, None]
            return pa.record_batch([pa.array([here], pa.int32()), pa.array([mean.tobytes()], pa.binary()),
                                    pa.array([live.astype(np.int32).tobytes()], pa.binary())], names=["segment", "mean", "at"])

        for batch in batches:
            for segment, moved, at in zip(*(batch.column(c).to_pylist() for c in ("segment", "moved", "at"))):
                dense = segment < 0
                rows = np.frombuffer(moved, float).reshape(1, -1) if dense else np.frombuffer(moved, np.float32).reshape(-1, DIM + 1)
                if segment != here:
                    if here is not None:
                        yield done()
                    here, total = segment, np.zeros((1 if dense else SEGMENT, rows.shape[1]))
                    times = np.zeros(len(total), np.int64)
                place = np.zeros(1, np.int64) if dense else np.frombuffer(at, np.int32) - segment * SEGMENT
                total[place] += rows
                times[place] += 1
        if here is not None:
            yield done()

    moves = (examples.select("replica", "y", "ids").mapInArrow(run, "segment int, replica int, moved binary, at binary")
             .repartition("segment").sortWithinPartitions("segment", "replica")
             .mapInArrow(summed, "segment int, mean binary, at binary").collect())
    shared.destroy()
    for r in moves:
        mean = np.frombuffer(bytes(r["mean"]), float)
        if r["segment"] < 0:
            at = 0
            for p in [*_params(model), *state.params]:
                p += mean[at:at + p.size].reshape(p.shape).astype(np.float32)
                at += p.size
            model.shift, state.shift = float(model.shift + mean[at]), float(state.shift + mean[at + 1])
        else:
            rows = np.frombuffer(bytes(r["at"]), np.int32) + r["segment"] * SEGMENT
            mean = mean.reshape(-1, DIM + 1).astype(np.float32)
            model.embedding[rows] += mean[:, :DIM]
            state.embedding[rows] += mean[:, DIM]


def _responses(examples: DataFrame, model: Model):
    """Responses of ``examples`` as (x, y, times, lang), in cells of 1 / BINS of their range."""
    shared = examples.sparkSession.sparkContext.broadcast(model.packed())

    def run(batches):
        import pyarrow as pa
        net = Model.unpacked(shared.value)
        for batch in batches:
            raw, out = batch.column("ids").to_pylist(), []
            for k in range(0, len(raw), 256):
                ids = [_ids(r) for r in raw[k:k + 256]]
                out.append(net.response(np.concatenate(ids), np.array([len(x) for x in ids])))
            yield pa.record_batch([batch.column("y"), batch.column("lang"), pa.array(np.concatenate(out) if out else np.zeros(0))],
                                  names=["y", "lang", "x"])

    found = checkpointed(examples.select("y", "lang", "ids").mapInArrow(run, "y int, lang string, x double"))
    step = (found.agg(F.max(F.abs("x"))).first()[0] or 0.0) / BINS or 1.0
    rows = (found.groupBy(F.round(F.col("x") / step).cast("long").alias("bin"), "y", "lang").agg(F.count(F.lit(1)).alias("times"))
            .orderBy("bin", "y", "lang").collect())
    return (np.array([r["bin"] * step for r in rows], float), np.array([r["y"] for r in rows], float),
            np.array([r["times"] for r in rows], float), [r["lang"] for r in rows])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", label_col: str = "toxic", replica_docs: int = REPLICA_DOCS) -> Model | None:
    """Trains on all rows of ``labels`` that are in ``docs``; None without rows
    of both classes. One label an id, one document a distinct text."""
    examples = _examples(docs, labels, id_col, text_col, lang_col, label_col, replica_docs)
    examples = examples.withColumn("out", F.conv(F.substring(F.hex("order"), 1, 8), 16, 10).cast("long") % 5 == 0)
    counts = {(r["y"], r["out"]): r["n"] for r in examples.groupBy("y", "out").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len({y for y, _ in counts}) < 2:
        return None
    up = tuple(max(1.0, float(counts.get((y, False), 0))) for y in (1, 0))
    learned = examples.where(~F.col("out"))
    model = initial(*_shares(learned), up)
    state = State.of(model)
    for k in range(0, EPOCHS, LOCAL_EPOCHS):
        _round(learned, model, state, up, range(k, min(EPOCHS, k + LOCAL_EPOCHS)))
    return calibrate(model, *_responses(examples.where("out"), model))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang",
          threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (of the text alone), ``predicted`` (1 at
    ``threshold`` or over) and ``flagged`` (over its language's threshold)."""
    text = F.col(f"`{text_col}`").cast("string")
    if model is None:
        got: Column = F.lit(0.0)
    else:
        shared, table = docs.sparkSession.sparkContext.broadcast(model.packed()), letter_table()
        held: list[Model] = []  # unpacked once a task

        @F.arrow_udf(T.DoubleType())
        def run(texts):
            import pyarrow as pa
            if not held:
                held.append(Model.unpacked(shared.value))
            out = [held[0].score(*buckets_of(data, starts, table))
                   for data, starts in text_slices(texts)]
            return pa.array(np.concatenate(out).astype(float) if out else np.zeros(0))

        got = run(text)
    limits = (model.thresholds or {}) if model else {}
    cut = F.lit(threshold)
    if limits and lang_col in docs.columns:
        by = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
        cut = F.coalesce(by[F.col(f"`{lang_col}`")], F.lit(threshold))
    return (docs.withColumn("score", got)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
            .withColumn("flagged", F.col("score") >= cut))


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; 1 (held out) without an id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3, F.lit(1))
