"""Secret scans (DataFrame functions only).

Three rules find base spans by pattern. Beyond them, every long token is
scored by two character Markov models, one of random strings and one of
ordinary identifiers: the log-likelihood ratio of its transitions, added up.
Both models are trained from labelled samples: the base rules label the
random strings (all of them, in all documents), and the identifiers come
from the texts without a base span among ``TRAIN_DOCS`` documents (those
with the smallest hashes of their texts).

Cases: null or empty text has no spans; rows without an id and repeated rows
are scanned like any other; without a labelled string of either kind the
models can't be trained and add nothing; an empty table gives an empty
table; other columns are kept, and one with the name of an output column is
replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bind, fresh

#: kinds in their order; the last one is the Markov models'
KINDS = ("assign", "access", "hex", "markov")
#: Base rules. Runs of one class are taken whole, so asking for their length
#: in the pattern equals dropping short matches; only ``assign`` must be
#: matched first and dropped afterwards, as a dropped match still covers text.
ASSIGN = (r"""(?:[Pp](?i:assword|asswd)|[Ss](?i:ecret)|[Tt](?i:oken)|[Aa](?i:pi_?key))"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"(?<![0-9a-f])([0-9a-f]{24,})"
MIN_VALUE = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_=-]{20,})"
IDENTIFIER = r"[A-Za-z0-9_-]{5,}"
#: documents that lend ordinary identifiers to the training
TRAIN_DOCS = 2000
#: transitions that each character is given in advance, dealt by the single
#: characters' shares (to which half an occurrence of each is added)
SMOOTHING = 20.0
#: log-likelihood ratio a token needs, in all and for each transition
MIN_RATIO, MIN_MEAN = 12.0, 0.4

_SPANS = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """(start, kind, stop, value) of each match, in code points: the texts
    between two matches and the matches' own lengths add up to the places."""
    def place(b: Column) -> Column:
        whole, value, gaps = b["whole"], b["value"], b["gaps"]
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(gaps, i))
            stop = start + F.length(F.get(whole, i))
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(
                start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"),
                F.get(value, i).alias("value")))).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(whole) - 1), zero, step, lambda acc: acc["out"])

    p = F.lit(pattern)
    found = bind(F.regexp_extract_all(text, p, F.lit(0)), lambda whole: F.when(
        F.size(whole) > 0, bind(F.struct(whole.alias("whole"), F.regexp_extract_all(text, p, F.lit(1)).alias("value"),
                                         F.split(text, pattern, -1).alias("gaps")), place)))
    return F.coalesce(found, F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the three rules, by start and then kind."""
    assign = F.filter(_spans(text, ASSIGN, 0), lambda s: F.length(s["value"]) >= MIN_VALUE)
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


@dataclass
class Markov:
    """Log-likelihood ratio of each pair of characters of ``ALPHABET``."""
    ratio: list[float]

    def of(self, token: Column) -> Column:
        """(sum of the ratios, transitions) of a token."""
        table, letters, size = F.array(*[F.lit(x) for x in self.ratio]), F.lit(ALPHABET), len(ALPHABET)

        def total(codes: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(1), F.size(codes) - 1), F.lit(0.0),
                               lambda a, i: a + F.get(table, F.get(codes, i - 1) * size + F.get(codes, i)))

        return bind(F.transform(F.split(token, ""), lambda c: F.instr(letters, c) - 1), total)


def train(docs: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Markov | None:
    """Counts of character pairs, added up in the cluster; at most
    ``2 * len(ALPHABET) ** 2`` of them come to the driver."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    secret = docs.select(F.explode(base_spans(text)).alias("s")).select(
        F.lit(1).alias("secret"), F.col("s.value").alias("v"))
    # the hashes first, then one text of each
    chosen = docs.select(F.xxhash64(text).alias("h")).distinct().orderBy("h").limit(train_docs)
    sample = (docs.select(text.alias("t"), F.xxhash64(text).alias("h")).join(F.broadcast(chosen), "h")
              .groupBy("h").agg(F.first("t").alias("t")))
    plain = (sample.select("t", base_spans(F.col("t")).alias("s")).where(F.size("s") == 0)
             .select(F.lit(0).alias("secret"), F.explode(F.regexp_extract_all("t", F.lit(IDENTIFIER), F.lit(0))).alias("v")))
    pairs = (secret.unionByName(plain)
             .select("secret", F.explode(F.when(F.length("v") > 1, F.transform(
                 F.sequence(F.lit(1), F.length("v") - 1), lambda i: F.substring(F.col("v"), i, F.lit(2))))).alias("p"))
             .groupBy("secret", "p").agg(F.count("*").alias("n"))
             .where(F.col("p").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect())
    size, place = len(ALPHABET), {c: k for k, c in enumerate(ALPHABET)}
    counts = {0: [0.0] * size ** 2, 1: [0.0] * size ** 2}
    for r in pairs:
        counts[r["secret"]][place[r["p"][0]] * size + place[r["p"][1]]] += r["n"]
    if not (any(counts[0]) and any(counts[1])):
        return None

    def logs(c: list[float]) -> list[float]:
        single = [0.5 + sum(c[b::size]) for b in range(size)]
        share, out = [x / sum(single) for x in single], []
        for k in range(size):
            row = c[k * size:(k + 1) * size]
            total = sum(row) + SMOOTHING
            out += [math.log((x + SMOOTHING * share[b]) / total) for b, x in enumerate(row)]
        return out

    return Markov([a - b for a, b in zip(logs(counts[1]), logs(counts[0]))])


def scan(docs: DataFrame, model: Markov | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``found``: arrays of spans (start, kind,
    stop, value; kind is an index of ``KINDS``). ``found`` has the base spans
    and the Markov models' spans that do not overlap one."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    def random_ones(b: Column) -> Column:
        apart = F.filter(b["more"], lambda s: ~F.exists(b["base"], lambda x: (s["start"] < x["stop"]) & (x["start"] < s["stop"])))
        return F.filter(apart, lambda s: (lambda r: (r >= MIN_RATIO) & (r >= MIN_MEAN * (s["stop"] - s["start"] - 1)))(
            model.of(s["value"])))

    base, more = fresh(docs, "base"), fresh(docs, "more")
    if model is None:
        return docs.withColumn("base", base_spans(text)).withColumn("found", F.col("base"))
    out = bind(F.struct(base_spans(text).alias("base"), _spans(text, TOKEN, 3).alias("more")),
               lambda b: F.struct(b["base"].alias("base"), F.when(F.size(b["more"]) > 0, random_ones(b))
                                  .otherwise(F.array().cast(_SPANS)).alias("more")))
    return (docs.withColumn(base, out).withColumn(more, F.col(base)["more"])
            .withColumn("base", F.col(base)["base"])
            .withColumn("found", F.array_sort(F.concat(F.col(base)["base"], F.col(more)))).drop(base, more))


def joined(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
