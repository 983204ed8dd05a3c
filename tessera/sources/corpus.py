"""Corpus readers and writers (S1-S7) and vocabulary / model persistence
(S8-S11). Everything goes through Spark's readers and writers, so paths
may be any file system the cluster mounts; only bounded objects (params,
small vocabularies on request) are written by a single task."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keyed import u32

# --------------------------------------------------------------- S1, S2, S6
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_labelled_csv(spark: SparkSession, path: str, schema: str | None = None,
                      text_col: str = "sentence", target_col: str = "target") -> DataFrame:
    """S1 + P1 + P5: a headed CSV (quoted fields may hold newlines and
    doubled quotes) -> (sentence, target DOUBLE). ``schema`` avoids type
    inference; columns are picked by name."""
    reader = spark.read.options(**CSV_OPTIONS)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.select(F.col(f"`{text_col}`").alias("sentence"),
                     F.col(f"`{target_col}`").cast("double").alias("target"))


def pick_columns(df: DataFrame, text: str | None = None, target: str | None = None,
                 prefer: str = "text") -> DataFrame:
    """Choose the sentence and target columns by name, with the
    ``prefer`` column winning when present (P2), falling back to position
    (first = sentence, second = target, P3), renamed to the canonical
    (sentence, target) (P4)."""
    cols = df.columns
    t = prefer if prefer in cols else (text or cols[0])
    y = target or (cols[1] if len(cols) > 1 else None)
    out = [F.col(f"`{t}`").alias("sentence")]
    if y is not None:
        out.append(F.col(f"`{y}`").cast("double").alias("target"))
    return df.select(*out)


def read_named_csv(spark: SparkSession, path: str) -> DataFrame:
    """Forced names (sentence, target); the header line is skipped."""
    return spark.read.options(**CSV_OPTIONS).schema("sentence string, target string").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and no index column."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


# --------------------------------------------------------------- S3, S4, S7
def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """S3: raw text lines with an explicit order key: (file, split start,
    position inside the split). Lines stay rows; nothing is concatenated."""
    df = spark.read.text(path)
    return df.select(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("line_id"),
                     F.col("value").alias("text"))


def read_corpus(spark: SparkSession, path: str, feature_name: str = "sentence") -> DataFrame:
    """S4 + P2: ``.csv`` -> labelled frame (column ``text`` preferred, else
    ``feature_name``), ``.parquet`` -> table, anything else -> text lines."""
    if path.endswith(".csv"):
        df = spark.read.options(**CSV_OPTIONS).csv(path)
        col = "text" if "text" in df.columns else feature_name
        return df.withColumnRenamed(col, "text") if col != "text" else df
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_text_corpus(spark, path)


def write_lines(df: DataFrame, text_col: str, path: str, mode: str = "overwrite",
                order_cols: list[str] | None = None) -> None:
    """One sentence per line (embedded line breaks become spaces). With
    ``order_cols`` the files, in the order of their names, hold the lines in
    that order (a range sort, no single writer)."""
    if order_cols:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    df.select(F.regexp_replace(F.col(text_col), r"[\r\n]+", " ").alias("value")) \
      .write.mode(mode).text(path)


# --------------------------------------------------------------- S5
# Public benchmark sets -> source text column, label columns,
# splits (as the reference's loaders name them).
BENCHMARK_SETS = {
    "ag_news": ("text", ["label"], ["train", "test"]),
    "cola": ("sentence", ["label"], ["train", "test", "val"]),
    "imdb": ("text", ["label"], ["train", "test"]),
    "yelp": ("text", ["label"], ["train", "test"]),
    "trec": ("text", ["label-coarse", "label-fine"], ["train", "test"]),
    "mr": ("text", ["label"], ["train", "test", "val"]),
}


def normalize_benchmark(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """Pick + rename a benchmark split to (sentence, target), or to
    (sentence, label-coarse, label-fine) for two-label sets; ``keep``
    columns ride along."""
    text_col, labels, _ = BENCHMARK_SETS[name]
    extra = [F.col(f"`{c}`") for c in keep or []]
    if len(labels) == 1:
        return df.select(F.col(f"`{text_col}`").alias("sentence"),
                         F.col(f"`{labels[0]}`").alias("target"), *extra)
    return df.select(F.col(f"`{text_col}`").alias("sentence"),
                     *[F.col(f"`{c}`").cast("int").alias(c) for c in labels], *extra)


def keyed_split(df: DataFrame, row_col: str, fractions: dict[str, float], seed=0) -> DataFrame:
    """Deterministic split assignment by a keyed hash of the row id."""
    u = u32(seed, 0, "split", F.col(row_col), 0) / F.lit(2.0 ** 32)
    expr, acc = None, 0.0
    for name, frac in fractions.items():
        acc += frac
        cond = u < F.lit(acc)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return df.withColumn("split", expr.otherwise(F.lit(list(fractions)[-1])))


def write_benchmark(df: DataFrame, name: str, out_dir: str) -> None:
    """S5 + S6: one CSV folder per split (``split=...``), in one pass."""
    known = df.filter(F.col("split").isin(BENCHMARK_SETS[name][2]))
    known.write.mode("overwrite").options(**CSV_OPTIONS).partitionBy("split").csv(f"{out_dir}/{name}")


# --------------------------------------------------------------- S8-S11
def _write_params(spark: SparkSession, params: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1) \
         .write.mode("overwrite").text(path)


def _read_params(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def save_vocab(vocab, directory: str) -> None:
    """The vocabulary table as parquet (authoritative), every
    parameter in ``params``, and JSON lines ``{"token": ..., "id": ...}`` for
    interchange, written in parallel at every size."""
    spark = vocab.table.sparkSession
    vocab.table.write.mode("overwrite").parquet(f"{directory}/vocab.parquet")
    params = {"kind": vocab.kind, "cased": vocab.cased, "n": vocab.n, "size": vocab.size,
              "start_char": vocab.start_char, "end_char": vocab.end_char}
    _write_params(spark, params, f"{directory}/params")
    vocab.table.select("token", "id").write.mode("overwrite").json(f"{directory}/vocab.json")


#: characters of a line that can be one entry
_ENTRY_CHARS = 1 << 20


def _vocab_lines(spark: SparkSession, path: str):
    """(token, id) of vocabulary files whose every line is a brace, one
    ``"token": id`` of an object, or one line of JSON lines; None if a file has
    another form or names a token of an object twice."""
    def kind_of(text: str):
        t = text.strip()
        if t in ("{", "}"):
            return t, None, None
        if t and len(t) <= _ENTRY_CHARS:
            try:
                if t[0] == "{":
                    x = json.loads(t)
                    if x.keys() == {"token", "id"} and isinstance(x["token"], str) and type(x["id"]) is int:
                        return "line", x["token"], x["id"]
                elif t[0] == '"':
                    x = list(json.loads("{" + t.removesuffix(",") + "}").items())
                    if len(x) == 1 and type(x[0][1]) is int:
                        return "," if t[-1] == "," else "last", *x[0]
            except json.JSONDecodeError:
                pass
        return "other", None, None

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            kinds, tokens, ids = zip(*map(kind_of, batch.column("value").to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.record_batch([batch.column("file"), pa.array(kinds, pa.string()), pa.array(tokens, pa.string()),
                                   pa.array(ids, pa.int64())], names=["file", "kind", "token", "id"])

    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").where(F.trim("value") != "")
    found = lines.mapInArrow(run, "file string, kind string, token string, id bigint")
    n = {k: F.sum((F.col("kind") == k).cast("long")) for k in ("{", "}", ",", "last", "line")}
    whole = (n["{"] == 1) & (n["}"] == 1) & (n["last"] <= 1) & ((n["last"] == 1) | (n[","] == 0)) \
        & (n[","] + n["last"] + 2 == F.count(F.lit(1)))
    odd = found.groupBy("file").agg((whole | (n["line"] == F.count(F.lit(1)))).alias("ok")).where(~F.col("ok"))
    if not odd.isEmpty():
        return None
    twice = found.where(F.col("kind").isin(",", "last")).groupBy("file", "token").count().where("count > 1")
    return found.where(F.col("token").isNotNull()).select("token", "id") if twice.isEmpty() else None


def read_json_vocab(spark: SparkSession, path: str, kind: str = "word", cased: bool = True):
    """A vocabulary from JSON files: each one ``{token: id}`` object, on
    one line or many, or lines ``{"token": ..., "id": ...}``. Files with one
    entry a line, as they are written here, are read by lines in many tasks,
    others as a whole; anything else raises."""
    from tessera.operators.vocab import Vocab

    by_line = _vocab_lines(spark, path)
    if by_line is not None:
        return Vocab(table=by_line, size=by_line.count(), kind=kind, cased=cased)

    def entries(text: str):
        def line(x):
            if not (isinstance(x, dict) and x.keys() == {"token", "id"} and isinstance(x["token"], str) and type(x["id"]) is int):
                raise ValueError(f"neither a vocabulary object nor a token's line: {str(x)[:80]}")
            return x["token"], x["id"]
        try:
            whole = json.loads(text)
        except json.JSONDecodeError:
            return [line(json.loads(x)) for x in text.split("\n") if x.strip()]
        if isinstance(whole, dict) and all(type(i) is int for i in whole.values()):
            return list(whole.items())
        return [line(whole)]

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for text in batch.column("value").to_pylist():
                found = entries(text) if text.strip() else []
                yield pa.record_batch([pa.array([t for t, _ in found], pa.string()), pa.array([i for _, i in found], pa.int64())],
                                      names=["token", "id"])

    table = spark.read.text(path, wholetext=True).mapInArrow(run, "token string, id bigint")
    return Vocab(table=table, size=table.count(), kind=kind, cased=cased)


def _single_file(lines, path: str) -> None:
    """A table (at, value) as the lines of one file, written by one task in
    the order of ``at`` and put in place under ``path``."""
    spark, folder = lines.sparkSession, f"{path}.parts"
    lines.repartition(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, parts = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(conf)
    part = next(f.getPath() for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-"))
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"could not write {path}")
    fs.delete(parts, True)


def _quoted(column):
    """Strings as JSON strings."""
    from pyspark.sql import types as T

    @F.arrow_udf(T.StringType())
    def run(values):
        import pyarrow as pa
        return pa.array([json.dumps(x, ensure_ascii=False) for x in values.to_pylist()], pa.string())

    return run(column)


def save_vocab_object(vocab, path: str) -> None:
    """The vocabulary as one JSON file with one ``{token: id}`` object,
    in the order of the ids."""
    spark, last = vocab.table.sparkSession, vocab.table.agg(F.max("id")).first()[0]
    at = lambda part, i: F.struct(F.lit(part).alias("part"), i.cast("long").alias("i"))
    mark = lambda part, text: spark.range(1).select(at(part, F.col("id")).alias("at"), F.lit(text).alias("value"))
    lines = vocab.table.select(at(1, F.col("id")).alias("at"), F.concat(
        _quoted("token"), F.lit(": "), F.col("id").cast("string"), F.when(F.col("id") < last, ",").otherwise("")).alias("value"))
    _single_file(mark(0, "{").unionByName(lines).unionByName(mark(2, "}")), path)


#: fixed parts of the tokenizer file (format of the public ``tokenizers`` library)
_JSON_HEAD = """{
  "version": "1.0",
  "truncation": null,
  "padding": null,
  "added_tokens": [
%s
  ],
  "normalizer": null,
  "pre_tokenizer": {
    "type": "Whitespace"
  },
  "post_processor": null,
  "decoder": null,
  "model": {
    "type": "BPE",
    "dropout": null,
    "unk_token": "[UNK]",
    "continuing_subword_prefix": null,
    "end_of_word_suffix": null,
    "fuse_unk": false,
    "byte_fallback": false,
    "ignore_merges": false,
    "vocab": {"""
_JSON_ADDED = """    {
      "id": %d,
      "content": %s,
      "single_word": false,
      "lstrip": false,
      "rstrip": false,
      "normalized": false,
      "special": true
    }"""


def save_bpe_json(model, path: str) -> None:
    """The model as the one JSON file that the ``tokenizers`` library
    writes and reads, byte for byte: vocabulary by id, merges by rank."""
    from tessera.constants import SPECIAL_TOKENS
    spark = model.vocab.sparkSession
    at = lambda part, i, k=0: F.struct(F.lit(part).alias("part"), i.cast("long").alias("i"), F.lit(k).alias("k"))
    fixed = lambda part, text: spark.range(1).select(at(part, F.col("id")).alias("at"), F.lit(text).alias("value"))
    added = ",\n".join(_JSON_ADDED % (i, json.dumps(t)) for t, i in sorted(SPECIAL_TOKENS.items(), key=lambda x: x[1]))
    last_id = model.vocab.agg(F.max("id")).first()[0]
    vocab = model.vocab.select(at(1, F.col("id")).alias("at"), F.concat(
        F.lit("      "), _quoted("token"), F.lit(": "), F.col("id").cast("string"),
        F.when(F.col("id") < last_id, ",").otherwise("")).alias("value"))
    names = model.vocab.select("id", "token")
    merges = (model.merges.select("rank", "left", "right")
              .join(names.select(F.col("id").alias("left"), F.col("token").alias("a")), "left")
              .join(names.select(F.col("id").alias("right"), F.col("token").alias("b")), "right"))
    n = len(model.merge_list)
    merge_lines = merges.select(at(3, F.col("rank")).alias("at"), F.concat(
        F.lit("      [\n        "), _quoted("a"), F.lit(",\n        "), _quoted("b"), F.lit("\n      ]"),
        F.when(F.col("rank") < n - 1, ",").otherwise("")).alias("value"))
    tail = "    ]\n  }\n}" if n else "  }\n}"
    parts = [fixed(0, _JSON_HEAD % added), vocab, fixed(2, '    },\n    "merges": [' if n else '    },\n    "merges": []'),
             merge_lines, fixed(4, tail)]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    _single_file(lines, path)


def read_bpe_json(spark: SparkSession, path: str):
    """A BPE model from the library's JSON file (bounded by the
    vocabulary's size). Raises on a file whose parts this engine does not
    follow (another model, pre-tokenizer, normaliser or special ids)."""
    from tessera.constants import SPECIAL_TOKENS
    from tessera.operators.bpe import BpeModel
    spec = json.loads(spark.read.text(path, wholetext=True).first().value)
    model, vocab = spec["model"], spec["model"]["vocab"]
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
           if model.get(k)]
    if (model.get("type", "BPE") != "BPE" or odd or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "Whitespace"
            or any(vocab.get(t) != i for t, i in SPECIAL_TOKENS.items())):
        raise ValueError(f"{path}: not a byte-pair model with the fixed special ids and the Whitespace pre-tokenizer")
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    made = {m for _, _, m in merges}
    table = spark.createDataFrame(list(vocab.items()), "token string, id int")
    rows = [(k, l, r, m, a + b) for k, ((l, r, m), (a, b)) in enumerate(zip(merges, pairs))]
    return BpeModel(vocab=table, merges=spark.createDataFrame(rows, "rank int, left int, right int, merged int, token string"),
                    size=len(vocab), merge_list=merges,
                    alphabet={t: i for t, i in vocab.items() if i not in made and t not in SPECIAL_TOKENS})


def load_vocab(spark: SparkSession, directory: str):
    """Restores the table and *all* parameters."""
    from tessera.operators.vocab import Vocab
    p = _read_params(spark, f"{directory}/params")
    table = spark.read.parquet(f"{directory}/vocab.parquet")
    return Vocab(table=table, size=p["size"], kind=p["kind"], cased=p["cased"], n=p["n"],
                 start_char=p["start_char"], end_char=p["end_char"])


def save_bpe(model, directory: str) -> None:
    """Vocabulary and ordered merges as parquet."""
    model.vocab.write.mode("overwrite").parquet(f"{directory}/vocab.parquet")
    model.merges.write.mode("overwrite").parquet(f"{directory}/merges.parquet")


def load_bpe(spark: SparkSession, directory: str):
    """Rebuild a model (merge list and alphabet are bounded by the
    vocabulary size)."""
    from tessera.constants import SPECIAL_TOKENS
    from tessera.operators.bpe import BpeModel
    vocab = spark.read.parquet(f"{directory}/vocab.parquet")
    merges = spark.read.parquet(f"{directory}/merges.parquet")
    ml = [(r.left, r.right, r.merged) for r in merges.orderBy("rank").collect()]
    merged = {m for _, _, m in ml}
    alphabet = {r.token: r.id for r in vocab.collect()
                if r.id not in merged and r.token not in SPECIAL_TOKENS}
    return BpeModel(vocab=vocab, merges=merges, size=vocab.count(), merge_list=ml,
                    alphabet=alphabet)
