"""Queries of the smaller operators: benchmark sets, uncased vocabularies,
column picking, ordered text corpora, JSON vocabularies, epoch totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.keyed import sql_u32
from tessera.functions.text import clean_generated
from tessera.operators import metrics as mt
from tessera.operators import vocab as vc
from tessera.operators.ids import with_row_index
from tessera.plans import sqlparts as q
from tessera.plans.registry import query, table
from tessera.session import scratch_dir
from tessera.sources import corpus as src


# ------------------------------------------------------------------- S5
def _benchmark(name: str):
    text_col, _, splits = src.BENCHMARK_SETS[name]
    shares = {s: 1.0 / len(splits) for s in splits}

    def run(spark, sf):
        """S5 + S6: a labelled set normalised, written by split in one pass
        and read back."""
        docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id") \
            .select("doc_id", F.regexp_replace("text", r"\s+", " ").alias(text_col), F.col("quality").alias("label"))
        norm = src.normalize_benchmark(src.keyed_split(docs, "doc_id", shares), name, keep=["split"])
        path = scratch_dir(spark, f"bench-{name}")
        src.write_benchmark(norm, name, path)
        back = spark.read.options(**src.CSV_OPTIONS).schema("sentence string, target int, split string") \
            .csv(f"{path}/{name}")
        return back.select("sentence", "target", "split")

    return run


def _benchmark_sql(splits: list[str]) -> str:
    u = f"{sql_u32(0, 0, 'split', 'doc_id', '0')} / 4294967296.0"
    cases = " ".join(f"WHEN {u} < {k + 1}.0 / {len(splits)} THEN '{s}'" for k, s in enumerate(splits[:-1]))
    return f"""
SELECT regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g') AS sentence, CAST(quality AS INT) AS target,
       CASE {cases} ELSE '{splits[-1]}' END AS split
FROM documents JOIN labels USING (doc_id)"""


# each set's splits, spelled out for the oracle
for _name, _splits in {"ag_news": ["train", "test"], "cola": ["train", "test", "val"], "imdb": ["train", "test"],
                       "yelp": ["train", "test"], "mr": ["train", "test", "val"]}.items():
    query(f"benchmark_{_name}", _benchmark_sql(_splits))(_benchmark(_name))


# ------------------------------------------------------------------- T7, K16
@query("word_vocab_uncased", f"""
WITH dw AS (SELECT doc_id, {q.words('lower(text)')} AS w FROM documents),
  dt AS (SELECT doc_id AS ord1, generate_subscripts(w, 1) AS ord2, unnest(w) AS token FROM dw)
{q.first_occurrence_vocab('dt')}""")
def word_vocab_uncased(spark, sf):
    """T7 + K16: the word tokenizer, chosen by name, over lower-cased text."""
    v = vc.fit_tokenizer(table(spark, sf, "documents"), "space", cased=False)
    return v.table.select("token", F.col("id").cast("bigint").alias("id"))


# ------------------------------------------------------------------- P1-P4, P8
@query("picked_columns", """
SELECT url AS sentence, CAST(page_id AS DOUBLE) AS target FROM pages""")
def picked_columns(spark, sf):
    """P1 + P3 + P4: by name, then by position, with canonical names."""
    pages = table(spark, sf, "pages").select("url", "page_id", "html")
    return src.pick_columns(pages, prefer="text")


@query("preferred_column", """
SELECT text AS sentence, CAST(doc_id AS DOUBLE) AS target FROM documents""")
def preferred_column(spark, sf):
    """The preferred column wins over the named one."""
    return src.pick_columns(table(spark, sf, "documents"), text="source", target="doc_id")


@query("clean_start_end", """
SELECT conv_id, turn, trim(array_to_string(list_filter(regexp_split_to_array(trim(
         regexp_replace(lower(text), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), ' '), lambda x: x <> ''), ' ')) AS sentence
FROM conversations""")
def clean_start_end(spark, sf):
    """Only the start and end tokens are dropped."""
    c = table(spark, sf, "conversations")
    marked = F.concat(F.lit("[START] "), F.regexp_replace(F.lower("text"), r"\s+", " "), F.lit(" [END]"))
    return c.select("conv_id", "turn", clean_generated(marked).alias("sentence"))


# ------------------------------------------------------------------- S3, S7
@query("ordered_lines", r"""
SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line,
       regexp_replace(text, '[\r\n]+', ' ', 'g') AS text
FROM conversations""")
def ordered_lines(spark, sf):
    """S7 + S3: lines written in order, read back by their order key."""
    path = scratch_dir(spark, "ordered")
    src.write_lines(table(spark, sf, "conversations"), "text", path, order_cols=["conv_id", "turn"])
    lines = src.read_text_corpus(spark, path)
    return with_row_index(lines, ["file", "block", "line_id"], col="line").select("line", "text")


# ------------------------------------------------------------------- S9, S10
@query("json_vocab", f"""
WITH dw AS (SELECT doc_id, {q.words('text')} AS w FROM documents),
  dt AS (SELECT doc_id AS ord1, generate_subscripts(w, 1) AS ord2, unnest(w) AS token FROM dw)
{q.first_occurrence_vocab('dt')}""")
def json_vocab(spark, sf):
    """A vocabulary exported as JSON lines and imported again."""
    path = scratch_dir(spark, "json")
    src.save_vocab(vc.fit_vocab(table(spark, sf, "documents")), path)
    return src.read_json_vocab(spark, f"{path}/vocab.json").table.select("token", "id")


@query("vocab_object", f"""
WITH dw AS (SELECT doc_id, {q.words('text')} AS w FROM documents),
  dt AS (SELECT doc_id AS ord1, generate_subscripts(w, 1) AS ord2, unnest(w) AS token FROM dw)
{q.first_occurrence_vocab('dt')}""")
def vocab_object(spark, sf):
    """S8 + S9: the vocabulary as one ``{token: id}`` file, and read again."""
    path = scratch_dir(spark, "object") + ".json"
    src.save_vocab_object(vc.fit_vocab(table(spark, sf, "documents")), path)
    return src.read_json_vocab(spark, path).table.select("token", "id")


@query("ngram_vocab_roundtrip", f"""
WITH dw AS (SELECT doc_id, {q.words('text')} AS w FROM documents),
  dg AS (SELECT doc_id, flatten(list_transform(w, lambda x: list_transform(
           range(1, greatest(length(x) + 2 - 4 + 1, 0) + 1), lambda i: substr('<' || x || '>', i, 4)))) AS g FROM dw),
  dt AS (SELECT doc_id AS ord1, generate_subscripts(g, 1) AS ord2, unnest(g) AS token FROM dg)
{q.first_occurrence_vocab('dt')}""")
def ngram_vocab_roundtrip(spark, sf):
    """S10 + K8: a 4-gram vocabulary with its own word marks, saved and
    loaded with every parameter."""
    docs = table(spark, sf, "documents")
    v = vc.fit_vocab(docs, kind="ngram", n=4, start_char="<", end_char=">")
    path = scratch_dir(spark, "ngram")
    src.save_vocab(v, path)
    back = src.load_vocab(spark, path)
    assert (back.kind, back.n, back.start_char, back.end_char) == ("ngram", 4, "<", ">")
    return back.table.select("token", "id")


# ------------------------------------------------------------------- M11
@query("training_totals", """
WITH b AS (SELECT CAST(ts AS DATE) AS epoch, value AS nll, value / 4 AS kl,
                  1 + event_id % 7 AS words, event_id % 2 AS correct FROM events)
SELECT epoch, CAST(count(*) AS BIGINT) AS n_batches, round(sum(nll), 6) AS nll_sum, round(sum(kl), 6) AS kl_sum,
       CAST(sum(words) AS BIGINT) AS words_sum, CAST(sum(correct) AS BIGINT) AS correct_sum,
       round(sum(nll) / sum(words), 6) AS nll_per_word, round(sum(correct) / sum(words), 6) AS accuracy
FROM b GROUP BY epoch""")
def training_totals(spark, sf):
    """Totals of NLL, KL, words and correct tokens per epoch."""
    ev = table(spark, sf, "events").select(
        F.to_date("ts").alias("epoch"), F.col("value").alias("nll"), (F.col("value") / 4).alias("kl"),
        (1 + F.col("event_id") % 7).alias("words"), (F.col("event_id") % 2).alias("correct"))
    t = mt.training_totals(ev)
    return t.select("epoch", "n_batches", *[F.round(c, 6).alias(c) for c in ("nll_sum", "kl_sum")], "words_sum",
                    "correct_sum", *[F.round(c, 6).alias(c) for c in ("nll_per_word", "accuracy")])
