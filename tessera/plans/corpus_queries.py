"""Cleaning, vocabulary, encode and decode queries (T*, K2-K10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import vocab as vc
from tessera.plans import sqlparts as q
from tessera.plans.registry import query, table


def ids_string(col) -> F.Column:
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


def labelled_docs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text, target): documents joined to their quality label."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double")
                                               .alias("target"))
    return docs.join(labels, "doc_id")


# ---------------------------------------------------------------- cleaning
@query("clean_special", f"""
SELECT doc_id, {q.special_chars('text')} AS clean FROM documents""")
def clean_special(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.remove_special_characters("text").alias("clean"))


@query("clean_brackets", f"""
SELECT doc_id, {q.brackets("concat('[', lang, '] ', text)")} AS clean FROM documents""")
def clean_brackets(spark, sf):
    d = table(spark, sf, "documents")
    tagged = F.concat(F.lit("["), F.col("lang"), F.lit("] "), F.col("text"))
    return d.select("doc_id", tx.remove_brackets(tagged).alias("clean"))


@query("split_words", f"""
SELECT doc_id, array_to_string({q.split_tokens('text')}, ' ') AS split FROM documents""")
def split_words(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.split_words("text").alias("split"))


def _html_sql(expr: str) -> str:
    e = f"regexp_replace({expr}, '<!--.*?-->', '', 'gs')"
    for tag in ("script", "style", "template"):
        e = f"regexp_replace({e}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    e = f"regexp_replace({e}, '<[^>]*>', '', 'g')"
    for ent, ch in tx.HTML_ENTITIES.items():
        ch_sql = ch.replace("'", "''")
        e = f"replace({e}, '{ent}', '{ch_sql}')"
    return f"replace({e}, '&amp;', '&')"


@query("html_text", f"""
SELECT page_id, {_html_sql('html')} AS text FROM pages""")
def html_text(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.strip_html("html").alias("text"))


@query("denoise_pages", f"""
SELECT page_id, {q.special_chars(q.brackets(_html_sql('html')))} AS clean FROM pages""")
def denoise_pages(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.denoise("html", "denoise").alias("clean"))


@query("drop_special_tokens", f"""
SELECT conv_id, turn, array_to_string(list_filter({q.words("concat('[START] ', text, ' [END] [PAD]')")},
       lambda x: x NOT IN {q.SPECIALS_SQL}), ' ') AS clean FROM conversations""")
def drop_special_tokens(spark, sf):
    c = table(spark, sf, "conversations")
    wrapped = F.concat(F.lit("[START] "), F.col("text"), F.lit(" [END] [PAD]"))
    return c.select("conv_id", "turn", tx.drop_tokens_str(wrapped).alias("clean"))


# ---------------------------------------------------------------- word vocab
_DOC_WORDS = f"""
  dw AS (SELECT doc_id, {q.words('text')} AS w FROM documents),
  dt AS (SELECT doc_id AS ord1, generate_subscripts(w, 1) AS ord2, unnest(w) AS token FROM dw)"""

_LAB_WORDS = f"""
  lw AS (SELECT doc_id, {q.words('text')} AS w FROM documents JOIN labels USING (doc_id)),
  lt AS (SELECT doc_id AS ord1, generate_subscripts(w, 1) AS ord2, unnest(w) AS token FROM lw)"""


@query("word_vocab", f"""
WITH {_DOC_WORDS}
{q.first_occurrence_vocab('dt')}""")
def word_vocab(spark, sf):
    v = vc.fit_vocab(table(spark, sf, "documents"), "text", ["doc_id"])
    return v.table.select("token", F.col("id").cast("bigint").alias("id"))


def _encode_sql(max_len: int | None) -> str:
    """Vocabulary from labelled documents; encode every document."""
    kept = "" if max_len is None else f"WHERE pos <= {max_len - 3}"
    pad = "" if max_len is None else f" || {q.pad_list(f'{max_len - 2} - len(body)')}"
    return f"""
WITH {_LAB_WORDS},
  v AS ({q.first_occurrence_vocab('lt')}),
  e AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS token
        FROM (SELECT doc_id, {q.words('text')} AS w FROM documents)),
  m AS (SELECT e.doc_id, list(coalesce(v.id, 0) ORDER BY e.pos) AS body
        FROM e LEFT JOIN v USING (token) {kept} GROUP BY e.doc_id),
  b AS (SELECT d.doc_id, coalesce(m.body, []) AS body FROM documents d LEFT JOIN m USING (doc_id))
SELECT doc_id, {q.ids_str(f'[1] || body || [2]{pad}')} AS ids FROM b"""


@query("word_encode", _encode_sql(512))
def word_encode(spark, sf):
    v = vc.fit_vocab(labelled_docs(spark, sf), "text", ["doc_id"])
    enc = vc.encode(table(spark, sf, "documents"), v, "text", ["doc_id"], max_len=512)
    return enc.select("doc_id", ids_string(F.col("ids")).alias("ids"))


@query("word_decode", f"""
WITH {_LAB_WORDS},
  v AS ({q.first_occurrence_vocab('lt')}),
  e AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS token
        FROM (SELECT doc_id, {q.words('text')} AS w FROM documents)),
  m AS (SELECT e.doc_id, list(v.token ORDER BY e.pos) FILTER (WHERE v.id IS NOT NULL) AS toks
        FROM e LEFT JOIN v USING (token) GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(array_to_string(m.toks, ' '), '') AS text
FROM documents d LEFT JOIN m USING (doc_id)""")
def word_decode(spark, sf):
    v = vc.fit_vocab(labelled_docs(spark, sf), "text", ["doc_id"])
    enc = vc.encode(table(spark, sf, "documents"), v, "text", ["doc_id"], max_len=None)
    dec = vc.decode_words(enc, "ids", v, ["doc_id"], remove_special=True)
    return dec.select("doc_id", F.array_join("tokens", " ").alias("text"))


# ---------------------------------------------------------------- n-gram vocab
def _grams_sql(words_expr: str, n: int = 3) -> str:
    """Flattened char n-grams of every word, in (word, gram) order."""
    return (f"flatten(list_transform({words_expr}, lambda wd: list_transform("
            f"range(1, greatest(length('#' || wd || '+') - {n - 1}, 0) + 1), "
            f"lambda i: substring('#' || wd || '+', i, {n}))))")


@query("ngram_vocab", f"""
WITH g AS (SELECT doc_id, {_grams_sql(q.words('text'))} AS w FROM documents),
  gt AS (SELECT doc_id AS ord1, generate_subscripts(w, 1) AS ord2, unnest(w) AS token FROM g)
{q.first_occurrence_vocab('gt')}""")
def ngram_vocab(spark, sf):
    v = vc.fit_vocab(table(spark, sf, "documents"), "text", ["doc_id"], kind="ngram")
    return v.table.select("token", F.col("id").cast("bigint").alias("id"))


_NGRAM_ENC = f"""
WITH lg AS (SELECT doc_id, {_grams_sql(q.words('text'))} AS w FROM documents JOIN labels USING (doc_id)),
  lt AS (SELECT doc_id AS ord1, generate_subscripts(w, 1) AS ord2, unnest(w) AS token FROM lg),
  v AS ({q.first_occurrence_vocab('lt')}),
  e AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS token
        FROM (SELECT doc_id, {_grams_sql(q.words('text'))} AS w FROM documents)),"""


@query("ngram_encode", _NGRAM_ENC + f"""
  m AS (SELECT e.doc_id, list(coalesce(v.id, 0) ORDER BY e.pos) AS body
        FROM e LEFT JOIN v USING (token) WHERE pos <= 509 GROUP BY e.doc_id),
  b AS (SELECT d.doc_id, coalesce(m.body, []) AS body FROM documents d LEFT JOIN m USING (doc_id))
SELECT doc_id, {q.ids_str(f"[1] || body || [2] || {q.pad_list('510 - len(body)')}")} AS ids FROM b""")
def ngram_encode(spark, sf):
    v = vc.fit_vocab(labelled_docs(spark, sf), "text", ["doc_id"], kind="ngram")
    enc = vc.encode(table(spark, sf, "documents"), v, "text", ["doc_id"], max_len=512)
    return enc.select("doc_id", ids_string(F.col("ids")).alias("ids"))


def _rebuild_sql(expr: str, n: int = 3) -> str:
    s = f"replace(replace({expr}, '#', ''), '+', ' ')"
    one = (f"CASE WHEN length(wd) = 1 OR length(wd) <= {n - 2} THEN wd ELSE "
           f"substring(wd, 1, {n - 1}) || array_to_string(list_transform("
           f"range(0, greatest(CAST(ceil((length(wd) - {n - 1}) / {n}) AS BIGINT), 0)), "
           f"lambda j: substring(wd, {n - 1} + j * {n} + {n}, 1)), '') END")
    return f"array_to_string(list_transform({q.words(s)}, lambda wd: {one}), ' ')"


@query("ngram_decode", _NGRAM_ENC + f"""
  m AS (SELECT e.doc_id, list(v.token ORDER BY e.pos) FILTER (WHERE v.id IS NOT NULL) AS toks
        FROM e LEFT JOIN v USING (token) GROUP BY e.doc_id)
SELECT d.doc_id, {_rebuild_sql("coalesce(array_to_string(m.toks, ''), '')")} AS text
FROM documents d LEFT JOIN m USING (doc_id)""")
def ngram_decode(spark, sf):
    v = vc.fit_vocab(labelled_docs(spark, sf), "text", ["doc_id"], kind="ngram")
    enc = vc.encode(table(spark, sf, "documents"), v, "text", ["doc_id"], max_len=None)
    return vc.decode_ngrams(enc, "ids", v, ["doc_id"], remove_special=True)


# ---------------------------------------------------------------- flagship
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents -> special-character cleaning -> word vocabulary
    -> fixed-length (128) id arrays with their target."""
    enc = labelled_encoded(spark, sf, 128)
    return enc.select("doc_id", "target", ids_string(F.col("ids")).alias("ids"))


def labelled_encode_ctes(max_len: int = 128) -> str:
    """CTEs ending in ``enc(doc_id, target, ids)`` = the flagship encode."""
    return f"""
  lw AS (SELECT doc_id, quality, {q.words(q.special_chars('text'))} AS w
         FROM documents JOIN labels USING (doc_id)),
  lt AS (SELECT doc_id AS ord1, generate_subscripts(w, 1) AS ord2, unnest(w) AS token FROM lw),
  v AS ({q.first_occurrence_vocab('lt')}),
  e AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS token FROM lw),
  m AS (SELECT e.doc_id, list(coalesce(v.id, 0) ORDER BY e.pos) AS body
        FROM e LEFT JOIN v USING (token) WHERE pos <= {max_len - 3} GROUP BY e.doc_id),
  b AS (SELECT lw.doc_id, CAST(lw.quality AS DOUBLE) AS target, coalesce(m.body, []) AS body
        FROM lw LEFT JOIN m USING (doc_id)),
  enc AS (SELECT doc_id, target, [1] || body || [2] || {q.pad_list(f'{max_len - 2} - len(body)')} AS ids
          FROM b)"""


def labelled_encoded(spark: SparkSession, sf: str, max_len: int = 128) -> DataFrame:
    """(doc_id, target, ids) of the flagship encode."""
    lab = labelled_docs(spark, sf).withColumn("text", tx.remove_special_characters("text"))
    v = vc.fit_vocab(lab, "text", ["doc_id"])
    return vc.encode(lab, v, "text", ["doc_id"], max_len=max_len, carry=["target"])


@query("labelled_encode", f"""
WITH {labelled_encode_ctes(128)}
SELECT doc_id, target, {q.ids_str('ids')} AS ids FROM enc""")
def labelled_encode(spark, sf):
    return flagship(spark, sf)
