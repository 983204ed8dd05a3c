"""Noise (N*) and corpus-shaping (C*) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.keyed import sql_permuted
from tessera.functions.noise import add_noise
from tessera.operators import shape as sh
from tessera.operators import vocab as vc
from tessera.plans import sqlparts as q
from tessera.plans.corpus_queries import ids_string, labelled_encode_ctes, labelled_encoded
from tessera.plans.registry import query, table


# ------------------------------------------------------------------ noise
def _noise_query(name: str, subset: int | None):
    sql = f"""
WITH {labelled_encode_ctes(128)},
{q.noise_ctes('enc', 'doc_id', 'ids', 15, 15, subset=subset)}
SELECT doc_id, {q.ids_str('noised')} AS noised FROM nz"""

    @query(name, sql)
    def run(spark, sf):
        enc = labelled_encoded(spark, sf, 128)
        out = add_noise(enc, "ids", "doc_id", "noised", 15, 15, subset=subset)
        return out.select("doc_id", ids_string(F.col("noised")).alias("noised"))
    run.__name__ = name
    return run


noise_mask = _noise_query("noise_mask", 1)
noise_rotate = _noise_query("noise_rotate", 2)
noise_delete = _noise_query("noise_delete", 4)
noise_full = _noise_query("noise_full", None)


@query("noise_dynamic", f"""
WITH {labelled_encode_ctes(128)},
{q.noise_ctes('enc', 'doc_id', 'ids', 15, 15, epoch=3)}
SELECT doc_id, {q.ids_str('noised')} AS noised FROM nz""")
def noise_dynamic(spark, sf):
    """The same corpus noised for epoch 3 (differs from epoch 0)."""
    enc = labelled_encoded(spark, sf, 128)
    out = add_noise(enc, "ids", "doc_id", "noised", 15, 15, epoch=3)
    return out.select("doc_id", ids_string(F.col("noised")).alias("noised"))


# ------------------------------------------------------------------ segments
SEG_LEN = 128


def _conv_body(spark, sf):
    conv = table(spark, sf, "conversations")
    v = vc.fit_vocab(conv, "text", ["conv_id", "turn"])
    enc = vc.encode(conv, v, "text", ["conv_id", "turn"], max_len=None)
    return enc.select("conv_id", "turn", F.slice("ids", 2, F.size("ids") - 2).alias("body"))


_CONV_TOKENS = f"""
  cw AS (SELECT conv_id, turn, {q.words('text')} AS w FROM conversations),
  ct AS (SELECT conv_id, turn, generate_subscripts(w, 1) AS pos, unnest(w) AS token FROM cw),
  cv AS ({q.first_occurrence_vocab('ct', 'conv_id, turn, pos')}),
  cg AS (SELECT CAST(row_number() OVER (ORDER BY conv_id, turn, pos) - 1 AS BIGINT) AS g, cv.id
         FROM ct JOIN cv USING (token)),
  cn AS (SELECT count(*) AS total FROM cg)"""


def _strict_sql(M: int) -> str:
    st = M - 2
    return f"""
WITH {_CONV_TOKENS},
  sp AS (SELECT g, id, greatest(CAST(ceil((total - 1) / {st}) AS BIGINT), 1) - 1 AS last FROM cg, cn),
  sx AS (SELECT g, id, unnest(list_filter([CASE WHEN g % {st} = 0 AND g // {st} >= 1
                                              THEN g // {st} - 1 END, g // {st}],
                                             lambda s: s IS NOT NULL AND s <= last)) AS segment_id FROM sp),
  sg AS (SELECT segment_id, [1] || list(id ORDER BY g) || [2] AS r FROM sx GROUP BY segment_id),
  segs AS (SELECT segment_id, r || {q.pad_list(f'{M + 1} - len(r)')} AS segment FROM sg)"""


@query("segments_strict", _strict_sql(SEG_LEN) + f"""
SELECT segment_id, {q.ids_str('segment')} AS segment FROM segs""")
def segments_strict(spark, sf):
    segs = sh.segments(_conv_body(spark, sf), "body", ["conv_id", "turn"], SEG_LEN, "strict")
    return segs.select("segment_id", ids_string(F.col("segment")).alias("segment"))


def _literal_sql(M: int) -> str:
    st = M - 2
    return f"""
WITH {_CONV_TOKENS},
  lp AS (SELECT g - 1 AS gp, id, total - 2 AS L,
                CAST(ceil((total - 2 - {M} - 2) / {st}) AS BIGINT) AS K FROM cg, cn
         WHERE g >= 1 AND g <= total - 2),
  lx AS (SELECT gp, id, L, K, unnest(list_filter([CASE WHEN gp % {st} = 0 AND gp // {st} >= 1
                                               THEN gp // {st} - 1 END, gp // {st}],
                                              lambda s: s IS NOT NULL AND s <= K - 1)
                               || CASE WHEN gp >= K * {st} AND gp <= L - 2 THEN [K] ELSE [] END)
                AS segment_id FROM lp),
  lg AS (SELECT segment_id, any_value(L) AS L, any_value(K) AS K,
                [1] || list(id ORDER BY gp) || [2] AS r FROM lx GROUP BY segment_id)
SELECT segment_id, {q.ids_str(f"r || CASE WHEN segment_id = K THEN {q.pad_list(f'{M} - (L - K * {st})')} ELSE [] END")} AS segment
FROM lg"""


@query("segments_literal", _literal_sql(SEG_LEN))
def segments_literal(spark, sf):
    segs = sh.segments(_conv_body(spark, sf), "body", ["conv_id", "turn"], SEG_LEN, "literal")
    return segs.select("segment_id", ids_string(F.col("segment")).alias("segment"))


@query("denoising_pairs", _strict_sql(SEG_LEN) + f""",
{q.noise_ctes('segs', 'segment_id', 'segment', 10, 7)}
SELECT segment_id, {q.ids_str('segment')} AS original_segment,
       {q.ids_str('noised')} AS noised_segment FROM nz""")
def denoising_pairs(spark, sf):
    segs = sh.segments(_conv_body(spark, sf), "body", ["conv_id", "turn"], SEG_LEN, "strict")
    pairs = sh.denoising_pairs(segs, 10, 7)
    return pairs.select("segment_id", ids_string(F.col("original_segment")).alias("original_segment"),
                        ids_string(F.col("noised_segment")).alias("noised_segment"))


# ------------------------------------------------------------------ C3-C12
@query("shift_pairs", f"""
WITH {labelled_encode_ctes(128)}
SELECT doc_id, {q.ids_str('list_slice(ids, 1, len(ids) - 1)')} AS trg_in,
       {q.ids_str('list_slice(ids, 2, len(ids))')} AS gold FROM enc""")
def shift_pairs(spark, sf):
    enc = labelled_encoded(spark, sf, 128)
    trg_in, gold = sh.shift("ids")
    return enc.select("doc_id", ids_string(trg_in).alias("trg_in"), ids_string(gold).alias("gold"))


@query("attention_mask", f"""
WITH {labelled_encode_ctes(128)}
SELECT doc_id, {q.ids_str('list_transform(ids, lambda x: CAST(x <> 3 AS INT))')} AS attention_mask,
       CAST(list_sum(list_transform(ids, lambda x: CAST(x <> 3 AS INT))) AS BIGINT) AS n_real
FROM enc""")
def attention_mask(spark, sf):
    enc = labelled_encoded(spark, sf, 128)
    am = sh.attention_mask("ids")
    return enc.select("doc_id", ids_string(am).alias("attention_mask"),
                      F.aggregate(sh.pad_mask("ids"), F.lit(0).cast("bigint"),
                                  lambda acc, x: acc + x.cast("bigint")).alias("n_real"))


@query("max_width", f"""
WITH lw AS (SELECT {q.words('text')} AS w FROM documents JOIN labels USING (doc_id))
SELECT CAST(least(max(len(w) + 2), 512) AS BIGINT) AS width FROM lw""")
def max_width(spark, sf):
    from tessera.plans.corpus_queries import labelled_docs
    lab = labelled_docs(spark, sf)
    v = vc.fit_vocab(lab, "text", ["doc_id"])
    enc = vc.encode(lab, v, "text", ["doc_id"], max_len=None)
    return sh.max_width(enc, "ids", 512)


@query("training_rows", f"""
WITH {labelled_encode_ctes(200)},
{q.noise_ctes('enc', 'doc_id', 'ids', 15, 15)}
SELECT doc_id, {q.ids_str('noised')} AS src, {q.ids_str('ids')} AS trg, target AS label FROM nz""")
def training_rows(spark, sf):
    enc = labelled_encoded(spark, sf, 200)
    rows = sh.training_rows(enc, "ids", "doc_id", "target", noise=True)
    return rows.select("doc_id", ids_string(F.col("src")).alias("src"),
                       ids_string(F.col("trg")).alias("trg"), "label")


@query("batches_shuffled", f"""
WITH RECURSIVE {sql_permuted('SELECT doc_id AS row, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM labels', 0, 0, 'order')}
SELECT row AS doc_id, position, CAST(position // 32 AS BIGINT) AS batch_id FROM placed""")
def batches_shuffled(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id")
    return sh.batches(lab, "doc_id", 32, shuffle=True).select("doc_id", "position", "batch_id")


@query("batches_sequential", """
SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS position,
       CAST((row_number() OVER (ORDER BY doc_id) - 1) // 32 AS BIGINT) AS batch_id
FROM documents""")
def batches_sequential(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return sh.batches(d, "doc_id", 32, shuffle=False).select("doc_id", "position", "batch_id")


@query("gold_positions", f"""
WITH {labelled_encode_ctes(128)},
  g AS (SELECT doc_id, list_slice(ids, 2, len(ids)) AS gold FROM enc)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, CAST(gold[i] AS BIGINT) AS gold
FROM g, range(1, len(gold) + 1) t(i) WHERE gold[i] <> 3""")
def gold_positions(spark, sf):
    """C4 + C5 + P10: teacher-forcing gold flattened to one row per
    position, padding dropped."""
    enc = labelled_encoded(spark, sf, 128)
    _, gold = sh.shift("ids")
    ex = enc.select("doc_id", F.posexplode(gold).alias("pos", "gold"))
    return ex.filter(F.col("gold") != 3).select("doc_id", F.col("pos").cast("bigint"),
                                                F.col("gold").cast("bigint"))


@query("preview_head", """
SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10""")
def preview_head(spark, sf):
    """The first ten rows in row order (a top-k: the limit is the
    feature)."""
    return table(spark, sf, "documents").select("doc_id", "lang").orderBy("doc_id").limit(10)
