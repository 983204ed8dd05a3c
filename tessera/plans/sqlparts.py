"""DuckDB spellings shared by the oracle queries."""

# The oracle's own spelling of the character classes: a wrong class in the
# library must not pass both sides.
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
KEEP_CLASS = "a-zA-z0-9ğüşöçıİĞÜŞÖÇ"

SPECIALS_SQL = "('[UNK]', '[START]', '[END]', '[PAD]', '[MASK]')"
SPECIALS_ROWS = ("SELECT * FROM (VALUES ('[UNK]', 0), ('[START]', 1), ('[END]', 2), "
                 "('[PAD]', 3), ('[MASK]', 4)) s(token, id)")


def words(expr: str) -> str:
    """T6 in DuckDB: whitespace split without empty strings."""
    return f"list_filter(regexp_split_to_array({expr}, '[{WS}]+'), lambda x: x <> '')"


def special_chars(expr: str) -> str:
    return f"regexp_replace({expr}, '[^{KEEP_CLASS}{WS}]', '', 'g')"


def brackets(expr: str) -> str:
    return f"regexp_replace({expr}, '\\[[^\\]]*\\]', '', 'g')"


def split_tokens(expr: str) -> str:
    return f"regexp_extract_all({expr}, '[{WORD}]+|[^{WS}{WORD}]+')"


def ids_str(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: CAST(x AS VARCHAR)), ' ')"


def pad_list(n_expr: str, pad: int = 3) -> str:
    return f"list_transform(range(greatest(0, {n_expr})), lambda x: {pad})"


def first_occurrence_vocab(tokens_cte: str, order: str = "ord1, ord2") -> str:
    """``tokens_cte`` has the ``order`` columns and ``token``; ids from 5 by
    first occurrence."""
    return f"""
    SELECT token, CAST(row_number() OVER (ORDER BY {order}) + 4 AS BIGINT) AS id
    FROM (SELECT token, {order},
                 row_number() OVER (PARTITION BY token ORDER BY {order}) AS rn
          FROM {tokens_cte} WHERE token NOT IN {SPECIALS_SQL}) WHERE rn = 1
    UNION ALL SELECT token, CAST(id AS BIGINT) AS id FROM ({SPECIALS_ROWS})"""


def noise_ctes(src: str, row: str, ids: str, pm, pdel, seed=0, epoch=0,
               subset: int | None = None, out: str = "noised") -> str:
    """N5 in DuckDB: CTEs n0..n3, final CTE ``nz`` = src columns + ``out``."""
    from tessera.functions.keyed import sql_position_key, sql_u60
    sub = str(subset) if subset is not None else f"({sql_u60(seed, epoch, 'subset', row, '0')} % 8)"
    k = lambda salt: sql_position_key(seed, epoch, salt, row, "i")
    rot = sql_u60(seed, epoch, "rotate", row, "0")
    return f"""
  n0 AS (SELECT *, CASE WHEN list_position({ids}, 2) >= 1
                   THEN list_slice({ids}, 2, list_position({ids}, 2) - 1) END AS c0,
                {sub} AS sub FROM {src}),
  n1a AS (SELECT *, list_transform(range(len(c0)), lambda i: {k('mask')}) AS k1,
                 CAST(round_even(len(c0) * {pm} / 100.0, 0) AS BIGINT) AS m1 FROM n0),
  n1b AS (SELECT *, CASE WHEN m1 > 0 THEN list_sort(k1)[m1] ELSE -1 END AS t1 FROM n1a),
  n1 AS (SELECT * EXCLUDE (k1, m1, t1),
           CASE WHEN sub & 1 <> 0 THEN list_transform(range(len(c0)),
                lambda i: CASE WHEN k1[i + 1] <= t1 THEN 4 ELSE c0[i + 1] END)
                ELSE c0 END AS c1 FROM n1b),
  n2 AS (SELECT *, CASE WHEN sub & 2 <> 0 AND len(c1) > 0
                   THEN list_slice(c1, {rot} % len(c1) + 1, len(c1)) || list_slice(c1, 1, {rot} % len(c1))
                   ELSE c1 END AS c2 FROM n1),
  n3a AS (SELECT *, list_transform(range(len(c2)), lambda i: {k('delete')}) AS k3,
                 CAST(round_even(len(c2) * {pdel} / 100.0, 0) AS BIGINT) AS m3 FROM n2),
  n3b AS (SELECT *, CASE WHEN m3 > 0 THEN list_sort(k3)[m3] ELSE -1 END AS t3 FROM n3a),
  n3 AS (SELECT *, CASE WHEN sub & 4 <> 0 THEN list_filter(c2, lambda x, i: k3[i] > t3)
                   ELSE c2 END AS c3 FROM n3b),
  nz AS (SELECT * EXCLUDE (c0, sub, c1, c2, k3, m3, t3, c3),
           CASE WHEN c3 IS NOT NULL THEN [{ids}[1]] || c3 || [2]
                || {pad_list(f"len({ids}) - len(c3) - 2")} END AS {out} FROM n3)"""