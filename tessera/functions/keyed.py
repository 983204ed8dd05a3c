"""Counter-based randomness: every draw is a pure function of
(seed, epoch, salt, row id, position), so results do not depend on
partitioning, repeat across task retries, and can be recomputed in SQL.

    h(salt, row, pos) = md5(concat_ws(':', seed, epoch, salt, row, pos))
    u32               = first 8 hex digits of h as an integer

A sortable per-position key is ``u32 * 2^31 + pos``: 63 bits, so it is unique
for every position that an array can have; "k of n without replacement" = the
k smallest keys. Uniform indexes are drawn from 60 bits, so every row of any
table can be drawn and the modulo's bias is below n / 2^60.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS_BITS = 31
POS_SCALE = 1 << POS_BITS


def _s(x) -> Column:
    if isinstance(x, Column):
        return x.cast("string")
    return F.lit(str(x))


def keyed_hash(seed, epoch, salt: str, row: Column | int | str, pos) -> Column:
    return F.md5(F.concat_ws(":", _s(seed), _s(epoch), F.lit(salt), _s(row), _s(pos)))


def u32(seed, epoch, salt: str, row, pos) -> Column:
    """Uniform integer in [0, 2^32)."""
    h = keyed_hash(seed, epoch, salt, row, pos)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def u60(seed, epoch, salt: str, row, pos) -> Column:
    """Uniform integer in [0, 2^60)."""
    h = keyed_hash(seed, epoch, salt, row, pos)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def position_key(seed, epoch, salt: str, row, pos: Column) -> Column:
    """Unique sortable key of a position: u32 * 2^31 + pos."""
    return u32(seed, epoch, salt, row, pos) * F.lit(POS_SCALE) + pos.cast("bigint")


def uniform_index(seed, epoch, salt: str, row, n: Column | int, pos=0) -> Column:
    """Uniform index in [0, n)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(u60(seed, epoch, salt, row, pos), n.cast("bigint"))


ROUNDS = 4
_PRIME = 2147483647


def _round_keys(seed, epoch, salt: str) -> list[list[int]]:
    """Four numbers from 1 below ``_PRIME`` for each round."""
    number = lambda r, k: int(hashlib.md5(f"{seed}:{epoch}:{salt}:{r}:{k}".encode()).hexdigest()[:15], 16)
    return [[1 + number(r, k) % (_PRIME - 1) for k in range(4)] for r in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Least ``h >= 1`` with ``4 ** h >= n``."""
    h = 1
    while 4 ** h < n:
        h += 1
    return h


def permuted(index: Column, n: int, seed, epoch, salt: str) -> Column:
    """A keyed permutation of 0..n-1: a Feistel network over two halves of
    ``half_bits(n)`` bits, walked on until it falls below ``n``. Needs no
    sort and no shuffle; n is at most 4 ** 30. Null stays null."""
    h, keys = half_bits(n), _round_keys(seed, epoch, salt)
    if h > 30:
        raise ValueError(f"at most {4 ** 30} rows")

    @F.arrow_udf(T.LongType())
    def run(column):
        import numpy as np
        import pyarrow as pa
        x = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        mask, left = (1 << h) - 1, np.arange(len(x))
        while len(left):
            a, b = x[left] >> h, x[left] & mask
            for k in keys:
                v = (b * k[0] + k[1]) % _PRIME
                v = (v * k[2] + k[3]) % _PRIME
                a, b = b, a ^ ((v ^ (v >> 15)) & mask)
            x[left] = a << h | b
            left = left[x[left] >= n]
        return pa.array(x, mask=column.is_null().to_numpy(zero_copy_only=False))

    return run(index.cast("bigint"))


# SQL spellings (DuckDB) of the same contract, used by oracle queries.
def sql_u32(seed, epoch, salt: str, row_sql: str, pos_sql: str) -> str:
    return (f"('0x' || substr(md5(concat_ws(':', '{seed}', '{epoch}', '{salt}', "
            f"CAST({row_sql} AS VARCHAR), CAST({pos_sql} AS VARCHAR))), 1, 8))::BIGINT")


def sql_u60(seed, epoch, salt: str, row_sql: str, pos_sql: str) -> str:
    return (f"('0x' || substr(md5(concat_ws(':', '{seed}', '{epoch}', '{salt}', "
            f"CAST({row_sql} AS VARCHAR), CAST({pos_sql} AS VARCHAR))), 1, 15))::BIGINT")


def sql_position_key(seed, epoch, salt: str, row_sql: str, pos_sql: str) -> str:
    return f"({sql_u32(seed, epoch, salt, row_sql, pos_sql)} * {POS_SCALE} + ({pos_sql}))"


def sql_permuted(rows_sql: str, seed, epoch, salt: str) -> str:
    """CTEs ``walk`` and ``placed`` (row, position) for ``rows_sql``, a query
    of (row, idx) with dense idx from 0; rounds spelled out one by one."""
    step = "SELECT row, idx, x >> h AS a, x & ((1::BIGINT << h) - 1) AS b, h, n FROM walk, size WHERE NOT done"
    for k in _round_keys(seed, epoch, salt):
        v = f"((((b * {k[0]} + {k[1]}) % {_PRIME}) * {k[2]} + {k[3]}) % {_PRIME})"
        step = f"SELECT row, idx, b AS a, xor(a, xor({v}, {v} >> 15) & ((1::BIGINT << h) - 1)) AS b, h, n FROM ({step})"
    return f"""idx AS ({rows_sql}),
  size AS (SELECT count(*) AS n, (SELECT min(i) FROM range(1, 31) r(i) WHERE pow(4, i) >= (SELECT count(*) FROM idx)) AS h FROM idx),
  walk AS (SELECT row, idx, CAST(idx AS BIGINT) AS x, false AS done FROM idx
    UNION ALL SELECT row, idx, (a << h) + b, (a << h) + b < n FROM ({step})),
  placed AS (SELECT row, x AS position FROM walk WHERE done)"""
