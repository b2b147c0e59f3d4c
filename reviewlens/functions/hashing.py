"""Repeatable randomness as Column expressions (R1-R8, G-steps).

A draw is a hash of (seed, keys..., purpose), so reruns, retried tasks and the
DuckDB oracle all see the same numbers.  ``rand()`` is never used.

    Spark : conv(substr(md5(concat_ws('|', ...)), 1, 8), 16, 10)
    DuckDB: ('0x' || substr(md5(concat_ws('|', ...)), 1, 8))::BIGINT
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(1 << 32)


def _parts(*parts) -> list[Column]:
    out = []
    for p in parts:
        if isinstance(p, Column):
            out.append(p.cast("string"))
        else:
            out.append(F.lit(str(p)))
    return out


def hash32(*parts) -> Column:
    """Unsigned 32-bit integer from md5 of the '|'-joined parts (BIGINT)."""
    h = F.substring(F.md5(F.concat_ws("|", *_parts(*parts))), 1, 8)
    return F.conv(h, 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """U[0, 1) from the parts."""
    return hash32(*parts) / F.lit(SCALE)


def randint(lo: int | Column, hi: int | Column, *parts) -> Column:
    """Integer in [lo, hi) from the parts."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return (lo_c + F.floor(uniform(*parts) * (hi_c - lo_c))).cast("bigint")


def free_id(held: Column, r: Column) -> Column:
    """The r-th (from 0) of the ids 0, 1, 2, ... that ``held`` (distinct) lacks:
    r plus the number of held ids with at most r free ids below them."""
    below = F.transform(F.array_sort(held), lambda v, k: v - k)
    return r + F.size(F.filter(below, lambda free: free <= r)).cast("bigint")


def sample(k: Column, n: Column, *parts) -> Column:
    """``k`` different ids of 0..n-1 in the order drawn (k <= n); needs the drawn ids only, never all n."""
    return F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), k.cast("bigint")), F.array().cast("array<bigint>"),
        lambda held, i: F.array_append(held, free_id(held, randint(0, n - F.size(held), *parts, i))))


def normal(mean: float, sd: float, *parts) -> Column:
    """N(mean, sd) by Box-Muller over two hashed uniforms."""
    u1 = (hash32(*parts, "n1") + F.lit(1)) / F.lit(SCALE + 1)
    u2 = uniform(*parts, "n2")
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
    return F.lit(mean) + F.lit(sd) * z


# --- the same draws as DuckDB SQL text (oracle) -----------------------------
def sql_hash32(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def sql_uniform(*parts: str) -> str:
    return f"({sql_hash32(*parts)} / {SCALE})"


def sql_randint(lo: str, hi: str, *parts: str) -> str:
    return f"CAST(({lo}) + floor({sql_uniform(*parts)} * (({hi}) - ({lo}))) AS BIGINT)"


def sql_free_id(held: str, r: str) -> str:
    return (f"(({r}) + len(list_filter(list_transform(list_sort({held}), lambda v, k: v - k + 1), "
            f"lambda free: free <= ({r}))))::BIGINT")


def sql_sample(k: str, n: str, *parts: str) -> str:
    new = sql_free_id("held", sql_randint("0", f"({n}) - len(held)", *parts, "i[1]"))
    return (f"list_reduce(list_transform(range(1, ({k}) + 1), lambda i: [i]), "
            f"lambda held, i: list_append(held, {new}), []::BIGINT[])")


def sql_normal(mean: float, sd: float, *parts: str) -> str:
    u1 = f"(({sql_hash32(*parts, chr(39) + 'n1' + chr(39))} + 1) / {SCALE + 1})"
    u2 = sql_uniform(*parts, "'n2'")
    return f"({mean} + {sd} * sqrt(-2.0 * ln({u1})) * cos({2 * math.pi} * {u2}))"
