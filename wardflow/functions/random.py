"""Reproducible randomness as column expressions.

Every random choice in the package (split, few-shot samples, shuffles,
bootstrap weights) is a pure function of a row key and a seed, so results do
not depend on partitioning, task order, retries or executor loss, and the same
numbers can be computed in SQL by any engine that has ``md5``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits = 52 bits, so the uniform is exact in a double.
UNIFORM_BITS = 52


def hash_key(*parts: Column | str) -> Column:
    """``md5`` hex of the parts joined by ':' (the order key of all samplers)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def uniform(*parts: Column | str) -> Column:
    """Uniform number in [0, 1) derived from ``hash_key(*parts)``."""
    hexdigits = F.substring(hash_key(*parts), 1, UNIFORM_BITS // 4)
    return F.conv(hexdigits, 16, 10).cast("double") / float(2**UNIFORM_BITS)


def poisson_cdf(mean: float = 1.0, tail: float = 2.0**-31) -> list[float]:
    """CDF values P(X <= k) of Poisson(mean) until the tail is below ``tail``."""
    values, term, total, k = [], math.exp(-mean), 0.0, 0
    while True:
        total += term
        values.append(total)
        k += 1
        term *= mean / k
        if 1.0 - total < tail or k > 200:
            return values


def poisson_weight(u: Column, mean: float = 1.0) -> Column:
    """Inverse-CDF Poisson(mean) draw from a uniform column: #{k : u > CDF(k)}."""
    return sum((F.when(u > F.lit(c), 1).otherwise(0) for c in poisson_cdf(mean)), F.lit(0))


def poisson_weight_sql(u_sql: str, mean: float = 1.0) -> str:
    """The same draw as ``poisson_weight`` written as SQL text (for the oracle)."""
    return "(" + " + ".join(f"(CASE WHEN {u_sql} > {c!r} THEN 1 ELSE 0 END)" for c in poisson_cdf(mean)) + ")"


def uniform_sql(parts_sql: list[str]) -> str:
    """SQL text of ``uniform`` for DuckDB: 52-bit prefix of the md5 hex."""
    joined = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts_sql)
    return f"(CAST(('0x' || substr(md5({joined}), 1, 13)) AS BIGINT) / {float(2**UNIFORM_BITS)!r})"


def hash_key_sql(parts_sql: list[str]) -> str:
    joined = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts_sql)
    return f"md5({joined})"


# Counter-based uniform for bulk draws (bootstrap weights). An id of any type
# becomes 60 bits of its md5 once per row (``key_bits``); both 30-bit halves then
# enter a few rounds of multiply-mod-prime and xorshift on 31-bit integers. All
# products stay below 2^62, so bigint arithmetic never overflows and any SQL
# engine with ``%``, ``>>`` and xor reproduces it exactly; a draw is ~30x cheaper
# than md5 + conv.
MIX_PRIME = 2147483647  # 2^31 - 1
HALF_BITS = 30
# (multiplier, addend, shift) of the three rounds
_MIX_ROUNDS = [(1103515245, 12345, 15), (1664525, 1013904223, 13), (22695477, 1, 16)]


def key_bits(key: Column) -> Column:
    """60 bits of an id of any type: the first 15 hex digits of the md5 of its text (a null id counts as '')."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 2 * HALF_BITS // 4), 16, 10).cast("long")


def key_bits_sql(key_sql: str) -> str:
    return f"CAST('0x' || substr(md5(coalesce(CAST({key_sql} AS VARCHAR), '')), 1, {2 * HALF_BITS // 4}) AS BIGINT)"


def _pmod(x: Column, p: int) -> Column:
    return F.pmod(x, F.lit(p).cast("long"))


def mixed_uniform(bits: Column, counter: Column, seed: int) -> Column:
    """Uniform in (0, 1) from (``key_bits`` of an id, integer counter, seed)."""
    p = MIX_PRIME
    low, high = bits.bitwiseAND(F.lit((1 << HALF_BITS) - 1)), F.shiftright(bits, HALF_BITS)
    c = counter.cast("long")
    x = _pmod(low * F.lit(48271) + c * F.lit(16807) + F.lit(int(seed) % p) * F.lit(69621), p)
    for (mul, add, shift), extra in zip(_MIX_ROUNDS, (high, c, low)):
        x = x.bitwiseXOR(F.shiftright(x, shift))
        x = _pmod(x * F.lit(mul) + F.lit(add) + extra, p)
    return (x.cast("double") + F.lit(0.5)) / F.lit(float(p))


def mixed_uniform_sql(bits_sql: str, counter_sql: str, seed: int) -> str:
    """SQL text of ``mixed_uniform`` (DuckDB: ``xor`` function, ``>>`` shift)."""
    p = MIX_PRIME
    low, high, c = f"(({bits_sql}) & {(1 << HALF_BITS) - 1})", f"(({bits_sql}) >> {HALF_BITS})", f"CAST({counter_sql} AS BIGINT)"
    x = f"(({low} * 48271 + {c} * 16807 + {int(seed) % p} * 69621) % {p})"
    for (mul, add, shift), extra in zip(_MIX_ROUNDS, (high, c, low)):
        x = f"xor({x}, ({x}) >> {shift})"
        x = f"((({x}) * {mul} + {add} + {extra}) % {p})"
    return f"((CAST({x} AS DOUBLE) + 0.5) / {float(p)!r})"


def mixed_uniform_np(bits, counters, seed: int):
    """NumPy form of ``mixed_uniform`` for a (bits x counters) grid; bit-identical."""
    import numpy as np

    p = MIX_PRIME
    bits = np.asarray(bits, dtype=np.int64)[:, None]
    low, high = bits & ((1 << HALF_BITS) - 1), bits >> HALF_BITS
    c = np.asarray(counters, dtype=np.int64)[None, :]
    x = (low * 48271 + c * 16807 + (int(seed) % p) * 69621) % p
    for (mul, add, shift), extra in zip(_MIX_ROUNDS, (high, c, low)):
        x = x ^ (x >> shift)
        x = (x * mul + add + extra) % p
    return (x.astype(np.float64) + 0.5) / float(p)
