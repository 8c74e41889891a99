"""Column expressions used by several operators. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.session import cut_lineage

MAD_TO_SD = 1.4826  # factor that makes the MAD of a normal sample equal its sd


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def off_tie(c: str | Column, digits: int) -> Column:
    """Round after a small fixed shift, for means of decimals that end exactly half-way."""
    return rnd(col(c).cast("double") + F.lit(0.00001234), digits)


def is_finite(c: str | Column) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def signed_sqrt(c: str | Column) -> Column:
    c = col(c)
    return F.signum(c) * F.sqrt(F.abs(c))


def log5_conc(c: str | Column) -> Column:
    return F.log(col(c)) / F.log(F.lit(5.0)) + F.lit(5.0)


def log5_conc_inverse(c: str | Column) -> Column:
    return F.pow(F.lit(5.0), col(c) - F.lit(5.0))


def hash_text(*cols: str | Column, salt: str | Column = "") -> Column:
    """md5 of the joined key, a reproducible source of random order."""
    tail = F.lit(salt) if isinstance(salt, str) else salt.cast("string")
    return F.md5(F.concat_ws("_", *[col(c).cast("string") for c in cols], tail))


def hash_unit(*cols: str | Column, salt: str | Column = "") -> Column:
    """Uniform number in [0, 1) made from the first 13 hex digits (52 bits) of the key's md5."""
    return F.conv(F.substring(hash_text(*cols, salt=salt), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _shift_log_gamma(x: Column) -> Column:
    # Stirling series at x + 8, brought back by the recurrence
    y = x + F.lit(8.0)
    head = (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727)
    inv = F.lit(1.0) / y
    inv2 = inv * inv
    tail = inv * (F.lit(1 / 12) - inv2 * (F.lit(1 / 360) - inv2 * (F.lit(1 / 1260) - inv2 * (F.lit(1 / 1680) - inv2 * F.lit(1 / 1188)))))
    prod = reduce(lambda p, i: p * (x + F.lit(float(i))), range(1, 8), x)
    return head + tail - F.log(prod)


def log_gamma(c: str | Column) -> Column:
    """ln Γ(x) for x > 0, about 1e-13 relative; Spark has no built-in."""
    return _shift_log_gamma(col(c).cast("double"))


def log_factorial(c: str | Column) -> Column:
    return log_gamma(col(c).cast("double") + F.lit(1.0))


def nsjoin(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys that also matches null keys.

    No broadcast hint: Spark broadcasts a side only under its size threshold,
    and the skew-join rule splits hot keys of the sort-merge form.
    """
    if not keys:
        raise ValueError("nsjoin needs at least one key")
    other = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def attach(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a summary to the rows it was made from.

    The summary is written first: its file size is then known when the join is
    planned, so a small one is broadcast and the big side is not shuffled, and a
    large one is not broadcast.
    """
    return nsjoin(df, cut_lineage(stats), keys, how)


def with_group_stats(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Attach group aggregates to every row: aggregate then join, so that a hot
    group is reduced map-side and never gathered in one window task."""
    return attach(df, df.groupBy(*keys).agg(*aggs), keys)
