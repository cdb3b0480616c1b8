"""The k first rows of a large table by a 64-bit key, without sorting it or gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kth_smallest(df: DataFrame, key: str, k: int) -> int | None:
    """The k-th smallest value (from 1) of a long column; None if there are fewer rows. Four passes, each of which sends
    at most 65,536 counts to the driver, whatever the table's size."""
    low, left = -(2**63), k
    for shift in (48, 32, 16, 0):
        span = 1 << shift
        inside = df if shift == 48 else df.where(F.col(key).between(low, low + (span << 16) - 1))
        digit = F.shiftright(key, shift)
        counts = sorted((r.d, r["count"]) for r in inside.groupBy(digit.alias("d")).count().collect())
        for d, n in counts:
            if left <= n:
                low = d << shift
                break
            left -= n
        else:
            return None
    return low


def first_k(df: DataFrame, key: str, tie: str, k: int) -> Column:
    """Whether a row is among the k first by (key, tie); rows equal in both are taken together. Neither is null."""
    if k <= 0:
        return F.lit(False)
    cut = kth_smallest(df, key, k)
    if cut is None:
        return F.lit(True)
    before = df.where(F.col(key) < cut).count()
    ties = df.where(F.col(key) == cut)
    last = kth_smallest(ties, tie, k - before)
    return (F.col(key) < cut) | ((F.col(key) == cut) & (F.col(tie) <= last))
