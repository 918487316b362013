"""Which constraints the rows of a table satisfy together: one grouped scan, whole numbers as bit sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Constraints that one column of bits holds; more take more columns.
MASK_BITS = 62


def _name(k: int) -> str:
    return "mask" if k < MASK_BITS else f"mask{k // MASK_BITS}"


def bit(k: int) -> Column:
    """Whether a row of ``masks`` has the k-th constraint, as 0 or 1."""
    return F.getbit(F.col(_name(k)), F.lit(k % MASK_BITS)).cast("int")


def has_bit(row: Row, k: int) -> bool:
    return bool(row[_name(k)] >> k % MASK_BITS & 1)


def masks(source: DataFrame, constraints: list[str]) -> DataFrame:
    """(mask, n): how many rows satisfy exactly the constraints whose bits are set; null counts as not satisfied.

    Constraints after the 62nd are in mask1, mask2 and so on.
    """
    columns: dict[str, Column] = {_name(k): F.lit(0).cast("bigint") for k in range(0, max(1, len(constraints)), MASK_BITS)}
    for k, c in enumerate(constraints):
        one = F.when(F.expr(c), F.lit(1 << k % MASK_BITS).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        columns[_name(k)] = columns[_name(k)].bitwiseOR(one)
    return source.select(*[c.alias(n) for n, c in columns.items()]).groupBy(*columns).agg(F.count("*").alias("n"))


def holding(counts: DataFrame, need: list[int]) -> DataFrame:
    """The rows of ``masks`` that have all constraints ``need``."""
    for name in dict.fromkeys(map(_name, need)):
        bits = F.lit(sum(1 << k % MASK_BITS for k in need if _name(k) == name)).cast("bigint")
        counts = counts.where(F.col(name).bitwiseAND(bits) == bits)
    return counts


def whole_masks(counts: DataFrame, n: int) -> list[int]:
    """The bits of ``n`` constraints of every row of ``masks`` as one number; for few rows."""
    return [sum(row[name] << MASK_BITS * k for k, name in enumerate(dict.fromkeys(map(_name, range(n))))) for row in counts.collect()]
