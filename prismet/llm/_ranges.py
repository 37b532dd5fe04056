"""Order over a whole table without a global sort: buckets between quantiles, and ranks from their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` computed once: a lambda's variable, so the optimiser cannot copy it into each use."""
    return F.transform(F.array(value), body)[0]


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """Lowest values of about ``parts`` equally filled buckets; each is a value of the column, the first its minimum.

    One aggregation whose state is a quantile sketch; ``parts`` numbers reach the driver, whatever the table holds.
    """
    shares = [k / parts for k in range(1, parts)] or [0.5]
    row = df.agg(F.min(column).alias("low"), F.expr(f"approx_percentile({column}, array({', '.join(f'{s!r}D' for s in shares)}), {max(10000, 4 * parts)})").alias("cuts")).first()
    if row["low"] is None:
        return []
    return sorted({row["low"], *(row["cuts"] if parts > 1 else [])})


def bucket_of(column: Column, bounds: list[int]) -> Column:
    """Index of the last bound that is not above the value (0 for nulls), by bisection."""
    n = len(bounds)
    steps = [1 << k for k in range(max(n - 1, 1).bit_length() - 1, -1, -1)]
    table = F.array(*[F.lit(b).cast("long") for b in bounds]) if n < 64 else F.from_json(F.lit("[" + ",".join(map(str, bounds)) + "]"), "array<long>")
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step < n) & (F.get(table, at + step) <= column), at + step).otherwise(at),
    )
