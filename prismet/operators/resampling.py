"""Seeded draws made in many tasks, and exact means and percentiles of rational values [R1, R2, A16, A17, X6].

The generator is MT19937 as Python seeds it. Its state is linear over GF(2), so the state after any number of outputs is
a sum of early states whose terms are the coefficients of a power of x modulo the generator's polynomial: each task jumps
to its own stretch of outputs. A draw below n takes outputs until one is small enough, so a stretch cannot know which
draws are its own: stretches are counted first, and the counts number the draws.
"""

from __future__ import annotations

import decimal
import math
import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismet.functions.status import AVAILABLE, UNAVAILABLE
from prismet.session import ship

#: Words of the generator's state, and bits that matter of it.
WORDS, DEGREE = 624, 19937
#: Outputs of a stretch.
STRETCH = 1 << 20
#: Bits of a numerator or denominator that a decimal of 38 digits holds for certain.
BITS = 125


def _words(key: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` state words from a state on: it and what the recurrence makes of it."""
    x = np.zeros(max(count, WORDS), np.uint32)
    x[:WORDS] = key
    at = WORDS
    while at < count:
        # 227 words at a time depend on words before them only.
        n = min(227, count - at)
        y = (x[at - 624 : at - 624 + n] & np.uint32(0x80000000)) | (x[at - 623 : at - 623 + n] & np.uint32(0x7FFFFFFF))
        x[at : at + n] = x[at - 227 : at - 227 + n] ^ (y >> np.uint32(1)) ^ np.where(y & np.uint32(1), np.uint32(0x9908B0DF), np.uint32(0))
        at += n
    return x


@lru_cache(1)
def polynomial() -> tuple[int, ...]:
    """Exponents below the degree of the generator's polynomial: the shortest recurrence of one bit of its words (Berlekamp-Massey)."""
    bits = (_words(np.array(random.Random(1).getstate()[1][:WORDS], np.uint32), 2 * DEGREE + WORDS)[WORDS:] & 1).tolist()
    now, before, length, shift, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        seen = seen << 1 | bit  # the latest bit lowest, as the recurrence's terms stand
        if (now & seen & ((1 << (length + 1)) - 1)).bit_count() & 1:
            if 2 * length <= n:
                now, before, length, shift = now ^ before << shift, now, n + 1 - length, 1
                continue
            now ^= before << shift
        shift += 1
    return tuple(length - k for k in range(length + 1) if now >> k & 1 and k)


def _reduced(value: int) -> int:
    terms, mask = polynomial(), (1 << DEGREE) - 1
    while value >> DEGREE:
        high, value = value >> DEGREE, value & mask
        for e in terms:
            value ^= high << e
    return value


def power(steps: int) -> int:
    """x to ``steps`` modulo the polynomial; squares by reading the bits as digits of base four."""
    out = 1
    for bit in bin(steps)[2:]:
        out = _reduced(int(bin(out)[2:], 4))
        if bit == "1":
            out = _reduced(out << 1)
    return out


def jumped(seed: int, steps: int) -> np.random.MT19937:
    """The generator of ``random.Random(seed)`` after ``steps`` outputs."""
    key = np.array(random.Random(seed).getstate()[1][:WORDS], np.uint32)
    if steps:
        terms = power(steps)
        at = np.flatnonzero(np.unpackbits(np.frombuffer(terms.to_bytes(DEGREE // 8 + 1, "little"), np.uint8), bitorder="little"))
        x = _words(key, DEGREE + WORDS)
        key = np.array([np.bitwise_xor.reduce(x[at + k]) for k in range(WORDS)], np.uint32)
    out = np.random.MT19937()
    out.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": WORDS}}
    return out


def _draws(seed: int, start: int, count: int, units: int) -> np.ndarray:
    """The draws below ``units`` among ``count`` outputs from ``start`` on."""
    raw = jumped(seed, start).random_raw(count).astype(np.uint64) >> np.uint64(32 - units.bit_length())
    return raw[raw < units].astype(np.int64)


def index_table(spark: SparkSession, units: int, seed: int, replicates: int, *, stretch: int = STRETCH) -> DataFrame:
    """(replicate, draw, unit): ``replicates`` x ``units`` draws, those of ``randrange(units)`` in their order.

    The driver learns how many draws each stretch of outputs holds, one number for ``stretch`` outputs.
    """
    if units < 2:
        raise ValueError("fewer_than_two_blocks")
    if units >= 1 << 32:
        raise ValueError("too_many_blocks")
    ship(spark)
    wanted = replicates * units
    share = units / (1 << units.bit_length())
    counts: list[int] = []
    while sum(counts) < wanted:
        left = wanted - sum(counts)
        more = max(1, math.ceil((left + 6 * math.sqrt(left)) / share / stretch))
        first = len(counts)

        def count(batches, first=first):
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(_draws(seed, k * stretch, stretch, units))])], ["k", "n"])

        rows = spark.range(first, first + more, numPartitions=more).mapInArrow(count, "k long, n long").collect()
        counts += [r["n"] for r in sorted(rows, key=lambda r: r["k"])]
    before = [sum(counts[:k]) for k in range(len(counts))] if len(counts) < 64 else np.concatenate([[0], np.cumsum(counts)[:-1]]).tolist()

    def make(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                unit = _draws(seed, k * stretch, stretch, units)
                at = before[k] + np.arange(len(unit))
                keep = at < wanted
                unit, at = unit[keep], at[keep]
                for a in range(0, len(unit), 10_000):
                    cols = (at[a : a + 10_000] // units, at[a : a + 10_000] % units, unit[a : a + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in cols], ["replicate", "draw", "unit"])

    return spark.range(0, len(counts), numPartitions=len(counts)).mapInArrow(make, "replicate int, draw int, unit int")


def common_denominators(values: DataFrame, keys: list[str], *, bits: int = BITS) -> DataFrame:
    """keys, common: the least common denominator of each group's rational values (num, den); null beyond ``bits``.

    Only distinct denominators come together, in parts that are merged: a least common multiple is one of such multiples.
    """
    ship(values.sparkSession)

    def merged(table: pa.Table) -> pa.Table:
        out = 1
        for d in table.column("den").to_pylist():
            out = None if d is None or int(d) <= 0 else math.lcm(out, int(d))
            if out is None or out.bit_length() > bits:
                out = None
                break
        value = pa.array([None if out is None else decimal.Decimal(out)], pa.decimal128(38, 0))
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "den": value})

    kinds = dict(values.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", den decimal(38,0)"
    each = values.select(*keys, F.col("den").cast("decimal(38,0)").alias("den")).distinct()
    parts = each.withColumn("_part", F.pmod(F.xxhash64("den"), F.lit(64))).groupBy(*keys, "_part").applyInArrow(merged, schema)
    return parts.groupBy(*keys).applyInArrow(merged, schema).withColumnRenamed("den", "common")


def exact_means(values: DataFrame, indices: DataFrame, keys: list[str], units: int, *, bits: int = BITS) -> DataFrame:
    """keys, replicate, num, den, status: the exact mean of each replicate of rational block values (unit, num, den).

    All values of a group are brought to one denominator, so that a mean is a sum of integers, merged on the map side.
    Before any sum its operands are weighed: where one could pass ``bits`` the group is unavailable as a whole, as it is
    where a unit has no value.
    """
    wide = "decimal(38,0)"
    common = common_denominators(values, keys, bits=bits)
    size = lambda c: F.ceil(F.log2(F.greatest(F.abs(c.cast("double")), F.lit(1.0))) + 1e-6)
    scaled = values.join(common, keys)
    fits = F.col("common").isNotNull() & (size(F.col("num")) + size(F.col("common").cast("double") / F.col("den").cast("double")) + math.ceil(math.log2(units + 1)) + 1 <= bits) & (size(F.col("common")) + math.ceil(math.log2(units + 1)) + 1 <= bits)
    judged = scaled.groupBy(*keys).agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("_fits"), F.count("num").alias("_units"), F.max("common").alias("common"))
    judged = judged.withColumn("_ok", F.col("_fits") & (F.col("_units") == units))
    fine = scaled.drop("common").join(judged.where("_ok").select(*keys, "common"), keys)
    fine = fine.withColumn("_scaled", (F.col("num").cast(wide) * F.expr(f"CAST(common DIV CAST(den AS {wide}) AS {wide})")).cast(wide))
    sums = fine.join(indices, "unit").groupBy(*keys, "replicate").agg(F.sum("_scaled").cast(wide).alias("num"), F.max("common").alias("_c"))
    out = sums.select(*keys, "replicate", "num", (F.col("_c") * units).cast(wide).alias("den"), F.lit(AVAILABLE).alias("status"))
    lost = judged.where("NOT _ok").select(*keys, F.lit(None).cast("int").alias("replicate"), F.lit(None).cast(wide).alias("num"), F.lit(None).cast(wide).alias("den"), F.lit(UNAVAILABLE).alias("status"))
    return out.unionByName(lost)


def exact_percentiles(means: DataFrame, keys: list[str], shares: list[tuple[int, int]], replicates: int) -> DataFrame:
    """keys, num, den, status of the linear percentile at each share (numerator, denominator), exactly, by rank.

    A percentile lies between two neighbours of the order, at a weight that is a fraction itself; only these are kept.
    One group's replicates are at most ``replicates`` rows, a constant of the method.
    """
    wide = "decimal(38,0)"
    w = Window.partitionBy(*keys).orderBy("num")
    rows = means.where(F.col("status") == AVAILABLE).withColumns({"_rank": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    out = None
    for top, bottom in shares:
        h = (replicates - 1) * top
        low, weight = h // bottom, h % bottom
        at = rows.where(F.col("_rank").isin(low, low + 1) & (F.col("_n") == replicates))
        part = F.when(F.col("_rank") == low, F.col("num") * (bottom - weight)).otherwise(F.col("num") * weight)
        each = at.groupBy(*keys).agg(F.sum(part.cast(wide)).cast(wide).alias("num"), F.max((F.col("den") * bottom).cast(wide)).alias("den"))
        each = each.select(*keys, F.lit(f"{top}/{bottom}").alias("share"), "num", "den", F.lit(AVAILABLE).alias("status"))
        out = each if out is None else out.unionByName(each)
    lost = means.where(F.col("status") != AVAILABLE).select(*keys).distinct()
    for top, bottom in shares:
        out = out.unionByName(lost.select(*keys, F.lit(f"{top}/{bottom}").alias("share"), F.lit(None).cast(wide).alias("num"), F.lit(None).cast(wide).alias("den"), F.lit(UNAVAILABLE).alias("status")))
    return out
