"""Exact arithmetic: integers in DECIMAL(38,0) first, Python fractions in Arrow UDFs beyond them."""

from __future__ import annotations

import re
from decimal import Decimal, localcontext
from fractions import Fraction
from math import gcd, isfinite

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"(0|[1-9][0-9]*)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]{1,4}))?")


def threshold_token(token: str) -> tuple[int, int] | None:
    """(coefficient, power): the decimal is coefficient / 10**power, in (0, 1]; None if the token is not one."""
    m = _TOKEN.fullmatch(token) if isinstance(token, str) and len(token) <= 1024 else None
    if not m:
        return None
    digits, power = m[1] + (m[2] or ""), len(m[2] or "") - int(m[3] or 0)
    coefficient = int(digits) * 10 ** max(0, -power)
    power = max(0, power)
    return (coefficient, power) if 0 < coefficient <= 10**power else None


def passes_threshold(count: Column, total: Column, token: str) -> Column:
    """count / total >= token, exactly and inclusively; a zero count never passes."""
    parsed = threshold_token(token)
    if parsed is None:
        return F.lit(None).cast("boolean")
    coefficient, power = parsed
    if power > 18:
        return (count > 0) & big_at_least(count, total, F.lit(str(coefficient)), F.lit(power))
    wide = lambda c: c.cast("decimal(19,0)")
    return (count > 0) & (wide(count) * wide(F.lit(10**power)) >= wide(total) * wide(F.lit(coefficient)))


@F.pandas_udf(T.BooleanType())
def big_at_least(count: pd.Series, total: pd.Series, coefficient: pd.Series, power: pd.Series) -> pd.Series:
    return pd.Series([int(c) * 10 ** int(p) >= int(k) * int(t) for c, t, k, p in zip(count, total, coefficient, power, strict=True)])


def gate(num: Column, den: Column, threshold: tuple[int, int], *, maximum: bool = False, empty: str = "unresolved") -> Column:
    """passed / failed of num/den against a ratio by cross-multiplication; unresolved if unknown, ``empty`` for den = 0."""
    a, b = num.cast("decimal(19,0)") * F.lit(threshold[1]).cast("decimal(19,0)"), den.cast("decimal(19,0)") * F.lit(threshold[0]).cast("decimal(19,0)")
    ok = (a <= b) if maximum else (a >= b)
    return F.when(num.isNull() | den.isNull(), "unresolved").when(den == 0, empty).when(ok, "passed").otherwise("failed")


def text(f: Fraction) -> str:
    return f"{f.numerator}/{f.denominator}"


def fraction(s: str) -> Fraction:
    return Fraction(s)


def reduced(num: int, den: int) -> tuple[int, int]:
    g = gcd(num, den) or 1
    return num // g, den // g


#: Most summands and most bits of a term that an exact tail may cost; beyond them it is unavailable.
MAX_SUMMANDS, MAX_BITS = 2_000_000, 262_144


def tails(n: int, low: int, high: int, tau: Fraction) -> tuple[Fraction, Fraction] | None:
    """P(X >= low) and P(X <= high) of a binomial with n trials and chance tau, exactly; None beyond the work limits.

    Each term follows from the one before it. Of each tail the shorter side is summed, the other is its complement.
    """
    p, q = tau.numerator, tau.denominator - tau.numerator
    if n * tau.denominator.bit_length() > MAX_BITS or n > MAX_SUMMANDS:
        return None
    whole = tau.denominator**n
    if q == 0:
        return Fraction(int(low <= n)), Fraction(int(high >= n))

    def below(k: int) -> int:
        """Weight of all outcomes under k, for 0 <= k <= n + 1."""
        if 2 * k > n + 1:
            return whole - _weights(n, n - k + 1, q, p)
        return _weights(n, k, p, q)

    return Fraction(whole - below(min(max(low, 0), n + 1)), whole), Fraction(below(min(max(high + 1, 0), n + 1)), whole)


def _weights(n: int, count: int, p: int, q: int) -> int:
    """Sum of the first ``count`` terms C(n, k) p^k q^(n - k)."""
    term, total = q**n, 0
    for k in range(count):
        total += term
        term = term * (n - k) * p // ((k + 1) * q)
    return total


def threshold_decision(n: int, low: int, high: int, tau: Fraction, alpha: Fraction, looks: int) -> tuple[str, Fraction, Fraction, Fraction]:
    """(status, delta, upper, lower) of one assay cell: delta = alpha / 2J; present at equality, below only if strictly smaller."""
    delta = alpha / (2 * looks)
    if n < 1:
        return "unavailable", delta, Fraction(1), Fraction(1)
    both = tails(n, low, high, tau)
    if both is None:
        return "unavailable", delta, None, None
    upper, lower = both
    return ("threshold_present" if upper <= delta else "threshold_below" if lower < delta else "unresolved"), delta, upper, lower


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("status", "delta", "upper_tail", "lower_tail")]))
def binomial_threshold(n: pd.Series, low: pd.Series, high: pd.Series, tau: pd.Series, alpha: pd.Series, looks: pd.Series) -> pd.DataFrame:
    # Many rows share their numbers: each decision is made once.
    asked = list(zip(n, low, high, tau, alpha, looks, strict=True))
    made = {k: threshold_decision(int(k[0]), int(k[1]), int(k[2]), Fraction(k[3]), Fraction(k[4]), int(k[5])) for k in set(asked)}
    rows = [made[k] for k in asked]
    return pd.DataFrame([(s, text(d), *[None if x is None else text(x) for x in (u, v)]) for s, d, u, v in rows], columns=["status", "delta", "upper_tail", "lower_tail"])


def percentile(values: list[Fraction], q: Fraction) -> Fraction:
    """Linear interpolation at (B - 1) q."""
    ordered = sorted(values)
    h = (len(ordered) - 1) * q
    low = h.numerator // h.denominator
    return ordered[low] if h == low else ordered[low] + (h - low) * (ordered[low + 1] - ordered[low])


def _at_most(n: int, t: int, target: Fraction) -> bool:
    """(1 - 1/n)^t <= target, certified: logarithms with more digits until the two sides stand clear of each other."""
    for digits in (30, 60, 120, 240):
        with localcontext() as c:
            c.prec = digits + len(str(t)) + len(str(n))
            left = t * (Decimal(n - 1).ln() - Decimal(n).ln())
            right = Decimal(target.numerator).ln() - Decimal(target.denominator).ln()
            if abs(left - right) > Decimal(10) ** -(digits - 4):
                return left < right
    return (n - 1) ** t * target.denominator <= target.numerator * n**t


def first_crossing(ns: list[int] | int, target: Fraction = Fraction(1, 2)) -> int | None:
    """First step at which the product of (1 - 1/n) is not above the target.

    For a constant n the logarithms name the step to within a few, and certified comparisons settle which it is, so the
    work does not grow with n.
    """
    if isinstance(ns, int):
        if ns == 1:
            return 1
        with localcontext() as c:
            c.prec = 40 + 2 * len(str(ns))
            step = int((Decimal(target.numerator).ln() - Decimal(target.denominator).ln()) / (Decimal(ns - 1).ln() - Decimal(ns).ln()))
        step = max(1, step - 1)
        while not _at_most(ns, step, target):
            step += 1
        while step > 1 and _at_most(ns, step - 1, target):
            step -= 1
        return step
    kept = Fraction(1)
    for k, n in enumerate(ns, 1):
        kept *= 1 - Fraction(1, n)
        if kept <= target:
            return k
    return None


@F.pandas_udf(T.LongType())
def half_crossing_steps(n: pd.Series) -> pd.Series:
    return pd.Series([first_crossing(int(x)) for x in n], dtype="Int64")


def half_life(dt: Column, start: Column, end: Column) -> Column:
    """dt ln 2 / ln(start / end) of a decline; null for no decline or an end at zero. Near one, log1p of the difference."""
    r = start / end
    return F.when((start > 0) & (end > 0) & (end < start), dt * F.log(F.lit(2.0)) / F.when(r < 2, F.log1p((start - end) / end)).otherwise(F.log(r)))


def half_life_status(start: Column, end: Column) -> Column:
    return (
        F.when(start.isNull() | end.isNull(), "unavailable").when(start == 0, "undefined_zero_start").when(end == 0, "undefined_zero_end").when(end == start, "undefined_no_decay").when(end > start, "undefined_growth").otherwise("available")
    )


def exact_operand(value: float | None, ratio: tuple[int, int] | None, bits: int = 131_072) -> tuple[Fraction | None, str | None]:
    """The exact value of a stored number, or why it has none [V28].

    A stored ratio counts if it renders to the stored number, so that a sign never hangs on rounding; without a ratio the
    number is what its binary form says. Numerators and denominators beyond ``bits`` are refused, not rounded.
    """
    if value is None:
        return None, "uncertainty_operand_unavailable"
    if isinstance(value, float) and not isfinite(value):
        return None, "nonfinite_uncertainty_operand"
    exact = Fraction(value)
    if ratio is not None:
        num, den = ratio
        if num is None or den is None or den <= 0:
            return None, "invalid_exact_uncertainty_ratio"
        exact = Fraction(num, den)
        if max(abs(exact.numerator).bit_length(), exact.denominator.bit_length()) <= bits:
            try:
                shown = float(exact)
            except OverflowError:
                return None, "uncertainty_numeric_overflow"
            if shown != value or (exact != 0) != (shown != 0):
                return None, "numerical_sign_or_representation_instability"
    if max(abs(exact.numerator).bit_length(), exact.denominator.bit_length()) > bits:
        return None, "uncertainty_exact_limit_exceeded"
    return exact, None
