"""Values that carry their state: a number is never bare, and undefined, unavailable and zero stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AVAILABLE, UNDEFINED, UNAVAILABLE, NOT_REQUESTED, DEFERRED = "available", "undefined", "unavailable", "not_requested", "deferred"
RESULT = "struct<value:double,num:decimal(38,0),den:decimal(38,0),status:string,reasons:array<string>,qualifiers:array<string>>"


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Sorted distinct codes of the conditions that hold."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in pairs])))) if pairs else F.array().cast("array<string>")


def result(status: Column, value: Column | None = None, num: Column | None = None, den: Column | None = None, why: Column | None = None, notes: Column | None = None) -> Column:
    """A result struct; value, num and den are kept only where the status is available."""
    on = status == AVAILABLE
    none = F.array().cast("array<string>")
    keep = lambda c, kind: (F.when(on, c.cast(kind)) if c is not None else F.lit(None).cast(kind))
    return F.struct(keep(value, "double").alias("value"), keep(num, "decimal(38,0)").alias("num"), keep(den, "decimal(38,0)").alias("den"), status.alias("status"), F.coalesce(why if why is not None else none, none).alias("reasons"), F.coalesce(notes if notes is not None else none, none).alias("qualifiers"))


def ratio(num: Column, den: Column) -> Column:
    """num / den: unavailable if an operand is null, undefined if the denominator is zero."""
    missing, empty = num.isNull() | den.isNull(), den == 0
    status = F.when(missing, UNAVAILABLE).when(empty, UNDEFINED).otherwise(AVAILABLE)
    value = F.when(~missing & ~empty, num.cast("double") / den.cast("double"))
    return result(status, value, num, den, reasons((missing, "inventory_unavailable"), (~missing & empty, "empty_denominator")))


def difference(a: Column, b: Column, unit_a: Column | None = None, unit_b: Column | None = None) -> Column:
    """a - b of two result structs: undefined only if both are known and one is undefined, otherwise unavailable.

    With units, values of different or unknown units have no difference.
    """
    if unit_a is not None and unit_b is not None:
        same = F.coalesce(unit_a == unit_b, F.lit(False))
        plain = difference(a, b)
        why = F.array_sort(F.array_union(plain["reasons"], F.array(F.lit("unit_mismatch"))))
        return F.when(same, plain).otherwise(result(F.lit(UNAVAILABLE), why=why))
    ok = (a["status"] == AVAILABLE) & (b["status"] == AVAILABLE)
    known = a["status"].isin(AVAILABLE, UNDEFINED) & b["status"].isin(AVAILABLE, UNDEFINED)
    status = F.when(ok, AVAILABLE).when(known, UNDEFINED).otherwise(UNAVAILABLE)
    return result(status, a["value"] - b["value"], None, None, F.array_sort(F.array_union(a["reasons"], b["reasons"])))


def known(c: Column) -> Column:
    """The value of a knowledge struct if its state is known, else null; the struct itself keeps why."""
    return F.when(c["state"] == "known", c["value"])


def knowledge_problem(c: Column) -> Column:
    """Why a knowledge struct is not well formed, or null."""
    blank = F.coalesce(F.trim(c["reason"]), F.lit("")) == ""
    return (
        F.when(c["state"].isNull() | ~c["state"].isin("known", "unknown", "unavailable", "not_applicable"), "invalid_knowledge_state")
        .when((c["state"] == "known") & c["value"].isNull(), "known_value_missing")
        .when((c["state"] != "known") & c["value"].isNotNull(), "unexpected_knowledge_value")
        .when(c["state"].isin("unavailable", "not_applicable") & blank, "knowledge_reason_missing")
    )


def is_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,255}$"), F.lit(False))


def is_hash(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9a-f]{64}$"), F.lit(False))


def is_relative_path(c: Column) -> Column:
    """No root, no parent step, no back slash, dollar or control character."""
    bad = c.rlike(r"^/|\\|\$|[\x00-\x1f\x7f]|(^|/)\.\.?(/|$)|//|/$") | (c == "")
    return F.coalesce(~bad, F.lit(False))


def zoned_timestamp(c: Column) -> Column:
    """ISO-8601 with an offset; null without one."""
    return F.when(c.rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(c))
