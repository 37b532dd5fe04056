"""Support assays over registered classes and interventions, and recovery between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismet.functions.exact import binomial_threshold


def trial_outcomes(trials: DataFrame) -> DataFrame:
    """Outcome of each trial for its target class [F12]: success, failure, or unresolved (unknown class)."""
    none = F.col("completion").isin("refused", "no_output") & F.coalesce(F.col("scoped_declaration"), F.lit(False))
    hit = F.col("observed_class") == F.col("class")
    return trials.withColumn("outcome", F.when(none, "failure").when(F.col("observed_class").isNull(), "unresolved").when(hit, "success").otherwise("failure"))


def rollup(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Trials, certain successes (low) and possible ones (high: unresolved too) of each assay cell [A25]."""
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"), yes(F.col("outcome") == "success").alias("low"), yes(F.col("outcome").isin("success", "unresolved")).alias("high"))


def decisions(cells: DataFrame, tau: str, alpha: str, looks: int) -> DataFrame:
    """Exact tails and status of each assay cell [A24]. ``looks`` counts all registered cells and is never reduced."""
    d = binomial_threshold(F.col("trials"), F.col("low"), F.col("high"), F.lit(tau), F.lit(alpha), F.lit(looks))
    return cells.withColumn("_d", d).select(*cells.columns, "_d.status", "_d.delta", "_d.upper_tail", "_d.lower_tail")


def class_status(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Any present: present; all below: below; all unavailable: unavailable; else unresolved [A26]."""
    s = F.col("status")
    out = cells.groupBy(*keys).agg(F.bool_or(s == "threshold_present").alias("_p"), F.bool_and(s == "threshold_below").alias("_b"), F.bool_and(s == "unavailable").alias("_u"))
    return out.select(*keys, F.when(F.col("_p"), "threshold_present").when(F.col("_b"), "threshold_below").when(F.col("_u"), "unavailable").otherwise("unresolved").alias("status"))


def size_bounds(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds of the supported set: those present, and all that are not below."""
    return classes.groupBy(*keys).agg(F.count(F.lit(1)).alias("registered"), F.sum(F.when(F.col("status") == "threshold_present", 1).otherwise(0)).alias("at_least"), F.sum(F.when(F.col("status") != "threshold_below", 1).otherwise(0)).alias("at_most"))


def registration(registered: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Trials that are only registered or only listed [U5]; empty if the sets agree."""
    a, b = registered.select(key).distinct().withColumn("_r", F.lit(1)), listed.select(key).distinct().withColumn("_l", F.lit(1))
    return a.join(b, key, "full_outer").where(F.col("_r").isNull() | F.col("_l").isNull()).select(key, F.when(F.col("_r").isNull(), "unregistered_trial").otherwise("registered_trial_missing").alias("problem"))


def recovery(pre: DataFrame, post: DataFrame, keys: list[str], cls: str = "class") -> DataFrame:
    """Recovered share of the classes missing before [U4, A27].

    Needs every class before to be present or below; none missing is undefined; unresolved classes after make the rate
    unavailable, with bounds from counting them as lost or recovered.
    """
    both = pre.select(*keys, cls, F.col("status").alias("before")).join(post.select(*keys, cls, F.col("status").alias("after")), [*keys, cls], "left")
    gone, back = F.col("before") == "threshold_below", F.col("after") == "threshold_present"
    lost = F.col("after") == "threshold_below"
    t = both.groupBy(*keys).agg(
        F.bool_and(F.col("before").isin("threshold_present", "threshold_below")).alias("_known"),
        F.sum(F.when(gone, 1).otherwise(0)).alias("missing"),
        F.sum(F.when(gone & back, 1).otherwise(0)).alias("recovered"),
        F.sum(F.when(gone & ~F.coalesce(back | lost, F.lit(False)), 1).otherwise(0)).alias("open"),
    )
    status = F.when(~F.col("_known"), "unavailable").when(F.col("missing") == 0, "undefined").when(F.col("open") > 0, "unavailable").otherwise("available")
    ok = F.col("_known") & (F.col("missing") > 0)
    return t.select(*keys, "missing", "recovered", F.when(status == "available", F.col("recovered") / F.col("missing")).alias("rate"), F.when(ok, F.col("recovered") / F.col("missing")).alias("low"), F.when(ok, (F.col("recovered") + F.col("open")) / F.col("missing")).alias("high"), status.alias("status"))


def observed_union(trials: DataFrame, key: str, cls: str = "class") -> DataFrame:
    """Classes seen in a success of any intervention of a family, each once, and how many [U3].

    ``trials`` has key, class, outcome and reasons (array); a trial that a gate restricts does not count. A family whose
    trials show nothing has an empty list and size 0: a finite union of what was observed, not an estimate of support.
    """
    counts = (F.col("outcome") == "success") & (F.size(F.coalesce("reasons", F.array().cast("array<string>"))) == 0)
    return trials.groupBy(key).agg(F.array_sort(F.collect_set(F.when(counts, F.col(cls)))).alias("classes")).withColumn("size", F.size("classes"))
