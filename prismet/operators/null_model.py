"""Categorical null model: omission, expected diversity, crossings, mixtures, and consistency of count paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismet.functions.exact import half_crossing_steps

#: Assumptions that must be declared true for expectations to exist, the last only with a schedule (fixed values).
ASSUMPTIONS = ["finite_multinomial", "fixed_classes", "closed", "empirical_reconstruction", "exogenous_schedule"]


def omission(p, n):
    """Chance that a class of share p is not drawn in n [X10]."""
    return F.pow(1 - p, n)


def forecast(scenarios: DataFrame, steps: int, key: str = "scenario") -> DataFrame:
    """Expected diversity D0 (1 - 1/n)^t for t = 0..steps of scenarios with d0 and n [X9, X10]."""
    t = scenarios.select(key, "d0", "n", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("t"))
    return t.select(key, "t", (F.col("d0") * F.pow(1 - 1 / F.col("n"), F.col("t"))).alias("expected"))


def null_half_life(scenarios: DataFrame, key: str = "scenario") -> DataFrame:
    """Continuous half-life ln 2 / -ln(1 - 1/n), undefined for n = 1, and the first whole step at or below one half, exactly [X9]."""
    shl = F.when(F.col("n") > 1, F.log(F.lit(2.0)) / -F.log1p(-1 / F.col("n")))
    return scenarios.select(key, "n", shl.alias("half_life"), half_crossing_steps(F.col("n")).alias("first_crossing"))


def schedule_multiplier(steps: DataFrame, key: str, order: str, n: str = "n") -> DataFrame:
    """Running product of 1 - 1/n over a schedule and whether it has fallen to one half [W9]; n = 1 leaves nothing."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.max(F.when(F.col(n) == 1, 1).otherwise(0)).over(w) == 1
    product = F.when(zero, 0.0).otherwise(F.exp(F.sum(F.when(F.col(n) > 1, F.log1p(-1 / F.col(n))).otherwise(0.0)).over(w)))
    return steps.withColumn("multiplier", product).withColumn("crossed", F.col("multiplier") <= 0.5)


def mixture(classes: DataFrame, key: str, weight: float) -> DataFrame:
    """u = (1 - weight) p + weight e, then w u / sum(w u) within a scenario [A23]; null where nothing is left."""
    mixed = classes.withColumn("mixed", (1 - weight) * F.col("p") + weight * F.col("e"))
    total = F.sum(F.col("w") * F.col("mixed")).over(Window.partitionBy(key))
    return mixed.withColumn("selected", F.when(total > 0, F.col("w") * F.col("mixed") / total))


def path_consistency(paths: DataFrame, key: str, order: str, cls: str = "class", n: str = "n") -> DataFrame:
    """Classes that reappear from a parent count of zero, and whether an earlier step already broke the path [W11]."""
    w = Window.partitionBy(key, cls).orderBy(order)
    rows = paths.withColumn("_parent", F.lag(n).over(w)).withColumn("_bad", (F.col(n) > 0) & (F.col("_parent") == 0))
    steps = rows.groupBy(key, order).agg(F.bool_or(F.coalesce("_bad", F.lit(False))).alias("inconsistent"), F.array_sort(F.collect_set(F.when(F.col("_bad"), F.col(cls)))).alias("classes"))
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("evaluated", ~F.coalesce(F.bool_or("inconsistent").over(before), F.lit(False)))
