"""Populations and distribution metrics over (cell, class, order) observations.

All of it is one aggregation by (cell, class) and one by cell, both with map-side sums; registered classes without
observations stay as zero rows. Exact quantities are integers (numerator and denominator); logarithms alone are floats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismet.functions.exact import passes_threshold
from prismet.functions.status import AVAILABLE, NOT_REQUESTED, UNAVAILABLE, UNDEFINED, ratio, reasons, result

ABS_TOLERANCE, REL_TOLERANCE = 1e-12, 1e-10


def class_counts(observations: DataFrame, cell: str = "cell", cls: str = "class") -> DataFrame:
    """Counts by cell and class [A1, without zero rows]. Null classes are not classified and do not count."""
    return observations.where(F.col(cls).isNotNull()).groupBy(cell, cls).agg(F.count(F.lit(1)).alias("n"))


def registered_counts(observations: DataFrame, cells: DataFrame, registry: DataFrame, cell: str = "cell", cls: str = "class") -> DataFrame:
    """Counts with a zero row for every registered class of every cell [A1]; the registry is a small fixed list."""
    grid = cells.select(cell).distinct().join(registry.select(cls).distinct(), F.lit(True))
    return grid.join(class_counts(observations, cell, cls), [cell, cls], "left").select(cell, cls, F.coalesce("n", F.lit(0)).alias("n"))


def checked_counts(counts: DataFrame, totals: DataFrame, cell: str = "cell") -> DataFrame:
    """Cells whose counts are negative or do not add up to their population [A8]."""
    sums = counts.groupBy(cell).agg(F.sum("n").alias("counted"), F.min("n").alias("least"))
    both = sums.join(totals.select(cell, F.col("n").alias("population")), cell, "full_outer")
    return both.select(cell, "counted", "population", reasons((F.col("least") < 0, "negative_count"), (~F.col("counted").eqNullSafe(F.col("population")), "count_conservation_failure")).alias("reasons")).where(F.size("reasons") > 0)


def distribution(counts: DataFrame, cell: str = "cell", threshold: str | None = None) -> DataFrame:
    """Support, concentration, entropy and effective supports of each cell [A2-A6], raw columns without statuses."""
    n = F.col("n").cast("double")
    total = counts.groupBy(cell).agg(
        F.sum("n").alias("population"),
        F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("support"),
        F.sum(F.col("n") * F.col("n")).alias("sum_sq"),
        F.sum(F.when(F.col("n") > 0, n * F.log(n)).otherwise(0.0)).alias("_nlogn"),
    )
    out = total.withColumn("sci_num", F.col("sum_sq")).withColumn("sci_den", F.col("population") * F.col("population"))
    p = F.col("population").cast("double")
    out = out.withColumn("entropy", F.when(F.col("population") > 0, F.greatest(F.lit(0.0), F.log(p) - F.col("_nlogn") / p)))
    out = out.withColumn("effective_entropy", F.exp("entropy")).withColumn("effective_sci", F.when(F.col("sum_sq") > 0, F.col("sci_den") / F.col("sum_sq")))
    out = out.drop("_nlogn", "sum_sq")
    if threshold is not None:
        out = out.join(thresholded(counts, threshold, cell), cell)
    return out


def thresholded(counts: DataFrame, threshold: str, cell: str = "cell") -> DataFrame:
    """Number of classes whose share reaches the threshold, exactly and inclusively [A3]."""
    w = Window.partitionBy(cell)
    each = counts.withColumn("_total", F.sum("n").over(w))
    return each.groupBy(cell).agg(F.sum(F.when(passes_threshold(F.col("n"), F.col("_total"), threshold), 1).otherwise(0)).alias("threshold_support"))


def bounded(value: Column, low: Column, high: Column) -> Column:
    """struct<value, correction, ok>: clamped to its theoretical range if within tolerance, the clamp recorded [A7]."""
    slack = lambda b: F.lit(ABS_TOLERANCE) + F.lit(REL_TOLERANCE) * F.abs(b)
    under, over = value < low, value > high
    ok = (value >= low - slack(low)) & (value <= high + slack(high))
    return F.struct(F.when(under, low).when(over, high).otherwise(value).alias("value"), F.when(ok & under, "clamped_to_lower_bound").when(ok & over, "clamped_to_upper_bound").alias("correction"), ok.alias("ok"))


def metric_results(dist: DataFrame, threshold: str | None = None) -> DataFrame:
    """Status-carrying results of ``distribution`` [A2-A7, A9]: an empty population has support 0, the rest undefined."""
    empty = F.col("population") == 0
    state = F.when(F.col("population").isNull(), UNAVAILABLE).when(empty, UNDEFINED).otherwise(AVAILABLE)
    note = F.when(empty, F.array(F.lit("empty_classified_population"))).otherwise(F.array().cast("array<string>"))
    s = F.col("support").cast("double")
    h, sci = bounded(F.col("entropy"), F.lit(0.0), F.log(F.greatest(s, F.lit(1.0)))), F.col("sci_num") / F.col("sci_den")
    agree = F.col("effective_sci") <= F.col("effective_entropy") * (1 + REL_TOLERANCE) + ABS_TOLERANCE
    eff = F.when(state != AVAILABLE, state).when(agree, AVAILABLE).otherwise(UNAVAILABLE)
    out = dist.withColumns({
        "r_support": result(F.when(F.col("population").isNull(), UNAVAILABLE).otherwise(AVAILABLE), s, F.col("support"), F.lit(1), None, note),
        "r_entropy": result(F.when((state == AVAILABLE) & ~h["ok"], UNAVAILABLE).otherwise(state), h["value"], None, None, None, F.array_compact(F.array(h["correction"]))),
        "r_sci": result(state, sci, F.col("sci_num"), F.col("sci_den")),
        "r_effective_entropy": result(eff, F.col("effective_entropy")),
        "r_effective_sci": result(eff, F.col("effective_sci"), F.col("sci_den"), F.col("sci_num")),
    })
    if threshold is None:
        return out.withColumn("r_threshold", result(F.lit(NOT_REQUESTED)))
    return out.withColumn("r_threshold", result(state, F.col("threshold_support"), F.col("threshold_support"), F.lit(1)))


def prefix_distinct(observations: DataFrame, ks: list[int], order: list[str], cell: str = "cell", cls: str = "class") -> DataFrame:
    """Distinct accepted classes among the first k of each cell [W1, W2, T2].

    The prefix is chosen over all rows; one without a class holds its place and is not replaced. Each class counts once,
    at its first place, so that one window pass serves every k; cells shorter than k are unavailable.
    """
    if any(k < 1 for k in ks) or list(ks) != sorted(set(ks)):
        raise ValueError("k grid must be positive and strictly increasing")
    w = Window.partitionBy(cell).orderBy(*order)
    ranked = observations.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= max(ks))
    firsts = ranked.groupBy(cell, cls).agg(F.min("_rank").alias("_first"), F.max("_rank").alias("_last"))
    wide = firsts.groupBy(cell).agg(F.max("_last").alias("_n"), *[F.sum(F.when(F.col(cls).isNotNull() & (F.col("_first") <= k), 1).otherwise(0)).alias(f"_k{k}") for k in ks])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col("_n") >= k, F.col(f"_k{k}")).alias("distinct_k"), F.when(F.col("_n") >= k, AVAILABLE).otherwise(UNAVAILABLE).alias("status")) for k in ks]))
    return wide.select(cell, each.alias("_e")).select(cell, "_e.k", "_e.distinct_k", "_e.status")


def accumulation(observations: DataFrame, order: list[str], cell: str = "cell", cls: str = "class") -> DataFrame:
    """Running number of distinct classes at every place [W2]: first occurrences summed over the order."""
    w = Window.partitionBy(cell).orderBy(*order)
    first = F.row_number().over(Window.partitionBy(cell, cls).orderBy(*order)) == 1
    marked = observations.withColumn("k", F.row_number().over(w)).withColumn("_new", F.when(first & F.col(cls).isNotNull(), 1).otherwise(0))
    return marked.withColumn("distinct_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def resolved_order(rows: DataFrame, cell: str = "cell", recorded: str = "sample_order", explicit: str | None = None) -> DataFrame:
    """Order of each row with its source, or why there is none [W4]: an explicit list wins, then recorded orders if complete."""
    w = Window.partitionBy(cell)
    place = F.array_position(F.col(explicit), F.col("sample_id")) if explicit else F.lit(0)
    listed = (place > 0) if explicit else F.lit(False)
    n, given, different = F.count(F.lit(1)).over(w), F.count(recorded).over(w), F.size(F.collect_set(recorded).over(w))
    all_listed = F.min(F.when(listed, 1).otherwise(0)).over(w) == 1
    state = F.when(all_listed, "explicit").when(given < n, "missing").when(different < given, "conflicting").otherwise("recorded")
    return rows.withColumn("order_state", state).withColumn("order_place", F.when(F.col("order_state") == "explicit", place).when(F.col("order_state") == "recorded", F.col(recorded)))


def contiguous(positions: DataFrame, group: list[str], place: str) -> DataFrame:
    """Whether the places of each group are 1..n without gap or repeat [W5]."""
    return positions.groupBy(*group).agg(F.count(place).alias("n"), F.min(place).alias("low"), F.max(place).alias("high"), F.count_distinct(place).alias("different")).withColumn("contiguous", (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("different") == F.col("n")))


def group_prefix_gate(positions: DataFrame, ks: list[int], groups: int = 4, size: int = 5, cell: str = "cell") -> DataFrame:
    """Whether the first k of the registered groups x size positions are complete and in order [W3, F9]."""
    intended = (F.col("call_order") - 1) * size + F.col("within_group_index")
    ok = positions.withColumn("_p", intended).groupBy(cell).agg(
        F.count_distinct("call_order").alias("_groups"),
        *[F.sum(F.when((F.col("_p") <= k) & (F.col("status") == "present"), 1).otherwise(0)).alias(f"_k{k}") for k in ks],
    )
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), ((F.col("_groups") == groups) & (F.col(f"_k{k}") == k)).alias("complete")) for k in ks]))
    return ok.select(cell, each.alias("_e")).select(cell, "_e.k", "_e.complete")


def coverage(rows: DataFrame, cell: str = "cell") -> DataFrame:
    """The five coverage ratios [A10] of selected rows with ``classified`` and ``validity`` (valid, invalid, other)."""
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    valid, invalid, classed = F.col("validity") == "valid", F.col("validity") == "invalid", F.col("classified")
    t = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("selected"), yes(classed).alias("classified"), yes(valid).alias("valid"), yes(valid | invalid).alias("decisive"), yes(classed & valid).alias("classified_valid"))
    return t.withColumns({
        "classification_coverage": ratio(F.col("classified"), F.col("selected")),
        "valid_fraction_selected": ratio(F.col("valid"), F.col("selected")),
        "decisive_validity_coverage": ratio(F.col("decisive"), F.col("selected")),
        "classified_valid_coverage": ratio(F.col("classified_valid"), F.col("valid")),
        "classified_valid_fraction": ratio(F.col("classified_valid"), F.col("classified")),
    })


def histogram(rows: DataFrame, keys: list[str], explode: str | None = None) -> DataFrame:
    """Counts by status columns [A11, A12]; ``explode`` counts each of several reasons of a row."""
    rows = rows.withColumn(explode, F.explode_outer(explode)) if explode else rows
    return rows.groupBy(*keys, *([explode] if explode else [])).agg(F.count(F.lit(1)).alias("n"))
