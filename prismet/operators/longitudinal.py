"""States over time: set changes, recurrence, curves, crossings, fits and clocks, as windows over (unit, state order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismet.functions.exact import half_life, half_life_status
from prismet.functions.status import AVAILABLE, UNAVAILABLE, UNDEFINED


def support_sets(counts: DataFrame, keys: list[str], cls: str = "class", minimum_share: float | None = None) -> DataFrame:
    """The observed set of each state [U2]: classes that occur, or whose share reaches a minimum."""
    rows = counts.where("n > 0")
    if minimum_share is not None:
        rows = rows.withColumn("_t", F.sum("n").over(Window.partitionBy(*keys))).where(F.col("n") >= F.col("_t") * minimum_share)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(cls)).alias("classes"))


def set_change(a, b):
    """Struct of two sets: retained, became_unobserved, newly_observed, retention, loss, size change [U1]; undefined for an empty first set."""
    kept, gone, new = F.array_intersect(a, b), F.array_except(a, b), F.array_except(b, a)
    n = F.size(a)
    return F.struct(
        F.array_sort(kept).alias("retained"), F.array_sort(gone).alias("became_unobserved"), F.array_sort(new).alias("newly_observed"),
        F.when(n > 0, F.size(kept) / n).alias("retention"), F.when(n > 0, F.size(gone) / n).alias("loss"), (F.size(b) - n).alias("size_change"),
        F.when(n > 0, AVAILABLE).otherwise(UNDEFINED).alias("status"),
    )


def consecutive_changes(sets: DataFrame, unit: str, order: str) -> DataFrame:
    """Set changes between adjacent states of each unit [W6, J10]."""
    w = Window.partitionBy(unit).orderBy(order)
    pairs = sets.withColumns({"_before": F.lag("classes").over(w), "from_state": F.lag(order).over(w)}).where(F.col("_before").isNotNull())
    return pairs.select(unit, "from_state", F.col(order).alias("to_state"), set_change(F.col("_before"), F.col("classes")).alias("c")).select(unit, "from_state", "to_state", "c.*")


def schedule(states: DataFrame, panels: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """Every state of a trajectory with every panel, and what was measured there [J9]. Panels are a small declared list."""
    grid = states.join(panels, F.lit(True))
    return grid.join(measured, keys, "left").withColumn("slot", F.when(F.col("value").isNotNull(), "observed").otherwise(F.coalesce("planned_status", F.lit("missing"))) if "planned_status" in grid.columns else F.when(F.col("value").isNotNull(), "observed").otherwise("missing"))


def recurrence(slots: DataFrame, unit: list[str], order: str, seen: str = "observed", identity: str | None = None) -> DataFrame:
    """State machine per unit [W7] of slots whose ``seen`` is true, false or null (unavailable: a gap, never an absence).

    A change of identity starts a new history. A sighting is first_observed, observed, observed_reappearance (recorded
    absent since the last sighting) or observed_after_gap (only gaps since).
    """
    keys = list(unit)
    rows = slots
    if identity:
        w = Window.partitionBy(*unit).orderBy(order)
        rows = rows.withColumn("_change", F.when(F.col(identity).eqNullSafe(F.lag(identity).over(w)), 0).otherwise(1)).withColumn("_history", F.sum("_change").over(w)).drop("_change")
        keys.append("_history")
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last_seen = F.max(F.when(F.col(seen), F.col(order))).over(before)
    last_absent = F.max(F.when(~F.col(seen), F.col(order))).over(before)
    last_gap = F.max(F.when(F.col(seen).isNull(), F.col(order))).over(before)
    state = (
        F.when(F.col(seen).isNull(), "gap").when(~F.col(seen), "absent").when(last_seen.isNull(), "first_observed")
        .when(last_absent > last_seen, "observed_reappearance").when(last_gap > last_seen, "observed_after_gap").otherwise("observed")
    )
    return rows.withColumn("recurrence", state).drop("_history")


def gini(sum_sq, total):
    """1 - sum of squared shares [A18], null for an empty population."""
    return F.when(total > 0, 1.0 - sum_sq / (total * total))


def fixed_mean(rows: DataFrame, keys: list[str], value: str, expected: int) -> DataFrame:
    """Mean over a declared number of units; unavailable unless every one has a value [A19, A20]."""
    out = rows.groupBy(*keys).agg(F.count(value).alias("units"), F.avg(value).alias("_m"))
    ok = F.col("units") == expected
    return out.select(*keys, "units", F.when(ok, F.col("_m")).alias("mean"), F.when(ok, AVAILABLE).otherwise(UNAVAILABLE).alias("status"))


def root_curve(curves: DataFrame, roots: int, root: str = "root", order: str = "state") -> DataFrame:
    """Mean of lineage roots by state; unavailable as a whole unless all roots share one grid of states [A20]."""
    grids = curves.groupBy(root).agg(F.array_sort(F.collect_set(order)).alias("_g")).agg((F.count_distinct("_g") <= 1).alias("_same"))  # one row
    out = fixed_mean(curves, [order], "mean", roots).crossJoin(F.broadcast(grids))
    return out.select(order, "units", F.when(F.col("_same"), F.col("mean")).alias("mean"), F.when(F.col("_same"), F.col("status")).otherwise(UNAVAILABLE).alias("status"))


def first_crossing(curve: DataFrame, unit: str, order: str, value: str, share: float = 0.5) -> DataFrame:
    """First state at or below a share of the start, the last measured state above it, and the missing states between [W8]. No interpolation."""
    w = Window.partitionBy(unit).orderBy(order)
    rows = curve.withColumn("_start", F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("_below", F.col(value) <= F.col("_start") * share)
    hit = rows.groupBy(unit).agg(F.first("_start").alias("start_value"), F.min(F.when(F.col("_below"), F.col(order))).alias("crossing"))
    both = rows.join(hit.select(unit, "crossing"), unit)
    bracket = both.groupBy(unit).agg(F.max(F.when((F.col(order) < F.col("crossing")) & F.col(value).isNotNull(), F.col(order))).alias("last_above"))
    gaps = both.join(bracket, unit).groupBy(unit).agg(F.sum(F.when((F.col(order) > F.col("last_above")) & (F.col(order) < F.col("crossing")) & F.col(value).isNull(), 1).otherwise(0)).alias("gaps"))
    return hit.join(bracket, unit).join(gaps, unit)


def anchored_fit(curve: DataFrame, unit: str, time: str, value: str, *, minimum: int = 4, criterion: float | None = None) -> DataFrame:
    """Slope through the first state of ln(value / first) on elapsed time, its half-life and largest residual [A22].

    Undefined unless the slope is negative; unavailable with fewer than ``minimum`` states, a value that is not positive,
    or a residual above the criterion.
    """
    w = Window.partitionBy(unit).orderBy(time)
    rows = curve.withColumns({"_t": F.col(time) - F.first(time).over(w), "_d0": F.first(value).over(w)})
    rows = rows.withColumn("_y", F.when((F.col(value) > 0) & (F.col("_d0") > 0), F.log(F.col(value) / F.col("_d0"))))
    t = F.col("_t").cast("double")
    fit = rows.groupBy(unit).agg(F.count("_y").alias("states"), F.count(F.lit(1)).alias("rows"), F.sum(t * F.col("_y")).alias("_ty"), F.sum(t * t).alias("_tt"))
    fit = fit.withColumn("beta", F.when(F.col("_tt") > 0, F.col("_ty") / F.col("_tt")))
    res = rows.join(fit.select(unit, "beta"), unit).groupBy(unit).agg(F.max(F.abs(F.col("_y") - F.col("beta") * t)).alias("max_residual"))
    out = fit.join(res, unit)
    bad = (F.col("states") < minimum) | (F.col("states") < F.col("rows"))
    if criterion is not None:
        bad = bad | (F.col("max_residual") > criterion)
    status = F.when(bad, UNAVAILABLE).when(F.col("beta") >= 0, UNDEFINED).otherwise(AVAILABLE)
    return out.select(unit, "states", "beta", "max_residual", F.when(status == AVAILABLE, -F.log(F.lit(2.0)) / F.col("beta")).alias("half_life"), status.alias("status"))


def interval_half_life(pairs: DataFrame, dt: str, start: str, end: str) -> DataFrame:
    """Half-life of each interval with its status [X8]."""
    return pairs.withColumns({"half_life": half_life(F.col(dt), F.col(start), F.col(end)), "half_life_status": half_life_status(F.col(start), F.col(end))})


def clock(path: DataFrame, unit: str, order: str, distance: str) -> DataFrame:
    """Elapsed rounds at each place of a path; null after an unknown distance [W10, G6]."""
    w = Window.partitionBy(unit).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce(F.col(distance), F.lit(0))).over(w)
    unknown = F.sum(F.when(F.col(distance).isNull(), 1).otherwise(0)).over(w)
    return path.withColumn("elapsed", F.when(unknown == 0, total))


def stage_links(stages: DataFrame, parents: DataFrame) -> DataFrame:
    """Child stages with their unique measured parent of the same view [J11]; several candidates are unresolved."""
    links = parents.select("child", F.explode("parent_refs").alias("parent"))
    a = stages.select(F.col("state").alias("child"), "view", F.col("value").alias("child_value"))
    b = stages.select(F.col("state").alias("parent"), "view", F.col("value").alias("parent_value"))
    both = a.join(links, "child").join(b, ["parent", "view"])
    n = F.count(F.lit(1)).over(Window.partitionBy("child", "view"))
    return both.withColumn("status", F.when(n == 1, "resolved").otherwise("unresolved_several_parents"))


def class_accounting(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All, valid, invalid and unresolved of each class [A21]."""
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    v = F.col("validity")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("all"), yes(v == "valid").alias("valid"), yes(v == "invalid").alias("invalid"), yes(v.isNull() | ~v.isin("valid", "invalid")).alias("unresolved"))
