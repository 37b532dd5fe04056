"""Paired conditions: contrasts by block, means over all intended blocks, gates, verdicts, and replayable resampling."""

from __future__ import annotations

import hashlib
import json
import random
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.functions.exact import gate, percentile
from prismet.functions.status import AVAILABLE, UNAVAILABLE, difference, reasons
from prismet.operators import resampling

PAIRED_SEED, TRAJECTORY_SEED, REPLICATES = 20260917, 20260919, 2000
#: Gate thresholds (fixed values): ratio, numerator, denominator.
GATES = {"classification_coverage": (9, 10), "decisive_validity_coverage": (19, 20), "classified_valid_coverage": (9, 10), "validity_floor": (4, 5), "text_coverage": (19, 20)}


def contrasts(cells: DataFrame, block: str, condition: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """value(first) - value(second) of each block and pair of conditions [J7, A15]. One aggregation instead of self joins."""
    names = sorted({c for p in pairs for c in p})
    wide = cells.groupBy(block).agg(*[F.max(F.when(F.col(condition) == c, F.col(value))).alias(f"_{k}") for k, c in enumerate(names)])
    col = {c: F.col(f"_{k}") for k, c in enumerate(names)}
    rows = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("contrast"), (col[a] - col[b]).alias("difference")) for a, b in pairs]))
    return wide.select(block, rows.alias("_c")).select(block, "_c.contrast", "_c.difference")


def status_contrasts(cells: DataFrame, block: str, condition: str, value: str, a: str, b: str) -> DataFrame:
    """Contrast of result structs, which keeps undefined apart from unavailable [X11]."""
    left = cells.where(F.col(condition) == a).select(block, F.col(value).alias("_a"))
    right = cells.where(F.col(condition) == b).select(block, F.col(value).alias("_b"))
    return left.join(right, block).select(block, difference(F.col("_a"), F.col("_b")).alias("difference"))


def frequency_deltas(counts: DataFrame, block: str, condition: str, cls: str, a: str, b: str) -> DataFrame:
    """Difference of class shares between two conditions of a block, absent classes as zero [A15]."""
    total = counts.groupBy(block, condition).agg(F.sum("n").alias("_t"))
    share = counts.join(total, [block, condition]).withColumn("_s", F.col("n") / F.col("_t"))
    return share.groupBy(block, cls).agg((F.sum(F.when(F.col(condition) == a, F.col("_s")).otherwise(0.0)) - F.sum(F.when(F.col(condition) == b, F.col("_s")).otherwise(0.0))).alias("delta"))


def block_means(differences: DataFrame, keys: list[str], value: str, intended: int) -> DataFrame:
    """Equal-block means; the full target exists only with every intended block, a subset mean is a column of its own [A14]."""
    out = differences.groupBy(*keys).agg(F.count(value).alias("blocks"), F.avg(value).alias("_m"))
    full = F.col("blocks") == intended
    return out.select(*keys, "blocks", F.when(full, F.col("_m")).alias("mean"), F.when(~full, F.col("_m")).alias("subset_mean"), F.when(full, AVAILABLE).otherwise(UNAVAILABLE).alias("status"))


def cell_gates(coverage: DataFrame, cell: str = "cell") -> DataFrame:
    """One row for each gate of a cell [F5, F7]; an empty valid population makes its coverage gate not applicable."""
    need = {
        "classification_coverage": ("classified", "selected", "unresolved"),
        "decisive_validity_coverage": ("decisive", "selected", "unresolved"),
        "classified_valid_coverage": ("classified_valid", "valid", "conditional_not_applicable"),
        "validity_floor": ("valid", "selected", "unresolved"),
    }
    rows = [F.struct(F.lit(g).alias("gate"), gate(F.col(n), F.col(d), GATES[g], empty=e).alias("status")) for g, (n, d, e) in need.items()]
    return coverage.select(cell, F.explode(F.array(*rows)).alias("_g")).select(cell, "_g.gate", "_g.status")


def quality_band(valid_a: Column, n_a: Column, valid_b: Column, n_b: Column) -> Column:
    """Whether two validity shares differ by at most 1/10, exactly."""
    return gate(F.abs(valid_a * n_b - valid_b * n_a), n_a * n_b, (1, 10), maximum=True)


def all_passed(gates: DataFrame, keys: list[str]) -> DataFrame:
    """Roll-up of gate rows with the names of those that do not pass [F6, F8]."""
    ok = F.col("status").isin("passed", "conditional_not_applicable", "fixture_stipulated")
    return gates.groupBy(*keys).agg(F.bool_and(ok).alias("passed"), F.array_sort(F.collect_set(F.when(~ok, F.col("gate")))).alias("open_gates"))


#: Groups of evidence that a confirmatory comparison needs (fixed values).
EVIDENCE_GROUPS = ["registration", "exposure", "structural_validation", "core_audit", "integrity", "independence"]


def evidence_scope(comparisons: DataFrame, facts: DataFrame, corrected: DataFrame) -> DataFrame:
    """comparison, status, reasons: whether each comparison's own evidence covers its cells and frames [F8].

    comparisons: comparison, material_role, reanalysis, fixture_context, restricted (booleans), scopes (keys of its cells
    and frames); facts: comparison, group, record_type, status, mock, scopes, codes (what else the group's own checks
    found); corrected: (target, codes) of corrections of independence, schema, membership or validity. A fixture needs
    no evidence, but what it supplies must not contradict it; it is stipulated, never passed.
    """
    none = F.array().cast("array<string>")
    own = facts.join(comparisons.select("comparison", F.col("scopes").alias("_own")), "comparison").withColumn("_in", F.arrays_overlap("scopes", "_own"))
    fine = (F.col("status") == "record_consistent") & ~F.coalesce("mock", F.lit(False))
    per = own.groupBy("comparison", "group").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("status") == "record_consistent", 1).otherwise(0)).alias("_sound"), F.bool_or(F.coalesce("_in", F.lit(False))).alias("_scoped"), F.bool_or(F.col("_in") & ~fine).alias("_limited"),
        F.bool_or(F.col("_in") & (F.col("record_type") == "audit")).alias("_audit"), F.flatten(F.collect_set(F.when(F.col("_in"), F.coalesce("codes", none)))).alias("_codes"),
    )
    wanted = comparisons.select("comparison", F.explode(F.array(*map(F.lit, EVIDENCE_GROUPS))).alias("group")).join(per, ["comparison", "group"], "left")
    name = lambda code: F.concat("group", F.lit(code))
    lost = F.when(F.col("_n").isNull(), F.array(name("_not_supplied"))).when(~F.col("_scoped"), F.array(name("_scope_not_established"))).otherwise(F.array_compact(F.array(F.when(F.col("_limited"), name("_record_limited")))))
    audit = F.when((F.col("group") == "core_audit") & ~F.coalesce("_audit", F.lit(False)), F.array(F.lit("actual_sample_audit_not_supplied"))).otherwise(none)
    timely = F.when((F.col("group") == "registration") & ((F.coalesce("_n", F.lit(0)) < 3) | (F.col("_sound") < F.col("_n"))), F.array(F.lit("prospective_registration_unresolved"))).otherwise(none)
    gathered = wanted.withColumn("_why", F.concat(lost, audit, timely, F.coalesce("_codes", none)))
    registered = F.bool_or((F.col("group") == "registration") & F.col("_n").isNotNull() & ((F.col("_n") < 3) | (F.col("_sound") < F.col("_n"))))
    gathered = gathered.groupBy("comparison").agg(F.array_distinct(F.flatten(F.collect_list("_why"))).alias("_why"), registered.alias("_contradicted"))
    fixed = comparisons.select("comparison", F.explode("scopes").alias("target")).join(corrected.select("target"), "target", "left_semi").select("comparison").distinct().withColumn("_fixed", F.lit(True))
    rows = comparisons.join(gathered, "comparison").join(fixed, "comparison", "left").withColumn("_fixed", F.coalesce("_fixed", F.lit(False)))
    fixture = F.col("material_role") == "fixture"
    stipulated = reasons((~F.coalesce("fixture_context", F.lit(False)), "fixture_admission_context_missing"), (F.coalesce("_contradicted", F.lit(False)), "supplied_fixture_registration_unresolved"), (F.col("_fixed"), "active_evidence_correction"))
    real = F.array_union("_why", reasons((~F.col("material_role").eqNullSafe(F.lit("confirmatory")), "nonconfirmatory_or_reanalysis_scope"), (F.col("reanalysis"), "reanalysis_not_new_confirmation"), (F.col("restricted"), "admission_claim_restrictions"), (F.col("_fixed"), "active_evidence_correction")))
    why = F.when(fixture, stipulated).otherwise(real)
    status = F.when(F.size(why) > 0, "unresolved").when(fixture, "fixture_stipulated").otherwise("passed")
    return rows.select("comparison", status.alias("status"), F.array_sort(F.when(fixture, F.array_union(why, F.array(F.lit("fixture_only_no_empirical_validation")))).otherwise(why)).alias("reasons"))


def _digest(x) -> str:
    return hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def replay_indices(units: int, seed: int = PAIRED_SEED, replicates: int = REPLICATES) -> list[list[int]]:
    """The index matrix of a seeded generator [R1, R2], the same wherever it is made."""
    if units < 2:
        raise ValueError("fewer_than_two_blocks")
    rng = random.Random(seed)
    return [[rng.randrange(units) for _ in range(units)] for _ in range(replicates)]


def make_replay(blocks: list[str], seed: int = PAIRED_SEED) -> dict:
    rows = replay_indices(len(blocks), seed)
    body = {"blocks": list(blocks), "seed": seed, "replicates": REPLICATES, "algorithm": "MT19937", "indices": rows, "indices_sha256": _digest(rows)}
    return body | {"sha256": _digest(body)}


def validate_replay(replay: dict, blocks: list[str]) -> list[str]:
    """Problems of a stored replay [R3]: fields, constants, dimensions, digests."""
    if set(replay) != {"blocks", "seed", "replicates", "algorithm", "indices", "indices_sha256", "sha256"}:
        return ["replay_field_set"]
    rows, n = replay["indices"], len(blocks)
    checks = {
        "replay_block_order": replay["blocks"] == list(blocks),
        "replay_constants": replay["replicates"] == REPLICATES and replay["algorithm"] == "MT19937" and replay["seed"] in (PAIRED_SEED, TRAJECTORY_SEED),
        "replay_dimensions": len(rows) == REPLICATES and all(len(r) == n and all(type(i) is int and 0 <= i < n for i in r) for r in rows),
        "replay_indices_digest": replay["indices_sha256"] == _digest(rows),
        "replay_digest": replay["sha256"] == _digest({k: v for k, v in replay.items() if k != "sha256"}),
    }
    return [k for k, ok in checks.items() if not ok]


def index_table(spark: SparkSession, units: int, seed: int = PAIRED_SEED, replicates: int = REPLICATES) -> DataFrame:
    """(replicate, draw, unit) rows of the index matrix: replicates x units rows.

    Stretches of the generator's outputs are tasks of their own; see ``resampling.index_table``.
    """
    return resampling.index_table(spark, units, seed, replicates)


def replicate_means(values: DataFrame, indices: DataFrame, keys: list[str], value: str = "difference") -> DataFrame:
    """Mean of each replicate [A16]: one join on the unit, sums are partial on the map side."""
    return values.join(indices, "unit").groupBy(*keys, "replicate").agg((F.sum(value) / F.count(F.lit(1))).alias("mean"))


def intervals(means: DataFrame, keys: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Linear percentiles of the replicate means [A17, R4]."""
    return means.groupBy(*keys).agg(F.expr(f"percentile(mean, {low}D)").alias("low"), F.expr(f"percentile(mean, {high}D)").alias("high"), F.count(F.lit(1)).alias("replicates"))


def exact_interval(values: list[Fraction], indices: list[list[int]]) -> tuple[Fraction, Fraction]:
    """Percentiles of exact replicate means of a few block values."""
    means = [sum((values[i] for i in row), Fraction(0)) / len(values) for row in indices]
    return percentile(means, Fraction(1, 40)), percentile(means, Fraction(39, 40))


def shared_units(rows: DataFrame, call: str, unit: str) -> DataFrame:
    """Calls that several units share, which forbids resampling them as independent [J15, R5]."""
    return rows.groupBy(call).agg(F.count_distinct(unit).alias("units")).where("units > 1")


def refit(curves: DataFrame, indices: DataFrame, time: str, value: str) -> DataFrame:
    """Half-lives re-fitted on every resampled mean curve [R6, A34]: sums only, then one fit for each replicate."""
    from prismet.operators.longitudinal import anchored_fit

    mean = curves.join(indices, "unit").groupBy("replicate", time).agg(F.avg(value).alias("_mean"))
    return anchored_fit(mean, "replicate", time, "_mean")


def refit_interval(fits: DataFrame) -> DataFrame:
    """An interval only if no draw failed; failures are tallied by status."""
    out = fits.agg(F.bool_and(F.col("status") == AVAILABLE).alias("complete"), F.sum(F.when(F.col("status") != AVAILABLE, 1).otherwise(0)).alias("failed"), F.expr("percentile(half_life, 0.025D)").alias("_l"), F.expr("percentile(half_life, 0.975D)").alias("_h"))
    return out.select("complete", "failed", F.when(F.col("complete"), F.col("_l")).alias("low"), F.when(F.col("complete"), F.col("_h")).alias("high"))


def verdict(mean: Column, low: Column, high: Column, blocked: Column) -> Column:
    """supporting if mean and interval are positive, contrary if negative, else inconclusive; not_evaluated behind a closed gate [X20]."""
    lost = blocked | mean.isNull() | low.isNull() | high.isNull()
    return F.when(lost, "not_evaluated").when((mean > 0) & (low > 0) & (high > 0), "supporting").when((mean < 0) & (low < 0) & (high < 0), "contrary").otherwise("inconclusive")


def joint_verdict(parts: list[Column]) -> Column:
    """All components together: not_evaluated dominates, then contrary, then all supporting [X19]."""
    has = lambda s: F.array_contains(F.array(*parts), s)
    return F.when(has("not_evaluated"), "not_evaluated").when(has("contrary"), "contrary").when(has("inconclusive"), "inconclusive").otherwise("supporting")
