"""The longitudinal profile of a bundle: declared objects read, bound, checked against each other, and their clocks and tails told.

Every check is a table operator over all objects at once. A problem is scoped to its object; what is sound beside it stays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.operators import bindings, lineage
from prismet.session import written
from prismet.sources import bundle as source
from prismet.sources import longitudinal as reader

#: Members of a tail ledger at most, and codes that leave an object open without contradicting it (fixed values).
LEDGER = 100_000
OPEN = [
    "transition_not_completed", "transition_process_evidence_missing", "transition_parents_unknown", "transition_child_unresolved", "transition_parent_unresolved", "recursive_distance_unknown", "merge_contributions_incomplete", "ancestral_transition_unresolved", "composite_stages_missing", "composite_stage_unresolved",
    "composite_stage_not_documented", "composite_distance_unknown", "trajectory_clock_unresolved", "trajectory_transition_unresolved", "trajectory_lineage_restricted", "observation_schedule_incomplete", "observed_measurement_unresolved", "scheduled_measurement_limited", "missingness_reason_unresolved",
    "object_reference_unresolved", "core_reference_unresolved", *bindings.OPEN,
]


@dataclass
class Review:
    """problems: key, code, severity; clocks: request, start_at, end_at, rounds, reasons; members and gates of tails."""

    declared: reader.Longitudinal
    problems: DataFrame
    clocks: DataFrame
    members: DataFrame
    gates: DataFrame
    exit_code: int


def schedule_problems(slots: DataFrame, paths: DataFrame, panels: DataFrame, measurements: DataFrame, limited: DataFrame) -> DataFrame:
    """trajectory, code of observation slots that do not fit their path, their measurement, or each other [J9, V12].

    panels: trajectory, panel (those of its grid); limited: measurement, those with a problem of their own. One row for
    each code of a trajectory.
    """
    at = paths.groupBy("trajectory", "state").agg(F.min_by("coordinate", "place").alias("_round"), F.lit(True).alias("_on_path"))
    grid = panels.select("trajectory", "panel", F.lit(True).alias("_on_grid")).distinct()
    m = measurements.select("measurement", F.col("state").alias("_m_state"), F.col("panel").alias("_m_panel"), F.lit(True).alias("_there")).join(limited.select("measurement", F.lit(True).alias("_limited")).distinct(), "measurement", "left")
    n = slots.groupBy("trajectory", "state", "panel").agg((F.count(F.lit(1)) > 1).alias("_twice"))
    rows = slots.join(at, ["trajectory", "state"], "left").join(grid, ["trajectory", "panel"], "left").join(m, "measurement", "left").join(n, ["trajectory", "state", "panel"], "left")
    inside = F.col("_on_path") & F.col("_on_grid")
    inside = F.coalesce(inside, F.lit(False))
    observed, there = F.col("slot") == "observed", F.coalesce("_there", F.lit(False))
    found = F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in (
        (F.coalesce("_twice", F.lit(False)), "duplicate_observation_slot"), (~inside, "observation_outside_selected_path"), (inside & ~F.col("round").eqNullSafe(F.col("_round")), "observation_clock_mismatch"), (observed & ~there, "observed_measurement_unresolved"),
        (observed & there & ~(F.col("_m_state").eqNullSafe(F.col("state")) & F.col("_m_panel").eqNullSafe(F.col("panel"))), "observation_measurement_mismatch"), (observed & F.coalesce("_limited", F.lit(False)), "scheduled_measurement_limited"),
        (~observed & F.col("measurement").isNotNull(), "measurement_on_unobserved_slot"), (F.col("slot").isin("missing", "intentionally_unsampled") & ~F.col("reasoned"), "missingness_reason_unresolved"),
    )]))
    wanted = at.select("trajectory", "state").join(grid.select("trajectory", "panel"), "trajectory")
    lost = wanted.join(slots.select("trajectory", "state", "panel"), ["trajectory", "state", "panel"], "left_anti").select("trajectory", F.lit("observation_schedule_incomplete").alias("code"))
    return rows.select("trajectory", F.explode(found).alias("code")).unionByName(lost).distinct()


def tails(b: source.Bundle) -> tuple[DataFrame, DataFrame]:
    """Protected tails of a bundle as ``lineage.tail_ledger`` takes them, and the links between them."""
    known = lambda c, kind="string": F.when(F.try_variant_get("v", f"$.payload.{c}.state", "string") == "known", F.try_variant_get("v", f"$.payload.{c}.value", kind))
    get = lambda c, kind: F.try_variant_get("v", f"$.payload.{c}", kind)
    refs = "array<struct<record_type:string,record_id:string,record_version:string>>"
    keys = lambda c: F.transform(F.coalesce(c, F.array().cast(refs)), lambda r: F.concat_ws(":", r["record_type"], r["record_id"]))
    good = b.records.where("problem IS NULL").join(b.keys().select(F.col("key").alias("_key")), F.concat_ws(":", "record_type", "record_id") == F.col("_key"), "left_semi").select(F.concat_ws(":", "record_type", "record_id").alias("key"), "record_type", "record_id", F.try_parse_json("line").alias("v"))
    own = good.where("record_type = 'tail'").select(
        F.col("key").alias("tail"), F.coalesce(known("class_id").isin(*source.CLASSES), F.lit(False)).alias("class_known"), known("designation").alias("designation"), known("basis").alias("basis"), get("state", "string").alias("state"), known("disposition").alias("disposition"), keys(get("reference_refs", refs)).alias("_refs"), keys(get("review_refs", refs)).alias("_reviews"),
        F.concat_ws(":", get("extensions.longitudinal_tail.registration_ref.record_type", "string"), get("extensions.longitudinal_tail.registration_ref.record_id", "string")).alias("registration"), (get("mock", "boolean") | (get("data_role", "string") == "fixture")).alias("mock"),
    ).withColumn("registration", F.when(F.col("registration").startswith("preregistration:"), F.col("registration")))
    plans = good.where("record_type = 'preregistration'").select(F.col("key").alias("registration"), ((get("state", "string") == "active") & known("registered_at").isNotNull()).alias("registered"), keys(get("material_refs", refs)).alias("_materials"))
    readable = good.select(F.col("key").alias("_review"), ((get("state", "string") == "active") & (F.coalesce(get("access", "string"), F.lit("readable")) == "readable")).alias("_readable"))
    seen = own.select("tail", F.explode("_reviews").alias("_review")).join(readable, "_review", "left").groupBy("tail").agg(F.count(F.lit(1)).alias("reviews"), F.sum(F.coalesce("_readable", F.lit(False)).cast("int")).alias("reviews_readable"))
    out = own.join(plans, "registration", "left").join(seen, "tail", "left").fillna(0, ["reviews", "reviews_readable"])
    registries = F.transform(F.filter("_refs", lambda r: r.startswith("reference_registry:")), lambda r: F.substring_index(r, ":", -1))
    table = out.select("tail", "class_known", "designation", "basis", "state", "disposition", registries.alias("registries"), F.coalesce("registered", F.lit(False)).alias("registered"), "registration", F.coalesce(F.array_contains("_materials", F.col("tail")), F.lit(False)).alias("listed"), "reviews", "reviews_readable", "mock")
    links = own.select("tail", F.posexplode(F.filter("_refs", lambda r: r.startswith("tail:"))).alias("place", "target"))
    return table, links


def review(spark: SparkSession, root: str, manifest: str = "bundle.json") -> Review | None:
    """All checks of a bundle's longitudinal declaration; None where it makes none.

    The exit code is 2 where something contradicts, 0 where at most knowledge is missing.
    """
    b = source.load_bundle(spark, root, manifest)
    d = reader.load(b)
    if d is None:
        return None
    states, measurements, transitions, parents, paths, steps = (written(t) for t in (d.states(), d.measurements(), d.transitions(), d.parents(), d.paths(), d.steps()))
    samples = b.table("realization").select(F.col("sample_id").alias("sample"), F.col("analysis_cell_id").alias("cell"))
    bound = bindings.measurement_bindings(measurements.drop("data_role"), d.cells(), states.select("state", "stage_role", "linked"), d.selections(), d.panels())
    subject = bindings.subject_bindings(measurements, states, d.checkpoints(), samples, d.data_role)
    each = lambda df, key, codes="codes": df.select(F.col(key).alias("key"), F.explode(codes).alias("code"))
    of_measurements = written(each(bound, "measurement").unionByName(each(subject, "measurement")).distinct())
    of_states = each(bindings.state_bindings(states, measurements), "state")
    own = written(lineage.step_problems(transitions, parents, d.contributions(), states))
    whole = lineage.composite_problems(transitions, parents, d.components(), own.select("transition"))
    faulty = written(each(own, "transition").unionByName(each(whole, "transition")).distinct())
    edges = written(parents.join(transitions.select("transition", "child"), "transition").select(F.col("parent").alias("src"), F.col("child").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    # Behind a cycle there is no level, so its steps are faults as well.
    ranked = lineage.levels(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), edges)
    cyclic = transitions.join(ranked.where("level IS NULL").select(F.col("node").alias("child")), "child", "left_semi").select(F.col("transition").alias("key"), F.lit("reproduction_cycle_or_descendant").alias("code"))
    faulty = written(faulty.unionByName(cyclic).distinct())
    broken = transitions.join(faulty.select(F.col("key").alias("transition")).distinct(), "transition", "left_semi").select(F.col("child").alias("node"))
    restricted = written(lineage.carried(broken.where("node IS NOT NULL"), edges))
    inherited = transitions.join(restricted.select(F.col("node").alias("child")), "child", "left_semi").join(faulty.select(F.col("key").alias("transition")), "transition", "left_anti").select(F.col("transition").alias("key"), F.lit("ancestral_transition_unresolved").alias("code"))
    of_steps = written(faulty.unionByName(inherited))
    of_paths = each(lineage.path_problems(paths, steps, transitions, parents, restricted.select(F.col("node").alias("state"))), "trajectory")
    grid = d.table("trajectory").select(F.col("key").alias("trajectory"), F.explode(F.transform("panel_refs", reader.object_key)).alias("panel"))
    of_slots = schedule_problems(d.slots(), paths, grid, measurements, of_measurements.select(F.col("key").alias("measurement"))).select(F.col("trajectory").alias("key"), "code")
    every = d.problems.select("key", "code").unionByName(of_measurements).unionByName(of_states).unionByName(of_steps).unionByName(of_paths).unionByName(of_slots).distinct()
    problems = written(every.withColumn("severity", F.when(F.col("code").isin(*OPEN), "unresolved").otherwise("inconsistent")))
    sound = transitions.join(of_steps.select(F.col("key").alias("transition"), F.lit(False).alias("_sound")).distinct(), "transition", "left").withColumn("sound", F.coalesce("_sound", F.lit(True)))
    clocks = lineage.elapsed(paths, steps, sound.select("transition", "child", "distance", "sound"), parents, d.clocks_asked())
    table, links = tails(b)
    members, gates = lineage.tail_ledger(d.tails_asked(), table, links, limit=LEDGER)
    stop = problems.where("severity = 'inconsistent'").take(1)
    return Review(d, problems, clocks, members, gates, 2 if stop else 0)
