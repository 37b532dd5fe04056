"""Bindings of measurements, curves, recovery and assay records: what each refers to must be there and agree.

Everything is joins on keys and one aggregation a question. A reference to nothing, a null and a disagreement are told
apart: a disagreement is inconsistent, the others are unresolved. Repeated references count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismet.functions.status import AVAILABLE, UNAVAILABLE, reasons
from prismet.session import gathered

#: Codes that leave a binding open without contradicting it (fixed values).
OPEN = ["measurement_selection_unresolved", "measurement_budget_unresolved", "subject_identity_unknown", "state_ancestry_unknown"]
#: What an evidence record of each recovery role must assert, and for what purpose (fixed values).
ASSERTIONS = {"non_injection": "no_direct_answer_substitution", "external_validation": "post_intervention_expression_validated", "expression": "stage_supported"}
PURPOSES = {"non_injection": "independence", "external_validation": "validity", "expression": "observation"}
#: Assumptions that a basis for independent, identically distributed trials states one by one (fixed values).
ASSUMPTIONS = ["independent_calls", "fixed_state", "fixed_intervention", "no_adaptive_stopping", "no_reused_continuations", "complete_trial_inventory"]


def _strings() -> Column:
    return F.array().cast("array<string>")


def _true(c) -> Column:
    return F.coalesce(c, F.lit(False))


def _set(c: str) -> Column:
    return F.array_sort(F.array_distinct(c))


def _binding(codes: str = "codes") -> Column:
    fatal = F.size(F.array_except(codes, F.array(*map(F.lit, OPEN))))
    return F.when(fatal > 0, "inconsistent").when(F.size(codes) > 0, "unresolved").otherwise("consistent")


def measurement_bindings(measurements: DataFrame, cells: DataFrame, states: DataFrame, selections: DataFrame, panels: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """measurement, codes, binding of each measurement against its cell, state, selection and panel [V12].

    measurements: measurement, cell, state, panel, view, frame, protocol, registry, samples, rule, planned; cells: cell,
    frame, protocol, registry; states: state, stage_role, linked (its measurements); selections: cell, samples, rule, of
    which a cell must have one; panels: panel, frame, protocol, registry, view, rule, planned, stage_role. What states link
    may come as ``links`` (state, measurement) instead, for states with any number of measurements. Either way a
    measurement meets its own links by their key; no state's list is laid beside it.
    """
    if links is None:
        links = states.select("state", F.explode("linked").alias("measurement"))
    linked = links.select("state", "measurement").distinct().withColumn("_linked", F.lit(True))
    states = states.drop("linked")
    named = lambda df, key, mark: df.select(key, *[F.col(c).alias(mark + c) for c in df.columns if c != key], F.lit(True).alias(mark))
    one = selections.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"), F.max("samples").alias("samples"), F.max("rule").alias("rule")).where("_n = 1").drop("_n")
    reused = measurements.groupBy("cell", "view").agg((F.min("state") < F.max("state")).alias("_reused"))
    rows = measurements.join(named(cells, "cell", "c_"), "cell", "left").join(named(states, "state", "s_"), "state", "left").join(named(one, "cell", "e_"), "cell", "left").join(named(panels, "panel", "p_"), "panel", "left").join(reused, ["cell", "view"], "left").join(linked, ["state", "measurement"], "left")
    chosen = _set("samples") != _set("e_samples")
    repeated = F.size("samples") != F.size(F.array_distinct("samples"))
    declared = [~F.col(c).eqNullSafe(F.col("p_" + c)) for c in ("frame", "protocol", "registry", "view", "rule", "planned")]
    other = declared[0]
    for d in declared[1:]:
        other = other | d
    codes = reasons(
        (_true(F.col("s_")) & F.col("_linked").isNull(), "measurement_not_linked_by_state"),
        *[(_true(F.col("c_")) & ~F.col(c).eqNullSafe(F.col("c_" + c)), f"measurement_{c}_mismatch") for c in ("frame", "protocol", "registry")],
        (F.col("samples").isNull() | F.col("e_samples").isNull(), "measurement_selection_unresolved"),
        (chosen | repeated & F.col("e_samples").isNotNull(), "measurement_selected_identity_mismatch"),
        (_true(F.col("e_")) & ~F.col("rule").eqNullSafe(F.col("e_rule")), "selection_rule_mismatch"),
        (F.col("planned").isNull(), "measurement_budget_unresolved"),
        (_true(F.col("p_")) & other, "panel_binding_mismatch"),
        (_true(F.col("p_")) & _true(F.col("s_")) & ~F.col("s_stage_role").eqNullSafe(F.col("p_stage_role")), "panel_stage_mismatch"),
        (_true(F.col("_reused")), "same_measurement_reused_as_new_state"),
    )
    return rows.select("measurement", codes.alias("codes")).withColumn("binding", _binding())


def state_bindings(states: DataFrame, measurements: DataFrame) -> DataFrame:
    """state, codes, binding: kind against stage, what is unknown, and measurements that name another state [V12]."""
    linked = states.select("state", F.explode(F.array_distinct("linked")).alias("measurement")).join(measurements.select("measurement", F.col("state").alias("_of")), "measurement")
    astray = linked.where("_of <> state").select("state").distinct().withColumn("_astray", F.lit(True))
    model, probe = F.col("state_kind") == "model_system", F.col("stage_role") == "probe_output"
    codes = reasons(
        ((model & ~probe) | ((F.col("state_kind") == "corpus") & probe), "state_stage_unit_mismatch"), (F.col("identity").isNull(), "subject_identity_unknown"),
        (F.col("ancestors").isNull(), "state_ancestry_unknown"), (_true(F.col("_astray")), "state_measurement_target_mismatch"),
    )
    return states.join(astray, "state", "left").select("state", codes.alias("codes")).withColumn("binding", _binding())


def curve_points(slots: DataFrame) -> DataFrame:
    """request, state, mean, status: the mean over a request's panels, each once and with a value, or none [V11].

    slots: request, state, panel, slot (observed, intentionally_unsampled or other), value. A state that no panel was to
    be sampled at is intentionally_unsampled, any other lack is missing.
    """
    width = slots.groupBy("request").agg(F.count_distinct("panel").alias("_panels"))
    skipped = F.sum(F.when(F.col("slot") == "intentionally_unsampled", 1).otherwise(0))
    at = slots.groupBy("request", "state").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("panel").alias("_own"), F.count("value").alias("_have"), F.avg("value").alias("_mean"), skipped.alias("_skipped"))
    whole = (F.col("_own") == F.col("_panels")) & (F.col("_n") == F.col("_panels")) & (F.col("_have") == F.col("_panels"))
    status = F.when(whole, AVAILABLE).when(F.col("_skipped") == F.col("_n"), "intentionally_unsampled").otherwise("missing")
    return at.join(width, "request").select("request", "state", F.when(whole, F.col("_mean")).alias("mean"), status.alias("status"))


def curve_reasons(slots: DataFrame) -> DataFrame:
    """request, endpoint, regime: why a curve's ends, or all of it, cannot carry a fit [V11]."""
    ends = slots.groupBy("request").agg(F.min("state").alias("_a"), F.max("state").alias("_b"))
    skip = F.col("slot") == "intentionally_unsampled"
    lost = reasons((~skip & (F.col("slot") != "observed"), "expected_panel_measurement_missing"), ((F.col("slot") == "observed") & F.col("value").isNull(), "panel_diversity_unavailable"))
    mixed = slots.groupBy("request", "state").agg((F.bool_or(skip) & ~F.bool_and(skip)).alias("_m")).groupBy("request").agg(F.bool_or("_m").alias("_mixed"))
    end = (F.col("state") == F.col("_a")) | (F.col("state") == F.col("_b"))
    gathered = slots.join(ends, "request").withColumn("_why", lost).groupBy("request").agg(F.flatten(F.collect_set(F.when(end, F.col("_why")))).alias("_e"), F.flatten(F.collect_set("_why")).alias("_r"))
    schedule = F.when(F.col("_mixed"), F.array(F.lit("incomplete_common_panel_schedule"))).otherwise(_strings())
    return gathered.join(mixed, "request").select("request", _set("_e").alias("endpoint"), F.array_sort(F.array_union("_r", schedule)).alias("regime"))


def sensitivity_units(curves: DataFrame, calls: DataFrame) -> DataFrame:
    """request, unit, times, values, reasons: whole curves of the units to be resampled, never pooled counts [V13].

    curves: request, unit, time, value, slot; calls: request, unit, call. Times that were not to be sampled are left out
    of every unit alike. Units that share a call, or whose times differ from the others', cannot be resampled.
    """
    kept = curves.where("slot <> 'intentionally_unsampled'").groupBy("request", "unit").agg(F.array_sort(F.collect_list(F.struct("time", "value"))).alias("_c"))
    kept = kept.select("request", "unit", F.col("_c.time").alias("times"), F.col("_c.value").alias("values"))
    grid = kept.groupBy("request").agg((F.min("times") != F.max("times")).alias("_differ"))
    shared = calls.groupBy("request", "call").agg((F.min("unit") < F.max("unit")).alias("_s")).groupBy("request").agg(F.bool_or("_s").alias("_shared"))
    rows = kept.join(grid, "request").join(shared, "request", "left")
    why = reasons((_true(F.col("_shared")), "shared_panel_call_dependency"), (F.col("_differ"), "root_sensitivity_time_grid_mismatch"), (F.exists("values", lambda v: v.isNull()), "sensitivity_value_unavailable"))
    return rows.select("request", "unit", "times", "values", why.alias("reasons"))


def scoped_gates(episodes: DataFrame, assessments: DataFrame) -> DataFrame:
    """episode, role, gate, reasons of each recovery role [V14]: every role of ``ASSERTIONS`` for every episode.

    episodes: episode, subject (digest of what was reviewed); assessments: episode, role, outcome, subject, assertion,
    purpose, method, detail, artifacts, reviewers (arrays). One assessment that fails closes the gate, and so do two
    that disagree.
    """
    roles = F.explode(F.array(*map(F.lit, ASSERTIONS))).alias("role")
    wanted = episodes.select("episode", F.col("subject").alias("_subject"), roles)
    rows = wanted.join(assessments.withColumn("_there", F.lit(True)), ["episode", "role"], "left")
    look = lambda table: F.get(F.array(*map(F.lit, table.values())), F.array_position(F.array(*map(F.lit, table)), F.col("role")).cast("int") - 1)
    there = _true(F.col("_there"))
    named = lambda *pairs: reasons(*[(there & c, code) for c, code in pairs])
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    why = named(
        (~F.col("subject").eqNullSafe(F.col("_subject")), "_reviewed_subject_changed"), (~F.col("outcome").eqNullSafe(F.lit("supported")), "_assessment_unsupported"),
        (~F.col("assertion").eqNullSafe(look(ASSERTIONS)), "_assertion_mismatch"), (~F.col("purpose").eqNullSafe(look(PURPOSES)), "_purpose_mismatch"), (blank("method") | blank("detail"), "_method_or_detail_missing"),
        (F.coalesce(F.size("artifacts"), F.lit(0)) < 1, "_material_missing"), (F.coalesce(F.size("reviewers"), F.lit(0)) < 1, "_reviewer_missing"),
    )
    each = rows.withColumn("_why", why).groupBy("episode", "role").agg(F.bool_or(there).alias("_any"), F.flatten(F.collect_set("_why")).alias("_codes"), (F.min("outcome") < F.max("outcome")).alias("_conflict"))
    codes = F.array_union("_codes", reasons((~F.col("_any"), "_evidence_missing"), (_true(F.col("_conflict")), "_assessment_conflict")))
    out = each.select("episode", "role", F.array_sort(F.transform(codes, lambda c: F.concat("role", c))).alias("reasons"))
    return out.select("episode", "role", F.when(F.size("reasons") > 0, UNAVAILABLE).otherwise("eligible").alias("gate"), "reasons")


def revision_ledger(revisions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """revision, originals, available, reasons: whether the originals of each revision are still there as read [V15]."""
    read = artifacts.where("status = 'snapshot_read'").select(F.col("artifact").alias("_a")).distinct().withColumn("_read", F.lit(True))
    each = revisions.select("revision", F.posexplode_outer("originals").alias("_i", "_a")).join(read, "_a", "left")
    kept = each.groupBy("revision").agg(F.array_sort(F.collect_list(F.when(F.col("_a").isNotNull(), F.struct("_i", "_a", _true(F.col("_read")).alias("_read"))))).alias("_o"))
    why = reasons((F.size("_o") == 0, "revision_original_material_missing"), (F.exists("_o", lambda o: ~o["_read"]), "revision_original_material_unavailable"))
    return kept.select("revision", F.col("_o._a").alias("originals"), F.col("_o._read").alias("available"), why.alias("reasons"))


def determinate_failures(trials: DataFrame, attempts: DataFrame, artifacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """trial, determinate: a trial counts as a failure only by a scoped declaration and its original response [V16].

    trials: trial, assay, attempt, event; attempts: attempt, artifact; evidence: trial, assay, attempt, event, purpose,
    assertion, sound. Without the response as read, or with a declaration for anything else, it stays unresolved.
    """
    read = attempts.join(artifacts.where("status = 'snapshot_read'").select("artifact").distinct(), "artifact", "left_semi").select("attempt").distinct()
    said = evidence.where("sound AND purpose = 'observation' AND assertion").select("trial", "assay", "attempt", "event").distinct()
    sure = trials.join(read, "attempt", "left_semi").join(said, ["trial", "assay", "attempt", "event"], "left_semi").select("trial").distinct().withColumn("_sure", F.lit(True))
    return trials.select("trial").join(sure, "trial", "left").select("trial", _true(F.col("_sure")).alias("determinate"))


def iid_basis(assays: DataFrame, basis: DataFrame) -> DataFrame:
    """assay, reasons: whether the basis that an assay cites supports its trials being alike and independent [V16].

    assays: assay, design (digest), basis; basis: basis, assay, design, supported, and a column for each assumption.
    """
    b = basis.select("basis", F.col("assay").alias("_assay"), F.col("design").alias("_design"), "supported", *ASSUMPTIONS, F.lit(True).alias("_there"))
    rows, there = assays.join(b, "basis", "left"), _true(F.col("_there"))
    bound = F.col("assay").eqNullSafe(F.col("_assay")) & F.col("design").eqNullSafe(F.col("_design"))
    return rows.select("assay", reasons((~there, "assay_iid_basis_missing"), (there & ~_true(F.col("supported")), "assay_independence_not_supported"), (there & ~bound, "assay_iid_binding_mismatch"), *[(there & ~_true(F.col(a)), f"assay_assumption_{a}_unsupported") for a in ASSUMPTIONS]).alias("reasons"))


def control_facts(controls: DataFrame) -> DataFrame:
    """Adds fact to controls of calls [J12]: one known value that differs is a mismatch, all known and recorded consistent.

    controls: name, expected, requested, actual (null: unknown), exposed, enforcement, supported (by evidence). A penalty
    that the service does not expose does not apply.
    """
    penalty = F.col("name").isin("presence_penalty", "frequency_penalty") & ~_true(F.col("exposed")) & (F.col("enforcement") == "unsupported")
    differs = _true(F.col("requested") != F.col("expected")) | _true(F.col("actual") != F.col("expected"))
    held = F.col("requested").isNotNull() & F.col("actual").isNotNull() & (F.col("enforcement") == "recorded") & _true(F.col("supported"))
    return controls.withColumn("fact", F.when(_true(penalty), "not_applicable").when(differs, "inconsistent").when(_true(held), "record_consistent").otherwise("unresolved"))


def registration_facts(requests: DataFrame, witnesses: DataFrame, design: list[str]) -> DataFrame:
    """request, reasons: whether a registration names this very design, and was made before anyone looked [V9].

    A witness holds the digest of the design's fields (``design_digest``), which identifies and never proves.
    """
    w = witnesses.select("request", F.col("digest").alias("_digest"), "rationale", "inspection", F.lit(True).alias("_there"))
    rows, there = requests.withColumn("_own", design_digest(design)).join(w, "request", "left"), _true(F.col("_there"))
    return rows.select("request", reasons((~there, "fit_registration_binding_missing"), (there & ~F.col("_digest").eqNullSafe(F.col("_own")), "fit_registration_binding_mismatch"), (there & (F.coalesce(F.trim("rationale"), F.lit("")) == ""), "fit_residual_rationale_missing"), (there & ~F.col("inspection").eqNullSafe(F.lit("registered_before_inspection")), "fit_registration_not_prespecified")).alias("reasons"))


def design_digest(fields: list[str]) -> Column:
    """Digest of named fields in the order of their names; null and the empty string differ."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("null"))) for c in sorted(fields)]
    return F.sha2(F.concat_ws(";", *parts), 256)


def carrier_differences(staged: DataFrame, results: DataFrame, keys: list[str], value: str, scale: int = 9) -> DataFrame:
    """keys, difference of results against a staged carrier [V24]: numbers are equal as decimals of ``scale`` places."""
    named = lambda df, mark: df.select(*keys, F.col(value).cast(f"decimal(38,{scale})").alias(mark), F.lit(True).alias(mark + "_in"))
    both = named(staged, "_a").join(named(results, "_b"), keys, "full")
    kind = F.when(F.col("_a_in").isNull(), "not_staged").when(F.col("_b_in").isNull(), "not_produced").when(~F.col("_a").eqNullSafe(F.col("_b")), "value_mismatch")
    return both.select(*keys, kind.alias("difference")).where("difference IS NOT NULL")


def operands(values: DataFrame, cells: DataFrame) -> DataFrame:
    """Values with what they stand on [V8]: the sample ids and size of their population and the pinned revisions.

    values: cell, view, metric, k, value; cells: cell, view, ids, pins. A value whose cell is not there is unavailable,
    whatever number came with it.
    """
    rows = values.join(cells.select("cell", "view", "ids", "pins", F.size("ids").alias("population"), F.lit(True).alias("_there")), ["cell", "view"], "left")
    there = _true(F.col("_there"))
    status = F.when(~there | F.col("value").isNull(), UNAVAILABLE).otherwise(AVAILABLE)
    why = reasons((~there, "expected_cell_unavailable"), (there & F.col("value").isNull(), "operand_value_absent"))
    return rows.select("cell", "view", "metric", "k", F.when(there, F.col("value")).alias("value"), status.alias("status"), "ids", "population", "pins", why.alias("reasons"))


def contrasts(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pair, view, metric, k, difference, status, reasons of left minus right [V8, A14].

    pairs: pair, left, right, compatible; values as ``operands`` gives them. Incompatible pairs have no difference.
    """
    side = lambda c: values.select(F.col("cell").alias(c), "view", "metric", "k", F.col("value").alias("_" + c), F.col("reasons").alias("_why_" + c))
    right = side("right").withColumns({"_view": F.col("view"), "_metric": F.col("metric"), "_k": F.col("k")}).drop("view", "metric", "k")
    rows = pairs.join(side("left"), "left").join(right, "right").where("view = _view AND metric = _metric AND k <=> _k")
    fits = _true(F.col("compatible"))
    why = F.when(fits, F.array_sort(F.array_union("_why_left", "_why_right"))).otherwise(F.array(F.lit("comparison_incompatible")))
    difference = F.when(fits, F.col("_left") - F.col("_right"))
    return rows.select("pair", "view", "metric", "k", difference.alias("difference"), F.when(difference.isNull(), UNAVAILABLE).otherwise(AVAILABLE).alias("status"), why.alias("reasons"))


def evidence_facts(comparisons: DataFrame, supplied: DataFrame, groups: list[str]) -> DataFrame:
    """comparison, name, status of each group of evidence and of a registration's order in time [V6].

    comparisons: comparison, digest (of its configuration); supplied: comparison, group, sound, digest, registered,
    inspected, collected. A group without evidence, and a time that is not known, is unresolved, never inconsistent.
    """
    own = comparisons.select("comparison", F.col("digest").alias("_digest"), F.explode(F.array(*map(F.lit, groups))).alias("group"))
    rows = own.join(supplied.withColumn("_there", F.lit(True)), ["comparison", "group"], "left")
    fact = lambda name, ok: F.struct(name.alias("name"), F.when(ok, "record_consistent").when(~ok, "inconsistent").otherwise("unresolved").alias("status"))
    first = fact(F.concat(F.lit("evidence_"), "group"), F.when(_true(F.col("sound")), F.lit(True)))
    timed = [fact(F.lit("registration_binding"), F.col("digest") == F.col("_digest"))] + [fact(F.lit(f"registration_before_first_{c}"), F.col("registered") < F.col(c)) for c in ("inspected", "collected")]
    facts = F.when((F.col("group") == "registration") & _true(F.col("_there")), F.array(first, *timed)).otherwise(F.array(first))
    return rows.select("comparison", F.explode(facts).alias("_f")).select("comparison", "_f.*").distinct()


def readiness_problems(activities: DataFrame, prerequisites: DataFrame) -> DataFrame:
    """activity, outstanding, problems of readiness records [V17, V23]: what is still to be met follows from the rows.

    activities: activity, state, outstanding (as declared); prerequisites: activity, requirement, mandatory, outcome. A
    mandatory requirement cannot be not_applicable; it counts as unresolved.
    """
    due = F.col("mandatory") & ~F.col("outcome").eqNullSafe(F.lit("satisfied_for_scope"))
    per = prerequisites.groupBy("activity").agg(
        F.array_sort(F.collect_set(F.when(due, F.col("requirement")))).alias("_due"), F.count(F.lit(1)).alias("_n"), F.count_distinct("requirement").alias("_own"), F.bool_or(F.col("mandatory") & (F.col("outcome") == "not_applicable")).alias("_void"),
    )
    rows = activities.join(per, "activity", "left").withColumn("_due", F.coalesce("_due", _strings()))
    declared = F.coalesce("outstanding", _strings())
    why = reasons(
        (_true(F.col("_n") > F.col("_own")) | (F.size(declared) > F.size(F.array_distinct(declared))), "duplicate_value"), (_true(F.col("_void")), "mandatory_requirement_not_applicable"),
        (F.array_sort(F.array_distinct(declared)) != F.col("_due"), "outstanding_requirements_contradiction"), (F.col("state").eqNullSafe(F.lit("ready")) & (F.size("_due") > 0), "ready_with_outstanding_requirements"),
    )
    return rows.select("activity", F.col("_due").alias("outstanding"), why.alias("problems"))


def review_problems(reviews: DataFrame, artifacts: DataFrame) -> DataFrame:
    """review, problems of reviews of artifacts [V17]: the hash reviewed, class and assignment, stage and first submission.

    reviews: review, artifact, sha256, reviewer, assignment, class, stage, initial (the review that a revision
    revises); artifacts: artifact, sha256.
    """
    # Reviews without an earlier one look for nothing, each under its own key: a null key would bring them all to one task.
    first = reviews.select(F.struct(F.lit(True).alias("_asks"), F.col("review").alias("_id")).alias("_wants"), F.col("stage").alias("_stage"), F.struct("artifact", "sha256", "reviewer").alias("_of"), F.lit(True).alias("_there"))
    asks = F.col("initial").isNotNull()
    wants = reviews.withColumn("_wants", F.struct(asks.alias("_asks"), F.when(asks, F.col("initial")).otherwise(F.col("review")).alias("_id")))
    rows = gathered(wants, "_wants").join(gathered(first, "_wants"), "_wants", "left").join(artifacts.select("artifact", F.col("sha256").alias("_sha")), "artifact", "left")
    other = (F.col("_stage") != "initial") | ~F.col("_of").eqNullSafe(F.struct("artifact", "sha256", "reviewer"))
    return rows.select("review", reasons(
        (_true(F.col("_sha") != F.col("sha256")), "artifact_hash_mismatch"), (F.col("assignment").eqNullSafe(F.lit("assigned")) != F.col("class").isNotNull(), "assignment_contradiction"),
        (F.col("stage").eqNullSafe(F.lit("revision")) != F.col("initial").isNotNull(), "submission_stage_contradiction"), (F.col("initial").isNotNull() & F.col("_there").isNull(), "initial_submission_unresolved"), (_true(F.col("_there")) & _true(other), "initial_submission_contradiction"),
    ).alias("problems"))


def subject_bindings(measurements: DataFrame, states: DataFrame, checkpoints: DataFrame, samples: DataFrame, data_role: str) -> DataFrame:
    """measurement, codes of measurements whose subject, samples or material are not those of their state, cell and bundle [V12].

    measurements: measurement, cell, state, samples, data_role; states: state, state_kind, parameters; checkpoints: cell,
    recorded; samples: sample, cell.
    """
    s = states.select("state", F.col("state_kind").alias("_kind"), F.col("parameters").alias("_declared"))
    rows = measurements.join(s, "state", "left").join(checkpoints.select("cell", "recorded", F.lit(True).alias("_cell")), "cell", "left")
    own = measurements.select("measurement", F.col("cell").alias("_own"), F.explode(F.array_distinct("samples")).alias("sample")).join(samples.select("sample", F.col("cell").alias("_of")), "sample")
    astray = own.where("_of <> _own").select("measurement").distinct().withColumn("_astray", F.lit(True))
    rows = rows.join(astray, "measurement", "left")
    codes = reasons(
        (~F.col("data_role").eqNullSafe(F.lit(data_role)), "measurement_material_role_mismatch"), (_true(F.col("_cell")) & (F.col("_kind") == "categorical_scenario"), "categorical_state_cannot_bind_empirical_cell"),
        (_true(F.col("_cell")) & (F.col("_kind") == "model_system") & (F.col("_declared") != F.col("recorded")), "measurement_model_state_mismatch"), (_true(F.col("_cell")) & _true(F.col("_astray")), "sample_cell_mismatch"),
    )
    return rows.select("measurement", codes.alias("codes")).where(F.size("codes") > 0)
