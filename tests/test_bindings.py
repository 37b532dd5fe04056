from pyspark.sql import functions as F

from prismet.operators import bindings


def test_measurement_and_state_bindings(spark):
    names = "measurement string, cell string, state string, panel string, view string, frame string, protocol string, registry string, samples array<string>, rule string, planned int"
    good = ("c", "s", "p", "all", "f", "q", "r", ["x", "y"], "first", 4)
    m = spark.createDataFrame([("m1", *good), ("m2", "c", "s", "p", "valid", "g", "q", "r", ["x", "x"], "first", None), ("m3", "d", "s2", None, "all", "f", "q", "r", None, None, 4), ("m4", "e", "s", None, "all", None, None, None, ["x"], None, 4), ("m5", "e", "s2", None, "all", None, None, None, ["x"], None, 4)], names)
    cells = spark.createDataFrame([("c", "f", "q", "r"), ("d", "f", "q", "r")], "cell string, frame string, protocol string, registry string")
    states = spark.createDataFrame([("s", "corpus", "probe_output", ["m1", "m2", "m4"], "i", ["a"]), ("s2", "model_system", "probe_output", ["m3", "m1"], None, None)], "state string, state_kind string, stage_role string, linked array<string>, identity string, ancestors array<string>")
    chosen = spark.createDataFrame([("c", ["y", "x"], "first"), ("e", ["x"], None), ("e", ["z"], None)], "cell string, samples array<string>, rule string")
    panels = spark.createDataFrame([("p", "f", "q", "r", "all", "first", 4, "probe_output")], "panel string, frame string, protocol string, registry string, view string, rule string, planned int, stage_role string")
    got = {r["measurement"]: (r["codes"], r["binding"]) for r in bindings.measurement_bindings(m, cells, states, chosen, panels).collect()}
    assert got["m1"] == ([], "consistent")
    assert got["m2"] == (["measurement_budget_unresolved", "measurement_frame_mismatch", "measurement_selected_identity_mismatch", "panel_binding_mismatch"], "inconsistent")
    assert got["m3"] == (["measurement_selection_unresolved"], "unresolved")
    assert got["m4"] == (["measurement_selection_unresolved", "same_measurement_reused_as_new_state"], "inconsistent")
    assert got["m5"][0] == ["measurement_not_linked_by_state", "measurement_selection_unresolved", "same_measurement_reused_as_new_state"]
    got = {r["state"]: (r["codes"], r["binding"]) for r in bindings.state_bindings(states, m).collect()}
    assert got == {"s": (["state_stage_unit_mismatch"], "inconsistent"), "s2": (["state_ancestry_unknown", "state_measurement_target_mismatch", "subject_identity_unknown"], "inconsistent")}


def test_curves_and_units(spark):
    skip = "intentionally_unsampled"
    rows = [(0, "a", "observed", 0.5), (0, "b", "observed", 0.7), (1, "a", skip, None), (1, "b", skip, None), (2, "a", "observed", 0.4), (2, "b", skip, None), (3, "a", "observed", None), (3, "b", "missing", None)]
    slots = spark.createDataFrame([("q", *r) for r in rows], "request string, state int, panel string, slot string, value double")
    assert {r["state"]: (r["mean"], r["status"]) for r in bindings.curve_points(slots).collect()} == {0: (0.6, "available"), 1: (None, skip), 2: (None, "missing"), 3: (None, "missing")}
    why = bindings.curve_reasons(slots).first()
    assert why["endpoint"] == ["expected_panel_measurement_missing", "panel_diversity_unavailable"] and why["regime"] == ["expected_panel_measurement_missing", "incomplete_common_panel_schedule", "panel_diversity_unavailable"]
    curves = slots.select("request", F.col("panel").alias("unit"), F.col("state").alias("time"), "value", "slot")
    calls = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "b", 1)], "request string, unit string, call int")
    got = {r["unit"]: (r["times"], r["values"], r["reasons"]) for r in bindings.sensitivity_units(curves, calls).collect()}
    common = ["root_sensitivity_time_grid_mismatch", "sensitivity_value_unavailable", "shared_panel_call_dependency"]
    assert got == {"a": ([0, 2, 3], [0.5, 0.4, None], common), "b": ([0, 3], [0.7, None], common)}
    alone = bindings.sensitivity_units(curves.where("unit = 'a' AND time < 3"), calls.where("call = 2")).first()
    assert alone["times"] == [0, 2] and alone["reasons"] == []


def test_recovery_gates_and_ledger(spark):
    fields = "episode string, role string, outcome string, subject string, assertion string, purpose string, method string, detail string, artifacts array<string>, reviewers array<string>"
    sound = lambda role: ("e", role, "supported", "h", bindings.ASSERTIONS[role], bindings.PURPOSES[role], "m", "d", ["x"], ["r"])
    rows = [sound("non_injection"), sound("external_validation"), ("e", "external_validation", "refuted", "old", "else", "validity", " ", None, [], None)]
    got = {r["role"]: (r["gate"], r["reasons"]) for r in bindings.scoped_gates(spark.createDataFrame([("e", "h")], "episode string, subject string"), spark.createDataFrame(rows, fields)).collect()}
    assert got["non_injection"] == ("eligible", []) and got["expression"] == ("unavailable", ["expression_evidence_missing"])
    ends = ["assertion_mismatch", "assessment_conflict", "assessment_unsupported", "material_missing", "method_or_detail_missing", "reviewed_subject_changed", "reviewer_missing"]
    assert got["external_validation"] == ("unavailable", ["external_validation_" + x for x in ends])
    revisions = spark.createDataFrame([("r1", ["x", "y"]), ("r2", []), ("r3", None), ("r4", ["x"])], "revision string, originals array<string>")
    artifacts = spark.createDataFrame([("x", "snapshot_read"), ("y", "hash_mismatch")], "artifact string, status string")
    got = {r["revision"]: (r["originals"], r["available"], r["reasons"]) for r in bindings.revision_ledger(revisions, artifacts).collect()}
    none = ([], [], ["revision_original_material_missing"])
    assert got == {"r1": (["x", "y"], [True, False], ["revision_original_material_unavailable"]), "r2": none, "r3": none, "r4": (["x"], [True], [])}


def test_assay_evidence(spark):
    t = "trial string, assay string, attempt string, event string"
    trials = spark.createDataFrame([(k, "a", k + "1", "seen") for k in "uvwx"], t)
    attempts = spark.createDataFrame([("u1", "x"), ("v1", "x"), ("w1", "y"), ("x1", "x")], "attempt string, artifact string")
    artifacts = spark.createDataFrame([("x", "snapshot_read"), ("y", "missing")], "artifact string, status string")
    said = spark.createDataFrame([(k, "a", k + "1", "seen" if k != "v" else "other", "observation", True, k != "x") for k in "uvwx"], t + ", purpose string, assertion boolean, sound boolean")
    assert {r["trial"]: r["determinate"] for r in bindings.determinate_failures(trials, attempts, artifacts, said).collect()} == {"u": True, "v": False, "w": False, "x": False}
    assays = spark.createDataFrame([("a", "d", "b"), ("c", "d2", "b"), ("e", "d", None)], "assay string, design string, basis string")
    basis = spark.createDataFrame([("b", "a", "d", True, *[True] * 5, None)], "basis string, assay string, design string, supported boolean, " + ", ".join(f"{a} boolean" for a in bindings.ASSUMPTIONS))
    short = f"assay_assumption_{bindings.ASSUMPTIONS[-1]}_unsupported"
    assert {r["assay"]: r["reasons"] for r in bindings.iid_basis(assays, basis).collect()} == {"a": [short], "c": [short, "assay_iid_binding_mismatch"], "e": ["assay_iid_basis_missing"]}


def test_controls_registrations_and_carriers(spark):
    rows = [("temperature", 1.0, 1.0, 1.0, True, "recorded", True), ("temperature", 1.0, None, 0.5, True, "recorded", True), ("temperature", 1.0, 1.0, None, True, "recorded", True), ("frequency_penalty", 0.0, None, None, False, "unsupported", False), ("temperature", 1.0, 1.0, 1.0, True, "hidden", True)]
    t = spark.createDataFrame(rows, "name string, expected double, requested double, actual double, exposed boolean, enforcement string, supported boolean")
    assert [r["fact"] for r in bindings.control_facts(t).collect()] == ["record_consistent", "inconsistent", "unresolved", "not_applicable", "unresolved"]
    fits = spark.createDataFrame([("a", "x", None), ("b", "x", ""), ("c", "x", "1")], "request string, mode string, stop string")
    digest = {r["request"]: r["d"] for r in fits.select("request", bindings.design_digest(["mode", "stop"]).alias("d")).collect()}
    assert len(set(digest.values())) == 3
    seen = spark.createDataFrame([("a", digest["a"], "why", "registered_before_inspection"), ("b", digest["a"], " ", "after")], "request string, digest string, rationale string, inspection string")
    got = {r["request"]: r["reasons"] for r in bindings.registration_facts(fits, seen, ["stop", "mode"]).collect()}
    assert got == {"a": [], "b": ["fit_registration_binding_mismatch", "fit_registration_not_prespecified", "fit_residual_rationale_missing"], "c": ["fit_registration_binding_missing"]}
    a = spark.createDataFrame([(1, 0.1 + 0.2), (2, 1.0), (3, None), (4, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 0.3), (2, 1.1), (3, None), (5, 2.0)], "k int, v double")
    assert {r["k"]: r["difference"] for r in bindings.carrier_differences(a, b, ["k"], "v").collect()} == {2: "value_mismatch", 4: "not_produced", 5: "not_staged"}


def test_operands_and_contrasts(spark):
    values = spark.createDataFrame([("a", "v", "m", None, 3.0), ("b", "v", "m", None, 1.0), ("c", "v", "m", None, 9.0), ("d", "v", "m", None, None)], "cell string, view string, metric string, k int, value double")
    cells = spark.createDataFrame([(c, "v", ["s1", "s2"], ["p:1"]) for c in "abd"], "cell string, view string, ids array<string>, pins array<string>")
    got = {r["cell"]: (r["value"], r["status"], r["population"], r["reasons"]) for r in bindings.operands(values, cells).collect()}
    assert got == {"a": (3.0, "available", 2, []), "b": (1.0, "available", 2, []), "c": (None, "unavailable", None, ["expected_cell_unavailable"]), "d": (None, "unavailable", 2, ["operand_value_absent"])}
    pairs = spark.createDataFrame([("ab", "a", "b", True), ("ba", "b", "a", False), ("cd", "c", "d", True)], "pair string, left string, right string, compatible boolean")
    got = {r["pair"]: (r["difference"], r["reasons"]) for r in bindings.contrasts(pairs, bindings.operands(values, cells)).collect()}
    assert got == {"ab": (2.0, []), "ba": (None, ["comparison_incompatible"]), "cd": (None, ["expected_cell_unavailable", "operand_value_absent"])}


def test_evidence_facts(spark):
    own = spark.createDataFrame([("c", "h")], "comparison string, digest string")
    got = spark.createDataFrame([("c", "registration", True, "h", 1, 2, None)], "comparison string, group string, sound boolean, digest string, registered int, inspected int, collected int")
    facts = {r["name"]: r["status"] for r in bindings.evidence_facts(own, got, ["registration", "exposure"]).collect()}
    assert facts == {"evidence_registration": "record_consistent", "evidence_exposure": "unresolved", "registration_binding": "record_consistent", "registration_before_first_inspected": "record_consistent", "registration_before_first_collected": "unresolved"}


def test_readiness_and_reviews(spark):
    own = spark.createDataFrame([("a", "ready", None), ("b", "ready", ["x"]), ("c", "not_ready", ["x", "x"])], "activity string, state string, outstanding array<string>")
    rows = spark.createDataFrame([("a", "x", True, "satisfied_for_scope"), ("b", "x", True, "not_applicable"), ("c", "x", False, "unresolved")], "activity string, requirement string, mandatory boolean, outcome string")
    got = {r["activity"]: (r["outstanding"], r["problems"]) for r in bindings.readiness_problems(own, rows).collect()}
    assert got == {"a": ([], []), "b": (["x"], ["mandatory_requirement_not_applicable", "ready_with_outstanding_requirements"]), "c": ([], ["duplicate_value", "outstanding_requirements_contradiction"])}
    fields = "review string, artifact string, sha256 string, reviewer string, assignment string, class string, stage string, initial string"
    reviews = spark.createDataFrame([("r1", "a", "h", "p", "assigned", "k", "initial", None), ("r2", "a", "h", "p", "withheld", None, "revision", "r1"), ("r3", "a", "g", "q", "assigned", None, "revision", "r1"), ("r4", "a", "h", "p", "assigned", "k", "initial", "r9")], fields)
    got = {r["review"]: r["problems"] for r in bindings.review_problems(reviews, spark.createDataFrame([("a", "h")], "artifact string, sha256 string")).collect()}
    assert got == {"r1": [], "r2": [], "r3": ["artifact_hash_mismatch", "assignment_contradiction", "initial_submission_contradiction"], "r4": ["initial_submission_unresolved", "submission_stage_contradiction"]}
