"""The longitudinal profile of whole bundles: a sound declaration has no problem, one change has its own and no other."""

import copy
import json

import pytest

from prismet.plans import longitudinal
from tests.test_bundle import REF, K, U, write_bundle

E = {k: [] for k in ("origin", "process", "independence", "validation", "review", "correction")}


def obj(kind, ident):
    return {"object_kind": kind, "object_id": ident, "object_version": "1"}


def declaration():
    done = E | {"process": [REF("evidence", "ea1")]}
    cell = {"cell_ref": REF("cell", "cell1"), "frame_ref": REF("frame", "f1"), "protocol_ref": REF("protocol", "p1"), "registry_ref": REF("reference_registry", "sorting_reference_eight")}
    plan = {"view": "classified_all", "planned_realizations": K(20), "selection_rule": K("all")}
    states = [obj("state", f"m{k}") | {"evidence": E, "state_kind": "model_system", "stage_role": "probe_output", "state_time": K(f"2026-01-0{k + 1}T00:00:00+00:00"), "subject_identity": K({"parameter_identity": K("theta") if k == 1 else U, "checkpoint_sha256": K(str(k) * 64)}), "ancestor_refs": K([obj("state", f"m{j}") for j in range(k)]), "measurement_refs": [obj("measurement", "x1")] if k == 1 else []} for k in range(4)]
    step = lambda k, **more: obj("transition", f"t{k}") | {"evidence": done, "transition_kind": "learning_update", "parent_refs": K([obj("state", f"m{k - 1}")]), "child_ref": obj("state", f"m{k}"), "round_distance": K(1), "event_time": U, "process_status": "completed", "effective_change": K(True), "parameter_change": K(True), "retained_parameters": U, "retained_data_refs": U, "contributions": [], "external_contribution_refs": [], "component_refs": []} | more
    slot = lambda k, status, m: {"state_ref": obj("state", f"m{k}"), "panel_ref": obj("panel", "pa"), "recursive_round_index": K(k), "observation_status": status, "measurement_ref": m, "reason": K("by design"), "evidence": E}
    return {
        "profile": "any_longitudinal_v1", "method_id": "longitudinal_records_v1", "states": states,
        "panels": [obj("panel", "pa") | {"evidence": E, "stage_role": "probe_output", **{k: v for k, v in cell.items() if k != "cell_ref"}, **plan}],
        "measurements": [obj("measurement", "x1") | {"evidence": E, "state_ref": obj("state", "m1"), "panel_ref": K(obj("panel", "pa")), "data_role": "fixture", "sample_refs": K([REF("realization", f"s{k}") for k in range(1, 21)]), "budget_ref": U, **cell, **plan}],
        "transitions": [step(k) for k in (1, 2, 3)] + [step(9, transition_kind="composite", parent_refs=K([obj("state", "m0")]), child_ref=obj("state", "m2"), round_distance=K(2), component_refs=[obj("transition", "t1"), obj("transition", "t2")])],
        "trajectories": [obj("trajectory", "j") | {"evidence": E, "state_refs": [obj("state", f"m{k}") for k in range(4)], "transition_refs": [obj("transition", f"t{k}") for k in (1, 2, 3)], "round_coordinates": [K(k) for k in range(4)], "panel_refs": [obj("panel", "pa")], "root_ref": obj("root", "r"), "schedule": [slot(0, "intentionally_unsampled", U), slot(1, "observed", K(obj("measurement", "x1"))), slot(2, "missing", U), slot(3, "planned", U)], "registration_ref": U}],
        "roots": [obj("root", "r") | {"evidence": E, "ancestor_refs": U, "dependency_group": U, "independence_ref": U}],
        "shl_requests": [obj("shl_request", "h") | {"evidence": E, "trajectory_ref": obj("trajectory", "j"), "start_ref": obj("state", "m0"), "end_ref": obj("state", "m3"), "view": "classified_all"}],
        "observed_requests": [obj("observed_request", "o") | {"evidence": E, "state_refs": [obj("state", "m1")], "trajectory_ref": U, "view": "classified_all", "protected_tail_ref": K(REF("tail", "tail1"))}],
    }


def support(kind, ident, **payload):
    base = {"payload_version": "0.1", "data_role": "fixture", "mock": True, "state": "active", "scope_refs": [], "origin": U, "knowledge_type": U, "transformation_refs": [], "evidence_refs": []}
    return {"record_type": kind, "record_version": "0.1", "record_id": ident, "payload": base | payload}


def bundle(path, change=lambda d: None):
    tail = lambda k, refs, **more: support("tail", k, class_id=K("SORT-RADIX"), designation=K("rare"), basis=K("seen once"), reference_refs=[REF("reference_registry", "sorting_reference_eight"), *refs], review_refs=[REF("evidence", "ea1")], disposition=K("protected"), extensions={"longitudinal_tail": {"registration_ref": REF("preregistration", "pre")}}, **more)
    extra = [
        {"record_type": "protocol", "record_version": "0.1", "record_id": "p1", "generation_protocol_id": "p1"}, {"record_type": "reference_registry", "record_version": "0.1", "record_id": "sorting_reference_eight", "reference_registry_id": "sorting_reference_eight"},
        support("preregistration", "pre", registration_id="pre", registered_at=K("2025-12-01T00:00:00+00:00"), material_refs=[REF("tail", "tail1"), REF("tail", "tail2")]), tail("tail1", [REF("tail", "tail2")]), tail("tail2", [REF("tail", "tail1")]),
    ]
    root = write_bundle(path, extra=extra)
    manifest = json.loads((path / "bundle.json").read_text())
    manifest["frames"][0]["reference_registry_id"] = "sorting_reference_eight"
    manifest["cells"][0] |= {"generation_protocol_id": "p1", "checkpoint_identifier": K("theta")}
    manifest["analysis_config"]["selection"][0]["selection_basis"] = K("all")
    d = copy.deepcopy(declaration())
    change(d)
    manifest["analysis_config"]["extensions"] = {"longitudinal": d}
    (path / "bundle.json").write_text(json.dumps(manifest))
    return root


def told(out):
    return {(r["key"], r["code"]) for r in out.problems.collect()}


def test_sound_declaration(spark, tmp_path):
    out = longitudinal.review(spark, bundle(tmp_path))
    assert told(out) == set() and out.exit_code == 0
    clock = out.clocks.first()
    assert (clock["request"], clock["start_at"], clock["end_at"], clock["rounds"], clock["reasons"]) == ("shl_request:h:1", 0, 3, 3, [])
    assert [(r["tail"], r["codes"], r["availability"]) for r in out.members.orderBy("place").collect()] == [("tail:tail1", [], "records_available_only"), ("tail:tail2", [], "records_available_only")]
    assert [(r["status"], r["reasons"]) for r in out.gates.collect()] == [("eligible", [])]


def test_no_declaration(spark, tmp_path):
    assert longitudinal.review(spark, write_bundle(tmp_path)) is None


def t(d, k):
    return next(x for x in d["transitions"] if x["object_id"] == k)


def several(*changes):
    return lambda d: [c(d) for c in changes]


CHANGES = {
    "a step is not done, and two states are cut off": (
        lambda d: t(d, "t2").update(process_status="running"),
        {("transition:t2:1", "transition_not_completed"), ("transition:t3:1", "ancestral_transition_unresolved"), ("transition:t9:1", "composite_stage_not_documented"), ("trajectory:j:1", "trajectory_lineage_restricted")}, ["transition_history_unresolved", "recursive_distance_mismatch"],
    ),
    "another branch, and a clock that runs ahead": (
        several(lambda d: t(d, "t3").update(parent_refs=K([obj("state", "m1")])), lambda d: d["trajectories"][0]["round_coordinates"].__setitem__(3, K(5))),
        {("trajectory:j:1", c) for c in ("selected_branch_path_mismatch", "trajectory_clock_distance_mismatch", "observation_clock_mismatch")}, ["selected_branch_mismatch", "recursive_distance_mismatch"],
    ),
    "another model, panel, root, tail and slot": (
        several(
            lambda d: d["states"][1]["subject_identity"]["value"].update(parameter_identity=K("other")), lambda d: d["panels"][0].update(selection_rule=K("first")), lambda d: d["roots"].append(d["roots"][0]),
            lambda d: d["observed_requests"][0].update(protected_tail_ref=K(REF("tail", "zz"))), lambda d: d["trajectories"][0]["schedule"][3].update(measurement_ref=K(obj("measurement", "x1"))),
        ),
        {("measurement:x1:1", "measurement_model_state_mismatch"), ("measurement:x1:1", "panel_binding_mismatch"), ("root:r:1", "duplicate_object_identity"), ("observed_request:o:1", "core_reference_unresolved"), *[("trajectory:j:1", c) for c in ("scheduled_measurement_limited", "object_reference_unresolved", "measurement_on_unobserved_slot")]}, [],
    ),
    "a cycle": (lambda d: t(d, "t1").update(parent_refs=K([obj("state", "m3")])), None, None),
}


@pytest.mark.parametrize("name", CHANGES)
def test_changes_have_their_own_problems_only(spark, tmp_path, name):
    change, codes, reasons = CHANGES[name]
    out = longitudinal.review(spark, bundle(tmp_path, change))
    if codes is None:
        found = {c for _, c in told(out)}
        assert {"reproduction_cycle_or_descendant", "backward_state_time", "trajectory_lineage_restricted"} <= found and out.exit_code == 2
        return
    assert told(out) == codes
    assert sorted(out.clocks.first()["reasons"]) == sorted(reasons)
    if "tail" in name:
        assert [(r["status"], r["reasons"]) for r in out.gates.collect()] == [("unresolved", ["tail_record_unavailable"])]
