import hashlib
import json

import pytest

from prismet.functions.canonical import InputProblem
from prismet.plans import analysis
from prismet.sources import bundle, sinks

K = lambda v: {"state": "known", "value": v, "evidence_refs": []}
CLASSES = ["SORT-MERGE"] * 8 + ["SORT-PIVOT"] * 6 + ["SORT-HEAP"] * 3 + ["SORT-COUNT"] * 2 + ["SORT-RADIX"]
ORDER = [0, 8, 14, 17, 1, 19, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 15, 16, 18]


U = {"state": "unknown"}
REF = lambda kind, k: {"record_type": kind, "record_id": k, "record_version": "0.1"}


def evidence_record(k, target, outcome, **changes):
    payload = {
        "payload_version": "0.1", "data_role": "fixture", "mock": True, "state": "active", "scope_refs": [REF("frame", "f1")], "origin": K("fixture"), "knowledge_type": U, "transformation_refs": [], "evidence_refs": [],
        "target_ref": target, "purpose": "fixture_declaration", "assertion": K(outcome), "method": K("declared"), "detail": K("as planned"), "artifact_refs": [], "reviewer_refs": [], "subject_hash": U, "access": "readable", "conflict_status": "none_declared",
    }
    return {"record_type": "evidence", "record_version": "0.1", "record_id": k, "payload": payload | changes}


def write_bundle(path, change=lambda kind, r: r, extra=()):
    rows = []
    for place, k in enumerate(ORDER, 1):
        s = f"s{place}"
        rows += [
            {"record_type": "realization", "record_id": s, "sample_id": s, "analysis_cell_id": "cell1", "attempt_id": K(f"call{(place - 1) // 5 + 1}"), "generation_group_id": K("g"), "within_group_index": K((place - 1) % 5 + 1), "sample_order": K(place), "completion_status": "complete"},
            {"record_type": "assignment", "record_id": f"a{place}", "assignment_id": f"a{place}", "assignment_version": "0.1", "sample_id": s, "frame_id": "f1", "assignment_status": "assigned", "structural_class_id": CLASSES[k], "assignment_review_status": "fixture", "decision_rationale": K("declared"), "evidence_refs": [REF("evidence", f"ea{place}")], "assignment_evidence_policy_id": "fixture_only", "assignment_evidence_policy_version": "0.1", "supersedes_assignment_id": {"state": "unknown"}},
            {"record_type": "validity", "record_id": f"v{place}", "validity_id": f"v{place}", "validity_version": "0.1", "sample_id": s, "validity_status": "valid", "validity_review_status": "fixture", "evidence_refs": [REF("evidence", f"ev{place}")], "decision_rationale": K("declared"), "supersedes_validity_id": {"state": "unknown"}},
            evidence_record(f"ea{place}", REF("assignment", f"a{place}"), CLASSES[k]), evidence_record(f"ev{place}", REF("validity", f"v{place}"), "valid"),
        ]
    rows += [{"record_type": "attempt", "record_id": f"call{k}", "attempt_id": f"call{k}", "analysis_cell_id": "cell1", "attempt_status": "completed"} for k in range(1, 5)]
    rows = [{"record_version": "0.1"} | change(r["record_type"], r) for r in rows] + list(extra)
    ids = [f"s{k}" for k in range(1, 21)]
    manifest = {
        "input_schema_version": "0.1", "bundle_id": "b", "data_role": "fixture", "record_files": [{"path": "records.jsonl", "format": "jsonl"}],
        "frames": [{"record_type": "frame", "record_id": "f1", "record_version": "0.1", "frame_id": "f1"}], "protocols": [], "cells": [{"record_type": "cell", "record_id": "cell1", "record_version": "0.1", "analysis_cell_id": "cell1", "frame_id": "f1"}],
        "analysis_config": {
            "assignment_evidence_policy_id": "fixture_only", "empirical_threshold": "0.10", "requested_k": [5, 10, 20],
            "selection": [{"analysis_cell_id": "cell1", "selected_sample_ids": K(ids), "sample_order": K(ids)}],
            "assignment_pins": [{"sample_id": f"s{k}", "assignment_id": f"a{k}", "assignment_version": "0.1"} for k in range(1, 21)], "validity_pins": [{"sample_id": f"s{k}", "validity_id": f"v{k}", "validity_version": "0.1"} for k in range(1, 21)],
        },
    }
    (path / "bundle.json").write_text(json.dumps(manifest))
    (path / "records.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    return f"file://{path}"


def test_whole_bundle(spark, tmp_path):
    out = analysis.analyze(spark, write_bundle(tmp_path))
    rows = {r["view"]: r for r in out.metrics.collect()}
    for view in ("classified_all", "classified_valid"):
        r = rows[view]
        assert (r["population"], r["support"], r["threshold_support"], r["sci_num"], r["sci_den"]) == (20, 5, 4, 114, 400)
        assert round(r["entropy"], 12) == round(1.3923212547574291, 12)
    assert {(r["view"], r["k"]): r["distinct_k"] for r in out.prefixes.collect()} == {(v, k): n for v in ("classified_all", "classified_valid") for k, n in ((5, 4), (10, 5), (20, 5))}
    assert out.exit_code == 0 and out.coverage.first()["classification_coverage"]["value"] == 1.0
    report = sinks.render_json(out.sections())
    assert report == sinks.render_json(analysis.analyze(spark, f"file://{tmp_path}").sections())
    assert sinks.render_markdown(out.sections()).count("\n\n## ") == 7


def test_one_changed_fact_has_scoped_effects(spark, tmp_path):
    def change(kind, r):
        return r | {"assignment_review_status": "provisional"} if r["record_id"] == "a20" else r

    out = analysis.analyze(spark, write_bundle(tmp_path, change))
    rows = {r["view"]: r["population"] for r in out.metrics.collect()}
    assert rows == {"classified_all": 19, "classified_valid": 19}
    assert [r["reason"] for r in out.admissions.where("axis = 'assignment' AND status <> 'accepted'").collect()] == ["provisional_judgment"]
    assert out.coverage.first()["classification_coverage"]["value"] == 0.95


def _withheld(spark, path, change=lambda kind, r: r, extra=()):
    out = analysis.analyze(spark, write_bundle(path, change, extra))
    return {(r["axis"], r["sample_id"]): r["reason"] for r in out.admissions.where("status <> 'accepted'").collect()}, out


def test_evidence_that_is_not_sound_withholds_its_label_only(spark, tmp_path):
    place = {c: str(CLASSES[k]) for c, k in enumerate(ORDER, 1)}
    target = lambda k: REF("assignment", f"a{k}")
    fresh = {
        "ea2": {"state": "withdrawn"}, "ea3": {"target_ref": target(4)}, "ea4": {"scope_refs": []}, "ea5": {"assertion": K("SORT-RADIX-X")}, "ea6": {"conflict_status": "unresolved"}, "ea7": {"purpose": "mechanism"},
        "ea8": {"detail": K("  ")}, "ea9": {"data_role": "pilot"}, "ea10": {"evidence_refs": [REF("evidence", "ring1")]}, "ea11": {"evidence_refs": [REF("evidence", "behind")]}, "ea12": {"evidence_refs": [REF("evidence", "nowhere")]},
        "ea13": {"evidence_refs": [REF("source", "nowhere")]}, "ea14": {"artifact_refs": [REF("artifact", "gone")]}, "ea15": {"artifact_refs": [REF("artifact", "other")]}, "ea16": {"artifact_refs": [REF("artifact", "whole")]}, "ea17": {"access": "withheld"},
    }

    def change(kind, r):
        if r["record_id"] in fresh:
            return r | {"payload": r["payload"] | fresh[r["record_id"]]}
        return r | {"evidence_refs": [REF("evidence", "dangling")]} if r["record_id"] == "a1" else r

    artifact = lambda k, path, sha: {"record_type": "artifact", "record_version": "0.1", "record_id": k, "artifact_id": k, "content_ref": K({"kind": "local", "path": path, "locator": None}), "expected_sha256": K(sha)}
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.txt").write_text("x")
    sha = hashlib.sha256(b"x").hexdigest()
    extra = [
        evidence_record("ring1", target(10), place[10], evidence_refs=[REF("evidence", "ring2")]), evidence_record("ring2", target(10), place[10], evidence_refs=[REF("evidence", "ring1"), REF("evidence", "behind")]),
        evidence_record("behind", target(11), place[11]), artifact("gone", "files/none.txt", sha), artifact("other", "files/x.txt", "0" * 64), artifact("whole", "files/x.txt", sha),
    ]
    got, out = _withheld(spark, tmp_path, change, extra)
    unread = "essential_artifact_unreadable_or_mismatched"
    assert got == {("assignment", f"s{k}"): why for k, why in {
        1: "essential_evidence_unresolved", 2: "essential_evidence_not_active_or_readable,upstream_evidence_not_active", 3: "evidence_target_mismatch", 4: "evidence_frame_mismatch", 5: "evidence_assertion_mismatch", 6: "evidence_contradiction,upstream_evidence_unreadable_or_conflicted", 7: "evidence_property_mismatch",
        8: "missing_evidence_detail", 9: "fixture_evidence_role_mismatch", 10: "circular_evidence_support", 12: "essential_evidence_unresolved", 13: "essential_reference_missing", 14: unread, 15: unread, 17: "essential_evidence_not_active_or_readable,upstream_evidence_unreadable_or_conflicted",
    }.items()}
    assert {r["view"]: r["population"] for r in out.metrics.collect()} == {"classified_all": 5, "classified_valid": 5}
    assert {tuple(r["restrictions"]) for r in out.admissions.where("status = 'accepted'").collect()} == {("knowledge_type_unknown",)}


def test_corrections_histories_and_outputs_withhold(spark, tmp_path):
    common = {"payload_version": "0.1", "data_role": "fixture", "mock": True, "state": "active", "scope_refs": [], "origin": U, "knowledge_type": U, "transformation_refs": [], "evidence_refs": [REF("source", "src")]}
    record = lambda kind, k, **p: {"record_type": kind, "record_version": "0.1", "record_id": k, "payload": common | p}
    fix = lambda k, target, **p: record("correction", k, **({"target_refs": [target], "effect": "membership", "action": "withdraw", "stage": "applied", "replacement_refs": [], "reviewer_refs": [REF("role", "r")], "event_type": "correction", "prior_result_ids": [], "reason": K("why")} | p))
    extra = [
        record("role", "r", entity_id=U, entity_type="human", role="reviewer", method=U, qualification=U, exposure_refs=[], evidence_refs=[]), record("source", "src", source_id="src", sha256=U, locator=U, evidence_refs=[]),
        fix("c1", REF("assignment", "a1")), fix("c2", REF("assignment", "a2"), reviewer_refs=[REF("role", "nobody")]), fix("c3", REF("assignment", "a3"), action="annotate"), fix("c4", REF("assignment", "a4"), stage="rejected"),
        fix("c5", REF("realization", "s5")), fix("c6", REF("evidence", "ea6")), fix("c7", REF("validity", "v7"), effect="validity"),
        {"record_type": "assignment", "record_version": "0.1", "record_id": "old", "assignment_id": "old", "assignment_version": "0.1", "sample_id": "s9", "frame_id": "f1", "assignment_status": "unresolved", "supersedes_assignment_id": K("older")},
        {"record_type": "assignment", "record_version": "0.1", "record_id": "older", "assignment_id": "older", "assignment_version": "0.1", "sample_id": "s9", "frame_id": "f1", "assignment_status": "unresolved", "supersedes_assignment_id": K("old")},
        {"record_type": "artifact", "record_version": "0.1", "record_id": "out", "artifact_id": "out", "content_ref": K({"kind": "local", "path": "x.txt"}), "expected_sha256": U},
    ]
    (tmp_path / "x.txt").write_text("x")
    changes = {"a8": {"supersedes_assignment_id": K("never")}, "a9": {"supersedes_assignment_id": K("old")}, "s10": {"output_ref": K(REF("artifact", "out")), "output_content_hash": K("0" * 64)}, "v11": {"validity_rubric_ref": K("other")}}
    got, _ = _withheld(spark, tmp_path, lambda kind, r: r | changes.get(r["record_id"], {}), extra)
    assert got == {
        ("assignment", "s1"): "correction_applied:c1", ("assignment", "s2"): "correction_pending:c2", ("assignment", "s5"): "correction_applied:c5", ("assignment", "s6"): "correction_applied:c6", ("validity", "s7"): "correction_applied:c7",
        ("assignment", "s8"): "revision_history_unresolved", ("assignment", "s9"): "cyclic_revision_history", ("assignment", "s10"): "sample_artifact_identity_mismatch", ("validity", "s10"): "sample_artifact_identity_mismatch", ("validity", "s11"): "validity_rubric_mismatch",
    }


def test_payload_shapes_and_record_cap(spark, tmp_path):
    bad = [evidence_record("b1", None, "x"), evidence_record("b2", None, "x", more=1), evidence_record("b3", None, "x", state="fine")]
    del bad[0]["payload"]["access"]
    root = write_bundle(tmp_path, extra=bad)
    assert {(r["record_id"], r["problem"]) for r in bundle.load_bundle(spark, root).problems.collect()} == {("b1", "missing_support_field"), ("b2", "unknown_support_field"), ("b3", "invalid_support_field")}
    with pytest.raises(InputProblem, match="record_count_exceeded"):
        bundle.load_bundle(spark, root, max_records=50)


def test_validate_computes_nothing(spark, tmp_path):
    lost = lambda kind, r: r | {"attempt_id": K("nowhere")} if r["record_id"] == "s1" else r
    got = analysis.validate(spark, write_bundle(tmp_path, lost))
    assert got.profile == "measurement" and got.exit_code == 0
    assert [(r["record_type"], r["record_id"], r["problem"]) for r in got.problems.collect()] == [("realization", "s1", "reference_missing")]
    assert {r["record_type"]: (r["records"], r["malformed"]) for r in got.rows.collect()} == {"frame": (1, 0), "cell": (1, 0), "attempt": (4, 0), "realization": (20, 0), "assignment": (20, 0), "validity": (20, 0), "evidence": (40, 0)}
    bad = [{"record_type": "artifact", "record_version": "0.1", "record_id": "g", "artifact_id": "g", "content_ref": K({"kind": "local", "path": "none.txt"}), "expected_sha256": U}]
    assert analysis.validate(spark, write_bundle(tmp_path, extra=bad)).exit_code == 2
    assert analysis.profile({"analysis_config": {"extensions": {"comparison": None, "longitudinal": 3}}}) == "longitudinal"
    assert analysis.profile({"analysis_config": {"extensions": {"comparison": None}}}) == "comparison" and analysis.profile({}) == "measurement"


def test_bad_lines_are_rows(spark, tmp_path):
    root = write_bundle(tmp_path)
    with (tmp_path / "records.jsonl").open("a") as f:
        f.write('{"record_type":"realization","record_type":"x"}\n{"record_type":"mystery","record_version":"0.1","record_id":"m"}\n')
        f.write(json.dumps({"record_type": "realization", "record_version": "0.1", "record_id": "s1", "sample_id": "s1", "analysis_cell_id": "cell1"}) + "\n")
    b = bundle.load_bundle(spark, root)
    assert sorted(r["problem"] for r in b.problems.collect()) == ["duplicate_json_key", "duplicate_record_identity", "unsupported_record_type"]
    out = analysis.analyze(spark, root)
    assert out.exit_code == 2 and [r["reason"] for r in out.admissions.where("sample_id = 's1' AND axis = 'assignment'").collect()] == ["sample_identity_unresolved"]


@pytest.mark.parametrize("path", ["../x", "/x", "a//b", "a\\b", "$HOME/x", "a/\x01", "", "."])
def test_unsafe_paths(path):
    with pytest.raises(InputProblem):
        bundle.relative_parts(path)


def test_publish_never_overwrites(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    sinks.publish_files(spark, {"report.json": b"{}\n", "report.md": b"# x\n"}, target)
    assert (tmp_path / "out/report.json").read_bytes() == b"{}\n"
    with pytest.raises(FileExistsError):
        sinks.publish_files(spark, {"report.json": b"1"}, target)


def test_redaction_and_blinding(spark):
    df = spark.createDataFrame([("k1", "secret words"), ("k2", None)], "key string, note string")
    got = {r["key"]: r["note"]["state"] for r in sinks.redacted(df, ["note"]).collect()}
    assert got == {"k1": "redacted", "k2": "absent"}
    blind, secret = sinks.blind_export(df, "key", 7)
    assert "key" not in blind.columns and {r["pseudonym"] for r in blind.collect()} == {r["pseudonym"] for r in secret.collect()}


def test_live_recurrence(spark, tmp_path):
    from prismet.streaming import live

    rows = [("u", "c", 0, True), ("u", "c", 1, False), ("u", "c", 2, True), ("u", "c", 3, None), ("u", "c", 4, True)]
    spark.createDataFrame(rows, "unit string, class string, state long, observed boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("unit string, class string, state long, observed boolean").parquet(f"{tmp_path}/in")
    q = live.live_recurrence(stream).writeStream.format("memory").queryName("recur").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [r["recurrence"] for r in spark.table("recur").orderBy("state").collect()] == ["first_observed", "absent", "observed_reappearance", "gap", "observed_after_gap"]
