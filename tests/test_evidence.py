import json
from fractions import Fraction
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from prismet.functions.canonical import InputProblem
from prismet.functions.exact import exact_operand
from prismet.functions.status import difference, ratio
from prismet.operators import assay, compare, evidence, longitudinal, text_pairs
from prismet.operators import study as operators
from prismet.sources import study
from prismet.streaming import live


def test_schema_interpreter():
    roster = {"packet_id": "p", "reviewers": [{"person_id": "a", "roles": ["r"], "independent": {"state": "unknown"}}]}
    assert study.parse_packet("reviewer_roster", json.dumps(roster).encode())[1] == []
    roster["reviewers"][0] |= {"extra": 1, "independent": {"state": "unavailable"}}
    del roster["reviewers"][0]["roles"]
    codes = sorted(p.code for p in study.parse_packet("reviewer_roster", json.dumps(roster).encode())[1])
    assert codes == ["knowledge_reason_missing", "missing_field", "unknown_field"]
    assert study.check("integer", True) and study.check("positive", 0) and not study.check("timestamp", "2024-01-01T00:00:00Z") and study.check("timestamp", "2024-01-01T00:00:00")
    assert study.check({"choice": ["integer", "boolean"]}, "x") and not study.check({"literal": 1}, 1) and study.check({"literal": 1}, True)


def test_study_inventory(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json").write_text("[]")
    item = lambda k, path, data: {"packet_id": k, "packet_type": "reviewer_roster", "path": path, "sha256": sha256(data).hexdigest()}
    envelope = {"study_id": "s", "study_version": "0.1", "evidence_policy": "fixture_only", "material_role": "fixture", "packet_inventory": [item("a", "a.json", b"{}"), item("b", "b.json", b"x"), item("c", "c.json", b"")]}
    (tmp_path / "study.json").write_text(json.dumps(envelope))
    _, rows = study.load_study(spark, f"file://{tmp_path}")
    assert {r["packet_id"]: r["status"] for r in rows.collect()} == {"a": "verified", "b": "mismatch", "c": "missing"}
    (tmp_path / "study.json").write_text(json.dumps(envelope | {"material_role": "other"}))
    with pytest.raises(InputProblem, match="invalid_enum"):
        study.load_study(spark, f"file://{tmp_path}")


def test_domain_results(spark):
    want = spark.createDataFrame([(s, c) for s in "abcd" for c in ("x", "y")], "suite string, case_id string")
    got = spark.createDataFrame([("a", "x", True), ("a", "y", True), ("b", "x", False), ("c", "x", True), ("d", "x", True), ("d", "x", True), ("d", "y", True)], "suite string, case_id string, passed boolean")
    assert {r["suite"]: r["state"] for r in evidence.domain_results(want, got, ["suite"]).collect()} == {"a": "passed", "b": "violated", "c": "incomplete", "d": "conflicting"}


def test_walk_finds_bad_and_circular_evidence(spark):
    links = spark.createDataFrame([("d1", "e1"), ("e1", "e2"), ("d2", "e3"), ("e3", "e4"), ("e4", "e3"), ("d3", "e5")], "src string, dst string")
    out = evidence.decisive_walk(spark.createDataFrame([("d1",), ("d2",), ("d3",)], "decision string"), links, spark.createDataFrame([("e2",)], "node string"))
    assert {r["decision"]: r["problems"] for r in out.collect()} == {"d1": ["dependent_evidence_unavailable"], "d2": ["circular_evidence_support"], "d3": []}


def test_claims_gates_and_sets(spark):
    rows = [("k", c, "met", True) for c in evidence.INTEGRITY] + [("l", c, "met" if c != "tail_retention" else "open", True) for c in evidence.INTEGRITY] + [("m", "tail_retention", "met", True)]
    got = {r["claim"]: (r["disposition"], r["open_conditions"]) for r in evidence.integrity_claims(spark.createDataFrame(rows, "claim string, condition string, state string, current boolean")).collect()}
    assert got == {"k": ("supported_for_scope", []), "l": ("restricted", ["tail_retention"]), "m": ("withheld", [])}
    t = spark.createDataFrame([("2024-01-01T00:00:00Z", "2024-01-01T01:00:00+01:00"), ("2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z"), ("2024-01-01", "2024-01-01T00:00:00Z")], "a string, b string")
    assert [r["g"] for r in t.select(evidence.registration_gate(F.col("a"), F.col("b")).alias("g")).collect()] == ["passed", "failed", "unresolved"]
    x, y = (spark.createDataFrame([(c,) for c in s], "k string") for s in ("aab", "abb"))
    assert {r["k"]: (r["left_n"], r["right_n"]) for r in evidence.multiset_differences(x, y, ["k"]).collect()} == {"a": (2, 1), "b": (1, 2)}
    assert evidence.pair_coverage(spark.createDataFrame([("b", "a")], "a string, b string"), list("abcdefgh")).groupBy("covered").count().orderBy("covered").collect()[0]["count"] == 27
    w = evidence.regime_restrictions(spark.createDataFrame([("t", 1, 3)], "trajectory string, first int, last int"), spark.createDataFrame([("t", 1, "recut"), ("t", 2, "intervention")], "trajectory string, at int, kind string"))
    assert w.first()["restrictions"] == ["intervention"]
    assert len(evidence.software_identity()) == 64


def test_observed_union(spark):
    rows = [("f", "X", "success", []), ("f", "X", "success", None), ("f", "Y", "failure", []), ("f", "Z", "success", ["restricted"]), ("g", "X", "undetermined", [])]
    out = assay.observed_union(spark.createDataFrame(rows, "family string, class string, outcome string, reasons array<string>"), "family")
    assert {r["family"]: (r["classes"], r["size"]) for r in out.collect()} == {"f": (["X"], 1), "g": ([], 0)}


def test_budget_is_shared_in_order(spark):
    rows = [(f"c{k:02}", [f"i{j}" for j in range(4)]) for k in range(30) for _ in range(3)]
    sets = spark.createDataFrame(rows, "cell string, items array<string>")
    held, status = text_pairs.affordable(sets, 3, 24 * 7, ["cell"])  # three sets of four items: 3 pairs, 24 visits a cell
    assert sorted(r["cell"] for r in status.where("status = 'available'").collect()) == [f"c{k:02}" for k in range(7)] and held.count() == 21
    assert text_pairs.affordable(sets, 2, 10**9, ["cell"])[0].count() == 0


def test_log_order_and_eligibility(spark):
    want = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)], "id string, at int")
    got = spark.createDataFrame([("a", 10), ("c", 20), ("b", 30), ("e", 40), ("e", 41), ("x", 50)], "id string, at int")
    assert {r["id"]: r["coverage"] for r in operators.log_coverage(want, got, "id", "at").collect()} == {"a": "once", "b": "once", "c": "out_of_order", "d": "missing", "e": "duplicate", "x": "unexpected"}
    plan = spark.createDataFrame([("c", g, i) for g in (1, 2) for i in (1, 2)], "cell string, group int, index int")
    ledger = spark.createDataFrame([("c", 1, 1, True), ("c", 1, 2, False), ("c", 1, 2, True), ("c", 2, 2, True)], "cell string, group int, index int, emitted boolean")
    r = operators.collection_eligibility(plan, ledger, "cell", "group", "index", [1, 2, 3]).first()
    assert (r["groups"], r["complete_groups"], r["prefix"], r["eligible"]) == (2, 1, 2, [1, 2])


def test_roots_need_one_grid_and_values_one_unit(spark):
    rows = [("r", 0, 1.0), ("r", 1, 2.0), ("s", 0, 3.0), ("s", 1, 4.0)]
    run = lambda rows: {r["state"]: (r["mean"], r["status"]) for r in longitudinal.root_curve(spark.createDataFrame(rows, "root string, state int, mean double"), 2).collect()}
    assert run(rows) == {0: (2.0, "available"), 1: (3.0, "available")}
    assert run(rows[:3]) == {0: (None, "unavailable"), 1: (None, "unavailable")}
    df = spark.createDataFrame([("s", "s"), ("s", "h"), ("s", None)], "a string, b string")
    five, two = (ratio(F.lit(n), F.lit(1)) for n in (5, 2))
    got = df.select(difference(five, two, F.col("a"), F.col("b")).alias("d")).collect()
    assert [(r["d"]["value"], r["d"]["status"], r["d"]["reasons"]) for r in got] == [(3.0, "available", []), (None, "unavailable", ["unit_mismatch"]), (None, "unavailable", ["unit_mismatch"])]


def test_live_counts_late_rows_and_replayed_batches(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "c", "X"), ("2024-01-01 11:00:00", "c", "X"), ("2024-01-02 10:00:00", "c", "Y"), ("2024-01-05 00:00:00", "c", "Z")]
    schema = "at timestamp, cell string, class string"
    spark.createDataFrame(rows, "at string, cell string, class string").select(F.to_timestamp("at").alias("at"), "cell", "class").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = live.windowed_counts(stream, "at", "cell", "class").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {(str(r["window"]["start"].date()), r["class"], r["n"]) for r in spark.table("counts").collect()} == {("2024-01-01", "X", 2), ("2024-01-02", "Y", 1)}, "the last window is still open"
    late = live.late_rows(spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "at int, reg int"), "at", "reg")
    assert [r["registered_late"] for r in late.orderBy("at").collect()] == [True, False, False]
    sink = live.idempotent_sink(f"{tmp_path}/out")
    for n in (0, 1, 1):
        sink(spark.range(3), n)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


def test_live_recurrence_flags_what_comes_late(spark, tmp_path):
    schema = "unit string, class string, state long, observed boolean"
    for n, rows in enumerate(([("u", "c", 1, True), ("u", "c", 3, False)], [("u", "c", 2, True), ("u", "c", 4, True)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = live.live_recurrence(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start(f"{tmp_path}/out")
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r["state"]: r["recurrence"] for r in got} == {1: "first_observed", 3: "absent", 2: "out_of_order", 4: "observed_reappearance"}


def test_evidence_scope_of_comparisons(spark):
    head = "comparison string, material_role string, reanalysis boolean, fixture_context boolean, restricted boolean, scopes array<string>"
    own = ["cell:c", "frame:f"]
    rows = [(k, "confirmatory", False, False, False, own) for k in ("whole", "far", "bare", "mocked", "late", "coded")] + [("fixed", "confirmatory", False, False, False, ["cell:x"]), ("again", "pilot", True, False, True, own), ("toy", "fixture", False, True, False, own), ("toy2", "fixture", False, False, False, own)]
    facts = []
    for k in ("whole", "far", "mocked", "late", "coded", "fixed", "again"):
        at = ["cell:x"] if k == "fixed" else own[:1]
        for g in compare.EVIDENCE_GROUPS:
            for n in range(3 if g == "registration" else 1):
                sound = "unresolved" if k == "late" and g == "registration" and n == 2 else "record_consistent"
                facts.append((k, g, "audit" if g == "core_audit" else "evidence", sound, k == "mocked" and g == "exposure", ["cell:other"] if k == "far" and g == "integrity" else at, ["independence_not_supported"] if k == "coded" and g == "independence" else None))
    facts.append(("toy2", "registration", "evidence", "record_consistent", False, own, None))
    facts = spark.createDataFrame(facts, "comparison string, group string, record_type string, status string, mock boolean, scopes array<string>, codes array<string>")
    corrected = spark.createDataFrame([("cell:x", ["correction_applied:k"])], "target string, codes array<string>")
    got = {r["comparison"]: (r["status"], r["reasons"]) for r in compare.evidence_scope(spark.createDataFrame(rows, head), facts, corrected).collect()}
    assert got == {
        "whole": ("passed", []), "far": ("unresolved", ["integrity_scope_not_established"]), "mocked": ("unresolved", ["exposure_record_limited"]), "late": ("unresolved", ["prospective_registration_unresolved", "registration_record_limited"]),
        "bare": ("unresolved", sorted([f"{g}_not_supplied" for g in compare.EVIDENCE_GROUPS] + ["actual_sample_audit_not_supplied", "prospective_registration_unresolved"])), "coded": ("unresolved", ["independence_not_supported"]), "fixed": ("unresolved", ["active_evidence_correction"]),
        "again": ("unresolved", ["admission_claim_restrictions", "nonconfirmatory_or_reanalysis_scope", "reanalysis_not_new_confirmation"]), "toy": ("fixture_stipulated", ["fixture_only_no_empirical_validation"]),
        "toy2": ("unresolved", ["fixture_admission_context_missing", "fixture_only_no_empirical_validation", "supplied_fixture_registration_unresolved"]),
    }


def test_exact_operands():
    third = 1 / 3
    assert exact_operand(third, (1, 3)) == (Fraction(1, 3), None) and exact_operand(0.5, None) == (Fraction(1, 2), None)
    assert [exact_operand(*x)[1] for x in ((None, None), (float("inf"), None), (1.0, (1, 0)), (0.3, (1, 3)), (0.0, (1, 10**400)))] == ["uncertainty_operand_unavailable", "nonfinite_uncertainty_operand", "invalid_exact_uncertainty_ratio", "numerical_sign_or_representation_instability", "numerical_sign_or_representation_instability"]
    assert exact_operand(third, (1, 3), bits=1)[1] == "uncertainty_exact_limit_exceeded"


def test_bytes_of_spans(spark):
    from prismet.operators import admission

    raw = "aé\nxyz".encode()
    contents = [("raw:1", raw), ("out:a", raw[1:4]), ("out:b", b"xyz"), ("out:c", b""), ("out:d", b"z"), ("out:e", b"z"), ("out:e", b"z"), ("raw:2", None)]
    cases = {
        "match": ("raw:1", "out:a", True, 1, 4, "bytes_match", None), "other": ("raw:1", "out:b", True, 1, 4, "mismatch", "extraction_span_mismatch"), "empty": ("raw:1", "out:c", True, 2, 2, "bytes_match", None), "tail": ("raw:1", "out:d", True, 6, 7, "bytes_match", None),
        "beyond": ("raw:1", "out:d", True, 6, 9, "mismatch", "extraction_span_mismatch"), "back": ("raw:1", "out:a", True, 4, 1, "unavailable", "invalid_extraction_span"), "shape": ("raw:1", "out:a", True, None, None, "unavailable", "invalid_extraction_span"),
        "twice": ("raw:1", "out:e", True, 6, 7, "unavailable", None), "unread": ("raw:2", "out:a", True, 1, 4, "unavailable", None), "none": ("raw:1", "out:a", False, None, None, "not_supplied", None),
    }
    rows = spark.createDataFrame([(k, *c[:5]) for k, c in cases.items()], "sample_id string, raw string, output string, supplied boolean, byte_start long, byte_end long")
    got = {r["sample_id"]: (r["span"], r["defect"]) for r in admission.extraction_spans(rows, spark.createDataFrame(contents, "key string, content binary")).collect()}
    assert got == {k: c[5:] for k, c in cases.items()}
