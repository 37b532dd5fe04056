"""Lineages against walks in plain Python: levels, carried faults, composites, paths, clocks, tail ledgers."""

import random
from collections import deque

from prismet.operators import lineage


def test_levels_are_longest_ways_and_cycles_have_none(spark):
    rng = random.Random(3)
    edges = {(a, b) for a in range(60) for b in [rng.randrange(60) for _ in range(2)] if a < b} | {(70, 71), (71, 72), (72, 70), (72, 73), (5, 73)}
    nodes = sorted({n for e in edges for n in e} | {99})
    want, parents = {}, {n: [a for a, b in edges if b == n] for n in nodes}

    def level(n):
        if n not in want:
            want[n] = max((level(p) + 1 for p in parents[n]), default=0)
        return want[n]

    for n in nodes:
        if n < 70 or n == 99:
            level(n)
    df = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")
    got = {int(r["node"]): r["level"] for r in lineage.levels(spark.createDataFrame([(str(n),) for n in nodes], "node string"), df).collect()}
    assert got == {n: want.get(n) if n not in (70, 71, 72, 73) else None for n in nodes}


def test_faults_reach_all_descendants(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(12)] + [("n3", "x"), ("x", "n9"), ("y", "n12")], "src string, dst string")
    got = {r["node"] for r in lineage.carried(spark.createDataFrame([("n8",), ("x",)], "node string"), edges).collect()}
    assert got == {"n8", "x", "n9", "n10", "n11", "n12"}


STATES = "state string, kind string, checkpoint string, time int, ancestors array<string>"
STEPS = "transition string, child string, kind string, process_status string, documented boolean, distance int, parameter_change boolean, event_time int, parents_known boolean, has_components boolean"


def test_steps(spark):
    states = [(f"m{k}", "model_system", f"c{k}", k, None) for k in range(6)] + [("corpus", "corpus", None, 3, ["m9"]), ("late", "model_system", "c1", 9, ["m1", "m2"])]
    base = {"kind": "learning_update", "process_status": "completed", "documented": True, "distance": 1, "parameter_change": True, "event_time": None, "parents_known": True, "has_components": False}
    cases = {
        "fine": ({"child": "m1"}, ["m0"], [], []),
        "open": ({"child": "m2", "process_status": "running", "documented": False, "distance": None}, ["m1"], [], ["recursive_distance_unknown", "transition_not_completed", "transition_process_evidence_missing"]),
        "unknown": ({"child": "m3", "parents_known": False}, [], [], ["transition_parents_unknown"]),
        "far": ({"child": "m4", "distance": 2}, ["m0", "m0"], [], ["duplicate_parent", "merge_contributions_incomplete", "single_transition_distance_must_be_one"]),
        "timeless": ({"child": "m5", "kind": "inference_configuration", "distance": 1}, ["m0"], [], ["fixed_parameter_intervention_changed_parameters", "nonreproduction_clock_increment"]),
        "merge": ({"child": "late", "event_time": 10}, ["m1", "m2"], ["m2", "m7", "m7"], ["contribution_not_a_parent", "duplicate_parent_contribution", "event_outside_state_times", "merge_contributions_incomplete", "parameter_change_identity_conflict"]),
        "wrong": ({"child": "corpus"}, ["m4"], [], ["backward_state_time", "child_parent_declaration_conflict", "learning_target_not_model_state"]),
        "kinds": ({"child": "corpus", "kind": "curation", "distance": 0, "parameter_change": False}, ["gone"], [], ["transition_parent_unresolved"]),
        "loop": ({"child": "nowhere", "has_components": True}, ["nowhere"], [], ["components_on_noncomposite", "reproduction_self_cycle", "transition_child_unresolved", "transition_parent_unresolved"]),
    }
    rows = [tuple({"transition": k, **base, **c}[f.split()[0]] for f in STEPS.split(", ")) for k, (c, _, _, _) in cases.items()]
    pair = lambda n: spark.createDataFrame([(k, p) for k, c in cases.items() for p in c[n]], "transition string, parent string")
    got = {r["transition"]: r["codes"] for r in lineage.step_problems(spark.createDataFrame(rows, STEPS), pair(1), pair(2), spark.createDataFrame(states, STATES)).collect()}
    for k, (_, _, _, codes) in cases.items():
        assert [c for c in got.get(k, []) if c != "ambiguous_producing_transition"] == codes, k
    assert "ambiguous_producing_transition" in got["wrong"] and "ambiguous_producing_transition" in got["kinds"]


def test_composites(spark):
    base = ("learning_update", "completed", True)
    rows = [("s1", "b", *base, 1), ("s2", "c", *base, 1), ("s3", "d", *base, None), ("bad", "c", "learning_update", "running", True, 1), ("nest", "e", "composite", "completed", True, 2)]
    whole = {"ok": ("c", 2, ["s1", "s2"]), "short": ("c", 3, ["s1", "s2"]), "swap": ("b", 2, ["s2", "s1"]), "none": ("c", 1, []), "gone": ("c", 1, ["s1", "zz", "s2"]), "inner": ("e", 3, ["s1", "nest"]), "far": ("d", 3, ["s1", "s3"]), "twice": ("b", 2, ["s1", "s1"]), "weak": ("c", 2, ["s1", "bad"])}
    rows += [(k, child, "composite", "completed", True, d) for k, (child, d, _) in whole.items()]
    parents = [("s1", "a"), ("s2", "b"), ("s3", "b"), ("bad", "b"), ("nest", "b"), *[(k, "a") for k in whole]]
    parts = [(k, n, p) for k, (_, _, ps) in whole.items() for n, p in enumerate(ps)]
    t = spark.createDataFrame(rows, "transition string, child string, kind string, process_status string, documented boolean, distance int")
    out = lineage.composite_problems(t, spark.createDataFrame(parents, "transition string, parent string"), spark.createDataFrame(parts, "transition string, place int, part string"), spark.createDataFrame([("bad",)], "transition string"))
    assert {r["transition"]: r["codes"] for r in out.collect()} == {
        "short": ["composite_distance_or_child_mismatch"], "swap": ["composite_parent_mismatch", "composite_stage_path_mismatch"], "none": ["composite_stages_missing"], "nest": ["composite_stages_missing"], "gone": ["composite_stage_unresolved"],
        "inner": ["nested_composite_not_supported"], "far": ["composite_distance_unknown"], "twice": ["composite_stage_path_mismatch", "duplicate_composite_stage"], "weak": ["composite_stage_not_documented"],
    }


def test_paths_and_clocks(spark):
    t = spark.createDataFrame([("t1", "b", 1, True), ("t2", "c", 1, True), ("t3", "d", None, True), ("t4", "x", 1, True), ("t5", "c", 1, False)], "transition string, child string, distance int, sound boolean")
    parents = spark.createDataFrame([("t1", "a"), ("t2", "b"), ("t3", "c"), ("t4", "a"), ("t5", "b")], "transition string, parent string")
    paths = {"ok": (["a", "b", "c"], [0, 1, 2], ["t1", "t2"]), "skew": (["a", "b", "c"], [0, 1, 3], ["t1", "t2"]), "far": (["a", "b", "c", "d"], [0, 1, 2, 3], ["t1", "t2", "t3"]), "astray": (["a", "b", "c"], [0, 1, None], ["t4", "t2"]), "weak": (["a", "b", "c"], [5, 6, 7], ["t1", "t5"]), "odd": (["a", "b"], [0, 1], ["t1", "t1"]), "gone": (["a", "b"], [0, 1], ["t9"])}
    rows = spark.createDataFrame([(k, n, s, c) for k, (ss, cs, _) in paths.items() for n, (s, c) in enumerate(zip(ss, cs, strict=True))], "trajectory string, place int, state string, coordinate int")
    steps = spark.createDataFrame([(k, n, e) for k, (_, _, es) in paths.items() for n, e in enumerate(es)], "trajectory string, place int, transition string")
    got = {r["trajectory"]: r["codes"] for r in lineage.path_problems(rows, steps, t, parents, spark.createDataFrame([("d",)], "state string")).collect()}
    assert got == {"skew": ["trajectory_clock_distance_mismatch"], "far": ["trajectory_lineage_restricted"], "astray": ["selected_branch_path_mismatch", "trajectory_clock_unresolved"], "odd": ["trajectory_path_lengths", "trajectory_repeated_transition"], "gone": ["trajectory_transition_unresolved"]}
    asked = [("ok", "a", "c"), ("ok", "c", "a"), ("ok", "a", "zz"), ("skew", "a", "c"), ("skew", "a", "b"), ("far", "a", "d"), ("far", "a", "c"), ("astray", "a", "b"), ("astray", "b", "c"), ("weak", "a", "c"), ("weak", "a", "b")]
    q = spark.createDataFrame([(f"{k}{s}{e}", k, s, e) for k, s, e in asked], "request string, trajectory string, start string, end string")
    clocks = {r["request"]: (r["rounds"], r["reasons"]) for r in lineage.elapsed(rows, steps, t, parents, q).collect()}
    assert clocks == {
        "okac": (2, []), "okca": (None, ["selected_path_order_mismatch"]), "okazz": (None, ["selected_path_order_mismatch"]), "skewac": (None, ["recursive_distance_mismatch"]), "skewab": (1, []), "farad": (None, ["recursive_distance_mismatch", "recursive_distance_unresolved"]), "farac": (2, []),
        "astrayab": (None, ["selected_branch_mismatch"]), "astraybc": (None, ["recursive_distance_unresolved"]), "weakac": (None, ["recursive_distance_mismatch", "transition_history_unresolved"]), "weakab": (1, []),
    }


def test_tail_ledger_walks_first_in_first_out(spark):
    links = {"a": ["b", "c"], "b": ["d", "a"], "c": ["e", "d"], "d": ["f"], "e": [], "f": ["c"], "z": ["z", "gone"]}
    good = dict(class_known=True, designation="rare", basis="seen", state="active", disposition="protected", registries=["r1"], registered=True, registration="p1", listed=True, reviews=1, reviews_readable=1, mock=False)
    odd = {"d": dict(disposition="open"), "e": dict(registries=["r2"], designation=" ", reviews=2), "f": dict(registered=False, listed=False, reviews=0, reviews_readable=0)}
    tails = spark.createDataFrame([(k, *{**good, **odd.get(k, {})}.values()) for k in links], "tail string, class_known boolean, designation string, basis string, state string, disposition string, registries array<string>, registered boolean, registration string, listed boolean, reviews int, reviews_readable int, mock boolean")
    edges = spark.createDataFrame([(k, n, v) for k, vs in links.items() for n, v in enumerate(vs)], "tail string, place int, target string")
    asked = spark.createDataFrame([("q1", "a", "r1"), ("q2", "z", "r1"), ("q3", None, "r1"), ("q4", "b", None)], "request string, tail string, registry string")

    def walk(start):
        seen, queue = [], deque([start])
        while queue:
            x = queue.popleft()
            if x not in seen:
                seen.append(x)
                queue.extend(links.get(x, []))
        return seen

    members, gates = lineage.tail_ledger(asked, tails, edges, limit=50)
    got = {}
    for r in sorted(members.collect(), key=lambda r: r["place"]):
        got.setdefault(r["request"], []).append(r["tail"])
    assert got == {"q1": walk("a"), "q2": walk("z"), "q4": walk("b")}
    codes = {(r["request"], r["tail"]): (r["codes"], r["availability"]) for r in members.collect()}
    assert codes["q1", "e"] == (["tail_designation_unresolved", "tail_registry_mismatch_or_missing"], "unavailable") and codes["q1", "f"] == (["registration_unresolved", "tail_not_in_registered_materials"], "not_supplied") and codes["q2", "gone"] == (["tail_record_unavailable"], "unavailable") and codes["q4", "e"][0] == ["tail_designation_unresolved"]
    assert {r["request"]: (r["status"], r["reasons"]) for r in gates.collect()}["q3"] == ("not_requested", ["protected_tail_not_declared"])
    _, few = lineage.tail_ledger(asked, tails, edges, limit=3)
    by = {r["request"]: r["reasons"] for r in few.collect()}
    assert "tail_link_limit" in by["q1"] and "tail_link_limit" not in by["q2"]
