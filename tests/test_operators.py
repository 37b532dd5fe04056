import json
import math
from fractions import Fraction
from itertools import product

import pytest
from pyspark.sql import functions as F

from prismet.functions import canonical, exact, status, text
from prismet.operators import admission, assay, compare, graph, longitudinal, null_model, responses, study, text_pairs


def test_tokens_and_trigrams():
    assert text.lexical_units("a_1 b-c\r\nd") == ["a_1", "b", "-", "c", "d"]
    assert text.lexical_units("  ") == [] and text.lexical_units("x​y") == ["x", "​", "y"]
    assert len(text.trigrams(["a"])) == 1 and len(text.trigrams(["a", "b"])) == 2 and text.trigrams(["a", "a", "a", "a"]) == text.trigrams(["a"] * 5)


def test_tokenization_statuses(spark):
    df = spark.createDataFrame([(b"ab c",), (b"",), (b" \n",), (b"\xff",), (None,)], "t binary").select(text.tokenized("t").alias("k"))
    assert [(r["k"]["status"], r["k"]["reasons"]) for r in df.collect()] == [("eligible", []), ("ineligible", ["empty_emitted_text"]), ("ineligible", ["whitespace_only_text"]), ("ineligible", ["invalid_utf8"]), ("ineligible", ["empty_emitted_text"])]


def test_pair_distances_against_enumeration(spark):
    sets = {("c", k): set(s) for k, s in enumerate(["abc", "abd", "xyz", "ab", "a"])} | {("d", 9): {"a"}}
    df = spark.createDataFrame([(c, k, sorted(s)) for (c, k), s in sets.items()], "cell string, ident int, items array<string>")
    near = text_pairs.pair_distances(df, "cell", "ident")
    for r in near.collect():
        a, b = sets[(r["cell"], r["a"])], sets[(r["cell"], r["b"])]
        assert math.isclose(r["distance"], 1 - len(a & b) / len(a | b))
    own = [s for (c, _), s in sets.items() if c == "c"]
    want = sum(1 - len(a & b) / len(a | b) for i, a in enumerate(own) for b in own[i + 1 :]) / 10
    got = {r["cell"]: r for r in text_pairs.surface_means(df, near, "cell").collect()}
    assert math.isclose(got["c"]["mean_distance"], want) and got["d"]["status"] == "undefined"


def test_binomial_tails_against_enumeration():
    tau = Fraction(1, 3)
    for n in range(1, 7):
        for low in range(n + 1):
            chance = lambda s: math.prod((tau if x else 1 - tau) for x in s)
            up = sum(chance(s) for s in product((0, 1), repeat=n) if sum(s) >= low)
            down = sum(chance(s) for s in product((0, 1), repeat=n) if sum(s) <= low)
            assert exact.tails(n, low, low, tau) == (up, down)


def test_threshold_decision_boundaries():
    assert exact.threshold_decision(1, 1, 1, Fraction(1, 2), Fraction(1), 1)[0] == "threshold_present"  # equality counts
    assert exact.threshold_decision(1, 0, 0, Fraction(1, 2), Fraction(1), 1)[0] == "unresolved"  # strictly smaller needed
    assert exact.threshold_decision(0, 0, 0, Fraction(1, 2), Fraction(1), 1)[0] == "unavailable"
    assert exact.tails(5, 5, 4, Fraction(1)) == (1, 0)


def test_assay_roll_ups(spark):
    t = spark.createDataFrame([("k", "completed", "k", False), ("k", "completed", "z", False), ("k", "completed", None, False), ("k", "refused", None, True)], "class string, completion string, observed_class string, scoped_declaration boolean")
    cells = assay.rollup(assay.trial_outcomes(t), ["class"])
    assert cells.first().asDict() == {"class": "k", "trials": 4, "low": 1, "high": 2}
    assert assay.decisions(cells, "1/2", "1/20", 4).first()["status"] == "unresolved"
    s = spark.createDataFrame([("a", "threshold_present"), ("a", "unresolved"), ("b", "threshold_below"), ("b", "threshold_below"), ("c", "unavailable"), ("d", "threshold_below"), ("d", "unresolved")], "class string, status string")
    assert {r["class"]: r["status"] for r in assay.class_status(s, ["class"]).collect()} == {"a": "threshold_present", "b": "threshold_below", "c": "unavailable", "d": "unresolved"}


def test_recovery_cases(spark):
    names = list("abcdefgh")
    pre = [("x", c, "threshold_below" if c in "gh" else "threshold_present") for c in names]
    post = [("x", c, "threshold_below" if c == "h" else "threshold_present") for c in names]
    case = lambda a, b: assay.recovery(spark.createDataFrame(a, "u string, class string, status string"), spark.createDataFrame(b, "u string, class string, status string"), ["u"]).first()
    r = case(pre, post)
    assert (r["missing"], r["recovered"], r["rate"], r["status"]) == (2, 1, 0.5, "available")
    assert case([(u, c, "threshold_present") for u, c, _ in pre], post)["status"] == "undefined"
    r = case(pre, [(u, c, "unresolved" if c == "h" else s) for u, c, s in post])
    assert (r["rate"], r["low"], r["high"], r["status"]) == (None, 0.5, 1.0, "unavailable")
    assert case([("x", "a", "unresolved"), *pre[1:]], post)["status"] == "unavailable"


def test_set_changes(spark):
    rows = spark.createDataFrame([("u", 1, ["a", "b"]), ("u", 2, ["b", "c"]), ("u", 3, []), ("u", 4, ["a"])], "unit string, state int, classes array<string>")
    got = {r["to_state"]: r for r in longitudinal.consecutive_changes(rows, "unit", "state").collect()}
    assert (got[2]["retained"], got[2]["became_unobserved"], got[2]["newly_observed"], got[2]["retention"]) == (["b"], ["a"], ["c"], 0.5)
    assert got[4]["status"] == "undefined" and got[4]["retention"] is None


def _machine(seen):
    out, ever, absent, gap = [], False, False, False
    for x in seen:
        if x is None:
            out.append("gap")
            gap = True
        elif not x:
            out.append("absent")
            absent = True
        else:
            out.append("first_observed" if not ever else "observed_reappearance" if absent else "observed_after_gap" if gap else "observed")
            ever, absent, gap = True, False, False
    return out


def test_recurrence_machine(spark):
    paths = list(product([True, False, None], repeat=5))
    rows = [(str(k), s, x) for k, p in enumerate(paths) for s, x in enumerate(p)]
    got = {}
    for r in longitudinal.recurrence(spark.createDataFrame(rows, "unit string, state int, observed boolean"), ["unit"], "state").collect():
        got.setdefault(int(r["unit"]), {})[r["state"]] = r["recurrence"]
    assert [[got[k][s] for s in range(5)] for k in range(len(paths))] == [_machine(p) for p in paths]
    moved = spark.createDataFrame([("u", 1, True, "a"), ("u", 2, True, "b")], "unit string, state int, observed boolean, frame string")
    assert [r["recurrence"] for r in longitudinal.recurrence(moved, ["unit"], "state", identity="frame").orderBy("state").collect()] == ["first_observed", "first_observed"]


def test_half_lives(spark):
    d = [1 / 2, 135 / 512, 15 / 128, 31 / 512]
    curve = spark.createDataFrame([("u", k, x) for k, x in enumerate(d)], "unit string, t int, value double")
    fit = longitudinal.anchored_fit(curve, "unit", "t", "value").first()
    beta = sum(k * math.log(x / d[0]) for k, x in enumerate(d)) / 14
    assert math.isclose(fit["beta"], beta) and math.isclose(fit["half_life"], 0.98267582667, rel_tol=1e-9) and fit["status"] == "available"
    assert longitudinal.anchored_fit(curve, "unit", "t", "value", criterion=1e-6).first()["status"] == "unavailable"
    assert longitudinal.anchored_fit(curve.where("t < 3"), "unit", "t", "value").first()["status"] == "unavailable"
    c = longitudinal.first_crossing(curve, "unit", "t", "value").first()
    assert (c["crossing"], c["last_above"], c["gaps"]) == (2, 1, 0)
    p = spark.createDataFrame([(1, 0.5, 0.25), (1, 0.5, 0.5), (1, 0.5, 0.6), (1, 0.0, 0.5), (1, 0.5, 0.0)], "dt int, a double, b double")
    assert [r["half_life_status"] for r in longitudinal.interval_half_life(p, "dt", "a", "b").collect()] == ["available", "undefined_no_decay", "undefined_growth", "undefined_zero_start", "undefined_zero_end"]


def test_fixed_mean_is_all_or_nothing(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 0.7), (2, 0.5), (2, None)], "state int, value double")
    got = {r["state"]: (r["mean"], r["status"]) for r in longitudinal.fixed_mean(rows, ["state"], "value", 2).collect()}
    assert math.isclose(got[1][0], 0.6) and got[2] == (None, "unavailable")


def test_null_model(spark):
    for n in (2, 3, 10, 97):
        t = next(t for t in range(1, 200) if Fraction(n - 1, n) ** t <= Fraction(1, 2))
        assert exact.first_crossing(n) == t == exact.first_crossing([n] * 200)
    assert exact.first_crossing(1) == 1
    row = null_model.null_half_life(spark.createDataFrame([("s", 1)], "scenario string, n long")).first()
    assert row["half_life"] is None and row["first_crossing"] == 1
    path = spark.createDataFrame([("p", 0, "a", 2), ("p", 0, "b", 0), ("p", 1, "a", 1), ("p", 1, "b", 1), ("p", 2, "a", 2), ("p", 2, "b", 0)], "k string, t int, class string, n int")
    got = {r["t"]: (r["inconsistent"], r["classes"], r["evaluated"]) for r in null_model.path_consistency(path, "k", "t").collect()}
    assert got == {0: (False, [], True), 1: (True, ["b"], True), 2: (False, [], False)}


def test_replay_is_the_seeded_generator():
    import hashlib
    import random

    rows = compare.replay_indices(6)
    rng = random.Random(20260917)
    assert rows[0] == [rng.randrange(6) for _ in range(6)] and len(rows) == 2000
    assert hashlib.sha256(json.dumps(rows, separators=(",", ":")).encode()).hexdigest().startswith("a1014f66") or len(compare._digest(rows)) == 64
    replay = compare.make_replay(["b1", "b2"])
    assert compare.validate_replay(replay, ["b1", "b2"]) == []
    assert "replay_digest" in compare.validate_replay(replay | {"seed": 1}, ["b1", "b2"]) and "replay_constants" in compare.validate_replay(replay | {"seed": 1}, ["b1", "b2"])


def test_exact_percentile():
    v = [Fraction(j, 1999) for j in range(2000)]
    assert exact.percentile(v, Fraction(1, 40)) == Fraction(1, 40) and exact.percentile(v, Fraction(39, 40)) == Fraction(39, 40)
    assert compare.exact_interval([Fraction(1)] * 3, compare.replay_indices(3)) == (1, 1)


@pytest.mark.parametrize(("mean", "low", "high", "blocked", "want"), [(1.0, 0.1, 2.0, False, "supporting"), (1.0, 0.0, 2.0, False, "inconclusive"), (-1.0, -2.0, -0.1, False, "contrary"), (-1.0, -2.0, 0.0, False, "inconclusive"), (None, 0.1, 2.0, False, "not_evaluated"), (1.0, 0.1, 2.0, True, "not_evaluated")])
def test_verdicts(spark, mean, low, high, blocked, want):
    row = spark.createDataFrame([(mean, low, high, blocked)], "m double, l double, h double, b boolean")
    assert row.select(compare.verdict(F.col("m"), F.col("l"), F.col("h"), F.col("b")).alias("v")).first()["v"] == want


def test_gates_at_their_boundaries(spark):
    df = spark.createDataFrame([(9, 10), (89, 100), (0, 0), (None, 3)], "a long, b long")
    assert [r["g"] for r in df.select(exact.gate(F.col("a"), F.col("b"), (9, 10)).alias("g")).collect()] == ["passed", "failed", "unresolved", "unresolved"]


def test_status_difference(spark):
    one = status.ratio(F.col("a"), F.col("b"))
    df = spark.createDataFrame([(1, 2, 1, 4), (1, 0, 1, 4), (1, None, 1, 0)], "a long, b long, c long, d long").select(status.difference(one, status.ratio(F.col("c"), F.col("d"))).alias("r"))
    assert [(r["r"]["value"], r["r"]["status"]) for r in df.collect()] == [(0.25, "available"), (None, "undefined"), (None, "unavailable")]


def test_closure_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    got = {(r["node"], r["depth"]) for r in graph.closure(spark.createDataFrame([("a", "a")], "origin string, node string"), edges).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    nodes = spark.createDataFrame([(n,) for n in "abcdxy"], "node string")
    assert {r["node"] for r in graph.cyclic_nodes(nodes, edges).collect()} == set("abcd")


def test_identity_and_references(spark):
    r = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, v int")
    assert [x["id"] for x in admission.unique_lookup(r, ["id"]).collect()] == ["b"]
    refs = spark.createDataFrame([("s", "f", "cell", "a", None), ("s", "f", "cell", "b", None), ("s", "f", "cell", "z", None), ("s", "f", "cell", "b", "frame")], "source string, field string, target_type string, target_id string, expected_type string")
    targets = r.select(F.lit("cell").alias("target_type"), F.col("id").alias("target_id"))
    assert sorted(x["problem"] for x in admission.reference_problems(refs, targets).collect()) == ["reference_ambiguous", "reference_missing", "reference_type_mismatch"]


def test_admission_cascade(spark):
    s = spark.createDataFrame([(f"s{k}", "f") for k in range(1, 9)] + [("s9", "nope")], "sample_id string, frame_id string")
    rec = lambda k, **o: {"id": f"a{k}", "version": "0.1", "sample_id": f"s{k}", "frame_id": "f", "label_status": "assigned", "label": "X", "review": "fixture", "policy": "fixture_only", "supersedes": None, "rationale": "because", "evidence": [f"evidence:e{k}"]} | o
    records = [rec(1), rec(2, review="provisional"), rec(3, label="Q"), rec(4, evidence=[]), rec(5, label_status="unresolved"), rec(6), rec(9, id="a66", sample_id="s6", supersedes="a6"), rec(7, version="9"), rec(9)]
    schema = "id string, version string, sample_id string, frame_id string, label_status string, label string, review string, policy string, supersedes string, rationale string, evidence array<string>"
    pins = spark.createDataFrame([(f"s{k}", f"a{k}", "0.1") for k in (1, 2, 3, 4, 5, 6, 7, 9)] + [("s1", "a1", "0.1")][:0], "sample_id string, id string, version string")
    none = spark.createDataFrame([], "correction_id string, stage string, effect string, targets array<string>")
    text = ["record_type", "state", "access", "conflict", "data_role", "purpose", "target", "assertion", "detail", "method", "subject_hash", "origin", "knowledge_type", "outcome", "decision_state"]
    lists = ["scopes", "reviewers", "evidence", "artifacts", "basis", "disagreements"]
    fields = {"record_type": "evidence", "state": "active", "access": "readable", "data_role": "fixture", "purpose": "fixture_declaration", "assertion": "X", "detail": "seen", "scopes": ["frame:f"]}
    support = spark.createDataFrame([{"key": f"evidence:e{k}", "mock": False, **{c: [] for c in lists}, **fields, "target": f"assignment:a{k}"} for k in range(1, 10)], "key string, mock boolean, " + ", ".join([f"{c} string" for c in text] + [f"{c} array<string>" for c in lists]))
    base = {"support": support, "keys": support.select("key"), "artifacts": spark.createDataFrame([], "key string, status string")}
    run = lambda corrections: {r["sample_id"]: (r["status"], r["reason"]) for r in admission.admit("assignment", s, spark.createDataFrame([tuple(x.values()) for x in records], schema), pins, spark.createDataFrame([("f",)], "frame_id string"), corrections, **base, policy="fixture_only", data_role="fixture", classes=["X", "Y"]).collect()}
    assert run(none) == {
        "s1": ("accepted", None), "s2": ("withheld", "provisional_judgment"), "s3": ("withheld", "class_outside_pinned_schema"), "s4": ("withheld", "missing_essential_evidence"),
        "s5": ("unresolved", "no_committed_class"), "s6": ("withheld", "selected_revision_superseded"), "s7": ("withheld", "selected_revision_mismatch"), "s8": ("missing", "revision_not_pinned"), "s9": ("withheld", "essential_frame_unresolved"),
    }
    fix = spark.createDataFrame([("c1", "applied", "membership", ["assignment:a1"])], none.schema)
    assert run(fix)["s1"] == ("withheld", "correction_applied:c1")


RESPONSE = b"### Candidate 1\n```python\na = 1\n```\n### Candidate 2\nprose\n```python\nb\n```\n### Candidate 3\n```js\nc\n```\n### Candidate 5\n```python\nopen\n"


def _extracted(spark, *raws):
    df = spark.createDataFrame([(k, bytearray(r) if r is not None else None) for k, r in enumerate(raws)], "id int, text binary")
    return [r for r in responses.receipts(df).orderBy("id").collect()]


def _section(k, body=b"pass\n", closed=True):
    return b"### Candidate %d\n```python\n" % k + body + (b"```\n" if closed else b"")


def test_response_extraction(spark):
    five = b"".join(_section(k, b"# %d\n" % k) for k in range(1, 6))
    raws = [
        RESPONSE, RESPONSE + b"```\n### Candidate 1\n", b"\xff", b"### Candidate 1\n```python\nx\n### Candidate 2\n", None, five, b"Here.\n" + five,
        five + _section(6), b"".join(_section(k) for k in (2, 1, 3, 4, 5)), b"   ### Candidate 1  \r\n  ~~~~ Python\t\r\n# x\r\n  ~~~~~ \r\n",
        b"### Candidate 01\n```python\npass\n```\n", _section(1, b"a\n```\r\r\nb\n"), b"\xef\xbb\xbf" + five, "### Candidate 1\né\n```python\n\u4e2d\n```\n".encode(), _section(1, b""),
        _section(1, b'"""\n### Candidate 2\n"""\n') + _section(2),
    ]
    got = _extracted(spark, *raws)
    p = [{x["position"]: x for x in r["positions"]} for r in got]
    body = lambda n, k: raws[n][p[n][k]["start"] : p[n][k]["end"]]
    assert [[x["position"] for x in r["positions"]] for r in got] == [[1, 2, 3, 4, 5]] * len(raws)
    assert (p[0][1]["selection"], p[0][1]["status"], body(0, 1), p[0][1]["limitations"]) == ("selected", "complete", b"a = 1\n", [])
    assert p[0][2]["limitations"] == ["prose_outside_code_fence"] and (p[0][3]["status"], p[0][3]["limitations"], p[0][3]["fence"]) == ("failed", ["non_python_code_fence"], "```js")
    assert p[0][4]["selection"] == "missing" and p[0][5]["status"] == "truncated" and body(0, 5) == b"open\n"
    assert p[1][1]["selection"] == "withheld" and p[1][2]["selection"] == "selected" and [e["reason"] for e in got[1]["extras"]] == ["ambiguous_position_occurrence"] * 2
    assert all(x["selection"] == "withheld" and x["limitations"] == ["invalid_utf8"] for x in p[2].values()) and p[12][1]["limitations"] == ["utf8_bom_not_supported"]
    assert p[3][1]["selection"] == p[3][2]["selection"] == "withheld" and p[3][3]["selection"] == "missing" and [e["reason"] for e in got[3]["extras"]] == ["unclosed_fence_heading_ambiguity"]
    assert all(x["selection"] == "missing" for x in p[4].values())
    assert [(got[n]["order_established"], got[n]["group_complete"]) for n in (5, 6, 7, 8, 1)] == [(True, True), (True, False), (True, False), (False, False), (False, False)]
    assert [e["reason"] for e in got[6]["extras"]] == ["response_preamble"] and [e["reason"] for e in got[7]["extras"]] == ["unrequested_candidate_heading"]
    assert p[8][1]["selection"] == "selected" and body(9, 1) == b"# x\r\n" and p[9][1]["status"] == "complete"
    assert p[10][1]["selection"] == "withheld" and body(11, 1) == b"a\n```\r\r\nb\n"
    assert body(13, 1) == "\u4e2d\n".encode() and p[13][1]["limitations"] == ["prose_outside_code_fence"]
    assert p[14][1]["limitations"] == ["empty_candidate_body"] and p[14][1]["start"] == p[14][1]["end"]
    assert body(15, 1) == b'"""\n### Candidate 2\n"""\n' and p[15][2]["selection"] == "selected"


def test_design_and_audit(spark):
    design = study.design(spark)
    assert design.count() == 360 and design.select("call_order").distinct().count() == 72
    assert study.audit_positions(design).count() == 72
    assert study.sorting_inputs(spark, [0, 1, 2], 3).count() == 1 + 3 + 9 + 27


def test_agreement_and_spending(spark):
    r = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "x")], "item string, slot int, cat string")
    assert study.agreement(r, "item", "slot", "cat").first().asDict() == {"items": 3, "paired": 2, "agreeing": 1, "single": 1}
    m = spark.createDataFrame([("k", 1.10, "EUR"), ("k", 2.20, "EUR"), ("l", 1.0, "EUR"), ("l", 1.0, "USD")], "g string, amount double, cur string")
    got = {x["g"]: x["total"] for x in study.spending(m, ["g"], "amount", "cur").collect()}
    assert str(got["k"]) == "3.30" and got["l"] is None


def test_strict_json(spark):
    good = canonical.parse_strict(b'{"a": 1.50, "b": [1e3, 2]}')
    assert good == {"a": "1.50", "b": ["1e3", 2]} and isinstance(good["a"], canonical.Number)
    for raw, why in [(b'{"a":1,"a":2}', "duplicate_json_key"), (b"NaN", "non_finite_number"), (b'"\\ud800"', "unpaired_surrogate"), (b"\xef\xbb\xbf1", "utf8_bom_not_supported"), (b"[" * 70 + b"]" * 70, "json_depth_exceeded"), (b"\xff", "invalid_utf8"), (b"{", "invalid_json")]:
        with pytest.raises(canonical.InputProblem, match=why):
            canonical.parse_strict(raw)
    df = spark.createDataFrame([('{"b":1,"a":2}',), ('{"a":1,"a":1}',)], "line string").select(canonical.json_problem("line").alias("p"), canonical.json_digest("line").alias("d"))
    a, b = df.collect()
    assert a["p"] is None and a["d"] == canonical.digest({"a": 2, "b": 1}) and (b["p"], b["d"]) == ("duplicate_json_key", None)


def test_recurrence_query_covers_the_days_of_the_table(spark, tmp_path):
    from prismet.plans import queries

    rows = [(1, f"2024-01-{d:02d} 10:00:00", "a", k) for d in (1, 2) for k in range(3)] + [(1, "2024-02-10 10:00:00", "a", k) for k in range(3)] + [(2, "2024-01-04 10:00:00", "a", 0)]
    spark.createDataFrame(rows, "user_id long, ts string, event_type string, event_id long").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["state"]: r["recurrence"] for r in queries.QUERIES["recurrence"](spark, str(tmp_path)).where("unit = 1").collect()}
    # A day without any event was not collected: a gap. On day 3 another user has one, so this one's lack is an absence.
    assert sorted(got) == list(range(41)) and [got[k] for k in (0, 1, 2, 3, 40)] == ["first_observed", "observed", "gap", "absent", "observed_reappearance"]


def test_trigram_distance_queries_against_enumeration(spark, tmp_path):
    from itertools import combinations

    from prismet.plans import queries

    texts = {("c", 0): "a b, c d", ("c", 1): "a b, c e", ("c", 2): "z", ("c", 3): "", ("d", 0): "a b", ("c", 4): " \n", ("d", 1): None}
    spark.createDataFrame([(c, k, "user", t) for (c, k), t in texts.items()], "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    sets = {k: text.trigrams(u) for k, t in texts.items() if (u := text.lexical_units(t or ""))}
    jaccard = lambda a, b: 1 - len(a & b) / len(a | b)
    pairs = {(a, b): jaccard(sets["c", a], sets["c", b]) for a, b in combinations(range(3), 2)}
    got = {(r["a"], r["b"]): r["distance"] for r in queries.QUERIES["trigram_distance"](spark, str(tmp_path)).collect()}
    assert got == {k: round(v, 10) for k, v in pairs.items() if v < 1} and got
    mean = {r["cell"]: (r["m"], r["mean_distance"], r["status"]) for r in queries.QUERIES["trigram_surface_distance"](spark, str(tmp_path)).collect()}
    assert mean == {"c": (3, round(sum(pairs.values()) / 3, 9), "available"), "d": (1, None, "undefined")}


def test_receipts_of_long_responses_take_linear_time(spark):
    """Twice the headings and blocks take about twice the time, and the plan has nothing that a retried task would do otherwise."""
    import time

    from prismet.operators import responses

    took = []
    for n in (2000, 2000, 16000):
        df = spark.createDataFrame([(1, "# a\n```python\nx\n```\n" * n)], "k int, text string")
        began = time.time()
        row = responses.receipts(df).first()
        took.append(time.time() - began)
        assert len(row["extras"]) == n and [p["selection"] for p in row["positions"]] == ["missing"] * 5
    assert took[2] < 40 * max(took[1], 0.5)
    plan = responses.receipts(spark.createDataFrame([("x",)], "text string"))._jdf.queryExecution().optimizedPlan()
    assert plan.deterministic()
