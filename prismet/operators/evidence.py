"""Evidence behind labels and claims: soundness, walks, domain results, integrity, matching, regimes, readiness."""

from __future__ import annotations

import hashlib
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismet.functions.status import reasons, zoned_timestamp
from prismet.operators import graph
from prismet.session import gathered

#: Conditions of an integrity claim (fixed values).
INTEGRITY = ["structural_validity", "external_presence", "source_integrity", "tail_retention", "corrective_capacity"]


#: Methods that a judgment of each purpose may rest on (fixed values).
METHODS = {"mechanism": ["control_flow", "execution_trace", "formal_mechanism", "counterfactual", "domain_adjudication"], "validity": ["execution", "formal_validity", "domain_adjudication"]}
#: Effects of corrections that reach a label through its evidence (fixed values).
EFFECTS = ["membership", "validity", "schema"]


def evidence_problems(cited: DataFrame, policy: str) -> DataFrame:
    """Problems of each cited evidence row against the decision that cites it [F3]: ``cited`` with the column problems.

    Rows carry the record's own fields (state null where it is not there) beside the ``want_`` fields of the decision.
    Columns that a table lacks take no part.
    """
    there = F.col("state").isNotNull()
    none = F.array().cast("array<string>")
    checks = [
        (["state"], ~there, "essential_evidence_unresolved"),
        (["target"], ~F.col("target").eqNullSafe(F.col("want_target")), "evidence_target_mismatch"),
        (["scopes"], ~F.array_contains(F.coalesce("scopes", none), F.col("want_frame")), "evidence_frame_mismatch"),
        (["purpose"], ~F.col("purpose").eqNullSafe(F.col("want_purpose")), "evidence_property_mismatch"),
        (["state", "access"], ~((F.col("state") == "active") & (F.col("access") == "readable")), "essential_evidence_not_active_or_readable"),
        (["conflict"], F.col("conflict") == "unresolved", "evidence_contradiction"),
        (["assertion"], ~F.col("assertion").eqNullSafe(F.col("want_outcome")), "evidence_assertion_mismatch"),
        (["detail"], F.coalesce(F.trim("detail"), F.lit("")) == "", "missing_evidence_detail"),
        (["subject_hash", "want_hash"], F.col("subject_hash") != F.col("want_hash"), "evidence_subject_hash_mismatch"),
    ]
    if policy == "fixture_only":
        checks += [(["data_role"], ~F.col("data_role").eqNullSafe(F.lit("fixture")), "fixture_evidence_role_mismatch")]
    else:
        allowed = F.when(F.col("want_purpose") == "mechanism", F.array(*map(F.lit, METHODS["mechanism"]))).otherwise(F.array(*map(F.lit, METHODS["validity"])))
        checks += [
            (["data_role", "mock"], (F.col("data_role") == "fixture") | F.col("mock"), "fixture_in_import_evidence"),
            (["method"], ~F.coalesce(F.array_contains(allowed, F.col("method")), F.lit(False)), "inappropriate_validation_method"),
            (["reviewed"], ~F.coalesce("reviewed", F.lit(False)), "reviewer_record_unresolved"),
        ]
    pairs = [(condition if code == "essential_evidence_unresolved" else there & condition, code) for need, condition, code in checks if set(need) <= set(cited.columns)]
    return cited.withColumn("problems", reasons(*pairs))


def _held(records: DataFrame, refs: str, targets: DataFrame) -> DataFrame:
    """key, held: whether every reference of the list is among ``targets`` (key); false for an empty list."""
    each = records.select("key", F.explode(refs).alias("_ref")).join(targets.select(F.col("key").alias("_ref"), F.lit(True).alias("_there")), "_ref", "left")
    return each.groupBy("key").agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("held"))


def own_problems(support: DataFrame, keys: DataFrame, corrections: DataFrame, policy: str) -> DataFrame:
    """key, codes of each evidence record: what is wrong with it whoever cites it [F3, F4]; only records with a code.

    ``corrections`` is (target, codes); ``keys`` the records that can be referred to.
    """
    ev = support.where("record_type = 'evidence'")
    state = [(F.col("state") != "active", "upstream_evidence_not_active"), ((F.col("access") != "readable") | (F.col("conflict") == "unresolved"), "upstream_evidence_unreadable_or_conflicted")]
    if policy != "fixture_only":
        state.append(((F.col("data_role") == "fixture") | F.col("mock"), "fixture_in_import_evidence"))
    codes = ev.select("key", F.explode(reasons(*state)).alias("code"))
    other = ev.withColumn("others", F.filter("evidence", lambda r: ~r.startswith("evidence:")))
    codes = codes.union(_held(other, "others", keys).where("NOT held").select("key", F.lit("essential_reference_missing")))
    codes = codes.union(ev.join(corrections.withColumnRenamed("target", "_fixed"), F.col("key") == F.col("_fixed")).select("key", F.explode("codes")))
    return codes.groupBy("key").agg(F.collect_set("code").alias("codes"))


def artifact_problems(support: DataFrame, artifacts: DataFrame, corrections: DataFrame) -> DataFrame:
    """key, codes of evidence whose artifacts were not read as recorded, or are corrected."""
    each = support.where("record_type = 'evidence'").select("key", F.explode("artifacts").alias("_a"))
    unread = each.join(artifacts.where("status = 'snapshot_read'").select(F.col("key").alias("_a")), "_a", "left_anti").select("key", F.lit("essential_artifact_unreadable_or_mismatched").alias("code"))
    fixed = each.join(corrections.withColumnRenamed("target", "_fixed"), F.col("_a") == F.col("_fixed")).select("key", F.explode("codes").alias("code"))
    return unread.union(fixed).groupBy("key").agg(F.collect_set("code").alias("codes"))


def decisive_walk(decisions: DataFrame, links: DataFrame, bad: DataFrame) -> DataFrame:
    """Problems that each decision meets on the way through its evidence [G1]: decision, problems.

    ``links`` is (src, dst); ``bad`` has node and codes (or node alone: dependent_evidence_unavailable). A circle counts
    where it can be reached from the decision, not where it merely leads to its evidence.
    """
    seeds = decisions.select(F.col("decision").alias("origin"), F.col("decision").alias("node")).distinct()
    reached = graph.closure(seeds, links)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    circle = graph.cyclic_nodes(links.select(F.col("src").alias("node")).union(links.select("dst")), back).withColumn("_c", F.lit(True))
    codes = F.col("codes") if "codes" in bad.columns else F.array(F.lit("dependent_evidence_unavailable"))
    marked = reached.join(bad.select("node", codes.alias("_codes")), "node", "left")
    met = marked.groupBy(F.col("origin").alias("node")).agg(F.array_distinct(F.flatten(F.collect_set("_codes"))).alias("_met")).join(circle, "node", "left")
    return met.select(F.col("node").alias("decision"), F.array_sort(F.array_union("_met", reasons((F.coalesce("_c", F.lit(False)), "circular_evidence_support")))).alias("problems"))


def decision_problems(decisions: DataFrame, support: DataFrame, keys: DataFrame, artifacts: DataFrame, corrections: DataFrame, *, policy: str) -> DataFrame:
    """decision, problems, restrictions of each decision from all evidence and adjudications that it cites [F3, G1].

    decisions: decision, subject, frame, outcome, purpose, want_hash, evidence (array of 'type:id'); support: key,
    record_type and the fields of a well-formed payload (``Bundle.support``); corrections: (target, codes) with EFFECTS.
    A decision without a problem has an empty list. Null lists count as empty; repeated references count once.
    """
    roles = support.where("record_type = 'role' AND state = 'active'").select("key")
    reviewed = _held(support, "reviewers", roles).withColumnRenamed("held", "reviewed")
    ev = support.where("record_type = 'evidence'").join(reviewed, "key", "left")
    wants = decisions.select("decision", F.col("decision").alias("want_target"), "subject", F.col("frame").alias("want_frame"), F.col("outcome").alias("want_outcome"), F.col("purpose").alias("want_purpose"), "want_hash", "evidence")
    refs = wants.select("*", F.explode(F.array_distinct(F.coalesce("evidence", F.array().cast("array<string>")))).alias("key")).drop("evidence")
    direct = refs.where(F.col("key").startswith("evidence:"))
    codes, limits = [], []
    if policy != "fixture_only":
        ruled = refs.where(F.col("key").startswith("adjudication:")).join(support.where("record_type = 'adjudication'").drop("record_type").join(reviewed, "key", "left"), "key", "left")
        based = _held(support.where("record_type = 'adjudication'"), "basis", keys.where(F.col("key").startswith("evidence:"))).withColumnRenamed("held", "_based")
        heard = _held(support.where("record_type = 'adjudication'"), "disagreements", keys).withColumnRenamed("held", "_heard")
        ruled = ruled.join(based, "key", "left").join(heard, "key", "left")
        there, no = F.col("state").isNotNull(), F.lit(False)
        sound = (F.col("state") == "active") & (F.col("decision_state") == "resolved") & ~F.col("mock") & (F.col("data_role") != "fixture") & F.col("target").eqNullSafe(F.col("want_target")) & F.col("outcome").eqNullSafe(F.col("want_outcome")) & F.array_contains("scopes", F.col("want_frame"))
        why = reasons((~there, "adjudication_record_unresolved"), (there & ~F.coalesce(sound, no), "adjudication_conflict"), (there & ~F.coalesce("reviewed", no), "adjudicator_unresolved"), (there & ~F.coalesce("_based", no), "adjudication_basis_unresolved"), (there & ~F.coalesce("_heard", F.lit(True)), "disagreement_unresolved"))
        codes += [ruled.select("decision", F.explode(why).alias("code")), refs.join(corrections.withColumnRenamed("target", "_fixed"), F.col("key") == F.col("_fixed")).where(F.col("key").startswith("adjudication:")).select("decision", F.explode("codes").alias("code"))]
        direct = direct.unionByName(ruled.select(*[c for c in direct.columns if c != "key"], F.explode("basis").alias("key"))).distinct()
        limits.append(decisions.select("decision", F.lit("independent_measurement_not_certified_by_software").alias("code")))
    cited = direct.join(ev.drop("record_type", "evidence", "outcome"), "key", "left")
    judged = evidence_problems(cited, policy)
    codes.append(judged.select("decision", F.explode("problems").alias("code")))
    limits.append(judged.where("state IS NOT NULL").select("decision", F.explode(reasons((F.col("origin").isNull(), "origin_unknown"), (F.col("knowledge_type").isNull(), "knowledge_type_unknown"))).alias("code")))
    codes.append(direct.join(artifact_problems(support, artifacts, corrections), "key").select("decision", F.explode("codes").alias("code")))
    links = ev.select(F.col("key").alias("src"), F.explode("evidence").alias("dst")).where(F.col("dst").startswith("evidence:"))
    lost = links.select(F.col("dst").alias("key")).distinct().join(ev.select("key"), "key", "left_anti").select(F.col("key").alias("node"), F.array(F.lit("essential_evidence_unresolved")).alias("codes"))
    bad = own_problems(support, keys, corrections, policy).select(F.col("key").alias("node"), "codes").union(lost)
    walked = decisive_walk(direct.select(F.col("key").alias("decision")).distinct(), links, bad).select(F.col("decision").alias("key"), "problems")
    codes.append(direct.join(walked, "key").select("decision", F.explode("problems").alias("code")))
    apart = refs.where(F.col("key").startswith("independence_assessment:")).join(support.where("record_type = 'independence_assessment' AND outcome = 'supported_for_scope'").select("key"), "key", "left_anti")
    limits.append(apart.select("decision", F.lit("independence_not_established").alias("code")))
    gather = lambda parts, name: reduce(DataFrame.union, parts).groupBy("decision").agg(F.array_sort(F.collect_set("code")).alias(name))
    none = F.array().cast("array<string>")
    out = decisions.select("decision").distinct().join(gather(codes, "problems"), "decision", "left").join(gather(limits, "restrictions"), "decision", "left")
    return out.select("decision", F.coalesce("problems", none).alias("problems"), F.coalesce("restrictions", none).alias("restrictions"))


def domain_results(expected: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """passed, violated, incomplete or conflicting of each suite [V3]: every expected case once, or a decisive counterexample.

    ``expected`` is taken as a set: a case that it lists twice is one.
    """
    # Both tables lie together by suite once; expected and performed cases meet in one grouping, and nothing is joined.
    each = expected.select(*keys, "case_id", F.lit(True).alias("_want"), F.lit(None).cast("boolean").alias("passed")).unionByName(results.select(*keys, "case_id", F.lit(False).alias("_want"), "passed"))
    cases = gathered(each, *keys).groupBy(*keys, "case_id").agg(F.bool_or("_want").alias("_want"), F.bool_and("passed").alias("_ok"), F.count(F.when(~F.col("_want"), 1)).alias("_results"))
    # As in a join, no key or case that is null meets another.
    met = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "case_id")]) & (F.col("_results") > 0)
    both = cases.where("_want").select(*keys, F.when(met, F.col("_ok")).alias("_ok"), F.when(met, F.col("_results")).alias("_n"))
    t = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"), F.count("_n").alias("performed"), F.coalesce(F.bool_or(~F.col("_ok")), F.lit(False)).alias("_bad"), F.max("_n").alias("_most"))
    state = F.when(F.col("_bad"), "violated").when(F.col("_most") > 1, "conflicting").when(F.col("performed") < F.col("expected"), "incomplete").otherwise("passed")
    return t.select(*keys, "expected", "performed", state.alias("state"))


def integrity_claims(requirements: DataFrame) -> DataFrame:
    """Disposition of each claim from its five conditions [V4]: all met and current, some withheld, or restricted."""
    t = requirements.groupBy("claim").agg(F.collect_set("condition").alias("_c"), F.bool_and(F.col("state") == "met").alias("_m"), F.bool_and("current").alias("_now"), F.array_sort(F.collect_set(F.when(F.col("state") != "met", F.col("condition")))).alias("open_conditions"))
    whole = F.size(F.array_except(F.array(*map(F.lit, INTEGRITY)), F.col("_c"))) == 0
    return t.select("claim", F.when(~whole, "withheld").when(F.col("_m") & F.col("_now"), "supported_for_scope").otherwise("restricted").alias("disposition"), "open_conditions")


def registration_gate(registered_at: Column, observed_at: Column) -> Column:
    """passed if both times have an offset and the registration is not later; unresolved without one [F10]."""
    a, b = zoned_timestamp(registered_at), zoned_timestamp(observed_at)
    return F.when(a.isNull() | b.isNull(), "unresolved").when(a <= b, "passed").otherwise("failed")


def match_reasons(left: str, right: str, columns: list[str]) -> Column:
    """Codes of the meanings in which two struct columns differ or are unknown [F11, J13]."""
    pairs = []
    for c in columns:
        a, b = F.col(f"{left}.{c}"), F.col(f"{right}.{c}")
        pairs += [(a.isNull() | b.isNull(), f"{c}_unknown"), (a.isNotNull() & b.isNotNull() & (a != b), f"{c}_mismatch")]
    return reasons(*pairs)


def assay_compatibility(pre: DataFrame, post: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Pre and post assays of a key with the reasons why they cannot be compared [J13, V14]."""
    a = pre.select(key, F.struct(*columns).alias("pre"))
    b = post.select(key, F.struct(*columns).alias("post"))
    return a.join(b, key).select(key, match_reasons("pre", "post", columns).alias("reasons"))


def regime_restrictions(windows: DataFrame, events: DataFrame) -> DataFrame:
    """Interventions, external contributions and recuts inside each fit window [V10]: trajectory, first, last against trajectory, at."""
    hit = windows.join(events, "trajectory").where((F.col("at") > F.col("first")) & (F.col("at") <= F.col("last")))
    return hit.groupBy("trajectory", "first", "last").agg(F.array_sort(F.collect_set("kind")).alias("restrictions"))


def qualification(artifacts: DataFrame) -> DataFrame:
    """Membership and validity qualification of each artifact [V18, V19]; an artifact used at several positions is withheld."""
    n = artifacts.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = artifacts.join(n, "artifact_id")
    why = F.array_union(reasons((F.col("_n") > 1, "duplicate_artifact"), (F.col("challenged"), "audit_challenge"), (F.col("decision").isNull(), "decision_missing")), F.coalesce("problems", F.array().cast("array<string>")))
    return rows.withColumn("reasons", F.array_sort(why)).withColumn("qualified", F.size("reasons") == 0).drop("_n")


def denominators(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Planned, emitted, qualified, audited and claimable counts in columns of their own [A30]; never pooled."""
    yes = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).alias(c)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("planned"), *[yes(c) for c in ("emitted", "qualified", "audited", "claimable") if c in rows.columns])


def pair_coverage(observed: DataFrame, items: DataFrame | list[str]) -> DataFrame:
    """Unordered pairs of a registry's items (item) and whether each is described [U7]: C(n, 2) rows, all of them asked for."""
    if isinstance(items, list):
        items = observed.sparkSession.createDataFrame([(x,) for x in items], "item string")
    names = items.select("item").distinct()
    want = names.select(F.col("item").alias("a")).join(names.select(F.col("item").alias("b")), F.col("a") < F.col("b"))
    seen = observed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("covered", F.lit(True))
    return want.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(seen, ["a", "b"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def multiset_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose number of rows differs between two tables [U6, U9]; empty if they are equal as multisets."""
    x = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("left_n"))
    y = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("right_n"))
    out = x.join(y, keys, "full_outer").select(*keys, F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))
    return out.where("left_n <> right_n")


def blocking_problems(problems: DataFrame, evidential: list[str]) -> DataFrame:
    """Problems that stop processing: errors other than missing or disputed evidence [F14]."""
    return problems.where((F.col("severity") == "error") & ~F.col("problem").isin(*evidential))


def readiness(required: DataFrame, declared: DataFrame, packets: DataFrame) -> DataFrame:
    """State of each required item of an activity packet [V22]: declared once, pinned to the packet that is there, or what is wrong."""
    n = declared.groupBy("requirement").agg(F.count(F.lit(1)).alias("_n"), F.first("packet_id").alias("packet_id"), F.first("sha256").alias("_pin"))
    out = required.join(n, "requirement", "full_outer").join(packets.select("packet_id", F.col("sha256").alias("_have")), "packet_id", "left")
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated").when(F.col("_have").isNull(), "packet_missing").when(F.col("_have") != F.col("_pin"), "packet_changed").otherwise("ready")
    return out.select("requirement", state.alias("state"))


def core_annotation_roles(slots: DataFrame, roles: int = 32) -> DataFrame:
    """Core roles with both initial reviews by different people, and whether all roles are there [V20]."""
    t = slots.groupBy("role").agg(F.count_distinct("slot").alias("_s"), F.count_distinct("person").alias("_p"))
    return t.agg(F.count(F.lit(1)).alias("roles"), F.sum(F.when((F.col("_s") >= 2) & (F.col("_p") >= 2), 1).otherwise(0)).alias("complete")).withColumn("all_complete", F.col("complete") == roles)


def context_changes(cached: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Contexts whose stored fingerprint is not the recomputed one [V7]: results on them are stale."""
    both = cached.select(*keys, F.col("fingerprint").alias("_a")).join(current.select(*keys, F.col("fingerprint").alias("_b")), keys, "left")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def software_identity() -> str:
    """Digest of the package's own files [V27]."""
    root = Path(__file__).resolve().parents[1]
    h = hashlib.sha256()
    for f in sorted(root.rglob("*.py")):
        h.update(str(f.relative_to(root)).encode() + b"\0" + hashlib.sha256(f.read_bytes()).digest())
    return h.hexdigest()
