"""Which labelled observations count: identity, references, pins, corrections, and one ordered cascade of reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismet.functions.status import known, reasons
from prismet.operators import evidence, graph


def unique_lookup(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records whose identity occurs once [J1]; a repeated identity is unresolved, never 'latest wins'."""
    n = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return records.join(n, keys, "left_semi")


def duplicate_identities(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reference_problems(references: DataFrame, targets: DataFrame) -> DataFrame:
    """missing, ambiguous or wrong-type targets of references (source, field, target_type, target_id, expected_type) [J2, V5]."""
    t = targets.groupBy("target_type", "target_id").agg(F.count(F.lit(1)).alias("_n"))
    out = references.join(t, ["target_type", "target_id"], "left")
    problem = F.when(F.col("_n").isNull(), "reference_missing").when(F.col("_n") > 1, "reference_ambiguous").when(F.col("expected_type").isNotNull() & (F.col("expected_type") != F.col("target_type")), "reference_type_mismatch")
    return out.withColumn("problem", problem).where(F.col("problem").isNotNull()).drop("_n")


def selection(requested: DataFrame, identified: DataFrame, key: str) -> DataFrame:
    """selected (both), excluded (identified only) or unresolved (requested only) of each key [J4]."""
    a, b = requested.select(key).distinct().withColumn("_r", F.lit(True)), identified.select(key).distinct().withColumn("_i", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_r") & F.col("_i"), "selected").when(F.col("_i"), "excluded").otherwise("unresolved").alias("selection"))


def active_corrections(corrections: DataFrame, effects: list[str]) -> DataFrame:
    """(target, codes) of corrections that have one of the effects and are neither rejected nor mere notes [F4].

    A correction is applied if it is in that stage and ``sound`` (its reviewers, evidence and reason are there, where the
    table says so); otherwise it is pending, which holds its targets as well.
    """
    live = corrections.where((F.col("stage") != "rejected") & F.col("effect").isin(*effects))
    if "action" in corrections.columns:
        live = live.where(~F.col("action").eqNullSafe(F.lit("annotate")))
    applied = F.col("stage") == "applied"
    if "sound" in corrections.columns:
        applied = applied & F.col("sound")
    each = live.select(F.explode(F.array_distinct("targets")).alias("target"), F.concat_ws(":", F.when(applied, "correction_applied").otherwise("correction_pending"), F.col("correction_id")).alias("code"))
    return each.groupBy("target").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def reference_key(ref: Column) -> Column:
    return F.concat_ws(":", ref["record_type"], ref["record_id"])


#: The rules of the cascade in their order: column of the joined row that is true where the rule fails, status, reason.
CASCADE = [
    ("sample_unresolved", "withheld", "sample_identity_unresolved"),
    ("frame_unresolved", "withheld", "essential_frame_unresolved"),
    ("pin_repeated", "conflict", "revision_pin_not_unique"),
    ("pin_missing", "missing", "revision_not_pinned"),
    ("record_unresolved", "withheld", "selected_revision_unresolved"),
    ("revision_mismatch", "withheld", "selected_revision_mismatch"),
    ("frame_mismatch", "withheld", "assignment_frame_mismatch"),
    ("rubric_mismatch", "withheld", "validity_rubric_mismatch"),
    ("frame_challenged", "withheld", "shared_frame_challenged"),
    ("sample_corrected", "withheld", "sample_correction"),
    ("record_corrected", "withheld", "record_correction"),
    ("history_unresolved", "withheld", "revision_history_unresolved"),
    ("history_cyclic", "withheld", "cyclic_revision_history"),
    ("successor_other_sample", "withheld", "cross_sample_supersession"),
    ("superseded", "withheld", "selected_revision_superseded"),
    ("unresolved_label", "unresolved", "no_committed_class"),
    ("unclassified_label", "unclassified", "no_committed_class"),
    ("not_assessed_label", "not_assessed", "no_validity_assessment"),
    ("provisional", "withheld", "provisional_judgment"),
    ("review_mismatch", "withheld", "review_policy_mismatch"),
    ("fixture_outside_fixture", "withheld", "fixture_policy_requires_fixture_context"),
    ("policy_mismatch", "withheld", "assignment_policy_mismatch"),
    ("class_unknown", "withheld", "class_outside_pinned_schema"),
    ("artifact_mismatch", "withheld", "sample_artifact_identity_mismatch"),
]


def cascade(rows: DataFrame) -> DataFrame:
    """status, reason, outcome of each row by the first failing rule [F1]; absent rule columns never fail.

    A rule's own codes take the place of its reason where the row has them: a column <rule>_codes.
    """
    status, reason = F.lit("accepted"), F.lit(None).cast("string")
    for column, s, why in reversed(CASCADE):
        if column in rows.columns:
            own = F.array_join(f"{column}_codes", ",") if f"{column}_codes" in rows.columns else F.lit(why)
            status, reason = F.when(F.col(column), s).otherwise(status), F.when(F.col(column), own).otherwise(reason)
    out = rows.withColumns({"status": status, "reason": reason})
    if "evidence_problems" in rows.columns:
        open_ = (F.col("status") == "accepted") & (F.size("evidence_problems") > 0)
        out = out.withColumns({"reason": F.when(open_, F.array_join("evidence_problems", ",")).otherwise(F.col("reason")), "status": F.when(open_, "withheld").otherwise(F.col("status"))})
    return out.withColumn("outcome", F.when(F.col("status") == "accepted", F.col("label")))


def histories(records: DataFrame) -> DataFrame:
    """id, broken, cyclic of records whose chain of predecessors [G8] leads to a missing or another sample's record, or round."""
    own = unique_lookup(records, ["id"]).select("id", "sample_id", "supersedes")
    links = own.where(F.col("supersedes").isNotNull()).select(F.col("id").alias("src"), F.col("supersedes").alias("dst"))
    if not links.take(1):
        return own.sparkSession.createDataFrame([], "id string, broken boolean, cyclic boolean")
    chains = graph.closure(links.select(F.col("src").alias("origin"), F.col("src").alias("node")), links)
    at = own.select(F.col("id").alias("node"), F.col("sample_id").alias("_s"))
    first = own.select(F.col("id").alias("origin"), F.col("sample_id").alias("_first"))
    broken = chains.join(at, "node", "left").join(first, "origin").groupBy(F.col("origin").alias("id")).agg(F.bool_or(~F.col("_s").eqNullSafe(F.col("_first"))).alias("broken"))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    round_ = graph.cyclic_nodes(links.select(F.col("src").alias("node")).union(links.select("dst")), back).select(F.col("node").alias("id"), F.lit(True).alias("cyclic"))
    return broken.join(round_, "id", "left").select("id", "broken", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def admit(axis: str, samples: DataFrame, records: DataFrame, pins: DataFrame, frames: DataFrame, corrections: DataFrame, *, support: DataFrame, keys: DataFrame, artifacts: DataFrame, policy: str, data_role: str, classes: list[str], hash_errors: DataFrame | None = None) -> DataFrame:
    """Admission of every sample on one axis (assignment or validity) by joins on identities and one cascade [F1-F4, G8].

    samples: sample_id, frame_id, and hash (of its output) if known; records: id, version, sample_id, frame_id,
    label_status, label, review, policy, supersedes, rationale, evidence (array of 'type:id'), and rubric; pins:
    sample_id, id, version; frames: frame_id, and rubric; corrections: correction_id, stage, effect, targets, and action,
    sound; support, keys, artifacts: as ``Bundle`` gives them; hash_errors: sample_id of outputs that are not what their
    record says. Columns named after "and" are optional. The evidence that a label cites is looked up and followed; what
    is not there withholds the label.
    """
    effect = "membership" if axis == "assignment" else "validity"
    shared = ["schema", "registry", "membership"] if axis == "assignment" else ["validity"]
    only = unique_lookup(samples, ["sample_id"])
    n = Window.partitionBy("sample_id")
    pinned = pins.select("sample_id", F.col("id").alias("pin_id"), F.col("version").alias("pin_version")).withColumn("_pins", F.count(F.lit(1)).over(n)).dropDuplicates(["sample_id"])
    recs = unique_lookup(records, ["id"]).select(F.col("id").alias("pin_id"), *[F.col(c).alias(f"r_{c}") for c in records.columns if c != "id"])
    nxt = records.where(F.col("supersedes").isNotNull()).groupBy(F.col("supersedes").alias("pin_id")).agg(F.collect_set("sample_id").alias("_next_samples"))
    past = histories(records).withColumnRenamed("id", "pin_id")
    fixed = lambda kinds, name, key: active_corrections(corrections, kinds).select(F.col("target").alias(key), F.col("codes").alias(name))
    rows = samples.select("sample_id", "frame_id", (F.col("hash") if "hash" in samples.columns else F.lit(None).cast("string")).alias("_hash")).dropDuplicates(["sample_id", "frame_id"])
    rows = rows.join(only.select("sample_id").withColumn("_one", F.lit(True)), "sample_id", "left")
    rows = rows.join(frames.select("frame_id", (F.col("rubric") if "rubric" in frames.columns else F.lit(None).cast("string")).alias("_rubric"), F.lit(True).alias("_frame")).dropDuplicates(["frame_id"]), "frame_id", "left")
    rows = rows.join(pinned, "sample_id", "left").join(recs, "pin_id", "left").join(nxt, "pin_id", "left").join(past, "pin_id", "left")
    if hash_errors is not None:
        rows = rows.join(hash_errors.select("sample_id", F.lit(True).alias("artifact_mismatch")).distinct(), "sample_id", "left").withColumn("artifact_mismatch", F.coalesce("artifact_mismatch", F.lit(False)))
    rows = rows.withColumns({"_fk": F.concat(F.lit("frame:"), "frame_id"), "_sk": F.concat(F.lit("realization:"), "sample_id"), "_rk": F.concat(F.lit(axis + ":"), "pin_id")})
    rows = rows.join(fixed(shared, "_fc", "_fk"), "_fk", "left").join(fixed([effect], "sample_corrected_codes", "_sk"), "_sk", "left").join(fixed([effect], "record_corrected_codes", "_rk"), "_rk", "left")
    wanted = "fixture" if policy == "fixture_only" else "adjudicated"
    purpose = "fixture_declaration" if policy == "fixture_only" else "mechanism" if axis == "assignment" else "validity"
    decisions = rows.where(F.col("r_version").isNotNull()).select(F.col("_rk").alias("decision"), F.col("_sk").alias("subject"), F.col("_fk").alias("frame"), F.col("r_label").alias("outcome"), F.lit(purpose).alias("purpose"), F.col("_hash").alias("want_hash"), F.col("r_evidence").alias("evidence")).dropDuplicates(["decision"])
    found = evidence.decision_problems(decisions, support, keys, artifacts, active_corrections(corrections, evidence.EFFECTS), policy=policy).select(F.col("decision").alias("_rk"), F.col("problems").alias("_found"), "restrictions")
    rows = rows.join(found, "_rk", "left")
    kinds = F.transform("r_evidence", lambda x: F.split(x, ":")[0])
    none = F.array().cast("array<string>")
    problems = F.array_sort(F.array_union(F.coalesce("_found", none), reasons(
        (F.coalesce(F.trim("r_rationale"), F.lit("")) == "", "missing_decision_rationale"),
        (~F.coalesce(F.array_contains(kinds, "evidence"), F.lit(False)), "missing_essential_evidence"),
        (F.exists(kinds, lambda k: ~k.isin("evidence", "adjudication", "independence_assessment")), "unsupported_decisive_record_type"),
        (F.lit(policy == "adjudicated_import") & ~F.coalesce(F.array_contains(kinds, "adjudication"), F.lit(False)), "missing_adjudication_record"),
    )))
    state = F.col("r_label_status")
    flags = {
        "sample_unresolved": F.col("_one").isNull(), "frame_unresolved": F.col("_frame").isNull(),
        "pin_repeated": F.coalesce(F.col("_pins") > 1, F.lit(False)), "pin_missing": F.col("_pins").isNull(),
        "record_unresolved": F.col("r_version").isNull(),
        "revision_mismatch": (F.col("r_sample_id") != F.col("sample_id")) | (F.col("r_version") != F.col("pin_version")),
        "frame_mismatch": F.lit(axis == "assignment") & ~F.col("r_frame_id").eqNullSafe(F.col("frame_id")),
        "rubric_mismatch": F.lit(axis == "validity") & ~F.col("r_rubric").eqNullSafe(F.col("_rubric")) if "rubric" in records.columns else F.lit(False),
        "frame_challenged": F.col("_fc").isNotNull(), "sample_corrected": F.col("sample_corrected_codes").isNotNull(), "record_corrected": F.col("record_corrected_codes").isNotNull(),
        "history_unresolved": F.col("broken"), "history_cyclic": F.col("cyclic"),
        "successor_other_sample": F.exists(F.coalesce("_next_samples", none), lambda s: s != F.col("sample_id")),
        "superseded": F.col("_next_samples").isNotNull(),
        "unresolved_label": F.lit(axis == "assignment") & (state == "unresolved"), "unclassified_label": F.lit(axis == "assignment") & (state == "unclassified"),
        "not_assessed_label": F.lit(axis == "validity") & (state == "not_assessed"),
        "provisional": F.col("r_review") == "provisional", "review_mismatch": F.col("r_review") != wanted,
        "fixture_outside_fixture": F.lit(policy == "fixture_only" and data_role != "fixture"),
        "policy_mismatch": F.lit(axis == "assignment") & ~F.col("r_policy").eqNullSafe(F.lit(policy)),
        "class_unknown": F.lit(axis == "assignment") & ~F.col("r_label").isin(*classes),
    }
    rows = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}).withColumns({"evidence_problems": problems, "label": F.col("r_label")})
    whole = cascade(rows)
    return whole.select("sample_id", F.lit(axis).alias("axis"), F.col("pin_id").alias("revision_id"), "status", "outcome", "reason", F.when(F.col("status") == "accepted", F.coalesce("restrictions", none)).otherwise(none).alias("restrictions"))


def populations(assignments: DataFrame, validities: DataFrame) -> DataFrame:
    """Views of admitted samples [F2]: classified_all, and classified_valid for those also accepted as valid."""
    a = assignments.where("status = 'accepted'").select("sample_id", F.col("outcome").alias("class"))
    v = validities.where("status = 'accepted' AND outcome = 'valid'").select("sample_id")
    return a.withColumn("view", F.lit("classified_all")).union(a.join(v, "sample_id", "left_semi").withColumn("view", F.lit("classified_valid")))


def positions(planned: DataFrame, realizations: DataFrame) -> DataFrame:
    """present, missing or ambiguous of each planned (group, index) position [J3]."""
    n = realizations.groupBy("generation_group_id", "within_group_index").agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_set("sample_id")).alias("samples"))
    out = planned.join(n, ["generation_group_id", "within_group_index"], "left")
    return out.withColumn("status", F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 1, "present").otherwise("ambiguous")).drop("_n")


def association(realizations: DataFrame, attempts: DataFrame) -> DataFrame:
    """Defects of a realization's link to its attempt [J5]: identity, cell, group, raw response, and a slot never attempted.

    realizations: sample_id, attempt_id, analysis_cell_id, generation_group_id, raw_response; attempts: attempt_id,
    analysis_cell_id, generation_group_id, raw_response, attempt_status; null is not known and contradicts nothing.
    """
    a = unique_lookup(attempts, ["attempt_id"]).select("attempt_id", F.col("analysis_cell_id").alias("_cell"), F.col("generation_group_id").alias("_group"), F.col("raw_response").alias("_raw"), F.col("attempt_status").alias("_status"), F.lit(True).alias("_a"))
    out = realizations.join(a, "attempt_id", "left")
    codes = reasons(
        (F.col("attempt_id").isNotNull() & F.col("_a").isNull(), "attempt_reference_unresolved"),
        (F.col("_cell") != F.col("analysis_cell_id"), "attempt_cell_mismatch"),
        (F.col("_group") != F.col("generation_group_id"), "attempt_group_mismatch"),
        (F.col("_raw") != F.col("raw_response"), "raw_response_association_mismatch"),
        (F.col("_status") == "not_attempted", "output_from_unattempted_slot"),
    )
    return out.select("sample_id", codes.alias("defects"))


def extraction_spans(realizations: DataFrame, contents: DataFrame) -> DataFrame:
    """sample_id, span, defect: whether the bytes of a span of the raw response are those of the output [J5].

    realizations: sample_id, raw, output (keys of artifacts), supplied, byte_start, byte_end (null where the span is not
    well formed); contents: key, content (null where it was not read). Contents are compared by their digests: of each
    artifact that is an output its own, of a raw response that of the slice, made where the response has been joined, so
    that bytes move once for each response and never for an output.
    """
    one = unique_lookup(contents, ["key"]).where(F.col("content").isNotNull())
    outputs = one.select(F.col("key").alias("output"), F.sha2("content", 256).alias("_output"))
    fine = F.coalesce((F.col("byte_start") >= 0) & (F.col("byte_start") <= F.col("byte_end")), F.lit(False))
    rows = realizations.select("sample_id", "raw", "output", "supplied", "byte_start", "byte_end", fine.alias("_fine")).join(outputs, "output", "left")
    asked = rows.where("supplied AND _fine AND _output IS NOT NULL").select("sample_id", "raw", "byte_start", "byte_end", "_output")
    size = F.octet_length("content")
    slice_ = F.sha2(F.substring(F.col("content"), F.col("byte_start").cast("int") + 1, (F.col("byte_end") - F.col("byte_start")).cast("int")), 256)
    cut = asked.join(one.select(F.col("key").alias("raw"), "content"), "raw").select("sample_id", ((F.col("byte_end") <= size) & (slice_ == F.col("_output"))).alias("_same"))
    span = F.when(~F.col("supplied"), "not_supplied").when(~F.col("_fine") | F.col("_same").isNull(), "unavailable").when(F.col("_same"), "bytes_match").otherwise("mismatch")
    defect = F.when(F.col("supplied") & ~F.col("_fine"), "invalid_extraction_span").when(F.col("supplied") & ~F.col("_same"), "extraction_span_mismatch")
    return rows.join(cut, "sample_id", "left").select("sample_id", span.alias("span"), defect.alias("defect"))


def output_mismatches(realizations: DataFrame, artifacts: DataFrame) -> DataFrame:
    """sample_id of outputs whose one artifact was read with another hash than the realization records [J5]."""
    one = unique_lookup(artifacts, ["key"]).where(F.col("actual").isNotNull()).select(F.col("key").alias("output"), "actual")
    return realizations.where(F.col("hash").isNotNull()).join(one, "output").where(F.col("actual") != F.col("hash")).select("sample_id")


def mismatches(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows of two tables that should be equal, with the columns that differ [J14, J16, V7, V24]."""
    left = a.select(*key, F.struct(*columns).alias("_a"))
    right = b.select(*key, F.struct(*columns).alias("_b"))
    both = left.join(right, key, "full_outer")
    diff = F.array_compact(F.array(F.when(F.col("_a").isNull(), "only_right"), F.when(F.col("_b").isNull(), "only_left"), *[F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in columns]))
    return both.select(*key, diff.alias("differs")).where(F.size("differs") > 0)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "known")]
