"""The shapes of a bundle's records as a table: fields of each type by rule, exceptions listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.operators import shapes
from prismet.sources.bundle import CLASSES, CORE_TYPES, IDENTITY, SUPPORT_COMMON, SUPPORT_FIELDS, SUPPORT_TYPES

#: Fields that core records must have, and may have (fixed values).
REQUIRED = {
    "frame": "frame_id task_id task_version task_context consequence_horizon analytic_resolution_id analytic_resolution_version structural_schema_id structural_schema_version reference_registry_id reference_registry_version validity_rubric_ref load_bearing_invariants consequence_signature_spec equivalence_rule_ref admissible_substitutions evidence_requirement exceptional_case_rules registration_ref",
    "protocol": "generation_protocol_id generation_protocol_version conditioning_context_ref decoding_settings seed",
    "cell": "analysis_cell_id frame_id generation_protocol_id generation_protocol_version prompt_block_id prompt_id condition_id model_identifier model_family checkpoint_identifier collection_window",
    "attempt": "attempt_id analysis_cell_id attempt_status retry_of raw_response_ref generation_group_id planned_candidate_count registered_call_order",
    "realization": "sample_id analysis_cell_id attempt_id raw_response_ref output_ref output_content_hash generation_group_id within_group_index sample_order extraction_rule_version completion_status",
    "assignment": "assignment_id assignment_version sample_id frame_id assignment_status structural_class_id assignment_review_status assignment_method decision_rationale evidence_refs assignment_evidence_policy_id assignment_evidence_policy_version supersedes_assignment_id",
    "validity": "validity_id validity_version sample_id validity_status validity_rubric_ref validity_review_status evidence_refs decision_rationale supersedes_validity_id",
    "artifact": "artifact_id content_ref expected_sha256 knowledge_type",
    "raw_artifact": "artifact_id content_ref expected_sha256 knowledge_type",
    "reference_registry": "reference_registry_id reference_registry_version frame classes validation_status provenance source_fragments",
}
OPTIONAL = {
    "frame": "registry_ref",
    "protocol": "shared_context_ref sampling_plan_ref intervention_ref",
    "cell": "budget_record_ref recursive_round_id parent_state_ref transition_ref",
    "attempt": "termination_reason budget_record_ref",
    "realization": "shared_context_ref termination_reason selection_status selection_reason group_type",
    "assignment": "candidate_class_ids classification_uncertainty_ref disagreement_ref role_records_ref correction_ref output_content_hash",
    "validity": "task_success_observations_ref role_records_ref correction_ref",
    "artifact": "transformation_history external_locator artifact_role",
    "raw_artifact": "transformation_history external_locator artifact_role",
}
#: What the one supported frame says of itself (fixed values).
PINNED = {
    "task_id": "bounded_integer_sort", "task_version": "0.1", "analytic_resolution_id": "sorting_mechanism_family", "analytic_resolution_version": "0.1", "structural_schema_id": "sorting_mechanism_partition",
    "structural_schema_version": "0.1", "reference_registry_id": "sorting_reference_eight", "reference_registry_version": "0.1", "validity_rubric_ref": "bounded_integer_sort_validity_v1",
}
#: Closed strings, by field where all types agree, else by type and field (fixed values).
CLOSED = {
    "attempt_status": ["succeeded", "failed", "cancelled", "not_attempted", "unknown"],
    "completion_status": ["complete", "truncated", "refused", "failed", "unknown"],
    "assignment_status": ["assigned", "unresolved", "unclassified"],
    "validity_status": ["valid", "invalid", "undetermined", "not_assessed"],
    "data_role": ["fixture", "pilot", "confirmatory", "descriptive"],
    "state": ["active", "challenged", "withdrawn", "superseded", "unresolved"],
    "purpose": ["fixture_declaration", "mechanism", "validity", "schema", "independence", "observation", "reference"],
    "access": ["readable", "unavailable", "withheld", "unknown"],
    "conflict_status": ["none_declared", "resolved", "unresolved"],
    "entity_type": ["human", "model", "tool", "organization", "formal_system", "measurement", "unknown"],
    "knowledge_state": ["known", "unknown", "unavailable", "not_applicable"],
    "decision_state": ["resolved", "unresolved"],
    "claim_kind": ["label_conditioned", "validated_measurement", "operational_openness", "empirical_theory"],
    "declared_disposition": ["supported_for_scope", "restricted", "withheld"],
    "component": ["stable_core", "rotating_frontier", "external_incident", "tail_registry"],
    "effect": ["membership", "validity", "independence", "schema", "registry", "metadata"],
    "action": ["challenge", "withdraw", "replace", "annotate"],
    "event_type": ["intake", "correction", "distributional_reopening_event", "structural_reopening_event"],
    "independence_assessment.outcome": ["supported_for_scope", "not_supported_for_scope", "unresolved"],
    "domain_result.outcome": ["passed", "failed", "timeout", "harness_error", "undetermined"],
    "domain_suite.stage": ["design", "performed", "incomplete", "not_performed"],
    "audit.stage": ["design", "performed", "incomplete", "not_performed"],
    "intake.stage": ["empty", "received", "reviewed", "acted", "rejected", "unresolved"],
    "correction.stage": ["pending", "applied", "rejected"],
}
#: Forms of fields that do not follow from their names: plain ones, then those of known values.
PLAIN = {
    "payload_version": "version", "mock": "bool", "initial": "bool", "requirements": "object", "reconsideration_triggers": "texts", "prior_result_ids": "ids",
    "role.role": "text", "lineage.relation": "text", "independence_assessment.dimension": "text", "annotation.aspect": "text", "domain_suite.property": "text", "domain_result.property": "text", "exposure.stage": "text", "integrity_assessment.claim": "text",
    "suite_id": "id", "set_id": "id", "registration_id": "id", "source_id": "id", "load_bearing_invariants": "some_texts", "registry_ref": "registry", "candidate_class_ids": "ids", "transformation_history": "refs",
    "assignment_evidence_policy_version": "version", "reference_registry.reference_registry_version": "version", "reference_registry.frame": "object", "classes": "objects", "provenance": "object", "source_fragments": "text_object", "structural_class_id": "any",
}
TAGGED = {
    "registration_ref": "ref", "conditioning_context_ref": "artifact", "decoding_settings": "object", "seed": "null_or_integer", "model_identifier": "text", "model_family": "text", "checkpoint_identifier": "text", "collection_window": "any", "retry_of": "null_or_id",
    "raw_response_ref": "artifact", "output_ref": "artifact", "generation_group_id": "id", "planned_candidate_count": "count", "registered_call_order": "positive", "realization.attempt_id": "id", "extraction_rule_version": "id", "realization.output_content_hash": "hash",
    "sample_order": "positive", "within_group_index": "positive", "assignment_method": "text", "decision_rationale": "text", "supersedes_assignment_id": "null_or_id", "supersedes_validity_id": "null_or_id", "validity.validity_rubric_ref": "text", "content_ref": "locator",
    "expected_sha256": "hash", "artifact.knowledge_type": "text", "raw_artifact.knowledge_type": "text", "validation_status": "text",
}
#: Names of reviews and of evidence policies (fixed values).
REVIEWS = ["fixture", "provisional", "adjudicated"]
POLICIES = ["fixture_only", "adjudicated_import"]


def _form(kind: str, field: str, core: bool, optional: bool) -> tuple[str, bool, list[str]]:
    """(form, whether of a known value, closed values) of a field."""
    both = (f"{kind}.{field}", field)
    values = next((CLOSED[k] for k in both if k in CLOSED), None)
    if values is not None:
        return "enum", False, values
    if not optional:
        form = next((TAGGED[k] for k in both if k in TAGGED), None) if core else None
        if form is not None:
            return form, True, []
    form = next((PLAIN[k] for k in both if k in PLAIN), None)
    if form is not None:
        return form, False, []
    if core:
        plain = "text" if kind == "frame" else "refs" if field == "evidence_refs" else "id"
        return ("any", True, []) if optional else (plain, False, [])
    if field.endswith("_refs"):
        return "refs", False, []
    if field.endswith("_ref") and field not in ("parent_ref", "sampling_plan_ref") and (kind, field) != ("annotation", "rubric_ref"):
        return "ref", False, []
    return "any", True, []


def table(spark: SparkSession, reviews: list[str] = REVIEWS, policies: list[str] = POLICIES) -> DataFrame:
    """The shape of every record type; what a review or an evidence policy may be called comes from the caller."""
    rows = []
    for kind in CORE_TYPES:
        for required, names in ((True, REQUIRED[kind]), (False, OPTIONAL.get(kind, ""))):
            for field in names.split():
                form, known, values = _form(kind, field, True, not required)
                if field.endswith("_review_status"):
                    form, known, values = "enum", False, list(reviews)
                if field == "assignment_evidence_policy_id":
                    form, known, values = "enum", False, list(policies)
                rows.append((kind, "$", field, required, form, known, values, "invalid_field"))
        rows += [(kind, "$", field, False, "any", False, [], "invalid_field") for field in ("record_type", "record_version", "record_id")]
        rows.append((kind, "$", "extensions", False, "object", False, [], "invalid_extensions"))
    for kind in SUPPORT_TYPES:
        for field in SUPPORT_COMMON + SUPPORT_FIELDS[kind]:
            form, known, values = _form(kind, field, False, False)
            rows.append((kind, "$.payload", field, True, form, known, values, "invalid_support_field"))
        rows.append((kind, "$.payload", "extensions", False, "object", False, [], "invalid_extensions"))
        rows += [(kind, "$", field, False, "any", False, [], "invalid_field") for field in ("record_type", "record_version", "record_id")]
        rows += [(kind, "$", "payload", True, "object", False, [], "invalid_support_envelope"), (kind, "$", "extensions", False, "object", False, [], "invalid_extensions")]
    return shapes.shape_table(spark, rows)


def _relations(records: DataFrame) -> DataFrame:
    """Defects that more than one field decides: a class without an assignment, another frame than the pinned one, the registry's classes."""
    f = shapes.fields(F.col("v"))
    part = lambda name: F.try_element_at(f, F.lit(name))
    has = lambda name: F.array_contains(F.map_keys(f), name)

    def found(kind: str, wrong: Column, field: str, code: str) -> Column:
        return F.when((F.col("record_type") == kind) & wrong, F.struct(F.lit(f"$.{field}").alias("path"), F.lit(code).alias("code")))

    label = part("structural_class_id")
    assigned = shapes.string(part("assignment_status")) == "assigned"
    named = F.coalesce(shapes.string(label).rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,255}$"), F.lit(False))
    checks = [
        found("assignment", has("structural_class_id") & assigned & ~named, "structural_class_id", "invalid_field"),
        found("assignment", has("structural_class_id") & ~assigned & (shapes.kind(label) != "null"), "structural_class_id", "class_on_unresolved_assignment"),
        *[found("frame", has(name) & ~shapes.string(part(name)).eqNullSafe(F.lit(value)), name, "unsupported_frame_identity") for name, value in PINNED.items()],
        *[found(kind, ~shapes.string(part(field)).eqNullSafe(F.col("record_id")), field, "identity_alias_mismatch") for kind, field in IDENTITY.items()],
    ]
    names = F.transform(shapes.items(part("classes")), lambda c: shapes.string(F.try_element_at(shapes.fields(c), F.lit("structural_class_id"))))
    described = F.forall(shapes.items(part("classes")), lambda c: F.forall(F.array(*[F.lit(x) for x in ("name", "membership_rule", "permitted_variation", "distinguishing_evidence")]), lambda k: F.coalesce(F.trim(shapes.string(F.try_element_at(shapes.fields(c), k))), F.lit("")) != ""))
    checks += [
        found("reference_registry", has("classes") & ~names.eqNullSafe(F.array(*map(F.lit, CLASSES))), "classes", "invalid_field"),
        found("reference_registry", has("classes") & ~F.coalesce(described, F.lit(False)), "classes", "invalid_class_descriptor"),
        found("reference_registry", ~shapes.string(part("reference_registry_id")).eqNullSafe(F.lit(PINNED["reference_registry_id"])), "reference_registry_id", "invalid_field"),
    ]
    return records.select("record_type", "record_id", F.explode(F.array_compact(F.array(*checks))).alias("p")).select("record_type", "record_id", "p.path", "p.code")


def defects(records: DataFrame, *, reviews: list[str] = REVIEWS, policies: list[str] = POLICIES) -> DataFrame:
    """record_type, record_id, path, code of every defect of well-formed records (record_type, record_id, line).

    Field names are told from field to field: a record has as many rows as it has defects. An assignment's or a registry's
    field may be wrong by its shape and by its relation to others; equal rows are one.
    """
    parsed = records.select("record_type", "record_id", F.try_parse_json("line").alias("v")).where("v IS NOT NULL")
    types = CORE_TYPES + SUPPORT_TYPES
    by_field = shapes.shape_problems(parsed, table(records.sparkSession, reviews, policies), types=types)
    return by_field.unionByName(_relations(parsed)).distinct()
