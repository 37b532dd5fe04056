"""Record bundles: a manifest, JSON or JSONL record files beside it, and artifacts, as tables and a table of problems.

Files are read by Spark (binary and text scans), so that a bundle may lie in any store. Only the manifest is parsed on
the driver. No identity is repaired: repeated ones stay and are unresolved wherever they are looked up.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.functions.canonical import InputProblem, json_problem, parse_strict
from prismet.functions.status import is_id, is_relative_path
from prismet.session import ship, written

MAX_FILE, MAX_LINE, MAX_RECORDS = 16 << 20, 1 << 20, 100_000
VERSION = "0.1"
CORE_TYPES = ["frame", "protocol", "cell", "attempt", "realization", "assignment", "validity", "artifact", "raw_artifact", "reference_registry"]
SUPPORT_TYPES = ["evidence", "role", "lineage", "independence_assessment", "annotation", "adjudication", "domain_suite", "domain_result", "audit", "exposure", "integrity_assessment", "intake", "tail", "correction", "preregistration", "budget", "sampling_plan", "source"]
#: Identity fields of the core types (fixed values).
IDENTITY = {
    "frame": "frame_id", "protocol": "generation_protocol_id", "cell": "analysis_cell_id", "attempt": "attempt_id", "realization": "sample_id", "assignment": "assignment_id",
    "validity": "validity_id", "artifact": "artifact_id", "raw_artifact": "artifact_id", "reference_registry": "reference_registry_id",
}
#: The pinned class registry (fixed values, in their order).
CLASSES = ["SORT-ADJ", "SORT-INS", "SORT-SEL", "SORT-MERGE", "SORT-PIVOT", "SORT-HEAP", "SORT-COUNT", "SORT-RADIX"]

_K = lambda t: f"struct<state:string,value:{t},reason:string,evidence_refs:array<struct<record_type:string,record_id:string,record_version:string>>>"
_REF = "struct<record_type:string,record_id:string,record_version:string>"
#: Columns of the record tables, beside record_type, record_id and record_version.
SCHEMAS = {
    "frame": "frame_id string, task_id string, structural_schema_id string, reference_registry_id string, validity_rubric_ref string",
    "protocol": f"generation_protocol_id string, generation_protocol_version string, conditioning_context_ref {_K(_REF)}, decoding_settings {_K('map<string,string>')}, seed {_K('string')}",
    "cell": "analysis_cell_id string, frame_id string, generation_protocol_id string, generation_protocol_version string, prompt_block_id string, prompt_id string, condition_id string",
    "attempt": f"attempt_id string, analysis_cell_id string, attempt_status string, retry_of {_K('string')}, generation_group_id {_K('string')}, planned_candidate_count {_K('int')}, registered_call_order {_K('int')}",
    "realization": f"sample_id string, analysis_cell_id string, attempt_id {_K('string')}, output_ref {_K(_REF)}, output_content_hash {_K('string')}, generation_group_id {_K('string')}, within_group_index {_K('int')}, sample_order {_K('int')}, completion_status string",
    "assignment": f"assignment_id string, assignment_version string, sample_id string, frame_id string, assignment_status string, structural_class_id string, assignment_review_status string, decision_rationale {_K('string')}, evidence_refs array<{_REF}>, assignment_evidence_policy_id string, assignment_evidence_policy_version string, supersedes_assignment_id {_K('string')}",
    "validity": f"validity_id string, validity_version string, sample_id string, validity_rubric_ref {_K('string')}, validity_status string, validity_review_status string, evidence_refs array<{_REF}>, decision_rationale {_K('string')}, supersedes_validity_id {_K('string')}",
    "artifact": f"artifact_id string, content_ref {_K('struct<kind:string,path:string,locator:string>')}, expected_sha256 {_K('string')}",
}
SCHEMAS["raw_artifact"] = SCHEMAS["artifact"]
#: Values that status columns may have.
ENUMS = {
    "assignment": {"assignment_status": ["assigned", "unresolved", "unclassified"]},
    "validity": {"validity_status": ["valid", "invalid", "undetermined", "not_assessed"]},
}


#: Fields of a support record's payload that decisions look at.
_SUPPORT = f"data_role string, mock boolean, state string, scope_refs array<{_REF}>, origin {_K('string')}, knowledge_type {_K('string')}, evidence_refs array<{_REF}>, target_ref {_REF}, purpose string, assertion {_K('string')}, method {_K('string')}, detail {_K('string')}, artifact_refs array<{_REF}>, reviewer_refs array<{_REF}>, subject_hash {_K('string')}, access string, conflict_status string, decision_state string, outcome string, basis_refs array<{_REF}>, disagreement_refs array<{_REF}>, target_refs array<{_REF}>, effect string, action string, stage string, replacement_refs array<{_REF}>, reason {_K('string')}"
#: Payload fields of the support types (fixed values): those of all types, then those of each.
SUPPORT_COMMON = ["payload_version", "data_role", "mock", "state", "scope_refs", "origin", "knowledge_type", "transformation_refs", "evidence_refs"]
SUPPORT_FIELDS = {
    "evidence": ["target_ref", "purpose", "assertion", "method", "detail", "artifact_refs", "reviewer_refs", "subject_hash", "access", "conflict_status"],
    "role": ["entity_id", "entity_type", "role", "method", "qualification", "exposure_refs"],
    "lineage": ["subject_ref", "parent_ref", "relation", "knowledge_state"],
    "independence_assessment": ["left_ref", "right_ref", "dimension", "outcome", "criterion", "reviewer_refs"],
    "annotation": ["target_ref", "annotator_ref", "aspect", "rubric_ref", "initial", "label_exposure", "outcome", "set_id"],
    "adjudication": ["target_ref", "decision_state", "outcome", "reviewer_refs", "basis_refs", "disagreement_refs"],
    "domain_suite": ["suite_id", "stage", "property", "planned_case_count", "reference_artifact_refs", "environment", "oracle_origin"],
    "domain_result": ["target_ref", "suite_ref", "property", "outcome", "subject_hash", "environment", "input_manifest", "observations"],
    "audit": ["stage", "planned_refs", "reviewed_refs", "sampling_plan_ref", "annotation_refs", "targeted_refs"],
    "exposure": ["subject_ref", "role_ref", "stage", "material_refs", "exposed"],
    "integrity_assessment": ["claim_kind", "claim", "requirements", "declared_disposition", "reviewer_refs", "assessed_at", "current_until", "reconsideration_triggers"],
    "intake": ["component", "stage", "original_refs", "proposed_change", "disposition", "reviewer_refs"],
    "tail": ["class_id", "designation", "basis", "reference_refs", "review_refs", "disposition"],
    "correction": ["target_refs", "effect", "action", "stage", "replacement_refs", "reviewer_refs", "event_type", "prior_result_ids", "reason"],
    "preregistration": ["registration_id", "registered_at", "material_refs"],
    "budget": ["planned", "actual"],
    "sampling_plan": ["planned_refs", "selection_rule", "registered_at"],
    "source": ["source_id", "sha256", "locator"],
}
#: Values of closed payload fields (fixed values).
SUPPORT_ENUMS = {
    "data_role": ["fixture", "pilot", "confirmatory", "descriptive"],
    "state": ["active", "challenged", "withdrawn", "superseded", "unresolved"],
    "purpose": ["fixture_declaration", "mechanism", "validity", "schema", "independence", "observation", "reference"],
    "access": ["readable", "unavailable", "withheld", "unknown"],
    "conflict_status": ["none_declared", "resolved", "unresolved"],
    "decision_state": ["resolved", "unresolved"],
    "effect": ["membership", "validity", "independence", "schema", "registry", "metadata"],
    "action": ["challenge", "withdraw", "replace", "annotate"],
}


def relative_parts(path: str) -> list[str]:
    """The parts of a safe relative path; anything else is an InputProblem."""
    parts = path.split("/") if isinstance(path, str) else []
    if not parts or any(p in ("", ".", "..") or re.search(r"[\\$\x00-\x1f\x7f]", p) for p in parts):
        raise InputProblem("unsafe_relative_path")
    return parts


def snapshots(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """path, content, length, sha256, problem of each file [S1]; a file beyond the size cap keeps no content."""
    for p in paths:
        relative_parts(p)
    raw = spark.read.format("binaryFile").load([f"{root.rstrip('/')}/{p}" for p in paths])
    big = F.col("length") > MAX_FILE
    return raw.select(F.col("path"), F.when(~big, F.col("content")).alias("content"), "length", F.when(~big, F.sha2("content", 256)).alias("sha256"), F.when(big, "file_size_exceeded").alias("problem"))


def _full(c) -> Column:
    """A file's path without its scheme, as Spark and its caller may spell it."""
    return F.regexp_replace(c, "^[a-z0-9]+:/*", "/")


def existing(paths: DataFrame, root: str) -> DataFrame:
    """Those of the safe relative paths (path) that are files below the root: one listing by Spark, which opens no file."""
    spark = paths.sparkSession
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(_full("path").alias("_full"), "length")
    return paths.select("path").distinct().withColumn("_full", _full(F.concat(F.lit(base), "path"))).join(files, "_full")


def hashes(paths: DataFrame, root: str) -> DataFrame:
    """path (as given), sha256 and problem of the files that exist [S1], however many they are; no other file is opened.

    The files are read in groups of at most ``MAX_RECORDS`` names, of which the driver holds one at a time.
    """
    spark = paths.sparkSession
    there = written(existing(paths, root).withColumn("_group", F.pmod(F.xxhash64("path"), F.lit(64))))
    n = there.count()
    groups = [None] if n <= MAX_RECORDS // 2 else list(range(64))
    out = spark.createDataFrame([], "path string, sha256 string, problem string")
    for g in groups:
        own = there if g is None else there.where(F.col("_group") == g)
        names = [r[0] for r in own.select("path").collect()]
        if names:
            found = snapshots(spark, root, names).select(_full("path").alias("_full"), "sha256", "problem")
            out = out.unionByName(written(own.select("path", "_full").join(found, "_full").select("path", "sha256", "problem")))
    return out


def json_lines(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """file, line (text) and problem of each line of JSONL files [S3, S4]: an over-long or bad line is a row, not an end."""
    ship(spark)
    for p in paths:
        relative_parts(p)
    rows = spark.read.option("lineSep", "\n").text([f"{root.rstrip('/')}/{p}" for p in paths]).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    rows = rows.where(F.trim("line") != "")
    long = F.octet_length("line") > MAX_LINE
    return rows.withColumn("problem", F.when(long, "line_size_exceeded").otherwise(json_problem(F.when(~long, F.col("line")))))


@dataclass
class Bundle:
    """Tables of a loaded bundle."""

    manifest: dict
    records: DataFrame
    problems: DataFrame
    root: str = ""

    def table(self, kind: str) -> DataFrame:
        """The records of one type as columns, well-formed lines only."""
        own = self.records.where((F.col("record_type") == kind) & F.col("problem").isNull())
        parsed = F.from_json("line", "record_type string, record_id string, record_version string, " + SCHEMAS[kind])
        return own.select(parsed.alias("r")).select("r.*")

    def keys(self) -> DataFrame:
        """key ('type:id') of the records that a reference can resolve to: well formed, of an identity that occurs once."""
        own = self.records.where(F.col("problem").isNull()).select(F.concat_ws(":", "record_type", "record_id").alias("key"))
        return own.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("key")

    def support(self) -> DataFrame:
        """key, record_type and the decisive payload fields of support records of a unique identity; references as keys."""
        own = self.records.where(F.col("problem").isNull() & F.col("record_type").isin(*SUPPORT_TYPES))
        p = F.from_json("line", f"payload struct<{_SUPPORT}>")["payload"]
        rows = own.select(F.concat_ws(":", "record_type", "record_id").alias("key"), "record_type", "record_id", p.alias("p"))
        one = lambda c: F.when(F.col(f"p.{c}").isNotNull(), F.concat_ws(":", f"p.{c}.record_type", f"p.{c}.record_id"))
        many = lambda c: F.coalesce(F.transform(f"p.{c}", lambda r: F.concat_ws(":", r["record_type"], r["record_id"])), F.array().cast("array<string>"))
        ruling = F.when(F.get_json_object("p.outcome", "$.state") == "known", F.get_json_object("p.outcome", "$.value"))
        rows = rows.select(
            "key", "record_type", "record_id", "p.state", "p.data_role", "p.mock", "p.purpose", "p.access", F.col("p.conflict_status").alias("conflict"), one("target_ref").alias("target"), many("scope_refs").alias("scopes"),
            many("reviewer_refs").alias("reviewers"), many("evidence_refs").alias("evidence"), many("artifact_refs").alias("artifacts"), many("basis_refs").alias("basis"), many("disagreement_refs").alias("disagreements"), many("target_refs").alias("targets"), many("replacement_refs").alias("replacements"),
            *[_known(f"p.{c}").alias(c) for c in ("assertion", "detail", "method", "subject_hash", "origin", "knowledge_type", "reason")], "p.decision_state", F.when(F.col("record_type") == "adjudication", ruling).otherwise(F.col("p.outcome")).alias("outcome"), "p.effect", "p.action", "p.stage",
        )
        return rows.join(self.keys(), "key", "left_semi")

    def artifact_states(self) -> DataFrame:
        """key, status, expected and actual hash of each artifact [S5]: its file is read if it is local, and no other."""
        both = self.table("artifact").unionByName(self.table("raw_artifact"))
        rows = both.select(F.concat_ws(":", "record_type", "record_id").alias("key"), F.col("content_ref.state").alias("_state"), _known("content_ref").alias("_at"), _known("expected_sha256").alias("expected"))
        local = (F.col("_state") == "known") & ~F.col("_at.kind").eqNullSafe(F.lit("external"))
        paths = rows.where(local & is_relative_path(F.col("_at.path"))).select("_at.path").distinct()
        seen = hashes(paths, self.root).select("path", F.col("sha256").alias("actual"))
        rows = rows.withColumn("path", F.when(local, F.col("_at.path"))).join(seen, "path", "left")
        status = F.when(F.col("_state") != "known", F.concat(F.lit("content_"), "_state")).when(~local, "external_not_fetched").when(F.col("actual").isNull(), "unavailable").when(F.col("expected").isNotNull() & (F.col("expected") != F.col("actual")), "hash_mismatch").otherwise("snapshot_read")
        return rows.select("key", status.alias("status"), "expected", "actual")

    def corrections(self) -> DataFrame:
        """correction_id, stage, effect, action, targets of the corrections, and whether their own basis is there [F4]."""
        s, keys = self.support(), self.keys().select(F.col("key").alias("_ref"), F.lit(True).alias("_there"))
        own = s.where("record_type = 'correction'")
        roles = s.where("record_type = 'role' AND state = 'active'").select(F.col("key").alias("_ref"), F.lit(True).alias("_role"))
        needed = F.array_union("evidence", F.when(F.col("action") == "replace", F.col("replacements")).otherwise(F.array().cast("array<string>")))
        refs = own.select("key", "reviewers", F.explode(F.array_union(needed, F.col("reviewers"))).alias("_ref"))
        held = refs.join(keys, "_ref", "left").join(roles, "_ref", "left").groupBy("key").agg(F.bool_and(F.coalesce("_there", F.lit(False)) & (~F.array_contains("reviewers", F.col("_ref")) | F.coalesce("_role", F.lit(False)))).alias("_held"))
        whole = (F.size("targets") > 0) & (F.size("reviewers") > 0) & (F.size("evidence") > 0) & ((F.col("action") != "replace") | (F.size("replacements") > 0)) & (F.coalesce(F.trim("reason"), F.lit("")) != "")
        sound = (F.col("state") == "active") & whole & F.coalesce("_held", F.lit(False))
        return own.join(held, "key", "left").select(F.col("record_id").alias("correction_id"), "stage", "effect", "action", "targets", F.coalesce(sound, F.lit(False)).alias("sound"))

    def declared(self, name: str, schema: str) -> DataFrame:
        """Rows of a list of the analysis configuration, such as selection or pins, with an explicit schema."""
        import json

        spark = self.records.sparkSession
        rows = self.manifest["analysis_config"].get(name) or []
        return spark.createDataFrame([(json.dumps(r),) for r in rows], "line string").select(F.from_json("line", schema).alias("r")).select("r.*")


def _known(column: str) -> Column:
    return F.when(F.col(f"{column}.state") == "known", F.col(f"{column}.value"))


def record_problems(lines: DataFrame) -> DataFrame:
    """lines with record_type, record_id and the first problem of each record [S7, S8]: envelope, identity, closed enums."""
    base = F.from_json("line", "record_type string, record_id string, record_version string")
    rows = lines.withColumn("_b", F.when(F.col("problem").isNull(), base)).withColumns({"record_type": F.col("_b.record_type"), "record_id": F.col("_b.record_id"), "record_version": F.col("_b.record_version")}).drop("_b")
    ident = F.lit(None).cast("string")
    for kind, field in IDENTITY.items():
        ident = F.when(F.col("record_type") == kind, F.get_json_object("line", f"$.{field}")).otherwise(ident)
    found = F.col("problem")
    found = F.coalesce(found, F.when(F.col("record_type").isNull() | ~F.col("record_type").isin(*CORE_TYPES, *SUPPORT_TYPES), "unsupported_record_type"), F.when(F.col("record_version") != VERSION, "unsupported_record_version"), F.when(~is_id(F.col("record_id")), "invalid_record_id"))
    found = F.coalesce(found, F.when(F.col("record_type").isin(*CORE_TYPES) & ~ident.eqNullSafe(F.col("record_id")), "record_identity_mismatch"))
    for kind, enums in ENUMS.items():
        for field, values in enums.items():
            found = F.coalesce(found, F.when((F.col("record_type") == kind) & ~F.coalesce(F.get_json_object("line", f"$.{field}"), F.lit("")).isin(*values), f"invalid_{field}"))
    rows = rows.withColumn("problem", found)
    names = F.json_object_keys(F.get_json_object("line", "$.payload"))
    fields = F.create_map(*[x for kind, own in SUPPORT_FIELDS.items() for x in (F.lit(kind), F.array(*map(F.lit, SUPPORT_COMMON + own)))])
    rows = rows.withColumn("_want", F.when(F.col("problem").isNull(), F.try_element_at(fields, F.col("record_type")))).withColumn("_has", F.when(F.col("_want").isNotNull(), names))
    wrong = F.when(F.col("_has").isNull(), "missing_support_payload").when(F.size(F.array_except("_want", "_has")) > 0, "missing_support_field").when(F.size(F.array_except("_has", F.array_append("_want", F.lit("extensions")))) > 0, "unknown_support_field")
    for field, values in SUPPORT_ENUMS.items():
        wrong = wrong.when(F.array_contains("_want", field) & ~F.coalesce(F.get_json_object("line", f"$.payload.{field}"), F.lit("")).isin(*values), "invalid_support_field")
    return rows.withColumn("problem", F.coalesce("problem", F.when(F.col("_want").isNotNull(), wrong))).drop("_want", "_has")


def _closed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records with the first defect of their shape as their problem, and all defects as problems with their paths."""
    from prismet.sources import record_shapes

    found = written(record_shapes.defects(records.where("problem IS NULL")))
    first = found.groupBy("record_type", "record_id").agg(F.min(F.struct("path", "code")).alias("_first"))
    out = records.join(first, ["record_type", "record_id"], "left").withColumn("problem", F.coalesce("problem", F.col("_first.code"))).select(records.columns)
    return out, found.select(F.col("path").alias("file"), "record_type", "record_id", F.col("code").alias("problem"))


def load_bundle(spark: SparkSession, root: str, manifest: str = "bundle.json", max_records: int | None = MAX_RECORDS, *, closed: bool = False) -> Bundle:
    """Read a bundle [S5, S6]: the manifest strictly, then all declared record files in one scan.

    More than ``max_records`` records are refused, none is dropped; None lifts the cap. ``closed`` also checks the whole
    field set and every field's shape: a defect is a row of ``problems`` whose ``file`` is the path of the field, and its
    record takes part in nothing.
    """
    relative_parts(manifest)
    raw = snapshots(spark, root, [manifest]).first()
    if raw["problem"]:
        raise InputProblem(raw["problem"])
    data = parse_strict(bytes(raw["content"]))
    missing = {"input_schema_version", "bundle_id", "data_role", "record_files", "analysis_config"} - set(data)
    if missing or data["input_schema_version"] != VERSION:
        raise InputProblem("invalid_manifest")
    files = [f["path"] for f in data["record_files"]]
    if files:
        lines = json_lines(spark, root, files)
    else:
        lines = spark.createDataFrame([], "file string, line string, problem string")
    inline = [(manifest, _text(x), None) for key in ("frames", "protocols", "cells") for x in data.get(key) or []]
    lines = lines.unionByName(spark.createDataFrame(inline, "file string, line string, problem string"))
    records = written(record_problems(lines))  # many tables are read from it
    defects = None
    if closed:
        records, defects = _closed(records)
        records = written(records)
    repeated = records.where(F.col("record_id").isNotNull()).groupBy("record_type", "record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    problems = records.where(F.col("problem").isNotNull()).select("file", "record_type", "record_id", "problem").unionByName(repeated.select(F.lit(None).cast("string").alias("file"), "record_type", "record_id", F.lit("duplicate_record_identity").alias("problem")))
    if defects is not None:
        problems = problems.join(defects.select("record_type", "record_id", "problem"), ["record_type", "record_id", "problem"], "left_anti").select(problems.columns).unionByName(defects)
    if max_records is not None and records.count() > max_records:
        raise InputProblem("record_count_exceeded")
    return Bundle(data, records, problems, root)


def _text(value) -> str:
    import json

    return json.dumps(value)


def references(bundle: Bundle) -> DataFrame:
    """source, field, target_type, target_id of the declared links between core records, for referential checks [J2]."""
    real, assign, valid, cell = (bundle.table(k) for k in ("realization", "assignment", "validity", "cell"))

    def link(table, own, kind, field, target):
        return table.select(F.concat(F.lit(kind + ":"), own).alias("source"), F.lit(field).alias("field"), F.lit(target).alias("target_type"), F.col(field).alias("target_id"), F.lit(None).cast("string").alias("expected_type")).where(F.col("target_id").isNotNull())

    out = link(real, "sample_id", "realization", "analysis_cell_id", "cell").unionByName(link(assign, "assignment_id", "assignment", "sample_id", "realization"))
    out = out.unionByName(link(assign, "assignment_id", "assignment", "frame_id", "frame")).unionByName(link(valid, "validity_id", "validity", "sample_id", "realization")).unionByName(link(cell, "analysis_cell_id", "cell", "frame_id", "frame"))
    return out.unionByName(link(real.withColumn("attempt_id", _known("attempt_id")), "sample_id", "realization", "attempt_id", "attempt"))
