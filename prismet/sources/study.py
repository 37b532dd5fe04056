"""Study files: schemas as data, packets checked against them, and a finite inventory joined with what is there."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.functions.canonical import InputProblem, Number, parse_strict
from prismet.operators.study import CONDITIONS
from prismet.sources.bundle import hashes, relative_parts, snapshots

_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.:-]{0,255}")
_HASH = re.compile(r"[0-9a-f]{64}")


@dataclass(frozen=True)
class Problem:
    code: str
    path: str


def _timestamp(x) -> bool:
    try:
        return isinstance(x, str) and datetime.fromisoformat(x.replace("Z", "+00:00")).tzinfo is not None
    except ValueError:
        return False


PRIMITIVES = {
    "string": lambda x: isinstance(x, str) and not isinstance(x, Number) and bool(x.strip()),
    "identifier": lambda x: isinstance(x, str) and bool(_ID.fullmatch(x)),
    "hash": lambda x: isinstance(x, str) and bool(_HASH.fullmatch(x)),
    "integer": lambda x: type(x) is int,
    "positive": lambda x: type(x) is int and x > 0,
    "boolean": lambda x: type(x) is bool,
    "decimal": lambda x: type(x) is int or isinstance(x, Number),
    "timestamp": _timestamp,
}


def check(spec, value, path: str = "$") -> list[Problem]:
    """Problems of a value against a specification.

    A specification is the name of a primitive, or a one-entry dict: object (field -> specification, optional fields end
    in '?'), array, enum, literal, choice (one of several must hold) or knowledge (a value that may be unknown).
    """
    if isinstance(spec, str):
        return [] if PRIMITIVES[spec](value) else [Problem(f"invalid_{spec}", path)]
    (kind, inner), *_ = spec.items()
    if kind == "object":
        if not isinstance(value, dict):
            return [Problem("invalid_object", path)]
        names = {k.rstrip("?"): (k.endswith("?"), s) for k, s in inner.items()}
        out = [Problem("unknown_field", f"{path}.{k}") for k in value if k not in names]
        for name, (optional, s) in names.items():
            if name in value:
                out += check(s, value[name], f"{path}.{name}")
            elif not optional:
                out.append(Problem("missing_field", f"{path}.{name}"))
        return out
    if kind == "array":
        if not isinstance(value, list):
            return [Problem("invalid_array", path)]
        return [p for k, x in enumerate(value) for p in check(inner, x, f"{path}[{k}]")]
    if kind == "enum":
        return [] if isinstance(value, str) and value in inner else [Problem("invalid_enum", path)]
    if kind == "literal":
        return [] if value == inner and type(value) is type(inner) else [Problem("invalid_literal", path)]
    if kind == "choice":
        return [] if any(not check(s, value, path) for s in inner) else [Problem("no_choice_matches", path)]
    if kind == "knowledge":
        if not isinstance(value, dict) or value.get("state") not in ("known", "unknown", "unavailable", "not_applicable"):
            return [Problem("invalid_knowledge", path)]
        if value["state"] == "known":
            return check(inner, value["value"], f"{path}.value") if "value" in value else [Problem("known_value_missing", path)]
        blank = not str(value.get("reason") or "").strip()
        return ([Problem("unexpected_knowledge_value", path)] if value.get("value") is not None else []) + ([Problem("knowledge_reason_missing", path)] if value["state"] != "unknown" and blank else [])
    raise ValueError(kind)


REFERENCE = {"object": {"record_type": "identifier", "record_id": "identifier", "record_version": "string"}}
PACKETS = {
    "collection_submission": {"object": {"packet_id": "identifier", "calls": {"array": {"object": {"call_id": "identifier", "group": "positive", "block": "positive", "condition": {"enum": CONDITIONS}, "call_order": "positive", "status": {"enum": ["planned", "completed", "failed", "refused"]}, "observed_at": {"knowledge": "timestamp"}, "response_sha256": {"knowledge": "hash"}}}}}},
    "evidence_qualification": {"object": {"packet_id": "identifier", "artifacts": {"array": {"object": {"artifact_id": "identifier", "sha256": "hash", "membership": {"knowledge": "string"}, "validity": {"enum": ["valid", "invalid", "undetermined", "not_assessed"]}, "evidence_refs": {"array": REFERENCE}}}}}},
    "reviewer_roster": {"object": {"packet_id": "identifier", "reviewers": {"array": {"object": {"person_id": "identifier", "roles": {"array": "identifier"}, "independent": {"knowledge": "boolean"}}}}}},
    "review_submission": {"object": {"packet_id": "identifier", "person_id": "identifier", "slot": "positive", "items": {"array": {"object": {"item_id": "identifier", "assignment_status": {"enum": ["assigned", "unresolved", "unclassified"]}, "structural_class_id?": "identifier", "validity_status": {"enum": ["valid", "invalid", "undetermined", "not_assessed"]}}}}}},
    "validation_packet": {"object": {"packet_id": "identifier", "suite_sha256": "hash", "results": {"array": {"object": {"case_id": "identifier", "passed": "boolean"}}}}},
    "activity_packet": {"object": {"packet_id": "identifier", "requirements": {"array": "identifier"}, "pins": {"array": {"object": {"packet_id": "identifier", "sha256": "hash"}}}, "depends_on": {"array": "identifier"}}},
}
ENVELOPE = {"object": {"study_id": "identifier", "study_version": "string", "evidence_policy": {"enum": ["fixture_only", "adjudicated_import"]}, "material_role": {"enum": ["fixture", "pilot", "main"]}, "packet_inventory": {"array": {"object": {"packet_id": "identifier", "packet_type": {"enum": sorted(PACKETS)}, "path": "string", "sha256": "hash"}}}, "prior_study_versions?": {"array": "string"}, "records?": {"array": {"object": {"record_id": "identifier", "record_type": "identifier", "revision": "positive", "supersedes?": "identifier"}}}}}


def parse_packet(kind: str, data: bytes) -> tuple[dict | None, list[Problem]]:
    """A packet's value, or None with its problems."""
    try:
        value = parse_strict(data)
    except InputProblem as e:
        return None, [Problem(str(e), "$")]
    found = check(PACKETS[kind], value)
    return (None if found else value), found


def load_study(spark: SparkSession, root: str, name: str = "study.json") -> tuple[dict, DataFrame]:
    """The envelope, and packet_id, packet_type, path, status of each inventoried packet.

    A missing file is an uncertainty (missing), a different one an error (mismatch); nothing outside the inventory is read.
    """
    relative_parts(name)
    envelope = parse_strict(bytes(snapshots(spark, root, [name]).first()["content"]))
    found = check(ENVELOPE, envelope)
    if found:
        raise InputProblem(found[0].code)
    rows = [(p["packet_id"], p["packet_type"], p["path"], p["sha256"]) for p in envelope["packet_inventory"]]
    for r in rows:
        relative_parts(r[2])
    inventory = spark.createDataFrame(rows, "packet_id string, packet_type string, path string, sha256 string")
    there = hashes(spark.createDataFrame([(r[2],) for r in rows], "path string"), root).select("path", F.col("sha256").alias("_sha"), F.col("problem").alias("_problem"))
    both = inventory.join(there, "path", "left")
    return envelope, both.select("packet_id", "packet_type", "path", F.when(F.col("_problem").isNotNull(), F.col("_problem")).when(F.col("_sha").isNull(), "missing").when(F.col("_sha") != F.col("sha256"), "mismatch").otherwise("verified").alias("status"))


def record_semantics(records: DataFrame) -> DataFrame:
    """Problems across the records of a study [V17]: repeated ids, revisions that do not grow, several hashes of one artifact."""
    n = records.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("record_id", F.lit("duplicate_record_identity").alias("problem"))
    prior = records.select(F.col("record_id").alias("supersedes"), F.col("revision").alias("_r"))
    order = records.join(prior, "supersedes", "left").where(F.col("supersedes").isNotNull() & (F.col("_r").isNull() | (F.col("revision") <= F.col("_r")))).select("record_id", F.lit("supersession_order").alias("problem"))
    out = n.union(order)
    if "artifact_sha256" in records.columns:
        out = out.union(records.groupBy("artifact_id").agg(F.count_distinct("artifact_sha256").alias("n")).where("n > 1").select(F.col("artifact_id").alias("record_id"), F.lit("artifact_hash_conflict").alias("problem")))
    return out


def prompt_bytes(parts: list[str]) -> bytes:
    """Prompt assembly [X18]: parts joined by an empty line."""
    return "\n\n".join(parts).encode()
