"""Longitudinal declarations of a bundle as tables: walked from VARIANT, one row for each object, reference and list item.

The declaration is one object of the manifest; every family in it is a list of versioned objects. Each is a record of its
own here, so that the operators on lineages and bindings get the tables they take. What a field does not know is null,
whatever its state of knowledge; a field of another type than its table's is null as well, and a row of ``problems``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismet.functions.status import is_id
from prismet.operators import shapes
from prismet.session import written
from prismet.sources.bundle import CORE_TYPES, SUPPORT_TYPES, VERSION, Bundle

#: How the names of supported profiles end, after that of their producer, and the method (fixed values).
PROFILE, METHOD = "_longitudinal_v1", "longitudinal_records_v1"
#: Families of objects and the kind of each (fixed values).
FAMILIES = {
    "states": "state", "panels": "panel", "measurements": "measurement", "roots": "root", "transitions": "transition", "trajectories": "trajectory", "observed_requests": "observed_request",
    "null_scenarios": "null_scenario", "shl_requests": "shl_request", "assays": "assay", "interventions": "intervention", "recovery_episodes": "recovery_episode", "revisions": "revision", "replays": "replay",
}
_OBJECT = ["object_id", "object_kind", "object_version"]
_O = "struct<object_kind:string,object_id:string,object_version:string>"
_R = "struct<record_type:string,record_id:string,record_version:string>"
_EVIDENCE = "evidence struct<process:array<variant>>"


def _k(kind: str) -> str:
    return f"struct<state:string,value:{kind}>"


#: Fields of each family that the tables read.
FIELDS = {
    "state": f"state_kind string, stage_role string, state_time {_k('string')}, subject_identity {_k(f'struct<parameter_identity:{_k('string')},checkpoint_sha256:{_k('string')}>')}, ancestor_refs {_k(f'array<{_O}>')}, measurement_refs array<{_O}>",
    "panel": f"frame_ref {_R}, protocol_ref {_R}, registry_ref {_R}, stage_role string, view string, planned_realizations {_k('long')}, selection_rule {_k('string')}",
    "measurement": f"state_ref {_O}, cell_ref {_R}, panel_ref {_k(_O)}, frame_ref {_R}, protocol_ref {_R}, registry_ref {_R}, view string, data_role string, planned_realizations {_k('long')}, selection_rule {_k('string')}, sample_refs {_k(f'array<{_R}>')}",
    "transition": f"transition_kind string, parent_refs {_k(f'array<{_O}>')}, child_ref {_O}, round_distance {_k('long')}, event_time {_k('string')}, process_status string, parameter_change {_k('boolean')}, contributions array<struct<parent_ref:{_O}>>, component_refs array<{_O}>, {_EVIDENCE}",
    "trajectory": f"state_refs array<{_O}>, transition_refs array<{_O}>, round_coordinates array<{_k('long')}>, panel_refs array<{_O}>, schedule array<struct<state_ref:{_O},panel_ref:{_O},recursive_round_index:{_k('long')},observation_status:string,measurement_ref:{_k(_O)},reason:{_k('string')}>>",
    "observed_request": f"state_refs array<{_O}>, trajectory_ref {_k(_O)}, view string, protected_tail_ref {_k(_R)}",
    "shl_request": f"trajectory_ref {_O}, start_ref {_O}, end_ref {_O}, view string",
}


def _value(c: Column) -> Column:
    return F.when(c["state"] == "known", c["value"])


def object_key(ref: Column) -> Column:
    """kind:id:version of an object reference; null if any part is."""
    return F.concat(ref["object_kind"], F.lit(":"), ref["object_id"], F.lit(":"), ref["object_version"])


def _keys(refs: Column) -> Column:
    return F.transform(refs, object_key)


def _id(ref: Column) -> Column:
    return ref["record_id"]


@dataclass
class Longitudinal:
    """Objects (family, kind, key, place, v) of a declaration, and problems (key, path, code) of their envelopes and references."""

    objects: DataFrame
    problems: DataFrame
    data_role: str
    bundle: Bundle

    def table(self, kind: str) -> DataFrame:
        """key and the fields of the objects of a kind, of those whose key is there once."""
        own = self.objects.where((F.col("kind") == kind) & ~F.col("faulty"))
        schema = ",".join(f"{name}:{rest}" for name, rest in (f.split(" ", 1) for f in _split(FIELDS[kind])))
        return own.select("key", F.try_variant_get("v", "$", f"struct<{schema}>").alias("o")).select("key", "o.*")

    def states(self) -> DataFrame:
        s = self.table("state")
        model = _value(F.col("subject_identity"))
        return s.select(
            F.col("key").alias("state"), F.col("state_kind").alias("kind"), "state_kind", "stage_role", _value(model["checkpoint_sha256"]).alias("checkpoint"), _value(model["parameter_identity"]).alias("parameters"), model.cast("string").alias("identity"),
            F.try_to_timestamp(_value(F.col("state_time"))).alias("time"), _keys(_value(F.col("ancestor_refs"))).alias("ancestors"), _keys(F.col("measurement_refs")).alias("linked"),
        )

    def panels(self) -> DataFrame:
        p = self.table("panel")
        return p.select(F.col("key").alias("panel"), *[_id(F.col(f"{c}_ref")).alias(c) for c in ("frame", "protocol", "registry")], "view", _value(F.col("selection_rule")).alias("rule"), _value(F.col("planned_realizations")).alias("planned"), "stage_role")

    def measurements(self) -> DataFrame:
        m = self.table("measurement")
        return m.select(
            F.col("key").alias("measurement"), _id(F.col("cell_ref")).alias("cell"), object_key(F.col("state_ref")).alias("state"), object_key(_value(F.col("panel_ref"))).alias("panel"), "view", *[_id(F.col(f"{c}_ref")).alias(c) for c in ("frame", "protocol", "registry")],
            F.transform(_value(F.col("sample_refs")), _id).alias("samples"), _value(F.col("selection_rule")).alias("rule"), _value(F.col("planned_realizations")).alias("planned"), "data_role",
        )

    def cells(self) -> DataFrame:
        """cell, frame, protocol, registry (that of its frame) of the bundle's cells."""
        frames = self.bundle.table("frame").select("frame_id", F.col("reference_registry_id").alias("registry"))
        own = self.bundle.table("cell").join(frames, "frame_id", "left")
        return own.select(F.col("analysis_cell_id").alias("cell"), F.col("frame_id").alias("frame"), F.col("generation_protocol_id").alias("protocol"), "registry")

    def selections(self) -> DataFrame:
        rows = self.bundle.declared("selection", "analysis_cell_id string, selected_sample_ids struct<state:string,value:array<string>>, selection_basis struct<state:string,value:string>")
        return rows.select(F.col("analysis_cell_id").alias("cell"), _value(F.col("selected_sample_ids")).alias("samples"), _value(F.col("selection_basis")).alias("rule"))

    def checkpoints(self) -> DataFrame:
        """cell, checkpoint that a cell records of its model."""
        own = self.bundle.records.where("problem IS NULL AND record_type = 'cell'").select("record_id", F.try_parse_json("line").alias("v"))
        known = F.try_variant_get("v", "$.checkpoint_identifier", _k("string"))
        return own.select(F.col("record_id").alias("cell"), _value(known).alias("recorded"))

    def transitions(self) -> DataFrame:
        t = self.table("transition")
        return t.select(
            F.col("key").alias("transition"), object_key(F.col("child_ref")).alias("child"), F.col("transition_kind").alias("kind"), "process_status", (F.size(F.coalesce("evidence.process", F.array().cast("array<variant>"))) > 0).alias("documented"),
            _value(F.col("round_distance")).alias("distance"), _value(F.col("parameter_change")).alias("parameter_change"), F.try_to_timestamp(_value(F.col("event_time"))).alias("event_time"), _value(F.col("parent_refs")).isNotNull().alias("parents_known"), (F.size("component_refs") > 0).alias("has_components"),
        )

    def parents(self) -> DataFrame:
        return self.table("transition").select(F.col("key").alias("transition"), F.explode(_keys(_value(F.col("parent_refs")))).alias("parent"))

    def contributions(self) -> DataFrame:
        return self.table("transition").select(F.col("key").alias("transition"), F.explode(F.transform("contributions", lambda c: object_key(c["parent_ref"]))).alias("parent"))

    def components(self) -> DataFrame:
        return self.table("transition").select(F.col("key").alias("transition"), F.posexplode(_keys(F.col("component_refs"))).alias("place", "part"))

    def paths(self) -> DataFrame:
        t = self.table("trajectory")
        rows = t.select(F.col("key").alias("trajectory"), F.posexplode(_keys(F.col("state_refs"))).alias("place", "state"), "round_coordinates")
        return rows.select("trajectory", "place", "state", _value(F.get("round_coordinates", F.col("place"))).alias("coordinate"))

    def steps(self) -> DataFrame:
        return self.table("trajectory").select(F.col("key").alias("trajectory"), F.posexplode(_keys(F.col("transition_refs"))).alias("place", "transition"))

    def slots(self) -> DataFrame:
        """trajectory, place, state, panel, round, slot, measurement, reasoned of every scheduled observation."""
        rows = self.table("trajectory").select(F.col("key").alias("trajectory"), F.posexplode("schedule").alias("place", "s"))
        return rows.select("trajectory", "place", object_key(F.col("s.state_ref")).alias("state"), object_key(F.col("s.panel_ref")).alias("panel"), _value(F.col("s.recursive_round_index")).alias("round"), F.col("s.observation_status").alias("slot"), object_key(_value(F.col("s.measurement_ref"))).alias("measurement"), _value(F.col("s.reason")).isNotNull().alias("reasoned"))

    def clocks_asked(self) -> DataFrame:
        r = self.table("shl_request")
        return r.select(F.col("key").alias("request"), *[object_key(F.col(f"{c}_ref")).alias(c) for c in ("trajectory", "start", "end")])

    def tails_asked(self) -> DataFrame:
        """request, tail, registry: the protected tail of each request, and the one registry that its states' measurements use."""
        r = self.table("observed_request")
        own = r.select(F.col("key").alias("request"), F.concat_ws(":", F.lit("tail"), _id(_value(F.col("protected_tail_ref")))).alias("tail"), _value(F.col("protected_tail_ref")).isNotNull().alias("_asked"), "view", F.explode_outer(_keys(F.col("state_refs"))).alias("state"))
        used = own.join(self.measurements().select("state", "view", "registry"), ["state", "view"], "left").groupBy("request", "tail", "_asked").agg(F.min("registry").alias("registry"))
        return used.select("request", F.when(F.col("_asked"), F.col("tail")).alias("tail"), "registry")


def _split(fields: str) -> list[str]:
    """Top-level fields of a schema."""
    out, depth, now = [], 0, ""
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def load(b: Bundle) -> Longitudinal | None:
    """The declaration of a bundle, or None where none is made; a malformed one is a table of problems."""
    extensions = (b.manifest.get("analysis_config") or {}).get("extensions")
    if not isinstance(extensions, dict) or "longitudinal" not in extensions:
        return None
    spark, raw = b.records.sparkSession, extensions["longitudinal"]
    head = []
    if not isinstance(raw, dict):
        head.append(("", "$", "longitudinal_declaration_not_object"))
        raw = {}
    elif not str(raw.get("profile")).endswith(PROFILE) or raw.get("method_id") != METHOD:
        head.append(("", "$.profile", "unsupported_longitudinal_profile"))
    if "comparison" in extensions:
        head.append(("", "$", "several_profiles_declared"))
    rows = [(family, k, json.dumps(x)) for family in FAMILIES for k, x in enumerate(raw.get(family) if isinstance(raw.get(family), list) else [])]
    kinds = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    objects = spark.createDataFrame(rows, "family string, place int, line string").withColumn("v", F.try_parse_json("line")).withColumn("kind", kinds[F.col("family")])
    f = shapes.fields(F.col("v"))
    part = lambda name: shapes.string(F.try_element_at(f, F.lit(name)))
    key = F.concat_ws(":", "kind", part("object_id"), part("object_version"))
    known = (part("object_kind") == F.col("kind")) & is_id(part("object_id")) & is_id(part("object_version"))
    objects = objects.withColumn("key", F.when(F.coalesce(known, F.lit(False)), key)).drop("line")
    n = objects.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    objects = written(objects.join(n, "key", "left").withColumn("faulty", F.col("key").isNull() | (F.col("_n") > 1)).drop("_n"))
    place = F.concat(F.lit("$."), "family", F.lit("["), F.col("place").cast("string"), F.lit("]"))
    own = objects.where("faulty").select(F.coalesce("key", F.lit("")).alias("key"), place.alias("path"), F.when(F.col("key").isNull(), "object_identity_invalid").otherwise("duplicate_object_identity").alias("code"))
    problems = spark.createDataFrame(head, "key string, path string, code string").unionByName(own).unionByName(_reference_problems(objects, b))
    return Longitudinal(objects, written(problems), b.manifest["data_role"], b)


def _reference_problems(objects: DataFrame, b: Bundle) -> DataFrame:
    """References of objects, at any depth, to objects or records that are not there once."""
    nodes = shapes.walk(objects.where("NOT faulty").select("key", "v"), ["key"])
    f = shapes.fields(F.col("v"))
    part = lambda name: shapes.string(F.try_element_at(f, F.lit(name)))
    is_object = F.coalesce(F.array_sort(F.map_keys(f)) == F.array(*map(F.lit, _OBJECT)), F.lit(False))
    named = nodes.where((F.col("kind") == "object") & (F.col("depth") > 0) & is_object).select("key", "path", F.concat_ws(":", part("object_kind"), part("object_id"), part("object_version")).alias("target"))
    there = objects.where("NOT faulty").select(F.col("key").alias("target"))
    lost = named.join(there, "target", "left_anti").select("key", "path", F.lit("object_reference_unresolved").alias("code"))
    core = shapes.references(nodes, ["key"]).withColumn("target", F.concat_ws(":", "target_type", "target_id"))
    bad = ~F.col("target_type").isin(*CORE_TYPES, *SUPPORT_TYPES) | (F.col("target_version") != VERSION)
    gone = core.where(~bad).join(b.keys().select(F.col("key").alias("target")), "target", "left_anti")
    return lost.unionByName(gone.select("key", "path", F.lit("core_reference_unresolved").alias("code"))).unionByName(core.where(bad).select("key", "path", F.lit("invalid_reference").alias("code")))
