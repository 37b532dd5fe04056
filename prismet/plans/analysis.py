"""From a bundle to its report: load, admit, count, measure, render. Everything up to the report stays a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.functions.status import known
from prismet.operators import admission, metrics, shapes
from prismet.session import written
from prismet.sources import bundle as source
from prismet.sources import sinks


@dataclass
class Analysis:
    problems: DataFrame
    admissions: DataFrame
    populations: DataFrame
    coverage: DataFrame
    metrics: DataFrame
    prefixes: DataFrame
    exit_code: int

    def sections(self) -> dict[str, object]:
        t = sinks.SECTIONS
        return {
            t[1]: sinks.table_rows(self.problems.groupBy("problem").count(), ["problem"]),
            t[2]: {"admissions": sinks.table_rows(self.admissions.groupBy("axis", "status").count(), ["axis", "status"]), "coverage": sinks.table_rows(self.coverage.select("cell", "selected", "classified", "valid", "decisive"), ["cell"])},
            t[3]: sinks.table_rows(self.metrics.select("cell", "view", "population", "support", "sci_num", "sci_den", F.col("entropy").cast("string").alias("entropy"), "threshold_support"), ["cell", "view"]),
            t[4]: sinks.table_rows(self.prefixes, ["view", "cell", "k"]),
        }


def _references(c: str):
    return F.transform(c, lambda r: F.concat_ws(":", r["record_type"], r["record_id"]))


def _axis(bundle: source.Bundle, axis: str, samples: DataFrame, corrections: DataFrame, support: DataFrame, artifacts: DataFrame, hash_errors: DataFrame) -> DataFrame:
    config = bundle.manifest["analysis_config"]
    t = bundle.table(axis)
    label, status = ("structural_class_id", "assignment_status") if axis == "assignment" else ("validity_status", "validity_status")
    frame = F.col("frame_id") if axis == "assignment" else F.lit(None).cast("string")
    rubric = known(F.col("validity_rubric_ref")) if axis == "validity" else F.lit(None).cast("string")
    policy = F.col("assignment_evidence_policy_id") if axis == "assignment" else F.lit(None).cast("string")
    records = t.select(F.col(f"{axis}_id").alias("id"), F.col(f"{axis}_version").alias("version"), "sample_id", frame.alias("frame_id"), F.col(status).alias("label_status"), F.col(label).alias("label"), F.col(f"{axis}_review_status").alias("review"), policy.alias("policy"), known(F.col(f"supersedes_{axis}_id")).alias("supersedes"), known(F.col("decision_rationale")).alias("rationale"), _references("evidence_refs").alias("evidence"), rubric.alias("rubric"))
    pins = bundle.declared(f"{axis}_pins", f"sample_id string, {axis}_id string, {axis}_version string").select("sample_id", F.col(f"{axis}_id").alias("id"), F.col(f"{axis}_version").alias("version"))
    frames = bundle.table("frame").select("frame_id", F.col("validity_rubric_ref").alias("rubric"))
    return admission.admit(
        axis, samples, records, pins, frames, corrections, support=support, keys=bundle.keys(), artifacts=artifacts, hash_errors=hash_errors,
        policy=config["assignment_evidence_policy_id"], data_role=bundle.manifest["data_role"], classes=source.CLASSES,
    )


#: Profiles in the order in which a declared extension selects them; without one it is measurement.
PROFILES = ["longitudinal", "comparison"]


def profile(manifest: dict) -> str:
    """The profile of a bundle [F15]: a declaration selects it by being there, even if what it declares is malformed."""
    extensions = (manifest.get("analysis_config") or {}).get("extensions")
    return next((p for p in PROFILES if isinstance(extensions, dict) and p in extensions), "measurement")


@dataclass
class Validation:
    profile: str
    problems: DataFrame
    rows: DataFrame
    exit_code: int


def _deep_references(b: source.Bundle) -> DataFrame:
    """References of well-formed records wherever they stand, beside those of declared paths [X15]."""
    parsed = b.records.where("problem IS NULL").select(F.concat_ws(":", "record_type", "record_id").alias("source"), F.try_parse_json("line").alias("v"))
    found = shapes.references(shapes.walk(parsed, ["source"]), ["source"])
    return found.select("source", F.col("path").alias("field"), "target_type", "target_id", F.lit(None).cast("string").alias("expected_type"))


def validate(spark: SparkSession, root: str, manifest: str = "bundle.json", *, closed: bool = False) -> Validation:
    """Records, references and artifacts of a bundle, without any measure [V26]: nothing is admitted, counted or written out.

    problems: file, record_type, record_id, problem; rows: record_type, records, malformed. The exit code is 2 where
    something other than missing evidence is wrong. ``closed`` also checks the shape of every field and follows
    references at any depth.
    """
    b = source.load_bundle(spark, root, manifest, closed=closed)
    targets = b.records.where("problem IS NULL").select(F.col("record_type").alias("target_type"), F.col("record_id").alias("target_id"))
    links = source.references(b).unionByName(_deep_references(b)) if closed else source.references(b)
    broken = admission.reference_problems(links, targets)
    place = lambda c: [F.lit(None).cast("string").alias("file"), F.substring_index(c, ":", 1).alias("record_type"), F.expr(f"substring({c}, locate(':', {c}) + 1)").alias("record_id")]
    files = b.artifact_states().where("status <> 'snapshot_read'")
    found = b.problems.unionByName(broken.select(*place("source"), "problem")).unionByName(files.select(*place("key"), F.concat(F.lit("artifact_"), "status").alias("problem")))
    found = written(found.distinct())
    rows = b.records.groupBy("record_type").agg(F.count(F.lit(1)).alias("records"), F.count("problem").alias("malformed"))
    evidential = ["reference_missing", "artifact_external_not_fetched", "artifact_content_unknown", "artifact_content_unavailable", "artifact_content_not_applicable"]
    stop = found.where(~F.col("problem").isin(*evidential)).take(1)
    return Validation(profile(b.manifest), found, rows, 2 if stop else 0)


def analyze(spark: SparkSession, root: str, manifest: str = "bundle.json", *, closed: bool = False) -> Analysis:
    """The measurement profile of a bundle: selection first, outcomes after it, no pooling across cells.

    ``closed``: records with any defect of their shape take part in nothing.
    """
    b = source.load_bundle(spark, root, manifest, closed=closed)
    config = b.manifest["analysis_config"]
    real = b.table("realization").select("sample_id", F.col("analysis_cell_id").alias("cell"), known(F.col("sample_order")).alias("sample_order"), known(F.col("output_content_hash")).alias("hash"))
    selected = b.declared("selection", "analysis_cell_id string, selected_sample_ids struct<state:string,value:array<string>>, sample_order struct<state:string,value:array<string>>")
    order = selected.select(F.col("analysis_cell_id").alias("cell"), F.posexplode(F.coalesce(F.col("sample_order.value"), F.col("selected_sample_ids.value"))).alias("_place", "sample_id"))
    cells = b.table("cell").select(F.col("analysis_cell_id").alias("cell"), "frame_id")
    samples = real.join(order, ["cell", "sample_id"], "left_semi").join(cells, "cell", "left")
    corrections, artifacts, support = written(b.corrections()), written(b.artifact_states()), written(b.support())
    outputs = b.table("realization").select("sample_id", known(F.col("output_content_hash")).alias("hash"), F.concat_ws(":", "output_ref.value.record_type", "output_ref.value.record_id").alias("output"))
    wrong = admission.output_mismatches(outputs, artifacts)
    samples = written(samples)
    a, v = _axis(b, "assignment", samples, corrections, support, artifacts, wrong), _axis(b, "validity", samples, corrections, support, artifacts, wrong)
    a, v = written(a), written(v)
    views = admission.populations(a, v).join(samples.select("sample_id", "cell"), "sample_id")
    rows = samples.join(a.select("sample_id", (F.col("status") == "accepted").alias("classified")), "sample_id").join(v.select("sample_id", F.when(F.col("status") == "accepted", F.col("outcome")).otherwise("not_assessed").alias("validity")), "sample_id")
    counted = views.groupBy("cell", "view", "class").agg(F.count(F.lit(1)).alias("n")).withColumn("_key", F.struct("cell", "view"))
    measured = metrics.distribution(counted, "_key", config.get("empirical_threshold"))
    measured = measured.select("_key.cell", "_key.view", *[c for c in measured.columns if c != "_key"])
    if "threshold_support" not in measured.columns:
        measured = measured.withColumn("threshold_support", F.lit(None).cast("long"))
    prefixes = None
    for view in ("classified_all", "classified_valid"):
        own = order.join(views.where(F.col("view") == view).select("sample_id", "class"), "sample_id", "left")
        part = metrics.prefix_distinct(own, config.get("requested_k") or [1], ["_place"]).withColumn("view", F.lit(view))
        prefixes = part if prefixes is None else prefixes.unionByName(part)
    broken = b.problems.where(~F.col("problem").isin("reference_missing")).take(1)
    return Analysis(b.problems, a.unionByName(v), views, metrics.coverage(rows), measured, prefixes, 2 if broken else 0)
