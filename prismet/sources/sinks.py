"""Reports and other outputs: canonical bytes, eight sections, redaction, blind exports, publication without overwriting."""

from __future__ import annotations

import random
import secrets
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.functions.canonical import canonical_bytes, digest
from prismet.sources import commits

#: Titles of the report's sections (fixed values).
SECTIONS = [
    "Task, evidence and permitted claim scope",
    "Attempts, positions and actual realizations",
    "Classification and validity accounting",
    "Per-cell structural metrics",
    "Fixed prefixes and reference coverage",
    "Study comparisons and uncertainty",
    "Surface and within-class diagnostics",
    "Integrity, corrections and release restrictions",
]


def render_json(sections: dict[str, object]) -> bytes:
    """The report in canonical form [K3, K4]; absent sections say so."""
    return canonical_bytes({"report_version": "0.1", "sections": [{"title": t, "content": sections.get(t, {"status": "not_requested"})} for t in SECTIONS]})


def render_markdown(sections: dict[str, object]) -> str:
    """The same tree as headings and lists [K4]."""

    def lines(x, depth=0):
        pad = "  " * depth
        if isinstance(x, dict):
            for k in sorted(x):
                v = x[k]
                yield from [f"{pad}- {k}:", *lines(v, depth + 1)] if isinstance(v, dict | list) else [f"{pad}- {k}: {v}"]
        elif isinstance(x, list):
            for v in x:
                yield from lines(v, depth) if isinstance(v, dict | list) else [f"{pad}- {v}"]
        else:
            yield f"{pad}- {x}"

    return "\n\n".join("\n".join([f"## {n}. {t}", *lines(sections.get(t, {"status": "not_requested"}))]) for n, t in enumerate(SECTIONS, 1)) + "\n"


def table_rows(df: DataFrame, order: list[str]) -> list[dict]:
    """A small result table in a fixed order, as plain values."""
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def redacted(df: DataFrame, private: list[str]) -> DataFrame:
    """Free text replaced by its state and digest [K5]."""
    return df.select(*[F.struct(F.when(F.col(c).isNull(), "absent").otherwise("redacted").alias("state"), F.sha2(F.col(c).cast("string"), 256).alias("record_sha256")).alias(c) if c in private else F.col(c) for c in df.columns])


def declared_date(c):
    """A date is disclosed as it is, anything else only by its state [K6]."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.struct(F.lit("disclosed").alias("state"), c.alias("value"))).otherwise(F.struct(F.when(c.isNull(), "absent").otherwise("withheld").alias("state"), F.lit(None).cast("string").alias("value")))


def blind_export(items: DataFrame, key: str, seed: int, secret: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Shuffled items under pseudonyms, and the restricted map back [K7, T6].

    Pseudonyms are keyed digests: without ``secret`` (256 random bits by default, never written) the list of keys does not
    lead back from them. ``seed`` sets the order only.
    """
    secret = secret or secrets.token_hex(32)
    inner = F.sha2(F.concat_ws(":", F.lit(secret), F.col(key).cast("string")), 256)
    alias = F.substring(F.sha2(F.concat_ws(":", F.lit(secret), inner), 256), 1, 16)
    named = items.withColumn("pseudonym", alias)
    return named.drop(key).orderBy(F.xxhash64("pseudonym", F.lit(seed))), named.select("pseudonym", key)


def publish(df: DataFrame, path: str) -> None:
    """Write a table to a place where nothing is yet [K1, K2]; Spark's committer moves it in as a whole."""
    df.write.mode("errorifexists").parquet(path)


def publish_files(spark: SparkSession, files: dict[str, bytes], path: str) -> None:
    """Write a report set [K1]: staged beside the target, then renamed, never over anything.

    A claim beside the target decides between two writers before either renames, so that one of them publishes whole and
    the other fails.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}")
    fs.mkdirs(staged)
    for name, data in sorted(files.items()):
        out = fs.create(jvm.org.apache.hadoop.fs.Path(staged, name), False)
        out.write(bytearray(data))
        out.close()
    try:
        commits.claim(spark, f"{path.rstrip('/')}.claim", staged.getName())
    except commits.PublicationConflict as e:
        fs.delete(staged, True)
        raise FileExistsError(path) from e
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, True)
        raise FileExistsError(path)


def run_manifest(config: dict, inputs: dict[str, str], outputs: dict[str, bytes], replay: dict | None = None) -> dict:
    """What a run read, how it was set, and what it made [K9]."""
    return {"configuration_sha256": digest(config), "inputs": dict(sorted(inputs.items())), "outputs": {k: digest(v.decode()) for k, v in sorted(outputs.items())}, "replay_sha256": replay["sha256"] if replay else None, "software": "prismet 0.1.0"}


def templates(design: DataFrame) -> DataFrame:
    """Empty collection rows of every registered call [K8]."""
    return design.select("group", "block", "condition", "call_order").distinct().withColumns({"call_status": F.lit("planned"), "observed_at": F.lit(None).cast("string")})


def shuffled(items: list, seed: int) -> list:
    out = list(items)
    random.Random(seed).shuffle(out)
    return out
