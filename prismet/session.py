"""Spark sessions of the engine, and its code on their executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(name: str = "prismet", **conf: str) -> SparkSession:
    """A session with the settings the engine relies on: UTC, ANSI arithmetic, adaptive execution."""
    builder = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}.items():
        builder = builder.config(k, v)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_place(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the whole cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="prismet-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/prismet-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, which ends its lineage: for iterations and for tables that many readers share."""
    path = shared_place(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task of ``gathered``, about.
TASK_ROWS = 500_000


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with rows of equal ``keys`` together, in as many tasks as its rows need: a task's memory does not grow with the table.

    What is grouped, or ranked, by these keys or by more than these needs no further shuffle. Costs one count of the rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-df.count() // TASK_ROWS)), *keys)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that they need no copy of the repository."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="prismet-")), "prismet_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
