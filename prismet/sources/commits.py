"""Several tables published as one: data first, then one claim of a numbered commit that no other writer can take [K1, K2].

A commit is a small file that names where each table lies. Readers follow the last one, so they see all tables of a
publication or none. A number is claimed without replacing: of two writers of one number the first wins whole, the other
gets ``PublicationConflict`` and has changed nothing that a reader sees.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class PublicationConflict(RuntimeError):
    """Another writer has taken the number of this commit."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _write(spark: SparkSession, path: str, text: str) -> None:
    out = _files(spark, path).create(_path(spark, path), False)
    out.write(bytearray(text.encode()))
    out.close()


def claim(spark: SparkSession, path: str, text: str) -> None:
    """Make ``path`` with this content in one step, or raise PublicationConflict if it exists: never half, never replaced.

    The content is written aside first. On a local disk a hard link takes the name, elsewhere a rename that refuses to
    replace, which the store's name server decides.
    """
    aside = f"{path}.{uuid.uuid4().hex}.part"
    _write(spark, aside, text)
    jvm, fs = spark._jvm, _files(spark, path)
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.io.File(_path(spark, p).toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(path), local(aside))
        else:
            once = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            once[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(_path(spark, aside), _path(spark, path), once)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            raise PublicationConflict(path) from e
        raise
    finally:
        fs.delete(_path(spark, aside), False)


def _name(number: int) -> str:
    return f"{number:012d}.json"


def last(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the last commit; (0, {}) before the first."""
    folder = f"{root.rstrip('/')}/commits"
    fs = _files(spark, folder)
    if not fs.exists(_path(spark, folder)):
        return 0, {}
    names = sorted(n for s in fs.listStatus(_path(spark, folder)) if (n := s.getPath().getName()).endswith(".json"))
    if not names:
        return 0, {}
    reader = fs.open(_path(spark, f"{folder}/{names[-1]}"))
    try:
        return int(names[-1][:-5]), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(reader, "UTF-8"))
    finally:
        reader.close()


def commit(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Publish ``content`` as commit ``number``; raises PublicationConflict if that number is taken."""
    folder = f"{root.rstrip('/')}/commits"
    _files(spark, folder).mkdirs(_path(spark, folder))
    claim(spark, f"{folder}/{_name(number)}", json.dumps(content, sort_keys=True))


def publish(tables: dict[str, DataFrame], root: str, *, after: int | None = None) -> int:
    """Write all tables and commit them as one; the number of the commit.

    ``after``: the last commit that the tables were made from; another writer's commit since then is a conflict. Tables
    of earlier commits that this one does not name stay published.
    """
    spark = next(iter(tables.values())).sparkSession
    number, content = last(spark, root)
    if after is not None and number != after:
        raise PublicationConflict(f"{root}: commit {number} has been made since {after}")
    place = f"data/{uuid.uuid4().hex}"
    paths = dict(content.get("tables", {}))
    for name, df in tables.items():
        df.write.parquet(f"{root.rstrip('/')}/{place}/{name}")
        paths[name] = [f"{place}/{name}"]
    commit(spark, root, number + 1, content | {"tables": paths})
    return number + 1


def read(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    """A table as of the last commit, or of an earlier one."""
    n, content = last(spark, root)
    if number is not None and number != n:
        fs, file = _files(spark, root), f"{root.rstrip('/')}/commits/{_name(number)}"
        reader = fs.open(_path(spark, file))
        content = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(reader, "UTF-8"))
        reader.close()
    return spark.read.parquet(*[f"{root.rstrip('/')}/{p}" for p in content["tables"][name]])
