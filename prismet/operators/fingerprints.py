"""Fingerprints of views: digests of any number of rows that neither their order nor their partitions change [V7].

A row's digest places it in a trie of hex digits. A node of the lowest level digests its rows' digests, in order and with
how often each occurs; every node above digests its up to sixteen children. The trie is as deep as its rows need, so that
a lowest node holds about ``NODE`` of them: nothing is ever gathered but a node, and two views that differ can be compared
level by level down to the ranges in which they do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismet.session import written

#: Different rows of a lowest node, about.
NODE = 4096


def row_digest(*columns: Column) -> Column:
    """SHA-256 of a row: each value with its length in bytes before it, ``-`` for null, so that no value can pass for two."""
    text = lambda c: c.cast("string")
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns]), 256)


def trie(rows: DataFrame, view: list[str], columns: list[str], *, node: int = NODE) -> DataFrame:
    """view, prefix, digest, rows of every node; the root of a view has the empty prefix. Views without rows have none.

    Equal rows are one line with their count before anything is gathered, so a row that is a third of a view is no hot one.
    """
    counts = written(rows.select(*view, row_digest(*[F.col(c) for c in columns]).alias("_h")).groupBy(*view, "_h").agg(F.count(F.lit(1)).alias("_n")))
    # Digits that a view's lowest nodes are told apart by: sixteen times as many nodes for each.
    deep = counts.groupBy(*view).agg(F.greatest(F.lit(0), F.ceil(F.log(F.count(F.lit(1)) / F.lit(float(node))) / F.log(F.lit(16.0)))).cast("int").alias("_deep"))
    most = deep.agg(F.max("_deep")).first()[0]
    if most is None:
        most = 0
    placed = counts.join(deep, view) if view else counts.crossJoin(F.broadcast(deep))
    line = F.concat_ws(":", "_h", F.col("_n").cast("string"))
    lowest = placed.groupBy(*view, "_deep", F.expr("substring(_h, 1, _deep)").alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("digest"), F.sum("_n").alias("rows"))
    level = written(lowest)
    out = level
    for depth in range(most, 0, -1):
        own = level.where(F.length("prefix") == depth)
        above = own.groupBy(*view, "_deep", F.expr(f"substring(prefix, 1, {depth - 1})").alias("prefix")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: x["digest"]), ","), 256).alias("digest"), F.sum("rows").alias("rows"))
        above = written(above)
        out = out.unionByName(above)
        level = level.where(F.length("prefix") < depth).unionByName(above)
    return out.select(*view, "prefix", "digest", "rows")


def fingerprints(rows: DataFrame, view: list[str], columns: list[str], *, node: int = NODE) -> DataFrame:
    """view, fingerprint, rows of each view."""
    return trie(rows, view, columns, node=node).where("prefix = ''").select(*view, F.col("digest").alias("fingerprint"), "rows")


def differing(a: DataFrame, b: DataFrame, view: list[str]) -> DataFrame:
    """view, prefix of the lowest nodes in which two tries differ: the ranges that must be looked at, and no others."""
    lowest = lambda t: t.join(t.groupBy(*view).agg(F.max(F.length("prefix")).alias("_m")), view).where(F.length("prefix") == F.col("_m")).select(*view, "prefix", "digest") if view else t.where(F.length("prefix") == (t.agg(F.max(F.length("prefix"))).first()[0] or 0)).select("prefix", "digest")
    x, y = lowest(a), lowest(b).withColumnRenamed("digest", "_other")
    return x.join(y, [*view, "prefix"], "full_outer").where(~F.col("digest").eqNullSafe(F.col("_other"))).select(*view, "prefix")
